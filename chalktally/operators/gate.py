"""Access and quota decisions, as HTTP-like status codes per request row."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalktally.functions import expr
from chalktally.operators import skew

# The areas of the interface and the roles that see them.
AREAS = {
    "admin": ["Admin Panel", "Teacher Console", "AI Chat"],
    "teacher": ["Teacher Console", "AI Chat"],
    "student": ["AI Chat"],
}
# The roles each gate admits.
GATES = {
    "user": ["student", "teacher", "admin"],
    "teacher": ["teacher", "admin"],
    "admin": ["admin"],
}
_DAY_KEYS = ["user_id", "date"]
_ORDER = ["created_at", "request_id"]


def _callers(users: DataFrame, *columns: str) -> DataFrame:
    """Live accounts; a caller without one is unknown or deleted."""
    return users.where(~F.col("is_deleted")).select(
        F.col("id").alias("user_id"), F.lit(True).alias("_known"), *columns
    )


def role_decisions(requests: DataFrame, users: DataFrame, gate: str) -> DataFrame:
    """Add ``status`` for the gate named in column ``gate``: 401 for an unknown
    or deleted caller, 403 for a role the gate does not admit, else 200."""
    admitted = F.lit(False)
    for name, roles in GATES.items():
        admitted = admitted | ((F.col(gate) == name) & F.col("_role").isin(roles))
    return (
        requests.join(_callers(users, F.col("role").alias("_role")), "user_id", "left")
        .withColumn(
            "status",
            F.when(F.col("_known").isNull(), 401).when(~admitted, 403).otherwise(200),
        )
        .drop("_known", "_role")
    )


def own_accounts(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Add the caller's own account and ``status``: 401 if there is none."""
    columns = ("username", "role", "daily_token_quota", "is_deleted")
    return (
        requests.join(_callers(users, *columns), "user_id", "left")
        .withColumn("status", F.when(F.col("_known").isNull(), 401).otherwise(200))
        .drop("_known")
    )


def session_read_decisions(
    requests: DataFrame, users: DataFrame, sessions: DataFrame
) -> DataFrame:
    """Reading one session by id: 401, then 404 if it does not exist, then 403
    if it belongs to somebody else, else 200. A deleted session stays readable."""
    owners = sessions.select(F.col("id").alias("session_id"), F.col("user_id").alias("_owner"))
    return (
        requests.join(_callers(users), "user_id", "left")
        .join(owners, "session_id", "left")
        .withColumn(
            "status",
            F.when(F.col("_known").isNull(), 401)
            .when(F.col("_owner").isNull(), 404)
            .when(F.col("_owner") != F.col("user_id"), 403)
            .otherwise(200),
        )
        .drop("_known", "_owner")
    )


def audit_decisions(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Auditing ``student_id``: 404 unless it is a live student, else 200."""
    students = users.where((F.col("role") == "student") & ~F.col("is_deleted")).select(
        F.col("id").alias("student_id"), F.lit(True).alias("_student")
    )
    return (
        requests.join(students, "student_id", "left")
        .withColumn("status", F.when(F.col("_student"), 200).otherwise(404))
        .drop("_student")
    )


def _door(requests: DataFrame, callers: DataFrame, sessions: DataFrame) -> DataFrame:
    """Add ``_refusal``: 401, 422 or 404 for what never reaches the quota, else
    NULL. Requests that carry a ``message`` need one of a character at least."""
    said = F.lit(True)
    if "message" in requests.columns:
        said = F.coalesce(F.length("message") > 0, F.lit(False))
    own = (
        sessions.where(~F.col("is_deleted"))
        .select(F.col("id").alias("session_id"), "user_id", F.lit(True).alias("_own"))
    )
    return (
        requests.join(callers, "user_id", "left")
        .join(own, ["session_id", "user_id"], "left")
        .withColumn(
            "_refusal",
            F.when(F.col("_known").isNull(), 401)
            .when(~said, 422)
            .when(F.col("_own").isNull(), 404),
        )
        .drop("_known", "_own")
    )


def chat_decisions(
    requests: DataFrame,
    users: DataFrame,
    sessions: DataFrame,
    usage_stats: DataFrame,
    today: dt.date,
) -> DataFrame:
    """Add ``status``, every request judged against the usage stored for
    ``today``: 401, then 422 for an empty message, then 404 unless the session is the caller's own and live,
    then 429 at or above the quota, else 200. Without a usage row the quota is
    not looked at, so even quota 0 passes."""
    used = usage_stats.where(F.col("date") == F.lit(today)).select(
        "user_id", F.col("tokens_used").alias("_used")
    )
    callers = _callers(users, F.col("daily_token_quota").alias("_quota")).join(
        used, "user_id", "left"
    )
    return (
        _door(requests, callers, sessions)
        .withColumn(
            "status",
            F.coalesce(
                "_refusal", F.when(F.col("_used") >= F.col("_quota"), 429), F.lit(200)
            ),
        )
        .drop("_refusal", "_used", "_quota")
    )


def quota_replay(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Add ``refused``: what the user used earlier that day reached the quota.

    Summing all earlier requests gives the verdict of summing the admitted ones:
    totals are not negative and the quota is constant over the day, so after the
    first refusal every later request is refused as well. A day's first request
    has no earlier ones (NULL) and passes.
    """
    quotas = users.select(
        F.col("id").alias("user_id"), F.col("daily_token_quota").alias("_quota")
    )
    rows = requests.withColumn("date", expr.day("created_at")).join(quotas, "user_id", "left")
    running = skew.earlier(rows, _DAY_KEYS, _ORDER, F.col("total_tokens"), "_earlier")
    return running.withColumn(
        "refused", F.coalesce(F.col("_earlier") >= F.col("_quota"), F.lit(False))
    ).select(*requests.columns, "refused")


def replay_decisions(
    requests: DataFrame,
    users: DataFrame,
    sessions: DataFrame,
    usage_before: DataFrame | None = None,
) -> DataFrame:
    """The chat gate in arrival order: 401 and 404 first, then the quota against
    what the admitted requests before this one used on the same day.

    ``usage_before`` holds tokens already used per (user, date) when the rows
    arrive. Requests refused at the door carry no tokens into the running sum.
    """
    callers = _callers(users, F.col("daily_token_quota").alias("_quota"))
    judged = _door(requests.withColumn("date", expr.day("created_at")), callers, sessions)
    tokens = F.when(F.col("_refusal").isNull(), F.col("total_tokens"))
    running = skew.earlier(judged, _DAY_KEYS, _ORDER, tokens, "_earlier")
    if usage_before is not None:
        stored = usage_before.select(*_DAY_KEYS, F.col("tokens_used").alias("_stored"))
        running = running.join(stored, _DAY_KEYS, "left").withColumn(
            "_earlier", skew.plus("_earlier", "_stored")
        )
    status = F.coalesce("_refusal", F.when(F.col("_earlier") >= F.col("_quota"), 429), F.lit(200))
    return running.withColumn("status", status).select(*requests.columns, "status")


def areas(users: DataFrame) -> DataFrame:
    """One row per live user and area of the interface the role may see."""
    visible = F.lit(None)
    for role, names in AREAS.items():
        visible = F.when(F.col("role") == role, F.array(*map(F.lit, names))).otherwise(visible)
    return users.where(~F.col("is_deleted")).select(
        "id", "role", F.explode(visible).alias("area")
    )
