"""Batches of changes: each gives the next snapshot of a table and a status per
change row. Several changes to one key inside a batch act in order."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalktally.operators import checks, skew
from chalktally.operators import rules as rule_ops
from chalktally.operators import sessions as session_ops
from chalktally.operators import users as user_ops
from chalktally.sources.tables import DEFAULT_QUOTA, Tables


class Change(NamedTuple):
    snapshot: DataFrame
    statuses: DataFrame


def _first_per(df: DataFrame, key: str, order: str) -> DataFrame:
    """The earliest row id of each key; reduced map-side, so a key that fills
    the batch costs nothing extra."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def create_users(users: DataFrame, candidates: DataFrame) -> Change:
    """New accounts from (row_id, id, username, role, daily_token_quota).

    422 for values that break a field rule, 409 for a name that is taken, also
    by a deleted account or an earlier row of the batch, else 201.
    """
    filled = candidates.withColumn("role", F.coalesce("role", F.lit("student"))).withColumn(
        "daily_token_quota", F.coalesce("daily_token_quota", F.lit(DEFAULT_QUOTA))
    )
    checked = checks.validate(filled, "users")
    firsts = _first_per(checked.where(F.col("reason").isNull()), "username", "row_id")
    created = (
        firsts.join(users.select("username"), "username", "left_anti")
        .select("row_id", F.lit(True).alias("_created"))
    )
    judged = checked.join(created, "row_id", "left").withColumn(
        "status",
        F.when(F.col("reason").isNotNull(), 422).when(F.col("_created"), 201).otherwise(409),
    )
    fresh = judged.where(F.col("status") == 201).withColumn("is_deleted", F.lit(False))
    columns = user_ops.PUBLIC_COLUMNS
    return Change(
        users.select(*columns).unionByName(fresh.select(*columns)),
        judged.select("row_id", "username", "reason", "status"),
    )


def set_quota(users: DataFrame, changes: DataFrame) -> Change:
    """Quota changes (change_id, user_id, daily_token_quota): 422 for a missing
    or negative quota, 404 for an unknown or deleted user, else 200; the last
    valid change of a user counts."""
    quota = F.col("daily_token_quota")
    valid = F.coalesce(quota >= 0, F.lit(False))
    last = (
        changes.where(valid)
        .groupBy(F.col("user_id").alias("id"))
        .agg(F.max_by("daily_token_quota", "change_id").alias("_quota"))
    )
    snapshot = users.join(last, "id", "left").withColumn(
        "daily_token_quota",
        F.when(~F.col("is_deleted"), F.coalesce("_quota", quota)).otherwise(quota),
    )
    live = users.where(~F.col("is_deleted")).select(
        F.col("id").alias("user_id"), F.lit(True).alias("_live")
    )
    statuses = changes.join(live, "user_id", "left").select(
        "change_id",
        "user_id",
        F.when(~valid, 422).when(F.col("_live").isNull(), 404).otherwise(200).alias("status"),
    )
    return Change(snapshot.select(*users.columns), statuses)


def soft_delete(users: DataFrame, changes: DataFrame) -> Change:
    """Deletions (change_id, user_id): 404 for an unknown or already deleted
    user, also one deleted earlier in the batch, else 204. The row stays."""
    live = users.where(~F.col("is_deleted")).select(F.col("id").alias("user_id"))
    done = _first_per(changes, "user_id", "change_id").join(live, "user_id", "left_semi")
    gone = done.select(F.col("user_id").alias("id"), F.lit(True).alias("_gone"))
    snapshot = users.join(gone, "id", "left").withColumn(
        "is_deleted", F.col("is_deleted") | F.coalesce("_gone", F.lit(False))
    )
    hits = done.select("change_id", F.lit(True).alias("_gone"))
    statuses = changes.join(hits, "change_id", "left").select(
        "change_id", "user_id", F.when(F.col("_gone"), 204).otherwise(404).alias("status")
    )
    return Change(snapshot.select(*users.columns), statuses)


def toggle_rules(rules: DataFrame, changes: DataFrame) -> Change:
    """Toggles (change_id, rule_id): 404 for an unknown rule, else 200 with the
    state after this toggle. Any caller may toggle any rule."""
    counts = changes.groupBy(F.col("rule_id").alias("id")).agg(F.count("*").alias("_n"))
    flipped = F.coalesce(F.col("_n") % 2 == 1, F.lit(False))
    snapshot = rules.join(counts, "id", "left").withColumn(
        "is_active", F.col("is_active") != flipped
    )
    numbered = skew.earlier(changes, ["rule_id"], ["change_id"], F.lit(1), "_before")
    states = rules.select(F.col("id").alias("rule_id"), F.col("is_active").alias("_was"))
    even = F.coalesce("_before", F.lit(0)) % 2 == 0
    statuses = numbered.join(states, "rule_id", "left").select(
        "change_id",
        "rule_id",
        F.when(F.col("_was").isNull(), 404).otherwise(200).alias("status"),
        (F.col("_was") != even).alias("is_active"),
    )
    return Change(snapshot.select(*rules.columns), statuses)


def create_sessions(sessions: DataFrame, new: DataFrame) -> Change:
    """New sessions (id, user_id, title, created_at); the title may be NULL,
    422 if it is too long, else 201."""
    filled = new.withColumn("is_deleted", F.lit(False)).withColumn(
        "applied_rule_id", F.lit(None).cast(sessions.schema["applied_rule_id"].dataType)
    )
    checked = checks.validate(filled, "sessions")
    columns = session_ops.COLUMNS
    fresh = checked.where(F.col("reason").isNull())
    return Change(
        sessions.select(*columns).unionByName(fresh.select(*columns)),
        checked.select(
            "id", "reason", F.when(F.col("reason").isNull(), 201).otherwise(422).alias("status")
        ),
    )


def create_rules(rules: DataFrame, new: DataFrame) -> Change:
    """New rules (id, teacher_id, student_id, rules_json, is_active). A
    ``rules_json`` that is not a string is written as JSON first; no student
    means everyone; active unless said otherwise."""
    if not isinstance(new.schema["rules_json"].dataType, T.StringType):
        new = new.withColumn("rules_json", F.to_json("rules_json"))
    filled = new.withColumn("is_active", F.coalesce("is_active", F.lit(True)))
    checked = checks.validate(filled, "teacher_rules")
    fresh = checked.where(F.col("reason").isNull())
    return Change(
        rules.unionByName(fresh.select(*rules.columns)),
        checked.select(
            "id", "reason", F.when(F.col("reason").isNull(), 201).otherwise(422).alias("status")
        ),
    )


def bind_rules(
    sessions: DataFrame, users: DataFrame, rules: DataFrame, admitted: DataFrame
) -> DataFrame:
    """Sessions with the applied rule filled in: only where none is bound yet
    and the session has an ``admitted`` request (``session_id``)."""
    used = admitted.select(F.col("session_id").alias("id")).distinct()
    used = used.withColumn("_used", F.lit(True))
    rule = rule_ops.effective(users, rules)
    bound = F.when(F.col("_used"), F.col("rule_id"))
    return (
        sessions.select(*session_ops.COLUMNS)
        .join(used, "id", "left")
        .join(rule, "user_id", "left")
        .withColumn("applied_rule_id", F.coalesce("applied_rule_id", bound))
        .select(*session_ops.COLUMNS)
    )


def purge_users(tables: Tables, gone: DataFrame) -> Tables:
    """Hard deletion of users (``user_id``) with all that hangs on them: usage,
    sessions with their messages, rules by or for them. A session that stays
    but used a removed rule loses the reference."""
    ids = gone.select("user_id").distinct()
    teachers = ids.withColumnRenamed("user_id", "teacher_id")
    students = ids.withColumnRenamed("user_id", "student_id")
    rules = tables.teacher_rules.join(teachers, "teacher_id", "left_anti").join(
        students, "student_id", "left_anti"
    )
    removed = (
        tables.teacher_rules.join(teachers, "teacher_id", "left_semi")
        .select("id")
        .union(tables.teacher_rules.join(students, "student_id", "left_semi").select("id"))
        .distinct()
        .select(F.col("id").alias("applied_rule_id"), F.lit(True).alias("_removed"))
    )
    sessions = (
        tables.sessions.join(ids, "user_id", "left_anti")
        .join(removed, "applied_rule_id", "left")
        .withColumn(
            "applied_rule_id", F.when(F.col("_removed").isNull(), F.col("applied_rule_id"))
        )
    )
    lost = tables.sessions.join(ids, "user_id", "left_semi").select(
        F.col("id").alias("session_id")
    )
    return Tables(
        users=tables.users.join(ids.withColumnRenamed("user_id", "id"), "id", "left_anti"),
        teacher_rules=rules.select(*tables.teacher_rules.columns),
        usage_stats=tables.usage_stats.join(ids, "user_id", "left_anti").select(
            *tables.usage_stats.columns
        ),
        sessions=sessions.select(*tables.sessions.columns),
        messages=tables.messages.join(lost, "session_id", "left_anti").select(
            *tables.messages.columns
        ),
    )
