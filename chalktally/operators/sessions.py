"""Chat sessions and their messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalktally.functions import expr
from chalktally.operators import skew
from chalktally.operators import users as user_ops

COLUMNS = ("id", "user_id", "applied_rule_id", "title", "is_deleted", "created_at")
_MESSAGE_FIELDS = (
    "id",
    "session_id",
    "sender",
    "content",
    "prompt_tokens",
    "completion_tokens",
    "total_tokens",
    "created_at",
)
PAGE_SIZE = 1000


def live(sessions: DataFrame) -> DataFrame:
    return sessions.where(~F.col("is_deleted"))


def newest_first(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy("user_id", F.desc("created_at"), F.desc("id"))


def listing(sessions: DataFrame) -> DataFrame:
    """Every user's live sessions, newest first."""
    return newest_first(live(sessions).select(*COLUMNS))


def auditable(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Live sessions of live students: what a teacher may audit."""
    students = user_ops.active_students(users).select(F.col("id").alias("user_id"))
    return live(sessions).select(*COLUMNS).join(students, "user_id", "left_semi")


def audit(sessions: DataFrame, users: DataFrame) -> DataFrame:
    return newest_first(auditable(sessions, users).select(*COLUMNS))


def newest(sessions: DataFrame) -> DataFrame:
    """Per user the session opened by default. A maximum instead of a rank, so
    a user with many sessions is reduced before the exchange."""
    key = F.struct("created_at", "id", "title", "applied_rule_id")
    return (
        live(sessions)
        .groupBy("user_id")
        .agg(F.max(key).alias("s"))
        .select("user_id", "s.id", "s.title", "s.applied_rule_id", "s.created_at")
    )


def summary(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Live sessions with printed title and number of messages, 0 included."""
    counts = messages.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n"))
    return (
        live(sessions)
        .join(counts, "id", "left")
        .select(
            "id",
            "user_id",
            expr.title("title").alias("title"),
            F.coalesce("n", F.lit(0)).alias("message_count"),
        )
    )


def with_messages(
    sessions: DataFrame,
    messages: DataFrame,
    page_size: int = PAGE_SIZE,
    subset: bool = False,
    bounded: bool = False,
) -> DataFrame:
    """Sessions with their messages as an array, oldest first.

    A session of up to ``page_size`` messages is one row with ``page`` 0; a
    longer one continues on further rows, each but the last of them full, so no
    array grows without limit. Sessions without messages have an empty array.
    Messages are numbered over the whole session, from their place in their
    grain and the messages of earlier grains. ``subset`` says that ``sessions``
    are only some of all: messages of the others are then dropped first. ``bounded``
    says that a task can hold any one session's messages: they are then numbered by a
    window over the session, and nothing moves if they lie in buckets by session.
    """
    rows = messages.select(expr.sender_rank("sender").alias("_rank"), *_MESSAGE_FIELDS)
    owners = sessions.select(F.col("id").alias("session_id"), *(c for c in COLUMNS if c != "id"))
    owners = owners.withColumnRenamed("created_at", "_opened")
    if subset:
        rows = rows.join(owners.select("session_id"), "session_id", "left_semi")
    order = ["created_at", "_rank", "id"]
    entry = F.struct(*order, *(c for c in _MESSAGE_FIELDS if c not in order))
    if bounded:
        window = Window.partitionBy("session_id").orderBy(*order)
        counted = rows.withColumn("_before", F.row_number().over(window) - 1)
    else:
        counted = skew.earlier(rows, ["session_id"], order, F.lit(1), "_before")
    pages = (
        counted.withColumn("page", F.floor(F.coalesce("_before", F.lit(0)) / page_size).cast("int"))
        .groupBy("session_id", "page")
        .agg(F.sort_array(F.collect_list(entry)).alias("messages"))
    )
    nothing = F.array().cast(pages.schema["messages"].dataType)
    if bounded:
        nested = owners.join(pages, "session_id", "left").withColumns(
            {"page": F.coalesce("page", F.lit(0)), "messages": F.coalesce("messages", nothing)}
        )
    else:
        # The many pages of a hot session are on the side that can be split.
        full = pages.join(owners, "session_id")
        heard = messages.select("session_id").distinct()
        silent = owners.join(heard, "session_id", "left_anti")
        empty = silent.withColumn("page", F.lit(0)).withColumn("messages", nothing)
        nested = full.unionByName(empty)
    return nested.select(
        F.col("session_id").alias("id"),
        *(c for c in COLUMNS if c not in ("id", "created_at")),
        F.col("_opened").alias("created_at"),
        "page",
        F.transform(
            "messages", lambda m: F.struct(*(m[c].alias(c) for c in _MESSAGE_FIELDS))
        ).alias("messages"),
    )
