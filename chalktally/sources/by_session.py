"""Sessions and messages stored by session, so that what is counted, ranked or
nested per session stays in the task that read it.

Both tables are bucketed by the session's id, in equally many buckets, and lie in the
session's catalog. A session of more than ``LONG`` messages would make its bucket one
large task: it and its messages are kept in tables of their own without buckets, and
are read with the plans that split a session. No session is in both parts, so every
result is the union of two.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalktally.operators import prompts
from chalktally.operators import sessions as session_ops

LONG = 100_000
_PARTS = ("sessions", "messages", "long_sessions", "long_messages")


class BySession(NamedTuple):
    sessions: DataFrame
    messages: DataFrame
    long_sessions: DataFrame
    long_messages: DataFrame


def save(
    sessions: DataFrame,
    messages: DataFrame,
    name: str,
    folder: str,
    buckets: int | None = None,
    long: int = LONG,
) -> None:
    """Write the tables ``name``_sessions, ``name``_messages and those of long sessions
    into a new folder; existing tables are never replaced.

    ``buckets`` is by default the number of shuffle partitions. Messages of no known
    session are kept. Counting the messages of a session is summed before its
    exchange; the messages themselves are moved once, to their bucket, and those of
    long sessions not at all.
    """
    spark = messages.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    long_ones = (
        messages.groupBy("session_id").agg(F.count("*").alias("_n")).where(F.col("_n") > long)
    ).select("session_id")
    of_session = long_ones.withColumnRenamed("session_id", "id")

    def bucketed(df: DataFrame, key: str, part: str) -> None:
        # One file a bucket.
        writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        writer.option("path", f"{folder}/{part}").saveAsTable(f"{name}_{part}")

    def plain(df: DataFrame, part: str) -> None:
        df.write.option("path", f"{folder}/{part}").saveAsTable(f"{name}_{part}")

    def split(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        return df.join(ids, ids.columns, how).select(df.columns)

    bucketed(split(sessions, of_session, "left_anti"), "id", "sessions")
    bucketed(split(messages, long_ones, "left_anti"), "session_id", "messages")
    plain(split(sessions, of_session, "left_semi"), "long_sessions")
    plain(split(messages, long_ones, "left_semi"), "long_messages")


def load(spark: SparkSession, name: str) -> BySession:
    return BySession(*(spark.table(f"{name}_{part}") for part in _PARTS))


def summary(stored: BySession) -> DataFrame:
    """``sessions.summary`` of the stored tables."""
    return session_ops.summary(stored.sessions, stored.messages).unionByName(
        session_ops.summary(stored.long_sessions, stored.long_messages)
    )


def with_messages(stored: BySession, page_size: int = session_ops.PAGE_SIZE) -> DataFrame:
    """``sessions.with_messages`` of the stored tables."""
    short = session_ops.with_messages(
        stored.sessions, stored.messages, page_size, bounded=True
    )
    return short.unionByName(
        session_ops.with_messages(stored.long_sessions, stored.long_messages, page_size)
    )


def history(stored: BySession, k: int = prompts.HISTORY) -> DataFrame:
    """``prompts.history`` of the stored tables."""
    return prompts.history(stored.messages, k).unionByName(
        prompts.history(stored.long_messages, k)
    )
