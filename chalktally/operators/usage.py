"""Daily token accounting."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalktally.functions import expr
from chalktally.operators import users as user_ops


def _totals(rows: DataFrame, tokens: str, requests) -> DataFrame:
    return rows.groupBy("user_id", "date").agg(
        F.sum(tokens).cast("long").alias("tokens_used"),
        requests.cast("int").alias("request_count"),
    )


def daily(requests: DataFrame) -> DataFrame:
    """Tokens and requests per user and UTC day, from rows with ``user_id``,
    ``created_at`` and ``total_tokens``."""
    rows = requests.select("user_id", expr.day("created_at").alias("date"), "total_tokens")
    return _totals(rows, "total_tokens", F.count("*"))


def rollup(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """The same from stored messages; only model rows carry counts.

    Messages are reduced to one row per session and day before they meet the
    sessions, so neither a long session nor a busy user makes a hot key.
    """
    per_session = (
        messages.where(F.col("sender") == "llm")
        .groupBy("session_id", expr.day("created_at").alias("date"))
        .agg(F.sum("total_tokens").alias("tokens"), F.count("*").alias("requests"))
    )
    owners = sessions.select(F.col("id").alias("session_id"), "user_id")
    return _totals(per_session.join(owners, "session_id"), "tokens", F.sum("requests"))


def merge(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Add ``delta`` to ``base``: existing (user, day) rows grow, others appear."""
    columns = ["user_id", "date", "tokens_used", "request_count"]
    return compact(base.select(columns).unionByName(delta.select(columns)))


def compact(parts: DataFrame) -> DataFrame:
    """One row per user and day from several."""
    return _totals(parts, "tokens_used", F.sum("request_count"))


def _on_day(usage_stats: DataFrame, today: dt.date) -> DataFrame:
    return usage_stats.where(F.col("date") == F.lit(today)).select(
        F.col("user_id").alias("id"), "tokens_used", "request_count"
    )


def student_overview(users: DataFrame, usage_stats: DataFrame, today: dt.date) -> DataFrame:
    """Active students with what they used on ``today``; none means 0."""
    joined = user_ops.active_students(users).join(_on_day(usage_stats, today), "id", "left")
    return joined.select(
        "id",
        "username",
        "daily_token_quota",
        F.coalesce("tokens_used", F.lit(0)).alias("tokens_used_today"),
        F.coalesce("request_count", F.lit(0)).alias("request_count_today"),
    )


def quota_use(users: DataFrame, usage_stats: DataFrame, today: dt.date) -> DataFrame:
    """Used tokens and limit of every live user, whatever the role."""
    joined = user_ops.active(users).join(_on_day(usage_stats, today), "id", "left")
    return joined.select(
        "id",
        F.coalesce("tokens_used", F.lit(0)).alias("used"),
        F.col("daily_token_quota").alias("limit"),
    )


def with_quota_share(df: DataFrame, used: str, quota: str) -> DataFrame:
    """Add percentage, colour band and printed percentage."""
    return (
        df.withColumn("pct", expr.quota_pct(used, quota))
        .withColumn("band", expr.quota_band("pct"))
        .withColumn("pct_label", expr.quota_label("pct"))
    )
