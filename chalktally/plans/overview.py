"""Student overview: who used how much of the quota today."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from chalktally.operators import usage


def student_overview(users: DataFrame, usage_stats: DataFrame, today: dt.date) -> DataFrame:
    """Active students with tokens, requests, percentage, band and label."""
    summary = usage.student_overview(users, usage_stats, today)
    return usage.with_quota_share(summary, "tokens_used_today", "daily_token_quota")
