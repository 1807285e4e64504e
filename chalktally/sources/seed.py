"""Example accounts for an empty installation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Username, role, daily token quota.
ACCOUNTS = [
    ("admin", "admin", 100_000),
    ("teacher", "teacher", 100_000),
    ("student1", "student", 50_000),
    ("student2", "student", 50_000),
]


def account_candidates(spark: SparkSession) -> DataFrame:
    """Rows for ``changes.create_users``."""
    rows = [(i, f"seed-{name}", name, role, quota) for i, (name, role, quota) in enumerate(ACCOUNTS)]
    return spark.createDataFrame(
        rows, "row_id long, id string, username string, role string, daily_token_quota int"
    )
