"""Reads of the users table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PUBLIC_COLUMNS = ("id", "username", "role", "daily_token_quota", "is_deleted")


def active(users: DataFrame) -> DataFrame:
    """Users that are not deleted, public columns only."""
    return users.where(~F.col("is_deleted")).select(*PUBLIC_COLUMNS)


def active_students(users: DataFrame) -> DataFrame:
    return active(users).where(F.col("role") == "student")


def active_count(users: DataFrame) -> DataFrame:
    return active(users).agg(F.count("*").alias("active_users"))


def resolve_names(names: DataFrame, users: DataFrame) -> DataFrame:
    """The live account behind each ``username``; NULL id where there is none."""
    live = active(users).select("username", F.col("id").alias("user_id"), "role")
    return names.join(live, "username", "left")
