"""Data-quality checks: field rules, uniqueness, references, bookkeeping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalktally.operators import usage
from chalktally.sources.tables import (
    ROLES,
    SCHEMAS,
    SENDERS,
    TITLE_MAX,
    USERNAME_MAX,
    Tables,
)

# Child table, column, parent table.
RELATIONS = [
    ("teacher_rules", "teacher_id", "users"),
    ("teacher_rules", "student_id", "users"),
    ("usage_stats", "user_id", "users"),
    ("sessions", "user_id", "users"),
    ("sessions", "applied_rule_id", "teacher_rules"),
    ("messages", "session_id", "sessions"),
]
UNIQUE_KEYS = {"users": ["username"], "usage_stats": ["user_id", "date"]}
BUCKETS = 65_536


def blank(c: Column) -> Column:
    """Empty, or nothing but white space."""
    return F.length(F.regexp_replace(c, r"\s+", "")) == 0


def _rules(table: str) -> list[tuple[str, Column]]:
    """Reason and condition of each field rule, in the order they are reported."""
    if table == "users":
        return [
            ("role", ~F.col("role").isin(*ROLES)),
            ("username", ~F.length("username").between(1, USERNAME_MAX)),
            ("daily_token_quota", F.col("daily_token_quota") < 0),
        ]
    if table == "sessions":
        return [("title", F.length("title") > TITLE_MAX)]
    if table == "messages":
        return [("sender", ~F.col("sender").isin(*SENDERS))]
    if table == "requests":
        return [("message", F.col("message").isNull() | blank(F.col("message")))]
    return []


def _missing(table: str, columns: list[str]) -> list[tuple[str, Column]]:
    if table not in SCHEMAS:
        return []
    return [
        (f"{f.name} missing", F.col(f.name).isNull())
        for f in SCHEMAS[table].fields
        if not f.nullable and f.name in columns
    ]


def validate(df: DataFrame, table: str) -> DataFrame:
    """Add ``reason``: the first field rule of ``table`` a row breaks, or NULL."""
    found = [
        F.when(broken, reason) for reason, broken in [*_missing(table, df.columns), *_rules(table)]
    ]
    return df.withColumn("reason", F.coalesce(*found))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with the number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def orphans(child: DataFrame, key: str, parent: DataFrame) -> DataFrame:
    """Rows whose ``key`` names no parent id; NULL names none and passes."""
    ids = parent.select(F.col("id").alias(key))
    return child.where(F.col(key).isNotNull()).join(ids, key, "left_anti")


def orphan_counts(tables: Tables) -> DataFrame:
    """Number of orphans for each of the six references. Keys are counted
    before the join, so a frequent key travels as one row."""

    def one(child: str, key: str, parent: str) -> DataFrame:
        keys = getattr(tables, child).groupBy(key).agg(F.count("*").alias("n"))
        lost = orphans(keys, key, getattr(tables, parent))
        return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans")).select(
            F.lit(f"{child}.{key}").alias("reference"), "orphans"
        )

    return reduce(DataFrame.unionByName, (one(*relation) for relation in RELATIONS))


def usage_drift(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """User-days where the stored usage and the expected one differ, or that
    only one of them has."""

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(
            "user_id",
            "date",
            F.col("tokens_used").alias(f"{prefix}_tokens"),
            F.col("request_count").alias(f"{prefix}_requests"),
        )

    both = side(stored, "stored").join(side(expected, "expected"), ["user_id", "date"], "full")
    same = F.col("stored_tokens").eqNullSafe(F.col("expected_tokens")) & F.col(
        "stored_requests"
    ).eqNullSafe(F.col("expected_requests"))
    return both.where(~same)


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def digests(
    df: DataFrame, keys: list[str], values: list[str], buckets: int = BUCKETS
) -> DataFrame:
    """A row per bucket of keys: ``n`` rows and ``sums`` of two hashes of each, in halves
    that cannot overflow. Neither order nor partitions matter, repeated rows count, and
    a null differs from every value. Only these rows go through an exchange."""
    parts = [part for c in (*keys, *values) for part in (F.col(c).isNull(), F.col(c))]
    sums = []
    for seed in (0, 1):
        h = F.xxhash64(F.lit(seed), *parts)
        sums += [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(h, 32))]
    return df.groupBy(_bucket(keys, buckets).alias("bucket")).agg(
        F.count("*").alias("n"), F.array(*sums).alias("sums")
    )


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Buckets whose digests are not the same on both sides."""
    other = right.select("bucket", F.col("n").alias("_n"), F.col("sums").alias("_sums"))
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("sums").eqNullSafe(F.col("_sums"))
    return left.join(other, "bucket", "full").where(~same).select("bucket")


def usage_drift_by_digests(
    stored: DataFrame, expected: DataFrame, buckets: int = BUCKETS
) -> DataFrame:
    """``usage_drift`` of two tables that lie stored, in the same types: rows are
    joined only in buckets whose digests differ. Both tables are read twice, which
    pays where reading is cheap and few days differ. The buckets are broadcast, at
    most ``buckets`` numbers."""
    keys, values = ["user_id", "date"], ["tokens_used", "request_count"]
    sides = (stored, expected)
    bad = F.broadcast(differing(*(digests(df, keys, values, buckets) for df in sides)))

    def suspects(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", _bucket(keys, buckets)).join(bad, "bucket", "left_semi")

    return usage_drift(*(suspects(df) for df in sides))


def stored_usage_drift(tables: Tables) -> DataFrame:
    """Stored usage against what the stored messages add up to."""
    return usage_drift(tables.usage_stats, usage.rollup(tables.messages, tables.sessions))
