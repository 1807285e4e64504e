"""The five tables: declared schemas, create, load, save, append."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the data model.
ROLES = ("student", "teacher", "admin")
SENDERS = ("user", "llm")
DEFAULT_QUOTA = 50_000
USERNAME_MAX = 150
TITLE_MAX = 255


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


# The password hash is a credential and not part of the schema, so no scan
# ever reads it. Instants are UTC.
SCHEMAS: dict[str, T.StructType] = {
    "users": _schema(
        ("id", T.StringType(), False),
        ("username", T.StringType(), False),
        ("role", T.StringType(), False),
        ("daily_token_quota", T.IntegerType(), False),
        ("is_deleted", T.BooleanType(), False),
    ),
    "teacher_rules": _schema(
        ("id", T.StringType(), False),
        ("teacher_id", T.StringType(), False),
        ("student_id", T.StringType(), True),
        ("rules_json", T.StringType(), False),
        ("is_active", T.BooleanType(), False),
    ),
    "usage_stats": _schema(
        ("user_id", T.StringType(), False),
        ("date", T.DateType(), False),
        ("tokens_used", T.LongType(), False),
        ("request_count", T.IntegerType(), False),
    ),
    "sessions": _schema(
        ("id", T.StringType(), False),
        ("user_id", T.StringType(), False),
        ("applied_rule_id", T.StringType(), True),
        ("title", T.StringType(), True),
        ("is_deleted", T.BooleanType(), False),
        ("created_at", T.TimestampType(), False),
    ),
    "messages": _schema(
        ("id", T.StringType(), False),
        ("session_id", T.StringType(), False),
        ("sender", T.StringType(), False),
        ("content", T.StringType(), False),
        ("prompt_tokens", T.IntegerType(), True),
        ("completion_tokens", T.IntegerType(), True),
        ("total_tokens", T.IntegerType(), True),
        ("created_at", T.TimestampType(), False),
    ),
}

# Partition column per large table; a query for one day reads one folder.
_DAY_COLUMN = {"usage_stats": "date", "messages": "created_date"}


class Tables(NamedTuple):
    users: DataFrame
    teacher_rules: DataFrame
    usage_stats: DataFrame
    sessions: DataFrame
    messages: DataFrame


def _stored_schema(name: str) -> T.StructType:
    day = _DAY_COLUMN.get(name)
    fields = [f for f in SCHEMAS[name].fields if f.name != day]
    if day:
        fields.append(T.StructField(day, T.DateType(), True))
    return T.StructType(fields)


def _write(df: DataFrame, name: str, path: str, mode: str) -> None:
    day = _DAY_COLUMN.get(name)
    if name == "messages":
        df = df.withColumn(day, F.to_date("created_at"))
    df = df.select(_stored_schema(name).names)
    if day:
        # AQE merges small and splits large partitions of one day, so neither
        # thousands of small files nor one task for a whole day result.
        df.hint("rebalance", day).write.mode(mode).partitionBy(day).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of table ``name`` in their declared types."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields))


def init(spark: SparkSession, directory: str) -> None:
    """Create the tables that do not exist yet; existing ones stay as they are."""
    for name, schema in SCHEMAS.items():
        _write(spark.createDataFrame([], schema), name, f"{directory}/{name}", "ignore")


def load_one(spark: SparkSession, directory: str, name: str) -> DataFrame:
    df = spark.read.schema(_stored_schema(name)).parquet(f"{directory}/{name}")
    if name == "messages":
        return df
    return df.select(SCHEMAS[name].names)


def load(spark: SparkSession, directory: str) -> Tables:
    """All five tables with their declared schemas. Messages also carry
    ``created_date``, their partition column."""
    return Tables(*(load_one(spark, directory, name) for name in Tables._fields))


def save(tables: Tables, directory: str) -> None:
    """Write a snapshot into a new folder; an existing one is never replaced,
    because the plan may still be reading it."""
    for name in Tables._fields:
        _write(getattr(tables, name), name, f"{directory}/{name}", "errorifexists")


def append_messages(messages: DataFrame, directory: str) -> None:
    """Add message rows to the stored table."""
    _write(messages, "messages", f"{directory}/messages", "append")
