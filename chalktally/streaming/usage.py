"""Daily usage kept up to date from a stream of requests.

The ledger has a narrow row per request, appended exactly once and filed by day;
usage is its sum. Nothing is kept as the stream's state, so days may be any time
apart and rows any time late. ``fold`` keeps a snapshot of it, of which it writes only
the days that something landed for. ``write_closed_days`` is the other form: a row per
user and day, written when the day is over, without what comes later still.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chalktally.functions import expr
from chalktally.operators import usage


def daily_usage(requests: DataFrame, delay: str = "1 day") -> DataFrame:
    """Tokens and requests per user and day, complete when a day ``delay`` later
    has begun. ``delay`` must cover at least one day, or rows of the running day
    would count as late."""
    day = requests.select(
        "user_id", F.date_trunc("day", "created_at").alias("day"), "total_tokens"
    )
    return (
        day.withWatermark("day", delay)
        .groupBy("user_id", "day")
        .agg(
            F.sum("total_tokens").cast("long").alias("tokens_used"),
            F.count("*").cast("int").alias("request_count"),
        )
    )


def write_ledger(
    requests: DataFrame,
    out: str,
    checkpoint: str,
    available_now: bool = False,
    landed: Column | None = None,
) -> StreamingQuery:
    """Append what each request used to the ledger, in a folder per day and day of
    landing: ``landed``, or the day of the micro-batch, which a repeated one keeps."""
    rows = requests.select(
        "user_id",
        F.col("total_tokens").cast("long").alias("tokens_used"),
        F.lit(1).alias("request_count"),
        expr.day("created_at").alias("date"),
        (F.current_date() if landed is None else landed).alias("landed"),
    )
    writer = (
        rows.writeStream.outputMode("append")
        .format("parquet")
        .partitionBy("date", "landed")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _folded(rows: DataFrame, snapshot: str) -> DataFrame:
    """The snapshot, in the types of the ledger; created if there is none."""
    columns = ["user_id", "tokens_used", "request_count", F.col("landed").alias("upto"), "date"]
    schema = rows.select(*columns).schema
    spark = rows.sparkSession
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("date").parquet(snapshot)
    return spark.read.schema(schema).parquet(snapshot)


def _tail(rows: DataFrame, folded: DataFrame) -> DataFrame:
    """What the snapshot does not have yet, by the folders' names alone. A row per day
    of usage comes to the driver."""
    marks = folded.groupBy("date").agg(F.max("upto")).collect()
    if not marks:
        return rows
    upto = F.create_map(*(F.lit(value) for mark in marks for value in mark))[F.col("date")]
    return rows.where(upto.isNull() | (F.col("landed") > upto))


def fold(spark: SparkSession, ledger: str, snapshot: str, until: dt.date) -> None:
    """Bring the snapshot up to what landed on ``until``, a day that is over.

    Days for which nothing landed since keep their files. The others are summed again
    from their folders of the ledger and replaced, each with its own mark, so a fold
    may be repeated, and one that broke off leaves days of both states, which
    ``current`` reads right. The ledger is the record and is kept. Rows without a day
    stay in it. Readers of a day must not run while it is replaced.
    """
    rows = spark.read.parquet(ledger)
    landed = rows.where((F.col("landed") <= F.lit(until)) & F.col("date").isNotNull())
    new = _tail(landed, _folded(rows, snapshot)).select("date").distinct().collect()
    if not new:
        return
    days = usage.compact(landed.where(F.col("date").isin([row.date for row in new])))
    (
        days.withColumn("upto", F.lit(until))
        .hint("rebalance", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(snapshot)
    )


def current(
    spark: SparkSession, ledger: str, since: dt.date | None = None, snapshot: str | None = None
) -> DataFrame:
    """Usage per user and day by the ledger; with ``since`` only the folders of
    that day and later ones are read, with ``snapshot`` only those that landed after
    their day was folded into it."""
    rows = spark.read.parquet(ledger)
    columns = ["user_id", "date", "tokens_used", "request_count"]
    if snapshot is not None:
        folded = _folded(rows, snapshot)
        rows = _tail(rows, folded).select(*columns).unionByName(folded.select(*columns))
    if since is not None:
        rows = rows.where(F.col("date") >= F.lit(since))
    return usage.compact(rows)


def write_closed_days(
    days: DataFrame, out: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append the usage of each day to a table once the day is closed."""
    rows = days.select("user_id", F.to_date("day").alias("date"), "tokens_used", "request_count")
    writer = (
        rows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
