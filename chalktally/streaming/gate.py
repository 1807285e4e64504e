"""The chat gate on a stream of requests.

``decide`` is a stream from requests to decisions: the tokens that the users of a
bucket have used on a day are the state of (bucket, day), kept by Spark from one
micro-batch to the next, restored after a restart, and dropped when the day is over.

``process_batch`` judges a batch against usage that lies in tables. A store has the decisions and the usage of each micro-batch under its id, and
every ``COMPACT`` batches a snapshot of all usage so far under the id of its last
batch. A batch sees the newest snapshot before it and the batches in between.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chalktally.functions import expr
from chalktally.operators import gate, usage
from chalktally.sources.tables import Tables

COMPACT = 64
DAY_MS = 86_400_000
#: Of users in the state of ``decide``.
BUCKETS = 256


def _usage_schema(user_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("user_id", user_type),
            T.StructField("tokens_used", T.LongType()),
            T.StructField("request_count", T.IntegerType()),
            T.StructField("batch_id", T.LongType()),
            T.StructField("date", T.DateType()),
        ]
    )


def _stored(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """A stored table, empty only if nothing has been stored there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def usage_before(spark: SparkSession, user_type: T.DataType, batch_id: int, store: str) -> DataFrame:
    """What earlier batches used. Batches are told apart by id: a batch that runs
    again does not see its own first attempt."""
    schema = _usage_schema(user_type)
    snapshots = _stored(spark, schema, f"{store}/snapshots").where(F.col("batch_id") < batch_id)
    last = snapshots.agg(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0]
    batches = _stored(spark, schema, f"{store}/usage").where(
        (F.col("batch_id") > last) & (F.col("batch_id") < batch_id)
    )
    return usage.compact(snapshots.where(F.col("batch_id") == last).unionByName(batches))


def process_batch(
    batch: DataFrame, batch_id: int, users: DataFrame, sessions: DataFrame, store: str
) -> None:
    """Judge one micro-batch and store its decisions and its usage under its
    id. Running it again replaces both with the same rows. Days before the first
    of the batch are not read."""
    spark = batch.sparkSession
    user_type = batch.schema["user_id"].dataType
    batch = batch.persist()
    try:
        days = batch.select(expr.day("created_at").alias("date")).distinct()
        before = usage_before(spark, user_type, batch_id, store).join(days, "date", "left_semi")
        decided = gate.replay_decisions(batch, users, sessions, before)
        path = f"{store}/decisions/batch_id={batch_id}"
        decided.write.mode("overwrite").parquet(path)
        admitted = spark.read.schema(decided.schema).parquet(path).where(F.col("status") == 200)
        usage.daily(admitted).write.mode("overwrite").partitionBy("date").parquet(
            f"{store}/usage/batch_id={batch_id}"
        )
    finally:
        batch.unpersist()
    if (batch_id + 1) % COMPACT == 0:
        usage_before(spark, user_type, batch_id + 1, store).write.mode("overwrite").partitionBy(
            "date"
        ).parquet(f"{store}/snapshots/batch_id={batch_id}")


def decisions(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/decisions")


def start(
    requests: DataFrame,
    load: Callable[[], Tables],
    store: str,
    checkpoint: str,
) -> StreamingQuery:
    """Gate a stream of requests, micro-batch by micro-batch in arrival order.
    The tables are loaded anew for each, so a deletion acts at once."""

    def step(batch: DataFrame, batch_id: int) -> None:
        tables = load()
        process_batch(batch, batch_id, tables.users, tables.sessions, store)

    return (
        requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).start()
    )


def _judge(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """The requests of a bucket's users on a day that came in a micro-batch, each
    user's in order. The sum of all that reach the quota gives the verdicts of
    summing the admitted ones, as in a replay."""
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(batches), ignore_index=True)
    codes, names = pd.factorize(rows["user_id"])
    rows = rows.assign(_user=codes).sort_values(["_user", "created_at", "request_id"])
    codes = rows["_user"].to_numpy()
    first = np.flatnonzero(np.diff(codes, prepend=-2))
    last = np.append(first[1:], len(rows)) - 1
    # The place of a row's user among those of the group; nobody is one of them.
    of = np.repeat(np.arange(len(first)), last - first + 1)
    who = [names[c] if c >= 0 else None for c in codes[first]]
    stored = dict(zip(*state.get, strict=True)) if state.exists else {}

    def before(values: np.ndarray) -> np.ndarray:
        sums = np.cumsum(values) - values
        return sums - sums[first][of]

    tokens = rows["tokens"].fillna(0).to_numpy(np.int64)
    asked = rows["refusal"].isna().to_numpy()
    used = np.array([stored.get(u, 0) for u in who], np.int64)[of] + before(tokens)
    # Before the first request that reaches the quota nothing counts as used.
    known = np.array([u in stored for u in who], bool)[of]
    counted = known | (before(asked.astype(np.int64)) > 0)
    quota = rows["quota"].to_numpy(np.float64)
    full = asked & counted & (used >= quota)
    status = np.where(full, 429, np.where(asked, 200, rows["refusal"].fillna(0)))
    if asked.any():
        some = np.bincount(of, weights=asked) > 0
        ends = (used + tokens)[last].tolist()
        stored |= {u: end for u, end, any_ in zip(who, ends, some, strict=True) if any_}
        state.update((list(stored), list(stored.values())))
    if stored:
        # The day's end in event time; the watermark comes later by its delay.
        day_end = (pd.Timestamp(key[1]).value // 1_000_000) + DAY_MS
        state.setTimeoutTimestamp(max(day_end, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(
        {
            "request_id": rows["_request"].to_numpy(),
            "user_id": rows["user_id"].to_numpy(),
            "session_id": rows["session_id"].to_numpy(),
            "created_at": rows["created_at"].to_numpy(),
            "status": status.astype(np.int32),
        }
    )


def decide(
    requests: DataFrame,
    users: DataFrame,
    sessions: DataFrame,
    delay: str = "1 day",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Decisions on a stream of requests (request_id, user_id, session_id, created_at,
    total_tokens): request_id, user_id, session_id, created_at, status.

    Requests of a user and day are judged in the order in which micro-batches
    bring them, within one by time and id. What comes when the day has been over
    for ``delay``, by the newest request seen, is dropped, as Spark does with late
    rows: its day's usage is forgotten by then.

    Users are dealt to ``buckets`` by a hash, and a bucket's users of a day are
    judged in one call, so the number of calls and of entries in the state follows
    from the days and not from the users. In a task is what a bucket's users ask in
    one micro-batch, which the source's limits bound. As with the number of shuffle
    partitions, a checkpoint goes with its number of buckets.
    """
    callers = gate._callers(users, F.col("daily_token_quota").alias("_quota"))
    door = gate._door(requests.withWatermark("created_at", delay), callers, sessions)
    types = {f.name: f.dataType for f in requests.schema.fields}
    ids = ("request_id", "user_id", "session_id")
    # Ids that are given back travel as text: in a column with nulls pandas would
    # make floating-point numbers of them.
    rows = door.select(
        F.pmod(F.hash("user_id"), F.lit(buckets)).alias("bucket"),
        F.date_format("created_at", "yyyy-MM-dd").alias("day"),
        F.col("user_id").cast("string").alias("user_id"),
        "request_id",
        F.col("request_id").cast("string").alias("_request"),
        F.col("session_id").cast("string").alias("session_id"),
        "created_at",
        F.when(F.col("_refusal").isNull(), F.col("total_tokens")).cast("long").alias("tokens"),
        F.col("_refusal").cast("int").alias("refusal"),
        F.col("_quota").cast("long").alias("quota"),
    )
    shape = T.StructType(
        [T.StructField(n, T.StringType()) for n in ids]
        + [T.StructField("created_at", types["created_at"]), T.StructField("status", T.IntegerType())]
    )
    decided = rows.groupBy("bucket", "day").applyInPandasWithState(
        _judge, shape, "users array<string>, used array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return decided.select(*(F.col(n).cast(types[n]).alias(n) for n in ids), "created_at", "status")


def write_decisions(
    decided: DataFrame, out: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append every decision to a table, once."""
    writer = (
        decided.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
