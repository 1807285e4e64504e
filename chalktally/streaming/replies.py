"""Model replies from a stream of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from chalktally import session
from chalktally.functions import expr

_FIELDS = ("session_id", "started_at")
PIECE = 4096
# Chunks joined to a run at most, bytes of those before its last one, rows looked at together.
RUN = 256
CUT = 127
ROWS = 65_536


def chunk_schema(id_type: T.DataType | None = None) -> T.StructType:
    """Every chunk repeats the time its request started, the key by which the
    watermark closes a request. Delta and token counts may be missing."""
    ids = id_type or T.StringType()
    return T.StructType(
        [
            T.StructField("request_id", ids),
            T.StructField("session_id", ids),
            T.StructField("started_at", T.TimestampType()),
            T.StructField("seq", T.IntegerType()),
            T.StructField("delta", T.StringType()),
            T.StructField("prompt_tokens", T.IntegerType()),
            T.StructField("completion_tokens", T.IntegerType()),
        ]
    )


def read_chunks(
    spark: SparkSession,
    directory: str,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Chunk files as a stream."""
    reader = spark.readStream.schema(schema or chunk_schema()).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(directory)


def _text(parts: str):
    return F.array_join(F.transform(F.sort_array(F.col(parts)), lambda p: p.text), "")


def _counts(df: DataFrame) -> DataFrame:
    """Both counts of the chunk that carried usage last; ten for a count that
    is missing or zero."""
    return df.withColumn(
        "prompt_tokens", expr.tokens_or_default("usage.prompt_tokens")
    ).withColumn("completion_tokens", expr.tokens_or_default("usage.completion_tokens"))


def _finish(df: DataFrame, text: Column) -> DataFrame:
    return _counts(df).select(
        "request_id",
        *_FIELDS,
        text.alias("reply"),
        "prompt_tokens",
        "completion_tokens",
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
    )


def _has_text():
    return F.col("delta") != ""


def _usage():
    return F.struct("prompt_tokens", "completion_tokens")


def _usage_seq():
    reported = F.col("prompt_tokens").isNotNull() | F.col("completion_tokens").isNotNull()
    return F.when(reported, F.col("seq"))


def _together(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches joined to tables of about that many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _valid(column: pa.ChunkedArray) -> np.ndarray:
    return column.is_valid().to_numpy()


def _join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_runs`` from chunks. Texts lie one after the other in an Arrow array, so
    those of a run are one text of it with the offsets between them left out."""
    for table in _together(batches, ROWS):
        codes = [
            table[c].combine_chunks().dictionary_encode("encode").indices.to_numpy()
            for c in ("request_id", *_FIELDS)
        ]
        known, seq = _valid(table["seq"]), table["seq"].fill_null(0).to_numpy().astype(np.int64)
        order = np.lexsort((seq, known, *codes))
        table = table.take(order).combine_chunks()
        known, seq = known[order], seq[order]
        delta = pa.concat_arrays(table["delta"].cast(pa.large_string()).fill_null("").chunks)
        _, offsets, text = delta.buffers()
        text = pa.py_buffer(b"") if text is None else text
        ends = np.frombuffer(offsets, np.int64)[delta.offset : delta.offset + len(delta) + 1]
        size, place = np.diff(ends), np.arange(len(delta))

        first = np.ones(len(delta), bool)
        first[1:] = ~(known[1:] & known[:-1] & (seq[1:] == seq[:-1] + 1) & (size[:-1] <= CUT))
        for code in codes:
            first[1:] |= np.diff(code[order]) != 0
        begun = np.maximum.accumulate(np.where(first, place, 0))
        starts = np.flatnonzero(first | ((place - begun) % RUN == 0))
        stops = np.append(starts[1:], len(delta))

        inner = np.ones(len(delta), bool)
        inner[stops - 1] = False
        counted = known & (_valid(table["prompt_tokens"]) | _valid(table["completion_tokens"]))
        last = np.maximum.accumulate(np.where(counted, place, -1))[stops - 1]
        usage = pa.array(last, mask=last < starts)
        bounds = np.append(starts, len(delta))
        cuts = pa.ListArray.from_arrays(
            pa.array(bounds - np.arange(len(bounds)), pa.int32()),
            pa.array(size[inner], pa.int8()),
        )
        runs = table.select(["request_id", *_FIELDS, "seq"]).take(starts)
        joined = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(np.ascontiguousarray(ends[bounds])), text
        )
        runs = runs.append_column("text", joined.cast(pa.string())).append_column("cuts", cuts)
        for name, column in (
            ("usage_seq", "seq"),
            ("prompt_tokens", "prompt_tokens"),
            ("completion_tokens", "completion_tokens"),
        ):
            runs = runs.append_column(name, table[column].take(usage))
        yield from runs.to_batches()


def _runs(chunks: DataFrame) -> DataFrame:
    """Chunks of a request with numbers one after the other that lie near each other in a
    task's rows, joined to one row: the number of the first, the text, the bytes of each
    chunk but the last, and the counts of the chunk that carried usage last."""
    kinds = {f.name: f.dataType for f in chunks.schema.fields}
    counts = ("prompt_tokens", "completion_tokens")
    schema = T.StructType(
        [T.StructField(c, kinds[c]) for c in ("request_id", *_FIELDS, "seq")]
        + [
            T.StructField("text", T.StringType()),
            T.StructField("cuts", T.ArrayType(T.ByteType(), False)),
            T.StructField("usage_seq", kinds["seq"]),
        ]
        + [T.StructField(c, kinds[c]) for c in counts]
    )
    return chunks.select("request_id", *_FIELDS, "seq", "delta", *counts).mapInArrow(
        _join_runs, schema
    )


def _chunks_of_run(run: Column) -> Column:
    """Numbers and texts of a run's chunks, in case other runs have numbers between them."""
    text = run.text.cast("binary")

    def chunk(i: Column) -> Column:
        before = F.aggregate(F.slice(run.cuts, 1, i), F.lit(0), lambda n, cut: n + cut)
        size = F.coalesce(F.get(run.cuts, i).cast("int"), F.octet_length(text))
        return F.struct(
            (run.seq + i).alias("seq"),
            F.substring(text, before + 1, size).cast("string").alias("text"),
        )

    return F.transform(F.sequence(F.lit(0), F.size(run.cuts)), chunk)


def _text_of_runs(runs: str) -> Column:
    """The text of sorted runs. Where one begins before the one before it has ended, chunks
    came twice: then they are parted and sorted one by one."""
    given = F.col(runs)
    apart = F.forall(
        F.zip_with(
            given,
            F.slice(given, 2, F.size(given)),
            lambda a, b: b.isNull() | a.seq.isNull() | (a.seq + F.size(a.cuts) < b.seq),
        ),
        lambda fits: fits,
    )
    parted = F.sort_array(F.flatten(F.transform(given, _chunks_of_run)))
    return F.when(apart, F.array_join(F.transform(given, lambda r: r.text), "")).otherwise(
        F.array_join(F.transform(parted, lambda c: c.text), "")
    )


def assemble(chunks: DataFrame, delay: str | None = None) -> DataFrame:
    """One row per request: deltas joined in order, token counts.

    With ``delay`` (streams) a request is complete when its start lies that far
    behind the newest one, whether or not its stream ended properly, so an
    interrupted reply is stored as far as it came. The state of a request is its
    reply so far, as large as the message it becomes: chunks are joined to runs
    before they are shuffled and stored.
    """
    chunks = _runs(chunks)
    if delay is not None:
        chunks = chunks.withWatermark("started_at", delay)
    run = F.when(F.col("text") != "", F.struct("seq", "text", "cuts"))
    grouped = chunks.groupBy("request_id", *_FIELDS).agg(
        F.collect_list(run).alias("runs"),
        F.max_by(_usage(), F.col("usage_seq")).alias("usage"),
    )
    return _finish(grouped.withColumn("runs", F.sort_array("runs")), _text_of_runs("runs"))


def assemble_by_silence(chunks: DataFrame, gap: str, delay: str | None = None) -> DataFrame:
    """Replies that end when no chunk has come for ``gap``: chunks carry the time
    they came at, ``arrived_at``, and a slow reply stays open as long as it goes
    on. What comes after a longer silence is a further row of the request; rows
    have ``begun``, the arrival of their first chunk, and its token counts are
    those of its own chunks.

    With ``delay`` (streams) a row is written when the newest arrival lies that
    far behind its gap; state is kept per request that isn't silent yet.
    """
    if delay is not None:
        chunks = chunks.withWatermark("arrived_at", delay)
    part = F.when(_has_text(), F.struct("seq", F.col("delta").alias("text")))
    grouped = chunks.groupBy(
        "request_id", "session_id", F.session_window("arrived_at", gap).alias("_open")
    ).agg(
        F.collect_list(part).alias("parts"),
        F.max_by(_usage(), _usage_seq()).alias("usage"),
    )
    return _counts(grouped).select(
        "request_id",
        "session_id",
        F.col("_open.start").alias("begun"),
        _text("parts").alias("reply"),
        "prompt_tokens",
        "completion_tokens",
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
    )


def assemble_batch(chunks: DataFrame, piece: int = PIECE) -> DataFrame:
    """``assemble`` for chunks at rest. Chunks are first joined to pieces of
    ``piece`` chunks, so even one endless reply is spread over many tasks and
    only its text comes together, as the one value it is."""
    part = F.when(_has_text(), F.struct("seq", F.col("delta").alias("text")))
    pieces = (
        chunks.groupBy("request_id", *_FIELDS, F.floor(F.col("seq") / piece).alias("piece"))
        .agg(
            F.collect_list(part).alias("parts"),
            F.max_by(_usage(), _usage_seq()).alias("usage"),
            F.max(_usage_seq()).alias("usage_seq"),
        )
        .withColumn("text", _text("parts"))
    )
    grouped = pieces.groupBy("request_id", *_FIELDS).agg(
        F.collect_list(F.struct("piece", "text")).alias("parts"),
        F.max_by("usage", "usage_seq").alias("usage"),
    )
    return _finish(grouped, _text("parts"))


def assemble_for(admitted: DataFrame, chunks: DataFrame, piece: int = PIECE) -> DataFrame:
    """Replies of the requests in ``admitted`` (request_id) only; chunks of
    others are dropped before any grouping."""
    wanted = admitted.select("request_id").distinct()
    return assemble_batch(chunks.join(wanted, "request_id", "left_semi"), piece)


def write_replies(
    replies: DataFrame, out: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append every completed reply, or other rows of a stream, to a table, once."""
    writer = (
        replies.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    with session.setting(replies.sparkSession, *session.CLEANED):
        return writer.start()
