"""The streaming jobs on files that arrive one after the other."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from chalktally import session
from chalktally.operators import gate, usage
from chalktally.streaming import gate as gate_stream
from chalktally.streaming import replies, usage as usage_stream
from rows import as_dict, as_set, at, table, user


def _chunk(request, seq, delta, minute, counts=None):
    prompt, completion = counts or (None, None)
    return (request, "s", at(minute), seq, delta, prompt, completion)


CHUNKS = [
    _chunk("whole", 0, "Un", 0, (4, 1)),
    _chunk("whole", 1, "der the ", 0),
    _chunk("whole", 2, "bridge", 0, (61, 17)),
    _chunk("whole", 3, ".", 0),
    _chunk("twice", 2, "c", 1, (7, 0)),
    _chunk("twice", 0, "a", 1, (3, 3)),
    _chunk("twice", 1, "", 1),
    _chunk("twice", 3, None, 1),
    _chunk("silent", 0, None, 2),
    _chunk("cut off", 0, "only ", 3),
    _chunk("cut off", 1, "this", 3),
    _chunk("ten parts", 10, "k", 4, (1, 1)),
    *(_chunk("ten parts", i, "abcdefghij"[i], 4) for i in range(9, -1, -1)),
]
WANT = {
    ("whole", "Under the bridge.", 61, 17, 78),
    # The last chunk with usage gives both counts, a zero counts as ten.
    ("twice", "ac", 7, 10, 17),
    ("silent", "", 10, 10, 20),
    ("cut off", "only this", 10, 10, 20),
    ("ten parts", "abcdefghijk", 1, 1, 2),
}
FIELDS = ("request_id", "reply", "prompt_tokens", "completion_tokens", "total_tokens")


@pytest.fixture
def chunks(spark):
    return spark.createDataFrame(CHUNKS, replies.chunk_schema())


@pytest.mark.parametrize("piece", [1, 3, 4096])
def test_batch_replies(chunks, piece):
    assert as_set(replies.assemble_batch(chunks.repartition(3), piece), *FIELDS) == WANT
    assert as_set(replies.assemble(chunks.repartition(3)), *FIELDS) == WANT


def test_stream_replies_close_by_time(spark, chunks, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def arrive(df):
        df.coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = replies.read_chunks(spark, source, files_per_trigger=1)
        assembled = replies.assemble(stream, delay="10 minutes")
        replies.write_replies(assembled, out, checkpoint, available_now=True).awaitTermination()
        return as_set(spark.read.schema(assembled.schema).parquet(out), *FIELDS)

    # Chunks of one request arrive in different files.
    arrive(chunks.where("seq > 0"))
    arrive(chunks.where("seq = 0"))
    assert run() == set()
    # A much later request closes all earlier ones, finished or not.
    arrive(spark.createDataFrame([_chunk("late", 0, "x", 60)], replies.chunk_schema()))
    assert run() == WANT
    # Nothing is written twice.
    arrive(spark.createDataFrame([_chunk("later", 0, "y", 120)], replies.chunk_schema()))
    run()
    rows = spark.read.parquet(out)
    assert rows.count() == 6 and "late" in {r.request_id for r in rows.collect()}


def test_runs_are_the_chunks_one_by_one(spark):
    """Some chunks come twice, some without a number or text, some numbers are missing,
    some texts are long, and each lies in any task."""
    rng = random.Random(6)
    rows = [_chunk("empty", n, None, 0) for n in range(3)]
    for n in range(12):
        for seq in range(40 * n):
            if rng.random() < 0.9:
                text = "".join(rng.choice("aé \n€") for _ in range(rng.choice([0, 3, 5, 150])))
                counts = rng.choice([None, None, (seq + 1, n + 1)])
                rows += [_chunk(f"r{n}", seq, text, 0, counts)] * (1 + (n % 3 == 0 and seq % 7 == 0))
        rows += [_chunk(f"r{n}", None, text, 0) for text in ("z", "a", None)]
        rows.append(_chunk(None, n, f"nobody's {n}", 0))
    got = {}
    for order in ("placed", "mixed"):
        if order == "mixed":
            rng.shuffle(rows)
        df = spark.createDataFrame(rows, replies.chunk_schema()).repartitionByRange(4, F.rand(3))
        got[order] = as_set(replies.assemble(df if order == "mixed" else df.coalesce(1)), *FIELDS)
    want = set()
    for request in {r[0] for r in rows}:
        own = sorted(
            ((r[3], r[4] or "", r[5], r[6]) for r in rows if r[0] == request),
            key=lambda c: (c[0] is not None, c[0] or 0, c[1]),
        )
        prompt, completion = ([c[2:] for c in own if c[2] is not None] or [(10, 10)])[-1]
        text = "".join(c[1] for c in own)
        want.add((request, text, prompt, completion, prompt + completion))
    assert got == {"placed": want, "mixed": want}


def test_state_is_the_text_and_shuffles_go(spark, tmp_path):
    rng = random.Random(7)
    rows = [
        _chunk(f"r{n}", seq, "".join(rng.choice("abcdefghijklmnop") for _ in range(4)) + " ", n)
        for n in range(150)
        for seq in range(100)
    ]
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    df = spark.createDataFrame(rows, replies.chunk_schema())
    df.coalesce(1).write.parquet(source)

    def shuffles():
        env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
        names = env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {n for n in names if n.endswith(".data") and "shuffle_" in n}

    before = shuffles()
    replies.write_replies(
        replies.assemble(replies.read_chunks(spark, source), delay="9 hours"),
        out, checkpoint, available_now=True,
    ).awaitTermination()
    state = sum(f.stat().st_size for f in (tmp_path / "checkpoint/state").rglob("*.changelog"))
    assert state < sum(len(r[4]) for r in rows)
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before
    assert spark.conf.get(session.CLEANED[0]) == "false"


def test_split_text_comes_back(spark):
    rng = random.Random(1)
    texts = {f"r{n}": "".join(rng.choice("aé \n,\"") for _ in range(n * 40)) for n in range(1, 9)}
    rows = []
    for request, text in texts.items():
        start = seq = 0
        while start < len(text):
            step = rng.randrange(1, 9)
            rows.append(_chunk(request, seq, text[start : start + step], 0))
            start, seq = start + step, seq + 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, replies.chunk_schema())
    assert as_dict(replies.assemble_batch(df, 5), "request_id", "reply") == texts


def test_more_files_are_no_more_triggers(spark, tmp_path):
    parts = [spark.range(20 * i, 20 * i + 20, numPartitions=1 + 6 * i) for i in range(3)]
    stream = __spark_entry__._arriving(spark, parts, "many")
    query = replies.write_replies(stream, f"{tmp_path}/out", f"{tmp_path}/check", available_now=True)
    query.awaitTermination()
    assert sum(p.numInputRows > 0 for p in query.recentProgress) <= 3
    assert as_set(spark.read.parquet(f"{tmp_path}/out"), "id") == {(i,) for i in range(60)}


REQUEST_SCHEMA = (
    "request_id long, user_id string, session_id string, created_at timestamp, total_tokens long"
)


def test_ledger_and_closed_days(spark, tmp_path):
    """Over months, in any order, some files a trigger: nothing is lost."""
    rng = random.Random(2)
    start = dt.datetime(2023, 9, 1)
    rows = [
        (i, f"u{rng.randrange(3)}", "s", start + dt.timedelta(hours=rng.randrange(6000)), rng.randrange(1, 9))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, REQUEST_SCHEMA)
    source = str(tmp_path / "in")
    stream = spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", 1).parquet
    ledger, check, days, closed = (str(tmp_path / n) for n in ("ledger", "check", "days", "closed"))
    columns = ("user_id", "date", "tokens_used", "request_count")
    for part in (df.where("request_id < 170"), df.where("request_id >= 170")):
        part.repartition(3).write.mode("append").parquet(source)
        usage_stream.write_ledger(
            stream(source), ledger, check, available_now=True
        ).awaitTermination()
    want = as_set(usage.daily(df), *columns)
    assert as_set(usage_stream.current(spark, ledger), *columns) == want
    since = dt.date(2024, 2, 1)
    late = as_set(usage_stream.current(spark, ledger, since), *columns)
    assert late == {r for r in want if r[1] >= since}
    # In order of time, a day is written when the next has begun.
    ordered = str(tmp_path / "ordered")
    for month in (9, 10, 11, 12, 1, 2, 3, 4, 5):
        df.where(F.month("created_at") == month).coalesce(1).write.mode("append").parquet(ordered)
    usage_stream.write_closed_days(
        usage_stream.daily_usage(stream(ordered)), days, closed, available_now=True
    ).awaitTermination()
    last = max(r[1] for r in want)
    assert as_set(spark.read.parquet(days), *columns) == {r for r in want if r[1] < last}


def test_folds_write_touched_days_only(spark, tmp_path):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [
        (i, f"u{rng.randrange(4)}", "s", start + dt.timedelta(hours=rng.randrange(480)), rng.randrange(1, 9))
        for i in range(400)
    ] + [(400, "u1", "s", None, 5)]
    df = spark.createDataFrame(rows, REQUEST_SCHEMA)
    source, ledger, check, snapshot = (str(tmp_path / n) for n in ("in", "ledger", "check", "snap"))
    df.repartition(2).write.parquet(source)
    late = F.date_add(F.to_date("created_at"), (F.col("request_id") % 3).cast("int"))
    usage_stream.write_ledger(
        spark.readStream.schema(REQUEST_SCHEMA).parquet(source), ledger, check, True, late
    ).awaitTermination()
    columns = ("user_id", "date", "tokens_used", "request_count")
    want = as_set(usage.daily(df), *columns)

    def files():
        return {
            day.name: {f.name for f in day.glob("*.parquet")}
            for day in (tmp_path / "snap").glob("date=*")
        }

    def now():
        return usage_stream.current(spark, ledger, snapshot=snapshot)

    assert as_set(now(), *columns) == want and files() == {}
    usage_stream.fold(spark, ledger, snapshot, dt.date(2024, 1, 8))
    first = files()
    assert set(first) == {f"date=2024-01-{d:02d}" for d in range(1, 9)}
    assert as_set(now(), *columns) == want
    usage_stream.fold(spark, ledger, snapshot, dt.date(2024, 1, 9))
    second = files()
    # Of the days before, those of the last two take rows on the ninth.
    changed = {day for day in first if first[day] != second[day]}
    assert changed == {"date=2024-01-07", "date=2024-01-08"}
    assert set(second) == set(first) | {"date=2024-01-09"}
    assert as_set(now(), *columns) == want
    since = dt.date(2024, 1, 8)
    some = usage_stream.current(spark, ledger, since, snapshot)
    assert as_set(some, *columns) == {r for r in want if r[1] and r[1] >= since}
    usage_stream.fold(spark, ledger, snapshot, dt.date(2024, 1, 9))
    assert files() == second
    tail = usage_stream._tail(spark.read.parquet(ledger), spark.read.parquet(snapshot))
    left = [r for i, r in enumerate(rows) if not r[3] or (r[3] + dt.timedelta(i % 3)).date() > dt.date(2024, 1, 9)]
    assert tail.count() == len(left)
    # By folders alone, before a row is read.
    plan = tail._jdf.queryExecution().executedPlan().toString()
    assert "map(keys" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]


@pytest.mark.parametrize("compact", [1, 2, 64])
def test_gate_batches_and_repeats(spark, tmp_path, monkeypatch, compact):
    monkeypatch.setattr(gate_stream, "COMPACT", compact)
    rng = random.Random(4)
    rows = sorted(
        ((i, f"u{i % 4}", f"s{i % 4}", at(rng.randrange(2000), 2), rng.randrange(1, 30))
         for i in range(300)),
        key=lambda r: r[3],
    )
    df = spark.createDataFrame(rows, REQUEST_SCHEMA)
    people = table(spark, "users", [user(f"u{i}", quota=150 * i) for i in range(4)])
    owned = table(spark, "sessions", [(f"s{i}", f"u{i}", None, None, False, at(0)) for i in range(4)])
    store = str(tmp_path / "gate")
    cuts = [at(0, 2), at(310, 2), at(1000, 2), at(3000, 2)]
    for number in range(3):
        batch = df.where(
            (F.col("created_at") >= cuts[number]) & (F.col("created_at") < cuts[number + 1])
        )
        gate_stream.process_batch(batch, number, people, owned, store)
        if number == 1:  # runs again after a failure
            gate_stream.process_batch(batch, number, people, owned, store)
    got = gate_stream.decisions(spark, store)
    want = gate.replay_decisions(df, people, owned)
    columns = ("request_id", "status")
    assert got.count() == 300
    assert as_set(got, *columns) == as_set(want, *columns)
    assert {r.status for r in want.collect()} == {200, 429}


def test_only_a_missing_store_is_an_empty_one(spark, tmp_path):
    kind = T.StringType()
    assert gate_stream.usage_before(spark, kind, 3, str(tmp_path / "none")).isEmpty()
    with pytest.raises(Exception, match="nosuchscheme"):
        gate_stream.usage_before(spark, kind, 3, "nosuchscheme://x")


def test_replies_of_admitted_requests_only(spark, chunks):
    wanted = spark.createDataFrame([("whole",), ("cut off",), ("unknown",)], "request_id string")
    got = as_set(replies.assemble_for(wanted, chunks), *FIELDS)
    assert got == {r for r in WANT if r[0] in ("whole", "cut off")}
