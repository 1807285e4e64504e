"""Replays and the stream gate against loops over one request at a time."""

from __future__ import annotations

import datetime as dt
import random

from chalktally.operators import gate, replay
from chalktally.streaming import gate as gate_stream
from rows import as_dict, as_set, table, user

START = dt.datetime(2024, 3, 1)
QUOTAS = {"often": 500, "some": 120, "none": 0, "much": 10_000}


def some_time(rng, days=6):
    # Whole minutes, so that instants coincide.
    return START + dt.timedelta(minutes=rng.randrange(days * 1440))


def landing_loop(rows):
    """Events in order; a landing comes before a start of the same instant."""
    events = [(r[2], 1, *r) for r in rows] + [(r[3], 0, *r) for r in rows]
    used, refused = {}, {}
    for at, starts, request, who, _, _, tokens in sorted(events):
        day = (who, at.date())
        if starts:
            refused[request] = day in used and used[day] >= QUOTAS.get(who, float("inf"))
        elif not refused[request]:
            used[day] = used.get(day, 0) + tokens
    return refused


def test_usage_lands_when_replies_end(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        who = "often" if i % 3 else rng.choice(["some", "none", "much", "stranger"])
        at = some_time(rng)
        long = rng.choice([1, 5, 30, 300, 1440, 4000])
        rows.append((i, who, at, at + dt.timedelta(minutes=rng.randint(1, long)), rng.randint(1, 60)))
    # A chain of nights: each outcome hangs on the one before.
    for d in range(8):
        at = dt.datetime(2024, 4, 1 + d, 23, 0)
        rows.append((1000 + d, "some", at, at + dt.timedelta(hours=2), 200))
    df = spark.createDataFrame(
        rows, "request_id long, user_id string, started_at timestamp, ended_at timestamp, total_tokens int"
    )
    accounts = table(spark, "users", [user(u, quota=q) for u, q in QUOTAS.items()])
    want = landing_loop(rows)
    assert [want[1000 + d] for d in range(8)] == [False, True] * 4
    assert as_dict(replay.landing_replay(df, accounts), "request_id", "refused") == want
    assert replay.landing_replay(df.limit(0), accounts).count() == 0


def history_loop(rows, edits):
    used, out = {}, {}
    for request, who, at, tokens in sorted(rows, key=lambda r: (r[2], r[0])):
        quota = QUOTAS.get(who)
        for _, _, _, value in sorted((e for e in edits if e[1] == who and e[2] <= at), key=lambda e: (e[2], e[0])):
            quota = value
        day = (who, at.date())
        out[request] = day in used and quota is not None and used[day] >= quota
        if not out[request]:
            used[day] = used.get(day, 0) + tokens
    return out


def test_quota_edited_within_the_day(spark):
    rng = random.Random(3)
    rows = [
        (i, "often" if i % 3 else rng.choice(["some", "none", "much", "stranger"]), some_time(rng, 3), rng.randint(1, 40))
        for i in range(900)
    ]
    edits = [
        (i, rng.choice(["often", "often", "some", "none", "stranger"]), some_time(rng, 3), rng.choice([0, 50, 300, 900, 3000]))
        for i in range(40)
    ]
    df = spark.createDataFrame(
        rows, "request_id long, user_id string, created_at timestamp, total_tokens int"
    )
    history = spark.createDataFrame(
        edits, "change_id long, user_id string, changed_at timestamp, daily_token_quota int"
    )
    accounts = table(spark, "users", [user(u, quota=q) for u, q in QUOTAS.items()])
    want = history_loop(rows, edits)
    got = as_dict(replay.history_replay(df, accounts, history), "request_id", "refused")
    assert got == want and 100 < sum(want.values()) < 800
    assert replay.history_replay(df.limit(0), accounts, history).count() == 0
    plain = as_dict(replay.history_replay(df, accounts, history.limit(0)), "request_id", "refused")
    assert plain == as_dict(gate.quota_replay(df, accounts), "request_id", "refused")


def test_many_edits_of_a_day_are_one_pass(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, rng.choice(["often", "some"]), some_time(rng, 1), rng.randint(1, 40)) for i in range(300)]
    edits = [
        (i, rng.choice(["often", "some"]), some_time(rng, 1), 10 * i + rng.choice([0, 300])) for i in range(60)
    ]
    df = spark.createDataFrame(
        rows, "request_id long, user_id string, created_at timestamp, total_tokens int"
    )
    history = spark.createDataFrame(
        edits, "change_id long, user_id string, changed_at timestamp, daily_token_quota int"
    )
    accounts = table(spark, "users", [user(u, quota=q) for u, q in QUOTAS.items()])
    stored, times = replay.session.stored, []

    def counted(*args):
        times.append(args[1])
        return stored(*args)

    monkeypatch.setattr(replay.session, "stored", counted)
    got = as_dict(replay.history_replay(df, accounts, history), "request_id", "refused")
    want = history_loop(rows, edits)
    assert got == want and 20 < sum(want.values()) < 280
    assert len(times) == 1


def test_state_of_the_gate_is_by_bucket(spark, tmp_path):
    n = 3 * gate_stream.BUCKETS
    large = 1 << 60
    accounts = table(spark, "users", [user(f"u{i}", quota=i % 3 * 40) for i in range(n)])
    owned = table(spark, "sessions", [(f"s{i}", f"u{i}", None, None, False, START) for i in range(n)])
    rows = [
        (large + i, f"u{i % n}" if i % 11 else None, f"s{i % n}" if i % 7 else None, START + dt.timedelta(minutes=i % 600), 30)
        for i in range(3 * n)
    ] + [(None, "u1", "s1", START, 1)]
    df = spark.createDataFrame(
        rows, "request_id long, user_id string, session_id string, created_at timestamp, total_tokens int"
    )
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    decided = gate_stream.decide(stream, accounts, owned)
    query = gate_stream.write_decisions(
        decided, f"{tmp_path}/out", f"{tmp_path}/checkpoint", available_now=True
    )
    query.awaitTermination()
    entries = [o.numRowsTotal for p in query.recentProgress for o in p.stateOperators]
    assert 0 < max(entries) <= gate_stream.BUCKETS
    columns = ("request_id", "user_id", "session_id", "status")
    got = spark.read.parquet(f"{tmp_path}/out")
    want = gate.replay_decisions(df, accounts, owned)
    assert got.count() == len(rows) and as_set(got, *columns) == as_set(want, *columns)
    assert {r.status for r in want.collect()} == {200, 401, 404, 429}


def test_stream_keeps_usage_over_restarts(spark, tmp_path):
    accounts = table(spark, "users", [user("often", quota=100), user("gone", deleted=True)])
    owned = table(spark, "sessions", [("s", "often", None, None, False, START)])
    shape = "request_id long, user_id string, session_id string, created_at timestamp, total_tokens int"

    def arrive(*rows):
        df = spark.createDataFrame(
            [(i, u, s, START + dt.timedelta(hours=h), t) for i, u, s, h, t in rows], shape
        )
        df.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        decided = gate_stream.decide(stream, accounts, owned, delay="1 hour")
        gate_stream.write_decisions(
            decided, f"{tmp_path}/out", f"{tmp_path}/checkpoint", available_now=True
        ).awaitTermination()
        return as_dict(spark.read.parquet(f"{tmp_path}/out"), "request_id", "status")

    first = arrive((1, "often", "s", 1, 60), (2, "gone", "s", 1, 5), (3, "often", "x", 1, 500))
    assert first == {1: 200, 2: 401, 3: 404}
    # Later in the same day: what was used before the stop still counts.
    second = arrive((5, "often", "s", 3, 60), (4, "often", "s", 2, 40), (6, "often", "s", 4, 1))
    assert {i: second[i] for i in (4, 5, 6)} == {4: 200, 5: 429, 6: 429}
    third = arrive((7, "often", "s", 30, 100), (8, "often", "s", 31, 1))
    assert {i: third[i] for i in (7, 8)} == {7: 200, 8: 429}
    # The first day is over by more than the delay: its rows come too late.
    last = arrive((9, "often", "s", 5, 1), (10, "often", "s", 32, 1))
    assert 9 not in last and last[10] == 429
