"""Hot keys: cut into grains, same rows as a loop over everything."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chalktally.operators import changes, gate, sessions, skew, usage
from rows import as_dict, at, message, table, user


@pytest.fixture(params=["second", "hour", "month"])
def grains(request, monkeypatch):
    """Grains of several sizes, of which the largest holds all rows of a key."""
    size = {"second": (4, 1), "hour": (64, 2), "month": (10**6, 9)}[request.param]
    monkeypatch.setattr(skew, "IDS", size[0])
    monkeypatch.setattr(skew, "LETTERS", size[1])
    whole = F.date_trunc
    monkeypatch.setattr(skew.F, "date_trunc", lambda _, c: whole(request.param, c))


@pytest.fixture(scope="module")
def asked():
    """Requests where one user on one day has a third of the rows, many of them
    at the same instant, plus a few ordinary users over several days."""
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        hot = i % 3 == 0
        owner = "hot" if hot else f"u{rng.randrange(12)}"
        minute = rng.choice([5, 5, 5, rng.randrange(600)]) if hot else rng.randrange(600)
        day = 4 if hot else rng.randrange(1, 8)
        session = f"s-{owner}" if rng.random() < 0.9 else "s-other"
        rows.append((i, owner, session, at(minute, day), rng.randrange(1, 30)))
    return rows


@pytest.fixture(scope="module")
def requests(spark, asked):
    return spark.createDataFrame(
        asked,
        "request_id long, user_id string, session_id string, created_at timestamp, total_tokens long",
    ).repartition(5)


@pytest.fixture(scope="module")
def people(spark):
    return table(
        spark,
        "users",
        [user("hot", quota=3000), user("u0", quota=0), user("u1", deleted=True)]
        + [user(f"u{i}", quota=40 * i) for i in range(2, 11)],
    )


QUOTA = {"hot": 3000, "u0": 0, **{f"u{i}": 40 * i for i in range(1, 11)}}
QUOTA["u1"] = 50_000


def loop(asked, admits):
    """One request after the other; ``admits`` judges everything but quota."""
    used: dict = {}
    out = {}
    for i, owner, session, when, tokens in sorted(asked, key=lambda r: (r[3], r[0])):
        status = admits(owner, session)
        key = (owner, when.date())
        if status == 200 and owner in QUOTA and key in used and used[key] >= QUOTA[owner]:
            status = 429
        if status == 200:
            used[key] = used.get(key, 0) + tokens
        out[i] = status
    return out


def test_a_hot_key_is_many_tasks(requests):
    rows = requests.withColumn("date", F.to_date("created_at"))
    cut = rows.withColumn("g", skew.grain(rows, "created_at")).groupBy("user_id", "date", "g").count()
    assert cut.where("user_id = 'hot'").count() > 100


@pytest.mark.usefixtures("grains")
def test_quota_replay_is_the_loop(requests, people, asked):
    got = as_dict(gate.quota_replay(requests, people), "request_id", "refused")
    want = loop(asked, lambda owner, session: 200)
    assert got == {i: status == 429 for i, status in want.items()}
    assert 100 < sum(got.values()) < len(got)


def _sessions(spark):
    owners = ["hot", *(f"u{i}" for i in range(12))]
    rows = [(f"s-{o}", o, None, None, o == "u5", at(0)) for o in owners]
    return table(spark, "sessions", rows)


def _admits(owner, session):
    if owner in ("u1", "u11"):
        return 401
    return 404 if session == "s-other" or owner == "u5" else 200


@pytest.mark.usefixtures("grains")
def test_replay_decisions_are_the_loop(spark, requests, people, asked):
    got = gate.replay_decisions(requests, people, _sessions(spark))
    assert as_dict(got, "request_id", "status") == loop(asked, _admits)


def test_replay_with_earlier_usage(spark, requests, people, asked):
    """Cut anywhere in time, the second part continues where the first stopped."""
    for cut in (at(5), at(300), at(0, 6)):
        first, rest = requests.where(F.col("created_at") <= cut), requests.where(
            F.col("created_at") > cut
        )
        owned = _sessions(spark)
        one = gate.replay_decisions(first, people, owned)
        before = usage.daily(one.where("status = 200"))
        two = gate.replay_decisions(rest, people, owned, before)
        assert as_dict(one.unionByName(two), "request_id", "status") == loop(asked, _admits)


def test_admitted_usage_overshoots_by_one_request_at_most(requests, people):
    judged = gate.quota_replay(requests, people).where(~F.col("refused"))
    daily = usage.daily(judged).join(people, F.col("id") == F.col("user_id"))
    for row in daily.collect():
        assert row.tokens_used < row.daily_token_quota + 30


@pytest.mark.usefixtures("grains")
@pytest.mark.parametrize("subset", [False, True])
def test_pages_hold_every_message_once_in_order(spark, subset):
    rng = random.Random(3)
    rows = [
        message(f"{i:04}", "hot" if i % 2 else f"c{i % 7}", rng.choice(["user", "llm"]), f"t{i}",
                rng.choice([3, rng.randrange(900)]))
        for i in range(600)
    ]
    own = [("hot", "u", None, None, False, at(0)), ("empty", "u", None, "", False, at(0))]
    own += [(f"c{i}", "u", None, None, False, at(0)) for i in range(5)]
    nested = sessions.with_messages(
        table(spark, "sessions", own),
        table(spark, "messages", rows).repartition(4),
        page_size=7,
        subset=subset,
    ).collect()
    for session in ("hot", "empty", *(f"c{i}" for i in range(5))):
        pages = sorted((r.page, r.messages) for r in nested if r.id == session)
        assert [n for n, _ in pages] == list(range(len(pages)))
        assert all(len(m) == 7 for _, m in pages[:-1])
        assert len({n for n, _ in pages}) == len(pages)
        want = sorted(
            (r for r in rows if r[1] == session), key=lambda r: (r[7], r[2] != "user", r[0])
        )
        assert [m.id for _, page in pages for m in page] == [r[0] for r in want]
    assert {r.id for r in nested} == {"hot", "empty", *(f"c{i}" for i in range(5))}


@pytest.mark.usefixtures("grains")
def test_toggles_of_a_hot_rule(spark):
    rules = table(spark, "teacher_rules", [("hot", "t", None, "x", True), ("b", "t", None, "x", False)])
    rows = [(i, "hot" if i % 3 else ("b" if i % 2 else "none")) for i in range(400)]
    df = spark.createDataFrame(rows, "change_id long, rule_id string").repartition(4)
    state = {"hot": True, "b": False}
    want = {}
    for i, rule in rows:
        if rule in state:
            state[rule] = not state[rule]
        want[i] = state.get(rule)
    got = changes.toggle_rules(rules, df)
    assert as_dict(got.statuses, "change_id", "is_active") == want
    assert as_dict(got.snapshot, "id", "is_active") == state


@pytest.mark.usefixtures("grains")
def test_rows_without_key_or_time(spark):
    rows = [(i, None if i % 2 else "u", None if i % 5 == 0 else at(i % 7), 1) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k string, t timestamp, n long")
    got = skew.earlier(df, ["k"], ["t", "id"], F.col("n"), "before").collect()
    assert len(got) == 200
    for key in (None, "u"):
        own = sorted((r for r in got if r.k == key), key=lambda r: (r.t is not None, r.t or at(0), r.id))
        assert [r.before for r in own] == [None, *range(1, 100)]


def test_one_join_row_for_each_request(spark, requests, people):
    judged = gate.quota_replay(requests, people)
    assert judged.count() == requests.count()
    assert judged.columns == [*requests.columns, "refused"] or set(judged.columns) == {
        *requests.columns, "refused"
    }


def test_days_are_utc(spark):
    df = spark.createDataFrame(
        [("u", dt.datetime(2024, 3, 4, 23, 59, 59), 1), ("u", dt.datetime(2024, 3, 5), 2)],
        "user_id string, created_at timestamp, total_tokens long",
    )
    assert as_dict(usage.daily(df), "date", "tokens_used") == {
        dt.date(2024, 3, 4): 1, dt.date(2024, 3, 5): 2
    }
