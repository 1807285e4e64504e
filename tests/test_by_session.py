"""Tables in buckets by session: the same results, and no messages moved to read them."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from chalktally.operators import prompts, sessions
from chalktally.sources import by_session, volume

SF = "/root/testdata/sf0.01"
LONG = 6


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    name = f"class_{uuid.uuid4().hex}"
    folder = str(tmp_path_factory.mktemp("by_session"))
    by_session.save(volume.sessions(spark, SF), volume.messages(spark, SF), name, folder, long=LONG)
    yield by_session.load(spark, name)
    for part in by_session._PARTS:
        spark.sql(f"DROP TABLE {name}_{part}")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_every_row_is_in_one_part(spark, stored):
    for both, part, name in (
        (stored.messages.union(stored.long_messages), stored.long_messages, "messages"),
        (stored.sessions.union(stored.long_sessions), stored.long_sessions, "sessions"),
    ):
        assert rows(both) == rows(getattr(volume, name)(spark, SF))
        assert not part.isEmpty()
    sizes = stored.messages.groupBy("session_id").count()
    assert sizes.agg(F.max("count")).first()[0] <= LONG
    longs = stored.long_messages.groupBy("session_id").count()
    assert longs.agg(F.min("count")).first()[0] > LONG


def test_same_results(spark, stored):
    s, m = volume.sessions(spark, SF), volume.messages(spark, SF)
    assert rows(by_session.summary(stored)) == rows(sessions.summary(s, m))
    assert rows(by_session.history(stored, 3)) == rows(prompts.history(m, 3))
    for size in (1, 3, 1000):
        assert rows(by_session.with_messages(stored, size)) == rows(sessions.with_messages(s, m, size))


@pytest.mark.usefixtures("no_broadcast")
@pytest.mark.parametrize(
    ("read", "apart"),
    [
        (by_session.summary, lambda t: sessions.summary(t.long_sessions, t.long_messages)),
        (by_session.with_messages, lambda t: sessions.with_messages(t.long_sessions, t.long_messages)),
        (by_session.history, lambda t: prompts.history(t.long_messages)),
    ],
)
def test_what_lies_in_buckets_does_not_move(stored, read, apart):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert plan(read(stored)).count("Exchange ") == plan(apart(stored)).count("Exchange ")
    assert plan(apart(stored)).count("Exchange ") > 0
    assert "Bucketed: true" in plan(read(stored))


def test_existing_tables_are_not_replaced(spark, tmp_path):
    s, m = volume.sessions(spark, SF).limit(0), volume.messages(spark, SF).limit(0)
    name = f"class_{uuid.uuid4().hex}"
    by_session.save(s, m, name, str(tmp_path / "a"), buckets=3)
    with pytest.raises(Exception, match="already exists"):
        by_session.save(s, m, name, str(tmp_path / "b"), buckets=3)
    empty = by_session.load(spark, name)
    assert by_session.summary(empty).isEmpty() and by_session.with_messages(empty).isEmpty()
    for part in by_session._PARTS:
        spark.sql(f"DROP TABLE {name}_{part}")
