"""Plans: no pairing of everything, early limits, filters in the scan."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from chalktally.operators import prompts, usage
from chalktally.sources import volume

SF = "/root/testdata/sf0.001"
QUERIES = contract.queries()
# The others run jobs of their own and read what those wrote.
PLANNED = sorted(
    n for n in contract._QUERIES if not n.startswith(("stream", "stored"))
)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_pairs_of_everything(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_history_is_limited_before_the_exchange(spark):
    text = plan(prompts.history(volume.messages(spark, SF)))
    assert text.count("WindowGroupLimit") == 2


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(usage.daily(volume.requests(spark, SF)).select("user_id"))
    assert "PushedFilters: [In(event_type, [click,error,view])]" in text
    assert "value" not in text.split("ReadSchema")[1]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.usefixtures("no_broadcast")
@pytest.mark.parametrize(("name", "scans", "exchanges"), [("quota_replay", 4, 8), ("replay_decisions", 6, 15)])
def test_replays_without_broadcasts(spark, name, scans, exchanges):
    """Rows and per-grain sums each read and join the requests; no job runs
    while the plan is built, and no part of it depends on the size."""
    text = plan(QUERIES[name](spark, SF))
    assert text.count("FileScan") <= scans
    assert text.count("Exchange hashpartitioning") <= exchanges


def test_totals_are_partial(spark):
    totals = plan(usage.rollup(volume.messages(spark, SF), volume.sessions(spark, SF)))
    assert "partial_sum" in totals


def test_no_python_in_any_plan(spark):
    for name in ("system_text", "prompt_payload"):
        text = plan(QUERIES[name](spark, SF))
        assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_text_is_pruned_before_it_moves(spark):
    """Messages and chunks of requests that aren't admitted go before ordering."""
    for name in ("prompt_payload", "settle_messages"):
        text = plan(QUERIES[name](spark, SF))
        top = min(text.index(x) for x in ("WindowGroupLimit", "collect_list") if x in text)
        assert "LeftSemi" in text[top:]
