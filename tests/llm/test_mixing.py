import numpy as np
import pytest
from pyspark.sql import functions as F

from chalktally.llm import mixing, queries

SF = "/root/testdata/sf0.01"
GOOD = "plain words of a calm text that goes on and on about many other things "
POOR = "spam!!! $$$ spam!!! $$$ &&& "


def solved(n, p, aim, least):
    """The same problem by many plain steps in memory."""
    now, rate = n @ p, np.ones(len(n))
    for _ in range(20_000):
        error = ((n * rate) @ p - aim) / now
        rate = np.maximum(least, rate - 0.3 * (p @ error + mixing.REG * (rate - 1)))
    return rate


@pytest.mark.parametrize(("least", "grow"), [(0.0, False), (1.0, True)])
def test_rates_solve_least_squares(spark, least, grow):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", mixing.quality_domain())
    weights = {"high": 0.8, "low": 0.2}
    got = mixing.rates(docs, labels, weights, least=least, grow=grow).toPandas()
    n, p = got.n_tokens.to_numpy(float), got[["p_high", "p_low"]].to_numpy()
    assert p.sum(1) == pytest.approx(1) and p.min() >= 0
    share = np.array([0.8, 0.2])
    total = max(n.sum(), *(n @ p / share)) if grow else n.sum()
    want = solved(n, p, share * total, least)
    some = n > 0
    assert got.rate.to_numpy()[some] == pytest.approx(want[some], abs=0.02)
    assert got.rate.min() >= least and (got.rate[~some] == 1).all()
    reached = (n * got.rate) @ p
    assert reached / reached.sum() == pytest.approx(share, abs=0.02)
    assert ((got.copies - got.rate).abs() < 1).all()


def test_query(spark):
    got = queries.op1_mixing(spark, SF).toPandas()
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    pairs = [(known[i], p > 0.5) for i, p in zip(got.doc_id, got.p_high, strict=True) if i in known]
    assert np.mean([q == r for q, r in pairs]) > 0.9
    reached = (got.n_tokens * got.rate * got.p_high).sum() / (got.n_tokens * got.rate).sum()
    assert reached == pytest.approx(0.9, abs=0.02)


def test_copies_and_odd_rows(spark):
    rows = [(i, (GOOD if i % 5 else POOR) * (1 + i % 3)) for i in range(400)]
    rows += [(900, None), (901, ""), (902, " \t"), (903, GOOD * 5000), (5, "same id"), (5, "same id"), (None, POOR)]
    df = spark.createDataFrame([(*r, 2, "x") for r in rows], "doc_id long, text string, copies int, rate string")
    labels = spark.createDataFrame(
        [(i, "good" if i % 5 else "poor") for i in range(200)] + [(None, "good"), (7, None), (8, "other")],
        "doc_id long, domain string",
    )
    got = mixing.rates(df, labels, {"good": 0.5, "poor": 0.5}).collect()
    assert len(got) == len(rows)
    assert all(r.rate == 1 for r in got if r.n_tokens == 0)
    mixed = mixing.mixed(df, labels, {"good": 0.5, "poor": 0.5}, least=1.0, grow=True)
    assert mixed.columns == df.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(counts) == {r[0] for r in rows}
    poor = sum(n for i, n in counts.items() if i is not None and i < 400 and i % 5 == 0)
    good = [counts[i] for i in range(400) if i % 5]
    assert poor > 20 * 80 and sum(good) < 1.1 * len(good)


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, domain string")
    got = mixing.rates(df, none, {"a": 1.0, "b": 1.0}).first()
    assert (got.p_a, got.p_b, got.copies) == (0.5, 0.5, 1)
    assert mixing.rates(df.limit(0), none, {"a": 1.0}).isEmpty()
    one = none.union(spark.createDataFrame([(1, "a")], none.schema))
    assert mixing.rates(df, one, {"a": 1.0, "b": 0.0}).select(F.col("p_a")).first()[0] == 1.0
