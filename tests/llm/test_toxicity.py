import zlib

import numpy as np
import pyarrow as pa
import pytest

from chalktally.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def test_query(spark):
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.op10_toxicity(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    out = [(marks[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in marks]
    assert len(out) > 50 and sum(a == b for a, b in out) >= 0.95 * len(out)


def test_recall_of_each_kind_held_out(spark):
    large = "/root/testdata/sf0.1"
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    got = [r for r in queries.op10_toxicity(spark, large).collect() if r.held_out and r.doc_id in marks]
    toxic = [r.predicted == 1 for r in got if marks[r.doc_id]]
    clean = [r.predicted == 0 for r in got if not marks[r.doc_id]]
    assert len(toxic) > 50 and sum(toxic) >= 0.85 * len(toxic)
    assert len(clean) > 500 and sum(clean) >= 0.99 * len(clean)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in toxicity._fresh(rng).items()}
    w["v"] = rng.standard_normal(w["v"].shape)
    inputs = rng.standard_normal((9, 6))
    taken = rng.integers(-1, 8, (3, toxicity.WINDOW))
    label = np.array([1.0, 0.0, 1.0])

    def loss():
        table = np.tanh(inputs @ w["A"] + w["a"]) @ w["W"] + w["b"]
        logit = toxicity._pooled(toxicity._states(taken, table, w), taken, w)[2]
        return np.sum(np.log1p(np.exp(logit)) - label * logit)

    g = toxicity._gradients(taken, inputs, label, 1.0, w)
    for name, x in w.items():
        i = tuple(rng.integers(0, n) for n in x.shape)
        x[i] += 1e-2
        up = loss()
        x[i] -= 2e-2
        down = loss()
        x[i] += 1e-2
        assert g[name][i] == pytest.approx((up - down) / 2e-2, rel=0.1, abs=2e-3), name


def test_windows_cover_all_words():
    starts = np.array([0, 0, 5, 5 + toxicity.WINDOW, 300])
    first, end, text = toxicity.windows(starts)
    words = toxicity.window_words(np.arange(300), first, end)
    for i in range(4):
        seen = set(words[text == i].ravel()) - {-1}
        assert seen == set(range(starts[i], starts[i + 1])) and (text == i).any()


def test_odd_rows(spark):
    bad = "you are a wretched fool today "
    good = "a quiet walk in the green park "
    docs = [
        (i, good * (i % 7) + (bad if i % 3 == 0 else "") + good * (i % 5), i % 3 == 0) for i in range(300)
    ]
    more = [(1000, None), (1001, ""), (1002, good * 4000), (1003, good * 3000 + bad), (1004, " \n"), (5, good), (None, bad)]
    rows = [(i, t, 1, "x") for i, t, _ in docs] + [(*m, 1, "x") for m in more]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")
    labels = spark.createDataFrame(
        [(i, int(b), "t") for i, _, b in docs] + [(7, None, "t"), (None, 1, "t"), (9, 0, "t")],
        "doc_id long, toxic int, text string",
    )
    got = toxicity.toxicity(df, labels).collect()
    assert len(got) == len(rows)
    named = {r.doc_id: r.predicted for r in got if r.doc_id != 5}
    assert [named[i] for i in range(1000, 1005)] == [0, 0, 0, 1, 0]
    assert all(named[i] == b for i, _, b in docs if i != 5)
    kept = toxicity.clean(df, labels)
    assert kept.columns == df.columns and kept.count() == len(rows) - sum(r.predicted for r in got)
    assert toxicity.toxicity(df.limit(0), labels).isEmpty()
    unlabelled = toxicity.toxicity(df, labels.limit(0)).collect()
    assert [r.predicted for r in unlabelled] == [0] * len(rows)


def test_empty_text_is_the_same_alone_or_not(spark):
    docs = spark.createDataFrame([(i, ["bad words", "fine words"][i % 2]) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    alone = toxicity.score_texts(model, pa.array([""]))[0]
    assert toxicity.score_texts(model, pa.array(["x", None, ""]))[1:] == pytest.approx([alone] * 2)


def test_training_reads_some_text_at_a_time(monkeypatch):
    monkeypatch.setattr(toxicity, "PORTION", 100)
    rows = [["a" * (i % 40), "b" * 7] if i % 5 else [] for i in range(50)] + [["c" * 300], ["d"]]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string())), pa.array(range(52))], ["parts", "n"])
    found = list(toxicity.portions(iter([batch.slice(0, 9), batch.slice(9), batch.slice(0, 0)])))
    assert [p for b in found for p in b["parts"].to_pylist()] == rows
    assert [n for b in found for n in b["n"].to_pylist()] == list(range(52))
    sizes = [[sum(map(len, p)) for p in b["parts"].to_pylist()] for b in found]
    assert len(found) > 10 and all(sum(s[:-1]) <= 100 for s in sizes)


def test_no_text_uses_up_the_sample(spark, monkeypatch):
    long = "a quiet walk in the park " * 600_000
    rows = [(i, long if i in (4, 11, 23) else f"text of number {i}") for i in range(40)]
    docs = spark.createDataFrame([*rows, (7, "another text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 3)) for i, _ in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "LEARN_SIZE", (200_000, 100_000))
    drawn = toxicity.sample(docs, labels).collect()
    assert sorted(r.n for r in drawn) == list(range(len(drawn)))
    texts = [part for r in drawn for part in r.parts]
    marks = [r.toxic for r in drawn]
    assert [r.whole for r in drawn if sum(map(len, r.parts)) > 1000] == [False] * sum(
        zlib.crc32(str(i).encode()) % 5 > 0 for i in (4, 11, 23)
    )
    learned = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    whole = {t for t in texts if t.startswith(("text", "another"))}
    assert {t for i, t in rows if i in learned and t != long} <= whole
    assert marks.count(1) == sum(i % 5 == 3 for i in learned) and 0 in marks
    assert sum(map(len, texts)) <= sum(toxicity.LEARN_SIZE)
    spread = toxicity.stretches(" ".join(map(str, range(100_000))), 14_000, 5)
    numbers = [int(w) for part in spread for w in part.split()]
    assert set(numbers) <= set(range(100_000)) and max(numbers) - min(numbers) > 30_000
    assert 10_000 < sum(map(len, spread)) <= 14_000
    assert all(toxicity.stretches("y" * 50_000, 3000, 5)) and toxicity.stretches("x y", 9, 5) == ["x y"]
    assert [toxicity.share(np.array(s), 100) for s in ([10, 20, 900], [50, 50], [])] == [70, 100, 100]
