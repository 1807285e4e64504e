import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import brute
from chalktally.llm import language_model as lm
from chalktally.llm import queries

SF = "/root/testdata/sf0.01"


def tokens(text):
    return [*brute.space_words(text), ""]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def expected(docs):
    counts = Counter(t for i, text in docs if not held(i) for t in tokens(text))
    n = sum(counts.values())
    below = n + 0.1 * (len(counts) + 1)
    out = []
    for i, text in docs:
        t = tokens(text)
        base = sum(math.log10((counts[x] + 0.1) / below) for x in t)
        out.append((i, held(i), len(t), sum(counts[x] > 0 for x in t), n, base))
    return sorted(out, key=str)


def check(got, docs):
    want = expected(docs)
    got = sorted((tuple(r) for r in got), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert math.isfinite(g[6]) and g[6] <= 1e-6


@pytest.mark.parametrize("sent", [lm.SENT, 500])
def test_query(spark, monkeypatch, sent):
    """Whichever words are sent, and which are joined; better than counts."""
    monkeypatch.setattr(lm, "SENT", sent)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op2_lm_scoring(spark, SF).collect()
    check(got, docs)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 0.99 * sum(r.base_score for r in out)


def test_probabilities_sum_to_one(spark):
    docs = [(i, t) for i, t in enumerate(["a b c a b", "b c d", None, "the end of the"] * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    _, model = lm.fit(df)
    starts = np.array([0, 3])
    total = 0.0
    for c in range(lm.CLASSES):
        classes = np.array([1, 2, c])
        total += 10 ** model.log10_classes(classes, starts)[2]
    assert total == pytest.approx(1, abs=1e-4)
    # Shares within a class of several words, one unknown included, sum to one.
    words = pa.array(["a", "b", "c", "d", "the", "end", "of"])
    classes, counts = model.known.look_up(words)
    assert (classes < lm.SHORT).all() and (counts > 0).all()


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "Ä ä A a \x0b x\x1fy"), (11, "word " * 40_000), (12, "rare"), (12, "rare"), (None, "no id")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, c int, word string")
    check(lm.language_model(df).collect(), docs)
    assert lm.language_model(df.limit(0)).isEmpty()


def test_nothing_to_learn_from(spark):
    docs = [(i, "a b") for i in range(60) if held(i)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(lm.language_model(df).collect(), docs)
