import pytest

import brute
from chalktally.llm import near_text, queries

SF = "/root/testdata/sf0.01"


def rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = rows(queries.op3_minhash_near_dedup(spark, SF))
    assert got == brute.near_duplicates([tuple(r) for r in docs], 3, 85)
    assert sum(not kept for _, _, kept in got.values()) > 20


@pytest.mark.parametrize(("k", "percent"), [(5, 80), (3, 85), (2, 50)])
def test_chain_of_edits(spark, k, percent):
    """Near copies that are linked only through others, in every group of keys."""
    base = [f"w{i}" for i in range(120)]
    docs = [(0, " ".join(base))]
    for i in range(1, 25):
        base[(7 * i) % 120] = f"x{i}"
        docs.append((i, " ".join(base)))
    docs += [(100 + i, " ".join(base[:60] + [f"y{i}_{j}" for j in range(60)])) for i in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(near_text.near_duplicates(df, k, percent)) == brute.near_duplicates(docs, k, percent)


def test_odd_rows(spark):
    docs = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B "), (6, "a"), (7, "b a"),
        (8, "long " * 50_000), (9, "long " * 40_000),
    ]
    schema = "doc_id long, text string, component_id string, node int"
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], schema)
    got = rows(near_text.near_duplicates(df, 3, 85))
    assert got == brute.near_duplicates(docs, 3, 85)
    assert got[5] == (1, 4, False) and got[9] == (1, 8, False)


def test_repeated_and_missing_ids(spark):
    docs = [(1, "a b c d"), (1, "e f g h"), (2, "a b c d"), (3, "e f g h"), (None, "a b c d")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(near_text.near_duplicates(df, 3, 85).collect(), key=str)
    assert [(r.doc_id, r.component_id, r.kept) for r in got] == [
        (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, None, True)
    ]


def test_empty_table(spark):
    assert near_text.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).isEmpty()
