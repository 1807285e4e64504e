import sys
from pathlib import Path

import pytest

import brute

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from test_records import expected  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows after each stage, the first entry being the input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name.replace(" ", "-"))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_columns_stay(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def test_toxic_documents_go(spark, stages):
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {i for i, _ in texts(stages[1])}
    wrong = [i for i, m in marks.items() if (i in kept) == bool(m)]
    assert len(wrong) <= 4 and len(kept) < stages[0].count()


def test_one_of_each_group_stays(stages):
    before = texts(stages[1])
    found = brute.near_duplicates(before, 5, 80)
    assert texts(stages[2]) == [d for d in before if found[d[0]][2]]


def test_benchmark_goes(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    before = texts(stages[2])
    bad = {r[0] for r in brute.contamination(before, items, 10) if r[5]}
    assert bad and texts(stages[3]) == [d for d in before if d[0] not in bad]


def test_mixing_keeps_all(stages):
    assert set(texts(stages[4])) == set(texts(stages[3]))


def test_records(stages):
    got = stages[5].orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert [tuple(r) for r in got] == expected(texts(stages[4]))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "a b c"), (4, "d e"), (None, "x"), (5, "y " * 30_000)]
    docs = spark.createDataFrame(
        [(*r, "en", "s", 1, "z") for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long, row string",
    )
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, table, SF)
            assert got.columns == table.columns
            assert set(texts(got.na.fill({"doc_id": -1, "text": "null"}))) == set(
                texts(table.na.fill({"doc_id": -1, "text": "null"}))
            )
        assert corpus_pipeline.as_records(spark, table, SF).count() == table.count()
