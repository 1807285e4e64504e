import brute
from compare import connect, duck_rows, spark_rows
from chalktally.llm import contamination, queries

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_sql(spark):
    name = "op6_benchmark_decontamination"
    got = spark_rows(queries.QUERIES[name](spark, SF))
    with connect(SF) as con:
        assert got == duck_rows(con, queries.ORACLE_SQL[name])


def test_odd_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = [
        (1, None), (2, ""), (3, "!!! "), (4, passage), (5, f"x {passage.upper()}, y"),
        (6, "one two three four five six seven eight nine"), (7, "the the the the short one the"),
        (8, "é à ü ß"), (9, "word " * 30_000 + passage), (9, "same id"), (None, passage),
        (10, "the " * 50), (11, passage + " " + passage),
    ]
    items = [
        (1, passage), (2, "short one"), (3, None), (4, "?"), (5, "É à Ü"), (6, "à ü"),
        (7, "the the"), (7, "absent words only"), (12, passage),
    ]
    clash = "doc_id long, text string, term string, row int, hits int"
    df = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], clash)
    bench = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, doc_id int")
    got = rows(contamination.contamination(df, bench, 10))
    assert got == sorted(brute.contamination(docs, items, 10), key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert not contamination.contamination(docs, none).first().contaminated
    assert contamination.contamination(docs.limit(0), none).isEmpty()


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    mixed = "kappa alpha x beta gamma y delta epsilon zeta eta theta iota"
    docs = spark.createDataFrame(
        [(1, item), (2, mixed), (3, "alpha " + "x " * 30 + mixed[6:]), (4, None)],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert rows(contamination.proximity(docs, bench, 10, 5)) == [(1, 7), (2, 7)]
