import numpy as np

import brute
from chalktally.llm import near_vectors, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(data, cosine=0.98):
    usable = [
        (i, np.asarray(v, np.float64), label)
        for i, v, label in data
        if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)
    ]
    links = []
    if usable:
        x = np.stack([v / np.linalg.norm(v) for _, v, _ in usable])
        labels = np.array([label for _, _, label in usable])
        near = (x @ x.T >= cosine) & (labels[:, None] == labels)
        links = [(usable[a][0], usable[b][0]) for a, b in zip(*np.nonzero(np.triu(near, 1)))]
    ids = [i for i, _, _ in data]
    found = brute.smallest_reachable(ids, links)
    n = {i: sum(pair.count(i) for pair in links) for i in ids}
    return {i: (n[i], found[i], found[i] == i) for i in ids}


def rows(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_query_equals_brute_force(spark):
    data = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert rows(queries.op8_embedding_near_dedup(spark, SF)) == expected(data)


def test_groups_larger_than_a_block(spark):
    rng = np.random.default_rng(5)
    data, centre = [], rng.standard_normal(64)
    for i in range(400):
        data.append((i, (centre + 0.1 * rng.standard_normal(64)).tolist(), 1))
    for i in range(400, 600):
        base = rng.standard_normal(64)
        data.append((i, base.tolist(), i % 2))
        data.append((i + 1000, (base + rng.uniform(0.1, 0.25) * rng.standard_normal(64)).tolist(), i % 2))
    data += [(5000 + i, data[0][1], 1) for i in range(30)]
    data = [(i, np.float32(v).tolist(), label) for i, v, label in data]
    got = rows(near_vectors.near_vectors(spark.createDataFrame(data, SCHEMA)))
    assert got == expected(data)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, -3.0, 0.5]
    data = [
        (1, v, 1), (2, v, 1), (3, [2 * x for x in v], 1), (4, v, None), (5, v, 2), (6, None, 1),
        (7, [], 1), (8, [0.0] * 4, 1), (9, [1.0, nan, 0.0, 0.0], 1), (10, [inf, 1.0, 0.0, 0.0], 1),
        (11, [1.0, None, 2.0, 3.0], 1), (12, [-x for x in v], 1), (13, [1e-30] * 4, 1),
    ]
    df = spark.createDataFrame(
        [(*d, 9, "x") for d in data], SCHEMA + ", node int, component string"
    )
    got = rows(near_vectors.near_vectors(df))
    assert got == expected(data)
    assert got[3] == (2, 1, False)


def test_missing_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 1), (3, [1.0, 2.0], 1)], SCHEMA)
    got = {r.vec_id: r for r in near_vectors.near_vectors(df).collect()}
    assert got[None].n_links == 0 and got[None].component_id is None and got[None].kept
    assert got[3].n_links == 0
    assert near_vectors.near_vectors(df.limit(0)).isEmpty()


def test_few_dimensions(spark):
    rng = np.random.default_rng(9)
    data, want = [], {}
    for size in (4, 16, 24, 32):
        part = []
        for i in range(size * 10_000, size * 10_000 + 300):
            base = rng.standard_normal(size)
            near = base / np.linalg.norm(base) + rng.uniform(0.15, 0.22) / np.sqrt(size) * rng.standard_normal(size)
            part += [(i, np.float32(base).tolist(), 1), (i + 5000, np.float32(near).tolist(), 1)]
        want |= expected(part)
        data += part
    assert rows(near_vectors.near_vectors(spark.createDataFrame(data, SCHEMA))) == want


def test_one_id_with_several_vectors_and_labels(spark):
    rng = np.random.default_rng(12)
    for size in (8, 64):
        a, b, c = np.float32(rng.standard_normal((3, size)))
        close = np.float32(0.01 * rng.standard_normal(size))
        data = [
            (1, a, 1), (1, b, 1), (1, a, 2), (1, a, 1), (1, a + close, 1),
            (2, a + 2 * close, 1), (3, b + close, 1), (4, b, 1), (5, a - close, 2),
            (6, c, 1), (6, c, 3), (7, c + close, 3), (8, c + close, 1),
        ]
        data = [(i, v.tolist(), label) for i, v, label in data]
        want = expected(data)
        assert want[1][0] > 6
        assert rows(near_vectors.near_vectors(spark.createDataFrame(data, SCHEMA))) == want
