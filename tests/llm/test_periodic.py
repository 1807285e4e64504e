import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from chalktally.llm import periodic, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_runs(w):
    """(start, length, period) by comparing all words for every period."""
    out, n = {}, len(w)
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(24, 3 * p):
                out.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((a, n, p) for (a, n), p in out.items())


def solved(w):
    """The same by tiles, put together here."""
    codes = np.array([hash(x) % 2**31 for x in w], np.int64)
    _, codes = np.unique(codes, return_inverse=True)
    parts = {}
    for _, number, left, first, tile in periodic.tiles(codes, np.array([0, len(w)])):
        for p, a, b in periodic.fragments(tile.tolist(), number, left, first):
            parts.setdefault(p, []).append((a, b))
    out = []
    for p, found in parts.items():
        whole = []
        for a, b in sorted(found):
            if whole and a <= whole[-1][1]:
                whole[-1][1] = max(b, whole[-1][1])
            else:
                whole.append([a, b])
        out += [(a, b - a + p, p) for a, b in whole if b - a >= periodic.places(p)]
    return sorted(out)


def some_text(rng, n):
    """Words with repetitions in repetitions."""
    w = []
    while len(w) < n:
        kind = rng.random()
        letters = rng.choice(["ab", "abc", "abcdefgh", "abcdefghijklmnopqrstuvwxyz"])
        block = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 7, 15, 16, 17, 33, 64, 150]))]
        if kind < 0.3:
            block = (block[: len(block) // 2 + 1] * 3 + block) if kind < 0.1 else block
            w += block * rng.randint(2, 40) + block[: rng.randint(0, len(block))]
        else:
            w += block
    return w[:n]


@pytest.mark.parametrize("tile", [64, 8192])
def test_tiles_against_brute_force(monkeypatch, tile):
    monkeypatch.setattr(periodic, "TILE_WORDS", tile)
    rng = random.Random(7)
    texts = [some_text(rng, rng.choice([0, 5, 23, 24, 25, 80, 300, 1200])) for _ in range(120)]
    texts += [["a"] * n for n in (7, 23, 24, 25, 500)]
    texts += [["a"] * 40 + ["b"] + ["a"] * 40 + ["b"] + ["a"] * 40 + ["b"]]
    texts += [([str(i) for i in range(700)] * 4)[:-3], ([str(i) for i in range(400)] * 3)[:-1]]
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 2000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    texts += [list(fibonacci[-1]), [str(bin(i).count("1") % 2) for i in range(2000)]]
    found = 0
    for w in texts:
        want = brute_runs(w)
        found += len(want)
        assert solved(w) == want
    assert found > 200


def collapsed(w, runs):
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_operator(spark, monkeypatch):
    monkeypatch.setattr(periodic, "TILE_WORDS", 64)
    rng = random.Random(3)
    texts = [None, "", " \n\t", "one two", "a " * 30, "é b\t" * 90]
    texts += [" \x0b".join(some_text(rng, 400)) for _ in range(20)] + ["x y z " * 20_000]
    rows = [(i, t, "t", 0) for i, t in enumerate(texts)] + [(4, "other " * 50, "t", 0), (4, texts[4], "t", 0), (None, texts[4], "t", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, words int").repartition(5)
    for digest in (False, True):
        got = periodic.periodic(df, digest).collect()
        assert len(got) == len(rows)
        want = []
        for doc_id, text, *_ in rows:
            w = WORD.findall(text or "")
            runs = brute_runs(w) if len(w) < 10_000 else [(0, 60_000, 3)]
            kept = collapsed(w, runs)
            want.append((doc_id, runs, hashlib.sha256(kept.encode()).hexdigest() if digest else kept))
        have = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got]
        assert sorted(map(str, have)) == sorted(map(str, want))
    assert periodic.periodic(df.limit(0)).collect() == []


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        w = WORD.findall(text or "")
        h = zlib.crc32(str(doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = brute_runs(w)
        r = got[doc_id]
        assert r.n_runs == len(runs)
        best = (None,) * 4
        for s, length, q in runs:
            if best[0] is None or length * best[2] > best[1] * q:
                best = (s, length, q, 1000 * length // q)
        assert (r.start, r.length, r.period, r.exponent_milli) == best
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
