"""Near-duplicate documents: MinHash signatures and a multi-index Hamming join.

A document is the set of its distinct shingles (runs of ``words`` words). Its
signature has ``chunks`` times five components of 16 bits, each the low bits of
a minimum over the set under its own hash. Two sets of similarity s differ in a
component with probability 1 - s. The signature is split into chunks of five
components. By the pigeonhole principle two signatures that differ in fewer
than ``2 * chunks`` components have a chunk with at most one difference, so both
are filed five times per chunk, each time with another component left out: they
are sure to meet under a key. The number of chunks follows from the threshold
so that a pair just at it is missed with a probability below ``MISS``.

Links are then confirmed on the full sets, in exact integer arithmetic.

Under a key not all pairs are formed. Every member is compared with the
smallest one first. What this joins needs no further comparison; only keys
under which several groups remain are looked at again, and only for pairs from
different groups whose rarest shingles leave room for enough common ones.
Equal sets are one member from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalktally.llm import shared
from chalktally.llm.components import components
from chalktally.llm.words import SMALL_PIECE_BYTES, mixed, pieces, words

WIDTH = 5
MISS = 1e-6
#: Members of one group under one shingle beyond which they don't meet each other.
LIGHT = 64


def chunks_for(percent: int) -> int:
    s = percent / 100
    found = s**WIDTH + WIDTH * s ** (WIDTH - 1) * (1 - s)
    return max(2, math.ceil(math.log(MISS) / math.log(1 - found))) if found < 1 else 2


def _shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingles of all texts in a row, where each text
    starts). A text of fewer than k words is one shingle, of none is empty."""
    lowered = pc.ascii_lower(pc.fill_null(texts, ""))
    codes, starts, dictionary = words(lowered)
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(w) for w in dictionary.to_pylist()), np.uint64, len(dictionary)
    )[codes] if len(codes) else np.zeros(0, np.uint64)
    found = []
    for i in range(len(starts) - 1):
        h = hashes[starts[i] : starts[i + 1]]
        n = min(len(h), k)
        if n == 0:
            found.append(h)
            continue
        x = np.full(len(h) - n + 1, np.uint64(n))
        for j in range(n):
            x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
        found.append(np.unique(x))
    sizes = [len(x) for x in found]
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.concatenate(
        [[0], np.cumsum(sizes, dtype=np.int64)]
    )


def _constants(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _signatures(k: int, chunks: int):
    parts = chunks * WIDTH
    flips, factors = _constants(2 * parts)[:parts], _constants(2 * parts)[parts:] | np.uint64(1)
    seeds = _constants(4 * parts)[3 * parts :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, size=SMALL_PIECE_BYTES):
            shingles, starts = _shingles(batch["text"], k)
            sizes = np.diff(starts)
            some = sizes > 0
            at = starts[:-1][some]
            low = np.zeros((parts, len(at)), np.uint64)
            ids = np.zeros((2, len(sizes)), np.uint64)
            if len(at):
                for i in range(parts):
                    low[i] = np.minimum.reduceat(mixed((shingles ^ flips[i]) * factors[i]), at)
                ids[0, some] = np.add.reduceat(mixed(shingles), at)
                ids[1, some] = np.bitwise_xor.reduceat(mixed(shingles ^ flips[0]), at)
            low &= np.uint64(0xFFFF)
            keys = np.empty((len(at), parts), np.uint64)
            for i in range(parts):
                rest = [j for j in range(i - i % WIDTH, i - i % WIDTH + WIDTH) if j != i]
                key = np.zeros(len(at), np.uint64)
                for j in rest:
                    key = key << np.uint64(16) | low[j]
                keys[:, i] = mixed(key ^ seeds[i])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].cast(pa.int64()),
                    pa.array(sizes),
                    pa.array(ids[0].view(np.int64)),
                    pa.array(ids[1].view(np.int64)),
                    _lists(keys, some),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "keys"],
            )

    return run


def _lists(rows: np.ndarray, some: np.ndarray) -> pa.Array:
    ends = np.cumsum(some) * rows.shape[1]
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1).view(np.int64)))


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, size=SMALL_PIECE_BYTES):
            shingles, starts = _shingles(batch["text"], k)
            lists = pa.ListArray.from_arrays(
                pa.array(starts.astype(np.int32)), pa.array(shingles.view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), lists], ["node", "shingles"]
            )

    return run


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; further columns are not looked at):
    doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its
    own included) and kept (doc_id = component_id).

    Two documents are linked if 100 * (shared shingles) >= percent * (shingles of
    both together). A text that is null or has no words has an empty set and
    links with nothing; one of fewer words than a shingle is one shingle. Rows
    with the same doc_id are the same document: a link of one counts for all. A
    row without doc_id is compared with nothing: component_id is null and kept
    is true. An empty table gives an empty result.
    """
    chunks = chunks_for(percent)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = shared.written(
        rows.mapInArrow(
            _signatures(shingle_words, chunks),
            "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>",
        ),
        "signed",
    )
    same = ["n_shingles", "set_a", "set_b"]
    whole = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    nodes = whole.groupBy(*same).agg(F.min("doc_id").alias("node"))
    members = (
        whole.join(nodes.select(*same, F.col("node").alias("doc_id")), [*same, "doc_id"], "left_semi")
        .select(F.col("doc_id").alias("node"), F.explode("keys").alias("key"))
    )
    leaders = (
        members.groupBy("key")
        .agg(F.min("node").alias("leader"), F.max("node").alias("last"))
        .where("leader <> last")
        .select("key", "leader")
    )
    crowded = shared.written(members.join(leaders, "key"), "crowded")
    stars = crowded.where("node <> leader").select(
        F.col("leader").alias("a"), F.col("node").alias("b")
    )
    meeting = stars.select(F.col("a").alias("doc_id")).union(stars.select("b")).distinct()
    sets = shared.written(
        rows.join(meeting, "doc_id", "left_semi").mapInArrow(
            _sets(shingle_words), "node long, shingles array<long>"
        ),
        "sets",
    )
    links = shared.written(_confirmed(stars.distinct(), sets, percent), "confirmed")
    groups = components(links)
    further = shared.written(
        _confirmed(_across(crowded, groups, sets, percent), sets, percent),
        "confirmed",
    )
    # A set with one smallest row stands for its rows, also when ids repeat.
    copies = whole.join(nodes, same).select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    groups = shared.written(
        components(links.union(further).union(copies)), "groups"
    )
    component = F.coalesce("component", "doc_id")
    return (
        signed.select("doc_id", "n_shingles")
        .join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            component.alias("component_id"),
            F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    sizes = F.size("of_a") + F.size("of_b")
    fits = 100 * F.least(F.size("of_a"), F.size("of_b")) >= percent * F.greatest(
        F.size("of_a"), F.size("of_b")
    )
    # n / (sizes - n) >= percent / 100, with the intersection taken once
    alike = (100 + percent) * F.size(F.array_intersect("of_a", "of_b")) >= percent * sizes
    return pairs.join(one, "a").join(two, "b").where(fits & alike).select("a", "b").distinct()


def _across(crowded: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs from different groups among the members of keys under which more
    than one group remains, so far as their sets can be similar enough.

    With shingles in ascending order of use, the first ones of two similar sets
    must have one in common, and what follows it must be long enough in both. A
    copy with many changes has only shingles of its own there and meets nobody.
    A group with many members under a shingle is heavy there: its members meet
    other groups, not each other.
    """
    grouped = crowded.join(groups, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("g")
    )
    open_keys = (
        grouped.groupBy("key")
        .agg(F.min("g").alias("low"), F.max("g").alias("high"))
        .where("low <> high")
        .select("key")
    )
    members = grouped.join(open_keys, "key", "left_semi").select("node", "g").distinct()
    row = ["node", "g", "n", "s"]
    each = sets.join(members, "node").select(
        "node", "g", F.size("shingles").alias("n"), F.xxhash64("shingles").alias("s"),
        F.explode("shingles").alias("shingle"),
    )
    uses = each.groupBy("shingle").agg(F.count("*").alias("uses")).where("uses > 1")
    common = (
        each.join(uses, "shingle")
        .groupBy(*row)
        .agg(F.sort_array(F.collect_list(F.struct("uses", "shingle"))).alias("c"))
        .withColumn("own", F.col("n") - F.size("c"))
    )
    length = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)).cast("int") + 1
    first = F.slice("c", F.lit(1), F.greatest(length - F.col("own"), F.lit(0)))
    filed = shared.written(
        common.select(*row, "own", F.posexplode(first).alias("at", "e")).select(
            "node", "g", "n", (F.col("n") - F.col("own") - F.col("at")).alias("rest"), "e.shingle"
        ),
        "filed",
    )
    heavy = (
        filed.groupBy("shingle", "g").agg(F.count("*").alias("c")).where(F.col("c") > LIGHT)
        .select("shingle", "g", F.lit(True).alias("heavy"))
    )
    marked = filed.join(heavy, ["shingle", "g"], "left").withColumn(
        "heavy", F.coalesce("heavy", F.lit(False))
    )
    left, right = (
        marked.select("shingle", *(F.col(c).alias(c + x) for c in ("node", "g", "n", "rest", "heavy")))
        for x in ("_a", "_b")
    )
    alike = (100 + percent) * F.least("rest_a", "rest_b") >= percent * (F.col("n_a") + F.col("n_b"))
    once = F.col("heavy_b") | (F.col("node_a") < F.col("node_b"))
    light = left.where(~F.col("heavy_a")).alias("l").join(
        right.alias("r"),
        (F.col("l.shingle") == F.col("r.shingle")) & (F.col("g_a") != F.col("g_b")) & once & alike,
    )
    two = heavy.select("shingle", F.col("g").alias("g_a")).join(
        heavy.select("shingle", F.col("g").alias("g_b")), "shingle"
    ).where("g_a < g_b")
    big = (
        left.where("heavy_a").join(two, ["shingle", "g_a"]).alias("l").join(
            right.where("heavy_b").alias("r"),
            (F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.g_b") == F.col("r.g_b")) & alike,
        )
    )
    pair = (F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return light.select(*pair).union(big.select(*pair)).distinct()


def deduplicated(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that are not kept. Rows with the same
    doc_id stay or go together; rows without doc_id stay."""
    dropped = (
        near_duplicates(docs, shingle_words, percent)
        .where(~F.col("kept"))
        .select(F.col("doc_id").alias("_dropped"))
        .distinct()
    )
    return docs.join(dropped, docs["doc_id"].cast("long") == F.col("_dropped"), "left_anti")
