"""Near-duplicate vectors of the same label by spherical-cap filters.

A filter is a direction; a vector passes those whose inner product with it is at
least ``CUT`` standard deviations of that product for random vectors. Directions
form structured random product codes: the space is turned at random and split
into two blocks with ``CODES`` random unit vectors each, and every combination of
one per block is a direction. All that a vector passes are decoded from its block
products: only those enter that reach the cut with the best of the other block.
``TURNS`` codes are used side by side. Two vectors of cosine 0.98 pass dozens of
filters together, random ones hardly any. Members of a filter are compared in
double precision.

A filter with many members is cut into blocks of ``SPAN``; every pair of blocks
is a group of its own, compared by a matrix product. A link counts only under
the first filter that both vectors pass, so it is counted once, and a group
returns per vector its number of links and the smallest vector it is connected
to there: pairs are never written out. Small groups are handed over in bundles.

In fewer than ``FEWEST`` dimensions random vectors are so close to each other, and
so few of them reach the cut, that filters would lose links. There all vectors of
a label are members of one filter, so every pair is compared, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalktally.llm import shared
from chalktally.llm.components import components

TURNS, CODES, CUT = 12, 1024, 4.1
FEWEST = 48
SPAN = 512
#: Rows of groups that are handed to a function together, about.
BUNDLE = 1500


def _codes(dimensions: int, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per turn the two blocks' code vectors as columns over the whole space."""
    rng = np.random.default_rng(seed)
    half = max(1, dimensions // 2)
    out = []
    for _ in range(TURNS):
        turn = np.linalg.qr(rng.standard_normal((dimensions, dimensions)))[0]
        blocks = []
        for axes in (turn[:, :half], turn[:, half:]):
            c = rng.standard_normal((axes.shape[1], CODES))
            blocks.append(axes @ (c / np.maximum(np.linalg.norm(c, axis=0), 1e-300)))
        out.append((blocks[0], blocks[1]))
    return out


def passed(units: np.ndarray, codes: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """All filters that each unit vector passes, ascending."""
    if units.shape[1] < FEWEST:
        return [np.zeros(1, np.int64) for _ in units]
    enough = CUT * np.sqrt(2 / units.shape[1])
    found: list[list[np.ndarray]] = [[] for _ in units]
    for turn, (first, second) in enumerate(codes):
        one, two = units @ first, units @ second
        best_one, best_two = one.max(1), two.max(1)
        for i in np.flatnonzero(best_one + best_two >= enough):
            a = np.flatnonzero(one[i] >= enough - best_two[i])
            b = np.flatnonzero(two[i] >= enough - best_one[i])
            x, y = np.nonzero(one[i][a][:, None] + two[i][b] >= enough)
            found[i].append((turn * CODES + a[x]) * CODES + b[y])
    return [np.concatenate(f) if f else np.zeros(0, np.int64) for f in found]


def _usable(v: np.ndarray | None) -> bool:
    return v is not None and len(v) > 0 and bool(np.isfinite(v).all()) and bool(np.any(v))


def _unit(values) -> np.ndarray:
    v = np.asarray(values, np.float64)
    v = v / np.abs(v).max()
    return v / np.linalg.norm(v)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes: dict[int, list] = {}
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            units = [
                None if not v or any(x is None for x in v) or not _usable(np.asarray(v)) else _unit(v)
                for v in part["embedding"].to_pylist()
            ]
            filters = [np.zeros(0, np.int64)] * len(units)
            for size in {len(u) for u in units if u is not None}:
                at = [i for i, u in enumerate(units) if u is not None and len(u) == size]
                if size not in codes:
                    codes[size] = _codes(size)
                for i, f in zip(at, passed(np.stack([units[i] for i in at]), codes[size]), strict=True):
                    filters[i] = f
            yield pa.RecordBatch.from_arrays(
                [part["vec_id"], part["label"], pa.array(units, pa.list_(pa.float64())),
                 pa.array(filters, pa.list_(pa.int64()))],
                ["vec_id", "label", "unit", "filters"],
            )


def _connected(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Per vector the smallest id it is connected to by the links of this group."""
    least = ids.copy()
    while True:
        found = np.where(linked, least[None, :], np.iinfo(np.int64).max).min(1)
        found = np.minimum(found, least)
        if (found == least).all():
            return least
        least = found


def _compared(here: int, ids, sides, weight, units, filters, cosine: float) -> tuple:
    """(links, least) per member of one group."""
    x = np.stack(units)
    linked = x @ x.T >= cosine
    # Two blocks: only pairs across them, the others are in groups of their own.
    if sides.min() != sides.max():
        linked &= sides[:, None] != sides[None, :]
    np.fill_diagonal(linked, False)
    if not linked.any():
        return np.zeros(len(ids), np.int64), ids
    earlier = [f[f < here] for f in filters]
    names, place = np.unique(np.concatenate(earlier), return_inverse=True)
    passes = np.zeros((len(ids), len(names)), np.float32)
    passes[np.repeat(np.arange(len(ids)), [len(f) for f in earlier]), place] = 1
    once = linked & (passes @ passes.T == 0)
    return once.astype(np.int64) @ weight, _connected(linked, ids)


def _compare(cosine: float):
    def run(bundle: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (here, *_), g in bundle.groupby(["filter", "label", "size", "i", "j"], sort=False):
            ids = g["node"].to_numpy(np.int64)
            if len(ids) > 1:
                links, least = _compared(
                    here, ids, g["part"].to_numpy(), g["copies"].to_numpy(np.int64),
                    g["unit"].to_list(), g["filters"].to_list(), cosine,
                )
                some = (links > 0) | (least != ids)
                vector = g["vector"].to_numpy(np.int64)
                out.append((ids[some], vector[some], links[some], least[some]))
        columns = [np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*out, strict=True)] or [[]] * 4
        names = ("node", "vector", "links", "least")
        return pd.DataFrame(dict(zip(names, columns, strict=True)), dtype="int64")

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links (other
    vectors linked directly), component_id (smallest vec_id reachable by links,
    its own included) and kept (vec_id = component_id).

    Vectors of the same label that isn't null are linked if their cosine in
    double precision is at least ``cosine``; vectors that are null, empty or zero
    or hold null or non-finite components, and those without vec_id, link with
    nothing, and neither do vectors of different length. Equal vectors are one
    to the search and count as so many links. Rows with the same vec_id are one
    node of several rows: each reports the sum of the links of all, be their vectors
    and labels equal or not. Other columns are not
    looked at; an empty table gives an empty result. With fewer than ``FEWEST``
    dimensions no link is missed, but the work grows with the square of a label.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long"),
        F.col("label").cast("string"),
        F.col("embedding").cast("array<double>"),
    )
    decoded = shared.written(
        rows.mapInArrow(
            _decode, "vec_id long, label string, unit array<double>, filters array<long>"
        ),
        "decoded",
    )
    usable = decoded.where("unit is not null and label is not null and vec_id is not null")
    same = ["label", "u1", "u2"]
    hashed = usable.withColumns({"u1": F.xxhash64("unit"), "u2": F.hash("unit")})
    # A node may have several vectors and labels; ``vector`` tells them apart.
    hashed = hashed.withColumn("vector", F.xxhash64(*same))
    key = ["node", "vector"]
    nodes = hashed.groupBy(*same).agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    one = (
        hashed.join(nodes, same)
        .where(F.col("vec_id") == F.col("node"))
        .select(*key, "label", "copies", "unit", "filters", F.size("unit").alias("size"))
        .dropDuplicates(key)
    )
    one = shared.written(one, "vectors")
    filed = one.select(*key, "label", "size", F.explode("filters").alias("filter"))
    place = ["label", "size", "filter"]
    shared_ones = filed.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1")
    met = shared.written(filed.join(shared_ones, place), "met")
    # Only filters that somebody else passes can be the first common one.
    sent = met.groupBy(*key).agg(F.collect_list("filter").alias("filters")).join(
        one.select(*key, "copies", "unit"), key
    )
    parts = F.ceil(F.col("n") / SPAN).cast("int")
    part = F.pmod(F.xxhash64(*key), parts).cast("int")
    # A member goes to the groups of its block with each block, its own included.
    others = F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda p: F.struct(F.least(p, F.col("part")).alias("i"), F.greatest(p, F.col("part")).alias("j")),
    )
    groups = (
        met.withColumn("part", part)
        .select(*place, *key, "part", F.explode(others).alias("g"))
        .select(*place, *key, "part", "g.i", "g.j")
        .join(sent, key)
    )
    size = shared_ones.agg(F.sum(F.col("n") * F.ceil(F.col("n") / SPAN))).first()[0] or 0
    bundles = 1 + int(size) // BUNDLE
    found = shared.written(
        groups.withColumn("bundle", F.pmod(F.xxhash64(*place, "i", "j"), F.lit(bundles)))
        .groupBy("bundle")
        .applyInPandas(_compare(cosine), "node long, vector long, links long, least long"),
        "found",
    )
    counts = found.groupBy(*key).agg(F.sum("links").alias("links"))
    copies = hashed.join(nodes, same)
    edges = found.select(F.col("node").alias("a"), F.col("least").alias("b")).union(
        copies.select("node", "vec_id")
    )
    reached = shared.written(components(edges), "groups").withColumnRenamed("node", "vec_id")
    linked = (
        copies.join(counts, key, "left")
        .select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
        .groupBy("vec_id")
        .agg(F.sum("n").alias("n_links"))
    )
    component = F.coalesce("component", "vec_id")
    return (
        decoded.select("vec_id")
        .join(linked, "vec_id", "left")
        .join(reached, "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            component.alias("component_id"),
            F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
        )
    )
