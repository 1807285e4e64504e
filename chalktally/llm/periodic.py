"""Maximal periodic runs of words, by tiles per octave of periods.

A run is a stretch of words with smallest period q (words q apart are the same)
of at least ``MIN_LENGTH`` words and ``MIN_TURNS`` periods that can't be extended
keeping q. With p for a period, words i and i + p agree for all i of an interval
of at least max(24 - p, 2p) places; a run is such an interval that is maximal.

Periods fall into octaves: those below 16, then [16, 32), [32, 64) and so on. An
octave has anchors every ``spacing`` words, no more than the shortest interval it
looks for, so each interval holds an anchor. A text's anchors are dealt out as
tiles, stretches of some thousand words that overlap by what one anchor looks
at. A tile is solved alone: at each anchor two Z-functions, one of the words after
it, one of the words before it read backwards, give for every period of the octave
how far the words agree to both sides, up to the neighbouring anchors. Intervals
that reach the edge of a tile are fragments; they meet by text and period, and
touching ones are stitched together.

Only stretches in which every ``GRAM`` words come again within the octave's largest
period are dealt out: inside a run they all do. Whole texts are looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalktally.llm import shared
from chalktally.llm.words import mixed, pieces, words

MIN_LENGTH, MIN_TURNS = 24, 3
#: Periods of the first octave end here; its intervals have 16 places at least.
FIRST = 16
GRAM = 8
#: Words between the first anchors of neighbouring tiles, at least.
TILE_WORDS = 8192
OUT_BYTES = 4_000_000


def octave(number: int) -> tuple[int, int, int]:
    """(smallest period, end of the periods, spacing of the anchors)."""
    if number == 0:
        return 1, FIRST, FIRST
    low = FIRST << (number - 1)
    return low, 2 * low, 2 * low


def places(period: int) -> int:
    """The fewest places at which a word and the one a period on agree in a run."""
    return max(MIN_LENGTH - period, (MIN_TURNS - 1) * period)


def z_function(s: list[int], until: int) -> list[int]:
    """For each start below ``until`` how many items agree with the beginning."""
    n = len(s)
    z = [0] * until
    left = right = 0
    for i in range(1, until):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def next_same(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per word the distance to where its ``GRAM`` words come next in the same
    text; larger than any text where they don't. The last words of a text have none.
    Grams are told apart by a hash, so a distance may be too small by chance,
    which costs work and loses nothing."""
    n = len(codes)
    far = np.full(n, np.iinfo(np.int64).max, np.int64)
    if n < GRAM:
        return far
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = np.flatnonzero(np.arange(n) + GRAM <= np.repeat(starts[1:], np.diff(starts)))
    value = mixed(codes.astype(np.uint64) + np.uint64(1))
    h = mixed(text[inside].astype(np.uint64))
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + value[inside + k]
    h = mixed(h)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    same &= text[inside[order[1:]]] == text[inside[order[:-1]]]
    first = inside[order[:-1]][same]
    far[first] = inside[order[1:]][same] - first
    return far


def stretches(distance: np.ndarray, starts: np.ndarray, number: int) -> list[tuple[int, int, int]]:
    """(text, first, end) of the stretches in which a run with a period of this
    octave may have its agreeing places. The last words of a text never come
    again, so no stretch goes on into the next text."""
    _, high, spacing = octave(number)
    near = np.concatenate([[False], distance < high, [False]])
    change = np.flatnonzero(near[1:] != near[:-1])
    begin, end = change[::2], change[1::2]
    # Of the agreeing places those count whose gram lies within them.
    long = end - begin >= spacing - GRAM + 1
    begin, end = begin[long], end[long] + GRAM - 1
    text = np.searchsorted(starts, begin, side="right") - 1
    return list(zip(text.tolist(), begin.tolist(), end.tolist(), strict=True))


def anchored(number: int) -> int:
    """The words from a tile's first anchor to that of the next tile."""
    spacing = octave(number)[2]
    return max(TILE_WORDS // spacing, 4) * spacing


def tiles(codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(text, octave, place of the first word, first anchor, words) of all tiles;
    places count from the beginning of the text."""
    distance = next_same(codes, starts)
    longest = int(np.diff(starts).max(initial=0))
    number = 0
    while longest >= max(MIN_LENGTH, MIN_TURNS * octave(number)[0]):
        _, high, spacing = octave(number)
        step = anchored(number)
        done = (-1, -1)
        for text, a, b in stretches(distance, starts, number):
            begin, size = int(starts[text]), int(starts[text + 1] - starts[text])
            first = -(-(a - begin) // spacing) * spacing
            for tile in range(first // step, -(-(b - begin) // step)):
                if (text, tile) > done:
                    done = (text, tile)
                    left = max(0, tile * step - spacing)
                    right = min(size, (tile + 1) * step + high)
                    yield text, number, left, tile * step, codes[begin + left : begin + right]
        number += 1


def _agreeing(s: list[int], c: int, number: int) -> tuple[list[int], list[int], int]:
    """Z-function of the words after ``c``, how far the words before ``c`` and those
    before c + p agree for each period p, and how far back that was looked."""
    _, high, spacing = octave(number)
    right = z_function(s[c : c + spacing + high], min(high, len(s) - c))
    back = min(c, spacing)
    if not back:
        return right, [0] * len(right), 0
    both = s[c - back : c + high][::-1]
    after = len(both) - back
    z = z_function([*both[after:], -1, *both], back + 1 + after)
    # The word before c + p is so far from the end of ``both``.
    return right, [back, *(z[back + 1 + after - p] for p in range(1, after))], back


def fragments(s: list[int], number: int, left: int, first: int) -> list[tuple[int, int, int]]:
    """(period, first place, end) of the intervals of agreeing places that hold an
    anchor of this tile, of those long enough or cut by the edge of the tile.

    ``s`` are the words from place ``left`` of the text on, ``first`` is the place
    of the first anchor. A period is passed over where the words at the anchor
    repeat with a part of it: in a run of which it is the smallest they never do.
    """
    low, high, spacing = octave(number)
    step = anchored(number)
    begin = first - left
    out: list[tuple[int, int, int]] = []
    running: dict[int, tuple[int, int]] = {}

    def close(period: int, interval: tuple[int, int]) -> None:
        a, b = interval
        cut = (begin and a <= begin - spacing) or b >= begin + step
        if cut or b - a >= places(period):
            out.append((period, a + left, b + left))

    for c in range(begin, min(begin + step, len(s)), spacing):
        right, to_left, back = _agreeing(s, c, number)
        seen: dict[int, tuple[int, int]] = {}
        roots: list[int] = []
        for p in range(1, len(right)):
            go_on = right[p]
            # No run of the octave has fewer agreeing places.
            matters = p >= low and go_on + to_left[p] >= spacing
            if not matters and go_on < p:
                continue
            if any(p % q == 0 and q + right[q] >= p for q in roots):
                continue
            if go_on >= p:
                roots.append(p)
            if matters:
                a, b = c - to_left[p], c + min(go_on, spacing)
                if p in running and running[p][1] >= a:
                    a = running[p][0]
                seen[p] = (a, b)
        for p, interval in running.items():
            if p not in seen or seen[p][0] != interval[0]:
                close(p, interval)
        running = seen
    for p, interval in running.items():
        close(p, interval)
    return out


_PASSED = (
    "row long, doc_id {doc_id}, collapsed string, text string, "
    "octave int, origin long, anchor long, words binary"
)


def _joined(text: bytes) -> bytes:
    return b" ".join(text.split())


def _finished(text: bytes, digest: bool) -> str:
    return hashlib.sha256(text).hexdigest() if digest else text.decode()


def _passed(docs: DataFrame, digest: bool) -> DataFrame:
    """Written: a row per document, with its collapsed text if there is no tile of
    it, else with the text as it is, and a row per tile."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [part.split()[0] for part in _PASSED.split(", ")]

    def table(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
        n = len(columns["row"])
        kinds = [pa.int64(), batch["doc_id"].type, pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        arrays = [pa.array(columns.get(name, [None] * n), k) for name, k in zip(names, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            codes, starts, _ = words(batch["text"])
            rows = batch["row"].to_pylist()
            dealt: set[int] = set()
            out: dict[str, list] = {}
            size = 0
            for text, number, left, first, part in tiles(codes, starts):
                dealt.add(text)
                data = part.astype(np.int32).tobytes()
                row = {"row": rows[text], "octave": number, "origin": left, "anchor": first, "words": data}
                for name, value in row.items():
                    out.setdefault(name, []).append(value)
                size += len(data)
                if size > OUT_BYTES:
                    yield table(batch, **out)
                    out, size = {}, 0
            if out:
                yield table(batch, **out)
            texts = [t or b"" for t in batch["text"].cast(pa.binary()).to_pylist()]
            yield table(
                batch,
                row=rows,
                doc_id=batch["doc_id"],
                collapsed=[
                    None if i in dealt else _finished(_joined(t), digest) for i, t in enumerate(texts)
                ],
                text=[t.decode() if i in dealt else None for i, t in enumerate(texts)],
            )

    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return shared.written(numbered.mapInArrow(run, _PASSED.format(doc_id=kind)), "periodic")


#: Words of tiles that a task solves: some seconds.
TASK_WORDS, MOST_TASKS = 1_000_000, 20_000


def _runs(passed: DataFrame) -> DataFrame:
    """(row, runs) of the texts that have any: arrays of (start, length, period)."""
    found = passed.where("octave is not null").select("row", "octave", "origin", "anchor", "words")
    total = found.agg(F.sum(F.length("words"))).first()[0] or 0
    tasks = min(max(1, -(-total // (4 * TASK_WORDS))), MOST_TASKS)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for tile in batch.to_pylist():
                codes = np.frombuffer(tile["words"], np.int32).tolist()
                for part in fragments(codes, tile["octave"], tile["origin"], tile["anchor"]):
                    out.append((tile["row"], *part))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            arrays = [pa.array(c, pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "period", "a", "b"])

    dealt = found.repartition(tasks, "row", "octave", "anchor")
    parts = dealt.mapInArrow(solve, "row long, period long, a long, b long")
    by_place = Window.partitionBy("row", "period").orderBy("a", "b")
    reached = F.max("b").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce((F.col("a") > reached).cast("int"), F.lit(1))
    whole = (
        parts.withColumn("_apart", apart)
        .withColumn("_nth", F.sum("_apart").over(by_place))
        .groupBy("row", "period", "_nth")
        .agg(F.min("a").alias("start"), F.max("b").alias("end"))
    )
    fewest = F.greatest(F.lit(MIN_LENGTH) - F.col("period"), (MIN_TURNS - 1) * F.col("period"))
    run = F.struct("start", (F.col("end") - F.col("start") + F.col("period")).alias("length"), "period")
    return (
        whole.where(F.col("end") - F.col("start") >= fewest)
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(run)).alias("runs"))
    )


def collapsed_words(text: bytes, runs: list[dict]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    every = text.split()
    keep = np.ones(len(every) + 1, np.int64)
    change = np.zeros(len(every) + 1, np.int64)
    for r in runs:
        change[r["start"] + r["period"]] += 1
        change[r["start"] + r["length"]] -= 1
    keep = np.cumsum(change)[:-1] == 0
    return b" ".join(w for w, k in zip(every, keep.tolist(), strict=True) if k)


_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic(docs: DataFrame, digest: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, runs, an array of (start, length,
    period) by start, then period, and collapsed, the text's words without those
    that a run holds after its first period, joined by one space. With ``digest``
    collapsed is the SHA-256 of that in hexadecimal, and texts without repetition
    aren't written in between.

    A null or empty text has no words, no runs and an empty collapsed text.
    Repeated rows and ids are treated apart; other columns aren't looked at; an
    empty table gives an empty result.
    """
    passed = _passed(docs, digest)
    rows = passed.where("octave is null")
    plain = rows.where("collapsed is not null").select(
        "doc_id", F.array().cast(_RUNS).alias("runs"), "collapsed"
    )

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch["text"].cast(pa.binary()).to_pylist()
            done = [
                _finished(collapsed_words(t, r or []), digest)
                for t, r in zip(texts, batch["runs"].to_pylist(), strict=True)
            ]
            columns = [batch["doc_id"], batch["runs"], pa.array(done, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    again = (
        rows.where("collapsed is null")
        .select("row", "doc_id", "text")
        .join(_runs(passed), "row", "left")
        .select("doc_id", "text", F.coalesce("runs", F.array().cast(_RUNS)).alias("runs"))
        .mapInArrow(collapse, f"doc_id {kind}, runs {_RUNS}, collapsed string")
    )
    return plain.union(again)


def strongest(runs: str) -> Column:
    """The run of the greatest length / period, compared exactly; of equal ones the
    first. Null without runs."""
    column = F.col(runs)
    return F.aggregate(
        column,
        F.get(column, F.lit(0)),
        lambda best, r: F.when(
            r["length"] * best["period"] > best["length"] * r["period"], r
        ).otherwise(best),
    )
