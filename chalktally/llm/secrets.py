"""Secrets in texts by patterns and by entropy, in SQL functions.

Base kinds are patterns. What they leave is searched for strings that look
drawn at random: a candidate is a run of one character class, a window of fixed
size slides over it, and the counts of its characters are kept as it moves, one
character in and one out, so the Shannon entropy of every window costs the same
few steps whatever its size. Windows at or above the entropy of their class are
marked and overlapping ones are one span.

Sums of c * log2(c) are whole millionths, so sliding adds up to what counting
anew would give. Candidates that an allow-list knows (identifiers, checksums,
links, words joined by signs, examples) are passed over; base kinds never are.

Long texts: matches are placed by running sums of lengths in two levels, and a
candidate is scanned in tiles of ``TILE`` window starts, so work grows with the
text and no pattern recurs per character.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalktally.llm.shared import let, sums_before

TILE = 512
MILLION = 1_000_000

# The base kinds, in the order of their report.
ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
BASE = ("assign", "access", "hex")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
# Runs shorter than wanted needn't be listed to be dropped: of the last two kinds
# a match is all of its run.
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{12,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
}
FEWEST = {"assign": 8, "access": 16, "hex": 32}


@dataclass(frozen=True)
class CharClass:
    """Characters (as the inside of a regular expression's brackets and one by
    one), size of the window, and the bits from which a window is reported. The
    window has at most 70 characters, as a count is one printable character."""

    name: str
    pattern: str
    letters: str
    window: int
    bits: float

    @property
    def most(self) -> int:
        """The largest sum of c * log2(c) of a reported window, in millionths,
        with what rounding may have added to it."""
        exact = self.window * (math.log2(self.window) - self.bits) * MILLION
        return math.floor(exact) + self.window


_DIGITS, _LOW = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharClass("entropy_hex", "0-9a-fA-F", _DIGITS + "abcdefABCDEF", 24, 3.0),
    CharClass("entropy_base64", "A-Za-z0-9+/_=-", _DIGITS + _LOW + _LOW.upper() + "+/_=-", 20, 3.8),
)
#: Candidates that are no secrets: only digits, words joined by signs, UUIDs,
#: checksums that name themselves, alphabets and examples.
ALLOW = (
    r"^[0-9_+/=-]+$",
    r"^[_/+=-]*(?:[A-Z]?[a-z]+|[A-Z]+)(?:[_/+=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*+[_/+=-]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(?:sha1|sha256|sha384|sha512|md5)[-=]",
    r"(?i)example|abcdefgh|12345678|xxxxxx",
)
#: What stands before such a candidate: the beginning of a link, the name of a checksum.
ALLOW_BEFORE = (
    r"://[^\x20\x09-\x0D]{0,200}\z",
    r"(?i)(?:sha-?1|sha-?256|sha-?512|md5|commit|checksum|digest|uuid)[\x20:=\"'(]{0,3}\z",
)


def scaled(count: int) -> int:
    """c * log2(c) in millionths."""
    return round(count * math.log2(count) * MILLION) if count else 0


def _spans_of(parts: Column, found: Column) -> Column:
    """(start, end, found, before) from the pieces between matches and the matches."""
    # A piece and the match after it are one step.
    heads = F.slice(parts, F.lit(1), F.size(found))
    sizes = F.zip_with(heads, found, lambda p, m: F.length(p) + F.length(m))

    def placed(sums: Column) -> Column:
        return F.transform(
            F.arrays_zip(sums.alias("at"), heads.alias("p"), found.alias("m")),
            lambda x: F.struct(
                (x["at"] + F.length(x["p"])).alias("start"),
                (x["at"] + F.length(x["p"]) + F.length(x["m"])).alias("end"),
                x["m"].alias("found"),
                x["p"].alias("before"),
            ),
        )

    return let(sums_before(sizes), placed)


_SPANS = "array<struct<start:int,end:int,found:string,before:string>>"


def located(text: Column, pattern: str) -> Column:
    """All matches of a pattern, leftmost and non-overlapping, with the text
    since the one before; starts and ends count code points, the end exclusive.
    The pattern must not match nothing."""

    def at(found: Column) -> Column:
        none = F.array().cast(_SPANS)
        return F.when(F.size(found) == 0, none).otherwise(
            let(F.split(text, pattern, -1), lambda parts: _spans_of(parts, found))
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), at)


def _long_enough(kind: str) -> Callable[[Column], Column]:
    def judge(found: Column) -> Column:
        part = F.regexp_extract(found, ASSIGN, 2) if kind == "assign" else found
        return F.length(part) >= FEWEST[kind]

    return judge


def _of_kind(text: Column, kind: str, pattern: str) -> Column:
    """Located matches of a base kind that are long enough."""
    judge = _long_enough(kind)
    return F.filter(located(text, pattern), lambda s: judge(s["found"]))


def _masked(text: Column, pattern: str, gone: Callable[[Column], Column]) -> Column:
    """The text with blanks, as many as characters, over matches that are ``gone``."""

    def filled(found: Column, parts: Column) -> Column:
        over = F.zip_with(
            F.transform(
                found, lambda m: F.when(gone(m), F.repeat(F.lit(" "), F.length(m))).otherwise(m)
            ),
            F.slice(parts, F.lit(2), F.size(found)),
            lambda m, p: F.concat(m, p),
        )
        return F.concat(F.get(parts, F.lit(0)), F.array_join(over, ""))

    def cut(found: Column) -> Column:
        return F.when(~F.exists(found, gone), text).otherwise(
            let(F.split(text, pattern, -1), lambda parts: filled(found, parts))
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), cut)


def _masking(kind: str, pattern: str) -> Callable[[Column], Column]:
    return lambda text: _masked(text, pattern, _long_enough(kind))


def _marks(tile: Column, chars: CharClass) -> Column:
    """A tile's window starts, 1 where the window has the entropy. The counts are
    a string with one character per letter, moved up and down as letters come
    and go."""
    size = F.lit(chars.window)
    gains = F.array(*(F.lit(scaled(c + 1) - scaled(c)).cast("long") for c in range(chars.window + 1)))
    zero = 48

    def moved(state: Column, letter: Column, by: int) -> Column:
        def at(place: Column) -> Column:
            count = F.ascii(F.substr(state["counts"], place, F.lit(1))) - zero

            def changed(c: Column) -> Column:
                gain = F.get(gains, c) if by > 0 else -F.get(gains, c - 1)
                return F.struct(
                    F.overlay(state["counts"], F.char(c + zero + by), place, F.lit(1)).alias("counts"),
                    (state["total"] + gain).alias("total"),
                    state["marks"].alias("marks"),
                )

            return let(count, changed)

        return let(F.instr(F.lit(chars.letters), letter), at)

    def step(state: Column, i: Column) -> Column:
        def out(s: Column) -> Column:
            letter = F.substr(tile, i - size, F.lit(1))
            return F.when(i <= size, s).otherwise(moved(s, letter, -1))

        def marked(s: Column) -> Column:
            mark = F.when(i < size, "").when(s["total"] <= chars.most, "1").otherwise("0")
            return F.struct(
                s["counts"].alias("counts"),
                s["total"].alias("total"),
                F.concat(s["marks"], mark).alias("marks"),
            )

        come = moved(state, F.substr(tile, i, F.lit(1)), 1)
        return let(let(come, out), marked)

    begin = F.struct(
        F.lit(chr(zero) * len(chars.letters)).alias("counts"),
        F.lit(0).cast("long").alias("total"),
        F.lit("").alias("marks"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.length(tile)), begin, step)["marks"]


def window_marks(candidate: Column, chars: CharClass) -> Column:
    """1 or 0 for every window of a candidate, in order. Windows that start in
    one tile end in the next, so a tile is read with the head of its follower."""

    def tiled(tiles: Column) -> Column:
        follow = F.transform(
            tiles,
            lambda t, k: F.concat(
                t, F.coalesce(F.left(F.get(tiles, k + 1), F.lit(chars.window - 1)), F.lit(""))
            ),
        )
        whole = F.filter(follow, lambda t: F.length(t) >= chars.window)
        return F.array_join(F.transform(whole, lambda t: _marks(t, chars)), "")

    return let(
        F.regexp_extract_all(candidate, F.lit(f".{{1,{TILE}}}"), F.lit(0)), tiled
    )


def _allowed(span: Column, allow: Sequence[str], before: Sequence[str]) -> Column:
    known = F.lit(False)
    for pattern in allow:
        known = known | span["found"].rlike(pattern)
    for pattern in before:
        # Patterns look back a bounded way.
        known = known | F.right(span["before"], F.lit(240)).rlike(pattern)
    return known


def random_looking(
    text: Column, chars: CharClass, allow: Sequence[str] = ALLOW, before: Sequence[str] = ALLOW_BEFORE
) -> Column:
    """(start, end) of the stretches of a text whose windows have the entropy."""
    candidates = F.filter(
        located(text, rf"(?<![{chars.pattern}])[{chars.pattern}]{{{chars.window},}}+"),
        lambda span: ~_allowed(span, allow, before),
    )
    # Marked windows that overlap or touch are one stretch.
    runs = rf"1(?:0{{0,{chars.window - 1}}}+1)*+"

    def stretches(span: Column) -> Column:
        return F.transform(
            located(window_marks(span["found"], chars), runs),
            lambda r: F.struct(
                (span["start"] + r["start"]).alias("start"),
                (span["start"] + r["end"] + (chars.window - 1)).alias("end"),
            ),
        )

    return F.flatten(F.transform(candidates, stretches))


def _reported(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")
        ),
    )


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            F.sort_array(spans),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def spans(
    docs: DataFrame,
    classes: Sequence[CharClass] = CLASSES,
    allow: Sequence[str] = ALLOW,
    before: Sequence[str] = ALLOW_BEFORE,
) -> DataFrame:
    """The rows of ``docs`` with ``_base`` and ``_added``, arrays of (start, rank,
    end, kind) of the base kinds and of each class, in that order of ranks. What
    a base kind reports is blanked before the classes look, so added spans never
    overlap base ones; those of two classes may.

    A null or empty text has no spans. Rows are judged alone, so repeated rows
    and ids make no difference; other columns stay as they are; an empty table
    gives an empty result.
    """
    text, base = F.col("_text"), F.col("_base")
    # Tests that see each text once and cheaply: without a keyword there is no
    # assignment, and without a run of the smallest window nothing that is a run.
    lower = F.lower(text)
    keyed = F.lit(False)
    for word in KEYWORDS:
        keyed = keyed | F.contains(lower, F.lit(word))
    fewest = min([FEWEST["hex"], *(chars.window for chars in classes)])
    every = "".join(f"[{p}]" for p in ("0-9a-f", *(chars.pattern for chars in classes)))
    may = {
        "assign": F.col("_keyed"),
        "access": F.contains(text, F.lit("AKIA")),
        "hex": F.col("_long"),
    }
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    base_spans = [
        F.when(may[kind], _reported(_of_kind(text, kind, p), kind, rank)).otherwise(none)
        for rank, (kind, p) in enumerate(PATTERNS.items())
    ]
    left = text
    for kind, p in PATTERNS.items():
        left = let(left, _masking(kind, p))
    left = F.when(F.size(base) == 0, text).otherwise(left)
    extra = let(
        left,
        lambda t: F.concat(
            none,
            *(
                _reported(random_looking(t, chars, allow, before), chars.name, len(BASE) + i)
                for i, chars in enumerate(classes)
            ),
        ),
    )
    return (
        docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
        .withColumn("_long", text.rlike(rf"(?<![{every}])[{every}]{{{fewest}}}"))
        .withColumn("_keyed", keyed)
        .withColumn("_base", F.concat(*base_spans))
        .withColumn("_added", F.when(F.col("_long"), extra).otherwise(none))
        .drop("_text", "_long", "_keyed")
    )


def secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex,
    base_sha256 of the base spans and spans, all of them, as
    ``kind:start:end`` by start, then kind, with commas between."""
    base = F.col("_base")

    def count(kind: str) -> Column:
        n = F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
        return n.alias(f"n_{kind}")

    # Only these columns: names of others may clash with those added.
    found = spans(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        *map(count, BASE),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat("_base", "_added")).alias("spans"),
    )
