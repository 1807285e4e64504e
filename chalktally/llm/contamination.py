"""Benchmark decontamination over a positional inverted index, in SQL functions.

The index holds postings (term, document, position) of the corpus for the terms
that decide: of every window of a benchmark item, the ``PROBES`` terms that are
rarest in the whole corpus. A window can only start where the list of its
rarest term, moved back by the term's place in the window, has an entry. The
lists of the next terms, moved likewise, are intersected with what is left, and
what survives is compared word for word with the text. Postings of frequent
terms are never stored, and none is left out that could start a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalktally.llm import shared

PROBES = 3
#: Rows of a term table up to which it may be sent to every executor.
BROADCAST_ROWS = 500_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def with_words(df: DataFrame) -> DataFrame:
    """Adds ``words``: lower-cased runs of ASCII letters and digits and of
    characters beyond ASCII in ``text``; none for a null text. The text is split
    in a step of its own, as what uses the parts more than once would split it
    as often."""
    parts = F.split(shared.lower_ascii(F.coalesce("text", F.lit(""))), _GAP)
    first = (F.element_at("_parts", 1) == "").cast("int")
    last = (F.element_at("_parts", -1) == "").cast("int")
    inner = F.slice("_parts", first + 1, F.greatest(F.size("_parts") - first - last, F.lit(0)))
    return df.withColumn("_parts", parts).withColumn("words", inner).drop("_parts")


def _checked_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id, terms) per window of ``size`` words; an item of fewer, but not
    none, is one window. ``phrase`` is the terms with blanks between."""
    split = with_words(items.select("item_id", "text")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - size, F.lit(0))
    return (
        split.withColumn("at", F.explode(F.sequence(F.lit(0), last)))
        .select("item_id", F.slice("words", F.col("at") + 1, F.lit(size)).alias("terms"))
        .withColumn("phrase", F.array_join("terms", " "))
        .distinct()
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows by a hash of id and text: rows with the same id stay apart, and a
    row without id has a key."""
    return docs.select(
        "doc_id", "text", F.xxhash64(F.col("doc_id"), F.col("text")).alias("row")
    )


def _tokens(keyed: DataFrame) -> DataFrame:
    # The outer form: the other one is filtered for non-empty arrays before, which
    # splits every text again for each time the filter mentions its parts.
    split = with_words(keyed).select("row", "words")
    return split.select("row", F.posexplode_outer("words").alias("pos", "term")).where(
        "term is not null"
    )


def probes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(phrase, rank, at, term): per window its rarest terms in the corpus and
    their places. Windows with a term that the corpus lacks have none."""
    placed = shared.written(
        windows.select("phrase", "terms")
        .distinct()
        .select("phrase", F.size("terms").alias("n"), F.posexplode("terms").alias("at", "term")),
        "placed",
    )
    terms = placed.select("term").distinct()
    known = _checked_broadcast(terms, placed.count())
    counts = _tokens(_keyed(docs)).join(known, "term").groupBy("term").agg(
        F.count("*").alias("uses")
    )
    entry = F.struct("uses", "at", "term")
    return (
        placed.join(counts, "term")
        .groupBy("phrase", "n")
        .agg(F.sort_array(F.collect_list(entry)).alias("by_use"))
        .where(F.size("by_use") == F.col("n"))
        .select("phrase", F.posexplode(F.slice("by_use", 1, PROBES)).alias("rank", "s"))
        .select("phrase", "rank", "s.at", "s.term")
    )


def index(docs: DataFrame, terms: DataFrame, rows: int) -> DataFrame:
    """Postings (row, pos, term) of ``docs`` for a table of distinct terms."""
    return _tokens(_keyed(docs)).join(_checked_broadcast(terms, rows), "term")


def _survivors(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((row, start, phrase) where all probes of a window fit, the postings)."""
    probe = shared.written(probes(docs, windows), "probes")
    terms = probe.select("term").distinct()
    postings = shared.written(index(docs, terms, probe.count()), "postings")
    left = postings.join(
        probe.where("rank = 0").select("phrase", "term", "at"), "term"
    ).select("row", (F.col("pos") - F.col("at")).alias("start"), "phrase").where("start >= 0")
    for rank in range(1, PROBES):
        more = probe.where(F.col("rank") == rank).select(
            "phrase", F.col("term").alias("_term"), F.col("at").alias("_at")
        )
        wanted = left.join(more, "phrase", "left").withColumn(
            "_pos", F.col("start") + F.col("_at")
        )
        listed = postings.select(
            "row", F.col("pos").alias("_pos"), F.col("term").alias("_term"),
            F.lit(True).alias("_there"),
        )
        left = (
            wanted.join(listed, ["row", "_pos", "_term"], "left")
            .where(F.col("_term").isNull() | F.col("_there"))
            .select("row", "start", "phrase")
        )
    return left, postings


def matches(
    docs: DataFrame, items: DataFrame, size: int = 10, all_rows: bool = True
) -> DataFrame:
    """Per row of ``docs``: doc_id, row, n_words and ``hits``, the occurrences
    (start, phrase) of windows of ``items`` in its text, each exact. Without
    ``all_rows`` those whose postings fit no window are left out."""
    windows = item_windows(items, size)
    found, _ = _survivors(docs, windows)
    by_row = (
        found.distinct()
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "phrase")).alias("_maybe"))
    )
    there = F.filter(
        F.coalesce("_maybe", F.array().cast("array<struct<start:int,phrase:string>>")),
        lambda m: F.array_join(
            F.slice("words", m["start"] + 1, F.size(F.split(m["phrase"], " "))), " "
        )
        == m["phrase"],
    )
    joined = _keyed(docs).join(by_row, "row", "left" if all_rows else "inner")
    return with_words(joined).select(
        "doc_id", "row", F.size("words").alias("n_words"), there.alias("hits")
    )


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit (words inside
    an occurrence of a window of ``items``), n_items (items with an occurring
    window), items_sha256 (hex of the sorted item_ids as text, with commas
    between) and contaminated (n_hit > 0).

    Null and empty texts have no words and no hits. Items without words have no
    window; items that are equal count each. Rows with the same doc_id are judged
    apart. Other columns of either table are not looked at. An empty table of
    documents gives an empty result; with no items nothing is hit.
    """
    judged = shared.written(matches(docs, items, size), "judged")
    covered = F.array_distinct(
        F.flatten(
            F.transform(
                "hits",
                lambda h: F.sequence(
                    h["start"], h["start"] + F.size(F.split(h["phrase"], " ")) - 1
                ),
            )
        )
    )
    of_items = (
        judged.select("row", F.explode("hits.phrase").alias("phrase"))
        .distinct()
        .join(item_windows(items, size).select("phrase", "item_id"), "phrase")
        .groupBy("row")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("_items"))
    )
    nothing = F.array().cast("array<string>")
    return (
        judged.select("doc_id", "row", "n_words", F.size(covered).alias("n_hit"))
        .join(of_items, "row", "left")
        .withColumn("_items", F.coalesce("_items", nothing))
        .select(
            "doc_id",
            F.col("n_words").cast("long").alias("n_words"),
            F.col("n_hit").cast("long").alias("n_hit"),
            F.size("_items").cast("long").alias("n_items"),
            F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


def proximity(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 5) -> DataFrame:
    """(doc_id, item_id): all terms of a window of the item lie, in any order,
    within ``size + slop`` words of the document. Looked for around the
    postings of the window's rarest term."""
    windows = item_windows(items, size)
    probe = shared.written(probes(docs, windows).where("rank = 0"), "probes")
    around = (
        index(docs, probe.select("term").distinct(), probe.count())
        .join(probe.select("phrase", "term"), "term")
        .select("row", "pos", "phrase")
        .distinct()
        .groupBy("row")
        .agg(F.collect_list(F.struct("pos", "phrase")).alias("_maybe"))
    )
    span = size + slop

    def close(m):
        terms = F.array_distinct(F.split(m["phrase"], " "))
        starts = F.sequence(F.greatest(m["pos"] - (span - 1), F.lit(0)), m["pos"])
        return F.exists(
            starts,
            lambda s: F.size(F.array_except(terms, F.slice("words", s + 1, F.lit(span)))) == 0,
        )

    return (
        with_words(_keyed(docs).join(around, "row"))
        .select("doc_id", F.explode(F.filter("_maybe", close)).alias("m"))
        .select("doc_id", F.col("m.phrase").alias("phrase"))
        .join(windows.select("phrase", "item_id"), "phrase")
        .select("doc_id", "item_id")
        .distinct()
    )


def clean(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of ``items``."""
    # Written before it is filtered, as the filter would split each text again.
    judged = shared.written(
        matches(docs.select("doc_id", "text"), items, size, all_rows=False).select(
            F.col("row").alias("_row"), F.size("hits").alias("n")
        ),
        "judged",
    )
    found = judged.where("n > 0").select("_row").distinct()
    return docs.withColumn("_row", F.xxhash64("doc_id", "text")).join(
        found, "_row", "left_anti"
    ).drop("_row")
