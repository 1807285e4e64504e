"""URL filter: listed rules first, gradient-boosted trees for the rest.

The trees see how a url is written: length, depth, shares of digits and signs,
character entropy, parameters, and how often urls of the same host suffixes were
blocked among the labelled ones. They are learned from labelled urls.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalktally.llm import shared

#: Labelled urls that the trees are fitted to, picked by a hash.
LEARN_ROWS = 20_000
TREES, DEPTH, SMOOTH = 20, 4, 10.0
_BITS = ("abcdefghijklmnopqrstuvwxyz", "0123456789", "-", ".", "_", "/", "?&=#%")
FEATURES = (
    "url_length", "host_length", "path_length", "labels", "depth", "digits", "signs",
    "entropy", "parameters", "fragment", "secure", "last_rate", "pair_rate",
)


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: from there up to ``?``, ``#`` or the end. Both are empty
    if the url is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return shared.lower_ascii(host), path


def rule_of(rules: list[tuple[str, str]], host: str, path: str) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host is the url's or a
    parent of it, and the path starts with its path. Of equally long ones the
    first by name. Null if none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, said in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        of_host, slash, of_path = rule.partition("/")
        fits = (
            (F.col(host) == of_host) | F.endswith(host, F.lit("." + of_host))
        ) & F.startswith(path, F.lit(slash + of_path))
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, said).otherwise(verdict)
    return text, verdict


def _count(text: str, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _suffixes() -> tuple[Column, Column]:
    """The last label of the host, and the last two."""
    return F.substring_index("host", ".", -1), F.substring_index("host", ".", -2)


def features(urls: DataFrame) -> DataFrame:
    """Adds what is read from each url itself to (url, host, path)."""
    lowered = F.lower(F.coalesce("url", F.lit("")))
    size = F.greatest(F.length("_u"), F.lit(1))
    shares = [_count("_u", c) / size for group in _BITS for c in group]
    entropy = reduce(add, (F.when(x > 0, -x * F.log2(F.when(x > 0, x))).otherwise(0.0) for x in shares))
    return (
        urls.withColumn("_u", lowered)
        .withColumns(
            {
                "url_length": F.length("_u"),
                "host_length": F.length("host"),
                "path_length": F.length("path"),
                "labels": _count("host", "."),
                "depth": _count("path", "/"),
                "digits": _count("_u", "0123456789") / size,
                "signs": _count("_u", "-_.~%+") / size,
                "entropy": entropy,
                "parameters": _count("_u", "="),
                "fragment": F.contains("_u", F.lit("#")).cast("int"),
                "secure": F.startswith("_u", F.lit("https")).cast("int"),
                "last": _suffixes()[0],
                "pair": _suffixes()[1],
            }
        )
        .drop("_u")
    )


def _rates(labelled: DataFrame, suffix: str) -> DataFrame:
    """Per suffix the smoothed share of blocked ones among the labelled urls."""
    return labelled.groupBy(suffix).agg(
        ((F.sum("label") + SMOOTH / 2) / (F.count("*") + SMOOTH)).alias(f"{suffix}_rate")
    )


def judged(urls: DataFrame, labelled: DataFrame) -> DataFrame:
    """Adds ``blocked`` (1.0 or 0.0) to rows with (url, host, path).

    ``labelled`` has the same columns and ``label`` (1 to block); a null label is
    not learned from. With labels of one kind only, that kind is the verdict;
    without any, nothing is blocked.
    """
    known = shared.written(
        features(labelled.where("label is not null").select("url", "host", "path", "label")), "known"
    )
    kinds = sorted(r.label for r in known.select(F.col("label").cast("double")).distinct().collect())
    if len(kinds) < 2:
        return urls.withColumn("blocked", F.lit(kinds[0] if kinds else 0.0))
    last, pair = _rates(known, "last"), _rates(known, "pair")

    def with_rates(rows: DataFrame) -> DataFrame:
        return (
            rows.join(last, "last", "left").join(pair, "pair", "left")
            .fillna(0.5, ["last_rate", "pair_rate"])
        )

    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    sample = with_rates(
        known.withColumn("_h", F.xxhash64("url", "host")).orderBy("_h", "url").limit(LEARN_ROWS)
    )
    learn = shared.written(
        sample.select(*FEATURES, F.col("label").cast("double").alias("label")), "learn"
    )
    trees = GBTClassifier(
        labelCol="label", featuresCol="_features", maxIter=TREES, maxDepth=DEPTH, seed=7
    ).fit(vectors.transform(learn))
    trees.setPredictionCol("blocked").setRawPredictionCol("").setProbabilityCol("")
    columns = urls.columns
    return trees.transform(vectors.transform(with_rates(features(urls)))).select(*columns, "blocked")


def verdicts(
    pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None
) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule (null if
    none fits) and verdict (``allow`` or ``block``): the rule's, else the trees'.

    The trees learn from ``labels`` (url, label; 1 to block) if given, else from
    the urls of ``pages`` that a rule decides. A null url has an empty host and
    path and gets a verdict from them. Rows with the same page_id, or without,
    are judged apart. Other columns are not looked at; an empty table gives an
    empty result.
    """
    host, path = host_and_path("url")
    urls = pages.select("page_id", F.col("url").cast("string"))
    rule, said = rule_of(rules, "host", "path")
    ruled = urls.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "said": said})
    if labels is None:
        labelled = ruled.withColumn("label", F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0))
    else:
        labelled = labels.select("url", "label").withColumns({"host": host, "path": path})
    verdict = F.coalesce("said", F.when(F.col("blocked") > 0.5, "block").otherwise("allow"))
    return judged(ruled, labelled).select("page_id", "host", "path", "rule", verdict.alias("verdict"))
