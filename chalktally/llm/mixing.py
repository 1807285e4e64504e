"""Mixing by soft membership: rates per document that bring domains to weights.

A classifier learned from a table of labels gives every document, labelled or
not, a probability for each domain, from the shape of its text: length, length
and variety of words, shares of signs. A document of n tokens counts for domain
k with n times its probability, times its rate. Rates are found by least squares
with projected gradients,

    1/2 sum_k (total_k - target_k)^2 / (T now_k) + reg/2 sum_d n_d/T (rate_d - 1)^2

over rates not below ``least``, T being the sum of targets and now_k a domain's
tokens at rate 1, so that a deviation counts by the size of its domain and few
steps are needed. All that a step gathers is one sum per domain; the rates stay
columns of the table.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalktally.llm import shared

SIGNS = ("!", "&", "%", "$", "#", "*", "|", "=", ".", ",", "\n")
FEATURES = ("size", "tokens", "word", "variety", *(f"sign{i}" for i in range(len(SIGNS))))
#: Labelled documents that the classifier is fitted to, picked by a hash.
LEARN_ROWS = 20_000
REG, STEPS, WRITE_EVERY, CLOSE = 0.01, 48, 6, 1e-5


def shaped(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_tokens, features) per row of (doc_id, text). ``row`` is a
    hash of id and text. A null text is empty."""
    text = F.coalesce("text", F.lit(""))
    tokens = F.greatest(F.col("n_tokens"), F.lit(1))
    size = F.greatest(F.length("t"), F.lit(1))
    bare = F.regexp_replace("t", r"^[\x20\x09-\x0D]+", "")
    return (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .select("doc_id", F.xxhash64("doc_id", "text").alias("row"), text.alias("t"))
        .withColumn("w", F.split(bare, r"[\x20\x09-\x0D]+"))
        .select(
            "doc_id", "row", "t",
            (F.size("w") - (F.element_at("w", -1) == "").cast("int")).cast("long").alias("n_tokens"),
            F.size(F.array_distinct("w")).alias("_kinds"),
        )
        .select(
            "doc_id", "row", "n_tokens",
            F.log1p(F.length("t")).alias("size"),
            F.log1p("n_tokens").alias("tokens"),
            F.least(F.length("t") / tokens, F.lit(50.0)).alias("word"),
            (F.col("_kinds") / tokens).alias("variety"),
            *(
                ((F.length("t") - F.length(F.replace("t", F.lit(s), F.lit("")))) / size).alias(f"sign{i}")
                for i, s in enumerate(SIGNS)
            ),
        )
    )


def _posteriors(rows: DataFrame, labels: DataFrame, domains: list[str]) -> list[Column]:
    """A column per domain with its probability. Domains without a label get
    nothing, unless there is no label at all: then all are equally likely."""
    marked = (
        labels.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("domain").alias("domain"))
    )
    sample = shared.written(
        rows.join(marked, "doc_id").orderBy(F.xxhash64("row"), "row").limit(LEARN_ROWS), "learn"
    )
    seen = sorted(r.domain for r in sample.select("domain").distinct().collect())
    if len(seen) < 2:
        known = seen or domains
        return [F.lit(1.0 / len(known) if d in known else 0.0) for d in domains]
    place = F.array_position(F.array(*map(F.lit, seen)), F.col("domain")) - 1
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
        sample.withColumn("label", place.cast("double"))
    )
    fitted = LogisticRegression(family="multinomial", maxIter=50, regParam=1e-4).fit(vectors)
    factors, bases = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    logits = {
        d: reduce(add, (F.col(f) * float(c) for f, c in zip(FEATURES, row, strict=True)), F.lit(float(b)))
        for d, row, b in zip(seen, factors, bases, strict=True)
    }
    return [
        1 / reduce(add, (F.exp(F.least(other - logits[d], F.lit(60.0))) for other in logits.values()))
        if d in logits else F.lit(0.0)
        for d in domains
    ]


def _sums(table: DataFrame, *columns: Column) -> np.ndarray:
    found = table.agg(*(F.sum(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
    return np.array([x or 0.0 for x in found])


def rates(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict[str, float],
    total: float | None = None,
    least: float = 0.0,
    grow: bool = False,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, row, n_tokens, p_<domain> for
    each domain of ``weights``, rate, and copies, the whole number of times to
    take the document: the rate with its fraction decided by a hash of the row.

    ``labels`` (doc_id, domain) says which documents are known to be of which
    domain; null ids and other domains are not looked at, of several labels the
    first by name counts. ``weights`` are shares of all tokens to aim for,
    ``total`` how many tokens there shall be: by default as many as there are;
    with ``grow``, the least for which no domain needs to lose any. A text that
    is null or empty has no tokens and rate 1. Rows with the same doc_id have
    rates of their own if their texts differ. Other columns are not looked at;
    an empty table gives an empty result.
    """
    domains = sorted(weights)
    share = np.array([weights[d] for d in domains]) / sum(weights.values())
    rows = shared.written(shaped(docs), "shaped")
    chances = [f"p_{d}" for d in domains]
    table = shared.written(
        rows.select(
            "doc_id", "row", "n_tokens",
            *(c.alias(n) for c, n in zip(_posteriors(rows, labels, domains), chances, strict=True)),
            F.lit(1.0).alias("rate"),
        ),
        "rates",
    )
    n, k = F.col("n_tokens"), len(domains)
    p = [F.col(c) for c in chances]
    products = [p[i] * p[j] * n for i in range(k) for j in range(i, k)]
    sums = _sums(table, n, *(n * x for x in p), *products)
    tokens, now = sums[0], sums[1 : k + 1]
    if grow:
        total = max([tokens, *(now[share > 0] / share[share > 0])])
    aim = share * (tokens if total is None else total)
    size = max(float(aim.sum()), 1.0)
    scale = np.maximum(now, 1e-6 * size)
    gram = np.zeros((k, k))
    gram[np.triu_indices(k)] = sums[k + 1 :]
    gram = (gram + np.triu(gram, 1).T) / np.sqrt(scale[:, None] * scale)
    pace = 1 / (np.linalg.eigvalsh(gram).max() + REG)
    rate, before = F.col("rate"), np.inf
    for i in range(STEPS):
        error = (_sums(table, *(n * x * rate for x in p)) - aim) / scale
        if np.abs(error - before).max() < CLOSE:
            break
        before = error
        step = reduce(add, (x * float(-pace * e) for x, e in zip(p, error, strict=True)))
        moved = F.greatest(rate * float(1 - pace * REG) + float(pace * REG) + step, F.lit(float(least)))
        rate = F.when(n > 0, moved).otherwise(1.0)
        if (i + 1) % WRITE_EVERY == 0:
            table = shared.written(table.withColumn("rate", rate), "rates")
            rate = F.col("rate")
    table = table.withColumn("rate", rate)
    part = F.pmod(F.xxhash64("row", F.lit("copies")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = F.floor("rate") + (part < F.col("rate") - F.floor("rate")).cast("int")
    return table.withColumn("copies", copies.cast("int"))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float], **how) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says."""
    found = rates(docs, labels, weights, **how).where("copies <> 1").select("row", "copies")
    changed = found.distinct().select(F.col("row").alias("_row"), F.col("copies").alias("_copies"))
    hashed = docs.withColumn(
        "_row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    )
    counted = hashed.join(changed, "_row", "left").withColumn(
        "_copies", F.coalesce("_copies", F.lit(1))
    )
    return counted.withColumn(
        "_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))
    ).select(docs.columns)


def quality_domain() -> Column:
    """Domain of a row of ``labels`` by its quality; null without one."""
    return F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("domain")
