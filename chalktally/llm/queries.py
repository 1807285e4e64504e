"""Registered queries over the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalktally.llm import (
    contamination,
    conversations,
    conversations_sql,
    language_id,
    language_model,
    mixing,
    near_text,
    near_vectors,
    periodic,
    pii,
    records,
    secrets,
    secrets_sql,
    shared,
    toxicity,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark, sf_dir):
    """Rates that bring the tokens of documents like those labelled good to nine
    tenths, the number of tokens staying as it is."""
    labels = _read(spark, sf_dir, "labels").select("doc_id", mixing.quality_domain())
    return mixing.rates(
        _read(spark, sf_dir, "documents"), labels, {"high": 0.9, "low": 0.1}
    ).drop("row")


def op2_lm_scoring(spark, sf_dir):
    return language_model.language_model(_read(spark, sf_dir, "documents"), 10)


def op3_minhash_near_dedup(spark, sf_dir):
    """Three-word shingles, similarity of 0.85 or more."""
    return near_text.near_duplicates(_read(spark, sf_dir, "documents"), 3, 85)


def op4_pii_surrogates(spark, sf_dir):
    """The key stands in for one that a user keeps secret."""
    return pii.with_surrogates(_read(spark, sf_dir, "documents"), "registered-query")


# The rules and what they say.
URL_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


def op5_url_filter(spark, sf_dir):
    """The trees learn from the urls that a rule decides."""
    return url_filter.verdicts(_read(spark, sf_dir, "pages"), URL_RULES)


def op6_benchmark_decontamination(spark, sf_dir):
    """Windows of ten words."""
    return contamination.contamination(
        _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), 10
    )


def op7_token_id_records(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return records.encoded(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


def op8_embedding_near_dedup(spark, sf_dir):
    return near_vectors.near_vectors(_read(spark, sf_dir, "embeddings"), 0.98)


def op9_language_id(spark, sf_dir):
    return language_id.language(_read(spark, sf_dir, "documents"), 5)


def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity(
        _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), 5
    )


def op11_secret_scan(spark, sf_dir):
    return secrets.secrets(_read(spark, sf_dir, "documents"))


def _damaged(doc_id: Column, text: Column) -> Column:
    """From word a on, one text in ten repeats itself with period p."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        again = F.transform(
            F.sequence(a, n - 1), lambda i: F.get(words, (a + (i - a) % p).cast("int"))
        )
        whole = F.concat(F.slice(words, F.lit(1), a.cast("int")), again)
        return F.when(n > 0, F.array_join(whole, " ")).otherwise(text)

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(h % 10 == 0, shared.let(words, repeated)).otherwise(text)


def op12_periodic_runs(spark, sf_dir):
    """One text in ten is made to repeat itself first."""
    docs = _read(spark, sf_dir, "documents").select(
        "doc_id", _damaged(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("text")
    )
    best = periodic.strongest("runs")
    lines = F.transform(
        "runs",
        lambda r: F.concat_ws(",", *(r[f].cast("string") for f in ("start", "length", "period"))),
    )
    return (
        periodic.periodic(docs, digest=True)
        .withColumn("best", best)
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            *(F.col(f"best.{f}") for f in ("start", "length", "period")),
            F.expr("1000 * best.length div best.period").alias("exponent_milli"),
            F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias(
                "runs_sha256"
            ),
            F.col("collapsed").alias("collapsed_sha256"),
        )
    )


def _torn(rows: DataFrame) -> DataFrame:
    """By a hash of conversation and turn: one row in twenty is dropped, emptied, has
    no stops, comes twice, or is the user's."""
    space = F.lit(" ")
    place = F.concat_ws(
        ":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    )
    fate = F.crc32(place.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return (
        rows.select(
            "conv_id",
            "turn",
            F.when(fate == 4, "user").otherwise(role).alias("role"),
            F.when(fate == 1, "")
            .when(fate == 2, F.regexp_replace(text, "[.!?]", ""))
            .otherwise(text)
            .alias("text"),
            F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
            fate.alias("fate"),
        )
        .where("fate <> 0")
        .drop("fate", "copy")
    )


def op13_conversation_repair(spark, sf_dir):
    """Some rows are damaged first."""
    given = _read(spark, sf_dir, "conversations")
    mended = conversations.repaired(_torn(given), digest=True).withColumnRenamed("conv_id", "_of")
    none = F.lit(0).cast("long")
    return (
        given.select("conv_id")
        .distinct()
        .join(mended, F.col("conv_id").eqNullSafe(F.col("_of")), "left")
        .select(
            "conv_id",
            *(
                F.coalesce(c, none).alias(c)
                for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
            ),
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
        )
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_lm_scoring,
        op3_minhash_near_dedup,
        op4_pii_surrogates,
        op5_url_filter,
        op6_benchmark_decontamination,
        op7_token_id_records,
        op8_embedding_near_dedup,
        op9_language_id,
        op10_toxicity,
        op11_secret_scan,
        op12_periodic_runs,
        op13_conversation_repair,
    )
}

_OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w
  FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w
  FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 10) n,
    array_to_string(list_slice(w, i + 1, i + least(len(w), 10)), ' ') p
  FROM (SELECT item_id, w, unnest(generate_series(0, greatest(len(w) - 10, 0))) i
        FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i + 1, i + n), ' ') p
  FROM (SELECT doc_id, w, n, unnest(generate_series(0, len(w) - n)) i
        FROM d, sizes WHERE len(w) >= n)),
hit AS (
  SELECT r.doc_id, r.i, r.n, w.item_id FROM runs r JOIN win w ON r.p = w.p AND r.n = w.n),
pos AS (
  SELECT doc_id, count(DISTINCT i + k) n_hit
  FROM (SELECT doc_id, i, unnest(generate_series(0, n - 1)) k
        FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit,
  coalesce(n_items, 0) n_items, sha256(coalesce(s, '')) items_sha256,
  coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

# Smallest id reachable by links (a, b), and n_links per node.
_REACHED = """
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
walk(a, b) AS (SELECT a, b FROM ways UNION SELECT w.a, l.b FROM walk w JOIN ways l ON w.b = l.a),
reached AS (SELECT a AS id, min(b) AS least FROM walk GROUP BY a),
linked AS (SELECT a AS id, count(*) AS n FROM ways WHERE a <> b GROUP BY a)"""

_OP3_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 3), ' ') x
  FROM (SELECT doc_id, w, unnest(generate_series(0, greatest(len(w) - 3, 0))) i
        FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (
    SELECT s.doc_id a, t.doc_id b, count(*) c FROM s JOIN s t ON s.x = t.x AND s.doc_id < t.doc_id
    GROUP BY s.doc_id, t.doc_id) p JOIN n u ON u.doc_id = p.a JOIN n v ON v.doc_id = p.b
  WHERE 100 * p.c >= 85 * (u.n + v.n - p.c)),{_REACHED}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.least, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(r.least, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reached r ON r.id = d.doc_id
"""

_OP8_SQL = f"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id a, y.vec_id b FROM e x JOIN e y ON x.label = y.label AND x.vec_id < y.vec_id
    AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.98),{_REACHED}
SELECT m.vec_id, coalesce(l.n, 0) AS n_links, least(m.vec_id, coalesce(r.least, m.vec_id)) AS component_id,
  m.vec_id = least(m.vec_id, coalesce(r.least, m.vec_id)) AS kept
FROM embeddings m LEFT JOIN linked l ON l.id = m.vec_id LEFT JOIN reached r ON r.id = m.vec_id
"""

ORACLE_SQL: dict[str, str] = {
    "op3_minhash_near_dedup": _OP3_SQL,
    "op6_benchmark_decontamination": _OP6_SQL,
    "op8_embedding_near_dedup": _OP8_SQL,
    "op11_secret_scan": secrets_sql.sql(),
    "op13_conversation_repair": conversations_sql.sql(),
}
