"""From raw documents to training records, as five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``docs``.

A row without doc_id can be named by no decision on groups, so it stays in the
near-duplicate stage; the other stages judge every row by its own text. Rows
with the same doc_id are judged apart except there. Null and empty texts are
kept by all stages. Columns of any name may come along, and an empty table
passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalktally.llm import contamination, mixing, near_text, records, shared, toxicity

# Shares of all tokens by labelled quality.
WEIGHTS = {"high": 0.85, "low": 0.15}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window scores below 0.5."""
    return toxicity.clean(docs, _read(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one of the smallest id: five-word
    shingles, similarity of 0.8 or more."""
    return near_text.deduplicated(docs, 5, 80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    return contamination.clean(docs, _read(spark, sf_dir, "benchmark"), 10)


def mixed_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and those of a domain that has too few
    tokens for its weight more often."""
    labels = _read(spark, sf_dir, "labels").select("doc_id", mixing.quality_domain())
    return mixing.mixed(docs, labels, WEIGHTS, least=1.0, grow=True)


def as_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in length-delimited records, read back."""
    return records.encoded(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


STAGES = [
    ("toxicity", without_toxic),
    ("minhash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing", mixed_by_quality),
    ("token-id records", as_records),
]

# Neither a learned model nor a tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
