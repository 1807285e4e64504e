"""Tables a job writes to the shared folder and reads back, and small columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 128
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names, which every executor sees. Only
    a session whose executors run inside the driver may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        folder = tempfile.mkdtemp(prefix="chalktally-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, purpose: str) -> str:
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: computed
    once, cut from its lineage, with a known size, and still there if executors
    are lost. The folder is the owner's to clear after the job."""
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def held_out(doc_id: str, folds: int) -> Column:
    """True where crc32 of the id as text leaves remainder 0; False without id."""
    text = F.col(doc_id).cast("string").cast("binary")
    return F.coalesce(F.crc32(text) % folds == 0, F.lit(False))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sums_before(sizes: Column) -> Column:
    """For each size the sum of all before it, by blocks, so that the work grows
    with the number of sizes."""

    def within(block: Column, start: Column) -> Column:
        sums = F.aggregate(
            block,
            F.array(start),
            lambda acc, x: F.array_append(acc, F.element_at(acc, F.lit(-1)) + x),
        )
        return F.slice(sums, F.lit(1), F.size(block))

    def blocks(sizes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(sizes) - 1, F.lit(BLOCK))
        return F.transform(starts, lambda i: F.slice(sizes, i + 1, F.lit(BLOCK)))

    def summed(parts: Column) -> Column:
        totals = F.transform(parts, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.zip_with(parts, within(totals, F.lit(0)), within))

    return let(sizes, lambda s: let(blocks(s), summed))
