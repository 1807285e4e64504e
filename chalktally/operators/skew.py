"""Running sums and numbers over hot keys, in one plan for every size.

A window over (key) order by (order) puts a key into one task. Here the order is
cut into grains that need no counting: seconds of an instant, blocks of
consecutive ids. The window runs per key and grain; what earlier grains add comes
from a table with a row per key and grain, summed before its exchange, over which
a second window runs. A key's rows within one grain are one task: a second of one
user, 4096 consecutive ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDS = 4096
LETTERS = 6


def grain(df: DataFrame, column: str) -> Column:
    """The grain of a column by its type; rows in the order of the column are in
    the order of their grains, and null is one of its own."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("second", column)
    if isinstance(kind, T.IntegralType):
        return F.floor(F.col(column) / IDS)
    if isinstance(kind, T.StringType):
        return F.left(column, F.lit(LETTERS))
    raise TypeError(f"no grain for {column} of type {kind.simpleString()}")


def earlier(
    df: DataFrame, keys: list[str], order: list[str], value: Column, name: str
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the earlier rows of the same keys,
    NULL if there is nothing. ``order`` starts with the column that grains are
    taken of and ends with a unique one."""
    sliced = df.withColumn("_grain", grain(df, order[0]))
    parts = [*keys, "_grain"]
    here = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_grain").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*parts).agg(F.sum(value).alias("_amount"))
    carried = (
        totals.withColumn("_carry", F.sum("_amount").over(before))
        .where(F.col("_carry").isNotNull())
        .select(*(F.col(p).alias(f"_of_{p}") for p in parts), "_carry")
    )
    same = F.lit(True)
    for p in parts:
        same = same & F.col(p).eqNullSafe(F.col(f"_of_{p}"))
    return (
        sliced.withColumn("_here", F.sum(value).over(here))
        .join(carried, same, "left")
        .select(*df.columns, plus("_here", "_carry").alias(name))
    )


def numbered(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Add ``name``: the place, from 1, of a row among those of its keys; ``order`` is
    unique within them."""
    before = earlier(df, keys, [order], F.lit(1), "_place")
    return before.select(*df.columns, (F.coalesce("_place", F.lit(0)) + 1).cast("int").alias(name))


def plus(a: str, b: str) -> Column:
    """Sum that is NULL only if both sides are."""
    return F.coalesce(F.col(a) + F.col(b), a, b)
