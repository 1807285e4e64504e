"""Connected components of links between documents, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalktally.llm import shared


def components(links: DataFrame) -> DataFrame:
    """(node, component) from links (a, b) of integer ids: for every node that
    has a link, the smallest id reachable. Links to itself or null are ignored.

    Large-star and small-star steps in turn: each hangs neighbours on the
    smallest one they know, until nothing moves, which takes about as many
    rounds as the logarithm of the longest path. A node's links are never
    gathered: minima are taken before the exchange, and the join that hands
    them out again is one AQE can split if a node holds most links. Every round
    is a table in the shared folder.
    """
    a, b = F.col("a"), F.col("b")
    tree = shared.written(
        links.where(a != b)
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct(),
        "links",
    )
    before = _state(tree)
    while before[0]:
        both = tree.unionByName(tree.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m"))
        large = (
            both.join(least, "hi")
            .where(F.col("lo") > F.col("hi"))
            .select(F.col("lo").alias("hi"), F.least("m", "hi").alias("lo"))
            .distinct()
        )
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(
            F.explode(
                F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))
            ).alias("s")
        )
        tree = shared.written(
            small.select("s.hi", "s.lo").where("hi <> lo").distinct(), "links"
        )
        after = _state(tree)
        if after == before:
            break
        before = after
    return tree.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def _state(tree: DataFrame) -> tuple:
    """Number of links and a sum of hashes: the same only if nothing moved."""
    digest = F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
    return tuple(tree.agg(F.count("*"), digest).first())
