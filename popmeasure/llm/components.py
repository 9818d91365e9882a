"""Connected components of a link table by alternating stars, with every round stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popmeasure.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = both.join(least, both["u"] == least["w"]).filter(F.col("v") > F.col("u"))
    return joined.select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them; links run from `a` < `b`."""
    least = links.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("w"), "m")
    joined = links.join(least, links["b"] == least["w"])
    moved = joined.filter(F.col("a") != F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), F.col("w").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    `links` has the columns a and b, in any order and with repeats; a null end or a link to itself is no link. The
    number of rounds grows with the logarithm of the longest chain.
    """
    now = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "a", "b").toDF("a", "b", "x", "y")
    now = now.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("a") != F.col("b")))
    now = written(now.select("a", "b").distinct())
    state = _state(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        following = written(_small_star(_large_star(now)))
        new = _state(following)
        now = following
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("a").alias("component")))
