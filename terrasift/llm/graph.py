"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.session import cut


def _large(e: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Edges point down (u > v): a node and its lower neighbours are linked to the least of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    j = e.join(least, "u")
    own = least.select("u", F.col("m").alias("v"))
    rest = j.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(rest).distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the least node that can be reached.

    Self-links and null ends are ignored. Each round is grouped minima and equality joins, and ends in a reliable checkpoint;
    a star's centre with very many leaves is a join key of one row on the small side, which Spark's skew join can split.
    The loop ends when a round changes no edge, seen from the count and a checksum of the edges.
    """
    e = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen, e = mark, cut(_small(_large(e)))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
