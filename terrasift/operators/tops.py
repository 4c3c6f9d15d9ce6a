"""Sorted extracts and report ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extremes(df: DataFrame, c: str, n: int, key: str) -> DataFrame:
    """n largest and n smallest values of a column, key as tie-break; two distributed top-n."""
    hi = df.filter(F.col(c).isNotNull()).orderBy(F.desc(c), key).limit(n).select(F.lit("top").alias("end"), key, c)
    lo = df.filter(F.col(c).isNotNull()).orderBy(F.asc(c), key).limit(n).select(F.lit("bottom").alias("end"), key, c)
    return hi.unionByName(lo)


def top_groups(df: DataFrame, keys, n: int) -> DataFrame:
    """The n largest groups."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys).limit(n)


def reorder(df: DataFrame, key: str, order) -> DataFrame:
    """Report rows in a stated order; listed keys without rows stay as empty lines."""
    t = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in order])).alias("position", key))
    return F.broadcast(t).join(df, key, "left").orderBy("position")
