"""Set operations on key columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(*parts: DataFrame, fill: bool = False) -> DataFrame:
    """All rows of all parts by column name; fill adds absent columns as NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=fill)
    return out


def missing(dim: DataFrame, df: DataFrame, keys) -> DataFrame:
    """Rows of a dimension whose key has no data."""
    return dim.join(df.select(*keys).distinct(), list(keys), "left_anti")


minus = missing


def common(df: DataFrame, key: str, level: str, n_levels: int, cond=None) -> DataFrame:
    """Keys that qualify at every level."""
    d = df if cond is None else df.filter(cond)
    per = d.groupBy(key).agg(F.count_distinct(level).alias("__n"))
    return per.filter(F.col("__n") == n_levels).select(key)
