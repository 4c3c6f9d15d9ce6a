"""Seeded draws that do not depend on partitioning: order by md5 of key and seed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.functions.feat import hashed
from terrasift.operators import groups


def sample_n(df: DataFrame, n: int, key: str, seed) -> DataFrame:
    """n rows: a distributed top-n, each task keeps n rows at most."""
    h = hashed(F.col(key), seed)
    return df.withColumn("__h", h).orderBy("__h", key).limit(n).drop("__h")


def sample_keys(df: DataFrame, key: str, n: int, seed, min_rows: int = 1) -> DataFrame:
    """n of the keys that have at least min_rows rows."""
    k = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= min_rows)
    return sample_n(k, n, key, seed)


def per_group(df: DataFrame, group, m: int, key: str, draw) -> DataFrame:
    """m rows of each group; map tasks keep m per group before the shuffle."""
    return groups.head(df.withColumn("__h", hashed(F.col(key), draw)), list(group), ["__h", key], m).drop("__h", "rn")
