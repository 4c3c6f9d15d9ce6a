"""Joins through delimited member lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def via_members(loc: DataFrame, samples: DataFrame, loc_id: str, ids: str = "ids_merged", id: str = "id", sep: str = ";") -> DataFrame:
    """Samples with the columns of the location that lists them."""
    links = loc.withColumn("__m", F.explode(F.split(ids, sep))).drop(ids)
    return samples.join(links, F.col(id).cast("string") == F.col("__m")).drop("__m")


def members(df: DataFrame, group: str, id: str = "id", most: int = 1000) -> DataFrame:
    """(group, part, ids_merged, n_part): the members of every group as delimited lists of about ``most`` ids at most.

    A group of few rows has one list. A large one is dealt by the hash of its ids to as many parts as its size asks for, so no task
    and no row holds a whole group; the parts keep every row, NULL ids included in the count alone. NULL is a group.
    """
    from terrasift.operators import agg, groups

    sized = groups.size(df.select(group, id), [group], "__n").withColumn("part", F.pmod(F.xxhash64(id), F.greatest(F.lit(1), F.ceil(2 * F.col("__n") / most)).cast("long")).cast("int"))
    sized = sized.withColumn("part", F.when(F.col("__n") <= most, F.lit(0)).otherwise(F.col("part")))
    return sized.groupBy(group, "part").agg(agg.joined_list(id).alias("ids_merged"), F.count(F.lit(1)).alias("n_part"))
