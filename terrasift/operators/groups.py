"""Group statistics attached to rows, and rules about repeated rows.

A window over a key sends every row of that key to one task. Here the statistic is aggregated first (partial sums on
the map side) and joined back: the joined side has one row per key, so a key with a third of all rows is split by the
skew join of AQE instead of being held by one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach(df: DataFrame, keys, *aggs: Column) -> DataFrame:
    """Add per-group aggregates to each row; NULL keys form a group of their own."""
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(*aggs)))  # one row by construction
    g = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(*aggs)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return df.join(g, on).drop(*[f"__{k}" for k in keys])


def same_keys(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equality join in which NULL keys meet each other; the keys come from the left side."""
    keys = list(keys)
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row by construction
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    out = left.join(r, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{k}" for k in keys])


def size(df: DataFrame, keys, name: str = "n_at") -> DataFrame:
    return attach(df, keys, F.count(F.lit(1)).alias(name))


def demean(df: DataFrame, keys, cols) -> DataFrame:
    out = attach(df, keys, *[F.avg(c).alias(f"__m_{c}") for c in cols])
    return out.withColumns({f"{c}_dev": F.col(c) - F.col(f"__m_{c}") for c in cols}).drop(*[f"__m_{c}" for c in cols])


def zscore(df: DataFrame, keys, cols) -> DataFrame:
    """z-score with the sample deviation of the group."""
    aggs = [f(c).alias(f"__{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    out = attach(df, keys, *aggs)
    z = {f"{c}_z": F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")) for c in cols}
    return out.withColumns(z).drop(*[f"__{n}_{c}" for c in cols for n in "ms"])


def centroid(df: DataFrame, keys, x="x", y="y") -> DataFrame:
    return attach(df, keys, F.avg(x).alias("cx"), F.avg(y).alias("cy"))


def share(df: DataFrame, keys, col: str, name: str = "share") -> DataFrame:
    out = attach(df, keys, F.sum(col).alias("__t"))
    return out.withColumn(name, F.try_divide(F.col(col), F.col("__t"))).drop("__t")


def max_nunique(df: DataFrame, keys, cols, name: str = "n_var") -> DataFrame:
    """Largest number of distinct values over cols within the group of each row."""
    return attach(df, keys, F.greatest(*[F.count_distinct(c) for c in cols], F.lit(0)).alias(name))


def head(df: DataFrame, keys, order, n: int, name: str = "rn") -> DataFrame:
    """The n first rows per group. Spark cuts each map task's groups to n rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def first(df: DataFrame, keys, order) -> DataFrame:
    return head(df, keys, order, 1).drop("rn")


def unique_points(df: DataFrame, keys) -> DataFrame:
    """Rows that are alone at their key; keys with several rows go out whole."""
    return size(df, keys, "__n").filter(F.col("__n") == 1).drop("__n")


def repeated_points(df: DataFrame, keys, values, order) -> tuple[DataFrame, DataFrame]:
    """(kept, set aside): keys with one row, or whose rows agree in every value, keep one row each.

    Distinct counting is done by min = max per value, which needs no value sets.
    """
    same = reduce(lambda a, b: a & b, [F.coalesce(F.min(v) == F.max(v), F.lit(True)) for v in values])
    has = reduce(lambda a, b: a | b, [F.count(v) > 0 for v in values])
    tagged = attach(df, keys, F.count(F.lit(1)).alias("__n"), (same & has).alias("__same"))
    kept = first(tagged.filter((F.col("__n") == 1) | F.col("__same")), keys, order).drop("__n", "__same")
    return kept, tagged.filter(F.col("__n") > 1).drop("__n", "__same")


def label(df: DataFrame, key: str, name: str = "label") -> DataFrame:
    """Dense integer label of a key. Only distinct keys are numbered, by a range sort, then joined back.

    Each range partition counts its own keys; the offsets come from those counts (one row per partition), so the
    numbering never passes through a single task.
    """
    from terrasift.session import cut

    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = cut(keys.repartitionByRange(n, key).sortWithinPartitions(key).withColumn("__p", F.spark_partition_id()))
    w = Window.partitionBy("__p").orderBy(key)
    local = parts.withColumn("__i", F.row_number().over(w) - 1)
    counts = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # one row per partition
    before = counts.withColumn("__off", F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__p")) - F.col("__n")).drop("__n")
    lab = local.join(F.broadcast(before), "__p").select(key, (F.col("__off") + F.col("__i")).cast("long").alias(name))
    return df.join(lab, key, "left")
