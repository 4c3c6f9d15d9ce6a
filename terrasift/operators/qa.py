"""Checks between tables: comparisons, subsets, copies, distance profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.operators.groups import same_keys
from terrasift.operators.quantiles import quantiles


def compare(a: DataFrame, b: DataFrame, keys, cols) -> DataFrame:
    """Per column: matched keys, keys on one side only, largest absolute difference."""
    left = a.select(*keys, F.lit(1).alias("__a"), *[F.col(c).alias(f"a__{c}") for c in cols])
    right = b.select(*keys, F.lit(1).alias("__b"), *[F.col(c).alias(f"b__{c}") for c in cols])
    j = left.join(right, list(keys), "full_outer")
    row = j.agg(
        F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("matched"), F.count_if(F.col("__b").isNull()).alias("left_only"), F.count_if(F.col("__a").isNull()).alias("right_only"),
        *[F.max(F.abs(F.col(f"a__{c}") - F.col(f"b__{c}"))).alias(f"m__{c}") for c in cols])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), "matched", "left_only", "right_only", F.col(f"m__{c}").alias("max_diff")) for c in cols])))


def is_subset(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Keys of a that b lacks, and whether there are none."""
    miss = a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_anti")
    return miss.agg(F.count(F.lit(1)).alias("missing")).withColumn("subset", F.col("missing") == 0)


def copies_in_train(train: DataFrame, test: DataFrame, cols, decimals: int = 6) -> DataFrame:
    """Test rows with an identical training record over the rounded columns.

    Both sides are first folded to distinct records, so a record that fills the table is one row in the join.
    """
    rec = [F.round(F.col(c), decimals).alias(c) for c in cols]
    t = train.select(*rec).distinct().withColumn("__hit", F.lit(1))
    q = test.select(*rec).groupBy(*cols).agg(F.count(F.lit(1)).alias("m"))
    on = reduce(lambda x, y: x & y, [q[c].eqNullSafe(t[c]) for c in cols])
    j = q.join(t, on, "left").agg(F.sum("m").alias("test_rows"), F.sum(F.when(F.col("__hit") == 1, F.col("m")).otherwise(0)).alias("copies"))
    return j.withColumn("share", F.try_divide("copies", "test_rows"))


def distance_profile(df: DataFrame, keys, d: str, ps=(0.05, 0.25, 0.5, 0.75, 0.95), cuts=(30, 100, 1000, 5000)) -> DataFrame:
    """Rows, exact quantiles and shares within fixed distances."""
    keys = list(keys)
    base = df.groupBy(*keys).agg(F.count(d).alias("rows"), *[F.avg((F.col(d) <= m).cast("double")).alias(f"le_{m}m") for m in cuts])
    q = quantiles(df, keys, [d], ps)
    q = q.withColumnsRenamed({c: c.replace(f"{d}_", "") + "_m" for c in q.columns if c not in keys})
    return same_keys(base, q, keys)
