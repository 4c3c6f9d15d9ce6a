"""Grouped summaries. All of them reduce on the map side first, so a hot key costs one partial row per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.functions.clean import known
from terrasift.functions.feat import bin_index
from terrasift.operators.quantiles import quantiles


def counts(df: DataFrame, c: str, name: str = "n") -> DataFrame:
    """Value counts, NULL left out, largest first with the value as tie-break."""
    return df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), c)


def top_values(df: DataFrame, c: str, n: int) -> DataFrame:
    """The n most frequent exact values."""
    return counts(df, c).limit(n)


def size_histogram(df: DataFrame, keys) -> DataFrame:
    """How many keys have 1, 2, 3, ... rows."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    return per.groupBy("size").agg(F.count(F.lit(1)).alias("keys"))


def distincts(df: DataFrame, keys, cols, combos=None) -> DataFrame:
    """Distinct values per group for several columns, plus distinct combinations of ``combos``."""
    aggs = [F.count(F.lit(1)).alias("records")] + [F.count_distinct(c).alias(f"{c}_distinct") for c in cols]
    if combos:
        aggs.append(F.count_distinct(F.struct(*combos)).alias("combos"))
    return df.groupBy(*keys).agg(*aggs)


def crosstab(df: DataFrame, a: str, b: str, values) -> DataFrame:
    """Counts of a by the given values of b, with an ``All`` row and column; ``other`` counts values not given, NULL too."""
    cols = [F.count_if(F.col(b) == v).alias(str(v)) for v in values]
    out = df.rollup(a).agg(*cols, F.count_if(~F.coalesce(F.col(b).isin(list(values)), F.lit(False))).alias("other"), F.count(F.lit(1)).alias("All"), F.grouping_id().alias("__g"))
    return out.withColumn(a, F.when(F.col("__g") == 1, "All").otherwise(F.col(a).cast("string"))).drop("__g")


def pivot(df: DataFrame, index, col: str, values, agg: Column) -> DataFrame:
    """Long to wide over stated values, so Spark needs no extra pass to find them."""
    return df.groupBy(*index).pivot(col, list(values)).agg(agg)


def melt(df: DataFrame, ids, cols, name="variable", value="value") -> DataFrame:
    return df.unpivot(list(ids), list(cols), name, value)


def describe(df: DataFrame, cols, ps=(0.25, 0.5, 0.75)) -> DataFrame:
    """One row per column: n, mean, sample sd, min, exact quantiles, max."""
    long = melt(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), [], cols, "column", "v")
    base = long.groupBy("column").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("min"), F.max("v").alias("max"))
    return base.join(quantiles(long, ["column"], ["v"], ps), "column")


def mode(df: DataFrame, keys, c: str, name: str = "mode") -> DataFrame:
    """Most frequent value per group, the smallest on ties, from value counts instead of value buffers."""
    per = df.filter(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count(F.lit(1)).alias("__n"))
    return per.groupBy(*keys).agg(F.min(F.struct((-F.col("__n")).alias("a"), F.col(c).alias("v"))).alias("__b")).select(*keys, F.col("__b.v").alias(name))


def histogram(df: DataFrame, c: str, edges, right: bool = True) -> DataFrame:
    """Counts over fixed edges, empty bins included."""
    inside = [bin_index(F.col(c), edges, right) == i for i in range(len(edges) - 1)]
    row = df.agg(*[F.count_if(known(k)).alias(f"b{i}") for i, k in enumerate(inside)])
    items = [F.struct(F.lit(i).alias("bin"), F.lit(float(edges[i])).alias("lo"), F.lit(float(edges[i + 1])).alias("hi"), F.col(f"b{i}").alias("n")) for i in range(len(edges) - 1)]
    return row.select(F.inline(F.array(*items)))


def shares(df: DataFrame, keys, c: str) -> DataFrame:
    """Percentage of each value of c within its group."""
    from terrasift.operators.groups import attach

    per = df.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("n"))
    return attach(per, list(keys), F.sum("n").alias("__t")).withColumn("pct", F.col("n") * 100.0 / F.col("__t")).drop("__t")


def joined_list(c: str | Column, sep: str = ";", distinct: bool = False) -> Column:
    """Sorted values of a bounded group as text; use it after the group-size rule has run."""
    v = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.concat_ws(sep, F.array_sort(F.collect_set(v) if distinct else F.collect_list(v)))


def best(df: DataFrame, keys, name: str, score: str) -> DataFrame:
    """Row name with the highest score per key, the smallest name on ties."""
    b = F.min(F.struct((-F.col(score)).alias("s"), F.col(name).alias("v"))).alias("b")
    return df.groupBy(*keys).agg(b).select(*keys, F.col("b.v").alias(name), (-F.col("b.s")).alias(score))


def over_seeds(df: DataFrame, keys, score: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"), F.min(score).alias("min"), F.max(score).alias("max"), F.count(score).alias("runs"))


def gain(df: DataFrame, keys, col: str, a, b, score: str) -> DataFrame:
    """Mean score of a minus mean score of b."""
    one = [F.avg(F.when(F.col(col) == v, F.col(score))).alias(n) for v, n in ((a, "first"), (b, "second"))]
    return df.groupBy(*keys).agg(*one).withColumn("gain", F.col("first") - F.col("second"))


def basic_problems(df: DataFrame, cols) -> DataFrame:
    """Missing, unreadable, negative and zero entries per text column, one pass."""
    aggs, items = [], []
    for c in cols:
        v = F.col(c).try_cast("double")
        empty = F.col(c).isNull() | (F.trim(F.col(c)) == "")
        tests = {"missing": empty, "unreadable": ~empty & v.isNull(), "negative": v < 0, "zero": v == 0}
        aggs += [F.count_if(known(t)).alias(f"{c}__{k}") for k, t in tests.items()]
        items.append(F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{k}").alias(k) for k in tests]))
    return df.agg(*aggs).select(F.inline(F.array(*items)))


def rule_failures(df: DataFrame, limits: dict) -> DataFrame:
    """Rows failing each limit, and rows failing any."""
    from terrasift.functions.clean import within, within_limits

    aggs = [F.count_if(~within(F.col(c), *lim)).alias(c) for c, lim in limits.items()] + [F.count_if(~within_limits(limits)).alias("any")]
    row = df.agg(*aggs)
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("rejected")) for k in [*limits, "any"]])))


def class_counts(df: DataFrame, cuts: dict) -> DataFrame:
    from terrasift.functions.feat import rating

    aggs, items = [], []
    for c, (lo, hi) in cuts.items():
        r = rating(F.col(c), lo, hi)
        aggs += [F.count_if(known(r == i)).alias(f"{c}_{i}") for i in range(3)]
        items.append(F.struct(F.lit(c).alias("column"), *[F.col(f"{c}_{i}").alias(n) for i, n in enumerate(("low", "medium", "high"))]))
    return df.agg(*aggs).select(F.inline(F.array(*items)))


def duplicates(df: DataFrame, cols, decimals: int = 6) -> DataFrame:
    """Groups of identical records over the (rounded) columns, NULL equal to NULL: groups, rows in them, largest group."""
    per = df.groupBy(*[F.round(F.col(c), decimals).alias(f"__k{i}") for i, c in enumerate(cols)]).agg(F.count(F.lit(1)).alias("m"))
    return per.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("m") > 1).alias("repeated_groups"), F.sum(F.when(F.col("m") > 1, F.col("m")).otherwise(0)).alias("rows_in_repeated"), F.max("m").alias("largest"))
