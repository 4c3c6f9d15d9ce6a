"""Nearest neighbours in a standardised feature space, exact, with bounded groups."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasift.operators.blockwise import top_k


def standardise(df: DataFrame, cols) -> DataFrame:
    """z-scores with the population deviation of the whole table (two numbers per column)."""
    row = df.agg(*[f(c).alias(f"{n}{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.withColumns({c: (F.col(c) - row[f"m{c}"]) / (row[f"s{c}"] or 1.0) for c in cols})


def feature_knn(q: DataFrame, r: DataFrame, feats, k: int, *, id="id", cols=(), exclude: str | None = None, bucket: int = 2000, tie: int = 6) -> DataFrame:
    """(query id, nb, d, *cols): the k nearest rows of r in feature space whose ``exclude`` value differs.

    Rows are cut into buckets by their distance to one pivot (the mean vector). A first pass inside the own bucket
    bounds the k-th distance; by the triangle inequality only buckets whose pivot distances lie within
    that bound can hold anything nearer, and the second pass visits exactly those. Identical vectors are folded to k
    ids per exclude value, and a bucket never holds more than its share of rows or queries in one task.
    """
    g = [exclude] if exclude else []
    feats = list(feats)
    pivot = r.agg(*[F.avg(c).alias(c) for c in feats]).first()
    pd_ = F.sqrt(sum(((F.col(c) - pivot[c]) * (F.col(c) - pivot[c]) for c in feats), F.lit(0.0)))
    ref = r.select(F.col(id).alias("nb"), *feats, *g, *cols)
    ref = ref.withColumn("__i", F.row_number().over(Window.partitionBy(*feats, *g).orderBy("nb"))).filter(F.col("__i") <= k).drop("__i").withColumn("__p", pd_)
    n = ref.count()
    parts = max(1, math.ceil(n / bucket))
    # split points of the pivot distance: one sketch value per bucket
    probes = [i / parts for i in range(1, parts)]
    cuts = ref.agg(F.percentile_approx("__p", F.array(*[F.lit(x) for x in probes]), 10000)).first()[0] if probes else []
    cuts = sorted(set(cuts))
    arr = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")

    def bucket_of(v):
        return F.size(F.filter(arr, lambda c: c <= v))

    ref = ref.withColumn("__b", bucket_of(F.col("__p")))
    que = q.select(id, *feats, *g).withColumn("__p", pd_).withColumn("__b", bucket_of(F.col("__p")))
    salts = max(1, math.ceil(que.count() / max(1, len(cuts) + 1) / (2 * bucket)))
    que = que.withColumn("__s", F.pmod(F.xxhash64(id), F.lit(salts)).cast("int"))
    ref = ref.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    first = top_k(que, ref, ["__b", "__s"], feats, k, qid=id, rid="nb", exclude=exclude, tie=tie)
    bound = first.groupBy(id).agg(F.count(F.lit(1)).alias("c"), F.max("d").alias("R")).select(id, F.when(F.col("c") >= k, F.col("R")).alias("R"))
    more = que.join(bound, id, "left").withColumn("R", F.coalesce("R", F.lit(float("inf"))) + 10.0**-tie)
    # buckets are ordered by pivot distance, so those within the bound are a run of numbers: an equality join again
    lo, hi = bucket_of(F.col("__p") - F.col("R")), bucket_of(F.col("__p") + F.col("R"))
    hit = more.withColumnRenamed("__b", "__own").withColumn("__b", F.explode(F.sequence(lo, hi))).filter(F.col("__b") != F.col("__own"))
    second = top_k(hit.drop("__own"), ref, ["__b", "__s"], feats, k, qid=id, rid="nb", exclude=exclude, tie=tie, radius="R")
    both = first.unionByName(second)
    wk = Window.partitionBy(id).orderBy("d", "nb")
    best = both.withColumn("rank", F.row_number().over(wk)).filter(F.col("rank") <= k)
    pay = r.select(F.col(id).alias("nb"), *cols)
    return best.join(pay, "nb") if cols else best


def knn_predict(df: DataFrame, feats, y: str, k: int, fold: str, *, id="id") -> DataFrame:
    """Distance-weighted and plain mean of y over the k nearest rows of other folds; NULL for a row without any."""
    nb = feature_knn(df, df, feats, k, id=id, cols=[y], exclude=fold)
    w = 1.0 / F.greatest(F.col("d"), F.lit(1e-9))
    p = nb.groupBy(id).agg((F.sum(F.col(y) * w) / F.sum(w)).alias("pred"), F.avg(y).alias("pred_uniform"))
    return df.join(p, id, "left")
