"""Scores as aggregate expressions and nested aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.operators import groups
from terrasift.operators.quantiles import quantiles
from terrasift.session import cut


def r2(y: str, p: str) -> Column:
    """1 - SSE / SST; NULL where the target does not vary."""
    e = F.col(y) - F.col(p)
    return 1.0 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))


def errors(y: str, p: str) -> dict[str, Column]:
    e = F.col(p) - F.col(y)
    return {"n": F.count(y), "r2": r2(y, p), "rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(F.abs(e)), "bias": F.avg(e)}


def smape(y: str, p: str) -> Column:
    a = (F.abs(F.col(y)) + F.abs(F.col(p))) / 2.0
    return F.avg(F.try_divide(F.abs(F.col(p) - F.col(y)), a))


def scores(df: DataFrame, keys, y: str, p: str) -> DataFrame:
    """n, R2, RMSE, MAE, bias, RPIQ, RPD and sMAPE per group; NULL keys are a group of their own.

    The few columns needed are stored first: the plan that predicts runs once, and each pass below reads the stored rows.
    """
    keys = list(keys)
    ok = cut(df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).select(*keys, y, p))
    aggs = [c.alias(n) for n, c in errors(y, p).items()] + [F.stddev_samp(y).alias("__sd"), smape(y, p).alias("smape")]
    q = quantiles(ok, keys, [y], [0.25, 0.75]).withColumn("__iqr", F.col(f"{y}_p75") - F.col(f"{y}_p25")).drop(f"{y}_p25", f"{y}_p75")
    base = ok.groupBy(*keys).agg(*aggs)
    j = groups.same_keys(base, q, keys)
    return j.withColumns({"rpiq": F.try_divide("__iqr", "rmse"), "rpd": F.try_divide("__sd", "rmse")}).drop("__iqr", "__sd")


def by_fold(df: DataFrame, keys, fold: str, y: str, p: str) -> DataFrame:
    per = df.groupBy(*keys, fold).agg(r2(y, p).alias("r2"))
    return per.groupBy(*keys).agg(F.avg("r2").alias("mean_r2"), F.stddev_samp("r2").alias("sd_r2"), F.count("r2").alias("folds"))


def confusion(df: DataFrame, keys, y: str, p: str, classes) -> DataFrame:
    """Counts of true by predicted class; ``other`` counts predictions outside the stated classes, NULL too."""
    cols = [F.count_if(F.col(p) == c).alias(str(c)) for c in classes]
    return df.groupBy(*keys, y).agg(*cols, F.count_if(~F.coalesce(F.col(p).isin(list(classes)), F.lit(False))).alias("other"))


def classes(df: DataFrame, keys, y: str, p: str, labels=(0, 1, 2)) -> DataFrame:
    """Accuracy, balanced accuracy, macro F1 and recall per class; classes absent from y are left out of the means."""
    keys = list(keys)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == F.col(p)).alias("__hit")]
    for c in labels:
        aggs += [F.count_if((F.col(y) == c) & (F.col(p) == c)).alias(f"__tp{c}"), F.count_if(F.col(y) == c).alias(f"__y{c}"), F.count_if(F.col(p) == c).alias(f"__p{c}")]
    t = df.groupBy(*keys).agg(*aggs)
    rec = {c: F.try_divide(f"__tp{c}", f"__y{c}") for c in labels}
    f1 = {c: F.when(F.col(f"__y{c}") > 0, F.col(f"__tp{c}") * 2.0 / (F.col(f"__y{c}") + F.col(f"__p{c}"))) for c in labels}

    def mean(parts):
        present = [F.col(f"__y{c}") > 0 for c in labels]
        total = sum((F.coalesce(v, F.lit(0.0)) for v in parts.values()), F.lit(0.0))
        return total / sum((b.cast("int") for b in present), F.lit(0))

    return t.select(*keys, "n", (F.col("__hit") / F.col("n")).alias("accuracy"), mean(rec).alias("balanced_accuracy"), mean(f1).alias("macro_f1"), *[rec[c].alias(f"recall_{c}") for c in labels])


def pooled_var(df: DataFrame, keys, group, v: str) -> DataFrame:
    """Within-group variance pooled over the groups: sum of squared deviations / (rows - groups)."""
    per = df.filter(F.col(v).isNotNull()).groupBy(*keys, *group).agg((F.var_pop(v) * F.count(v)).alias("ss"), F.count(v).alias("m"))
    return per.groupBy(*keys).agg(F.try_divide(F.sum("ss"), F.sum("m") - F.count(F.lit(1))).alias("pooled_var"))


def noise_ceiling(df: DataFrame, cols, spot, district, spot_cond: Column) -> DataFrame:
    """Per column (log1p): same-spot, within-district and total variance, and the shares they imply."""
    long = df.select(*spot, *district, spot_cond.alias("__same"), *[F.log1p(c).alias(c) for c in cols]).unpivot([*spot, *district, "__same"], list(cols), "target", "v")
    a = pooled_var(long.filter("__same"), ["target"], spot, "v").withColumnRenamed("pooled_var", "var_same_spot")
    b = pooled_var(long, ["target"], district, "v").withColumnRenamed("pooled_var", "var_within_district")
    c = long.groupBy("target").agg(F.var_samp("v").alias("var_total"))
    out = a.join(b, "target").join(c, "target")
    return out.withColumns({
        "share_between": 1.0 - F.col("var_within_district") / F.col("var_total"),
        "ceiling": 1.0 - F.col("var_same_spot") / F.col("var_within_district"),
    })


def variance_share(df: DataFrame, v: str, cond: Column) -> DataFrame:
    """Share of the total sum of squares carried by the rows meeting cond."""
    m = groups.attach(df, [], F.avg(v).alias("__m"))
    sq = (F.col(v) - F.col("__m")) * (F.col(v) - F.col("__m"))
    return m.agg(F.count_if(cond).alias("rows"), (F.sum(F.when(cond, sq)) / F.sum(sq)).alias("share"))


def average_rank(df: DataFrame, keys, v: str, name: str, splits: int = 256) -> DataFrame:
    """Rank with ties averaged, per group, exact, with no group ranked in one task.

    Value counts shrink ties first; a sketch then cuts each group into value ranges of similar weight, ranks are taken
    inside a range and shifted by the rows of the ranges before it.
    """
    per = df.filter(F.col(v).isNotNull()).groupBy(*keys, v).agg(F.count(F.lit(1)).alias("__c"))
    probes = F.array(*[F.lit(i / splits) for i in range(1, splits)])
    cuts = df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(v, probes, 1000)).alias("__cuts"))
    per = per.join(cuts, keys).withColumn("__r", F.size(F.filter("__cuts", lambda c: c < F.col(v)))).drop("__cuts")
    tot = per.groupBy(*keys, "__r").agg(F.sum("__c").alias("__t"))
    w0 = Window.partitionBy(*keys).orderBy("__r")  # at most `splits` rows per group
    before = tot.withColumn("__before", F.sum("__t").over(w0) - F.col("__t")).drop("__t")
    w1 = Window.partitionBy(*keys, "__r").orderBy(v).rowsBetween(Window.unboundedPreceding, 0)
    ranked = per.withColumn("__to", F.sum("__c").over(w1)).join(before, [*keys, "__r"])
    ranked = ranked.select(*keys, v, (F.col("__before") + F.col("__to") - (F.col("__c") - 1) / 2.0).alias(name))
    return df.join(ranked, [*keys, v], "left")


def spearman(df: DataFrame, keys, a: str, b: str) -> DataFrame:
    """Rank correlation per group."""
    ok = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = average_rank(average_rank(ok, keys, a, "__ra"), keys, b, "__rb")
    return r.groupBy(*keys).agg(F.corr("__ra", "__rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def within(df: DataFrame, group, y: str, p: str, min_n: int) -> DataFrame:
    """Mean R2 inside groups with at least min_n rows."""
    per = df.groupBy(*group).agg(r2(y, p).alias("r2"), F.count(F.lit(1)).alias("m")).filter(F.col("m") >= min_n)
    return per.agg(F.avg("r2").alias("within_r2"), F.count(F.lit(1)).alias("groups"))


def share_by_group(df: DataFrame, keys, group: str, v: str) -> DataFrame:
    per = df.groupBy(*keys, group).agg(F.sum(v).alias("v"))
    return groups.share(per, list(keys), "v")


def position_error(df: DataFrame, keys, pred=("px", "py"), null=("nx", "ny"), x="x", y="y") -> DataFrame:
    """Median distance of predicted and of null positions to the true ones."""
    d = df.withColumns({"model_err": F.hypot(F.col(pred[0]) - F.col(x), F.col(pred[1]) - F.col(y)), "null_err": F.hypot(F.col(null[0]) - F.col(x), F.col(null[1]) - F.col(y))})
    q = quantiles(d, keys, ["model_err", "null_err"], [0.5])
    return q.withColumn("ratio", F.try_divide("model_err_p50", "null_err_p50"))
