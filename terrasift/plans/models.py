"""Closed-form predictors, target scaling and out-of-fold bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.session import cut


def scale_target(df: DataFrame, y: str, train: Column) -> DataFrame:
    """z = (log1p(y) - mean) / population sd, both from the training rows; mean and sd stay on the row."""
    z = F.log1p(F.col(y))
    stats = df.filter(train).agg(F.avg(z).alias("z_mean"), F.stddev_pop(z).alias("z_sd"))
    return df.crossJoin(F.broadcast(stats)).withColumn("z", F.try_divide(z - F.col("z_mean"), F.col("z_sd")))  # one-row side


def unscale(z: Column) -> Column:
    return F.expm1(z * F.col("z_sd") + F.col("z_mean"))


def clip_to_train(df: DataFrame, y: str, pred: str, train: Column) -> DataFrame:
    """Prediction limited to the range of the training target."""
    r = df.filter(train).agg(F.min(y).alias("__lo"), F.max(y).alias("__hi"))
    out = df.crossJoin(F.broadcast(r))  # one-row side
    return out.withColumn(pred, F.greatest("__lo", F.least("__hi", pred))).drop("__lo", "__hi")


def _others(df: DataFrame, keys, fold: str, aggs: dict) -> DataFrame:
    """Per (keys, fold): sums over the rows of all other folds, as total minus fold. aggs: name -> sum column."""
    per = df.groupBy(*keys, fold).agg(*[c.alias(f"__f_{n}") for n, c in aggs.items()])
    tot = per.groupBy(*keys).agg(*[F.sum(f"__f_{n}").alias(f"__t_{n}") for n in aggs])
    j = per.join(tot, list(keys)) if keys else per.crossJoin(F.broadcast(tot))  # one-row side when there are no keys
    return j.select(*keys, fold, *[(F.col(f"__t_{n}") - F.col(f"__f_{n}")).alias(n) for n in aggs])


def group_mean(df: DataFrame, y: str, group: str, fold: str, pred: str = "pred") -> DataFrame:
    """Mean of log1p(y) in the group over the other folds; the other folds' overall mean where the group is absent there or NULL."""
    ly = F.log1p(y)
    sums = {"s": F.sum(ly), "m": F.count(ly)}
    g = _others(df, [group], fold, sums).select(group, fold, F.when(F.col("m") > 0, F.col("s") / F.col("m")).alias("__g"))
    a = _others(df, [], fold, sums).select(fold, F.try_divide("s", "m").alias("__a"))
    out = df.join(g, [group, fold], "left").join(F.broadcast(a), fold)  # one row per fold
    return out.withColumn(pred, F.expm1(F.coalesce("__g", "__a"))).drop("__g", "__a")


def majority(df: DataFrame, y: str, fold: str, pred: str = "pred") -> DataFrame:
    """Most frequent class of the other folds, the smallest on ties."""
    per = df.groupBy(fold, y).agg(F.count(F.lit(1)).alias("m"))
    tot = per.groupBy(y).agg(F.sum("m").alias("t"))
    folds = per.select(F.col(fold).alias("__fold")).distinct()
    all_pairs = folds.join(F.broadcast(tot), F.lit(True))  # folds x classes, a few dozen rows
    own = per.select(F.col(fold).alias("__fold"), y, "m")
    left = all_pairs.join(own, ["__fold", y], "left").withColumn("rest", F.col("t") - F.coalesce("m", F.lit(0))).filter("rest > 0")
    best = left.groupBy("__fold").agg(F.min(F.struct((-F.col("rest")).alias("a"), F.col(y).alias("c"))).alias("b")).select("__fold", F.col("b.c").alias(pred))
    return df.join(F.broadcast(best), F.col(fold) == F.col("__fold")).drop("__fold")


def train_mean(df: DataFrame, cols, fold: str, suffix: str = "_null") -> DataFrame:
    """Mean of each column over the other folds."""
    aggs = {}
    for c in cols:
        aggs |= {f"s_{c}": F.sum(c), f"m_{c}": F.count(c)}
    a = _others(df, [], fold, aggs).select(fold, *[F.try_divide(f"s_{c}", f"m_{c}").alias(f"{c}{suffix}") for c in cols])
    return df.join(F.broadcast(a), fold)


def idw(df: DataFrame, y: str, k: int, fold: str, weight=None, *, pred: str = "pred", id="id", x="x", y_="y") -> DataFrame:
    """Inverse-distance mean of log1p(y) over the k nearest rows of other folds."""
    from terrasift.operators import knn

    d = cut(df.withColumn("__ly", F.log1p(y)))  # folds are dealt once, then read by each step of the join
    value = lambda arr: {pred: F.expm1(knn.weighted_mean(arr, "__ly", weight or knn.inverse(30.0)))}
    return knn.knn(d, d, k, cols=["__ly"], exclude=fold, qid=id, rid=id, x=x, y=y_, reduce=value).drop("__ly")


def local_reference_split(df: DataFrame, y: str, test: str, mode: str, k: int = 10, *, site: str = "site", id="id") -> DataFrame:
    """Local reference features for one train/test split; every neighbour is a training row.

    mode "site": neighbours of the own site never count; "self": training rows skip themselves only.
    """
    from terrasift.operators import knn

    d = df.withColumn("__ly", F.log1p(y))
    tr, te = d.filter(F.col(test) == 0), d.filter(F.col(test) == 1)
    kw = dict(cols=["__ly"], qid=id, rid=id, reduce=lambda arr: knn.reference_of(arr, "__ly"))
    if mode == "site":
        # training sites and test sites may share members in an ungrouped split: the site test covers both
        a = knn.knn(d, tr, k, exclude=site, **kw)
    else:
        a = knn.knn(tr, tr, k, exclude="self", **kw).unionByName(knn.knn(te, tr, k, **kw))
    return a.drop("__ly")


def local_reference_folds(df: DataFrame, y: str, fold: str, n_folds: int, k: int = 10, *, site: str = "site", id="id") -> DataFrame:
    """Local reference features for every outer fold in one join: rows are (outer, row, is_test).

    The reference side of outer fold f holds the rows of the other folds, keyed by f; own-site rows never count.
    """
    from terrasift.operators import knn

    d = df.withColumn("__ly", F.log1p(y)).withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    d = d.withColumn("is_test", (F.col(fold) == F.col("outer")).cast("int"))
    a = knn.knn(d, d.filter("is_test = 0"), k, cols=["__ly"], exclude=site, by="outer", qid=id, rid=id, reduce=lambda arr: knn.reference_of(arr, "__ly"))
    return a.drop("__ly")


def offset_calibration(df: DataFrame, group: str, cal: DataFrame, y: str, p: str) -> DataFrame:
    """Prediction plus the group's mean error on its calibration rows (0 without any)."""
    off = cal.groupBy(group).agg(F.avg(F.col(y) - F.col(p)).alias("__o"))
    return df.join(off, group, "left").withColumn("corrected", F.col(p) + F.coalesce("__o", F.lit(0.0))).drop("__o")


def linear_calibration(df: DataFrame, group: str, cal: DataFrame, y: str, p: str) -> DataFrame:
    """Least-squares line per group fitted on its calibration rows."""
    fit = cal.groupBy(group).agg(F.regr_slope(y, p).alias("__b"), F.regr_intercept(y, p).alias("__a"))
    return df.join(fit, group, "left").withColumn("corrected", F.col("__a") + F.col("__b") * F.col(p)).drop("__a", "__b")


def local_only(df: DataFrame, group: str, m: int, draw, y: str, k: int = 25, min_rows: int = 5, *, id="id") -> DataFrame:
    """Rows outside the draw predicted from the m calibration rows of their own group only."""
    from terrasift.operators import knn, sampling

    d = df.withColumn("__ly", F.log1p(y))
    cal = sampling.per_group(d, [group], m, id, draw)
    sizes = cal.groupBy(group).agg(F.count(F.lit(1)).alias("__c")).filter(F.col("__c") >= min_rows)
    cal = cal.join(sizes.drop("__c"), group, "left_semi")
    rest = d.join(sizes.drop("__c"), group, "left_semi").join(cal.select(id), id, "left_anti")
    value = lambda arr: {"pred": F.expm1(knn.weighted_mean(arr, "__ly", knn.inverse(30.0)))}
    return knn.knn(rest, cal, k, cols=["__ly"], by=group, qid=id, rid=id, reduce=value).drop("__ly")


def calibration_curve(df: DataFrame, group: str, y: str, p: str, sizes=(0, 10, 20, 50, 100, 200, 500), draws=(0, 1, 2), linear_from: int = 50, min_group: int = 1, min_test: int = 20, *, id="id") -> DataFrame:
    """Overall and within-group R2 after offset or linear calibration with m rows per group, plus the all-rows offset.

    y and p are on the log scale; scores are on the original scale.
    """
    from terrasift.operators import metric, sampling
    from terrasift.operators.groups import size

    d = size(df, [group], "__g").filter(F.col("__g") >= min_group).drop("__g")
    runs = []
    for m in [*sizes, "all"]:
        for draw in [draws[0]] if m in (0, "all") else draws:
            if m == "all":
                test, cal = d, d
            elif m == 0:
                test, cal = d, d.filter("false")
            else:
                cal = sampling.per_group(d, [group], m, id, 1000 + draw)
                test = d.join(cal.select(id), id, "left_anti")
            ways = [("offset", offset_calibration)] + ([("linear", linear_calibration)] if isinstance(m, int) and m >= linear_from else [])
            for name, f in ways:
                t = f(test, group, cal, y, p)
                runs.append(t.select(F.lit(str(m)).alias("m"), F.lit(draw).alias("draw"), F.lit(name).alias("correction"), group, F.expm1(y).alias("__y"), F.expm1("corrected").alias("__p")))
    allr = runs[0]
    for r in runs[1:]:
        allr = allr.unionByName(r)
    keys = ["m", "draw", "correction"]
    over = allr.groupBy(*keys).agg(metric.r2("__y", "__p").alias("r2"), F.count(F.lit(1)).alias("n_test"))
    per = allr.groupBy(*keys, group).agg(metric.r2("__y", "__p").alias("r"), F.count(F.lit(1)).alias("c")).filter(F.col("c") >= min_test)
    return over.join(per.groupBy(*keys).agg(F.avg("r").alias("within_r2"), F.count(F.lit(1)).alias("groups")), keys, "left")
