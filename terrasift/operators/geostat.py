"""Variograms and nearby-pair statistics from folded locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.functions.geo import nowhere
from terrasift.operators import groups, nearby
from terrasift.operators.pyramid import binned, half_squares
from terrasift.operators.quantiles import weighted_medians
from terrasift.session import cut as stored

# lag edges in metres (fixed values)
LAGS = [30.0, 100.0, 250.0, 500.0, 1000.0, 2000.0, 5000.0, 10000.0, 20000.0, 50000.0, 100000.0, 200000.0, 400000.0]
FIT_LAGS_KM = [0.0, 0.25, 0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 12.0, 18.0, 25.0, 35.0, 45.0, 60.0]


def lag_table(df: DataFrame, v: str, edges, *, x: str = "x", y: str = "y", **kw) -> DataFrame:
    """Row pairs, mean distance and semivariance per half-open lag bin, over all pairs below the last edge."""
    loc = nearby.locations(df.filter(~nowhere(x, y)), [v], x=x, y=y, **kw)
    p = binned(loc, edges, [v], lag=True).select("bin", "pairs", "dist", F.col(f"g_{v}").alias("g"))
    if edges[0] <= 0:
        p = p.unionByName(_at_one(loc, v)).groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("pairs", "dist", "g")])
    return _means(p, [])


def lag_tables(df: DataFrame, v: str, edges, fold: str, without, *, x: str = "x", y: str = "y", **kw) -> DataFrame:
    """``lag_table`` once per number in ``without``, in ``left_out``, of the rows whose fold is another: all of them from one pass over the pairs."""
    at = df.filter(~nowhere(x, y)).withColumn("fold", F.coalesce(F.col(fold).cast("int"), F.lit(-2)))
    loc = nearby.locations(at, [v], ["fold"], x=x, y=y, **kw)
    p = binned(loc, edges, [v], lag=True, without=without).select("left_out", "bin", "pairs", "dist", F.col(f"g_{v}").alias("g"))
    if edges[0] <= 0:
        told = loc.withColumn("left_out", F.explode(F.array(*[F.lit(f) for f in without]))).filter("fold <> left_out")
        p = p.unionByName(_at_one(told, v, "left_out")).groupBy("left_out", "bin").agg(*[F.sum(c).alias(c) for c in ("pairs", "dist", "g")])
    return _means(p, ["left_out"])


def _at_one(loc: DataFrame, v: str, *more) -> DataFrame:
    """Sums over the pairs of rows within one row of ``loc``."""
    return loc.filter("n > 1").select(*more, F.lit(0).alias("bin"), F.expr("n * (n - 1) div 2").alias("pairs"), F.lit(0.0).alias("dist"), (F.col("n") * F.col(f"{v}__ss") / 2.0).alias("g"))


def _means(p: DataFrame, more) -> DataFrame:
    return p.select(*more, "bin", "pairs", (F.col("dist") / F.col("pairs")).alias("lag"), (F.col("g") / F.col("pairs")).alias("semivariance"))


def semivariogram(df: DataFrame, v: str, edges=LAGS, *, id="id", x="x", y="y") -> DataFrame:
    """Row pairs and semivariance per half-open distance bin, over all pairs; relative to the total variance."""
    p = binned(nearby.locations(df, [v], id=id, x=x, y=y), edges, [v]).select("bin", "pairs", (F.col(f"g_{v}") / F.col("pairs")).alias("semivariance"))
    out = p.crossJoin(F.broadcast(df.agg(F.var_samp(v).alias("__tv"))))  # one-row side
    mids = F.array(*[F.lit((a * b) ** 0.5 / 1000) for a, b in zip(edges, edges[1:])])
    return out.select("bin", F.get(mids, F.col("bin")).alias("dist_km"), "pairs", "semivariance", (F.col("semivariance") / F.col("__tv")).alias("relative"))


def reach(vg: DataFrame, level: float = 0.95) -> DataFrame:
    """Shortest distance at which the relative semivariance reaches the level."""
    return vg.agg(F.min(F.when(F.col("relative") >= level, F.col("dist_km"))).alias("reach_km"))


def fit_exponential(vg: DataFrame, total_var: float, min_pairs: int = 30, steps: int = 240) -> DataFrame:
    """c0 + c1 (1 - exp(-h / a)): for each range on a grid the two linear terms are closed-form weighted least squares.

    vg has one row per lag bin (lag in km). Weights are the pair counts; c0 >= 0 and c1 > 0 are kept; with too few
    bins the result is half the variance each at 15 km.
    """
    lo, hi = 0.3, 300.0
    grid = F.sequence(F.lit(0), F.lit(steps))
    t = vg.filter(F.col("pairs") >= min_pairs).withColumn("a", F.explode(F.transform(grid, lambda i: F.lit(lo) * F.pow(F.lit(hi / lo), i / float(steps)))))
    t = t.withColumns({"u": 1.0 - F.exp(-F.col("lag") / F.col("a")), "w": F.col("pairs").cast("double"), "g": F.col("semivariance")})
    s = {"w": "w", "u": "w*u", "uu": "w*u*u", "g": "w*g", "ug": "w*u*g", "gg": "w*g*g"}
    z = t.groupBy("a").agg(*[F.sum(F.expr(e)).alias(f"s_{n}") for n, e in s.items()], F.count(F.lit(1)).alias("bins")).filter("bins >= 3")
    det = "(s_w*s_uu - s_u*s_u)"
    z = z.withColumn("c1", F.expr(f"try_divide(s_w*s_ug - s_u*s_g, {det})")).withColumn("c0", F.expr("try_divide(s_g - c1*s_u, s_w)"))
    z = z.withColumn("c1", F.expr("case when c0 < 0 then try_divide(s_ug, s_uu) else c1 end")).withColumn("c0", F.expr("greatest(c0, 0D)"))
    z = z.withColumn("c1", F.greatest("c1", F.lit(1e-6)))
    z = z.withColumn("sse", F.expr("s_gg + c0*c0*s_w + c1*c1*s_uu - 2*c0*s_g - 2*c1*s_ug + 2*c0*c1*s_u"))
    best = z.agg(F.min_by(F.struct("c0", "c1", "a"), F.struct(F.round("sse", 9), "a")).alias("m"))
    return best.select(*[F.coalesce(f"m.{c}", F.lit(v)).alias(c) for c, v in (("c0", 0.5 * total_var), ("c1", 0.5 * total_var), ("a", 15.0))])


def nearby_pairs(df: DataFrame, values, region: str, bands, *, id="id", x="x", y="y") -> DataFrame:
    """Half squared difference of region z-scores (log1p) per distance band, pairs of one region only."""
    z = df.filter(F.col(region).isNotNull()).select(F.col(id).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"), region, *[F.log1p(v).alias(v) for v in values])
    z = groups.zscore(z, [region], values)
    zs = [f"{v}_z" for v in values]
    p = binned(nearby.locations(z, zs, [region]), bands, zs, [region])
    if bands[0] <= 0:  # rows of one position are at distance 0
        loc = nearby.locations(z, zs, [region]).filter("n > 1")
        own = loc.select(F.lit(0).alias("bin"), F.expr("n * (n - 1) div 2").alias("pairs"), *[(F.col("n") * F.col(f"{v}__ss") / 2.0).alias(f"g_{v}") for v in zs])
        p = p.unionByName(own).groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("pairs", *[f"g_{v}" for v in zs])])
    return p.select(F.col("bin").alias("band"), "pairs", *[(F.col(f"g_{v}_z") / F.col("pairs")).alias(v) for v in values])


def pair_difference(df: DataFrame, v: str, r: float, cut: float = 0.3, *, id="id", x="x", y="y") -> DataFrame:
    """Median absolute and relative difference of v over all pairs of rows within r, and the share above the cut.

    Rows of one position and value are folded to a count, so a pair of such spots stands for all its row pairs.
    """
    at = df.filter(~nowhere(x, y)).groupBy(F.col(x).alias("x"), F.col(y).alias("y"), F.col(v).alias("v")).agg(F.min(id).alias("id"), F.count(F.lit(1)).alias("n"))
    at = stored(at)
    p = nearby.pairs_of(at, r, ["v"]).select("v_a", "v_b", (F.col("n_a") * F.col("n_b")).alias("w"))
    own = at.filter("n > 1").select(F.col("v").alias("v_a"), F.col("v").alias("v_b"), F.expr("n * (n - 1) div 2").alias("w"))
    p = p.unionByName(own).unionByName(_of_one_position(at))
    a, b = F.col("v_a"), F.col("v_b")
    t = p.select("w", F.abs(a - b).alias("abs_diff"), F.try_divide(F.abs(a - b), (a + b) / 2.0).alias("rel_diff"))
    known = F.when(F.col("rel_diff").isNotNull(), F.col("w"))
    n = t.agg(F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("pairs"), F.try_divide(F.sum(F.when(F.col("rel_diff") > cut, F.col("w")).when(known.isNotNull(), 0)), F.sum(known)).alias("share_above"))
    return n.withColumns({f"{c}_p50": F.lit(m).cast("double") for c, m in weighted_medians(t, ["abs_diff", "rel_diff"], "w").items()})


def _of_one_position(at: DataFrame, side: int = 250) -> DataFrame:
    """(v_a, v_b, w): the pairs of different values at one position. A position with many is dealt over pairs of hashed blocks."""
    many = at.groupBy("x", "y").agg(F.ceil(F.count(F.lit(1)) / F.lit(side)).cast("int").alias("b"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    s = groups.same_keys(at, many, ["x", "y"]).withColumn("k", F.pmod(F.xxhash64("id"), F.col("b")).cast("int"))
    left = s.withColumns({"lo": F.col("k"), "hi": F.explode(F.sequence(F.col("k"), F.col("b") - 1))}).select("x", "y", "lo", "hi", F.col("v").alias("v_a"), F.col("n").alias("n_a"), F.col("id").alias("id_a"))
    right = s.withColumns({"hi": F.col("k"), "lo": F.explode(F.sequence(F.lit(0), F.col("k")))}).select("x", "y", "lo", "hi", F.col("v").alias("v_b"), F.col("n").alias("n_b"), F.col("id").alias("id_b"))
    j = left.join(right, ["x", "y", "lo", "hi"]).filter("lo < hi OR id_a < id_b")
    return j.select("v_a", "v_b", (F.col("n_a") * F.col("n_b")).alias("w"))
