"""Per-point features from dated series: climate normals, vegetation seasons, radar, land cover, burns, composites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.functions import clean, feat
from terrasift.operators import groups
from terrasift.operators.quantiles import medians, quantiles

GREEN = 0.4
FLOOD_DB = -18.0


def climate_normals(df: DataFrame, keys, sums=("ppt",), means=("tmax", "tmin"), ts="dt", years=None) -> DataFrame:
    """Annual totals (monthly mean x 12), means, the June-September total (x 4) and the mean temperature."""
    if years:
        df = df.filter(F.year(ts).between(*years))
    aggs = [(F.avg(c) * 12).alias(f"{c}_annual") for c in sums] + [F.avg(c).alias(f"{c}_mean") for c in means]
    aggs += [(F.avg(F.when(F.month(ts).between(6, 9), F.col(c))) * 4).alias(f"{c}_monsoon") for c in sums[:1]]
    out = df.groupBy(*keys).agg(*aggs)
    return out.withColumn("tmean", (F.col(f"{means[0]}_mean") + F.col(f"{means[1]}_mean")) / 2) if len(means) > 1 else out


def season_table(df: DataFrame, key="id", ts="dt", v="ndvi") -> DataFrame:
    """Per point and agricultural year: season maxima and annual max, min, mean. One shuffle."""
    s = df.withColumns({"agyear": feat.ag_year(F.col(ts)), "__s": feat.season(F.col(ts))})
    mx = [F.max(F.when(F.col("__s") == n, F.col(v))).alias(n) for n in ("kharif", "rabi", "zaid")]
    return s.groupBy(key, "agyear").agg(*mx, F.max(v).alias("hi"), F.min(v).alias("lo"), F.avg(v).alias("mean"))


def vegetation(df: DataFrame, key="id", ts="dt", v="ndvi") -> DataFrame:
    """Season maxima, green frequency, seasons green per year, green outside the monsoon, amplitude, mean, yearly sd.

    Shares are over the years with a value in the season; the two counts are over years with any season value.
    """
    y = season_table(df, key, ts, v)
    any_season = F.coalesce("kharif", "rabi", "zaid").isNotNull()
    aggs = []
    for s in ("kharif", "rabi", "zaid"):
        aggs += [F.avg(s).alias(f"ndvi_{s}_max"), F.avg(F.when(F.col(s).isNotNull(), (F.col(s) > GREEN).cast("double"))).alias(f"green_{s}_freq")]
    green = sum((clean.known(F.col(s) > GREEN).cast("double") for s in ("kharif", "rabi", "zaid")), F.lit(0.0))
    dry = clean.known(F.col("rabi") > GREEN) | clean.known(F.col("zaid") > GREEN)
    aggs += [F.avg(F.when(any_season, green)).alias("n_seasons_green"), F.avg(F.when(any_season, dry.cast("double"))).alias("irrig_proxy"),
             F.avg(F.col("hi") - F.col("lo")).alias("ndvi_amp"), F.avg("mean").alias("ndvi_mean"), F.stddev_samp("mean").alias("ndvi_interannual_sd")]
    return y.groupBy(key).agg(*aggs)


def radar(df: DataFrame, key="id", season="season", seasons=("kharif", "dry")) -> DataFrame:
    """Medians, sd, minimum and flood frequency per point and season, wide, from vv and vh in dB."""
    ok = df.filter(F.col("vv").isNotNull() & F.col("vh").isNotNull())
    base = ok.groupBy(key, season).agg(F.stddev_samp("vh").alias("vh_sd"), F.min("vv").alias("vv_min"), F.avg((F.col("vv") < FLOOD_DB).cast("double")).alias("flood_freq"))
    m = medians(ok, [key, season], ["vv", "vh"]).withColumnsRenamed({"vv": "vv_med", "vh": "vh_med"})
    j = base.join(m, [key, season])
    stats = ["vv_med", "vh_med", "vh_sd", "vv_min", "flood_freq"]
    wide = j.groupBy(key).agg(*[F.max(F.when(F.col(season) == s, F.col(c))).alias(f"s1_{c}_{s}") for c in stats for s in seasons])
    return wide.withColumn("s1_vh_change", F.col(f"s1_vh_med_{seasons[0]}") - F.col(f"s1_vh_med_{seasons[1]}"))


def landcover_years(df: DataFrame, key="id", year="year", cls="cls", codes=None) -> DataFrame:
    """Years per class, years seen, and year-to-year changes; one row per (point, year) expected.

    Only consecutive years are compared, so a missing year counts as no change.
    """
    from pyspark.sql import Window

    codes = codes or {}
    w = Window.partitionBy(key).orderBy(year)  # years of one point: bounded by the calendar
    changed = (F.lag(cls).over(w) != F.col(cls)) & (F.lag(year).over(w) == F.col(year) - 1)
    d = df.withColumn("__chg", clean.known(changed).cast("int"))
    aggs = [F.count_if(F.col(cls) == code).alias(f"{n}_years") for n, code in codes.items()]
    return d.groupBy(key).agg(*aggs, F.count(cls).alias("n_years"), F.sum("__chg").alias("changes"))


def burn_months(df: DataFrame, points: DataFrame, key="id", at="b", near="b3") -> DataFrame:
    """Months burnt at the point and around it, 0 where never seen."""
    s = df.groupBy(key).agg(F.sum(at).alias("burn_months"), F.sum(near).alias("burn_months_near"))
    return points.select(key).join(s, key, "left").na.fill(0, ["burn_months", "burn_months_near"])


def composite(obs: DataFrame, bands, key="id", scene="scene_id", min_dates: int = 3) -> DataFrame:
    """Multi-date composite: strict windows, physical reflectance, median per band, sd of NDVI and BSI, at least min_dates.

    Of several rows of one point and scene the first in the order of its values counts. A point has as many dates as there
    are scenes over it, so its medians are taken in the same aggregate as the deviations: one pass.
    """
    o = groups.first(obs.filter(clean.strict_bare()), [key, scene], [F.col(b) for b in bands])
    o = feat.reflectance(o, bands).filter(clean.valid_reflectance(bands))
    o = feat.indices(o).filter(clean.finite(*feat.INDEX_NAMES))
    sd = [F.stddev_samp("NDVI").alias("c_std_NDVI"), F.stddev_samp("BSI").alias("c_std_BSI"), F.count(F.lit(1)).alias("c_n_dates")]
    out = o.groupBy(key).agg(*[F.median(b).alias(f"c_{b}") for b in bands], *sd).filter(F.col("c_n_dates") >= min_dates)
    return feat.indices(out, prefix="c_")


def window_stats(px: DataFrame, keys, v="value", cls="cls") -> DataFrame:
    """Statistics of one window of pixels: median, count, min, max and majority class. A window has a few pixels."""
    return px.groupBy(*keys).agg(F.median(v).alias("median"), F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.mode(cls, True).alias("major"))
