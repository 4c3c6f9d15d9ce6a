"""Time-interval, footprint and box joins: each range predicate gets an equality key first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.functions import geo
from terrasift.operators import groups


def tile_extent(df: DataFrame, tile: str, ts: str, days: int, lon="lon", lat="lat") -> DataFrame:
    """Per tile: bounding box and date span widened by the window."""
    return df.groupBy(tile).agg(
        F.min(lon).alias("lon_lo"), F.min(lat).alias("lat_lo"), F.max(lon).alias("lon_hi"), F.max(lat).alias("lat_hi"),
        F.date_sub(F.to_date(F.min(ts)), days).alias("day_lo"), F.date_add(F.to_date(F.max(ts)), days).alias("day_hi"))


def within_days(samples: DataFrame, scenes: DataFrame, tile: str, days: int, sample_ts="ts", scene_ts="scene_ts") -> DataFrame:
    """Pairs on the same tile whose dates differ by at most ``days``; adds date_difference_days (scene - sample).

    Scenes are repeated once per day of the window and joined on (tile, day): a hot tile spreads over its days, and
    only the scene side grows, by 2 * days + 1.
    """
    b = scenes.withColumn("__d", F.to_date(scene_ts)).withColumn("__day", F.explode(F.sequence(F.date_sub("__d", days), F.date_add("__d", days))))
    a = samples.withColumn("__day", F.to_date(sample_ts))
    return a.join(b, [tile, "__day"]).withColumn("date_difference_days", F.datediff("__d", "__day")).drop("__d", "__day")


def in_footprint(pairs: DataFrame, ring: Column, lon="lon", lat="lat") -> DataFrame:
    """Pairs whose position lies in the footprint; the box test runs before ray casting."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    px, py = F.col(lon), F.col(lat)
    box = px.between(F.array_min(xs), F.array_max(xs)) & py.between(F.array_min(ys), F.array_max(ys))
    return pairs.filter(F.when(box, geo.ring_contains(ring, px, py)).otherwise(False))


def rank_scenes(diff="date_difference_days", cloud="cloud", scene="scene_id") -> list[Column]:
    """Order of scenes for a sample: closest date, least cloud, then scene id."""
    return [F.abs(F.col(diff)).asc(), F.col(cloud).asc(), F.col(scene).asc()]


def nearest_in_time(samples, scenes, tile, days, keys=("id",), sample_ts="ts", scene_ts="scene_ts", cloud="cloud", scene="scene_id") -> DataFrame:
    """Closest scene within the window per sample, ties by cloud then id; a map-side reducible aggregate, no sort."""
    pairs = within_days(samples, scenes, tile, days, sample_ts, scene_ts)
    best = F.struct(F.abs("date_difference_days").alias("gap"), F.col(cloud), F.col(scene), F.col("date_difference_days"))
    return pairs.groupBy(*keys).agg(F.min(best).alias("b")).select(*keys, f"b.{scene}", f"b.{cloud}", "b.date_difference_days")


def in_box(points: DataFrame, boxes: DataFrame, *, lon="lon", lat="lat", lo=("lon_lo", "lat_lo"), hi=("lon_hi", "lat_hi"), unit: float = 1 / 64) -> DataFrame:
    """Points in half-open boxes. Each box is put on the level of its own size, where it covers at most four cells."""
    span = F.greatest(F.col(hi[0]) - F.col(lo[0]), F.col(hi[1]) - F.col(lo[1]), F.lit(unit))
    lv = F.ceil(F.log2(span / unit)).cast("int")
    b = boxes.withColumn("__lv", lv).withColumn("__s", F.pow(F.lit(2.0), F.col("__lv")) * unit)

    def cells(a, z):
        return F.explode(F.sequence(F.floor(F.col(a) / F.col("__s")), F.floor(F.col(z) / F.col("__s"))))

    b = b.withColumn("__cx", cells(lo[0], hi[0])).withColumn("__cy", cells(lo[1], hi[1]))
    levels = [r[0] for r in b.select("__lv").distinct().collect()]  # a few dozen at most: log2 of the size range
    if not levels:
        return points.join(boxes, F.lit(False))
    p = points.withColumn("__lv", F.explode(F.array(*[F.lit(v) for v in levels]))).withColumn("__s", F.pow(F.lit(2.0), F.col("__lv")) * unit)
    p = p.withColumns({"__cx": F.floor(F.col(lon) / F.col("__s")), "__cy": F.floor(F.col(lat) / F.col("__s"))}).drop("__s")
    j = p.join(b.drop("__s"), ["__lv", "__cx", "__cy"])
    inside = (F.col(lon) >= F.col(lo[0])) & (F.col(lon) < F.col(hi[0])) & (F.col(lat) >= F.col(lo[1])) & (F.col(lat) < F.col(hi[1]))
    return j.filter(inside).drop("__lv", "__cx", "__cy")
