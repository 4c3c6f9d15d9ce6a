"""From cleaned records to independent locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.functions import clean, feat, geo
from terrasift.operators import cluster, groups

SOIL = ("n", "p", "k", "oc", "ph", "ec")


def state_locations(df: DataFrame, bands=(), radius: float = 30.0, most: int = 10, values=SOIL, tile: str | None = None) -> DataFrame:
    """Limits, 30 m sites, placeholders dropped, members merged by median, indices recomputed, close leftovers removed."""
    ok = df.filter(clean.within_limits(clean.LIMITS) & clean.within_limits(clean.TIGHTENED))
    s = cluster.sites(geo.xy(ok), radius)
    m = cluster.merge(cluster.drop_large(s, most=most), ["lon", "lat", *values, *bands], firsts=[tile] if tile else [])
    if bands:
        m = feat.indices(m).filter(clean.finite(*feat.INDEX_NAMES))
    return cluster.drop_close(geo.xy(m), radius)


def national_locations(raw: DataFrame, radius: float = 30.0, most: int = 10, values=SOIL) -> tuple[DataFrame, DataFrame]:
    """(locations, repeated records set aside) from text records, undated rows kept."""
    num = raw.withColumns({c: clean.to_number(c) for c in values})
    num = num.withColumn("date", clean.year_guard(clean.to_date("date"), 2014, 2025))
    ok = num.filter(clean.in_bbox("lon", "lat", geo.NATIONAL_BOX) & clean.within_limits({c: clean.NATIONAL_LIMITS[c] for c in values}))
    kept, aside = groups.repeated_points(ok, ["lon", "lat"], values, ["id"])
    s = cluster.drop_large(cluster.sites(geo.xy(kept), radius), most=most)
    m = cluster.merge(s, ["lon", "lat", *values], modes=["sid", "did"], lists=["cycle"], date="date")
    return cluster.drop_close(geo.xy(m), radius).withColumn("has_date", F.col("date").isNotNull()), aside
