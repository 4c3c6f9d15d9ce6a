"""Spatial projections and predicates."""

from pyspark.sql import functions as F

from terrasift.functions import clean, geo
from terrasift.operators import groups, intervals
from terrasift.sources.views import oracle, view

Q = QUERIES = {}
N = "CAST(count(*) AS BIGINT)"
X = "(lon*111320e0*cos(radians(lat)))"
Y = "(lat*110574e0)"


def blk(km, x=X, y=Y):
    return f"concat(CAST(floor({x}/{km}e3) AS BIGINT), '_', CAST(floor({y}/{km}e3) AS BIGINT))"


def c01(s, d):
    p = geo.xy(view(s, d, "points"))
    return p.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(geo.x_of("lon", "lat", "km"), 6).alias("x_km"))


Q["c01_local_metres"] = (c01, oracle(f"SELECT id, round({X}, 3) AS x, round({Y}, 3) AS y, round({X}/1e3, 6) AS x_km FROM points", "points"))


def c02(s, d):
    p = view(s, d, "points").select("id", geo.to_wkb("lon", "lat").alias("geometry"))
    return p.select("id", geo.wkb_xy("geometry").alias("g")).select("id", "g.lon", "g.lat")


Q["c02_wkb_decode"] = (c02, oracle("SELECT id, lon, lat FROM points", "points"))


def c03(s, d):
    r = view(s, d, "raw").withColumn("lon", F.when(F.col("event_id") % 113 == 0, F.lit(float("nan"))).otherwise(F.col("lon")))
    lon = clean.not_nan(F.col("lon"))
    return r.agg(F.count("*").alias("n"), F.count_if(F.isnan("lon")).alias("nan_lon"), F.round(F.min(lon), 6).alias("lon_lo"), F.round(F.max(lon), 6).alias("lon_hi"),
                 F.round(F.min("lat"), 6).alias("lat_lo"), F.round(F.max("lat"), 6).alias("lat_hi"), F.count_if(~clean.in_bbox("lon", "lat", geo.STATE_BOX)).alias("outside"))


Q["c03_geometry_profile"] = (c03, oracle(f"""SELECT {N} AS n, CAST(count(*) FILTER (event_id % 113 = 0) AS BIGINT) AS nan_lon, round(min(lon) FILTER (event_id % 113 <> 0), 6) AS lon_lo,
 round(max(lon) FILTER (event_id % 113 <> 0), 6) AS lon_hi, round(min(lat), 6) AS lat_lo, round(max(lat), 6) AS lat_hi,
 CAST(count(*) FILTER (NOT (event_id % 113 <> 0 AND lon BETWEEN 72.6e0 AND 80.9e0 AND lat BETWEEN 15.6e0 AND 22.1e0)) AS BIGINT) AS outside FROM raw""", "raw"))


def c04(s, d):
    p = geo.xy(view(s, d, "points"))
    return p.select("id", *[geo.block("x", "y", km).alias(f"b{km}") for km in (10, 25, 50, 100)])


Q["c04_square_blocks"] = (c04, oracle("SELECT id, " + ", ".join(f"{blk(km)} AS b{km}" for km in (10, 25, 50, 100)) + " FROM points", "points"))


def c05(s, d):
    p = groups.centroid(geo.xy(view(s, d, "points")), ["spot"])
    return p.select("id", geo.block("cx", "cy", 10).alias("b"))


Q["c05_f07_block_by_site_centroid"] = (c05, oracle(f"SELECT id, {blk(10, 'cx', 'cy')} AS b FROM (SELECT id, avg({X}) OVER (PARTITION BY spot) AS cx, avg({Y}) OVER (PARTITION BY spot) AS cy FROM points)", "points"))


def c06(s, d):
    p = geo.xy(view(s, d, "points")).withColumn("b", geo.block("x", "y", 50))
    return groups.label(p, "b").select("id", "label")


Q["c06_dense_label"] = (c06, oracle(f"SELECT id, CAST(dense_rank() OVER (ORDER BY {blk(50)}) - 1 AS BIGINT) AS label FROM points", "points"))


def c07(s, d):
    p = geo.xy(view(s, d, "points")).withColumn("ring", geo.window_ring("x", "y"))
    return p.select("id", F.size("ring").alias("corners"), F.round(F.col("ring")[0]["x"], 3).alias("x0"), F.round(F.col("ring")[2]["y"], 3).alias("y2"))


Q["c07_window_ring"] = (c07, oracle(f"SELECT id, 5 AS corners, round(floor({X}/10)*10 + 5 - 15, 3) AS x0, round(floor({Y}/10)*10 + 5 + 15, 3) AS y2 FROM points", "points"))


def c08(s, d):
    return view(s, d, "points").groupBy(geo.tile_key("lon", "lat").alias("t")).agg(F.count("*").alias("n"))


_Z = "(floor((lon + 180)/6) + 1)"
Q["c08_tile_key"] = (c08, oracle(f"SELECT concat(CAST({_Z} AS BIGINT), '_', CAST(floor((5e5 + (lon - ({_Z}*6 - 183))*111320e0*cos(radians(lat)))/1e5) AS BIGINT), '_', CAST(floor({Y}/1e5) AS BIGINT)) AS t, {N} AS n FROM points GROUP BY 1", "points"))

# corners of the footprint around a scene centre, in degrees
CORNERS = [(-2.0, -1.0), (1.0, -2.0), (2.0, 1.0), (0.0, 2.0), (-2.0, 1.0)]


def footprint(cx="cx", cy="cy"):
    return F.array(*[F.struct((F.col(cx) + a).alias("x"), (F.col(cy) + b).alias("y")) for a, b in CORNERS + CORNERS[:1]])


def contains_sql(px="lon", py="lat", cx="cx", cy="cy"):
    ring = CORNERS + CORNERS[:1]
    parts = []
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if ay == by:
            continue
        ax_, ay_, bx_, by_ = f"({cx} + ({ax}e0))", f"({cy} + ({ay}e0))", f"({cx} + ({bx}e0))", f"({cy} + ({by}e0))"
        parts.append(f"CAST(({ay_} > {py}) <> ({by_} > {py}) AND {px} < ({bx_} - {ax_})*({py} - {ay_})/nullif({by_} - {ay_}, 0) + {ax_} AS INTEGER)")
    return "((" + " + ".join(parts) + ") % 2 = 1)"


def c09(s, d):
    sc = view(s, d, "scenes").withColumn("ring", footprint())
    return sc.select("scene_id", geo.ring_contains(F.col("ring"), F.lit(76.5), F.lit(18.5)).alias("inside"))


Q["c09_point_in_polygon"] = (c09, oracle(f"SELECT scene_id, {contains_sql('76.5e0', '18.5e0')} AS inside FROM scenes", "scenes"))


def c10(s, d):
    e = intervals.tile_extent(view(s, d, "points"), "tile", "ts", 3)
    return e.select("tile", *[F.round(c, 6).alias(c) for c in ("lon_lo", "lat_lo", "lon_hi", "lat_hi")], F.date_format("day_lo", "yyyy-MM-dd").alias("day_lo"), F.date_format("day_hi", "yyyy-MM-dd").alias("day_hi"))


Q["c10_tile_extent"] = (c10, oracle("""SELECT tile, round(min(lon), 6) AS lon_lo, round(min(lat), 6) AS lat_lo, round(max(lon), 6) AS lon_hi, round(max(lat), 6) AS lat_hi,
 strftime(CAST(min(ts) AS DATE) - 3, '%Y-%m-%d') AS day_lo, strftime(CAST(max(ts) AS DATE) + 3, '%Y-%m-%d') AS day_hi FROM points GROUP BY 1""", "points"))


def c11(s, d):
    return view(s, d, "raw").groupBy(geo.coord_key().alias("key")).agg(F.count("*").alias("n"))


Q["c11_coordinate_key"] = (c11, oracle(f"SELECT concat(CAST(round(lon*1e6) AS BIGINT), '_', CAST(round(lat*1e6) AS BIGINT)) AS key, {N} AS n FROM raw GROUP BY 1", "raw"))


def c12(s, d):
    return view(s, d, "points").groupBy(geo.nearest_node("lon", 72.6, 0.25).alias("i"), geo.nearest_node("lat", 15.6, 0.25).alias("j")).agg(F.count("*").alias("n"))


Q["c12_nearest_grid_node"] = (c12, oracle(f"SELECT CAST(floor((lon - 72.6e0)/25e-2 + 5e-1) AS BIGINT) AS i, CAST(floor((lat - 15.6e0)/25e-2 + 5e-1) AS BIGINT) AS j, {N} AS n FROM points GROUP BY 1, 2", "points"))


def c13(s, d):
    return view(s, d, "points").groupBy(geo.pixel_index("lon", 73.0, 0.083, 90).alias("i"), geo.pixel_index("lat", 15.7, 0.065, 95).alias("j")).agg(F.count("*").alias("n"))


Q["c13_pixel_index"] = (c13, oracle(f"SELECT CAST(greatest(0, least(89, floor((lon - 73e0)/83e-3))) AS BIGINT) AS i, CAST(greatest(0, least(94, floor((lat - 157e-1)/65e-3))) AS BIGINT) AS j, {N} AS n FROM points GROUP BY 1, 2", "points"))
