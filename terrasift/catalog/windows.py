"""Values attached per row, ranked rows, focal windows, top-k and sampling."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrasift.catalog.aggregates import rnd
from terrasift.catalog.joining import PAIRS, pairs
from terrasift.catalog.places import N
from terrasift.functions import feat
from terrasift.operators import grid, groups, intervals, sampling, tops
from terrasift.plans import jobs
from terrasift.sources.views import oracle, view

Q = QUERIES = {}

Q["f01_group_size_on_rows"] = (lambda s, d: groups.size(view(s, d, "raw").select("event_id", "lon", "lat"), ["lon", "lat"]).select("event_id", "n_at"),
                               oracle("SELECT event_id, CAST(count(*) OVER (PARTITION BY lon, lat) AS BIGINT) AS n_at FROM raw", "raw"))


def f02(s, d):
    w = Window.partitionBy("id").orderBy(*intervals.rank_scenes())
    return pairs(s, d).select("id", "scene_id", (F.row_number().over(w) - 1).alias("rank"))


_ORD = "ORDER BY abs(date_difference_days), cloud, scene_id"
Q["f02_scene_rank"] = (f02, oracle(f"SELECT id, scene_id, CAST(row_number() OVER (PARTITION BY id {_ORD}) - 1 AS INTEGER) AS rank FROM {PAIRS}", "points", "scenes"))
Q["f03_best_scene"] = (lambda s, d: groups.first(pairs(s, d), ["id"], intervals.rank_scenes()).select("id", "scene_id"),
                       oracle(f"SELECT id, scene_id FROM (SELECT *, row_number() OVER (PARTITION BY id {_ORD}) AS rn FROM {PAIRS}) WHERE rn = 1", "points", "scenes"))
Q["f04_up_to_n_scenes"] = (lambda s, d: groups.head(pairs(s, d), ["id"], [F.col("cloud"), F.col("scene_ts").desc(), F.col("scene_id")], 3).select("id", "scene_id", "rn"),
                           oracle(f"SELECT id, scene_id, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cloud, scene_ts DESC, scene_id) AS rn FROM {PAIRS}) WHERE rn <= 3", "points", "scenes"))
Q["f05_group_deviation"] = (lambda s, d: rnd(groups.demean(view(s, d, "points").select("id", "did", "n"), ["did"], ["n"]).select("id", "n_dev"), ["n_dev"]),
                            oracle("SELECT id, round(n - avg(n) OVER (PARTITION BY did), 6) + 0e0 AS n_dev FROM points", "points"))
Q["f06_z_score_in_region"] = (lambda s, d: rnd(groups.zscore(view(s, d, "points").select("id", "region", "n", "p"), ["region"], ["n", "p"]).select("id", "n_z", "p_z"), ["n_z", "p_z"]),
                              oracle("SELECT id, round((n - avg(n) OVER w)/stddev_samp(n) OVER w, 6) AS n_z, round((p - avg(p) OVER w)/stddev_samp(p) OVER w, 6) AS p_z FROM points WINDOW w AS (PARTITION BY region)", "points"))


def f07(s, d):
    return rnd(groups.centroid(view(s, d, "points").select("id", "spot", F.col("lon").alias("x"), F.col("lat").alias("y")), ["spot"]).select("id", "cx", "cy"), ["cx", "cy"], 9)


Q["f07_site_centroid"] = (f07, oracle("SELECT id, round(avg(lon) OVER (PARTITION BY spot), 9) AS cx, round(avg(lat) OVER (PARTITION BY spot), 9) AS cy FROM points", "points"))


def f08(s, d):
    r = view(s, d, "repeated").select("l_partkey", "l_suppkey", "l_orderkey", "n", "p", "k")
    return groups.max_nunique(r, ["l_partkey", "l_suppkey"], ["n", "p", "k"]).groupBy("n_var").agg(F.count("*").alias("rows"))


Q["f08_max_distinct_values"] = (f08, oracle(f"SELECT n_var, CAST(sum(c) AS BIGINT) AS rows FROM (SELECT CAST(greatest(count(DISTINCT n), count(DISTINCT p), count(DISTINCT k)) AS BIGINT) AS n_var, count(*) AS c FROM repeated GROUP BY l_partkey, l_suppkey) GROUP BY 1", "repeated"))
Q["f10_share_of_group_total"] = (lambda s, d: rnd(groups.share(view(s, d, "points").select("id", "did", "n"), ["did"], "n").select("id", "share"), ["share"], 9),
                                 oracle("SELECT id, round(n/sum(n) OVER (PARTITION BY did), 9) AS share FROM points", "points"))

# ---- focal windows: the oracle joins each pixel with its window, coordinates clipped to the tile
_G = "g AS (SELECT tile, r, col, value, cls FROM grid), e AS (SELECT tile, max(r) AS mr, max(col) AS mc FROM g GROUP BY 1)"


def focal_sql(w, cols):
    k = w // 2
    return f"""WITH {_G}, p AS MATERIALIZED (SELECT a.tile, a.r, a.col, a.value, greatest(0, least(mr, a.r + di)) AS rr, greatest(0, least(mc, a.col + dj)) AS cc
 FROM g a JOIN e ON a.tile = e.tile, range(-{k}, {k + 1}) i(di), range(-{k}, {k + 1}) j(dj))
 SELECT a.tile, a.r, a.col, {cols} FROM p a JOIN g b ON b.tile = a.tile AND b.r = a.rr AND b.col = a.cc GROUP BY 1, 2, 3"""


K3 = ["tile", "r", "col"]
Q["f13_focal_mean"] = (lambda s, d: rnd(grid.focal_mean(view(s, d, "grid"), 5).select(*K3, "focal_mean"), ["focal_mean"]), oracle(focal_sql(5, "round(avg(b.value), 6) AS focal_mean"), "grid"))
Q["f14_focal_sd"] = (lambda s, d: rnd(grid.focal_sd(view(s, d, "grid"), 3).select(*K3, "focal_sd"), ["focal_sd"], 4), oracle(focal_sql(3, "round(stddev_pop(b.value), 4) AS focal_sd"), "grid"))


def f15(s, d):
    g = grid.focal_minmax(view(s, d, "grid"), 7)
    rel = (F.col("value") - F.col("focal_min")) / F.greatest(F.col("focal_max") - F.col("focal_min"), F.lit(1.0))
    return g.select(*K3, "focal_min", "focal_max", F.round(rel, 6).alias("relpos"))


Q["f15_focal_min_max"] = (f15, oracle(focal_sql(7, "min(b.value) AS focal_min, max(b.value) AS focal_max, round((any_value(a.value) - min(b.value))/greatest(max(b.value) - min(b.value), 1e0), 6) AS relpos"), "grid"))


def f16(s, d):
    return rnd(grid.slope(view(s, d, "grid"), 90.0, 92.0).select(*K3, "gx", "gy", "slope"), ["gx", "gy", "slope"])


def _grad(axis, step):
    w = f"(PARTITION BY tile, {'r' if axis == 'col' else 'col'} ORDER BY {axis})"
    up, dn = f"lead(value) OVER {w}", f"lag(value) OVER {w}"
    return f"CASE WHEN {up} IS NULL AND {dn} IS NULL THEN 0e0 WHEN {dn} IS NULL THEN {up} - value WHEN {up} IS NULL THEN value - {dn} ELSE ({up} - {dn})/2 END/{step}e0"


Q["f16_slope"] = (f16, oracle(f"SELECT tile, r, col, round(gx, 6) + 0e0 AS gx, round(gy, 6) + 0e0 AS gy, round(degrees(atan(sqrt(gx*gx + gy*gy))), 6) AS slope FROM (SELECT tile, r, col, {_grad('col', 90)} AS gx, {_grad('r', 92)} AS gy FROM grid)", "grid"))


def f16b(s, d):
    return rnd(grid.curvature(view(s, d, "grid"), 90.0, 92.0).select(*K3, "curv_profile", "curv_plan"), ["curv_profile", "curv_plan"], 5)


def _grad2(v, axis, step):
    return _grad(axis, step).replace("value", v)


Q["f16_curvature"] = (f16b, oracle(f"""WITH a AS (SELECT tile, r, col, {_grad('col', 90)} AS gx, {_grad('r', 92)} AS gy FROM grid),
 b AS (SELECT *, {_grad2('gx', 'col', 90)} AS xx, {_grad2('gy', 'col', 90)} AS xy, {_grad2('gy', 'r', 92)} AS yy FROM a)
 SELECT tile, r, col, round(-(xx*gx*gx + 2*xy*gx*gy + yy*gy*gy)/(gx*gx + gy*gy + 1e-12), 5) + 0e0 AS curv_profile, round(-(xx*gy*gy - 2*xy*gx*gy + yy*gx*gx)/(gx*gx + gy*gy + 1e-12), 5) + 0e0 AS curv_plan FROM b""", "grid"))
Q["f17_neighbourhood_any"] = (lambda s, d: grid.focal_any(view(s, d, "grid").withColumn("burnt", F.col("cls") == 3), 3, "burnt").select(*K3, "any_near"),
                              oracle(focal_sql(3, "max(CAST(b.cls = 3 AS INTEGER)) AS any_near"), "grid"))


def terrain(s, d):
    t = grid.terrain(view(s, d, "grid"), 90.0, 92.0)
    cols = ["slope", "tpi_5", "tpi_17", "tpi_33", "rough", "relpos"]
    return rnd(t.select(*K3, *cols), cols, 4)


_W = {n: f"(PARTITION BY tile, {o} ORDER BY {a} ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)" for n, o, a, k in (("h33", "r", "col", 33), ("v33", "col", "r", 33))}
Q["f13_f16_terrain_features"] = (terrain, oracle(f"""WITH {_G}, m AS (SELECT tile, r, col, min(lo) OVER {_W['v33']} AS lo, max(hi) OVER {_W['v33']} AS hi FROM (SELECT tile, r, col, min(value) OVER {_W['h33']} AS lo, max(value) OVER {_W['h33']} AS hi FROM g)),
 pad AS (SELECT e.tile, y.i AS y, x.i AS x, b.value FROM e, range(-16, 116) y(i), range(-16, 116) x(i), g b WHERE y.i <= mr + 16 AND x.i <= mc + 16 AND b.tile = e.tile AND b.r = greatest(0, least(mr, y.i)) AND b.col = greatest(0, least(mc, x.i))),
 hz AS (SELECT tile, y, x, value, {', '.join(f"sum(value) OVER (PARTITION BY tile, y ORDER BY x ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING) AS s{w}" for w in (3, 5, 17, 33))}, sum(value*value) OVER (PARTITION BY tile, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS q3 FROM pad),
 vt AS (SELECT tile, y, x, {', '.join(f"sum(s{w}) OVER (PARTITION BY tile, x ORDER BY y ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING)/{w * w}e0 AS m{w}" for w in (3, 5, 17, 33))}, sum(q3) OVER (PARTITION BY tile, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)/9e0 AS mq FROM hz),
 sl AS (SELECT tile, r, col, value, degrees(atan(sqrt(gx*gx + gy*gy))) AS slope FROM (SELECT tile, r, col, value, {_grad('col', 90)} AS gx, {_grad('r', 92)} AS gy FROM g))
 SELECT sl.tile, sl.r, sl.col, round(slope, 4) AS slope, round(value - m5, 4) + 0e0 AS tpi_5, round(value - m17, 4) + 0e0 AS tpi_17, round(value - m33, 4) + 0e0 AS tpi_33, round(sqrt(greatest(mq - m3*m3, 0)), 4) AS rough,
 round((value - lo)/greatest(hi - lo, 1e0), 4) AS relpos FROM sl JOIN m ON m.tile = sl.tile AND m.r = sl.r AND m.col = sl.col JOIN vt ON vt.tile = sl.tile AND vt.y = sl.r AND vt.x = sl.col""", "grid"))

# ---- sorts, top-k, samples
Q["g01_stable_multi_key_sort"] = (lambda s, d: view(s, d, "scenes").orderBy("tile", "cloud", F.desc("scene_ts"), "scene_id").select("scene_id", "tile", "cloud"), oracle("SELECT scene_id, tile, cloud FROM scenes", "scenes"))
Q["g02_extreme_values"] = (lambda s, d: tops.extremes(view(s, d, "points"), "n", 5, "id"), oracle(
    'SELECT * FROM (SELECT \'top\' AS "end", id, n FROM points ORDER BY n DESC, id LIMIT 5) UNION ALL SELECT * FROM (SELECT \'bottom\', id, n FROM points ORDER BY n, id LIMIT 5)', "points"))
Q["g03_largest_groups"] = (lambda s, d: tops.top_groups(view(s, d, "points"), ["did", "event_type"], 8), oracle(f"SELECT did, event_type, {N} AS n FROM points GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 8", "points"))


def g04(s, d):
    per = view(s, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("v"))
    return groups.head(per, ["l_returnflag"], [F.desc("v"), F.col("l_suppkey")], 8)


Q["g04_top_inputs_per_target"] = (g04, "SELECT l_returnflag, l_suppkey, v, CAST(rn AS INTEGER) AS rn FROM (SELECT l_returnflag, l_suppkey, round(sum(l_quantity), 2) AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY round(sum(l_quantity), 2) DESC, l_suppkey) AS rn FROM lineitem GROUP BY 1, 2) WHERE rn <= 8")
Q["g05_seeded_sample"] = (lambda s, d: sampling.sample_n(view(s, d, "points"), 500, "id", 42).select("id", "n"), oracle("SELECT id, n FROM points ORDER BY md5(concat(id, ':42')), id LIMIT 500", "points"))


def g06(s, d):
    from terrasift.functions import geo

    p = geo.xy(view(s, d, "points")).withColumn("block", geo.block("x", "y", 25))
    return sampling.sample_keys(p, "block", 40, 42, 5)


Q["g06_seeded_block_sample"] = (g06, oracle(f"""SELECT block, {N} AS rows FROM (SELECT concat(CAST(floor(lon*111320e0*cos(radians(lat))/25e3) AS BIGINT), '_', CAST(floor(lat*110574e0/25e3) AS BIGINT)) AS block FROM points)
 GROUP BY 1 HAVING count(*) >= 5 ORDER BY md5(concat(block, ':42')), block LIMIT 40""", "points"))
Q["g07_capped_training_sample"] = (lambda s, d: sampling.sample_n(view(s, d, "points").filter("region <> 3"), 4000, "id", 7).groupBy("region").agg(F.count("*").alias("n"), F.round(F.sum("n"), 3).alias("total")),
                                   oracle(f"SELECT region, {N} AS n, round(sum(n), 3) AS total FROM (SELECT * FROM points WHERE region <> 3 ORDER BY md5(concat(id, ':7')), id LIMIT 4000) GROUP BY 1", "points"))


def g08(s, d):
    draws = jobs.grid(s, m=[10, 20], draw=[0, 1, 2])
    out = None
    for m in (10, 20):
        for draw in (0, 1, 2):
            t = sampling.per_group(view(s, d, "points").select("id", "did"), ["did"], m, "id", 1000 + draw).withColumns({"m": F.lit(m), "draw": F.lit(draw)})
            out = t if out is None else out.unionByName(t)
    return out.join(F.broadcast(draws), ["m", "draw"])


Q["g08_local_rows_per_group"] = (g08, oracle("SELECT id, did, m, draw FROM (SELECT id, did, v.m AS m, w.d AS draw, row_number() OVER (PARTITION BY did, v.m, w.d ORDER BY md5(concat(id, ':', 1000 + w.d)), id) AS rn FROM points, (VALUES (10), (20)) v(m), (VALUES (0), (1), (2)) w(d)) WHERE rn <= m", "points"))


def g09(s, d):
    per = view(s, d, "points").groupBy("event_type").agg(F.count("*").alias("n"))
    return tops.reorder(per, "event_type", ["view", "click", "purchase", "signup", "error", "refund"])


Q["g09_report_row_order"] = (g09, oracle(f"SELECT position, o.event_type, n FROM (VALUES (0, 'view'), (1, 'click'), (2, 'purchase'), (3, 'signup'), (4, 'error'), (5, 'refund')) o(position, event_type) LEFT JOIN (SELECT event_type, {N} AS n FROM points GROUP BY 1) p ON p.event_type = o.event_type", "points"))
