"""Equality, interval, footprint and distance joins, and the statistics built on them."""

from pyspark.sql import functions as F

from terrasift.catalog.aggregates import rnd
from terrasift.catalog.places import N, X, Y, contains_sql, footprint
from terrasift.functions import geo
from terrasift.operators import agg, geostat, groups, intervals, knn, nearby
from terrasift.operators.quantiles import quantiles
from terrasift.sources import tables as io
from terrasift.sources.views import oracle, view

Q = QUERIES = {}
DIST = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))"
T = f"t AS (SELECT *, {X} AS x, {Y} AS y FROM points)"
ST = f"s AS (SELECT *, {X} AS x, {Y} AS y FROM stations)"


def pts(s, d):
    return geo.xy(view(s, d, "points"))


def stn(s, d):
    return geo.xy(view(s, d, "stations"))


def top(k, on, cols="nb := b.id", left="t", right="t", key="a.id"):
    """Brute-force nearest k as a list of structs per query."""
    return f"(SELECT {key} AS id, min(struct_pack(d := round({DIST}, 3), {cols}), {k}) AS l FROM {left} a JOIN {right} b ON {on} GROUP BY 1)"


# ---- equality joins
def d01(s, d):
    p = view(s, d, "points")
    return p.select("id", "n").join(p.select("id", "ph", "ec"), "id").join(p.select("id", F.col("oc").alias("c_oc")), "id")


Q["d01_feature_table_join"] = (d01, oracle("SELECT id, n, ph, ec, oc AS c_oc FROM points", "points"))


def d02(s, d):
    p = view(s, d, "points").withColumn("k3", F.col("user_id") % 7)
    return p.join(view(s, d, "region"), F.col("k3") == F.col("r_regionkey"), "left").select("id", "r_name")


Q["d02_left_join_region"] = (d02, oracle("SELECT id, r_name FROM points LEFT JOIN region ON user_id % 7 = r_regionkey", "points"))


def d03(s, d):
    w = view(s, d, "windows").select("id", "scene_id", "B04").distinct()
    o = view(s, d, "windows").filter("status = 'ok'").select("id", "scene_id", "dt").distinct()
    return w.join(o, ["id", "scene_id"]).groupBy("id").agg(F.count("*").alias("n"), F.sum("B04").alias("b04"))


Q["d03_composite_key_join"] = (d03, oracle(f"SELECT id, {N} AS n, sum(B04) AS b04 FROM (SELECT DISTINCT id, scene_id, B04 FROM windows) JOIN (SELECT DISTINCT id, scene_id, dt FROM windows WHERE status = 'ok') USING (id, scene_id) GROUP BY 1", "windows"))


def d04(s, d):
    p = view(s, d, "part")
    return p.join(view(s, d, "windows").filter("scl_major = 5 AND n_px = 8").select(F.col("id").alias("p_partkey")).distinct(), "p_partkey", "left_semi").select("p_partkey", "p_brand")


Q["d04_semi_join"] = (d04, oracle("SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT id FROM windows WHERE scl_major = 5 AND n_px = 8)", "windows"))


def d05(s, d):
    w = view(s, d, "windows")
    return io.missing_keys(w.select("id", "scene_id").distinct(), w.filter("status <> 'ok' OR rank > 3"), ["id", "scene_id"])


Q["d05_anti_join_composite"] = (d05, oracle("SELECT DISTINCT id, scene_id FROM windows w WHERE NOT EXISTS (SELECT 1 FROM windows v WHERE v.id = w.id AND v.scene_id = w.scene_id AND (v.status <> 'ok' OR v.rank > 3))", "windows"))


def d06(s, d):
    w = view(s, d, "windows").filter("rank = 1")
    return io.missing_keys(view(s, d, "part").select(F.col("p_partkey").alias("id")), w, ["id"])


Q["d06_anti_join_id"] = (d06, oracle("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT id FROM windows WHERE rank = 1)", "windows"))


def d07(s, d):
    from terrasift.operators import qa

    a = view(s, d, "points").filter("region <> 0").groupBy("did", "event_type").agg(F.avg("n").alias("n"), F.avg("p").alias("p"))
    b = view(s, d, "points").filter("region <> 1").groupBy("did", "event_type").agg(F.avg("n").alias("n"), F.avg(F.col("p") + 0.25).alias("p"))
    return rnd(qa.compare(a, b, ["did", "event_type"], ["n", "p"]), ["max_diff"])


_AB = [f"(SELECT did, event_type, avg(n) AS n, avg({p}) AS p FROM points WHERE region <> {r} GROUP BY 1, 2)" for r, p in ((0, "p"), (1, "p + 25e-2"))]
Q["d07_full_outer_compare"] = (d07, oracle(" UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST(count(*) FILTER (a.did IS NOT NULL AND b.did IS NOT NULL) AS BIGINT) AS matched, CAST(count(*) FILTER (b.did IS NULL) AS BIGINT) AS left_only,
 CAST(count(*) FILTER (a.did IS NULL) AS BIGINT) AS right_only, round(max(abs(a.{c} - b.{c})), 6) AS max_diff FROM {_AB[0]} a FULL OUTER JOIN {_AB[1]} b ON a.did = b.did AND a.event_type = b.event_type""" for c in "np"), "points"))


# ---- time, footprint, box
def pairs(s, d):
    return intervals.within_days(view(s, d, "points"), view(s, d, "scenes"), "tile", 3)


def d08(s, d):
    return pairs(s, d).select("id", "scene_id", "date_difference_days")


_DD = "date_diff('day', CAST(ts AS DATE), CAST(scene_ts AS DATE))"
PAIRS = f"(SELECT p.*, scene_id, scene_ts, cloud, cx, cy, CAST({_DD} AS INTEGER) AS date_difference_days FROM points p JOIN scenes c ON p.tile = c.tile AND abs({_DD}) <= 3)"
Q["d08_within_three_days"] = (d08, oracle(f"SELECT id, scene_id, date_difference_days FROM {PAIRS}", "points", "scenes"))


def d09(s, d):
    p = pairs(s, d).withColumn("ring", footprint())
    return intervals.in_footprint(p, F.col("ring")).select("id", "scene_id")


Q["d09_point_in_footprint_join"] = (d09, oracle(f"SELECT id, scene_id FROM {PAIRS} WHERE {contains_sql()}", "points", "scenes"))


def boxes(s, d):
    return view(s, d, "stations").select("st_id", F.col("lon").alias("lon_lo"), F.col("lat").alias("lat_lo"), (F.col("lon") + 0.05 + (F.col("st_id") % 7) * 0.2).alias("lon_hi"), (F.col("lat") + 0.1 + (F.col("st_id") % 5) * 0.1).alias("lat_hi"))


def d10(s, d):
    return intervals.in_box(view(s, d, "points").select("id", "lon", "lat"), boxes(s, d)).select("id", "st_id")


Q["d10_point_to_box_join"] = (d10, oracle("""SELECT p.id, st_id FROM points p JOIN stations s ON p.lon >= s.lon AND p.lon < s.lon + 5e-2 + (st_id % 7)*2e-1 AND p.lat >= s.lat AND p.lat < s.lat + 1e-1 + (st_id % 5)*1e-1""", "points", "stations"))


# ---- distance
def d11(s, d):
    return rnd(nearby.pairs_within(pts(s, d), 30.0), ["d"], 3)


_P30 = f"SELECT a.id AS a, b.id AS b, round({DIST}, 3) AS d FROM t a JOIN t b ON a.id < b.id AND {DIST} <= 30"
Q["d11_pairs_within_30m"] = (d11, oracle(f"WITH {T} SELECT *, CAST(1 AS BIGINT) AS row_pairs FROM ({_P30})", "points"))
Q["d12_neighbour_count"] = (lambda s, d: nearby.count_within(pts(s, d), 30.0).select("id", "n_near"), oracle(
    f"WITH {T} SELECT a.id, CAST(count(b.id) AS BIGINT) AS n_near FROM t a LEFT JOIN t b ON a.id <> b.id AND {DIST} <= 30 GROUP BY 1", "points"))


def d13(s, d):
    n = knn.nearest(pts(s, d), stn(s, d), ["level"], rid="st_id")
    return n.select("id", "nb", F.round("nn_dist", 3).alias("nn_dist"), "level")


Q["d13_nearest_station"] = (d13, oracle(f"WITH {T}, {ST} SELECT id, l[1].nb AS nb, l[1].d AS nn_dist, l[1].v AS level FROM " + top(1, "true", "nb := b.st_id, v := b.level", right="s"), "points", "stations"))


def self_rows(p, k, exclude):
    return knn.knn_rows(p, p, k, exclude=exclude)


def d14(s, d):
    return knn.knn_rows(pts(s, d), stn(s, d), 8, rid="st_id")


def knn_sql(k, on, right="t", cols="nb := b.id"):
    return f"SELECT id, CAST(generate_subscripts(l, 1) AS INTEGER) AS rank, unnest(l).nb AS nb, unnest(l).d AS d FROM {top(k, on, cols, right=right)}"


Q["d14_f11_knn_join"] = (d14, oracle(f"WITH {T}, {ST} " + knn_sql(8, "true", "s", "nb := b.st_id"), "points", "stations"))
Q["d15_knn_excluding_self"] = (lambda s, d: self_rows(pts(s, d), 10, "self"), oracle(f"WITH {T} " + knn_sql(10, "a.id <> b.id"), "points"))
Q["d16_knn_excluding_site"] = (lambda s, d: self_rows(pts(s, d), 10, "spot"), oracle(f"WITH {T} " + knn_sql(10, "a.spot <> b.spot"), "points"))


def self_nearest(p):
    return knn.nearest(p, p, exclude="self")


def d17(s, d):
    return self_nearest(pts(s, d)).select("id", "nn_dist")


Q["d17_nearest_other_distance"] = (d17, oracle(f"WITH {T} SELECT a.id, round(min({DIST}), 3) AS nn_dist FROM t a JOIN t b ON a.id <> b.id GROUP BY 1", "points"))


def folded(s, d):
    from terrasift.plans import designs

    return designs.blocks(pts(s, d), 10, 5, 42)


def fold_sql(key, k=5, seed=42, src="t"):
    """Rows of src with a fold from the md5 order of the distinct keys."""
    return f"f AS (SELECT u.*, g.fold FROM (SELECT *, {key} AS fkey FROM {src}) u JOIN (SELECT fkey, CAST((row_number() OVER (ORDER BY md5(concat(fkey, ':{seed}')), fkey) - 1) % {k} AS INTEGER) AS fold FROM (SELECT DISTINCT {key} AS fkey FROM {src})) g ON u.fkey = g.fkey)"


BLK10 = "concat(CAST(floor(x/10e3) AS BIGINT), '_', CAST(floor(y/10e3) AS BIGINT))"
Q["d18_knn_other_folds"] = (lambda s, d: self_rows(folded(s, d), 5, "fold"), oracle(f"WITH {T}, {fold_sql(BLK10)} " + knn_sql(5, "a.fold <> b.fold").replace("FROM t a JOIN t b", "FROM f a JOIN f b"), "points"))


def d19(s, d):
    from terrasift.plans import designs

    p = designs.random_holdout(pts(s, d), "id", 0.3, 42)
    return nearby.farther_than(p.filter("is_test = 0"), p.filter("is_test = 1"), 5000.0).select("id")


_IST = "CAST(concat('0x', substr(md5(concat(id, ':42')), 1, 8)) AS BIGINT)/4294967296e0 < 3e-1"
Q["d19_farther_than_every_test_row"] = (d19, oracle(f"WITH {T}, u AS (SELECT *, {_IST} AS ist FROM t) SELECT a.id FROM u a JOIN u b ON NOT a.ist AND b.ist GROUP BY 1 HAVING round(min({DIST}), 3) > 5000", "points"))


def d20(s, d):
    from terrasift.operators.sampling import sample_n

    p = nearby.sample_pairs(sample_n(pts(s, d), 1500, "id", 42))
    return p.groupBy(F.floor(F.col("d") / 50000).alias("bin")).agg(F.count("*").alias("pairs"), F.round(F.avg("d"), 3).alias("mean_d"))


_S = "sm AS (SELECT * FROM t ORDER BY md5(concat(id, ':42')), id LIMIT {})"
Q["d20_all_pairs_of_sample"] = (d20, oracle(f"WITH {T}, {_S.format(1500)} SELECT CAST(floor(d/5e4) AS BIGINT) AS bin, {N} AS pairs, round(avg(d), 3) AS mean_d FROM (SELECT {DIST} AS d FROM sm a JOIN sm b ON a.id < b.id) GROUP BY 1", "points"))


def d21(s, d):
    from terrasift.operators import links

    p = view(s, d, "points")
    loc = links.members(p, "spot").join(p.groupBy("spot").agg(F.avg("n").alias("loc_n")), "spot")
    return links.via_members(loc.withColumnRenamed("spot", "loc_id"), p.select("id", "p"), "loc_id").select("loc_id", "id", "p", F.round("loc_n", 6).alias("loc_n"))


Q["d21_link_through_members"] = (d21, oracle("SELECT spot AS loc_id, id, p, round(avg(n) OVER (PARTITION BY spot), 6) AS loc_n FROM points", "points"))


def d22(s, d):
    from terrasift.operators import seasons

    c = seasons.climate_normals(view(s, d, "climate"), ["node_x", "node_y"])
    p = view(s, d, "points").withColumns({"node_x": geo.nearest_node("lon", 72.6, 0.085), "node_y": geo.nearest_node("lat", 15.6, 0.5)})
    return p.join(c, ["node_x", "node_y"]).select("id", F.round("ppt_annual", 6).alias("ppt_annual"))


Q["d22_climate_at_nearest_node"] = (d22, oracle("""SELECT id, round(a, 6) AS ppt_annual FROM points JOIN (SELECT node_x, node_y, avg(ppt)*12 AS a FROM climate GROUP BY 1, 2)
 ON node_x = floor((lon - 72.6e0)/85e-3 + 5e-1) AND node_y = floor((lat - 15.6e0)/5e-1 + 5e-1)""", "points", "climate"))


def d23(s, d):
    g = view(s, d, "grid").select("tile", "r", "col", F.col("value").alias("at_pixel"))
    p = view(s, d, "points").select("id", geo.cell("id", 1e4).cast("long").alias("tile"), geo.pixel_index("lon", 72.6, 0.083, 100).alias("col"), geo.pixel_index("lat", 15.6, 0.065, 100).alias("r"))
    return p.join(g, ["tile", "r", "col"]).select("id", "at_pixel")


_COL, _ROW = ["CAST(greatest(0, least(99, floor(({} - {})/{}))) AS BIGINT)".format(*a) for a in (("lon", "72.6e0", "83e-3"), ("lat", "15.6e0", "65e-3"))]
Q["d23_pixel_at_point"] = (d23, oracle(f"SELECT p.id, g.value AS at_pixel FROM (SELECT id, {_COL} AS c, {_ROW} AS w FROM points) p JOIN grid g ON g.tile = CAST(floor(p.id/1e4) AS BIGINT) AND g.col = p.c AND g.r = p.w", "points", "grid"))


# pixels as positions: 100 x 100 cells of about 8.8 km x 7.2 km per tile, tiles side by side
def pixels(s, d):
    return view(s, d, "grid").withColumns({"x": 7500000.0 + F.col("col") * 8800.0 + F.col("tile") * 900000.0, "y": 1724000.0 + F.col("r") * 7200.0, "id": F.col("tile") * 10000 + F.col("r") * 100 + F.col("col")})


PX = "g AS (SELECT *, 75e5 + col*88e2 + tile*9e5 AS x, 1724e3 + r*72e2 AS y, tile*10000 + r*100 + col AS id FROM grid)"


def d24(s, d):
    f = nearby.fraction_within(pts(s, d), pixels(s, d), 15000.0, {"crop": 4, "built": 5})
    return rnd(f.select("id", "pixels", "crop", "built"), ["crop", "built"])


Q["d24_class_fraction_within"] = (d24, oracle(f"""WITH {T}, {PX} SELECT a.id, CAST(count(b.id) AS BIGINT) AS pixels, round(coalesce(avg(CAST(b.cls = 4 AS INTEGER)), 0e0), 6) AS crop, round(coalesce(avg(CAST(b.cls = 5 AS INTEGER)), 0e0), 6) AS built
 FROM t a LEFT JOIN g b ON {DIST} <= 15000 GROUP BY 1""", "points", "grid"))


def d25(s, d):
    n = knn.nearest(pts(s, d), pixels(s, d).filter("cls = 5"))
    return n.select("id", F.coalesce(F.least("nn_dist", F.lit(25000.0)), F.lit(25000.0)).alias("dist_built"))


Q["d25_distance_to_class"] = (d25, oracle(f"WITH {T}, {PX} SELECT a.id, least(round(min({DIST}), 3), 25e3) AS dist_built FROM t a JOIN g b ON b.cls = 5 GROUP BY 1", "points", "grid"))


def d26(s, d):
    from terrasift.plans import designs

    p = designs.kfold(pts(s, d), "id", 5, 42)
    return rnd(nearby.split_pairs(p, 30.0, "fold"), ["split_share"])


Q["d26_close_pairs_across_folds"] = (d26, oracle(f"""WITH {T}, f AS (SELECT *, CAST(concat('0x', substr(md5(concat(id, ':42')), 1, 8)) AS BIGINT) % 5 AS fold FROM t)
 SELECT {N} AS pairs, CAST(count(*) FILTER (a.fold <> b.fold) AS BIGINT) AS split_pairs, round(count(*) FILTER (a.fold <> b.fold)/count(*), 6) AS split_share FROM f a JOIN f b ON a.id < b.id AND {DIST} <= 30""", "points"))


def d27(s, d):
    from terrasift.operators import qa
    from terrasift.plans import designs

    r = view(s, d, "repeated").withColumn("rid", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    p = designs.random_holdout(r, "rid", 0.3, 42)
    return rnd(qa.copies_in_train(p.filter("is_test = 0"), p.filter("is_test = 1"), ["n", "p", "k", "l_suppkey"]), ["share"])


Q["d27_copies_in_training"] = (d27, oracle("""WITH u AS (SELECT *, CAST(concat('0x', substr(md5(concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, ':42')), 1, 8)) AS BIGINT)/4294967296e0 < 3e-1 AS ist FROM repeated),
 tr AS (SELECT DISTINCT n, p, k, l_suppkey FROM u WHERE NOT ist) SELECT CAST(count(*) AS BIGINT) AS test_rows, CAST(count(tr.n) AS BIGINT) AS copies, round(count(tr.n)/count(*), 6) AS share
 FROM (SELECT * FROM u WHERE ist) te LEFT JOIN tr USING (n, p, k, l_suppkey)""", "repeated"))


def d28(s, d):
    b = intervals.nearest_in_time(view(s, d, "points"), view(s, d, "scenes"), "tile", 3)
    return b.select("id", "scene_id", "date_difference_days")


Q["d28_nearest_in_time"] = (d28, oracle(f"SELECT id, scene_id, date_difference_days FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(date_difference_days), cloud, scene_id) AS rn FROM {PAIRS}) WHERE rn = 1", "points", "scenes"))


# ---- statistics on distance joins
def e34(s, d):
    a = knn.knn(pts(s, d), stn(s, d), 8, rid="st_id", cols=["level"])
    return a.select("id", F.round(F.get("nbrs", F.lit(0))["d"], 3).alias("dist_nearest"), F.round(knn.weighted_mean("nbrs", "level", knn.inverse(100.0)), 6).alias("level"))


Q["e34_idw_null_aware"] = (e34, oracle(f"""WITH {T}, {ST}, k AS (SELECT id, l[1].d AS d1, unnest(l) AS z FROM {top(8, 'true', 'nb := b.st_id, v := b.level', right='s')})
 SELECT id, round(any_value(d1), 3) AS dist_nearest, round(sum(z.v/greatest(z.d, 100))/sum(CASE WHEN z.v IS NOT NULL THEN 1/greatest(z.d, 100) END), 6) AS level FROM k GROUP BY 1""", "points", "stations"))


def e35(s, d):
    p = pts(s, d).withColumn("ly", F.log1p("n"))
    a = knn.local_reference(knn.knn(p, p, 10, cols=["ly"], exclude="spot"), "ly")
    return rnd(a.select("id", "lr_mean", "lr_nearest", "lr_log_dist", "lr_sd"), ["lr_mean", "lr_nearest", "lr_log_dist", "lr_sd"])


Q["e35_local_reference_features"] = (e35, oracle(f"""WITH {T}, k AS (SELECT id, l[1].v AS v1, l[1].d AS d1, unnest(l) AS z FROM {top(10, 'a.spot <> b.spot', 'nb := b.id, v := ln(1 + b.n)')})
 SELECT id, round(sum(z.v/greatest(z.d, 1))/sum(1/greatest(z.d, 1)), 6) AS lr_mean, round(any_value(v1), 6) AS lr_nearest, round(ln(1 + any_value(d1)), 6) AS lr_log_dist, round(stddev_pop(z.v), 6) AS lr_sd FROM k GROUP BY 1""", "points"))


def logged(s, d):
    return pts(s, d).withColumn("ly", F.log1p("n"))


def e47(s, d):
    return rnd(geostat.semivariogram(logged(s, d), "ly"), ["dist_km", "semivariance", "relative"])


def _bins(edges):
    return "CASE " + " ".join(f"WHEN d >= {a} AND d < {b} THEN {i}" for i, (a, b) in enumerate(zip(edges, edges[1:]))) + " END"


_MID = "CASE bin " + " ".join(f"WHEN {i} THEN {(a * b) ** 0.5 / 1000!r}e0" for i, (a, b) in enumerate(zip(geostat.LAGS, geostat.LAGS[1:]))) + " END"
_VG = f"""WITH {T}, pr AS (SELECT {DIST} AS d, pow(ln(1 + a.n) - ln(1 + b.n), 2)/2 AS g FROM t a JOIN t b ON a.id < b.id AND {DIST} < 400000),
 vg AS (SELECT {_bins(geostat.LAGS)} AS bin, CAST(count(*) AS BIGINT) AS pairs, avg(g) AS semivariance FROM pr WHERE d >= 30 GROUP BY 1)
"""
Q["e47_semivariogram"] = (e47, oracle(_VG + f"SELECT bin, round({_MID}, 6) AS dist_km, pairs, round(semivariance, 6) AS semivariance, round(semivariance/(SELECT var_samp(ln(1 + n)) FROM points), 6) AS relative FROM vg", "points"))
Q["e48_reach_of_variance"] = (lambda s, d: rnd(geostat.reach(geostat.semivariogram(logged(s, d), "ly")), ["reach_km"]), oracle(
    _VG + f"SELECT round(min({_MID}) FILTER (semivariance/(SELECT var_samp(ln(1 + n)) FROM points) >= 95e-2), 6) AS reach_km FROM vg", "points"))


def e49(s, d):
    p = logged(s, d)
    km = p.select("id", (F.col("x") / 1000).alias("x"), (F.col("y") / 1000).alias("y"), "ly")
    tv = p.agg(F.var_pop("ly")).first()[0]
    return rnd(geostat.fit_exponential(geostat.lag_table(km, "ly", geostat.FIT_LAGS_KM), tv), ["c0", "c1", "a"], 5)


Q["e49_variogram_fit"] = (e49, oracle(f"""WITH {T}, pr AS (SELECT {DIST}/1e3 AS d, pow(ln(1 + a.n) - ln(1 + b.n), 2)/2 AS g FROM t a JOIN t b ON a.id < b.id AND {DIST} < 60000),
 vg AS (SELECT {_bins(geostat.FIT_LAGS_KM)} AS bin, count(*)*1e0 AS w, avg(d) AS h, avg(g) AS g FROM pr GROUP BY 1 HAVING count(*) >= 30),
 ga AS (SELECT 3e-1*pow(1e3, i/24e1) AS a FROM range(241) r(i)), u AS (SELECT a, w, g, 1 - exp(-h/a) AS u FROM vg, ga),
 z AS (SELECT a, sum(w) AS sw, sum(w*u) AS su, sum(w*u*u) AS suu, sum(w*g) AS sg, sum(w*u*g) AS sug, sum(w*g*g) AS sgg FROM u GROUP BY 1),
 c AS (SELECT *, (sw*sug - su*sg)/(sw*suu - su*su) AS c1r, (sg - (sw*sug - su*sg)/(sw*suu - su*su)*su)/sw AS c0r FROM z),
 e AS (SELECT *, greatest(c0r, 0) AS c0, greatest(CASE WHEN c0r < 0 THEN sug/suu ELSE c1r END, 1e-6) AS c1 FROM c)
 SELECT round(c0, 5) AS c0, round(c1, 5) AS c1, round(a, 5) AS a FROM e ORDER BY round(sgg + c0*c0*sw + c1*c1*suu - 2*c0*sg - 2*c1*sug + 2*c0*c1*su, 9), a LIMIT 1""", "points"))

BANDS_M = [0.0, 100.0, 500.0, 1000.0, 2000.0]


def e50(s, d):
    return rnd(geostat.nearby_pairs(pts(s, d), ["n", "p", "oc"], "region", BANDS_M), ["n", "p", "oc"])


def _z(c):
    return f"(ln(1 + {c}) - avg(ln(1 + {c})) OVER (PARTITION BY region))/stddev_samp(ln(1 + {c})) OVER (PARTITION BY region) AS z{c}"


Q["e50_f06_nearby_pairs"] = (e50, oracle(f"""WITH t AS (SELECT id, region, {X} AS x, {Y} AS y, {_z('n')}, {_z('p')}, {_z('oc')} FROM points),
 pr AS (SELECT {DIST} AS d, pow(a.zn - b.zn, 2)/2 AS n, pow(a.zp - b.zp, 2)/2 AS p, pow(a.zoc - b.zoc, 2)/2 AS oc FROM t a JOIN t b ON a.id < b.id AND a.region = b.region AND {DIST} < 2000)
 SELECT {_bins(BANDS_M)} AS band, {N} AS pairs, round(avg(n), 6) AS n, round(avg(p), 6) AS p, round(avg(oc), 6) AS oc FROM pr GROUP BY 1""", "points"))
Q["e62_pair_difference"] = (lambda s, d: rnd(geostat.pair_difference(pts(s, d), "n", 500.0), ["share_above", "abs_diff_p50", "rel_diff_p50"]), oracle(
    f"""WITH {T}, pr AS (SELECT abs(a.n - b.n) AS x, abs(a.n - b.n)/((a.n + b.n)/2) AS r FROM t a JOIN t b ON a.id < b.id AND {DIST} <= 500)
 SELECT {N} AS pairs, round(avg(CAST(r > 3e-1 AS INTEGER)), 6) AS share_above, round(median(x), 6) AS abs_diff_p50, round(median(r), 6) AS rel_diff_p50 FROM pr""", "points"))


def e56(s, d):
    from terrasift.operators import qa

    n = self_nearest(pts(s, d))
    return rnd(qa.distance_profile(n, [], "nn_dist"), ["p5_m", "p25_m", "p50_m", "p75_m", "p95_m", "le_30m", "le_100m", "le_1000m", "le_5000m"], 4)


PROFILE = "CAST(count(*) AS BIGINT) AS rows, " + ", ".join(f"round(quantile_cont(d, {p/100}), 4) AS p{p}_m" for p in (5, 25, 50, 75, 95)) + ", " + ", ".join(f"round(avg(CAST(d <= {m} AS INTEGER)), 4) AS le_{m}m" for m in (30, 100, 1000, 5000))
Q["e56_distance_profile"] = (e56, oracle(f"WITH {T} SELECT {PROFILE} FROM (SELECT a.id, round(min({DIST}), 3) AS d FROM t a JOIN t b ON a.id <> b.id GROUP BY 1)", "points"))
