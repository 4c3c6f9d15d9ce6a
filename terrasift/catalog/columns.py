"""Projections, filters and predicates."""

from pyspark.sql import functions as F

from terrasift.functions import clean, feat
from terrasift.functions.geo import STATE_BOX
from terrasift.operators import groups
from terrasift.sources.views import BANDS, FEATURE_COLS, oracle, view

Q = QUERIES = {}
N = "CAST(count(*) AS BIGINT)"


def cnt(cond):
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


def b01(s, d):
    return view(s, d, "raw").filter(F.col("sid") == "27").select("id", "sid", "did")


Q["b01_state_filter"] = (b01, oracle("SELECT id, sid, did FROM raw WHERE sid = '27'", "raw"))


def b02(s, d):
    r = view(s, d, "raw")
    st, di = clean.id_parts("id")
    a, b = F.col("sid") == "27", st == "27"
    k = clean.known
    return r.agg(
        F.count_if(F.col("sid").isNull()).alias("null_sid"), F.count_if(k(a)).alias("by_sid"), F.count_if(k(b)).alias("by_id"),
        F.count_if(k(a & b)).alias("both"), F.count_if(k(a & ~b)).alias("sid_only"), F.count_if(k(b & ~a)).alias("id_only"),
        F.count_if((k(a) | k(b)) & k(F.col("did") == di)).alias("district_agrees"))


Q["b02_masks_and_agreement"] = (b02, oracle(f"""SELECT {cnt('sid IS NULL')} AS null_sid, {cnt("sid = '27'")} AS by_sid, {cnt("s = '27'")} AS by_id,
 {cnt("sid = '27' AND s = '27'")} AS both, {cnt("sid = '27' AND NOT s = '27'")} AS sid_only, {cnt("s = '27' AND NOT sid = '27'")} AS id_only,
 {cnt("(coalesce(sid = '27', false) OR s = '27') AND did = dd")} AS district_agrees
 FROM (SELECT *, split_part(id, '_', 1) AS s, split_part(id, '_', 2) AS dd FROM raw)""", "raw"))


def b03(s, d):
    codes = ["466", "470", "485", "500"]
    return view(s, d, "raw").filter(F.col("did").isin(codes)).groupBy("did").agg(F.count("*").alias("n"))


Q["b03_code_membership"] = (b03, oracle(f"SELECT did, {N} AS n FROM raw WHERE did IN ('466', '470', '485', '500') GROUP BY 1", "raw"))


def b04(s, d):
    r = view(s, d, "raw").withColumn("lon", F.when(F.col("event_id") % 113 == 0, F.lit(float("nan"))).otherwise(F.col("lon")))
    inside = clean.in_bbox("lon", "lat", STATE_BOX)
    return r.agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


_BOX = "event_id % 113 <> 0 AND lon BETWEEN 72.6e0 AND 80.9e0 AND lat BETWEEN 15.6e0 AND 22.1e0"
Q["b04_bounding_box_nan_safe"] = (b04, oracle(f"SELECT {cnt(_BOX)} AS inside, {cnt(f'NOT ({_BOX})')} AS outside FROM raw", "raw"))


def b05(s, d):
    return view(s, d, "raw").select("event_id", *[clean.to_number(c).alias(c) for c in ("n", "p", "k", "oc", "ph", "ec")])


Q["b05_text_to_number"] = (b05, oracle("SELECT event_id, " + ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in ("n", "p", "k", "oc", "ph", "ec")) + " FROM raw", "raw"))


def b06(s, d):
    return view(s, d, "raw").select("event_id", F.date_format(clean.to_date("date"), "yyyy-MM-dd").alias("day"))


Q["b06_text_to_date"] = (b06, oracle("SELECT event_id, strftime(try_strptime(date, '%m/%d/%y, %I:%M %p'), '%Y-%m-%d') AS day FROM raw", "raw"))


def b07(s, d):
    c = clean.year_guard(clean.to_date("date"), 2014, 2025)
    return view(s, d, "raw").withColumn("y", F.year(c)).groupBy("y").agg(F.count("*").alias("n"))


Q["b07_year_guard"] = (b07, oracle(f"""SELECT CASE WHEN y BETWEEN 2014 AND 2025 THEN y END AS y, {N} AS n
 FROM (SELECT year(try_strptime(date, '%m/%d/%y, %I:%M %p')) AS y FROM raw) GROUP BY 1""", "raw"))


def b08(s, d):
    ok = [clean.to_number(c).isNotNull() for c in ("n", "p", "k")]
    return view(s, d, "raw").agg(F.count_if(clean.all_of(ok)).alias("all_ok"), F.count_if(clean.any_of(ok)).alias("any_ok"))


_OKS = ["TRY_CAST(n AS DOUBLE) IS NOT NULL", "TRY_CAST(p AS DOUBLE) IS NOT NULL", "TRY_CAST(k AS DOUBLE) IS NOT NULL"]
Q["b08_rowwise_all_any"] = (b08, oracle(f"SELECT {cnt(' AND '.join(_OKS))} AS all_ok, {cnt(' OR '.join(_OKS))} AS any_ok FROM raw", "raw"))

_NUM = "(SELECT event_id, " + ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in ("n", "p", "k", "oc", "ph", "ec")) + " FROM raw)"
_LIM = "n > 20 AND n <= 1500 AND p > 1 AND p <= 300 AND k > 20 AND k <= 3000 AND oc > 0 AND oc <= 5 AND ph >= 3.5e0 AND ph <= 10.5e0 AND ec > 0 AND ec <= 10"
_NAT = "n BETWEEN 20 AND 1500 AND p BETWEEN 1 AND 300 AND k BETWEEN 20 AND 3000 AND oc > 2e-2 AND oc <= 5 AND ph BETWEEN 3.5e0 AND 10.5e0 AND ec > 5e-3 AND ec <= 10"


def numbers(s, d):
    return view(s, d, "raw").select("event_id", *[clean.to_number(c).alias(c) for c in ("n", "p", "k", "oc", "ph", "ec")])


def b09(s, d):
    return numbers(s, d).filter(clean.within_limits(clean.LIMITS)).select("event_id")


Q["b09_plausibility_limits"] = (b09, oracle(f"SELECT event_id FROM {_NUM} WHERE {_LIM}", "raw"))


def b10(s, d):
    return numbers(s, d).filter(clean.within_limits(clean.NATIONAL_LIMITS)).select("event_id")


Q["b10_national_limits"] = (b10, oracle(f"SELECT event_id FROM {_NUM} WHERE {_NAT}", "raw"))


def b11(s, d):
    return numbers(s, d).filter(clean.within_limits(clean.LIMITS) & clean.within_limits(clean.TIGHTENED)).select("event_id")


Q["b11_tightened_limits"] = (b11, oracle(f"SELECT event_id FROM {_NUM} WHERE {_LIM} AND oc > 2e-2 AND ec > 5e-3", "raw"))


def b12(s, d):
    r = view(s, d, "raw").withColumn("sample_date", clean.to_date("date"))
    return clean.eligible(r, STATE_BOX).select("event_id")


Q["b12_h09_eligible_records"] = (b12, oracle(f"""SELECT event_id FROM (SELECT *, count(*) OVER (PARTITION BY lon, lat) AS c FROM raw)
 WHERE c = 1 AND try_strptime(date, '%m/%d/%y, %I:%M %p') IS NOT NULL AND lon BETWEEN 72.6e0 AND 80.9e0 AND lat BETWEEN 15.6e0 AND 22.1e0 AND {' AND '.join(_OKS)}""", "raw"))


def b13(s, d):
    return view(s, d, "lineitem").filter(clean.months(F.col("l_shipdate"), 1, 6)).groupBy(F.month("l_shipdate").alias("m")).agg(F.count("*").alias("n"))


Q["b13_season_filter"] = (b13, f"SELECT CAST(month(l_shipdate) AS INTEGER) AS m, {N} AS n FROM lineitem WHERE month(l_shipdate) <= 6 GROUP BY 1")


def b14(s, d):
    return view(s, d, "windows").filter(clean.strict_bare()).groupBy("id").agg(F.count("*").alias("n"))


_STRICT = "status = 'ok' AND scl_min = 5 AND scl_max = 5 AND n_px = 9"
Q["b14_strict_windows"] = (b14, oracle(f"SELECT id, {N} AS n FROM windows WHERE {_STRICT} GROUP BY 1", "windows"))


def b15(s, d):
    return view(s, d, "windows").filter(clean.majority_bare()).groupBy("id").agg(F.count("*").alias("n"))


Q["b15_majority_windows"] = (b15, oracle(f"SELECT id, {N} AS n FROM windows WHERE status = 'ok' AND scl_major = 5 GROUP BY 1", "windows"))


def b16(s, d):
    w = feat.reflectance(view(s, d, "windows"), BANDS)
    return w.groupBy("tile").agg(*[F.round(F.avg(b), 6).alias(b) for b in BANDS])


Q["b16_reflectance"] = (b16, oracle("SELECT tile, " + ", ".join(f"round(avg(({b} - 1000)/1e4), 6) AS {b}" for b in BANDS) + " FROM windows GROUP BY 1", "windows"))


def b17(s, d):
    w = feat.reflectance(view(s, d, "windows"), BANDS)
    return w.filter(clean.valid_reflectance(BANDS)).groupBy("tile").agg(F.count("*").alias("n"))


Q["b17_physical_reflectance"] = (b17, oracle(f"SELECT tile, {N} AS n FROM windows WHERE " + " AND ".join(f"({b} - 1000)/1e4 > 0 AND ({b} - 1000)/1e4 <= 1" for b in BANDS) + " GROUP BY 1", "windows"))

_F = dict(zip(BANDS, FEATURE_COLS))


def _bands_from_features(s, d):
    return view(s, d, "features").select("id", "label", *[F.col(f).alias(b) for b, f in _F.items()])


def _nd(a, b):
    return f"({a} - {b})/nullif({a} + {b}, 0)"


_B = {b: f for b, f in _F.items()}
INDEX_SQL = {
    "NDVI": _nd(_B["B08"], _B["B04"]),
    "SAVI": f"1.5e0*({_B['B08']} - {_B['B04']})/nullif({_B['B08']} + {_B['B04']} + 5e-1, 0)",
    "NBR2": _nd(_B["B11"], _B["B12"]), "NDMI": _nd(_B["B08"], _B["B11"]), "NDWI": _nd(_B["B03"], _B["B08"]),
    "BSI": _nd(f"({_B['B11']} + {_B['B04']})", f"({_B['B08']} + {_B['B02']})"),
    "NDRE": _nd(_B["B8A"], _B["B05"]), "CI": _nd(_B["B04"], _B["B03"]),
    "BI": f"sqrt((pow({_B['B04']}, 2) + pow({_B['B03']}, 2))/2)", "RI": f"pow({_B['B04']}, 2)/nullif({_B['B02']}*pow({_B['B03']}, 3), 0)",
    "R_B4B2": f"{_B['B04']}/nullif({_B['B02']}, 0)", "R_B11B12": f"{_B['B11']}/nullif({_B['B12']}, 0)", "R_B12B8": f"{_B['B12']}/nullif({_B['B08']}, 0)",
    "R_B11B8": f"{_B['B11']}/nullif({_B['B08']}, 0)", "R_B7B5": f"{_B['B07']}/nullif({_B['B05']}, 0)", "R_B6B5": f"{_B['B06']}/nullif({_B['B05']}, 0)",
}


def b18(s, d):
    return feat.indices(_bands_from_features(s, d)).select("id", *[F.round(i, 6).alias(i) for i in feat.INDEX_NAMES])


Q["b18_spectral_indices"] = (b18, oracle("SELECT id, " + ", ".join(f"round({q}, 6) AS {n}" for n, q in INDEX_SQL.items()) + " FROM features", "features"))


def b19(s, d):
    w = feat.indices(feat.reflectance(view(s, d, "windows"), BANDS))
    return w.agg(F.count("*").alias("n"), F.count_if(clean.finite(*feat.INDEX_NAMES)).alias("finite"))


_R = {b: f"(({b} - 1000)/1e4)" for b in BANDS}
_DEN = [f"{_R['B08']} + {_R['B04']}", f"{_R['B08']} + {_R['B04']} + 5e-1", f"{_R['B11']} + {_R['B12']}", f"{_R['B08']} + {_R['B11']}", f"{_R['B03']} + {_R['B08']}",
        f"({_R['B11']} + {_R['B04']}) + ({_R['B08']} + {_R['B02']})", f"{_R['B8A']} + {_R['B05']}", f"{_R['B04']} + {_R['B03']}",
        _R["B02"], _R["B03"], _R["B12"], _R["B08"], _R["B05"]]
Q["b19_finite_check"] = (b19, oracle(f"SELECT {N} AS n, {cnt(' AND '.join(f'({x}) <> 0' for x in _DEN))} AS finite FROM windows", "windows"))


def b20(s, d):
    n = view(s, d, "nation").join(view(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return n.select("n_nationkey", "n_name", F.coalesce("r_name", F.lit("?")).alias("r_name"))


Q["b20_code_lookup"] = (b20, "SELECT n_nationkey, n_name, coalesce(r_name, '?') AS r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")


def b21(s, d):
    st, di = clean.id_parts("id")
    return view(s, d, "raw").select("event_id", st.alias("state"), di.alias("district"))


Q["b21_split_id"] = (b21, oracle("SELECT event_id, split_part(id, '_', 1) AS state, split_part(id, '_', 2) AS district FROM raw", "raw"))


def b22(s, d):
    name = F.concat(F.lit("S2A_MSIL2A_20240101_N0510_R062_T"), F.col("scene_id").cast("string"), F.lit("_x"))
    prop = F.when(F.col("scene_id") % 3 == 0, F.concat(F.lit("P"), F.col("tile").cast("string")))
    return view(s, d, "scenes").select("scene_id", clean.scene_tile(prop, name).alias("t"))


Q["b22_scene_tile_token"] = (b22, oracle("SELECT scene_id, CASE WHEN scene_id % 3 = 0 THEN concat('P', tile) ELSE CAST(scene_id AS VARCHAR) END AS t FROM scenes", "scenes"))


def b23(s, d):
    o, li = view(s, d, "orders"), view(s, d, "lineitem")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.groupBy(clean.day_diff(F.col("l_shipdate"), F.col("o_orderdate")).alias("days")).agg(F.count("*").alias("n"))


Q["b23_day_difference"] = (b23, f"SELECT CAST(date_diff('day', o_orderdate, l_shipdate) AS INTEGER) AS days, {N} AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")


def b24(s, d):
    from terrasift.plans import designs, models

    p = designs.random_holdout(view(s, d, "points"), "id", 0.3, 42)
    t = models.scale_target(p, "n", F.col("is_test") == 0)
    return t.select("id", F.round("z", 6).alias("z"), F.round(models.unscale(F.col("z")), 6).alias("back"))


_TEST = "CAST(concat('0x', substr(md5(concat(id, ':42')), 1, 8)) AS BIGINT)/4294967296e0 < 3e-1"
Q["b24_target_transform"] = (b24, oracle(f"""WITH t AS (SELECT avg(ln(1 + n)) AS m, stddev_pop(ln(1 + n)) AS sd FROM points WHERE NOT {_TEST})
 SELECT id, round((ln(1 + n) - m)/sd, 6) AS z, round(n, 6) AS back FROM points, t""", "points"))


def b25(s, d):
    from terrasift.plans import designs, models

    p = designs.random_holdout(view(s, d, "points"), "id", 0.3, 42).withColumn("pred", F.col("p") * 12 - 40)
    return models.clip_to_train(p, "n", "pred", F.col("is_test") == 0).select("id", F.round("pred", 6).alias("pred"))


Q["b25_clip_to_training_range"] = (b25, oracle(f"""WITH t AS (SELECT min(n) AS lo, max(n) AS hi FROM points WHERE NOT {_TEST})
 SELECT id, round(greatest(lo, least(hi, p*12 - 40)), 6) AS pred FROM points, t""", "points"))


def b26(s, d):
    p = view(s, d, "points")
    return p.select("id", *[feat.rating(F.col(c), *feat.CUTS[c]).alias(f"{c}_class") for c in feat.CUTS],
                    feat.rating(F.col("oc"), 0.5, 0.75, False).alias("oc_class_open"))


def _rate(c, lo, hi, op="<="):
    return f"CASE WHEN {c} < {lo}e0 THEN 0 WHEN {c} {op} {hi}e0 THEN 1 ELSE 2 END"


Q["b26_three_class_rating"] = (b26, oracle(f"SELECT id, {_rate('n', 280, 560)} AS n_class, {_rate('p', 10, 25)} AS p_class, {_rate('k', 110, 280)} AS k_class, {_rate('oc', 0.5, 0.75)} AS oc_class, {_rate('oc', 0.5, 0.75, '<')} AS oc_class_open FROM points", "points"))

EDGES = [float("-inf"), 100.0, 200.0, 300.0, 450.0, float("inf")]


def b27(s, d):
    return view(s, d, "points").groupBy(feat.bin_index(F.col("n"), EDGES).alias("b")).agg(F.count("*").alias("n"))


Q["b27_numeric_bins"] = (b27, oracle(f"SELECT CASE WHEN n <= 100 THEN 0 WHEN n <= 200 THEN 1 WHEN n <= 300 THEN 2 WHEN n <= 450 THEN 3 ELSE 4 END AS b, {N} AS n FROM points GROUP BY 1", "points"))


def b28(s, d):
    return view(s, d, "events").groupBy(feat.bin_index(F.col("value"), [0.0, 30.0, 100.0, 250.0, 400.0], right=False).alias("b")).agg(F.count("*").alias("n"))


Q["b28_digitise_half_open"] = (b28, f"SELECT CASE WHEN value < 0 THEN NULL WHEN value < 30 THEN 0 WHEN value < 100 THEN 1 WHEN value < 250 THEN 2 WHEN value < 400 THEN 3 END AS b, {N} AS n FROM events GROUP BY 1")


def b29(s, d):
    p = view(s, d, "points").select("id", "n", "p", "k").withColumnsRenamed({c: f"c_{c}" for c in ("n", "p", "k")})
    return p.drop("c_k").select("c_p", "c_n", "id")


Q["b29_rename_prefix_reorder"] = (b29, oracle("SELECT p AS c_p, n AS c_n, id FROM points", "points"))


def b30(s, d):
    return clean.fill_median(view(s, d, "stations").select("st_id", "level"), ["level"]).select("st_id", F.round("level", 6).alias("level"))


Q["b30_fill_with_median"] = (b30, oracle("SELECT st_id, round(coalesce(level, (SELECT median(level) FROM stations)), 6) AS level FROM stations", "stations"))


def b31(s, d):
    st = view(s, d, "stations").withColumns({"constant": F.lit(1.0), "sparse": F.when(F.col("st_id") % 5 == 0, F.col("lon"))})
    return feat.screen(st, ["level", "constant", "sparse", "lat"]).select("feature", F.round("share", 6).alias("share"), "kept")


Q["b31_column_screening"] = (b31, oracle("""SELECT 'level' AS feature, round(count(level)/count(*), 6) AS share, count(level)/count(*) > 5e-1 AS kept FROM stations UNION ALL
 SELECT 'constant', 1e0, false UNION ALL SELECT 'sparse', round(count(*) FILTER (st_id % 5 = 0)/count(*), 6), false FROM stations UNION ALL SELECT 'lat', 1e0, true""", "stations"))


def b32(s, d):
    long = view(s, d, "windows").agg(*[F.avg(b).alias(b) for b in BANDS], F.avg("rank").alias("ndvi_mean"), F.avg("n_px").alias("ph")).unpivot([], BANDS + ["ndvi_mean", "ph"], "feature", "v")
    return long.withColumn("g", feat.group_of(F.col("feature"))).groupBy("g").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("v"))


Q["b32_input_group_tag"] = (b32, oracle("SELECT 'satellite' AS g, CAST(12 AS BIGINT) AS n, round(" + " + ".join(f"avg({b})" for b in BANDS) + ", 4) AS v FROM windows UNION ALL SELECT 'season', CAST(1 AS BIGINT), round(avg(rank), 4) FROM windows UNION ALL SELECT 'on-site', CAST(1 AS BIGINT), round(avg(n_px), 4) FROM windows", "windows"))


def b33(s, d):
    return feat.add_noise(view(s, d, "points"), "id", 0.15, 0.10).select("id", F.round("ph", 6).alias("ph"), F.round("ec", 6).alias("ec"))


def _u(salt):
    return f"CAST(concat('0x', substr(md5(concat(id, ':42{salt}')), 1, 8)) AS BIGINT)/4294967296e0"


def _norm(c):
    return f"(sqrt(-2e0*ln(greatest({_u(c + 'a')}, 1e-12)))*cos({_u(c + 'b')}*6.283185307179586e0))"


Q["b33_sensor_noise"] = (b33, oracle(f"SELECT id, round(ph + {_norm('p')}*15e-2, 6) AS ph, round(greatest(ec*(1 + {_norm('e')}*1e-1), 1e-3), 6) AS ec FROM points", "points"))


def b34(s, d):
    c = F.col("dt")
    return view(s, d, "series").groupBy(feat.ag_year(c).alias("y"), feat.season(c).alias("season")).agg(F.count("*").alias("n"))


AGY = "CAST(CASE WHEN month(dt) >= 6 THEN year(dt) ELSE year(dt) - 1 END AS INTEGER)"
SEASON = "CASE WHEN month(dt) BETWEEN 7 AND 10 THEN 'kharif' WHEN month(dt) IN (11, 12, 1, 2) THEN 'rabi' WHEN month(dt) BETWEEN 3 AND 5 THEN 'zaid' ELSE 'other' END"
Q["b34_agricultural_year_season"] = (b34, oracle(f"SELECT {AGY} AS y, {SEASON} AS season, {N} AS n FROM series GROUP BY 1, 2", "series"))


def b35(s, d):
    v = clean.qa_mask(F.col("ndvi"), F.col("qa"))
    return view(s, d, "series").groupBy("id").agg(F.count(v).alias("good"), F.round(F.sum(v), 4).alias("total"))


Q["b35_quality_mask"] = (b35, oracle("SELECT id, CAST(count(*) FILTER (qa <= 1) AS BIGINT) AS good, round(sum(ndvi) FILTER (qa <= 1), 4) AS total FROM series GROUP BY 1", "series"))


def b36(s, d):
    return view(s, d, "series").groupBy("id").agg(F.round(F.avg(feat.db(F.col("vv"))), 6).alias("vv_db"), F.count(feat.db(F.col("vv"))).alias("n"))


Q["b36_decibel"] = (b36, oracle("SELECT id, round(avg(10*log10(vv)), 6) AS vv_db, CAST(count(vv) AS BIGINT) AS n FROM series GROUP BY 1", "series"))


def b37(s, d):
    from terrasift.plans import jobs

    sets = jobs.feature_sets(s, {"soil": ["ph", "ec"], "rich": ["n", "p", "k"], "place": ["lon", "lat"]})
    vals = view(s, d, "points").agg(*[F.avg(c).alias(c) for c in ("ph", "ec", "n", "p", "k", "lon", "lat")]).unpivot([], ["ph", "ec", "n", "p", "k", "lon", "lat"], "feature", "v")
    return sets.select("set_name", F.explode("features").alias("feature")).join(vals, "feature").groupBy("set_name").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("v"))


_SETS = {"soil": "ph ec", "rich": "n p k", "place": "lon lat", "ladder: soil": "ph ec", "ladder: soil + rich": "ph ec n p k", "ladder: soil + rich + place": "ph ec n p k lon lat",
         "without soil": "n p k lon lat", "without rich": "ph ec lon lat", "without place": "ph ec n p k"}
Q["b37_feature_sets"] = (b37, oracle(" UNION ALL ".join(f"SELECT '{k}' AS set_name, CAST({len(v.split())} AS BIGINT) AS n, round({' + '.join(f'avg({c})' for c in v.split())}, 4) AS v FROM points" for k, v in _SETS.items()), "points"))


def b38(s, d):
    lim = {"n": (110.0, 400.0, True), "p": (8.0, 40.0, True), "ph": (6.0, 8.5, True)}
    return view(s, d, "points").filter(clean.within_limits(lim)).select("id")


Q["b38_value_range_subset"] = (b38, oracle("SELECT id FROM points WHERE n BETWEEN 110 AND 400 AND p BETWEEN 8 AND 40 AND ph BETWEEN 6 AND 8.5e0", "points"))


def b39(s, d):
    return view(s, d, "points").filter(F.col("did") != 491).groupBy("did").agg(F.count("*").alias("n"))


Q["b39_exclude_district"] = (b39, oracle(f"SELECT did, {N} AS n FROM points WHERE did <> 491 GROUP BY 1", "points"))


def b40(s, d):
    steps = [("all", F.lit(True)), ("readable", clean.all_of(F.col(c).isNotNull() for c in ("n", "p", "k"))), ("plausible", clean.within_limits(clean.LIMITS)), ("tightened", clean.within_limits(clean.TIGHTENED))]
    return clean.funnel(numbers(s, d), steps)


Q["b40_funnel"] = (b40, oracle(f"""SELECT 0 AS step_no, 'all' AS step, {N} AS rows FROM {_NUM} UNION ALL SELECT 1, 'readable', {cnt('n IS NOT NULL AND p IS NOT NULL AND k IS NOT NULL')} FROM {_NUM}
 UNION ALL SELECT 2, 'plausible', {cnt(_LIM)} FROM {_NUM} UNION ALL SELECT 3, 'tightened', {cnt(_LIM + ' AND oc > 2e-2 AND ec > 5e-3')} FROM {_NUM}""", "raw"))
