"""Grouped summaries, features from series, and scores."""

from pyspark.sql import functions as F

from terrasift.catalog.columns import AGY, INDEX_SQL, SEASON, _LIM, _NUM, _STRICT
from terrasift.functions import clean, feat
from terrasift.operators import agg, grid, groups, metric, seasons
from terrasift.operators.quantiles import medians, quantiles
from terrasift.sources.views import BANDS, oracle, view

Q = QUERIES = {}
N = "CAST(count(*) AS BIGINT)"


def rnd(df, cols, n=6):
    return df.select(*[F.round(c, n).alias(c) if c in cols else F.col(c) for c in df.columns])


def cnt(cond):
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


Q["e01_value_counts"] = (lambda s, d: agg.counts(view(s, d, "raw"), "did"), oracle(f"SELECT did, {N} AS n FROM raw WHERE did IS NOT NULL GROUP BY 1", "raw"))
Q["e02_size_histogram"] = (lambda s, d: agg.size_histogram(view(s, d, "repeated"), ["l_partkey", "l_suppkey"]),
                           oracle(f"SELECT size, {N} AS keys FROM (SELECT {N} AS size FROM repeated GROUP BY l_partkey, l_suppkey) GROUP BY 1", "repeated"))


def e03(s, d):
    return agg.distincts(view(s, d, "repeated"), ["l_partkey", "l_suppkey"], ["l_returnflag", "n", "l_shipdate"], ["n", "p", "k"])


Q["e03_e04_distincts_per_point"] = (e03, oracle(f"""SELECT l_partkey, l_suppkey, {N} AS records, CAST(count(DISTINCT l_returnflag) AS BIGINT) AS l_returnflag_distinct, CAST(count(DISTINCT n) AS BIGINT) AS n_distinct,
 CAST(count(DISTINCT l_shipdate) AS BIGINT) AS l_shipdate_distinct, CAST(count(DISTINCT (n, p, k)) AS BIGINT) AS combos FROM repeated GROUP BY 1, 2""", "repeated"))


def e05(s, d):
    p = view(s, d, "points")
    a = p.groupBy("region").agg(F.count("*").alias("samples"), F.round(F.avg((F.col("n") > 400).cast("double")), 6).alias("share"), F.round(F.sum("p"), 4).alias("p_sum"))
    return a.join(rnd(medians(p, ["region"], ["n", "k"]), ["n", "k"]), "region")


Q["e05_multi_aggregate"] = (e05, oracle(f"SELECT region, {N} AS samples, round(avg(CAST(n > 400 AS INTEGER)), 6) AS share, round(sum(p), 4) AS p_sum, round(median(n), 6) AS n, round(median(k), 6) AS k FROM points GROUP BY 1", "points"))

TYPES = ["click", "error", "purchase", "signup", "view"]
Q["e06_crosstab_margins"] = (lambda s, d: agg.crosstab(view(s, d, "points"), "region", "event_type", TYPES), oracle(
    "SELECT coalesce(CAST(region AS VARCHAR), 'All') AS region, " + ", ".join(f"{cnt(chr(39).join(['event_type = ', t, '']))} AS \"{t}\"" for t in TYPES) + f", CAST(0 AS BIGINT) AS other, {N} AS \"All\" FROM points GROUP BY ROLLUP (region)", "points"))


def e07(s, d):
    return agg.pivot(view(s, d, "points"), ["region"], "event_type", TYPES, F.round(F.avg("n"), 6))


Q["e07_pivot_mean"] = (e07, oracle("SELECT region, " + ", ".join(f"round(avg(n) FILTER (event_type = '{t}'), 6) AS \"{t}\"" for t in TYPES) + " FROM points GROUP BY 1", "points"))


def e08(s, d):
    long = agg.melt(view(s, d, "windows").select("tile", "id", *BANDS), ["tile", "id"], BANDS, "band", "dn")
    return agg.pivot(long, ["tile"], "band", BANDS, F.max("dn"))


Q["e08_long_to_wide"] = (e08, oracle("SELECT tile, " + ", ".join(f"max({b}) AS {b}" for b in BANDS) + " FROM windows GROUP BY 1", "windows"))


def e09(s, d):
    return agg.melt(view(s, d, "points").select("id", "n", "p", "k"), ["id"], ["n", "p", "k"], "target", "value")


Q["e09_wide_to_long"] = (e09, oracle(" UNION ALL ".join(f"SELECT id, '{c}' AS target, {c} AS value FROM points" for c in "npk"), "points"))


def e10(s, d):
    return rnd(agg.describe(view(s, d, "points"), ["n", "p", "oc"], (0.05, 0.25, 0.5, 0.75)), ["mean", "sd", "min", "max", "v_p5", "v_p25", "v_p50", "v_p75"])


Q["e10_describe_exact_quantiles"] = (e10, oracle(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {N} AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(quantile_cont({c}, 0.05), 6) AS v_p5, round(quantile_cont({c}, 0.25), 6) AS v_p25, round(median({c}), 6) AS v_p50, round(quantile_cont({c}, 0.75), 6) AS v_p75 FROM points"
    for c in ("n", "p", "oc")), "points"))
Q["e11_group_medians"] = (lambda s, d: rnd(medians(view(s, d, "windows"), ["id"], BANDS), BANDS), oracle("SELECT id, " + ", ".join(f"round(median({b}), 6) AS {b}" for b in BANDS) + " FROM windows GROUP BY 1", "windows"))
Q["e12_group_sd"] = (lambda s, d: view(s, d, "repeated").groupBy("l_partkey", "l_suppkey").agg(F.round(F.stddev_samp("n"), 6).alias("sd_n"), F.round(F.stddev_samp("p"), 6).alias("sd_p")),
                     oracle("SELECT l_partkey, l_suppkey, round(stddev_samp(n), 6) AS sd_n, round(stddev_samp(p), 6) AS sd_p FROM repeated GROUP BY 1, 2", "repeated"))


def e13(s, d):
    # every spot keeps its row; the list is there for spots of at most ten members (the rule of I02), larger ones have their count
    p = groups.size(view(s, d, "points"), ["spot"], "size")
    short = F.when(F.col("size") <= 10, F.col("id"))
    out = p.groupBy("spot").agg(F.min_by("did", "id").alias("did"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_ts"), agg.joined_list(short).alias("ids_merged"), F.count("*").alias("n_merged"))
    return out.withColumn("ids_merged", F.when(F.col("n_merged") <= 10, F.col("ids_merged")))


Q["e13_ordered_first_and_lists"] = (e13, oracle(f"""SELECT spot, arg_min(did, id) AS did, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts,
 CASE WHEN count(*) <= 10 THEN string_agg(CAST(id AS VARCHAR), ';' ORDER BY CAST(id AS VARCHAR)) END AS ids_merged, {N} AS n_merged FROM points GROUP BY 1""", "points"))
Q["e14_distinct_sorted_list"] = (lambda s, d: view(s, d, "raw").groupBy("did").agg(agg.joined_list("cycle", "|", True).alias("cycles")),
                                 oracle("SELECT did, string_agg(DISTINCT cycle, '|' ORDER BY cycle) AS cycles FROM raw GROUP BY 1", "raw"))
Q["e15_mode_smallest_on_ties"] = (lambda s, d: agg.mode(view(s, d, "repeated"), ["l_partkey"], "l_suppkey"), oracle(
    "SELECT l_partkey, l_suppkey AS mode FROM (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_suppkey) AS rn FROM repeated GROUP BY 1, 2) WHERE rn = 1", "repeated"))


def e16(s, d):
    li = view(s, d, "lineitem").withColumn("setting", F.concat_ws("/", "l_returnflag", "l_linestatus"))
    return agg.mode(li, ["l_suppkey"], "setting")


Q["e16_most_chosen_setting"] = (e16, """SELECT l_suppkey, setting AS mode FROM (SELECT l_suppkey, concat(l_returnflag, '/', l_linestatus) AS setting,
 row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, concat(l_returnflag, '/', l_linestatus)) AS rn FROM lineitem GROUP BY 1, 2) WHERE rn = 1""")
Q["e17_basic_problems"] = (lambda s, d: agg.basic_problems(view(s, d, "raw"), ["n", "p", "k"]), oracle(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {cnt(f'{c} IS NULL OR trim({c}) = {chr(39)*2}')} AS missing, {cnt(f'trim({c}) <> {chr(39)*2} AND TRY_CAST({c} AS DOUBLE) IS NULL')} AS unreadable, {cnt(f'TRY_CAST({c} AS DOUBLE) < 0')} AS negative, {cnt(f'TRY_CAST({c} AS DOUBLE) = 0')} AS zero FROM raw" for c in "npk"), "raw"))
Q["e18_rating_class_counts"] = (lambda s, d: agg.class_counts(view(s, d, "points"), feat.CUTS), oracle(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {cnt(f'{c} < {lo}e0')} AS low, {cnt(f'{c} >= {lo}e0 AND {c} <= {hi}e0')} AS medium, {cnt(f'{c} > {hi}e0')} AS high FROM points" for c, (lo, hi) in feat.CUTS.items()), "points"))
_E = [-100.0, 0.0, 100.0, 200.0, 400.0, 5000.0, 6000.0]
Q["e19_histogram_fixed_edges"] = (lambda s, d: agg.histogram(view(s, d, "points"), "n", _E), oracle(" UNION ALL ".join(
    f"SELECT {i} AS bin, {lo}e0 AS lo, {hi}e0 AS hi, {cnt(f'n > {lo} AND n <= {hi}')} AS n FROM points" for i, (lo, hi) in enumerate(zip(_E, _E[1:]))), "points"))


def e20(s, d):
    return agg.top_values(view(s, d, "raw").withColumnRenamed("n", "v"), "v", 10)


Q["e20_most_frequent_values"] = (e20, oracle(f"SELECT n AS v, {N} AS n FROM raw WHERE n IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "raw"))


def e21(s, d):
    from terrasift.catalog.columns import numbers

    return agg.rule_failures(numbers(s, d), clean.LIMITS)


_ONE = {"n": "n > 20 AND n <= 1500", "p": "p > 1 AND p <= 300", "k": "k > 20 AND k <= 3000", "oc": "oc > 0 AND oc <= 5", "ph": "ph >= 3.5e0 AND ph <= 10.5e0", "ec": "ec > 0 AND ec <= 10"}
Q["e21_rule_failures"] = (e21, oracle(" UNION ALL ".join(f"SELECT '{c}' AS rule, {cnt(f'NOT coalesce({q}, false)')} AS rejected FROM {_NUM}" for c, q in {**_ONE, "any": _LIM}.items()), "raw"))


def e24(s, d):
    c = seasons.composite(view(s, d, "windows"), BANDS)
    return c.select("id", "c_n_dates", *[F.round(x, 6).alias(x) for x in ("c_B02", "c_B8A", "c_B12", "c_std_NDVI", "c_std_BSI", "c_NDVI", "c_RI")])


_SRC = f"(SELECT id, scene_id, {', '.join(f'any_value(({b} - 1000)/1e4) AS {b}' for b in BANDS)} FROM windows WHERE {_STRICT} GROUP BY id, scene_id)"


def _idx(name, pre=""):
    from terrasift.catalog.columns import _F

    q = INDEX_SQL[name]
    for b, f in _F.items():
        q = q.replace(f, pre + b)
    return q


Q["e24_multi_date_composite"] = (e24, oracle(f"""WITH w AS (SELECT DISTINCT ON (id, scene_id) * FROM windows WHERE {_STRICT}),
 o AS (SELECT id, {', '.join(f'({b} - 1000)/1e4 AS {b}' for b in BANDS)} FROM w WHERE {' AND '.join(f'{b} > 1000 AND {b} <= 11000' for b in BANDS)}),
 m AS (SELECT id, count(*) AS c, {', '.join(f'median({b}) AS {b}' for b in BANDS)}, stddev_samp({_idx('NDVI')}) AS sn, stddev_samp({_idx('BSI')}) AS sb FROM o GROUP BY id HAVING count(*) >= 3)
 SELECT id, CAST(c AS BIGINT) AS c_n_dates, round(B02, 6) AS "c_B02", round(B8A, 6) AS "c_B8A", round(B12, 6) AS "c_B12", round(sn, 6) AS "c_std_NDVI", round(sb, 6) AS "c_std_BSI", round({_idx('NDVI')}, 6) AS "c_NDVI", round({_idx('RI')}, 6) AS "c_RI" FROM m""", "windows"))


def e25(s, d):
    c = seasons.climate_normals(view(s, d, "climate"), ["node_x", "node_y"])
    return rnd(c, ["ppt_annual", "tmax_mean", "tmin_mean", "ppt_monsoon", "tmean"])


Q["e25_climate_normals"] = (e25, oracle("""SELECT node_x, node_y, round(avg(ppt)*12, 6) AS ppt_annual, round(avg(tmax), 6) AS tmax_mean, round(avg(tmin), 6) AS tmin_mean,
 round(avg(ppt) FILTER (month(dt) BETWEEN 6 AND 9)*4, 6) AS ppt_monsoon, round((avg(tmax) + avg(tmin))/2, 6) AS tmean FROM climate GROUP BY 1, 2""", "climate"))

_VEG = ["ndvi_kharif_max", "green_kharif_freq", "ndvi_rabi_max", "green_rabi_freq", "ndvi_zaid_max", "green_zaid_freq", "n_seasons_green", "irrig_proxy", "ndvi_amp", "ndvi_mean", "ndvi_interannual_sd"]


def e26(s, d):
    return rnd(seasons.vegetation(view(s, d, "series")), _VEG)


_YR = f"""y AS (SELECT id, {AGY} AS ay, max(ndvi) FILTER ({SEASON} = 'kharif') AS kharif, max(ndvi) FILTER ({SEASON} = 'rabi') AS rabi, max(ndvi) FILTER ({SEASON} = 'zaid') AS zaid,
 max(ndvi) AS hi, min(ndvi) AS lo, avg(ndvi) AS mean FROM series GROUP BY 1, 2)"""
_G = "CAST(coalesce({} > 4e-1, false) AS INTEGER)"
Q["e26_e27_e28_vegetation_seasons"] = (e26, oracle("WITH " + _YR + " SELECT id, " + ", ".join(f"round(avg({s}), 6) AS ndvi_{s}_max, round(avg(CAST({s} > 4e-1 AS INTEGER)), 6) AS green_{s}_freq" for s in ("kharif", "rabi", "zaid"))
    + f""", round(avg({_G.format('kharif')} + {_G.format('rabi')} + {_G.format('zaid')}) FILTER (coalesce(kharif, rabi, zaid) IS NOT NULL), 6) AS n_seasons_green,
 round(avg(greatest({_G.format('rabi')}, {_G.format('zaid')})) FILTER (coalesce(kharif, rabi, zaid) IS NOT NULL), 6) AS irrig_proxy,
 round(avg(hi - lo), 6) AS ndvi_amp, round(avg(mean), 6) AS ndvi_mean, round(stddev_samp(mean), 6) AS ndvi_interannual_sd FROM y GROUP BY 1""", "series"))


def e29(s, d):
    t = view(s, d, "series").withColumns({"vv": feat.db(F.col("vv")), "vh": feat.db(F.col("vh")), "season": F.when(F.month("dt").between(7, 10), "kharif").otherwise("dry")})
    r = seasons.radar(t)
    return rnd(r, [c for c in r.columns if c != "id"])


_SE = "CASE WHEN month(dt) BETWEEN 7 AND 10 THEN 'kharif' ELSE 'dry' END"
Q["e29_radar_statistics"] = (e29, oracle(f"WITH t AS (SELECT id, {_SE} AS se, 10*log10(vv) AS vv, 10*log10(vh) AS vh FROM series WHERE vv > 0 AND vh > 0) SELECT id, " + ", ".join(
    f"round({fn} FILTER (se = '{se}'), 6) AS s1_{nm}_{se}" for nm, fn in (("vv_med", "median(vv)"), ("vh_med", "median(vh)"), ("vh_sd", "stddev_samp(vh)"), ("vv_min", "min(vv)"), ("flood_freq", "avg(CAST(vv < -18 AS INTEGER))")) for se in ("kharif", "dry"))
    + ", round(median(vh) FILTER (se = 'kharif') - median(vh) FILTER (se = 'dry'), 6) AS s1_vh_change FROM t GROUP BY 1", "series"))

CODES = {"crop": 5, "built": 7, "trees": 2, "water": 1}


def yearly(s, d):
    t = view(s, d, "series").withColumn("year", F.year("dt"))
    return t.groupBy("id", "year").agg(F.min(F.struct("l_orderkey", "l_linenumber", "ndvi", "cls")).alias("m")).select("id", "year", "m.cls")


Q["e30_f09_land_cover_years"] = (lambda s, d: seasons.landcover_years(yearly(s, d), codes=CODES), oracle("""WITH t AS (SELECT id, CAST(year(dt) AS INTEGER) AS yr, CAST(min(struct_pack(a := l_orderkey, b := l_linenumber, c := ndvi, e := cls)).e AS INTEGER) AS cls FROM series GROUP BY 1, 2),
 u AS (SELECT *, CASE WHEN lag(cls) OVER w <> cls AND lag(yr) OVER w = yr - 1 THEN 1 ELSE 0 END AS chg FROM t WINDOW w AS (PARTITION BY id ORDER BY yr)) SELECT id, """
    + ", ".join(f"{cnt(f'cls = {c}')} AS {n}_years" for n, c in CODES.items()) + f", {N} AS n_years, CAST(sum(chg) AS BIGINT) AS changes FROM u GROUP BY 1", "series"))


def e31(s, d):
    burns = view(s, d, "series").filter("cls = 3").select("id", (F.col("qa") == 0).cast("int").alias("b"), F.lit(1).alias("b3"))
    return seasons.burn_months(burns, view(s, d, "points").select("id"))


Q["e31_burn_months"] = (e31, oracle("""SELECT p.id, coalesce(a, 0) AS burn_months, coalesce(c, 0) AS burn_months_near FROM points p LEFT JOIN
 (SELECT id, CAST(sum(CAST(qa = 0 AS INTEGER)) AS BIGINT) AS a, CAST(count(*) AS BIGINT) AS c FROM series WHERE cls = 3 GROUP BY 1) b ON p.id = b.id""", "points", "series"))


def e32(s, d):
    g = view(s, d, "grid").withColumns({"wr": F.floor(F.col("r") / 3), "wc": F.floor(F.col("col") / 3)})
    return rnd(seasons.window_stats(g, ["tile", "wr", "wc"]), ["median", "lo", "hi"])


Q["e32_window_statistics"] = (e32, oracle(f"""WITH g AS (SELECT *, CAST(floor(r/3) AS BIGINT) AS wr, CAST(floor(col/3) AS BIGINT) AS wc FROM grid),
 m AS (SELECT tile, wr, wc, cls, row_number() OVER (PARTITION BY tile, wr, wc ORDER BY count(*) DESC, cls) AS rn FROM g GROUP BY 1, 2, 3, 4)
 SELECT g.tile, g.wr, g.wc, round(median(value), 6) AS median, {N} AS n, round(min(value), 6) AS lo, round(max(value), 6) AS hi, any_value(m.cls) AS major
 FROM g JOIN m ON g.tile = m.tile AND g.wr = m.wr AND g.wc = m.wc AND m.rn = 1 GROUP BY 1, 2, 3""", "grid"))
Q["e33_block_class_fraction"] = (lambda s, d: rnd(grid.block_fraction(view(s, d, "grid"), 10, {"irrigated": 2, "rainfed": 3}), ["irrigated", "rainfed"]), oracle(
    f"SELECT tile, CAST(floor(r/10) AS BIGINT) AS br, CAST(floor(col/10) AS BIGINT) AS bc, round(avg(CAST(cls = 2 AS INTEGER)), 6) AS irrigated, round(avg(CAST(cls = 3 AS INTEGER)), 6) AS rainfed, {N} AS cells FROM grid GROUP BY 1, 2, 3", "grid"))


# ---- scores: prediction = a straight line in p, k; folds by id
def pred(s, d):
    return view(s, d, "points").withColumns({"yhat": F.col("k") * 0.6 + F.col("p"), "fold": F.col("id") % 5})


_P = "(SELECT *, k*6e-1 + p AS yhat, id % 5 AS fold FROM points)"
_R2 = "1 - sum(pow(n - yhat, 2))/nullif(var_pop(n)*count(n), 0)"
_RMSE = "sqrt(avg(pow(yhat - n, 2)))"


def e36(s, d):
    return rnd(metric.scores(pred(s, d), ["region"], "n", "yhat"), ["r2", "rmse", "mae", "bias", "rpiq", "rpd", "smape"])


Q["e36_e37_e38_e39_scores"] = (e36, oracle(f"""SELECT region, {N} AS n, round({_R2}, 6) AS r2, round({_RMSE}, 6) AS rmse, round(avg(abs(yhat - n)), 6) AS mae, round(avg(yhat - n), 6) AS bias,
 round((quantile_cont(n, 0.75) - quantile_cont(n, 0.25))/{_RMSE}, 6) AS rpiq, round(stddev_samp(n)/{_RMSE}, 6) AS rpd, round(avg(abs(yhat - n)/((abs(n) + abs(yhat))/2)), 6) AS smape FROM {_P} GROUP BY 1""", "points"))
Q["e40_fold_r2_mean_sd"] = (lambda s, d: rnd(metric.by_fold(pred(s, d), ["region"], "fold", "n", "yhat"), ["mean_r2", "sd_r2"]), oracle(
    f"SELECT region, round(avg(r), 6) AS mean_r2, round(stddev_samp(r), 6) AS sd_r2, {N} AS folds FROM (SELECT region, fold, {_R2} AS r FROM {_P} GROUP BY 1, 2) GROUP BY 1", "points"))


def rated(s, d):
    p = pred(s, d)
    return p.select("region", feat.rating(F.col("n"), 280.0, 560.0).alias("y"), feat.rating(F.col("yhat"), 280.0, 560.0).alias("c"))


_C = f"(SELECT region, CASE WHEN n < 280 THEN 0 WHEN n <= 560 THEN 1 ELSE 2 END AS y, CASE WHEN yhat < 280 THEN 0 WHEN yhat <= 560 THEN 1 ELSE 2 END AS c FROM {_P})"
Q["e41_confusion_matrix"] = (lambda s, d: metric.confusion(rated(s, d), ["region"], "y", "c", [0, 1, 2]), oracle(
    f"SELECT region, y, {cnt('c = 0')} AS \"0\", {cnt('c = 1')} AS \"1\", {cnt('c = 2')} AS \"2\", CAST(0 AS BIGINT) AS other FROM {_C} GROUP BY 1, 2", "points"))
_REC = [f"count(*) FILTER (y = {c} AND c = {c})/nullif(count(*) FILTER (y = {c}), 0)" for c in range(3)]
_F1 = [f"CASE WHEN count(*) FILTER (y = {c}) > 0 THEN 2*count(*) FILTER (y = {c} AND c = {c})/(count(*) FILTER (y = {c}) + count(*) FILTER (c = {c})) END" for c in range(3)]
Q["e42_class_scores"] = (lambda s, d: rnd(metric.classes(rated(s, d), ["region"], "y", "c"), ["accuracy", "balanced_accuracy", "macro_f1", "recall_0", "recall_1", "recall_2"]), oracle(
    f"SELECT region, {N} AS n, round(avg(CAST(y = c AS INTEGER)), 6) AS accuracy, round(list_avg([{', '.join(_REC)}]), 6) AS balanced_accuracy, round(list_avg([{', '.join(_F1)}]), 6) AS macro_f1, "
    + ", ".join(f"round({r}, 6) AS recall_{i}" for i, r in enumerate(_REC)) + f" FROM {_C} GROUP BY 1", "points"))
Q["e43_class_shares"] = (lambda s, d: rnd(agg.shares(rated(s, d), ["region"], "y"), ["pct"]), oracle(
    f"SELECT region, y, {N} AS n, round(count(*)*1e2/sum(count(*)) OVER (PARTITION BY region), 6) AS pct FROM {_C} GROUP BY 1, 2", "points"))


def e44(s, d):
    return rnd(metric.pooled_var(view(s, d, "points"), ["region"], ["spot"], "n"), ["pooled_var"])


Q["e44_pooled_variance"] = (e44, oracle("SELECT region, round(sum(pow(n - m, 2))/(count(*) - count(DISTINCT spot)), 6) AS pooled_var FROM (SELECT *, avg(n) OVER (PARTITION BY region, spot) AS m FROM points) GROUP BY 1", "points"))


def e45(s, d):
    from terrasift.operators import groups

    p = groups.size(view(s, d, "points"), ["spot"], "m")
    return rnd(metric.noise_ceiling(p, ["n", "p", "oc"], ["spot"], ["did"], F.col("m").between(2, 10)), ["var_same_spot", "var_within_district", "var_total", "share_between", "ceiling"])


def _nc(c):
    return f"""SELECT '{c}' AS target, sp.v AS a, di.v AS b, (SELECT var_samp(ln(1 + {c})) FROM points) AS t FROM
 (SELECT sum(pow(v - m, 2))/(count(*) - count(DISTINCT spot)) AS v FROM (SELECT spot, ln(1 + {c}) AS v, avg(ln(1 + {c})) OVER (PARTITION BY spot) AS m, count(*) OVER (PARTITION BY spot) AS k_ FROM points) WHERE k_ BETWEEN 2 AND 10) sp,
 (SELECT sum(pow(v - m, 2))/(count(*) - count(DISTINCT did)) AS v FROM (SELECT did, ln(1 + {c}) AS v, avg(ln(1 + {c})) OVER (PARTITION BY did) AS m FROM points)) di"""


Q["e45_noise_ceiling"] = (e45, oracle("SELECT target, round(a, 6) AS var_same_spot, round(b, 6) AS var_within_district, round(t, 6) AS var_total, round(1 - b/t, 6) AS share_between, round(1 - a/b, 6) AS ceiling FROM (" + " UNION ALL ".join(_nc(c) for c in ("n", "p", "oc")) + ")", "points"))
Q["e46_variance_share"] = (lambda s, d: rnd(metric.variance_share(view(s, d, "points"), "n", F.col("did") == 491), ["share"]), oracle(
    f"SELECT {cnt('did = 491')} AS rows, round(sum(pow(n - m, 2)) FILTER (did = 491)/sum(pow(n - m, 2)), 6) AS share FROM (SELECT *, avg(n) OVER () AS m FROM points)", "points"))
Q["e51_pearson"] = (lambda s, d: view(s, d, "points").groupBy("region").agg(F.round(F.corr("n", "k"), 6).alias("r")), oracle("SELECT region, round(corr(n, k), 6) AS r FROM points GROUP BY 1", "points"))
_RK = "rank() OVER (PARTITION BY region ORDER BY {0}) + (count(*) OVER (PARTITION BY region, {0}) - 1)/2e0"
Q["e52_f12_spearman_in_group"] = (lambda s, d: rnd(metric.spearman(view(s, d, "points"), ["region"], "ph", "n"), ["rho"]), oracle(
    f"SELECT region, round(corr(a, b), 6) AS rho, {N} AS n FROM (SELECT region, {_RK.format('ph')} AS a, {_RK.format('n')} AS b FROM points) GROUP BY 1", "points"))
Q["e55_mean_within_group_score"] = (lambda s, d: rnd(metric.within(pred(s, d), ["did"], "n", "yhat", 20), ["within_r2"]), oracle(
    f"SELECT round(avg(r), 6) AS within_r2, {N} AS groups FROM (SELECT did, {_R2} AS r, count(*) AS c FROM {_P} GROUP BY 1 HAVING count(*) >= 20)", "points"))


# ---- result tables: a score per (seed = user_id % 7, model = event_type, region)
def results(s, d):
    return view(s, d, "points").groupBy((F.col("user_id") % 7).alias("seed"), F.col("event_type").alias("model"), "region").agg(F.avg("n").alias("score"))


_RES = "(SELECT user_id % 7 AS seed, event_type AS model, region, avg(n) AS score FROM points GROUP BY 1, 2, 3)"
Q["e57_summary_over_seeds"] = (lambda s, d: rnd(agg.over_seeds(results(s, d), ["model", "region"], "score"), ["mean", "sd", "min", "max"]), oracle(
    f"SELECT model, region, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, round(min(score), 6) AS min, round(max(score), 6) AS max, {N} AS runs FROM {_RES} GROUP BY 1, 2", "points"))
Q["e58_gain_table"] = (lambda s, d: rnd(agg.gain(results(s, d), ["region"], "model", "view", "click", "score"), ["first", "second", "gain"]), oracle(
    f"SELECT region, round(avg(score) FILTER (model = 'view'), 6) AS first, round(avg(score) FILTER (model = 'click'), 6) AS second, round(avg(score) FILTER (model = 'view') - avg(score) FILTER (model = 'click'), 6) AS gain FROM {_RES} GROUP BY 1", "points"))
Q["e59_best_model"] = (lambda s, d: rnd(agg.best(results(s, d), ["seed", "region"], "model", "score"), ["score"]), oracle(
    f"SELECT seed, region, model, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY seed, region ORDER BY score DESC, model) AS rn FROM {_RES}) WHERE rn = 1", "points"))


def e60(s, d):
    return rnd(metric.share_by_group(results(s, d), ["region"], "model", "score"), ["v", "share"])


Q["e60_f10_share_by_group"] = (e60, oracle(f"SELECT region, model, round(sum(score), 6) AS v, round(sum(score)/sum(sum(score)) OVER (PARTITION BY region), 6) AS share FROM {_RES} GROUP BY 1, 2", "points"))


def e61(s, d):
    return agg.duplicates(view(s, d, "repeated"), ["n", "p", "k"])


Q["e61_duplicate_records"] = (e61, oracle(f"SELECT {N} AS groups, {cnt('m > 1')} AS repeated_groups, CAST(sum(CASE WHEN m > 1 THEN m ELSE 0 END) AS BIGINT) AS rows_in_repeated, CAST(max(m) AS BIGINT) AS largest FROM (SELECT count(*) AS m FROM repeated GROUP BY n, p, k)", "repeated"))


def e63(s, d):
    p = view(s, d, "points").select("region", "n", "k", (F.col("lon") * 100).alias("x"), (F.col("lat") * 110).alias("y"))
    from terrasift.operators import groups

    p = groups.attach(p, ["region"], F.avg("x").alias("nx"), F.avg("y").alias("ny")).withColumns({"px": F.col("nx") + F.col("n") / 10 - 30, "py": F.col("ny") + F.col("k") / 10 - 40})
    return rnd(metric.position_error(p, ["region"]), ["model_err_p50", "null_err_p50", "ratio"])


Q["e63_position_error"] = (e63, oracle("""WITH t AS (SELECT region, lon*100 AS x, lat*110 AS y, n, k, avg(lon*100) OVER (PARTITION BY region) AS nx, avg(lat*110) OVER (PARTITION BY region) AS ny FROM points),
 e AS (SELECT region, sqrt(pow(nx + n/10 - 30 - x, 2) + pow(ny + k/10 - 40 - y, 2)) AS a, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS b FROM t)
 SELECT region, round(median(a), 6) AS model_err_p50, round(median(b), 6) AS null_err_p50, round(median(a)/median(b), 6) AS ratio FROM e GROUP BY 1""", "points"))


def e64(s, d):
    p = view(s, d, "points")
    a = p.groupBy("did").agg(F.count("*").alias("samples"), F.count_if(F.col("n") > 500).alias("n_hi"))
    j = a.join(medians(p, ["did"], ["n"]), "did")
    return rnd(j.withColumn("pct_hi", F.round(F.col("n_hi") * 100.0 / F.col("samples"), 1)).orderBy(F.desc("n_hi"), "did"), ["n"])


Q["e64_high_value_concentration"] = (e64, oracle(f"SELECT did, {N} AS samples, {cnt('n > 500')} AS n_hi, round(median(n), 6) AS n, round(count(*) FILTER (n > 500)*1e2/count(*), 1) AS pct_hi FROM points GROUP BY 1", "points"))


def e65(s, d):
    p = view(s, d, "points").withColumns({f"{c}_hi": F.when((F.col("n") > 500) & (F.col("did") == 480), F.col(c)) for c in ("p", "k", "oc", "ph")})
    q = quantiles(p, [], ["p_hi", "k_hi", "oc_hi", "ph_hi", "p", "k", "oc", "ph"], [0.5])
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


Q["e65_group_vs_all_medians"] = (e65, oracle("SELECT " + ", ".join(f"round(median({c}) FILTER (n > 500 AND did = 480), 6) AS {c}_hi_p50, round(median({c}), 6) AS {c}_p50" for c in ("p", "k", "oc", "ph")) + " FROM points", "points"))
