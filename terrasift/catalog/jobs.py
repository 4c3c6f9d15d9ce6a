"""Model jobs. Trees and rounds are small here; the defaults of the library are the full settings."""

from pyspark.sql import functions as F

from terrasift.catalog.aggregates import rnd
from terrasift.catalog.designs import HELD, blocked, test_sql, u
from terrasift.catalog.joining import BLK10, DIST, T, fold_sql, folded, pts, top
from terrasift.catalog.places import blk
from terrasift.functions import feat, geo
from terrasift.operators import cluster, features, links, sampling
from terrasift.plans import designs, learn, linear, models
from terrasift.session import cut
from terrasift.sources.views import FEATURE_COLS, oracle, view

Q = QUERIES = {}
IN = ["ph", "ec", "oc", "p", "lon", "lat"]
Y = "n"
REGIONS = list(range(5))


def rf():
    return learn.forest(trees=10, depth=6)


def gb():
    return learn.boosted(rounds=8, rate=0.3, depth=4)


def ridge():
    return learn.linear(0.01)


def model(est=None, feats=IN, y=Y, **kw):
    return learn.regressor(est if est is not None else ridge(), feats, y, **kw)


def oof(s, d, m, y=Y):
    return learn.score(learn.out_of_fold(folded(s, d), m, "fold", 5), ["fold"], y)


def narrow(p, *more):
    """The columns that the jobs below read."""
    return p.select("id", "x", "y", "fold", Y, *IN, *more)


def k04(s, d):
    f = view(s, d, "features").withColumn("fold", (F.col("id") % 5).cast("int"))
    z = features.standardise(f, FEATURE_COLS)
    p = features.knn_predict(z, FEATURE_COLS, "label", 15, "fold")
    return rnd(p.select("id", "fold", "pred", "pred_uniform"), ["pred", "pred_uniform"], 5)


_FS = ", ".join(f"({c} - avg({c}) OVER ())/stddev_pop({c}) OVER () AS {c}" for c in FEATURE_COLS)
_FD = "sqrt(" + " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in FEATURE_COLS) + ")"
Q["k04_feature_space_knn"] = (k04, oracle(f"""WITH z AS (SELECT id, CAST(id % 5 AS INTEGER) AS fold, label, {_FS} FROM features),
 k AS (SELECT id, fold, unnest(l) AS z FROM (SELECT a.id, a.fold, min(struct_pack(d := round({_FD}, 6), nb := b.id, v := b.label), 15) AS l FROM z a JOIN z b ON a.fold <> b.fold GROUP BY 1, 2))
 SELECT id, fold, round(sum(z.v/greatest(z.d, 1e-9))/sum(1/greatest(z.d, 1e-9)), 5) AS pred, round(avg(z.v), 5) AS pred_uniform FROM k GROUP BY 1, 2""", "features"))
Q["i07_environmental_zones"] = (lambda s, d: learn.zones(view(s, d, "points").select("id", "n", "p", "k", "ph", "ec"), ["n", "p", "k", "ph", "ec"], 20).groupBy("zone").agg(F.count("*").alias("n")), None)
Q["k09_random_forest"] = (lambda s, d: oof(s, d, model(rf())), None)
Q["k10_all_feature_forest"] = (lambda s, d: oof(s, d, model(learn.forest(trees=10, depth=6, subset="all"))), None)
Q["k11_boosted_trees"] = (lambda s, d: oof(s, d, model(gb())), None)
Q["k12_decision_tree"] = (lambda s, d: oof(s, d, model(learn.tree())), None)


def k13(s, d):
    named = {"least squares": (0.0, 0.0), "ridge": (0.1, 0.0), "lasso": (0.01, 1.0), "elastic net": (0.01, 0.5)}
    return learn.score(linear.out_of_fold(folded(s, d), named, IN, Y, "fold"), ["model"], Y)


Q["k13_linear_models"] = (k13, None)


def k14(s, d):
    p = designs.random_holdout(pts(s, d), "id", 0.3, 42)
    runs = {"linear": learn.linear(0.0), "forest": rf(), "boosted": gb()}
    return learn.score(learn.label_all([({"model": n}, learn.holdout(p, model(e, log=False, clip=False)).select(Y, "pred")) for n, e in runs.items()]), ["model"], Y)


Q["k14_replication_without_log"] = (k14, None)


def classes(s, d, kinds):
    from terrasift.operators import metric

    p = cut(folded(s, d).select("fold", feat.rating(F.col("n"), 280.0, 560.0).alias("cls"), *IN))  # the models read it many times
    parts = [({"model": k}, learn.out_of_fold(p, learn.classifier(k, IN, "cls", trees=10), "fold", 5, stored=True).select("cls", "pred")) for k in kinds]
    return metric.classes(learn.label_all(parts), ["model"], "cls", "pred")


Q["k15_class_models"] = (lambda s, d: classes(s, d, ["logistic", "forest"]), None)
Q["k16_linear_svc"] = (lambda s, d: classes(s, d, ["svc"]), None)


def k17(s, d):
    from terrasift.plans.jobs import literal_table

    tr = designs.group_folds(designs.random_holdout(pts(s, d), "spot", 0.3, 42).filter("is_test = 0"), "spot", 3, 7, "inner")
    _, rows = learn.tune(tr, learn.linear(), {"regParam": [0.001, 0.1, 1.0], "elasticNetParam": [0.0, 0.5]}, IN, Y, "inner")
    return literal_table(s, [(float(p["regParam"]), float(p["elasticNetParam"]), float(v)) for p, v in rows], ["reg", "l1", "inner_r2"])


Q["k17_tuning_on_training_blocks"] = (k17, None)
Q["k18_two_stage"] = (lambda s, d: learn.two_stage(folded(s, d), model(rf(), y="__r", log=False), Y, "did", "fold", 5), None)


def k19(s, d):
    p = learn.stack(folded(s, d), {"ridge": model(), "tree": model(learn.tree())}, Y, "fold", 5)
    from terrasift.operators import metric

    return p.agg(F.count("*").alias("n"), *[metric.r2(Y, c).alias(f"r2_{c}") for c in ("ridge", "tree", "average", "stacked")])


Q["k19_stacking"] = (k19, None)


def kriged(s, d):
    p = folded(s, d).select("id", "x", "y", "n", "fold", F.log1p("n").alias("z"))
    return learn.kriging_out_of_fold(p, "z", "fold", 5).withColumn("pred", F.expm1("kriged"))


Q["k20_ordinary_kriging"] = (lambda s, d: learn.score(kriged(s, d), ["fold"], Y), None)


def k21(s, d):
    p = designs.random_holdout(designs.blocks(pts(s, d), 10, 3, 42, ), "spot", 0.3, 42).withColumn("z", F.log1p("n"))
    p = cut(p.select("id", "x", "y", Y, *IN, "fold", "is_test", "z"))
    tr, te = p.filter("is_test = 0"), p.filter("is_test = 1")
    inner = learn.out_of_fold(tr, model(), "fold", 3).withColumn("res", F.log1p("n") - F.log1p("pred")).drop("pred")
    reg = learn.kriging(inner, model()(tr, te).withColumnRenamed("pred", "base"), "res").withColumn("pred", F.expm1(F.log1p("base") + F.col("kriged")))
    fits = learn.variograms(tr, "z", "fold", [-1, 0, 1, 2])
    kr = learn.kriging_out_of_fold(tr, "z", "fold", 3, fits=fits)
    hyb = model(feats=[*IN, "kriged"])(kr, learn.kriging(tr, te, "z", model=fits[-1]))
    return learn.score(learn.label_all([({"method": "regression kriging"}, reg.select(Y, "pred")), ({"method": "kriged value as input"}, hyb.select(Y, "pred"))]), ["method"], Y)


Q["k21_regression_kriging_and_hybrid"] = (k21, None)
Q["k22_region_wise"] = (lambda s, d: learn.region_wise(folded(s, d), model(), "ridge", "region", REGIONS, Y, "fold", 5), None)
Q["k23_region_vs_state"] = (lambda s, d: learn.region_vs_state(folded(s, d), model(), "region", REGIONS, Y, "fold", 5), None)
Q["k24_inflation"] = (lambda s, d: learn.inflation(pts(s, d), model(), Y, (10, 25, 50, 100)), None)


def k25(s, d):
    p = pts(s, d).select("id", "spot", Y, *IN)
    merged = cluster.merge(cluster.drop_large(p, "spot").drop("site_size"), ["n", *IN], site="spot")
    linked = links.via_members(merged.select(F.col("id").alias("loc_id"), "ids_merged", F.col("n").alias("loc_n")), p, "loc_id")
    return learn.split_comparison(linked, merged, model(), Y)


Q["k25_clustered_vs_declustered"] = (k25, None)


def k26(s, d):
    sets = {"soil": ["ph", "ec"], "+ nutrients": ["ph", "ec", "oc", "p"], "+ place": IN, "place only": ["lon", "lat"]}
    return learn.ablation(narrow(folded(s, d)), lambda f: model(feats=f), sets | learn.without_each({"soil": ["ph", "ec"], "nutrients": ["oc", "p"], "place": ["lon", "lat"]}), Y, "fold", 5)


Q["k26_input_ablation"] = (k26, None)
Q["k27_block_size_curve"] = (lambda s, d: learn.block_size(pts(s, d), model(), Y), None)
RAD = [0, 5000, 20000, 50000]


def k28(s, d):
    p = blocked(s, d)
    held = sampling.sample_keys(p, "block", 30, 42, 5)
    return rnd(learn.distance_curve(p, Y, "block", held, RAD), ["r2"], 5)


_H30 = HELD.replace("LIMIT 100", "LIMIT 30")
Q["k28_distance_curve"] = (k28, oracle(f"""WITH {T}, {_H30}, te AS (SELECT b.*, held FROM b JOIN h ON b.block = h.held), nd AS (SELECT h.held, a.id, any_value(a.x) AS x, any_value(a.y) AS y, any_value(a.n) AS n, round(min({DIST}), 3) AS bd FROM h JOIN b ON b.block = h.held JOIN b a ON a.block <> h.held GROUP BY 1, 2),
 ok AS (SELECT held, r FROM (SELECT held, r, count(*) FILTER (bd > r) AS c FROM nd, (VALUES {', '.join(f'({r})' for r in RAD)}) v(r) GROUP BY 1, 2) WHERE c >= 300), jb AS (SELECT * FROM ok WHERE held IN (SELECT held FROM ok WHERE r = 50000)),
 k AS (SELECT kid, r, unnest(l) AS z FROM (SELECT a.id AS kid, v.r AS r, min(struct_pack(d := round({DIST}, 3), nb := b.id, v := ln(1 + b.n)), 10) AS l FROM (VALUES {', '.join(f'({r})' for r in RAD)}) v(r), te a JOIN nd b ON a.held = b.held JOIN jb ON jb.held = a.held WHERE b.bd > v.r AND jb.r = v.r GROUP BY 1, 2)),
 pr AS (SELECT kid, r, exp(sum(z.v/greatest(z.d, 30))/sum(1/greatest(z.d, 30))) - 1 AS yhat FROM k GROUP BY 1, 2)
 SELECT r*1e0 AS radius_m, CAST(count(*) AS BIGINT) AS n_test, CAST(count(DISTINCT held) AS BIGINT) AS blocks, round(1 - sum(pow(n - yhat, 2))/nullif(var_pop(n)*count(n), 0), 5) AS r2 FROM pr JOIN te ON te.id = kid GROUP BY r HAVING count(*) >= 100""", "points"))
Q["k29_seed_repeats"] = (lambda s, d: learn.seed_repeats(pts(s, d), model(), Y), None)
Q["k30_reverse_position"] = (lambda s, d: learn.reverse_position(narrow(folded(s, d), "k"), lambda f, c: model(feats=f, y=c, log=False), {"soil": ["ph", "ec"], "nutrients": ["n", "p", "k"]}, "fold", 5), None)
Q["k31_sensor_noise"] = (lambda s, d: learn.noise(narrow(folded(s, d)), lambda f: model(feats=f), IN, Y, "fold", 5), None)
Q["k32_importance"] = (lambda s, d: learn.importance(pts(s, d), rf(), IN, Y), None)
Q["k33_model_comparison"] = (lambda s, d: learn.model_comparison(narrow(folded(s, d)), {"ridge": model(), "tree": model(learn.tree()), "forest": model(rf()), "boosted": model(gb())}, Y, "fold", 5), None)
Q["k34_transfer_to_unseen_groups"] = (lambda s, d: learn.transfer(pts(s, d).select("id", "x", "y", Y, "did", "ph", "ec", "oc"), ridge(), ["ph", "ec", "oc"], Y, {"district": ("did", 3)}), None)


# ---- the same jobs on closed-form models, with exact DuckDB text
def scored_sql(keys, rel):
    """Score columns of learn.score over a relation with n and yhat."""
    rm = "sqrt(avg(pow(yhat - n, 2)))"
    return f"""SELECT {keys}, CAST(count(n) AS BIGINT) AS n, round(1 - sum(pow(n - yhat, 2))/nullif(var_pop(n)*count(n), 0), 5) AS r2, round({rm}, 4) AS rmse, round(avg(abs(yhat - n)), 4) AS mae, round(avg(yhat - n), 4) AS bias,
 round((quantile_cont(n, 0.75) - quantile_cont(n, 0.25))/{rm}, 5) AS rpiq, round(stddev_samp(n)/{rm}, 5) AS rpd, round(avg(abs(yhat - n)/((abs(n) + abs(yhat))/2)), 5) AS smape FROM ({rel}) GROUP BY ALL"""


def score5(df):
    return rnd(rnd(df, ["r2", "rpiq", "rpd", "smape"], 5), ["rmse", "mae", "bias"], 4)


def fitted_sql(x, src="f", keys=(), log=True, test="fold"):
    """Every row of src with yhat from the line through the rows of the other folds (of the same keys)."""
    t, same = ("ln(1 + c.n)" if log else "c.n"), "".join(f" AND c.{k} = o.{k}" for k in keys)
    k = "".join(f", o.{c}" for c in keys)
    y = "a.c0 + a.c1*u.{}".format(x)
    return f"""SELECT u.*, {f'exp({y}) - 1' if log else y} AS yhat FROM {src} u JOIN (SELECT o.{test}{k}, regr_slope({t}, c.{x}) AS c1, regr_intercept({t}, c.{x}) AS c0
 FROM (SELECT DISTINCT {', '.join([test, *keys])} FROM {src}) o JOIN {src} c ON c.{test} <> o.{test}{same} GROUP BY ALL) a USING ({', '.join([test, *keys])})"""


FOLDED = f"WITH {T}, {fold_sql(BLK10)}"
R2 = "round(1 - sum(pow(n - yhat, 2))/nullif(var_pop(n)*count(n), 0), 5)"
by_line = learn.line


def on(km=10, seed=42):
    return f"WITH {T}, {fold_sql(blk(km, 'x', 'y'), seed=seed)}"


Q["k13_line_per_input"] = (lambda s, d: score5(learn.score(learn.label_all([({"inputs": c}, learn.out_of_fold(folded(s, d), by_line(c, Y), "fold", 5).select(Y, "pred")) for c in IN]), ["inputs"], Y)),
                           oracle(FOLDED + " " + " UNION ALL ".join(f"SELECT * FROM ({scored_sql('inputs', f'SELECT {chr(39)}{c}{chr(39)} AS inputs, n, yhat FROM ({fitted_sql(c)})')})" for c in IN), "points"))


def k14_line(s, d):
    return score5(learn.score(learn.holdout(designs.random_holdout(pts(s, d), "id", 0.3, 42), by_line("k", Y, log=False)).withColumn("model", F.lit("line")), ["model"], Y))


_H = f"h AS (SELECT *, {test_sql('id', 0.3)} AS is_test FROM t)"
Q["k14_line_without_log"] = (k14_line, oracle(f"WITH {T}, {_H} " + scored_sql("model", "SELECT 'line' AS model, u.n, a.c0 + a.c1*u.k AS yhat FROM h u, (SELECT regr_slope(n, k) AS c1, regr_intercept(n, k) AS c0 FROM h WHERE is_test = 0) a WHERE is_test = 1"), "points"))
_GM = """gm AS (SELECT o.fold, c.did, avg(ln(1 + c.n)) AS g FROM (SELECT DISTINCT fold FROM f) o JOIN f c ON c.fold <> o.fold GROUP BY ALL), am AS (SELECT o.fold, avg(ln(1 + c.n)) AS a FROM (SELECT DISTINCT fold FROM f) o JOIN f c ON c.fold <> o.fold GROUP BY ALL)"""


def k18_line(s, d):
    return rnd(learn.two_stage(folded(s, d), by_line("k", "__r", log=False), Y, "did", "fold", 5), ["group_r2", "r2", "within_r2"], 5)


Q["k18_two_stage_line"] = (k18_line, oracle(f"""{FOLDED}, {_GM}, rs AS (SELECT o.fold, regr_slope(ln(1 + c.n) - g, c.k) AS c1, regr_intercept(ln(1 + c.n) - g, c.k) AS c0 FROM (SELECT DISTINCT fold FROM f) o JOIN f c ON c.fold <> o.fold JOIN gm ON gm.fold = o.fold AND gm.did = c.did GROUP BY ALL),
 p AS (SELECT u.n, coalesce(gm.g, am.a) AS b, rs.c0 + rs.c1*u.k AS r FROM f u JOIN am USING (fold) JOIN rs USING (fold) LEFT JOIN gm ON gm.fold = u.fold AND gm.did = u.did)
 SELECT CAST(count(*) AS BIGINT) AS n, round(1 - sum(pow(n - exp(b) + 1, 2))/(var_pop(n)*count(n)), 5) AS group_r2, round(1 - sum(pow(n - exp(b + r) + 1, 2))/(var_pop(n)*count(n)), 5) AS r2,
 round(1 - sum(pow(ln(1 + n) - b - r, 2))/(var_pop(ln(1 + n) - b)*count(n)), 5) AS within_r2 FROM p""", "points"))


def k19_line(s, d):
    p = learn.stack(folded(s, d), {"by_group": learn.mean_of("did", Y), "by_line": by_line("k", Y)}, Y, "fold", 5)
    from terrasift.operators import metric

    return p.agg(F.count("*").alias("n"), *[F.round(metric.r2(Y, c), 5).alias(f"r2_{c}") for c in ("by_group", "by_line", "average", "stacked")])


_TWO = "(SELECT a.fold AS f, b.fold AS g FROM (SELECT DISTINCT fold FROM f) a JOIN (SELECT DISTINCT fold FROM f) b ON a.fold <> b.fold)"
Q["k19_stacking_closed_form"] = (k19_line, oracle(f"""{FOLDED}, {_GM}, ln_ AS (SELECT o.fold, regr_slope(ln(1 + c.n), c.k) AS c1, regr_intercept(ln(1 + c.n), c.k) AS c0 FROM (SELECT DISTINCT fold FROM f) o JOIN f c ON c.fold <> o.fold GROUP BY ALL),
 w AS (SELECT o.f, o.g, c.did, avg(ln(1 + c.n)) AS m FROM {_TWO} o JOIN f c ON c.fold NOT IN (o.f, o.g) GROUP BY ALL),
 wa AS (SELECT o.f, o.g, avg(ln(1 + c.n)) AS m, regr_slope(ln(1 + c.n), c.k) AS c1, regr_intercept(ln(1 + c.n), c.k) AS c0 FROM {_TWO} o JOIN f c ON c.fold NOT IN (o.f, o.g) GROUP BY ALL),
 i AS (SELECT wa.f AS outer_, ln(1 + u.n) AS t, coalesce(w.m, wa.m) AS p, wa.c0 + wa.c1*u.k AS q FROM f u JOIN wa ON wa.g = u.fold LEFT JOIN w ON w.f = wa.f AND w.g = wa.g AND w.did = u.did),
 s AS (SELECT outer_, avg(p) AS mp, avg(q) AS mq, avg(t) AS mt, var_pop(p) AS pp, var_pop(q) AS qq, covar_pop(p, q) AS pq, covar_pop(p, t) AS pt, covar_pop(q, t) AS qt, min(t) AS lo, max(t) AS hi FROM i GROUP BY 1),
 x AS (SELECT *, (pt*qq - qt*pq)/(pp*qq - pq*pq) AS wp, (qt*pp - pt*pq)/(pp*qq - pq*pq) AS wq FROM s),
 z AS (SELECT *, CASE WHEN wp >= 0 AND wq >= 0 THEN wp WHEN wp < 0 AND wq < 0 THEN CASE WHEN pt*pt/pp >= qt*qt/qq THEN greatest(pt/pp, 0) ELSE 0 END WHEN wp < 0 THEN 0 ELSE greatest(pt/pp, 0) END AS up,
  CASE WHEN wp >= 0 AND wq >= 0 THEN wq WHEN wp < 0 AND wq < 0 THEN CASE WHEN pt*pt/pp >= qt*qt/qq THEN 0 ELSE greatest(qt/qq, 0) END WHEN wq < 0 THEN 0 ELSE greatest(qt/qq, 0) END AS uq FROM x),
 o AS (SELECT u.n, coalesce(gm.g, am.a) AS p, ln_.c0 + ln_.c1*u.k AS q, z.* FROM f u JOIN am USING (fold) JOIN ln_ USING (fold) JOIN z ON z.outer_ = u.fold LEFT JOIN gm ON gm.fold = u.fold AND gm.did = u.did),
 e AS (SELECT n, exp(p) - 1 AS by_group, exp(q) - 1 AS by_line, exp(greatest(lo, least(hi, (p + q)/2))) - 1 AS average, exp(greatest(lo, least(hi, mt - up*mp - uq*mq + up*p + uq*q))) - 1 AS stacked FROM o)
 SELECT CAST(count(*) AS BIGINT) AS n, {', '.join(f"round(1 - sum(pow(n - {c}, 2))/(var_pop(n)*count(n)), 5) AS r2_{c}" for c in ('by_group', 'by_line', 'average', 'stacked'))} FROM e""", "points"))


def k20_two(s, d):
    p = folded(s, d).select("id", "x", "y", "fold", F.log1p("n").alias("z"))
    m = lambda a, b: learn.kriging(a, b, "z", k=2, model=(0.05, 0.2, 15.0)).withColumn("pred", F.col("kriged"))
    return rnd(learn.out_of_fold(p, m, "fold", 5, threads=2).select("id", "pred"), ["pred"], 5)


_GAM = "(5e-2 + 2e-1*(1 - exp(-({0})/15e0)))"
Q["k20_kriging_of_two"] = (k20_two, oracle(f"""{FOLDED}, k AS (SELECT id, l[1] AS a, l[2] AS b FROM {top(2, 'a.fold <> b.fold', 'nb := b.id, v := ln(1 + b.n), x := b.x, y := b.y', 'f', 'f')}),
 r AS (SELECT o.fold, min(ln(1 + c.n)) AS lo, max(ln(1 + c.n)) AS hi FROM (SELECT DISTINCT fold FROM f) o JOIN f c ON c.fold <> o.fold GROUP BY 1),
 w AS (SELECT k.id, (1 + ({_GAM.format('b.d/1e3')} - {_GAM.format('a.d/1e3')})/{_GAM.format('sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))/1e3')})/2 AS w, a.v AS va, b.v AS vb FROM k)
 SELECT w.id, round(greatest(lo, least(hi, w*va + (1 - w)*vb)), 5) AS pred FROM w JOIN f ON f.id = w.id JOIN r USING (fold)""", "points"))
Q["k22_region_wise_line"] = (lambda s, d: score5(learn.region_wise(folded(s, d), by_line("k", Y), "line", "region", REGIONS, Y, "fold", 5)),
                             oracle(f"{FOLDED} " + scored_sql("region, 'line' AS model", fitted_sql("k", keys=["region"])), "points"))
Q["k23_region_vs_state_line"] = (lambda s, d: rnd(learn.region_vs_state(folded(s, d), by_line("k", Y), "region", REGIONS, Y, "fold", 5), ["r2_region_model", "r2_state_model"], 5),
                                 oracle(f"{FOLDED}, own AS ({fitted_sql('k', keys=['region'])}), st AS ({fitted_sql('k')}) SELECT region, CAST(count(*) AS BIGINT) AS n, {R2} AS r2_region_model, round(1 - sum(pow(n - sy, 2))/(var_pop(n)*count(n)), 5) AS r2_state_model FROM (SELECT own.region, own.n, own.yhat, st.yhat AS sy FROM own JOIN st ON own.id = st.id) GROUP BY 1", "points"))
_RANDOM = f"(SELECT {R2} AS r FROM (SELECT u.n, exp(a.c0 + a.c1*u.k) - 1 AS yhat FROM h u, (SELECT regr_slope(ln(1 + n), k) AS c1, regr_intercept(ln(1 + n), k) AS c0 FROM h WHERE is_test = 0) a WHERE is_test = 1))"


def k24_line(s, d):
    t = learn.inflation(pts(s, d), by_line("k", Y), Y, (10, 25, 50, 100))
    return rnd(t.drop("inflation"), ["r2_random", "r2_spatial"], 5)


Q["k24_inflation_line"] = (k24_line, oracle(f"WITH {T}, {_H} " + " UNION ALL ".join(f"SELECT * FROM (WITH {fold_sql(blk(km, 'x', 'y'))} SELECT {R2} AS r2_spatial, {km} AS block_km, (SELECT r FROM {_RANDOM}) AS r2_random FROM ({fitted_sql('k')}))" for km in (10, 25, 50, 100)), "points"))
Q["k26_ablation_line"] = (lambda s, d: score5(learn.ablation(folded(s, d), lambda f: by_line(f[0], Y), {c: [c] for c in ("ph", "p", "lat")}, Y, "fold", 5)),
                          oracle(FOLDED + " " + " UNION ALL ".join(f"SELECT * FROM ({scored_sql('inputs', f'SELECT {chr(39)}{c}{chr(39)} AS inputs, n, yhat FROM ({fitted_sql(c)})')})" for c in ("ph", "p", "lat")), "points"))
Q["k27_block_size_curve_line"] = (lambda s, d: score5(learn.block_size(pts(s, d), by_line("k", Y), Y)), oracle(f"WITH {T} " + " UNION ALL ".join(
    f"SELECT * FROM (WITH {fold_sql(blk(km, 'x', 'y'))} {scored_sql(f'{km} AS block_km', fitted_sql('k'))})" for km in (10, 25, 50, 100)), "points"))
SEEDS = (42, 7, 13, 99, 2024)


def _seed_sql(seed):
    h = f"h AS (SELECT *, {test_sql('id', 0.3, seed)} AS is_test FROM t)"
    raw = R2.replace("round(", "", 1).replace(", 5)", "")
    return f"""SELECT * FROM (WITH {h} SELECT 'random 70/30' AS design, {raw} AS r2 FROM (SELECT u.n, exp(a.c0 + a.c1*u.k) - 1 AS yhat FROM h u, (SELECT regr_slope(ln(1 + n), k) AS c1, regr_intercept(ln(1 + n), k) AS c0 FROM h WHERE is_test = 0) a WHERE is_test = 1))
 UNION ALL SELECT * FROM (WITH {fold_sql(BLK10, seed=seed)} SELECT 'blocks 10 km' AS design, {raw} AS r2 FROM ({fitted_sql('k')}))"""


Q["k29_seed_repeats_line"] = (lambda s, d: rnd(learn.seed_repeats(pts(s, d), by_line("k", Y), Y, SEEDS), ["mean", "sd", "min", "max"], 5),
                              oracle(f"WITH {T} SELECT design, round(avg(r2), 5) AS mean, round(stddev_samp(r2), 5) AS sd, round(min(r2), 5) AS min, round(max(r2), 5) AS max, CAST(count(r2) AS BIGINT) AS runs FROM ({' UNION ALL '.join(map(_seed_sql, SEEDS))}) GROUP BY 1", "points"))


def k30_line(s, d):
    t = learn.reverse_position(folded(s, d), lambda f, c: by_line(f[0], c, log=False), {"ph": ["ph"], "k": ["k"]}, "fold", 5)
    return rnd(t, ["model_err_p50", "null_err_p50", "ratio"], 3)


def _back(x):
    o = "(SELECT DISTINCT fold FROM f) o JOIN f c ON c.fold <> o.fold GROUP BY 1"
    return f"""SELECT '{x}' AS inputs, sqrt(pow(a.bx + a.sx*u.{x} - u.x, 2) + pow(a.iy + a.sy*u.{x} - u.y, 2)) AS e, sqrt(pow(a.mx - u.x, 2) + pow(a.my - u.y, 2)) AS z
 FROM f u JOIN (SELECT o.fold, regr_slope(c.x, c.{x}) AS sx, regr_intercept(c.x, c.{x}) AS bx, regr_slope(c.y, c.{x}) AS sy, regr_intercept(c.y, c.{x}) AS iy, avg(c.x) AS mx, avg(c.y) AS my FROM {o}) a USING (fold)"""


Q["k30_reverse_position_line"] = (k30_line, oracle(f"{FOLDED} SELECT inputs, round(median(e), 3) AS model_err_p50, round(median(z), 3) AS null_err_p50, round(median(e)/median(z), 3) AS ratio FROM ({_back('ph')} UNION ALL {_back('k')}) GROUP BY 1", "points"))


def k31_line(s, d):
    t = learn.noise(narrow(folded(s, d), "k"), lambda f: by_line(f[0], Y), ["ph", "k"], Y, "fold", 5)
    return score5(t)


def _normal(salt):
    return f"sqrt(ln(greatest({u('u.id', f'42{salt}a')}, 1e-12))*-2e0)*cos({u('u.id', f'42{salt}b')}*6.283185307179586e0)"


_PH = "SELECT '{0}' AS inputs, {1}e0 AS ph_sd, {2}e0 AS ec_rel, u.n, exp(a.c0 + a.c1*({3})) - 1 AS yhat FROM f u JOIN (SELECT o.fold, regr_slope(ln(1 + c.n), c.{4}) AS c1, regr_intercept(ln(1 + c.n), c.{4}) AS c0 FROM (SELECT DISTINCT fold FROM f) o JOIN f c ON c.fold <> o.fold GROUP BY 1) a USING (fold)"
Q["k31_sensor_noise_line"] = (k31_line, oracle(f"{FOLDED} " + scored_sql("inputs, ph_sd, ec_rel", " UNION ALL ".join(
    [_PH.format("with sensor", sd, rel, f"u.ph + {_normal('p')}*{sd}e0", "ph") for sd, rel in ((0.0, 0.0), (0.15, 0.1), (0.3, 0.2), (0.5, 0.4))] + [_PH.format("without sensor", 0.0, 0.0, "u.k", "k")])), "points"))


# ---- the job table (J14) drives one runner, results appended as they come
_JOBS = {"seed": [42, 7, 13, 99, 2024], "design": ["random", "site", "10 km"], "target": ["n", "p", "k", "oc"]}
_DEAL = {"random": lambda p, seed: designs.kfold(p, "id", 5, seed), "site": lambda p, seed: designs.group_folds(p, "spot", 5, seed), "10 km": lambda p, seed: designs.blocks(p, 10, 5, seed)}


def j14_run(s, d):
    from terrasift.plans import jobs
    from terrasift.session import scratch

    p = cut(pts(s, d).select("id", "spot", "region", "x", "y", "ph", *_JOBS["target"]))
    table = jobs.grid(s, **_JOBS).crossJoin(F.broadcast(p.select("region").distinct()))  # five regions
    out = linear.run_jobs(table, scratch(s, "jobs"), ["seed", "design", "target", "region"], ["seed", "design"], lambda seed, design: linear.by_scope(_DEAL[design](p, seed), ["ph"], _JOBS["target"], "region", "fold"))
    return rnd(out, ["r2"], 5)


_KF = "f AS (SELECT *, CAST(CAST(concat('0x', substr(md5(concat(id, ':{0}')), 1, 8)) AS BIGINT) % 5 AS INTEGER) AS fold FROM t)"


def _job_sql(seed, design):
    f = {"random": _KF.format(seed), "site": fold_sql("spot", seed=seed), "10 km": fold_sql(BLK10, seed=seed)}[design]
    per = " UNION ALL ".join(f"SELECT '{t}' AS target, u.region, u.{t} AS n, exp(a.c0 + a.c1*u.ph) - 1 AS yhat FROM f u JOIN (SELECT o.fold, o.region, regr_slope(ln(1 + c.{t}), c.ph) AS c1, regr_intercept(ln(1 + c.{t}), c.ph) AS c0 FROM (SELECT DISTINCT fold, region FROM f) o JOIN f c ON c.fold <> o.fold AND c.region = o.region GROUP BY ALL) a USING (fold, region)" for t in _JOBS["target"])
    return f"SELECT * FROM (WITH {f} SELECT {seed} AS seed, '{design}' AS design, target, region, CAST(count(n) AS BIGINT) AS n, {R2} AS r2 FROM ({per}) GROUP BY target, region)"


Q["j14_job_table_run"] = (j14_run, oracle(f"WITH {T} " + " UNION ALL ".join(_job_sql(a, b) for a in _JOBS["seed"] for b in _JOBS["design"]), "points"))


# ---- nested search: the setting is chosen on training blocks only, then refitted and scored on the outer fold (K13, K17)
PENALTIES = [10.0 ** (e / 4 - 3) for e in range(25)]
SETTINGS = [(r, 0.0) for r in PENALTIES] + [(r, e) for e in (1.0, 0.2, 0.5, 0.8) for r in PENALTIES[:13]]


def nested(s, d, settings, feats):
    p = folded(s, d).withColumn("block", geo.block("x", "y", 10))
    return linear.nested(p, settings, feats, Y, "block", "fold", 5, 3, 7)


Q["k17_nested_linear_search"] = (lambda s, d: rnd(nested(s, d, SETTINGS, IN), ["reg", "inner_r2", "outer_r2"], 6), None)
_RIDGE = [0.01, 0.1, 0.5, 1.0]
_SSE = "sum(pow(ln(1 + {v}.n) - (m.my + m.b/(1 + s.reg)*({v}.ph - m.mx)), 2))"
_R2N = f"1 - {_SSE}/(var_pop(ln(1 + {{v}}.n))*count(*))"
Q["k17_nested_ridge_line"] = (lambda s, d: rnd(nested(s, d, [(r, 0.0) for r in _RIDGE], ["ph"]).select("outer", "reg", "inner_r2", "chosen", "outer_r2"), ["inner_r2", "outer_r2"], 6), oracle(f"""{FOLDED},
 o AS (SELECT f.*, {BLK10} AS block, CAST(v.o AS BIGINT) AS outer_ FROM f, range(5) v(o) WHERE v.o <> fold),
 g AS (SELECT outer_, block, CAST((row_number() OVER (ORDER BY outer_, md5(concat(outer_, ':', block, ':7'))) - 1) % 3 AS INTEGER) AS inner_ FROM (SELECT DISTINCT outer_, block FROM o)),
 i AS (SELECT o.*, inner_ FROM o JOIN g USING (outer_, block)), s AS (SELECT unnest([{', '.join(f'{r}e0' for r in _RIDGE)}]) AS reg),
 mi AS (SELECT h.outer_, h.inner_, avg(ph) AS mx, avg(ln(1 + n)) AS my, regr_slope(ln(1 + n), ph) AS b FROM (SELECT DISTINCT outer_, inner_ FROM i) h JOIN i ON i.outer_ = h.outer_ AND i.inner_ <> h.inner_ GROUP BY ALL),
 ri AS (SELECT i.outer_, i.inner_, s.reg, {_R2N.format(v='i')} AS r2 FROM i JOIN mi m ON m.outer_ = i.outer_ AND m.inner_ = i.inner_, s GROUP BY ALL),
 sc AS (SELECT outer_, reg, avg(r2) AS inner_r2 FROM ri GROUP BY ALL),
 mo AS (SELECT outer_, avg(ph) AS mx, avg(ln(1 + n)) AS my, regr_slope(ln(1 + n), ph) AS b FROM o GROUP BY 1),
 ro AS (SELECT m.outer_, s.reg, {_R2N.format(v='f')} AS outer_r2 FROM f JOIN mo m ON m.outer_ = f.fold, s GROUP BY ALL)
 SELECT outer_ AS "outer", reg, round(inner_r2, 6) AS inner_r2, row_number() OVER (PARTITION BY outer_ ORDER BY inner_r2 DESC, reg) = 1 AS chosen, round(outer_r2, 6) AS outer_r2 FROM sc JOIN ro USING (outer_, reg)""", "points"))
