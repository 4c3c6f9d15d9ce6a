"""Validation designs."""

from pyspark.sql import functions as F

from terrasift.catalog.aggregates import rnd
from terrasift.catalog.joining import BLK10, DIST, PROFILE, T, fold_sql, pts
from terrasift.catalog.places import N, blk
from terrasift.functions import geo
from terrasift.operators import sampling
from terrasift.plans import designs, jobs
from terrasift.session import cut
from terrasift.sources.views import oracle, view

Q = QUERIES = {}


def u(key, seed=42):
    return f"CAST(concat('0x', substr(md5(concat({key}, ':{seed}')), 1, 8)) AS BIGINT)/4294967296e0"


def test_sql(key, p, seed=42):
    return f"CAST({u(key, seed)} < {p}e0 AS INTEGER)"


def j01(s, d):
    p = view(s, d, "points").select("id")
    out = None
    for share in (0.2, 0.3, 0.4):
        t = designs.random_holdout(p, "id", share, 42).withColumn("p", F.lit(share))
        out = t if out is None else out.unionByName(t)
    return out


Q["j01_random_holdout"] = (j01, oracle(" UNION ALL ".join(f"SELECT id, {test_sql('id', p)} AS is_test, {p}e0 AS p FROM points" for p in (0.2, 0.3, 0.4)), "points"))
Q["j02_random_kfold"] = (lambda s, d: designs.kfold(view(s, d, "points").select("id"), "id", 5, 42), oracle("SELECT id, CAST(CAST(concat('0x', substr(md5(concat(id, ':42')), 1, 8)) AS BIGINT) % 5 AS INTEGER) AS fold FROM points", "points"))
Q["j03_block_kfold"] = (lambda s, d: designs.fold_blocks(pts(s, d).select("id", "x", "y"), [10, 25, 50, 100], 5, 42).select("km", "id", "block", "fold"), oracle(f"WITH {T} " + " UNION ALL ".join(
    f"SELECT * FROM (WITH {fold_sql(blk(km, 'x', 'y'))} SELECT {km} AS km, id, fkey AS block, fold FROM f)" for km in (10, 25, 50, 100)), "points"))
Q["j03_block_kfold_by_site"] = (lambda s, d: designs.site_blocks(pts(s, d), 10, 5, 42, "spot").select("id", "block", "fold"), oracle(
    f"WITH {T}, c AS (SELECT *, avg(x) OVER (PARTITION BY spot) AS cx, avg(y) OVER (PARTITION BY spot) AS cy FROM t), {fold_sql(blk(10, 'cx', 'cy'), src='c')} SELECT id, fkey AS block, fold FROM f", "points"))
Q["j04_site_grouped_holdout"] = (lambda s, d: designs.random_holdout(view(s, d, "points").select("id", "spot"), "spot", 0.3, 42), oracle(f"SELECT id, spot, {test_sql('spot', 0.3)} AS is_test FROM points", "points"))


def j05(s, d):
    r = view(s, d, "raw").withColumn("key", geo.coord_key())
    return designs.random_holdout(r, "key", 0.3, 42).select("event_id", "is_test")


_CK = "concat(CAST(round(lon*1e6) AS BIGINT), '_', CAST(round(lat*1e6) AS BIGINT))"
Q["j05_exact_location_holdout"] = (j05, oracle(f"SELECT event_id, {test_sql(_CK, 0.3)} AS is_test FROM raw", "raw"))
Q["j06_leave_one_region_out"] = (lambda s, d: designs.leave_one_out(view(s, d, "points").select("id", "region", "n"), "region", range(5)).groupBy("held_out", "is_test").agg(F.count("*").alias("n_rows"), F.round(F.avg("n"), 6).alias("mean")),
                                 oracle(f"SELECT CAST(v.h AS INTEGER) AS held_out, CAST(region = v.h AS INTEGER) AS is_test, {N} AS n_rows, round(avg(n), 6) AS mean FROM points, range(5) v(h) GROUP BY 1, 2", "points"))


def j07(s, d):
    p = designs.pairwise(view(s, d, "points").select("id", F.col("region").cast("int").alias("region"), "n"), "region", range(5))
    g = p.groupBy("train_on", "test_on").agg(F.avg(F.when(F.col("is_test") == 0, F.col("n"))).alias("m"), F.avg(F.when(F.col("is_test") == 1, F.col("n"))).alias("t"), F.count_if(F.col("is_test") == 1).alias("n_test"))
    return g.select("train_on", "test_on", "n_test", F.round(F.col("m") - F.col("t"), 6).alias("bias"))


Q["j07_region_to_region_matrix"] = (j07, oracle(f"""WITH r AS (SELECT CAST(region AS INTEGER) AS g, avg(n) AS m, {N} AS c FROM points GROUP BY 1)
 SELECT a.g AS train_on, b.g AS test_on, b.c AS n_test, round(a.m - b.m, 6) AS bias FROM r a JOIN r b ON a.g <> b.g""", "points"))
Q["j08_group_kfold"] = (lambda s, d: designs.group_folds(view(s, d, "points").select("id", "did"), "did", 10, 42), oracle("WITH " + fold_sql("did", 10, src="points") + " SELECT id, did, fold FROM f", "points"))


def j09(s, d):
    p = designs.group_folds(view(s, d, "points").select("id", "did"), "did", 5, 42)
    return designs.inner_folds(p, "did", "fold", 5, 3, 7).select("id", "outer", "inner")


Q["j09_nested_inner_folds"] = (j09, oracle(f"""WITH {fold_sql('did', 5, src='points')}, o AS (SELECT f.*, CAST(v.o AS INTEGER) AS outer_ FROM f, range(5) v(o) WHERE v.o <> fold),
 g AS (SELECT outer_, did, CAST((row_number() OVER (ORDER BY outer_, md5(concat(outer_, ':', did, ':7'))) - 1) % 3 AS INTEGER) AS "inner" FROM (SELECT DISTINCT outer_, did FROM o))
 SELECT id, o.outer_ AS "outer", "inner" FROM o JOIN g ON o.outer_ = g.outer_ AND o.did = g.did""", "points"))
RADII = [0, 2000, 5000, 10000, 20000, 50000, 100000]


def blocked(s, d):
    return pts(s, d).withColumn("block", geo.block("x", "y", 10))


def j10(s, d):
    p = blocked(s, d).select("id", "x", "y", "block")
    held = sampling.sample_keys(p, "block", 100, 42, 5)
    return designs.buffered_counts(p, held, "block", RADII)


HELD = f"b AS (SELECT *, {BLK10} AS block FROM t), h AS (SELECT block AS held, count(*) AS n_test FROM b GROUP BY 1 HAVING count(*) >= 5 ORDER BY md5(concat(block, ':42')), block LIMIT 100)"
NEAR = f"nd AS (SELECT h.held, any_value(n_test) AS n_test, a.id, any_value(a.n) AS n, any_value(a.x) AS x, any_value(a.y) AS y, round(min({DIST}), 3) AS d FROM h JOIN b ON b.block = h.held JOIN b a ON a.block <> h.held GROUP BY h.held, a.id)"
Q["j10_buffered_holdout"] = (j10, oracle(f"WITH {T}, {HELD}, {NEAR} SELECT held, CAST(any_value(n_test) AS BIGINT) AS n_test, r*1e0 AS radius, CAST(count(*) FILTER (d > r) AS BIGINT) AS n_train FROM nd, (VALUES {', '.join(f'({r})' for r in RADII)}) v(r) GROUP BY held, r", "points"))


def j11(s, d):
    p = designs.blocks(pts(s, d), 10, 5, 42)
    return p.filter("region = 3").groupBy("fold").agg(F.count("*").alias("n_rows"), F.count_distinct("block").alias("blocks"))


Q["j11_region_scope_of_state_blocks"] = (j11, oracle(f"WITH {T}, {fold_sql(BLK10)} SELECT fold, {N} AS n_rows, CAST(count(DISTINCT fkey) AS BIGINT) AS blocks FROM f WHERE region = 3 GROUP BY 1", "points"))
Q["j12_block_counts"] = (lambda s, d: designs.block_counts(pts(s, d), "region", [10, 25, 50, 100]), oracle(f"WITH {T} " + " UNION ALL ".join(
    f"SELECT CAST(region AS VARCHAR) AS scope, {km} AS km, CAST(count(DISTINCT {blk(km, 'x', 'y')}) AS BIGINT) AS blocks FROM t GROUP BY 1 UNION ALL SELECT 'all', {km}, CAST(count(DISTINCT {blk(km, 'x', 'y')}) AS BIGINT) FROM t" for km in (10, 25, 50, 100)), "points"))


def j13(s, d):
    p = cut(pts(s, d).select("id", "x", "y", "spot"))  # the searches read their rows and folds several times
    r, g = designs.random_holdout(p, "id", 0.3, 42), designs.random_holdout(p, "spot", 0.3, 42)
    b10, b100 = (cut(designs.blocks(p, km, 5, 42).select("id", "x", "y", "fold")) for km in (10, 100))
    parts = [("random 70/30", r.filter("is_test = 1"), r.filter("is_test = 0"), {}), ("random by site", g.filter("is_test = 1"), g.filter("is_test = 0"), {}),
             ("blocks 10 km", b10, b10, {"exclude": "fold"}), ("blocks 100 km", b100, b100, {"exclude": "fold"})]
    q = designs.train_test_distance(parts)
    return rnd(q, [c for c in q.columns if c not in ("design", "rows")], 4)


def _hold(name, key):
    return f"SELECT '{name}' AS design, a.id, round(min({DIST}), 3) AS d FROM (SELECT * FROM t WHERE {test_sql(key, 0.3)} = 1) a JOIN (SELECT * FROM t WHERE {test_sql(key, 0.3)} = 0) b ON true GROUP BY a.id"


def _fold(name, km):
    return f"SELECT '{name}' AS design, a.id, round(min({DIST}), 3) AS d FROM f{km} a JOIN f{km} b ON a.fold <> b.fold GROUP BY a.id"


Q["j13_train_test_distance_profile"] = (j13, oracle(f"WITH {T}, {fold_sql(BLK10).replace('f AS', 'f10 AS', 1)}, {fold_sql(blk(100, 'x', 'y')).replace('f AS', 'f100 AS', 1)} SELECT design, {PROFILE} FROM ({_hold('random 70/30', 'id')} UNION ALL {_hold('random by site', 'spot')} UNION ALL {_fold('blocks 10 km', 10)} UNION ALL {_fold('blocks 100 km', 100)}) GROUP BY 1", "points"))


def j14(s, d):
    g = jobs.grid(s, seed=[42, 7, 13, 99, 2024], design=["random", "site", "10 km"], target=["n", "p", "k", "oc"])
    scopes = view(s, d, "points").groupBy("region").agg(F.count("*").alias("scope_rows"))
    return g.join(F.broadcast(scopes), F.lit(True))


Q["j14_job_table"] = (j14, oracle(f"SELECT CAST(a.v AS INTEGER) AS seed, b.v AS design, c.v AS target, region, scope_rows FROM (VALUES (42), (7), (13), (99), (2024)) a(v), (VALUES ('random'), ('site'), ('10 km')) b(v), (VALUES ('n'), ('p'), ('k'), ('oc')) c(v), (SELECT region, {N} AS scope_rows FROM points GROUP BY 1)", "points"))
