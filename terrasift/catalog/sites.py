"""Components, sites, merged locations and zones."""

from pyspark.sql import functions as F

from terrasift.catalog.aggregates import rnd
from terrasift.catalog.columns import _NAT, _NUM  # noqa: F401
from terrasift.catalog.joining import DIST, T, pts
from terrasift.catalog.places import N, X, Y
from terrasift.operators import cluster, groups
from terrasift.plans import decluster
from terrasift.sources.views import BANDS, oracle, view

Q = QUERIES = {}


def reach(src="t"):
    """Sites by transitive closure of the pairs within 30 m."""
    return f"""pr AS (SELECT a.id AS a, b.id AS b FROM {src} a JOIN {src} b ON a.id <> b.id AND {DIST} <= 30),
 rc AS (SELECT id, id AS m FROM {src} UNION SELECT rc.id, pr.b FROM rc JOIN pr ON rc.m = pr.a), st AS (SELECT id, min(m) AS site FROM rc GROUP BY 1)"""


SITES = f"WITH RECURSIVE {T}, {reach()}"
WITH_SITE = SITES + ", u AS (SELECT t.*, st.site, count(*) OVER (PARTITION BY st.site) AS sz FROM t JOIN st ON t.id = st.id)"


def sited(s, d):
    return cluster.sites(pts(s, d), 30.0)


def i01(s, d):
    li = view(s, d, "lineitem")
    # orders and parts as nodes of one graph: parts get negative numbers
    e = li.select((-F.col("l_partkey") - 1).alias("src"), F.col("l_orderkey").alias("dst"))
    return cluster.components(e).groupBy("root").agg(F.count("*").alias("nodes"))


Q["i01_connected_components"] = (i01, """WITH RECURSIVE e AS (SELECT DISTINCT -l_partkey - 1 AS a, l_orderkey AS b FROM lineitem),
 pr AS (SELECT a, b FROM e UNION SELECT b, a FROM e), rc(id, m) USING KEY (id) AS (SELECT a, a FROM pr UNION SELECT pr.b, min(rc.m) FROM rc JOIN pr ON rc.id = pr.a JOIN recurring.rc AS o ON o.id = pr.b WHERE rc.m < o.m GROUP BY pr.b)
 SELECT m AS root, CAST(count(*) AS BIGINT) AS nodes FROM rc GROUP BY 1""")
Q["i01_sites_within_30m"] = (lambda s, d: sited(s, d).select("id", "site"), oracle(SITES + " SELECT id, site FROM st", "points"))
Q["i02_drop_large_sites"] = (lambda s, d: cluster.drop_large(sited(s, d)).select("id", "site", "site_size"), oracle(WITH_SITE + " SELECT id, site, sz AS site_size FROM u WHERE sz <= 10", "points"))


def i03(s, d):
    m = cluster.merge(cluster.drop_large(sited(s, d)), ["lon", "lat", "n", "p"], firsts=["did"], modes=["event_type"])
    return rnd(m, ["lon", "lat", "n", "p"])


MERGED = """mg AS (SELECT min(id) AS id, string_agg(CAST(id AS VARCHAR), ';' ORDER BY CAST(id AS VARCHAR)) AS ids_merged, CAST(count(*) AS BIGINT) AS n_merged, median(lon) AS lon, median(lat) AS lat, median(n) AS n, median(p) AS p,
 arg_min(did, id) AS did, site FROM u WHERE sz <= 10 GROUP BY site)"""
Q["i03_merge_sites"] = (i03, oracle(WITH_SITE + f""", {MERGED}, md AS (SELECT site, event_type, row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, event_type) AS rn FROM u GROUP BY 1, 2)
 SELECT id, ids_merged, n_merged, round(lon, 6) AS lon, round(lat, 6) AS lat, round(n, 6) AS n, round(p, 6) AS p, did, event_type FROM mg JOIN md ON mg.site = md.site AND rn = 1""", "points"))
Q["i04_drop_close_locations"] = (lambda s, d: cluster.drop_close(pts(s, d), 30.0).select("id"), oracle(f"WITH {T} SELECT id FROM t WHERE id NOT IN (SELECT a.id FROM t a JOIN t b ON a.id <> b.id AND {DIST} <= 30)", "points"))
Q["i05_rule_comparison"] = (lambda s, d: cluster.compare_rules(sited(s, d)), oracle(WITH_SITE + " " + " UNION ALL ".join(
    f"SELECT '{n}' AS rule, CAST(count(*) AS BIGINT) AS samples, CAST(count(DISTINCT site) AS BIGINT) AS locations FROM u WHERE {c}" for n, c in (("isolated only", "sz = 1"), ("drop > 5", "sz <= 5"), ("drop > 10", "sz <= 10"), ("merge all", "true"))), "points"))


def i06(s, d):
    kept = cluster.drop_large(sited(s, d)).filter(F.col("did") != 491).drop("site", "site_size")
    return cluster.sites(kept, 30.0).select("id", "site")


Q["i06_sites_on_filtered_set"] = (i06, oracle(WITH_SITE + f", k AS (SELECT * FROM u WHERE sz <= 10 AND did <> 491), {reach('k').replace('pr AS', 'pr2 AS').replace('pr.', 'pr2.').replace('JOIN pr ', 'JOIN pr2 ').replace('rc', 'rc2').replace('st AS', 'st2 AS')} SELECT id, site FROM st2", "points"))


def e22(s, d):
    t = cluster.summary(sited(s, d), 5, distincts=["ts", "event_type"], ranges=["n", "oc"])
    return rnd(t, ["extent_x", "extent_y"], 3)


Q["e22_largest_sites"] = (e22, oracle(WITH_SITE + f""" SELECT site, {N} AS samples, round(max(x) - min(x), 3) AS extent_x, round(max(y) - min(y), 3) AS extent_y, CAST(count(DISTINCT ts) AS BIGINT) AS ts_distinct,
 CAST(count(DISTINCT event_type) AS BIGINT) AS event_type_distinct, min(n) AS n_lo, max(n) AS n_hi, min(oc) AS oc_lo, max(oc) AS oc_hi FROM u GROUP BY 1 ORDER BY samples DESC, site LIMIT 5""", "points"))
Q["e23_within_vs_overall_sd"] = (lambda s, d: rnd(cluster.within_vs_overall(sited(s, d), ["n", "p", "k", "oc"]), ["within_site", "overall"]), oracle(WITH_SITE + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round((SELECT median(v) FROM (SELECT stddev_samp({c}) AS v FROM u GROUP BY site)), 6) AS within_site, round(stddev_samp({c}), 6) AS overall FROM u" for c in ("n", "p", "k", "oc")), "points"))


def banded(s, d):
    return view(s, d, "points").withColumns({b: 0.05 + ((F.col("id") * (31 + 2 * j) + j * 57) % 400) / 1000.0 for j, b in enumerate(BANDS)})


def i08(s, d):
    loc = decluster.state_locations(banded(s, d), BANDS)
    return loc.select("id", "n_merged", *[F.round(c, 6).alias(c) for c in ("lon", "lat", "n", "ec", "B02", "NDVI", "RI")])


_B = {b: f"5e-2 + ((id*{31 + 2 * j} + {j * 57}) % 400)/1e3" for j, b in enumerate(BANDS)}
_LIMS = "n > 20 AND n <= 1500 AND p > 1 AND p <= 300 AND k > 20 AND k <= 3000 AND oc > 2e-2 AND oc <= 5 AND ph >= 3.5e0 AND ph <= 10.5e0 AND ec > 5e-3 AND ec <= 10"
Q["i08_state_locations"] = (i08, oracle(f"""WITH RECURSIVE t AS (SELECT *, {X} AS x, {Y} AS y, {_B['B02']} AS "B02", {_B['B03']} AS "B03", {_B['B04']} AS "B04", {_B['B08']} AS "B08" FROM points WHERE {_LIMS}), {reach()},
 u AS (SELECT t.*, st.site, count(*) OVER (PARTITION BY st.site) AS sz FROM t JOIN st ON t.id = st.id),
 mg AS (SELECT min(id) AS id, CAST(count(*) AS BIGINT) AS n_merged, median(lon) AS lon, median(lat) AS lat, median(n) AS n, median(ec) AS ec, median(B02) AS b2, median(B03) AS b3, median(B04) AS b4, median(B08) AS b8 FROM u WHERE sz <= 10 GROUP BY site),
 z AS (SELECT *, {X} AS x, {Y} AS y FROM mg)
 SELECT id, n_merged, round(lon, 6) AS lon, round(lat, 6) AS lat, round(n, 6) AS n, round(ec, 6) AS ec, round(b2, 6) AS "B02", round((b8 - b4)/(b8 + b4), 6) AS "NDVI", round(b4*b4/(b2*b3*b3*b3), 6) AS "RI" FROM z
 WHERE id NOT IN (SELECT a.id FROM z a JOIN z b ON a.id <> b.id AND {DIST} <= 30)""", "points"))


def i09(s, d):
    loc, _ = decluster.national_locations(view(s, d, "raw"))
    return loc.select("id", "ids_merged", "n_merged", "sid", "did", "cycle", F.date_format("date", "yyyy-MM-dd").alias("date"), "has_date", *[F.round(c, 6).alias(c) for c in ("lon", "lat", "n", "ph")])


_RN = "(SELECT id, sid, did, cycle, lon, lat, CASE WHEN year(dd) BETWEEN 2014 AND 2025 THEN dd END AS date, n, p, k, oc, ph, ec FROM (SELECT id, sid, did, cycle, lon, lat, try_strptime(date, '%m/%d/%y, %I:%M %p') AS dd, " + ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in ("n", "p", "k", "oc", "ph", "ec")) + " FROM raw))"
_SAME = " AND ".join(f"min({c}) OVER w = max({c}) OVER w" for c in ("n", "p", "k", "oc", "ph", "ec"))
Q["i09_h08_national_locations"] = (i09, oracle(f"""WITH RECURSIVE a0 AS (SELECT *, count(*) OVER w AS c, {_SAME} AS same, row_number() OVER (PARTITION BY lon, lat ORDER BY id) AS rn FROM {_RN}
 WHERE lon BETWEEN 68 AND 98 AND lat BETWEEN 6 AND 37.5e0 AND {_NAT} WINDOW w AS (PARTITION BY lon, lat)),
 t AS (SELECT *, {X} AS x, {Y} AS y FROM a0 WHERE (c = 1 OR same) AND rn = 1), {reach()},
 u AS (SELECT t.*, st.site, count(*) OVER (PARTITION BY st.site) AS sz FROM t JOIN st ON t.id = st.id),
 mg AS (SELECT min(id) AS id, string_agg(id, ';' ORDER BY id) AS ids_merged, CAST(count(*) AS BIGINT) AS n_merged, min(sid) AS sid, min(did) AS did, string_agg(DISTINCT cycle, '|' ORDER BY cycle) AS cycle, min(date) AS date,
  median(lon) AS lon, median(lat) AS lat, median(n) AS n, median(ph) AS ph FROM u WHERE sz <= 10 GROUP BY site), z AS (SELECT *, {X} AS x, {Y} AS y FROM mg)
 SELECT id, ids_merged, n_merged, sid, did, cycle, strftime(date, '%Y-%m-%d') AS date, date IS NOT NULL AS has_date, round(lon, 6) AS lon, round(lat, 6) AS lat, round(n, 6) AS n, round(ph, 6) AS ph FROM z
 WHERE id NOT IN (SELECT a.id FROM z a JOIN z b ON a.id <> b.id AND {DIST} <= 30)""", "raw"))
