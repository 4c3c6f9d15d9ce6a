"""Unions, differences, subset checks and repeated-row rules."""

from pyspark.sql import functions as F

from terrasift.catalog.places import N
from terrasift.operators import groups, qa, setops
from terrasift.sources.views import oracle, view

Q = QUERIES = {}


def h01(s, d):
    p = view(s, d, "points").select("id", "region", "n")
    return setops.union(p.filter("region < 2"), p.filter("region >= 2"), p.filter("region = 4"))


Q["h01_union_all"] = (h01, oracle("SELECT id, region, n FROM points UNION ALL SELECT id, region, n FROM points WHERE region = 4", "points"))
Q["h02_union_missing_columns"] = (lambda s, d: setops.union(view(s, d, "nation").select("n_nationkey", "n_name"), view(s, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_acctbal"), fill=True),
                                  "SELECT n_nationkey, n_name, NULL::DOUBLE AS s_acctbal FROM nation UNION ALL SELECT s_nationkey, NULL, s_acctbal FROM supplier")
Q["h03_codes_without_data"] = (lambda s, d: setops.missing(view(s, d, "customer").select("c_custkey", "c_nationkey"), view(s, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]),
                               "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")


def h04(s, d):
    from terrasift.operators import sampling

    p = view(s, d, "points").select("id", "did")
    return setops.minus(p, sampling.per_group(p, ["did"], 50, "id", 1000), ["id"])


Q["h04_test_rows_minus_calibration"] = (h04, oracle("SELECT id, did FROM (SELECT id, did, row_number() OVER (PARTITION BY did ORDER BY md5(concat(id, ':1000')), id) AS rn FROM points) WHERE rn > 50", "points"))


def h05(s, d):
    per = view(s, d, "lineitem").withColumn("y", F.year("l_shipdate")).groupBy("l_partkey", "y").agg(F.count("*").alias("m"))
    return setops.common(per, "l_partkey", "y", 7, F.col("m") >= 2)


Q["h05_keys_qualifying_everywhere"] = (h05, "SELECT l_partkey FROM (SELECT l_partkey, year(l_shipdate) AS y FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1 HAVING count(DISTINCT y) = 7")


def h06(s, d):
    li = view(s, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    o = view(s, d, "orders").select(F.col("o_orderkey").alias("k"))
    a = qa.is_subset(li, o, ["k"]).withColumn("pair", F.lit("lineitem in orders"))
    b = qa.is_subset(o, li, ["k"]).withColumn("pair", F.lit("orders in lineitem"))
    return a.unionByName(b)


Q["h06_subset_check"] = (h06, f"""SELECT 'lineitem in orders' AS pair, {N} AS missing, count(*) = 0 AS subset FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders) UNION ALL
 SELECT 'orders in lineitem', {N}, count(*) = 0 FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)""")
_ORDER = ["l_orderkey", "l_linenumber", "n", "l_shipdate"]
Q["h07_drop_duplicates_by_key"] = (lambda s, d: groups.first(view(s, d, "repeated"), ["l_partkey"], _ORDER).select("l_partkey", "l_orderkey", "l_linenumber", "n"),
                                   oracle("SELECT l_partkey, l_orderkey, l_linenumber, n FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, n, l_shipdate) AS rn FROM repeated) WHERE rn = 1", "repeated"))


def h08(s, d):
    kept, aside = groups.repeated_points(view(s, d, "repeated"), ["l_partkey", "l_suppkey"], ["p", "k"], _ORDER)
    a = kept.groupBy("l_suppkey").agg(F.count("*").alias("kept"), F.sum("l_orderkey").alias("kept_orders"))
    return a.join(aside.groupBy("l_suppkey").agg(F.count("*").alias("aside")), "l_suppkey", "full_outer").na.fill(0)


Q["h08_repeated_point_rule"] = (h08, oracle("""WITH t AS (SELECT *, count(*) OVER w AS c, min(p) OVER w = max(p) OVER w AND min(k) OVER w = max(k) OVER w AS same,
 row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, n, l_shipdate) AS rn FROM repeated WINDOW w AS (PARTITION BY l_partkey, l_suppkey))
 SELECT l_suppkey, CAST(count(*) FILTER ((c = 1 OR same) AND rn = 1) AS BIGINT) AS kept, CAST(coalesce(sum(l_orderkey) FILTER ((c = 1 OR same) AND rn = 1), 0) AS BIGINT) AS kept_orders, CAST(count(*) FILTER (c > 1) AS BIGINT) AS aside FROM t GROUP BY 1""", "repeated"))
Q["h09_unique_points_only"] = (lambda s, d: groups.unique_points(view(s, d, "repeated"), ["l_partkey", "l_suppkey"]).select("l_partkey", "l_suppkey", "n"),
                               oracle("SELECT l_partkey, l_suppkey, any_value(n) AS n FROM repeated GROUP BY 1, 2 HAVING count(*) = 1", "repeated"))
