"""Rules on small literal tables."""

import math

from pyspark.sql import functions as F

from terrasift.functions import clean, feat, geo
from terrasift.operators import agg, groups, metric, qa, setops
from terrasift.plans import designs, models
from terrasift.sources import tables

NAN = float("nan")


def col(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_text_numbers(spark):
    df = spark.createDataFrame([("6,982",), (" 7.1 ",), ("",), (None,), ("-3",), ("abc",)], ["t"])
    assert col(df, clean.to_number("t")) == [None, 7.1, None, None, -3.0, None]


def test_dates_and_year_guard(spark):
    df = spark.createDataFrame([("7/23/24, 12:00 AM",), ("bad",), (None,), ("1/2/13, 1:30 PM",)], ["t"])
    d = clean.to_date("t")
    got = col(df, F.date_format(d, "yyyy-MM-dd HH:mm"))
    assert got == ["2024-07-23 00:00", None, None, "2013-01-02 13:30"]
    assert col(df, F.year(clean.year_guard(d, 2014, 2025))) == [2024, None, None, None]


def test_nan_is_outside_every_limit(spark):
    df = spark.createDataFrame([(NAN,), (None,), (20.0,), (20.5,), (1500.0,), (1500.5,)], "n double")
    assert col(df, clean.within(F.col("n"), 20.0, 1500.0, False)) == [False, False, False, True, True, False]
    assert col(df, clean.within(F.col("n"), 20.0, 1500.0, True)) == [False, False, True, True, True, False]
    assert col(df, clean.finite("n")) == [False, False, True, True, True, True]


def test_bins_edges_and_empty(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (NAN,), (None,)], "v double")
    assert col(df, feat.bin_index(F.col("v"), [0.0, 1.0, 2.0])) == [None, 0, 1, None, None]
    assert col(df, feat.bin_index(F.col("v"), [0.0, 1.0, 2.0], right=False)) == [0, 1, None, None, None]
    h = agg.histogram(df, "v", [0.0, 1.0, 2.0, 3.0]).orderBy("bin").collect()
    assert [r["n"] for r in h] == [1, 1, 0]


def test_rating_cut_is_a_parameter(spark):
    df = spark.createDataFrame([(279.0,), (280.0,), (560.0,), (561.0,)], "v double")
    assert col(df, feat.rating(F.col("v"), 280, 560)) == [0, 1, 1, 2]
    assert col(df, feat.rating(F.col("v"), 280, 560, False)) == [0, 1, 2, 2]


def test_blocks_floor_negative(spark):
    df = spark.createDataFrame([(-1.0, 5.0), (10000.0, -10000.0)], "x double, y double")
    assert col(df, geo.block("x", "y", 10)) == ["-1_0", "1_-1"]


def test_point_in_polygon_edges(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]])
    df = spark.createDataFrame([(2.0, 2.0), (5.0, 2.0), (-1.0, 0.0), (2.0, 5.0)], "x double, y double")
    assert col(df, geo.ring_contains(ring, F.col("x"), F.col("y"))) == [True, False, False, False]


def test_wkb_round_trip_and_junk(spark):
    df = spark.createDataFrame([(72.5, 18.25), (-3.0, 4.0)], "lon double, lat double").select(geo.to_wkb("lon", "lat").alias("g"))
    df = df.union(spark.createDataFrame([(bytearray(b"xx"),), (None,)], "g binary"))
    assert [tuple(r) for r in df.select(geo.wkb_xy("g").alias("p")).select("p.lon", "p.lat").collect()] == [(72.5, 18.25), (-3.0, 4.0), (None, None), (None, None)]


def test_group_of_one_has_no_sd_and_ties_take_smallest(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("b", 1.0, "z"), ("b", 3.0, "y")], "g string, v double, c string")
    z = {(r["g"], r["v"]): r["v_z"] for r in groups.zscore(df, ["g"], ["v"]).collect()}
    assert z[("a", 1.0)] is None and abs(z[("b", 3.0)] - math.sqrt(0.5)) < 1e-12
    assert {r["g"]: r["mode"] for r in agg.mode(df, ["g"], "c").collect()} == {"a": "x", "b": "y"}


def test_null_keys_are_kept_on_rows(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    assert sorted((r["v"], r["n_at"]) for r in groups.size(df, ["k"]).collect()) == [(1, 2), (2, 2), (3, 1)]


def test_repeated_points(spark):
    rows = [(1, 0.0, 5.0), (2, 0.0, 5.0), (3, 1.0, 5.0), (4, 1.0, 6.0), (5, 2.0, 7.0)]
    kept, aside = groups.repeated_points(spark.createDataFrame(rows, "id int, x double, n double"), ["x"], ["n"], ["id"])
    assert sorted(r["id"] for r in kept.collect()) == [1, 5]
    assert sorted(r["id"] for r in aside.collect()) == [1, 2, 3, 4]


def test_r2_without_variance(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double")
    assert df.agg(metric.r2("y", "p")).first()[0] is None


def test_class_scores_ignore_absent_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "y int, p int").withColumn("g", F.lit(0))
    r = metric.classes(df, ["g"], "y", "p").first()
    assert r["accuracy"] == 0.75 and r["balanced_accuracy"] == 0.75 and r["recall_2"] is None
    assert abs(r["macro_f1"] - (2 / 3 + 4 / 5) / 2) < 1e-12


def test_folds_partition_rows_and_keep_groups_whole(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 37)
    f = designs.group_folds(df, "g", 5, 42).cache()
    assert f.count() == 500
    assert f.groupBy("g").agg(F.count_distinct("fold").alias("c")).agg(F.max("c")).first()[0] == 1
    sizes = [r[1] for r in f.select("g", "fold").distinct().groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == 5


def test_majority_with_class_missing_in_a_fold(spark):
    rows = [(0, 1)] * 3 + [(1, 2)] * 4 + [(2, 1)] * 2
    df = spark.createDataFrame(rows, "fold int, y int")
    got = {(r["fold"], r["pred"]) for r in models.majority(df, "y", "fold").select("fold", "pred").distinct().collect()}
    assert got == {(0, 2), (1, 1), (2, 2)}


def test_append_missing_is_idempotent(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    for part in (df.filter("id < 4"), df, df):
        tables.append_missing(part, str(tmp_path / "t"), ["id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10


def test_funnel_and_subset(spark):
    df = spark.createDataFrame([(1.0,), (None,), (5.0,)], "v double")
    f = clean.funnel(df, [("all", F.lit(True)), ("known", F.col("v").isNotNull()), ("big", F.col("v") > 2)]).orderBy("step_no").collect()
    assert [r["rows"] for r in f] == [3, 2, 1]
    assert qa.is_subset(spark.range(3), spark.range(5), ["id"]).first()["subset"] is True
    assert qa.is_subset(spark.range(5), spark.range(3), ["id"]).first()["missing"] == 2
    assert setops.missing(spark.range(5), spark.range(3), ["id"]).count() == 2
