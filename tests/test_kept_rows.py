"""Rows with NULL inputs, keys, positions and status are kept; holes in rasters; WKB variants; blends without leaks."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.functions import geo
from terrasift.operators import agg, cluster, grid, groups, knn, metric, nearby
from terrasift.plans import designs, learn, linear, models
from terrasift.session import scratch
from terrasift.sources import tables


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.default_rng(3)
    n = 240
    a, b = g.normal(size=n), g.normal(size=n)
    y = np.exp(1 + 0.5 * a - 0.3 * b + 0.05 * g.normal(size=n))
    data = [(i, None if i % 11 == 0 else float(a[i]), float("nan") if i % 13 == 0 else float(b[i]), float(y[i]), None if i % 17 == 0 else f"g{i % 7}", i % 5) for i in range(n)]
    return spark.createDataFrame(data, "id long, a double, b double, y double, grp string, fold int").cache()


def test_models_predict_every_row(rows):
    for est in (learn.linear(0.01), learn.tree(), learn.forest(5, depth=4)):
        p = learn.out_of_fold(rows, learn.regressor(est, ["a", "b"], "y"), "fold", 5)
        assert p.count() == 240 and p.filter("pred IS NULL OR isnan(pred)").isEmpty()
    some = rows.withColumn("y", F.when(F.col("id") % 9 == 0, None).otherwise(F.col("y"))).withColumn("cls", (F.col("y") > 2.7).cast("int"))
    assert learn.out_of_fold(some, learn.regressor(learn.linear(0.01), ["a", "b"], "y"), "fold", 5).filter("pred IS NOT NULL").count() == 240
    assert learn.out_of_fold(some, learn.classifier("logistic", ["a", "b"], "cls"), "fold", 5).filter("pred IN (0, 1)").count() == 240


def test_sums_of_products_give_the_library_models(rows):
    full = rows.fillna(0.0, ["a", "b"]).withColumn("b", F.nanvl("b", F.lit(0.0)))
    named = {"least squares": (0.0, 0.0), "ridge": (0.1, 0.0), "lasso": (0.05, 1.0), "elastic net": (0.05, 0.5)}
    fast = {(r["model"], r.id): r.pred for r in linear.out_of_fold(full, named, ["a", "b"], "y", "fold").collect()}
    assert len(fast) == 4 * 240
    for n, (reg, l1) in named.items():
        for r in learn.out_of_fold(full, learn.regressor(learn.linear(reg, l1), ["a", "b"], "y"), "fold", 5).collect():
            assert abs(fast[n, r.id] - r.pred) < 2e-3 * r.pred


def test_group_keys_that_are_null(rows):
    p = models.group_mean(rows, "y", "grp", "fold")
    assert p.count() == 240 and p.filter("pred IS NULL").isEmpty()
    f = designs.group_folds(rows.drop("fold"), "grp", 3, 1)
    assert f.count() == 240 and f.filter("grp IS NULL").select("fold").distinct().count() == 1
    s = metric.scores(rows.withColumn("pred", F.col("y") * 1.1), ["grp"], "y", "pred")
    assert s.agg(F.sum("n")).first()[0] == 240 and s.filter("grp IS NULL AND rpiq IS NOT NULL").count() == 1
    t = learn.two_stage(rows, learn.regressor(learn.linear(0.01), ["a", "b"], "__r", log=False), "y", "grp", "fold", 5).first()
    assert t.n == 240 and t.r2 > 0.6 > t.group_r2


def test_margins_and_confusion_count_everything(spark):
    df = spark.createDataFrame([("u", "x"), ("u", "z"), ("v", None), (None, "x")], "a string, b string")
    got = {r["a"]: (r["x"], r["other"], r["All"]) for r in agg.crosstab(df, "a", "b", ["x"]).collect()}
    assert got == {"All": (2, 2, 4), "u": (1, 1, 2), "v": (0, 1, 1), None: (1, 0, 1)}
    c = metric.confusion(spark.createDataFrame([(0, 0), (0, 9), (0, None)], "y int, p int"), [], "y", "p", [0, 1]).first()
    assert (c["0"], c["1"], c["other"]) == (1, 0, 2)


def test_duplicates_tell_nulls_apart(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (1.0, 2.0, None), (None, 1.0, 2.0), (1.0, None, 2.0)], "a double, b double, c double")
    r = agg.duplicates(df, ["a", "b", "c"]).first()
    assert (r.groups, r.repeated_groups, r.rows_in_repeated, r.largest) == (3, 1, 2, 2)


def test_positions_that_are_missing(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, None, 5.0), (4, float("nan"), 0.0), (5, 900.0, 0.0)], "id long, x double, y double")
    assert {r.id: r.site for r in cluster.sites(df, 30.0).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert {r.id: r.n_near for r in nearby.count_within(df, 30.0).collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}


def test_crowded_cells_of_one_component_are_not_paired_again(spark):
    g = np.random.default_rng(1)
    xy = np.vstack([g.uniform(0, 20, (6000, 2)), g.uniform(0, 20, (6000, 2)) + [22, 0]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double")
    assert cluster.sites(df, 30.0).select("site").distinct().count() == 1


def test_store_steps_with_null_keys(spark):
    out = scratch(spark, "nullkeys")
    df = spark.createDataFrame([(1, "a"), (None, "b")], "id long, v string")
    for _ in range(3):
        tables.append_missing(df, out, ["id"])
    assert spark.read.parquet(out).count() == 2
    res = spark.createDataFrame([(1, "ok"), (2, "failed: x"), (3, None), (None, "failed")], "id long, status string")
    kept, again = tables.requeue_failed(res, res.select("id"), ["id"])
    assert sorted(map(str, (r.id for r in kept.collect()))) == ["1", "3"] and sorted(map(str, (r.id for r in again.collect()))) == ["2", "None"]


def test_wkb_variants(spark):
    point = lambda order, kind, *v: struct.pack(f"{order}BI{len(v)}d", order == "<", kind, *v)
    srid = lambda order: struct.pack(f"{order}BII2d", order == "<", 0x20000001, 4326, 7.5, 8.5)
    good = [point("<", 1, 7.5, 8.5), point(">", 1, 7.5, 8.5), srid("<"), srid(">"), point("<", 1001, 7.5, 8.5, 1.0), point("<", 0x80000001, 7.5, 8.5, 1.0)]
    bad = [None, b"", b"\x01\x01", point("<", 2, 7.5, 8.5), point("<", 1, 7.5)]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(good + bad)], "i int, g binary").select("i", geo.wkb_xy("g").alias("p")).select("i", "p.lon", "p.lat")
    got = {r.i: (r.lon, r.lat) for r in df.collect()}
    assert all(got[i] == (7.5, 8.5) for i in range(len(good))) and all(got[len(good) + i] == (None, None) for i in range(len(bad)))


def dense(value, holes=()):
    return [("t", r, c, None if (r, c) in holes else float(value(r, c))) for r in range(100, 107) for c in range(-3, 5)]


def test_focal_windows_with_holes_and_offset_tiles(spark):
    schema = "tile string, r long, col long, value double"
    flat = grid.focal_mean(spark.createDataFrame(dense(lambda r, c: 10), schema), 3)
    assert {x.focal_mean for x in flat.collect()} == {10.0}
    data = dense(lambda r, c: r * r + 3 * c, {(103, 0)})
    px = spark.createDataFrame([d for d in data if (d[1], d[2]) != (105, 2)], schema)  # a NULL and a missing row
    value = {(r, c): v for _, r, c, v in data if (r, c) != (105, 2)}
    out = grid.focal_sd(grid.focal_mean(px, 3), 3)
    for x in grid.slope(out, 1.0, 1.0).collect():
        near = [value.get((min(max(x.r + i, 100), 106), min(max(x.col + j, -3), 4))) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        if None in near:
            assert x.focal_mean is None and x.focal_sd is None
        else:
            assert abs(x.focal_mean - np.mean(near)) < 1e-9 and abs(x.focal_sd - np.std(near)) < 1e-5
        if x.value is not None and x.col not in (-3, 4) and None not in (value.get((x.r, x.col - 1)), value.get((x.r, x.col + 1))):
            assert abs(x.gx - 3.0) < 1e-9
        if (x.r, x.col) in ((103, 1), (105, 1)):
            assert x.gx is None


def test_a_position_with_very_many_sites(spark):
    rows = [(i, 5.0, 5.0, f"s{i}") for i in range(3000)] + [(10_000 + i, 100.0 + i, 0.0, f"t{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, x double, y double, site string")
    got = {r.id: [n.nb for n in r.nbrs] for r in knn.knn(df, df, 3, exclude="site").filter("id < 5").collect()}
    assert got == {0: [1, 2, 3], 1: [0, 2, 3], 2: [0, 1, 3], 3: [0, 1, 2], 4: [0, 1, 2]}


def test_blend_has_no_negative_weight_and_no_leak(rows):
    w = learn.non_negative(np.array([[1.0, 0.9], [0.9, 1.0]]), np.array([0.9, 0.5]))
    assert (w >= 0).all() and np.allclose(w, [0.9, 0.0])
    named = {"line": learn.line("a", "y"), "group": learn.mean_of("grp", "y")}
    full = rows.fillna(0.0, ["a"])
    before = {r.id: r.stacked for r in learn.stack(full, named, "y", "fold", 5).filter("fold = 2").collect()}
    moved = full.withColumn("y", F.when(F.col("fold") == 2, F.col("y") * 50).otherwise(F.col("y")))
    after = {r.id: r.stacked for r in learn.stack(moved, named, "y", "fold", 5).filter("fold = 2").collect()}
    assert len(before) == 48 and all(abs(before[i] - after[i]) < 1e-9 for i in before)  # the outer fold's targets teach nothing


def test_null_keys_meet_in_joins(spark):
    a = spark.createDataFrame([(None, 1), (2, 2)], "k long, v long")
    b = spark.createDataFrame([(None, 5)], "k long, w long")
    assert sorted(map(str, (tuple(r) for r in groups.same_keys(a, b, ["k"], "left").collect()))) == ["(2, 2, None)", "(None, 1, 5)"]
    assert groups.same_keys(a, b, ["k"], "left_anti").count() == 1


def test_linear_models_with_holes_everywhere(spark):
    """A model per scope and target from the rows that have the target; holes take the mean of the scope's other folds."""
    g = np.random.default_rng(3)
    n = 360
    a, b = g.normal(size=n), g.normal(size=n)
    y = np.exp(2 + 0.6 * a - 0.4 * b)
    rows = [(i, None if i % 3 == 2 else "ab"[i % 2], None if i % 29 == 0 else float(a[i]), float("nan") if i % 31 == 0 else float(b[i]), None if i % 4 == 0 else float(y[i]), float(y[i]) + 1, None if i % 5 == 4 else i % 5) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, scope string, a double, b double, y double, z double, fold int")

    def plain(scope, k):
        own = [r for r in rows if r[1] == scope and r[k] is not None]
        pred, true = [], []
        for f in {r[6] for r in own}:
            train, test = [r for r in own if r[6] != f], [r for r in own if r[6] == f]
            mean = [np.mean([r[c] for r in train if r[c] is not None and r[c] == r[c]]) for c in (2, 3)]
            x = lambda rs: np.array([[1.0, *(m if r[c] is None or r[c] != r[c] else r[c] for c, m in zip((2, 3), mean))] for r in rs])  # noqa: B023, E731
            w = np.linalg.lstsq(x(train), np.log1p([r[k] for r in train]), rcond=None)[0]
            pred += list(np.expm1(x(test) @ w))
            true += [r[k] for r in test]
        pred, true = np.array(pred), np.array(true)
        return len(true), 1 - ((true - pred) ** 2).sum() / ((true - true.mean()) ** 2).sum()

    got = {(r["scope"], r.target): (r.n, r.r2) for r in linear.by_scope(df, ["a", "b"], ["y", "z"], "scope", "fold").collect()}
    assert set(got) == {(s, t) for s in ("a", "b", None) for t in ("y", "z")}
    for (s, t), (count, r2) in got.items():
        want = plain(s, {"y": 4, "z": 5}[t])
        assert count == want[0] and abs(r2 - want[1]) < 1e-6, (s, t)
    p = linear.out_of_fold(df, {"line": (0.0, 0.0)}, ["a", "b"], "y", "fold")
    assert p.count() == n and p.filter("pred IS NULL OR isnan(pred)").isEmpty() and p.filter("fold IS NULL").count() == n // 5
    assert linear.by_scope(df.withColumn("fold", F.lit(1)), ["a"], ["y"], "scope", "fold").filter("r2 IS NULL").count() == 3
    assert linear.by_scope(df.filter("false"), ["a"], ["y"], "scope", "fold").count() == 0
    assert linear.out_of_fold(df.filter("false"), {"line": (0.0, 0.0)}, ["a"], "y", "fold").count() == 0


def test_members_of_large_groups_are_kept(spark):
    from terrasift.operators import links

    df = spark.createDataFrame([(i, "hot" if i < 3000 else None if i % 2 else f"g{i % 40}") for i in range(4000)], "id long, spot string")
    m = links.members(df, "spot", most=100)
    assert m.agg(F.sum("n_part")).first()[0] == 4000 and m.agg(F.max("n_part")).first()[0] <= 100
    assert m.filter("spot = 'g10'").count() == 1
    assert links.via_members(m, df.select("id"), "spot").count() == 4000


def test_jobs_over_many_input_sets_store_their_table_once(spark, monkeypatch):
    """Folds are dealt once, however many input sets are evaluated."""
    from terrasift.plans import learn

    stored = []
    monkeypatch.setattr(learn, "cut", lambda df: stored.append(df) or df)
    p = spark.range(60).selectExpr("id", "CAST(id % 3 AS INT) AS fold", "CAST(id AS DOUBLE) AS a", "CAST(id * 7 % 11 AS DOUBLE) AS b", "CAST(id + 1 AS DOUBLE) AS v")
    rows = learn.ablation(p, lambda f: learn.line(f[0], "v"), {"a": ["a"], "b": ["b"]}, "v", "fold", 3).collect()
    assert len(rows) == 2 and len(stored) == 1
