"""Distance operators against brute force, with crowded and repeated positions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrasift.operators import cluster, geostat, knn, nearby
from terrasift.plans import designs


def crowd(n=900, seed=1):
    """A third of all rows at one position, a dense cloud, a sparse rest."""
    g = np.random.default_rng(seed)
    third = n // 3
    xy = np.vstack([np.tile([[5000.0, 5000.0]], (third, 1)), 5000 + g.normal(0, 40, (third, 2)), g.uniform(-90000, 90000, (n - 2 * third, 2))])
    return pd.DataFrame({"id": np.arange(n), "x": xy[:, 0].round(2), "y": xy[:, 1].round(2), "v": g.normal(size=n).round(4), "fold": g.integers(0, 4, n), "site": np.arange(n) // 3})


def brute(q, r, k, ok):
    out = {}
    for a in q.itertuples():
        d = np.round(np.hypot(r.x - a.x, r.y - a.y), 3)
        m = ok(a, r)
        c = sorted(zip(d[m], r.id[m]))[:k]
        out[a.id] = [(float(x), int(i)) for x, i in c]
    return out


@pytest.fixture(scope="module")
def data(spark):
    p = crowd()
    return p, spark.createDataFrame(p)


@pytest.mark.parametrize("mode", [None, "self", "fold", "site"])
def test_knn_equals_brute_force(spark, data, mode, monkeypatch):
    monkeypatch.setattr(knn, "LEAF", 40)
    p, df = data
    rules = {None: lambda a, r: np.ones(len(r), bool), "self": lambda a, r: r.id != a.id, "fold": lambda a, r: r.fold != a.fold, "site": lambda a, r: r.site != a.site}
    got = {r["id"]: [(s["d"], s["nb"]) for s in r["nbrs"]] for r in knn.knn(df, df, 5, exclude=mode).collect()}
    want = brute(p, p, 5, rules[mode])
    assert got == want


def test_knn_between_two_tables_within_a_key(spark, data, monkeypatch):
    monkeypatch.setattr(knn, "LEAF", 40)
    p, df = data
    q = crowd(300, 7).assign(id=lambda t: t.id + 10000)
    got = {r["id"]: [(s["d"], s["nb"]) for s in (r["nbrs"] or [])] for r in knn.knn(spark.createDataFrame(q), df, 4, by="fold").collect()}
    assert got == brute(q, p, 4, lambda a, r: r.fold == a.fold)


def test_knn_with_few_references(spark, data):
    p, df = data
    few = p.head(600).tail(3)
    got = {r["id"]: len(r["nbrs"]) for r in knn.knn(df, spark.createDataFrame(few), 10).collect()}
    assert set(got.values()) == {3}


def test_pairs_counts_and_fold_split(spark, data):
    p, df = data
    d = np.hypot(p.x.values[:, None] - p.x.values, p.y.values[:, None] - p.y.values)
    near = (d <= 30) & (np.arange(len(p))[:, None] != np.arange(len(p)))
    got = {r["id"]: r["n_near"] for r in nearby.count_within(df, 30.0).select("id", "n_near").collect()}
    assert got == dict(zip(p.id, near.sum(1)))
    r = nearby.pairs_within(df, 30.0).agg(F.sum("row_pairs")).first()[0]
    assert r == near.sum() // 2
    s = nearby.split_pairs(df, 30.0, "fold").first()
    cross = near & (p.fold.values[:, None] != p.fold.values)
    assert (s["pairs"], s["split_pairs"]) == (near.sum() // 2, cross.sum() // 2)


def test_exactly_thirty_metres_is_within(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 30.0, 0.0), (3, 60.001, 0.0)], "id int, x double, y double")
    assert sorted((r["id"], r["n_near"]) for r in nearby.count_within(df, 30.0).collect()) == [(1, 1), (2, 1), (3, 0)]
    assert {r["id"]: r["site"] for r in cluster.sites(df, 30.0).collect()} == {1: 1, 2: 1, 3: 3}


def test_chain_and_ring_are_one_site(spark):
    chain = [(i, 29.0 * i, 0.0) for i in range(31)]
    ring = [(100 + i, 5000 + 60 * math.cos(i / 16 * 2 * math.pi), 60 * math.sin(i / 16 * 2 * math.pi)) for i in range(16)]
    got = {r["id"]: r["site"] for r in cluster.sites(spark.createDataFrame(chain + ring, "id int, x double, y double"), 30.0).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[100 + i] for i in range(16)} == {100}


def test_sites_equal_graph_components(spark, data):
    p, df = data
    parent = list(range(len(p)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    d = np.hypot(p.x.values[:, None] - p.x.values, p.y.values[:, None] - p.y.values)
    for a, b in zip(*np.nonzero(np.triu(d <= 30, 1))):
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["id"]: r["site"] for r in cluster.sites(df, 30.0).select("id", "site").collect()}
    assert got == {i: find(i) for i in range(len(p))}


def test_long_path_component(spark):
    e = spark.range(400).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = cluster.components(e).agg(F.count("*"), F.max("root"), F.count_distinct("node")).first()
    assert tuple(got) == (401, 0, 401)


def test_lag_table_equals_row_pairs(spark, data):
    p, df = data
    edges = [0.0, 1.0, 50.0, 400.0]
    d = np.hypot(p.x.values[:, None] - p.x.values, p.y.values[:, None] - p.y.values)
    g = 0.5 * (p.v.values[:, None] - p.v.values) ** 2
    up = np.triu(np.ones_like(d, bool), 1)
    got = {r["bin"]: (r["pairs"], r["semivariance"]) for r in geostat.lag_table(df, "v", edges).collect()}
    for b, (lo, hi) in enumerate(zip(edges, edges[1:])):
        m = up & (d >= lo) & (d < hi)
        assert got[b][0] == m.sum() and abs(got[b][1] - g[m].mean()) < 1e-9


def test_buffer_drops_exactly_the_near_rows(spark, data):
    p, df = data
    test, train = df.filter("id % 7 = 0"), df.filter("id % 7 <> 0")
    a, b = p[p.id % 7 == 0], p[p.id % 7 != 0]
    d = np.round(np.hypot(b.x.values[:, None] - a.x.values, b.y.values[:, None] - a.y.values), 3).min(1)
    got = sorted(r["id"] for r in nearby.farther_than(train, test, 2000.0).select("id").collect())
    assert got == sorted(b.id[d > 2000])


def test_inner_folds_cover_training_groups_only(spark, data):
    _, df = data
    f = designs.inner_folds(designs.group_folds(df.select("id", "site"), "site", 3, 1), "site", "fold", 3, 2, 5)
    assert f.filter("outer = fold").isEmpty()
    assert f.groupBy("outer", "site").agg(F.count_distinct("inner").alias("c")).agg(F.max("c")).first()[0] == 1


def test_knn_parts_of_a_wide_reach_give_whole_lists(spark, data, monkeypatch):
    monkeypatch.setattr(knn, "LEAF", 40)
    monkeypatch.setattr(knn, "WIDE", 1)
    p, df = data
    got = {r["id"]: [(s["d"], s["nb"]) for s in r["nbrs"]] for r in knn.knn(df, df, 5, exclude="fold").collect()}
    assert got == brute(p, p, 5, lambda a, r: r.fold != a.fold)


def test_knn_visits_leaves_that_hold_rows_without_a_fold(spark, monkeypatch):
    """A leaf whose rows have the query's fold or none is not a leaf of that fold."""
    monkeypatch.setattr(knn, "LEAF", 20)
    g = np.random.default_rng(5)
    p = pd.DataFrame({"id": np.arange(600), "x": g.uniform(0, 1000, 600).round(2), "y": g.uniform(0, 1000, 600).round(2)})
    p["fold"] = np.where(p.id % 9 == 0, 9, (p.x > 300).astype(int))
    df = spark.createDataFrame(p).withColumn("fold", F.when(F.col("fold") < 9, F.col("fold")))
    got = {r["id"]: [(s["d"], s["nb"]) for s in r["nbrs"]] for r in knn.knn(df, df, 3, exclude="fold").filter("fold IS NOT NULL").collect()}
    want = brute(p, p, 3, lambda a, r: r.fold != a.fold)
    assert got == {i: want[i] for i in got} and len(got) == int((p.fold < 9).sum())


@pytest.mark.parametrize("mode", [None, "self"])
def test_knn_reduced_lists_are_the_same_numbers(spark, data, mode, monkeypatch):
    monkeypatch.setattr(knn, "LEAF", 40)
    _, df = data
    plain = knn.local_reference(knn.knn(df, df, 4, exclude=mode, cols=["v"]), "v").drop("nbrs")
    short = knn.knn(df, df, 4, exclude=mode, cols=["v"], reduce=lambda near: knn.reference_of(near, "v"))
    assert sorted(plain.collect()) == sorted(short.select(*plain.columns).collect())
