"""Pair statistics over the pyramid of cells against all pairs, where positions are crowded."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrasift.operators import geostat, nearby, pyramid


def crowd(n=1500, seed=3):
    """A dense cloud in one cell, some of it at repeated positions, a cloud over a cell corner, a sparse rest."""
    g = np.random.default_rng(seed)
    xy = np.vstack([g.uniform(1000, 1900, (n // 2, 2)), g.normal(5000, 150, (n // 3, 2)), g.uniform(-20000, 20000, (n - n // 2 - n // 3, 2))]).round(1)
    xy[5:60] = xy[4]
    order = g.permutation(n)
    return pd.DataFrame({"id": np.arange(n), "x": xy[order, 0], "y": xy[order, 1], "v": g.normal(2, 1, n).round(3), "w": g.normal(0, 3, n).round(3), "fold": g.integers(0, 4, n)})


def distances(p):
    d = np.hypot(p.x.to_numpy()[:, None] - p.x.to_numpy(), p.y.to_numpy()[:, None] - p.y.to_numpy())
    return d, np.triu(np.ones(d.shape, bool), 1)


@pytest.fixture(scope="module")
def data(spark):
    p = crowd()
    return p, spark.createDataFrame(p)


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(pyramid, "CROWD", 30)
    monkeypatch.setattr(pyramid, "DIRECT", 40)


@pytest.mark.parametrize("keys", [[], ["fold"]])
def test_bins_match_all_pairs(data, keys):
    p, df = data
    d, up = distances(p)
    up &= d > 0
    if keys:
        up &= p.fold.to_numpy()[:, None] == p.fold.to_numpy()
    edges = [0.0, 30.0, 100.0, 250.0, 1000.0]
    got = {r.bin: (r.pairs, r.g_v, r.g_w) for r in pyramid.binned(nearby.locations(df, ["v", "w"], keys), edges, ["v", "w"], keys).collect()}
    for b, (lo, hi) in enumerate(zip(edges, edges[1:])):
        m = up & (d >= lo) & (d < hi)
        want = [0.5 * ((p[c].to_numpy()[:, None] - p[c].to_numpy()) ** 2)[m].sum() for c in "vw"]
        assert got[b][0] == m.sum() and np.allclose(got[b][1:], want), b


def test_neighbour_counts_match(data):
    p, df = data
    d, _ = distances(p)
    want = (d <= 100).sum(axis=1) - 1
    got = {r.id: r.n_near for r in nearby.count_within(df, 100.0).collect()}
    assert got == dict(zip(p.id.tolist(), want.tolist()))


def test_fold_pairs_match(data, spark):
    p, df = data
    d, up = distances(p)
    m = up & (d <= 100)
    split = m & (p.fold.to_numpy()[:, None] != p.fold.to_numpy())
    r = nearby.split_pairs(df, 100.0, "fold").first()
    assert (r.pairs, r.split_pairs) == (m.sum(), split.sum())
    holes = df.unionByName(spark.createDataFrame([(9001, None, 1.0, 0.0, 0.0, 1), (9002, None, None, 0.0, 0.0, None)], df.schema))
    assert nearby.split_pairs(holes, 100.0, "fold").first() == r
    assert nearby.split_pairs(df.filter("false"), 100.0, "fold").first()[0] == 0


def test_an_edge_on_a_distance_is_kept_apart(spark):
    """Positions on a grid of 10: very many distances equal an edge, which belongs to the bin above it (or to the closed end)."""
    xy = [(10.0 * i, 10.0 * j) for i in range(20) for j in range(20)]
    df = spark.createDataFrame([(k, x, y, 1.0) for k, (x, y) in enumerate(xy)], "id long, x double, y double, v double")
    a = np.array(xy)
    d = np.hypot(a[:, None, 0] - a[None, :, 0], a[:, None, 1] - a[None, :, 1])[np.triu_indices(400, 1)]
    edges = [10.0, 50.0, 100.0]
    got = {r.bin: r.pairs for r in pyramid.binned(nearby.locations(df, ["v"]), edges, ["v"]).collect()}
    assert got == {0: ((d >= 10) & (d < 50)).sum(), 1: ((d >= 50) & (d < 100)).sum()}
    assert pyramid.binned(nearby.locations(df), [0.0, 100.0], closed=True).first().pairs == (d <= 100).sum()
    assert nearby.count_within(df, 100.0).agg(F.sum("n_near")).first()[0] == 2 * (d <= 100).sum()


def test_pairs_of_one_position_count_in_the_first_band(data):
    p, df = data
    d, up = distances(p)
    got = {r.band: r.pairs for r in geostat.nearby_pairs(df.withColumn("v", F.abs("v")), ["v"], "fold", [0.0, 100.0, 500.0]).collect()}
    same = up & (p.fold.to_numpy()[:, None] == p.fold.to_numpy())
    assert got == {0: (same & (d < 100)).sum(), 1: (same & (d >= 100) & (d < 500)).sum()}


def test_work_follows_the_rim(spark, monkeypatch):
    """Four times the positions in one cell: the pairs of positions that are built grow far less than the pairs that exist."""
    monkeypatch.setattr(pyramid, "CROWD", 256)
    monkeypatch.setattr(pyramid, "DIRECT", 1024)
    built = []
    for n in (2000, 8000):
        g = np.random.default_rng(1)
        df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": g.uniform(0, 29, n), "y": g.uniform(0, 29, n)}))
        loc, _, crowded = pyramid.split(nearby.locations(df), 30.0)
        assert crowded
        built.append(sum(pyramid.positions(loc, side, direct).count() for side, _, direct in pyramid.opened(loc, [0.0, 30.0])))
        assert built[-1] < n * n / 8
    assert built[1] < 12 * built[0]  # 16 times the pairs exist


def test_class_shares_within_a_circle(spark, data, monkeypatch):
    """Dense pixels (and a third of them at one position) around points: whole cells by their sums, the rim opened."""
    monkeypatch.setattr(pyramid, "RIM", 4)
    g = np.random.default_rng(5)
    px = pd.DataFrame({"x": g.uniform(0, 3000, 3000).round(1), "y": g.uniform(0, 3000, 3000).round(1), "cls": g.integers(0, 4, 3000)})
    px.loc[:999, ["x", "y"]] = [1500.0, 1500.0]
    pts = pd.DataFrame({"id": range(60), "x": g.uniform(-500, 3500, 60).round(1), "y": g.uniform(-500, 3500, 60).round(1)})
    pts.loc[50:, ["x", "y"]] = [1500.0, 1500.0]
    holes = spark.createDataFrame([(99, None, 1.0)], "id long, x double, y double")
    got = {r.id: (r.pixels, r.one, r.two) for r in nearby.fraction_within(spark.createDataFrame(pts).unionByName(holes), spark.createDataFrame(px), 700.0, {"one": 1, "two": 2}).collect()}
    assert got.pop(99) == (0, 0.0, 0.0)
    for p in pts.itertuples():
        near = px[np.hypot(px.x - p.x, px.y - p.y) <= 700]
        want = (len(near), *((near.cls == c).mean() if len(near) else 0.0 for c in (1, 2)))
        assert got[p.id][0] == want[0] and np.allclose(got[p.id][1:], want[1:]), p


@pytest.mark.parametrize("heavy, paired, block", [(65536, 1 << 28, 4), (100, 2000, 64)])
def test_sums_of_blocks_match_all_pairs(data, monkeypatch, heavy, paired, block):
    """Blocks of many cells, of one, and opened ones: row pairs, half squares and distances per bin; no pair is a row of a join."""
    for name, value in (("HEAVY", heavy), ("PAIRED", paired), ("BLOCK", block), ("TILE", 8), ("HELD", 500), ("PARTS", 4)):
        monkeypatch.setattr(pyramid, name, value)
    monkeypatch.setattr(nearby, "pairs_of", None)
    p, df = data
    d, up = distances(p)
    up &= d > 0
    edges = [20.0, 100.0, 250.0, 1000.0]
    for lag in (False, True):
        got = {r.bin: r for r in pyramid.binned(nearby.locations(df, ["v", "w"]), edges, ["v", "w"], lag=lag).collect()}
        for b, (lo, hi) in enumerate(zip(edges, edges[1:])):
            m = up & (d >= lo) & (d < hi)
            want = [m.sum(), *(0.5 * ((p[c].to_numpy()[:, None] - p[c].to_numpy()) ** 2)[m].sum() for c in "vw"), *([d[m].sum()] if lag else [])]
            assert got[b].pairs == want[0] and np.allclose(got[b][1:], want, rtol=1e-9), (b, lag)
    same = up & (p.fold.to_numpy()[:, None] == p.fold.to_numpy())
    assert pyramid.binned(nearby.locations(df, keys=["fold"]), [0.0, 100.0], keys=["fold"], closed=True).first().pairs == (same & (d <= 100)).sum()
    table = {r.bin: r for r in geostat.lag_table(df, "v", [0.0, 100.0, 250.0]).collect()}
    m = np.triu(np.ones(d.shape, bool), 1) & (d < 100)
    assert table[0].pairs == m.sum() and np.isclose(table[0].lag, d[m].mean())
