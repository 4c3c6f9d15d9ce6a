"""Pair statistics over whole tables against all pairs of rows."""

import numpy as np
import pandas as pd
import pytest

from terrasift.operators import geostat
from terrasift.operators.quantiles import weighted_medians


def all_pairs(p, r):
    i, j = np.triu_indices(len(p), 1)
    m = np.hypot(p.x.to_numpy()[i] - p.x.to_numpy()[j], p.y.to_numpy()[i] - p.y.to_numpy()[j]) <= r
    a, b = p.v.to_numpy()[i[m]], p.v.to_numpy()[j[m]]
    return np.abs(a - b), np.abs(a - b) / ((a + b) / 2)


def test_pair_differences_count_rows(spark):
    """Rows that share a position, and rows that share position and value, are pairs like any others."""
    g = np.random.default_rng(4)
    p = pd.DataFrame({"id": np.arange(900), "x": g.uniform(0, 3000, 900).round(0), "y": g.uniform(0, 3000, 900).round(0), "v": g.integers(1, 60, 900) / 2})
    p.loc[:299, ["x", "y"]] = [1000.0, 1000.0]
    p.loc[300:340, ["x", "y"]] = p.loc[341:381, ["x", "y"]].to_numpy()
    d, rel = all_pairs(p, 500.0)
    holes = spark.createDataFrame([(9001, None, 1.0, 4.0), (9002, None, 1.0, 9.0)], "id long, x double, y double, v double")
    got = geostat.pair_difference(spark.createDataFrame(p).unionByName(holes), "v", 500.0).first()
    assert got.pairs == len(d)
    assert np.allclose([got.share_above, got.abs_diff_p50, got.rel_diff_p50], [(rel > 0.3).mean(), np.median(d), np.median(rel)])
    assert geostat.pair_difference(holes, "v", 500.0).first().pairs == 0


@pytest.mark.parametrize("most", [1, 40, 10_000])
def test_weighted_medians_are_exact(spark, most):
    g = np.random.default_rng(5)
    for k in range(2):
        v, u, w = g.normal(size=300 + k).round(2), g.normal(size=300 + k), g.integers(1, 4, 300 + k)
        w[np.argsort(v)[:7]] = 4000 * k + 1  # the middle is far from that of the rows
        df = spark.createDataFrame(pd.DataFrame({"v": v, "u": u, "w": w, "o": v * 0 + 7})).unionByName(spark.createDataFrame([(float("nan"), None, 99, None)], "v double, u double, w long, o double"))
        got = weighted_medians(df, ["v", "u", "o"], "w", most)
        assert np.allclose(list(got.values()), [np.median(np.repeat(c, w)) for c in (v, u)] + [7.0], rtol=0, atol=1e-12)
    two = spark.createDataFrame([(1.0, 5), (4.0, 5)], "v double, w long")
    assert weighted_medians(two, ["v"], "w", most) == {"v": 2.5} and weighted_medians(two.filter("false"), ["v"], "w", most) == {"v": None}


def test_semivariogram_takes_all_pairs(spark):
    """The far bins hold every pair, not those of a draw."""
    g = np.random.default_rng(6)
    p = pd.DataFrame({"id": np.arange(5000), "x": g.uniform(0, 300_000, 5000), "y": g.uniform(0, 300_000, 5000), "v": g.normal(size=5000)})
    got = {r.bin: r for r in geostat.semivariogram(spark.createDataFrame(p), "v").collect()}
    i, j = np.triu_indices(5000, 1)
    d = np.hypot(p.x.to_numpy()[i] - p.x.to_numpy()[j], p.y.to_numpy()[i] - p.y.to_numpy()[j])
    half = (p.v.to_numpy()[i] - p.v.to_numpy()[j]) ** 2 / 2
    for b, (lo, hi) in enumerate(zip(geostat.LAGS, geostat.LAGS[1:])):
        m = (d >= lo) & (d < hi)
        assert got[b].pairs == m.sum() and np.isclose(got[b].semivariance, half[m].mean(), rtol=1e-10), b


def test_kriging_is_fitted_on_all_training_rows(spark):
    """The variogram comes from all pairs, not from those of a draw; those of several trainings from one pass, coincident rows included."""
    from terrasift.plans import learn

    g = np.random.default_rng(8)
    p = pd.DataFrame({"id": np.arange(3000), "x": g.uniform(0, 50_000, 3000), "y": g.uniform(0, 50_000, 3000), "fold": g.integers(0, 3, 3000)})
    p.loc[:59, ["x", "y"]] = p.loc[60:119, ["x", "y"]].to_numpy()
    p["v"] = np.sin(p.x / 9000) + g.normal(size=3000) / 3
    df = spark.createDataFrame(p).unionByName(spark.createDataFrame([(9001, None, 1.0, 0, 2.0), (9002, 2.0, 1.0, 1, None)], "id long, x double, y double, fold long, v double"))
    edges = geostat.FIT_LAGS_KM
    km = p.assign(x=p.x / 1000, y=p.y / 1000)
    tables = {(r.left_out, r.bin): r for r in geostat.lag_tables(spark.createDataFrame(km), "v", edges, "fold", [-1, 0, 1, 2]).collect()}
    for f in (-1, 0, 1, 2):
        t = km[km.fold != f]
        i, j = np.triu_indices(len(t), 1)
        d = np.hypot(t.x.to_numpy()[i] - t.x.to_numpy()[j], t.y.to_numpy()[i] - t.y.to_numpy()[j])
        half = (t.v.to_numpy()[i] - t.v.to_numpy()[j]) ** 2 / 2
        for b, (lo, hi) in enumerate(zip(edges, edges[1:])):
            m = (d >= lo) & (d < hi)
            r = tables[f, b]
            assert r.pairs == m.sum() and np.allclose([r.lag, r.semivariance], [d[m].mean(), half[m].mean()], rtol=1e-9), (f, b)
    fits = learn.variograms(df, "v", "fold", [-1, 1])
    assert np.allclose(fits[1], learn.variogram(df.filter("fold <> 1"), "v")) and np.allclose(fits[-1], learn.variogram(df, "v"))
    out = learn.kriging_out_of_fold(df.filter("v IS NOT NULL"), "v", "fold", 3, k=8).select("id", "kriged")
    assert out.count() == 3001 and out.filter("kriged IS NULL").count() == 1
