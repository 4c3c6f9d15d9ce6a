"""Feature-space neighbours and model plans on small tables."""

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from terrasift.operators import blockwise, features
from pyspark.sql import functions as F

from terrasift.plans import learn


def test_feature_knn_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(blockwise, "SLICE", 500)
    g = np.random.default_rng(5)
    X = np.vstack([np.zeros((150, 4)), g.normal(size=(300, 4)).round(3)])  # a third of the rows are one vector
    p = pd.DataFrame(X, columns=list("abcd")).assign(id=np.arange(450), fold=np.arange(450) % 3)
    df = spark.createDataFrame(p)
    got = {}
    for r in features.feature_knn(df, df, list("abcd"), 4, exclude="fold", bucket=40).collect():
        got.setdefault(r["id"], []).append((r["d"], r["nb"]))
    for i in range(450):
        d = np.round(np.sqrt(((X - X[i]) ** 2).sum(1)), 6)
        m = p.fold.values != p.fold[i]
        want = sorted(zip(d[m], p.id[m]))[:4]
        assert sorted(got[i]) == [(float(a), int(b)) for a, b in want], i


def test_out_of_fold_predicts_every_row_within_the_training_range(spark):
    g = np.random.default_rng(6)
    x = g.uniform(0, 10, 600)
    p = pd.DataFrame({"id": np.arange(600), "x": x, "y": np.exp(x / 5) + g.normal(0, 0.05, 600) + 1, "fold": np.arange(600) % 3})
    df = spark.createDataFrame(p)
    out = learn.out_of_fold(df, learn.regressor(learn.linear(0.0), ["x"], "y"), "fold", 3).toPandas()
    assert len(out) == 600 and out.pred.notna().all()
    assert out.pred.min() >= p.y.min() - 1e-6 and out.pred.max() <= p.y.max() + 1e-6
    assert 1 - ((out.y - out.pred) ** 2).sum() / ((out.y - out.y.mean()) ** 2).sum() > 0.8


def test_kriging_recovers_a_smooth_field(spark):
    g = np.random.default_rng(7)
    xy = g.uniform(0, 40000, (700, 2))
    z = np.sin(xy[:, 0] / 8000) + np.cos(xy[:, 1] / 9000)
    p = pd.DataFrame({"id": np.arange(700), "x": xy[:, 0], "y": xy[:, 1], "z": z})
    df = spark.createDataFrame(p)
    out = learn.kriging(df.filter("id >= 100"), df.filter("id < 100"), "z", k=16).select("id", "z", "kriged").toPandas()
    assert len(out) == 100 and np.corrcoef(out.z, out.kriged)[0, 1] > 0.97


def test_permuted_column_keeps_its_values(spark):
    df = spark.range(300).withColumn("v", F.col("id") * 2)
    out = learn.permuted(df, "v", "id", 1).toPandas()
    assert sorted(out.v) == list(range(0, 600, 2)) and (out.v != out.id * 2).mean() > 0.9
