"""The ways large groups take give the same answer as the plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrasift.operators import metric
from terrasift.operators.quantiles import quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    g = np.random.default_rng(3)
    n = 6000
    v = np.where(np.arange(n) % 3 == 0, 7.0, np.exp(g.normal(0, 3, n)).round(3))
    k = np.where(np.arange(n) % 2 == 0, "hot", (np.arange(n) % 40).astype(str))
    pdf = pd.DataFrame({"k": k, "v": v, "w": g.normal(size=n).round(2)})
    return pdf, spark.createDataFrame(pdf)


def test_bracketed_quantiles_are_exact(skewed):
    pdf, df = skewed
    ps = [0.05, 0.25, 0.5, 0.9]
    got = {r["k"]: r for r in quantiles(df, ["k"], ["v", "w"], ps, heavy_rows=500).collect()}
    assert len(got) == pdf.k.nunique()
    for k, part in pdf.groupby("k"):
        for c in "vw":
            for p, name in zip(ps, ("p5", "p25", "p50", "p90")):
                assert abs(got[k][f"{c}_{name}"] - part[c].quantile(p)) < 1e-9, (k, c, p)
    r = quantiles(df, [], ["v"], ps, heavy_rows=500).first()
    assert abs(r["v_p50"] - pdf.v.median()) < 1e-9


def test_average_rank_matches_pandas(skewed):
    pdf, df = skewed
    d = df.withColumn("i", F.monotonically_increasing_id())
    got = metric.average_rank(d, ["k"], "v", "rk").toPandas().sort_values("i").reset_index(drop=True)
    want = got.groupby("k").v.rank()
    assert np.allclose(got.rk, want)


def test_rows_of_a_heavy_group_stay_where_they_are(spark):
    """The brackets go to the rows: no join shuffles a heavy group's rows to one task, however small Spark thinks the sides are."""
    from terrasift.operators.quantiles import quantiles as exact

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q = exact(spark.range(20_001).selectExpr("double(id * 7 % 20001) AS v"), [], ["v"], [0.5, 0.9], 1000)
        assert tuple(q.first()) == (10000.0, 18000.0)
        assert "SortMergeJoin" not in q._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
