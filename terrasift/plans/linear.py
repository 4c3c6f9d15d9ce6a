"""Linear models out of fold from sums of products: one pass for all folds and penalties."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.operators import metric
from terrasift.operators.groups import same_keys
from terrasift.plans.jobs import literal_table


def _clean(c: str):
    """An input as a double; NaN counts as NULL."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None))


def _parts(feats, t: str):
    """(1, inputs with 0 for a hole, whether each has a hole, target): from their products follow those of imputed inputs for any imputed value."""
    return [F.lit(1.0), *[F.coalesce(_clean(c), F.lit(0.0)) for c in feats], *[_clean(c).isNull().cast("double") for c in feats], F.col(t)]


def sums_of_products(df: DataFrame, keys, feats, t: str) -> dict[tuple, np.ndarray]:
    """Per key values the matrix of sums of products of ``_parts`` over the rows with a target: numbers squared in the inputs reach the driver."""
    cols, keys = _parts(feats, t), list(keys)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1)]
    rows = df.filter(F.col(t).isNotNull()).groupBy(*keys).agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in rows:
        m = np.zeros((len(cols), len(cols)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        out[tuple(r[k] for k in keys)] = m
    return out


def imputed(sums: np.ndarray, inputs: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums of products of (1, inputs, target) with each hole filled by the mean of the known values, those means; 0 where none is known)."""
    known = sums[0, 0] - sums[0, 1 + inputs : 1 + 2 * inputs]
    mean = np.divide(sums[0, 1 : 1 + inputs], known, out=np.zeros(inputs), where=known > 0)
    return _fill(sums, mean), mean


def solve(sums: np.ndarray, reg: float, l1: float, rounds: int = 10_000) -> tuple[float, np.ndarray]:
    """(intercept, weights) of the least-squares line with an elastic-net penalty on standardised inputs and target.

    l1 = 0 is ridge, 1 is lasso; reg = 0 is least squares. Inputs that do not vary get weight 0.
    """
    n = sums[0, 0]
    mean = sums[0, 1:] / n
    cov = sums[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    ok = sd[:-1] > 1e-12 * (1 + np.abs(mean[:-1]))
    scale = np.where(sd > 0, sd, 1.0)
    c = cov / np.outer(scale, scale)
    gram, right, w = c[:-1, :-1], c[:-1, -1], np.zeros(len(mean) - 1)
    at = np.flatnonzero(ok)
    if reg * l1 == 0:
        w[at] = np.linalg.lstsq(gram[np.ix_(at, at)] + reg * np.eye(len(at)), right[at], rcond=None)[0]
    else:
        for _ in range(rounds):
            before = w.copy()
            for j in at:
                z = right[j] - gram[j] @ w + gram[j, j] * w[j]
                w[j] = np.sign(z) * max(abs(z) - reg * l1, 0.0) / (gram[j, j] + reg * (1 - l1))
            if np.abs(w - before).max(initial=0.0) < 1e-12:
                break
    w = w * scale[-1] / scale[:-1]
    return float(mean[-1] - w @ mean[:-1]), w


def _value(feats):
    """The line of a row from the columns __a, __w and __m of its model; holes take the model's training mean."""
    return sum((F.col("__w")[i] * F.coalesce(_clean(c), F.col("__m")[i]) for i, c in enumerate(feats)), F.col("__a"))


def _model(sums: np.ndarray, inputs: int, reg: float, l1: float) -> tuple[float, list[float], list[float]]:
    full, mean = imputed(sums, inputs)
    a, w = solve(full, reg, l1)
    return a, [float(x) for x in w], [float(x) for x in mean]


def out_of_fold(df: DataFrame, named: dict[str, tuple[float, float]], feats, y: str, fold: str) -> DataFrame:
    """Rows x models with ``model`` and ``pred``: log1p target, clipped to the training range; named: model -> (reg, l1).

    Every model of every fold comes from the same sums, as the total minus the fold. Rows without a target teach nothing and are
    predicted; NULL and NaN inputs take the mean of the other folds. A NULL fold is a fold. Where no other fold has a target, pred is NULL.
    """
    feats = list(feats)
    known = df.withColumn("__t", F.log1p(y))
    sums = {k[0]: m for k, m in sums_of_products(known, [fold], feats, "__t").items()}
    ends = {r[0]: (r[1], r[2]) for r in known.filter("__t IS NOT NULL").groupBy(fold).agg(F.min("__t"), F.max("__t")).collect()}
    width = 2 * len(feats) + 2
    total = sum(sums.values(), np.zeros((width, width)))
    rows = []
    for f in [r[0] for r in df.select(fold).distinct().collect()]:
        left = total - sums.get(f, 0.0)
        others = [e for g, e in ends.items() if g != f]
        for name, (reg, l1) in named.items():
            if others:
                a, w, m = _model(left, len(feats), reg, l1)
                rows.append((f, name, a, w, m, float(min(e[0] for e in others)), float(max(e[1] for e in others))))
            else:
                rows.append((f, name, None, [0.0] * len(feats), [0.0] * len(feats), None, None))
    if not rows:
        return df.withColumns({"model": F.lit(None).cast("string"), "pred": F.lit(None).cast("double")}).filter("false")
    t = literal_table(df.sparkSession, rows, [fold, "model", "__a", "__w", "__m", "__lo", "__hi"])
    out = same_keys(df, F.broadcast(t), [fold])  # one row per fold and model
    z = _value(feats)
    return out.withColumn("pred", F.when(F.col("__a").isNotNull(), F.expm1(F.greatest("__lo", F.least("__hi", z))))).drop("__a", "__w", "__m", "__lo", "__hi")


def by_scope(df: DataFrame, feats, targets, scope: str, fold: str) -> DataFrame:
    """(scope, target, n, r2) of least-squares models fitted and scored out of fold inside each scope: two passes for all of them.

    Sums are taken per target over the rows that have it, so a row without one target still teaches the others; holes in the inputs
    take the mean of the scope's other folds. NULL scopes and folds are values like others. n counts the rows with the target; a
    scope whose rows are in one fold has no model and r2 NULL.
    """
    feats, targets = list(feats), list(targets)
    each = F.inline(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("__y")) for t in targets]))
    # held as a pair, so that a scope or fold column may have any name
    long = df.select(F.col(scope).alias("__scope"), F.col(fold).alias("__fold"), *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(feats)], each)
    long = long.filter("__y IS NOT NULL").withColumn("__t", F.log1p("__y"))
    names = [f"__x{i}" for i in range(len(feats))]
    sums: dict = {}
    for (where, t, f), m in sums_of_products(long, ["__scope", "target", "__fold"], names, "__t").items():
        sums.setdefault((where, t), {})[f] = m
    rows = []
    for (where, t), per in sums.items():
        total = sum(per.values())
        for f, m in per.items():
            if (total - m)[0, 0] > 0.5:
                a, w, mean = _model(total - m, len(feats), 0.0, 0.0)
                rows.append((where, t, f, a, w, mean))
    if rows:
        table = literal_table(df.sparkSession, rows, ["__scope", "target", "__fold", "__a", "__w", "__m"])
        p = same_keys(long, F.broadcast(table), ["__scope", "target", "__fold"], "left")  # one row per scope, target and fold
        p = p.withColumn("__p", F.expm1(_value(names)))
    else:
        p = long.withColumn("__p", F.lit(None).cast("double"))
    r2 = F.when(F.count("__p") > 0, metric.r2("__y", "__p")).alias("r2")
    return p.groupBy(F.col("__scope").alias(scope), "target").agg(F.count("__y").alias("n"), r2)


def _residual(sums: np.ndarray, a: float, w) -> tuple[float, float]:
    """(sum of squared errors, sum of squares about the mean) of the line on rows given by their sums of products (1, inputs, target)."""
    v = np.array([a, *w, -1.0])
    n, mean = sums[0, 0], sums[0, -1] / max(sums[0, 0], 1.0)
    return float(v @ sums @ v), float(sums[-1, -1] - n * mean * mean)


def _fill(sums: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Sums of products of held-out rows whose holes take the training means."""
    inputs = len(mean)
    to = np.zeros((inputs + 2, len(sums)))
    to[0, 0] = to[-1, -1] = 1.0
    for i in range(inputs):
        to[1 + i, 1 + i], to[1 + i, 1 + inputs + i] = 1.0, mean[i]
    return to @ sums @ to.T


def nested(df: DataFrame, settings, feats, y: str, group: str, fold: str, n_folds: int, inner: int = 3, seed: int = 7) -> DataFrame:
    """(outer, reg, l1, inner_r2, chosen, outer_r2): every setting scored on inner folds of each outer fold's training groups, the best one refitted.

    ``settings`` are pairs (reg, l1). All fits and all scores, of log1p targets, follow from the sums of products per outer and inner
    fold, so one pass over the rows serves every setting. inner_r2 is the mean over the inner folds; ties go to the earlier setting.
    outer_r2 is the score of the setting refitted on the whole training part, on the rows of the outer fold. Rows without a target
    or a group take no part; NULL inputs take the training mean of the fit at hand.
    """
    from terrasift.plans import designs

    feats, settings = list(feats), [(float(r), float(e)) for r, e in settings]
    known = df.filter(F.col(y).isNotNull() & F.col(group).isNotNull()).withColumn("__t", F.log1p(y))
    own = {k[0]: m for k, m in sums_of_products(known, [fold], feats, "__t").items()}
    dealt = designs.inner_folds(known, group, fold, n_folds, inner, seed)
    parts: dict = {}
    for (o, i), m in sums_of_products(dealt, ["outer", "inner"], feats, "__t").items():
        parts.setdefault(o, {})[i] = m

    def r2(train, test, reg, l1):
        full, mean = imputed(train, len(feats))
        a, w = solve(full, reg, l1)
        sse, sst = _residual(_fill(test, mean), a, w)
        return 1.0 - sse / sst if sst > 0 else None

    rows = []
    for o, per in sorted(parts.items()):
        total = sum(per.values())
        scores = []
        for reg, l1 in settings:
            s = [r2(total - m, m, reg, l1) for m in per.values() if (total - m)[0, 0] > 0.5]
            s = [v for v in s if v is not None]
            scores.append(float(np.mean(s)) if s else None)
        best = max(range(len(settings)), key=lambda k: (-np.inf if scores[k] is None else scores[k], -k))
        for k, (reg, l1) in enumerate(settings):
            rows.append((int(o), reg, l1, scores[k], k == best, r2(total, own[o], reg, l1) if o in own else None))
    if not rows:
        return df.sparkSession.createDataFrame([], "outer long, reg double, l1 double, inner_r2 double, chosen boolean, outer_r2 double")
    return literal_table(df.sparkSession, rows, ["outer", "reg", "l1", "inner_r2", "chosen", "outer_r2"])


def run_jobs(jobs: DataFrame, path: str, keys, axes, one) -> DataFrame:
    """Run the jobs of a table that ``path`` does not hold yet and append their results.

    ``axes`` are the columns that need a pass of their own (seed, design); ``one(*values)`` gives the result rows of all other
    combinations at once, keyed by ``keys``. Only the distinct axis values reach the driver. A rerun after a crash goes on where it ended.
    """
    from terrasift.sources import tables

    spark = jobs.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    stored = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    todo = tables.missing_keys(jobs, spark.read.parquet(path), keys) if stored else jobs
    for values in todo.select(*axes).distinct().orderBy(*axes).collect():
        done = one(*values).withColumns({a: F.lit(v) for a, v in zip(axes, values, strict=True)})
        tables.append_missing(done.join(jobs.select(*keys), list(keys), "left_semi"), path, list(keys))
    return spark.read.parquet(path)
