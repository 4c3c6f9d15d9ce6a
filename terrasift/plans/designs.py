"""Validation designs: hold-outs, folds and their scopes.

Row-level draws compare an md5 prefix with a threshold, so no row is ranked against all others. Group folds rank the
distinct groups only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions import geo
from terrasift.functions.feat import hashed, uniform


def random_holdout(df: DataFrame, key: str, p: float, seed: int) -> DataFrame:
    """is_test = 1 for about a share p of the keys; all rows of a key go the same way."""
    return df.withColumn("is_test", (uniform(F.col(key), seed) < p).cast("int"))


def group_folds(df: DataFrame, key: str, k: int, seed, name: str = "fold") -> DataFrame:
    """Fold per group: distinct keys in md5 order, dealt out in turn. No group is in two folds.

    Rows without a key are one group, dealt as the last one: they may belong together, so they are never split.
    """
    from terrasift.operators.groups import label, same_keys

    text = F.col(key).cast("string")
    keys = df.select(key).distinct().withColumn("__h", F.coalesce(F.concat(hashed(F.col(key), seed), F.lit(" "), text), F.lit("~")))
    f = label(keys, "__h", "__i").select(key, (F.col("__i") % k).cast("int").alias(name))
    return same_keys(df, f, [key])


def kfold(df: DataFrame, key: str, k: int, seed, name: str = "fold") -> DataFrame:
    """Fold per row key from the md5 prefix."""
    return df.withColumn(name, (F.conv(F.substring(hashed(F.col(key), seed), 1, 8), 16, 10).cast("long") % k).cast("int"))


def blocks(df: DataFrame, km: float, k: int, seed, x="x", y="y") -> DataFrame:
    """Spatial block folds on projected positions."""
    return group_folds(df.withColumn("block", geo.block(x, y, km)), "block", k, seed)


def fold_blocks(df: DataFrame, kms, k: int, seed, x="x", y="y") -> DataFrame:
    """One row per (block size, row): block and fold for several block sizes at once."""
    out = None
    for km in kms:
        t = blocks(df, km, k, seed, x, y).withColumn("km", F.lit(km))
        out = t if out is None else out.unionByName(t)
    return out


def site_blocks(df: DataFrame, km: float, k: int, seed, site: str = "site", x="x", y="y") -> DataFrame:
    """Block folds by site centroid, so that a site is never split."""
    from terrasift.operators.groups import centroid

    return blocks(centroid(df, [site], x, y), km, k, seed, "cx", "cy")


def leave_one_out(df: DataFrame, group: str, values) -> DataFrame:
    """One copy of the rows per held-out value, with is_test."""
    held = F.explode(F.array(*[F.lit(v) for v in values]))
    return df.withColumn("held_out", held).withColumn("is_test", (F.col(group) == F.col("held_out")).cast("int"))


def pairwise(df: DataFrame, group: str, values) -> DataFrame:
    """Train on one value, test on another: each row serves as training for its own value and as test for the others."""
    vals = F.array(*[F.lit(v) for v in values])
    tr = df.withColumn("train_on", F.col(group)).withColumn("test_on", F.explode(vals)).withColumn("is_test", F.lit(0))
    te = df.withColumn("test_on", F.col(group)).withColumn("train_on", F.explode(vals)).withColumn("is_test", F.lit(1))
    return tr.unionByName(te).filter(F.col("train_on") != F.col("test_on"))


def inner_folds(df: DataFrame, group: str, fold: str, n_outer: int, k: int, seed) -> DataFrame:
    """Per outer fold: its training rows with an inner fold dealt over the training groups only."""
    t = df.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(n_outer - 1)))).filter(F.col("outer") != F.col(fold))
    t = t.withColumn("__k", F.concat_ws(":", "outer", group))
    from terrasift.operators.groups import label

    keys = t.select("__k", "outer").distinct()
    keys = keys.withColumn("__h", F.concat(F.lpad(F.col("outer").cast("string"), 6, "0"), F.lit(" "), hashed(F.col("__k"), seed), F.lit(" "), F.col("__k")))
    f = label(keys, "__h", "__i").select("__k", (F.col("__i") % k).cast("int").alias("inner"))
    return t.join(f, "__k").drop("__k")


def buffered(df: DataFrame, held: DataFrame, block: str, radii, *, id="id", x="x", y="y") -> DataFrame:
    """(held-out block, training row, distance to the nearest test row of that block) for rows within the largest radius.

    Rows farther away are training rows at every radius, so they are never paired with a block; a row meets only the
    blocks whose cells are in reach.
    """
    from terrasift.operators.knn import nearest

    r = float(max(radii))
    test = df.join(held.select(F.col(block).alias("held")), F.col(block) == F.col("held"))
    cell = {"cx": F.floor(F.col(x) / r).cast("long"), "cy": F.floor(F.col(y) / r).cast("long")}
    reach = test.select("held", *[c.alias(n) for n, c in cell.items()]).distinct()
    offs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    reach = reach.withColumn("o", offs).select("held", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy")).distinct()
    near = df.withColumns(cell).join(reach, ["cx", "cy"]).filter(F.col(block) != F.col("held")).drop("cx", "cy")
    d = nearest(near, test.select("held", id, x, y), by="held", qid=id, rid=id, x=x, y=y, dist="buffer_dist").drop("nb")
    return d.filter(F.col("buffer_dist") <= r)


def buffered_counts(df: DataFrame, held: DataFrame, block: str, radii, **kw) -> DataFrame:
    """Training rows left per held-out block and radius."""
    return counts_of(buffered(df, held, block, radii, **kw), df, held, block, radii)


def counts_of(near: DataFrame, df: DataFrame, held: DataFrame, block: str, radii) -> DataFrame:
    """Training rows left per held-out block and radius, of the rows of ``buffered`` for these radii or greater ones."""
    inside = near.groupBy("held").agg(*[F.count_if(F.col("buffer_dist") <= r).alias(f"r{i}") for i, r in enumerate(radii)])
    sizes = df.join(held.select(F.col(block).alias("held")), F.col(block) == F.col("held")).groupBy("held").agg(F.count(F.lit(1)).alias("n_test"))
    total = df.agg(F.count(F.lit(1)).alias("n_all"))
    t = sizes.join(inside, "held", "left").crossJoin(F.broadcast(total))  # one-row side
    items = [F.struct(F.lit(float(r)).alias("radius"), (F.col("n_all") - F.col("n_test") - F.coalesce(F.col(f"r{i}"), F.lit(0))).alias("n_train")) for i, r in enumerate(radii)]
    return t.select("held", "n_test", F.inline(F.array(*items)))


def block_counts(df: DataFrame, scope: str, kms, x="x", y="y") -> DataFrame:
    """Occupied blocks per scope and block size, and over all scopes."""
    long = df.select(scope, F.inline(F.array(*[F.struct(F.lit(km).alias("km"), geo.block(x, y, km).alias("b")) for km in kms])))
    per = long.groupBy(F.col(scope).cast("string").alias("scope"), "km").agg(F.count_distinct("b").alias("blocks"))
    return per.unionByName(long.groupBy(F.lit("all").alias("scope"), "km").agg(F.count_distinct("b").alias("blocks")))


def train_test_distance(parts) -> DataFrame:
    """Distance profile per design; parts: (name, test rows, training rows, knn options)."""
    from terrasift.operators.knn import nearest
    from terrasift.operators.qa import distance_profile

    out = None
    for name, test, train, kw in parts:
        d = nearest(test, train, **kw).select(F.lit(name).alias("design"), F.col("nn_dist").alias("d"))
        out = d if out is None else out.unionByName(d)
    return distance_profile(out.filter("d IS NOT NULL"), ["design"], "d")
