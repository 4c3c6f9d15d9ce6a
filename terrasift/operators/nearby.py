"""Distance joins on grid cells: pairs, neighbour counts, exclusion by distance, fractions within a radius.

Rows at one exact position are folded into one location with a count and moments first, so repeated positions never
multiply into row pairs; a pair of locations stands for n_a * n_b row pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.functions.geo import distance, nowhere
from terrasift.operators.groups import same_keys

HALF = [(0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]
FULL = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def locations(df: DataFrame, values=(), keys=(), *, id: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """One row per exact position (and key values): lowest id, row count, mean and sum of squared deviations of values."""
    aggs = [F.min(id).alias("id"), F.count(F.lit(1)).alias("n")]
    for v in values:
        aggs += [F.avg(v).alias(f"{v}__m"), (F.var_pop(v) * F.count(v)).alias(f"{v}__ss")]
    return df.groupBy(F.col(x).alias("x"), F.col(y).alias("y"), *keys).agg(*aggs)


def _cells(df, side, offsets=None):
    df = df.withColumns({"cx": F.floor(F.col("x") / side).cast("long"), "cy": F.floor(F.col("y") / side).cast("long")})
    if offsets is None:
        return df
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets]))
    return df.withColumn("__o", o).withColumns({"cx": F.col("cx") + F.col("__o.i"), "cy": F.col("cy") + F.col("__o.j"), "__home": (F.col("__o.i") == 0) & (F.col("__o.j") == 0)}).drop("__o")


def pairs_of(loc: DataFrame, r: float, extra=(), keys=()) -> DataFrame:
    """Unordered pairs of locations at most r apart: a < b, d, n_a, n_b and both sides' extra columns.

    Only half of the neighbouring cells are visited, so each pair is built once. With ``keys``, only pairs of one value of the keys.
    """
    left = _cells(loc, r, HALF).select(*keys, "cx", "cy", "__home", *[F.col(c).alias(f"a__{c}") for c in ("id", "x", "y", "n", *extra)])
    right = _cells(loc, r).select(*keys, "cx", "cy", *[F.col(c).alias(f"b__{c}") for c in ("id", "x", "y", "n", *extra)])
    j = same_keys(left, right, [*keys, "cx", "cy"]) if keys else left.join(right, ["cx", "cy"])
    d = distance(F.col("a__x"), F.col("a__y"), F.col("b__x"), F.col("b__y"))
    once = ~F.col("__home") | (F.col("a__x") < F.col("b__x")) | ((F.col("a__x") == F.col("b__x")) & (F.col("a__y") < F.col("b__y")))
    j = j.withColumn("d", d).filter(once & (F.col("d") <= r))
    flip = F.col("a__id") > F.col("b__id")
    sides = []
    for c in ("id", "n", *extra):
        sides += [F.when(flip, F.col(f"b__{c}")).otherwise(F.col(f"a__{c}")).alias(f"{c}_a"), F.when(flip, F.col(f"a__{c}")).otherwise(F.col(f"b__{c}")).alias(f"{c}_b")]
    return j.select("d", *sides)


def pairs_within(df: DataFrame, r: float, **kw) -> DataFrame:
    """Pairs of positions at most r apart and the row pairs each stands for; rows sharing a position come as a = b, d = 0."""
    loc = locations(df, **kw)
    p = pairs_of(loc, r).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "d", (F.col("n_a") * F.col("n_b")).alias("row_pairs"))
    same = loc.filter(F.col("n") > 1).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("d"), F.expr("n * (n - 1) div 2").alias("row_pairs"))
    return p.unionByName(same)


def count_within(df: DataFrame, r: float, name: str = "n_near", *, id="id", x="x", y="y") -> DataFrame:
    """Other rows within r of each row; a row without a position is near nothing."""
    from terrasift.operators import pyramid

    loc = locations(df.filter(~nowhere(x, y)), id=id, x=x, y=y)
    near = pyramid.neighbours(loc, r)
    total = loc.join(near, loc["id"] == near["lid"], "left").select(F.col("x").alias("__x"), F.col("y").alias("__y"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias(name))
    out = df.join(total, (F.col(x) == F.col("__x")) & (F.col(y) == F.col("__y")), "left").drop("__x", "__y")
    return out.withColumn(name, F.coalesce(name, F.lit(0)))


def farther_than(train: DataFrame, test: DataFrame, r: float, **kw) -> DataFrame:
    """Training rows farther than r from every test row, by the nearest test distance: the cost does not grow with r."""
    from terrasift.operators.knn import nearest

    d = nearest(train, test, dist="__d", **kw).drop("nb")
    return d.filter(F.col("__d").isNull() | (F.col("__d") > r)).drop("__d")


def sample_pairs(sample: DataFrame, side_rows: int = 250, *, id="id", x="x", y="y", cols=()) -> DataFrame:
    """All pairs of a drawn sample (a < b) with distance, spread over block pairs by an equality join.

    Rows are hashed to blocks; the key (i, j), i <= j, takes block i on the left and block j on the right, so every
    unordered pair is built exactly once and no task holds more than side_rows squared of them.
    """
    n = sample.count()  # the size of the draw
    b = max(1, math.ceil(n / side_rows))
    s = sample.select(F.col(id).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"), *cols).withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(b)).cast("int"))
    names = ("id", "x", "y", *cols)
    left = s.withColumns({"lo": F.col("blk"), "hi": F.explode(F.sequence(F.col("blk"), F.lit(b - 1)))})
    right = s.withColumns({"hi": F.col("blk"), "lo": F.explode(F.sequence(F.lit(0), F.col("blk")))})
    left = left.select("lo", "hi", *[F.col(c).alias(f"a__{c}") for c in names])
    right = right.select("lo", "hi", *[F.col(c).alias(f"b__{c}") for c in names])
    # the input is tiny and the output large: fixed partitioning keeps the work spread
    parts = max(1, b * (b + 1) // 2)
    j = left.repartition(parts, "lo", "hi").join(right.repartition(parts, "lo", "hi"), ["lo", "hi"])
    j = j.filter((F.col("lo") < F.col("hi")) | (F.col("a__id") < F.col("b__id")))
    d = distance(F.col("a__x"), F.col("a__y"), F.col("b__x"), F.col("b__y"))
    flip = F.col("a__id") > F.col("b__id")

    def side(c, s_):
        one, other = ("a", "b") if s_ == "a" else ("b", "a")
        return F.when(flip, F.col(f"{other}__{c}")).otherwise(F.col(f"{one}__{c}"))

    return j.select(side("id", "a").alias("a"), side("id", "b").alias("b"), d.alias("d"), *[side(c, s_).alias(f"{c}_{s_}") for c in cols for s_ in "ab"])


def fraction_within(points: DataFrame, px: DataFrame, r: float, codes: dict, *, cls="cls", id="id", x="x", y="y") -> DataFrame:
    """Share of each class among the pixels within r of each point; points at one position are answered once."""
    from terrasift.operators import pyramid

    loc = points.filter(~nowhere(x, y)).select(F.col(x).alias("x"), F.col(y).alias("y")).distinct()
    # pixels of one position are folded with counts per class
    counts = [F.count(F.lit(1)).alias("n")] + [F.count_if(F.col(cls) == code).alias(f"c_{n}") for n, code in codes.items()]
    s = pyramid.class_counts(loc, px.filter(~nowhere("x", "y")).groupBy("x", "y").agg(*counts), r, [f"c_{n}" for n in codes])
    s = s.select(F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("n").alias("pixels"), *[(F.col(f"c_{n}") / F.col("n")).alias(n) for n in codes])
    out = points.join(s, (F.col(x) == F.col("__x")) & (F.col(y) == F.col("__y")), "left").drop("__x", "__y")
    return out.na.fill(0, ["pixels", *codes])


def split_pairs(df: DataFrame, r: float, fold: str, *, id="id", x="x", y="y") -> DataFrame:
    """Row pairs within r and how many of them lie in two different folds: all pairs less those of one fold. A NULL fold is a fold."""
    from terrasift.operators import pyramid

    known = df.filter(~nowhere(x, y)).withColumnRenamed(fold, "__fold")

    def pairs(keys):
        loc = locations(known, keys=keys, id=id, x=x, y=y)
        own = loc.select(F.expr("n * (n - 1) div 2").alias("pairs"))
        return pyramid.binned(loc, [0.0, r], keys=keys, closed=True).select("pairs").unionByName(own).agg(F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("pairs"))

    t = pairs([]).crossJoin(F.broadcast(pairs(["__fold"]).withColumnRenamed("pairs", "same")))  # one row each
    return t.select("pairs", (F.col("pairs") - F.col("same")).alias("split_pairs")).withColumn("split_share", F.try_divide("split_pairs", "pairs"))
