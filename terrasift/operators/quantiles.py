"""Exact quantiles (linear interpolation) that survive very large groups.

The built-in ``percentile`` keeps every distinct value of a group in one task. Groups above a row limit therefore take
another exact way: a sketch gives a bracket of values around each wanted rank, rows below the bracket are only
counted, and just the values inside the bracket are ranked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasift.operators.groups import same_keys

HEAVY_ROWS = 2_000_000
ACCURACY = 100_000


def tag(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def _builtin(df, keys, cols, ps):
    g = df.groupBy(*keys)
    return g.agg(*[F.percentile(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(p)).alias(f"{c}_{tag(p)}") for c in cols for p in ps])


def _bracketed(df, keys, cols, ps, accuracy=ACCURACY):
    """Exact quantiles of heavy groups: three aggregations with bounded state per group."""
    spread = F.array(*[F.struct(F.lit(c).alias("__c"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("__v")) for c in cols])
    long = df.select(*keys, F.inline(spread)).filter(F.col("__v").isNotNull())
    gk = [*keys, "__c"]
    eps = 8.0 / accuracy
    probes = [q for p in ps for q in (max(0.0, p - eps), min(1.0, p + eps))]
    sk = long.groupBy(*gk).agg(
        F.count(F.lit(1)).alias("__n"),
        F.percentile_approx("__v", F.array(*[F.lit(q) for q in probes]), accuracy).alias("__b"),
    )
    want = sk.select(*gk, "__n", F.inline(F.array(*[
        F.struct(F.lit(i).alias("__i"), F.lit(p).alias("__p"), F.col("__b")[2 * i].alias("__lo"), F.col("__b")[2 * i + 1].alias("__hi"))
        for i, p in enumerate(ps)
    ])))
    want = want.withColumns({"__at": F.col("__p") * (F.col("__n") - 1)})
    want = want.withColumns({"__r0": F.floor("__at"), "__r1": F.ceil("__at")})
    # values inside the bracket with their counts; rows below it as one number. A shuffle by the group would send all its rows to one
    # task; there are at most rows / limit heavy groups, so their brackets are broadcast
    hit = same_keys(long, F.broadcast(want.select(*gk, "__i", "__lo", "__hi")), gk).filter(F.col("__v") <= F.col("__hi"))
    vals = hit.groupBy(*gk, "__i", F.when(F.col("__v") >= F.col("__lo"), F.col("__v")).alias("__v")).agg(F.count(F.lit(1)).alias("__m"))
    w = Window.partitionBy(*gk, "__i").orderBy(F.col("__v").asc_nulls_first())
    vals = vals.withColumn("__to", F.sum("__m").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    vals = vals.withColumn("__from", F.col("__to") - F.col("__m")).filter(F.col("__v").isNotNull())
    got = same_keys(vals, F.broadcast(want.select(*gk, "__i", "__p", "__at", "__r0", "__r1")), [*gk, "__i"])

    def at(r):
        return F.max(F.when((F.col("__from") <= F.col(r)) & (F.col(r) < F.col("__to")), F.col("__v")))

    frac = F.col("__at") - F.col("__r0")
    got = got.groupBy(*gk, "__i", "__at", "__r0").agg(at("__r0").alias("__a"), at("__r1").alias("__z"))
    # a rank outside its bracket would mean the sketch broke its bound: fail rather than answer wrongly
    got = got.withColumn("__q", F.when(F.col("__a").isNull() | F.col("__z").isNull(), F.raise_error(F.lit("quantile bracket missed"))).otherwise(F.col("__a") * (1 - frac) + F.col("__z") * frac))
    pick = [F.max(F.when((F.col("__c") == c) & (F.col("__i") == i), F.col("__q"))).alias(f"{c}_{tag(p)}") for c in cols for i, p in enumerate(ps)]
    out = got.groupBy(*keys).agg(*pick)
    return same_keys(df.select(*keys).distinct(), out, keys, "left") if keys else out


def quantiles(df: DataFrame, keys, cols, ps, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Exact quantiles per group, columns ``<col>_p<percent>``; NULL and NaN are left out.

    Group sizes are measured first over the key columns alone. NULL keys are a group like any other.
    """
    keys, cols, ps = list(keys), list(cols), list(ps)
    accuracy = max(100, min(ACCURACY, heavy_rows // 10))
    if not keys:
        if df.select(F.count(F.lit(1))).first()[0] <= heavy_rows:
            return _builtin(df, keys, cols, ps)
        return _bracketed(df, keys, cols, ps, accuracy)
    heavy = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > heavy_rows).drop("__n")
    if heavy.isEmpty():
        return _builtin(df, keys, cols, ps)
    light_part = same_keys(df, F.broadcast(heavy), keys, "left_anti")
    heavy_part = same_keys(df, F.broadcast(heavy), keys, "left_semi")
    return _builtin(light_part, keys, cols, ps).unionByName(_bracketed(heavy_part, keys, cols, ps, accuracy))


def _place(v, cuts):
    """How many of the sorted cuts lie below v, by halving."""
    if not cuts:
        return F.lit(0)
    m = len(cuts) // 2
    return F.when(v <= F.lit(cuts[m]), _place(v, cuts[:m])).otherwise(_place(v, cuts[m + 1 :]) + F.lit(m + 1))


def weighted_medians(df: DataFrame, cols, weight: str, most: int = HEAVY_ROWS) -> dict:
    """Exact median per column where each row stands for ``weight`` equal values; NULL and NaN are left out, None without values.

    A sketch of the rows proposes cuts, the weights between them are summed exactly, and the range that holds the middle is cut again
    until few rows are left to be ranked. So the answer is exact however far the weights are from the rows. All columns share the passes.
    """
    cols, out, state = list(cols), {}, {}
    spread = F.array(*[F.struct(F.lit(i).alias("c"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("v")) for i, c in enumerate(cols)])
    long = df.select(F.col(weight).cast("long").alias("w"), F.inline(spread)).filter("v IS NOT NULL AND w > 0")
    probes = sorted({*(i / 16 for i in range(1, 16)), *(0.5 + s * 2.0**-j for j in range(2, 13) for s in (-1, 1))})
    sketch = F.percentile_approx("v", F.array(*[F.lit(q) for q in probes]), ACCURACY // 10).alias("cuts")
    for r in long.groupBy("c").agg(F.count(F.lit(1)).alias("rows"), F.sum("w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"), sketch).collect():  # one row per column
        state[r.c] = {"rows": r.rows, "ends": ((r.w - 1) // 2, r.w // 2), "before": 0, "lo": r.lo, "hi": r.hi, "cuts": r.cuts}

    def within(open_):
        return long.filter(reduce(lambda a, b: a | b, [(F.col("c") == c) & F.col("v").between(state[c]["lo"], state[c]["hi"]) for c in open_]))

    def middle(c, low, high):
        out[cols[c]] = low + (high - low) / 2
        del state[c]

    while wide := [c for c in state if state[c]["rows"] > most]:
        place = F.lit(None).cast("int")
        for c in wide:
            place = F.when(F.col("c") == c, _place(F.col("v"), sorted({*state[c]["cuts"], state[c]["lo"]}))).otherwise(place)
        held = within(wide).groupBy("c", place.alias("b")).agg(F.count(F.lit(1)).alias("rows"), F.sum("w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        held = sorted(held.collect(), key=lambda r: (r.c, r.b))  # one row per column and cut
        for c in wide:
            t, upto, inside = state[c], state[c]["before"], []
            for r in (r for r in held if r.c == c):
                if upto <= t["ends"][1] and upto + r.w > t["ends"][0]:
                    t["before"] = t["before"] if inside else upto
                    inside.append(r)
                upto += r.w
            if len(inside) > 1 or inside[0].lo == inside[0].hi:  # the middle lies between two ranges, or its range is one value
                middle(c, inside[0].hi, inside[-1].lo)
            else:
                t.update(rows=inside[0].rows, lo=inside[0].lo, hi=inside[0].hi)
        again = [c for c in state if state[c]["rows"] > most]
        for r in within(again).groupBy("c").agg(sketch).collect() if again else ():
            state[r.c]["cuts"] = r.cuts
    if state:
        upto = F.sum("w").over(Window.partitionBy("c").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))  # at most `most` rows
        per = within(state).groupBy("c", "v").agg(F.sum("w").alias("w")).select("c", "v", (upto - F.col("w")).alias("a"), upto.alias("z"))
        at = F.coalesce(*[F.when(F.col("c") == c, F.array(*[F.lit(e - t["before"]) for e in t["ends"]])) for c, t in state.items()])
        for r in per.groupBy("c").agg(*[F.max(F.when((F.col("a") <= at[i]) & (F.col("z") > at[i]), F.col("v"))).alias(n) for i, n in enumerate(("low", "high"))]).collect():
            middle(r.c, r.low, r.high)
    return {c: out.get(c) for c in cols}


def medians(df: DataFrame, keys, cols, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    out = quantiles(df, keys, cols, [0.5], heavy_rows)
    return reduce(lambda d, c: d.withColumnRenamed(f"{c}_p50", c), cols, out)
