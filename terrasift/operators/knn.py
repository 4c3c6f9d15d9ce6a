"""Exact k-nearest-neighbour joins on projected positions.

Plan, without an index or a nested-loop join:

1. Reference rows at one exact position are cut to the few lowest ids that could ever be wanted, and queries at one
   position are answered once. A placeholder position with a third of all rows is then a handful of rows.
2. A pyramid of cell counts cuts the plane into leaves of at most a few thousand references, small where the data is
   dense and large where it is sparse; levels finer than the average density are only built where cells are full.
3. Queries meet the references of their own leaf, as NumPy blocks inside the tasks. The k-th distance found there
   bounds the search. Where the own leaf holds too few eligible rows (sparse areas, excluded folds), the smallest cell
   with enough of them gives the bound by its far corner.
4. The queries of a leaf meet all references in their reach at once, so their lists are whole and need no ranking
   across tasks; only bounds are stored in between.

Ties in distance (rounded to ``tie`` decimals) go to the lower id.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasift.operators import groups
from terrasift.operators.blockwise import top_k
from terrasift.session import cut

LEAF = 2000  # reference positions per leaf
WIDE = 64  # leaves' worth of references that queries meet at once


def _finite(df, x, y):
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))


def _bounds(q, r, x, y):
    """(x low, y low, extent, reference rows) in one pass over the two coordinate columns."""
    both = r.select(x, y, F.lit(1).alias("__r"))
    if q is not r:
        both = both.unionByName(q.select(x, y, F.lit(0).alias("__r")))
    row = both.agg(F.min(x), F.min(y), F.max(x), F.max(y), F.sum("__r")).first()
    if row[0] is None:
        return 0.0, 0.0, 1.0, 0
    return row[0], row[1], max(row[2] - row[0], row[3] - row[1], 1e-6) * 1.001, row[4] or 0


def _levels(ref, que, gs, bs, kk, top, mid):
    """Level per query fine cell (and group): (coarse table, deep table or None).

    gs: the exclusion column, if any; bs: the column both sides must share, if any.
    """

    def up(c, lv):
        return F.expr(f"shiftright({c}, {lv})")

    def pyramid(cells, lo, hi, base):
        e = cells.withColumn("lv", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
        e = e.select("lv", up("cx", f"lv - {base}").alias("cx"), up("cy", f"lv - {base}").alias("cy"), *bs, *gs, "n")
        return e.groupBy("lv", "cx", "cy", *bs, *gs).agg(F.sum("n").alias("n"))

    def pick(qcells, pyr, lo, hi, base):
        at = ["lv", "cx", "cy", *bs]
        total = pyr.groupBy(*at).agg(F.sum("n").alias("t"))
        e = qcells.withColumn("lv", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
        e = e.select(F.col("cx").alias("qcx"), F.col("cy").alias("qcy"), *bs, *gs, "lv", up("cx", f"lv - {base}").alias("cx"), up("cy", f"lv - {base}").alias("cy"))
        e = e.join(total, at)
        if gs:
            e = e.join(pyr.withColumnRenamed("n", "own"), [*at, *gs], "left").withColumn("t", F.col("t") - F.coalesce("own", F.lit(0)))
        return e.filter(F.col("t") >= kk).groupBy("qcx", "qcy", *bs, *gs).agg(F.min("lv").alias("lv"))

    mids = [up("fx", mid).alias("cx"), up("fy", mid).alias("cy")]
    fine = ref.groupBy("fx", "fy", *bs, *gs).agg(F.count(F.lit(1)).alias("n"))
    at_mid = fine.groupBy(*mids, *bs, *gs).agg(F.sum("n").alias("n"))
    coarse = pick(que.select(*mids, *bs, *gs).distinct(), pyramid(at_mid, mid, top, mid), mid, top, mid)
    full = at_mid.groupBy("cx", "cy", *bs).agg(F.sum("n").alias("n")).filter(F.col("n") >= 2 * kk).drop("n")
    if mid == 0 or full.isEmpty():
        return coarse, None

    def crowded(df, cols):
        j = df.withColumns({"cx": up("fx", mid), "cy": up("fy", mid)}).join(full, ["cx", "cy", *bs], "left_semi")
        return j.select(F.col("fx").alias("cx"), F.col("fy").alias("cy"), *bs, *gs, *cols)

    deep_q = crowded(que, []).distinct()
    return coarse, pick(deep_q, pyramid(crowded(fine, ["n"]), 0, mid - 1, 0), 0, mid - 1, 0)


def _far_corner(que, ref, gs, bs, kk, top, mid, s0, tie):
    """Bound of the k-th distance from the smallest own cell with enough eligible references; infinite without one."""
    coarse, deep = _levels(ref, que, gs, bs, kk, top, mid)
    e = que.withColumns({"qcx": F.expr(f"shiftright(fx, {mid})"), "qcy": F.expr(f"shiftright(fy, {mid})")})
    e = e.join(coarse, ["qcx", "qcy", *bs, *gs], "left").drop("qcx", "qcy")
    if deep is not None:
        d = deep.withColumnsRenamed({"lv": "__dlv", "qcx": "fx", "qcy": "fy"})
        e = e.join(d, ["fx", "fy", *bs, *gs], "left").withColumn("lv", F.coalesce("__dlv", "lv")).drop("__dlv")
    s = F.pow(F.lit(2.0), F.col("lv")) * s0

    def far(u, f):
        lo = F.expr(f"shiftright({f}, lv)") * s
        return F.greatest(F.col(u) - lo, lo + s - F.col(u))

    bound = F.hypot(far("ux", "fx"), far("uy", "fy")) * (1 + 1e-9) + 10.0**-tie
    return e.withColumn("R", F.when(F.col("lv").isNotNull(), bound).otherwise(F.lit(float("inf")))).drop("lv")


def _touched(asks, leaves, bs, top, s0):
    """(group of queries, leaf) for every leaf that the group's box, widened by its greatest bound, touches.

    ``asks`` has one row per group: its box in ux0 ... uy1, R and the exclusion value ``one`` if its queries have the same. The widened box
    covers at most four cells on the level that fits its size. Leaves of that level and below are found there through their
    ancestor cells (a table of leaves x levels), larger leaves on their own level.
    """
    used = sorted(r[0] for r in leaves.select("llv").distinct().collect())  # at most 29 small integers
    under = leaves.withColumn("lv", F.explode(F.sequence(F.col("llv"), F.lit(top)))).withColumn("kind", F.lit(0))
    under = under.withColumns({"cx": F.expr("shiftright(lcx, lv - llv)"), "cy": F.expr("shiftright(lcy, lv - llv)")})
    self_ = leaves.withColumns({"lv": F.col("llv"), "kind": F.lit(1), "cx": F.col("lcx"), "cy": F.col("lcy")})
    tree = under.unionByName(self_)
    width = F.col("R") * 2.0 + F.greatest(F.col("ux1") - F.col("ux0"), F.col("uy1") - F.col("uy0"))
    whole = width >= s0 * 2.0**top
    fit = F.when(whole, F.lit(top)).otherwise(F.least(F.ceil(F.log2(F.greatest(width / s0, F.lit(1.0)))), F.lit(top))).cast("int")
    larger = F.filter(F.array(*[F.lit(v) for v in used]), lambda v: v > F.col("fit"))
    stops = F.concat(F.array(F.struct(F.col("fit").alias("lv"), F.lit(0).alias("kind"))), F.transform(larger, lambda v: F.struct(v.alias("lv"), F.lit(1).alias("kind"))))
    q = asks.withColumn("fit", fit).select(*asks.columns, F.inline(stops)).withColumn("s", F.pow(F.lit(2.0), F.col("lv")) * s0)
    last = F.expr(f"shiftright({2**top - 1}L, lv)")

    def span(u):
        lo = F.when(whole, F.lit(0)).otherwise(F.greatest(F.floor((F.col(f"{u}0") - F.col("R")) / F.col("s")), F.lit(0)))
        hi = F.when(whole, last).otherwise(F.least(F.floor((F.col(f"{u}1") + F.col("R")) / F.col("s")), last))
        return F.explode(F.sequence(F.least(lo, last).cast("long"), F.greatest(hi, F.lit(0)).cast("long")))

    q = q.withColumn("cx", span("ux")).withColumn("cy", span("uy")).drop("s")
    t = q.join(tree, ["lv", "kind", "cx", "cy", *bs])
    side = F.pow(F.lit(2.0), F.col("llv")) * s0

    def gap(u, c):
        lo = F.col(c) * side
        return F.greatest(lo - F.col(f"{u}1"), F.col(f"{u}0") - lo - side, F.lit(0.0))

    t = t.filter(F.hypot(gap("ux", "lcx"), gap("uy", "lcy")) <= F.col("R"))
    return t.filter(F.col("only").isNull() | F.col("one").isNull() | (F.col("only") != F.col("one"))).drop("only", "one", "lv", "kind", "cx", "cy")


def _two_pass(same, ref, que, fine, split, serving, take, bs, gs, qk, leaf, kk, cap, top, s0, origin, n_ref, depth, tie):
    """(qk, near) of every query: the own leaf bounds the k-th distance, then queries of one leaf meet all references in their reach at once.

    A leaf's queries are parted by the size of their bounds, so a few far-reaching ones do not widen the others' search. No list of
    neighbours is shuffled, but for groups whose reach holds more than WIDE leaves' worth of references: those meet them in parts.
    """
    # leaves: one level below the smallest cell with more than cap references; queries follow the same cells
    mid = top - min(top, depth(n_ref, cap))
    spots = ref.select("fx", "fy", *bs)
    cells = spots if same else spots.unionByName(que.select("fx", "fy", *bs))
    coarse, deep = _levels(spots, cells.distinct(), [], bs, cap + 1, top, mid)

    def leafed(df):
        out = df.withColumns({"qcx": F.expr(f"shiftright(fx, {mid})"), "qcy": F.expr(f"shiftright(fy, {mid})")})
        out = out.join(coarse, ["qcx", "qcy", *bs], "left").drop("qcx", "qcy")
        if deep is not None:
            d = deep.withColumnsRenamed({"lv": "__dlv", "qcx": "fx", "qcy": "fy"})
            out = out.join(d, ["fx", "fy", *bs], "left").withColumn("lv", F.coalesce("__dlv", "lv")).drop("__dlv")
        out = out.withColumn("llv", F.greatest(F.coalesce(F.col("lv") - 1, F.lit(top)), F.lit(0))).drop("lv")
        return out.withColumns({"lcx": F.expr("shiftright(fx, llv)"), "lcy": F.expr("shiftright(fy, llv)")})

    # the references are read several times from here on, so they are stored once
    ref = cut(leafed(ref))
    que = ref.select(F.col("rx").alias("qx"), F.col("ry").alias("qy"), *gs, *leaf).distinct() if same else leafed(que)
    # in a self-join a leaf has no more queries than references
    ask, have, keys = (que, ref, leaf) if same and "serves" not in ref.columns else (*split(que, serving(ref)), [*leaf, "salt"])
    slim = take | {"rcols": (), "qcols": (*qk[1:], *leaf[:3])}
    seen = cut(top_k(ask, have, keys, ["qx", "qy"], kk, give="bound", **slim))
    enough = F.col("c") >= kk
    at = {"ux": F.col("qx") - origin[0], "uy": F.col("qy") - origin[1]}
    asked = seen.filter(enough).withColumns(at).withColumn("R", F.col("R") + 10.0**-tie).drop("c")
    lost = seen.filter(~enough).drop("c", "R")
    if not lost.isEmpty():
        far = _far_corner(fine(lost, "qx", "qy").withColumns(at), ref, gs, bs, kk, top, top - min(top, depth(n_ref, kk)), s0, tie)
        asked = asked.unionByName(far.select(*asked.columns))
    side = F.pow(F.lit(2.0), F.col("llv")) * s0
    reach = F.when(F.col("R") <= side / 4, 0).when(F.col("R") >= s0 * 2.0**top, 64).otherwise(F.ceil(F.log2(F.col("R") * 4 / side))).cast("int")
    asked = asked.withColumn("rc", reach).withColumnsRenamed({"llv": "olv", "lcx": "ocx", "lcy": "ocy"})
    if not lost.isEmpty():
        asked = cut(asked)
    group = ["olv", "ocx", "ocy", "rc", *bs]
    # the value that all rows have, NULL if they differ or one has none
    one = F.when((F.min("g") == F.max("g")) & (F.count("g") == F.count(F.lit(1))), F.min("g")) if gs else F.lit(None).cast("int")
    box = [F.min("ux").alias("ux0"), F.max("ux").alias("ux1"), F.min("uy").alias("uy0"), F.max("uy").alias("uy1")]
    asks = asked.groupBy(*group).agg(F.max("R").alias("R"), *box, one.alias("one"), F.ceil(F.count(F.lit(1)) / (4.0 * cap)).cast("int").alias("salts"))
    leaves = serving(ref).groupBy(*leaf).agg(one.alias("only"), F.count(F.lit(1)).alias("n"))
    hits = cut(_touched(asks, leaves, bs, top, s0))
    sizes = cut(hits.groupBy(*group, "salts").agg(F.ceil(F.sum("n") / float(WIDE * cap)).cast("int").alias("parts")))
    names = [f"__o_{c}" for c in group]
    told = hits.drop("salts", "n").join(sizes, group).withColumnsRenamed(dict(zip(group, names)))
    told = told.withColumn("part", F.pmod(F.xxhash64(*leaf[:3]), F.col("parts")).cast("int")).drop("parts", *bs).withColumnsRenamed({f"__o_{b}": b for b in bs})
    u, v = F.col("rx") - origin[0], F.col("ry") - origin[1]
    margin = F.col("R") + 10.0**-tie
    within = u.between(F.col("ux0") - margin, F.col("ux1") + margin) & v.between(F.col("uy0") - margin, F.col("uy1") + margin)
    refs = serving(ref).select(*leaf, "nb", "rx", "ry", *gs, *take["rcols"]).join(told, leaf).filter(within)
    refs = refs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop(*leaf[:3], "R", "ux0", "ux1", "uy0", "uy1", "salts").withColumnsRenamed({f"__o_{c}": c for c in group})
    ask = asked.select(*qk, *[c for c in group if c not in qk], "R").join(sizes, group).withColumn("salt", F.pmod(F.xxhash64(*qk), F.col("salts")).cast("int"))
    ask = ask.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found = top_k(ask, refs, [*group, "salt", "part"], ["qx", "qy"], kk, radius="R", give="lists", **take | {"qcols": (*qk[1:], "parts")})
    if sizes.filter("parts > 1").isEmpty():
        return found.drop("parts")
    found = cut(found)
    merged = found.filter("parts > 1").groupBy(*qk).agg(F.flatten(F.collect_list("near")).alias("near"))
    order = F.array_sort(F.transform("near", lambda s: F.struct(s["d"].alias("d"), s["nb"].alias("nb"), s.alias("s"))))
    best = F.transform(F.slice(order, 1, kk), lambda t: t["s"])
    return found.filter("parts = 1").drop("parts").unionByName(merged.withColumn("near", best))


def knn(q: DataFrame, r: DataFrame, k: int, *, qid: str = "id", rid: str = "id", x: str = "x", y: str = "y", cols=(), exclude: str | None = None, by: str | None = None, tie: int = 3, name: str = "nbrs", reduce=None) -> DataFrame:
    """Rows of q with an array of their k nearest rows of r, nearest first: struct(nb id, d, *cols).

    exclude: None, ``"self"`` (never the row with the same id), or a column of both sides whose equal values never
    match (site, fold). by: a column of both sides that must be equal (group, outer fold). The array is shorter than k only where r has fewer eligible rows, and NULL where it has none. ``reduce`` makes columns (name -> Column) of the array; they come in its place, and the lists are not
    shuffled where no row is told from the others at its position. A query without any neighbour has NULLs.
    """
    own = exclude == "self"
    g = None if exclude in (None, "self") else exclude
    kk = k + 1 if own else k
    gs, bs = (["g"] if g else []), (["b"] if by else [])
    keyed = [*([F.col(by).alias("b")] if by else []), *([F.col(g).alias("g")] if g else [])]
    q_in = _finite(q, x, y)
    r_in = _finite(r, x, y)
    x0, y0, extent, n_ref = _bounds(q_in if q is not r else r_in, r_in, x, y)

    cap = max(LEAF, 20 * kk)

    def depth(n, per):
        return max(1, math.ceil(math.log(max(n, 4) / per, 4)) + 1) if n > per else 1

    # levels: 0 finest ... top (one cell)
    top = min(28, depth(n_ref, kk) + 8)
    s0 = extent / 2**top

    def fine(df, a, b):
        return df.withColumns({"fx": F.floor((F.col(a) - x0) / s0).cast("long"), "fy": F.floor((F.col(b) - y0) / s0).cast("long")})

    ref = r_in.select(F.col(rid).alias("nb"), F.col(x).alias("rx"), F.col(y).alias("ry"), *keyed, *cols)
    w = Window.partitionBy("rx", "ry", *bs, *gs).orderBy("nb")
    ref = ref.withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= kk)
    crowded = bool(gs) and not ref.groupBy("rx", "ry", *bs).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * kk).isEmpty()
    if crowded:
        # of a position's rows at most kk share a query's own value, so the first 2 kk hold kk others, however many values there are;
        # the rest only ask
        wp = Window.partitionBy("rx", "ry", *bs).orderBy("nb")
        ref = groups.same_keys(ref, ref.withColumn("__i", F.row_number().over(wp)).filter(F.col("__i") <= 2 * kk).select("nb", F.lit(True).alias("serves")).distinct(), ["nb"], "left")
    ref = fine(ref.drop("__i"), "rx", "ry")

    def serving(refs):
        return refs.filter("serves").drop("serves") if crowded else refs

    que = fine(q_in.select(F.col(x).alias("qx"), F.col(y).alias("qy"), *keyed).distinct(), "qx", "qy")

    qk = ["qx", "qy", *bs, *gs]
    leaf = ["llv", "lcx", "lcy", *bs]
    take = dict(rcoords=["rx", "ry"], qid="qx", rid="nb", exclude="g" if g else None, tie=tie, qcols=tuple(qk[1:]), rcols=tuple(cols))

    def split(qs, refs):
        """Leaves asked by very many queries are split; their references go to every part."""
        parts = qs.groupBy(*leaf).agg(F.ceil(F.count(F.lit(1)) / (4.0 * cap)).cast("int").alias("parts"))
        salted = qs.join(parts, leaf).withColumn("salt", F.pmod(F.xxhash64(*qk), F.col("parts")).cast("int"))
        return salted, refs.join(parts, leaf).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    if n_ref <= cap:
        # all references fit in one leaf: one pass is the answer
        one = {"llv": F.lit(top), "lcx": F.lit(0).cast("long"), "lcy": F.lit(0).cast("long")}
        ask, have = split(que.withColumns(one), serving(ref).withColumns(one))
        arr = top_k(ask, have, [*leaf, "salt"], ["qx", "qy"], kk, give="lists", **take)
    else:
        arr = _two_pass(q is r, ref, que, fine, split, serving, take, bs, gs, qk, leaf, kk, cap, top, s0, (x0, y0), n_ref, depth, tie)
    if reduce is not None and not own:
        arr = arr.select(*qk, *[c.alias(n) for n, c in reduce(F.slice("near", 1, k)).items()])
    else:
        arr = arr.withColumnRenamed("near", "__a")

    arr = arr.withColumnsRenamed({c: f"__{c}" for c in [*bs, *gs]})
    on = (F.col(x) == F.col("qx")) & (F.col(y) == F.col("qy"))
    if g:
        on = on & (F.col(g) == F.col("__g"))
    if by:
        on = on & (F.col(by) == F.col("__b"))
    out = q.join(arr, on, "left").drop("qx", "qy", "__g", "__b")
    if reduce is not None and not own:
        return out
    got = F.filter("__a", lambda s: s["nb"] != F.col(qid)) if own else F.col("__a")
    keep = F.transform(F.slice(got, 1, k), lambda s: F.struct(s["nb"].alias("nb"), s["d"].alias("d"), *[s[c].alias(c) for c in cols]))
    if reduce is not None:
        return out.withColumns(reduce(keep)).drop("__a")
    return out.withColumn(name, keep).drop("__a")


def knn_rows(q, r, k, *, qid="id", **kw) -> DataFrame:
    """One row per neighbour: (query id, rank from 1, nb, d, *cols)."""
    need = [qid, kw.get("x", "x"), kw.get("y", "y"), *[kw[o] for o in ("exclude", "by") if kw.get(o) not in (None, "self")]]
    slim = q.select(*dict.fromkeys([*need, *(kw.get("cols", ()) if q is r else ())]))
    a = knn(slim, slim if q is r else r, k, qid=qid, **kw)
    e = a.select(qid, F.posexplode("nbrs").alias("__p", "__s"))
    return e.select(qid, (F.col("__p") + 1).alias("rank"), F.col("__s.nb").alias("nb"), F.col("__s.d").alias("d"), *[F.col(f"__s.{c}").alias(c) for c in kw.get("cols", ())])


def nearest(q, r, cols=(), *, dist="nn_dist", **kw) -> DataFrame:
    """Attributes and distance of the nearest row of r."""

    def first(arr):
        one = F.get(arr, F.lit(0))
        return {"nb": one["nb"], dist: one["d"], **{c: one[c] for c in cols}}

    return knn(q, r, 1, cols=cols, reduce=first, **kw)


def weighted_mean(arr, v: str, weight, k: int | None = None):
    """sum(w v) / sum(w) over a neighbour array; entries with NULL v carry no weight. JVM side."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    a = arr if k is None else F.slice(arr, 1, k)
    known = F.filter(a, lambda s: s[v].isNotNull())
    num = F.aggregate(known, F.lit(0.0), lambda t, s: t + s[v] * weight(s["d"]))
    den = F.aggregate(known, F.lit(0.0), lambda t, s: t + weight(s["d"]))
    return F.try_divide(num, den)


def inverse(min_d: float = 1.0):
    """1 / max(d, min_d)"""
    return lambda d: 1.0 / F.greatest(d, F.lit(float(min_d)))


def inverse_plus(add: float):
    """1 / (d + add)"""
    return lambda d: 1.0 / (d + add)


def reference_of(arr, v: str, min_d: float = 1.0) -> dict:
    """Inverse-distance mean, nearest value, log distance and population sd of the neighbours' v, by name."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    vals, n = F.transform(arr, lambda s: s[v]), F.size(arr)
    mean = F.try_divide(F.aggregate(vals, F.lit(0.0), lambda t, z: t + z), n)
    var = F.try_divide(F.aggregate(F.transform(vals, lambda z: (z - mean) * (z - mean)), F.lit(0.0), lambda t, z: t + z), n)
    first = F.get(arr, F.lit(0))
    return {"lr_mean": weighted_mean(arr, v, inverse(min_d)), "lr_nearest": first[v], "lr_log_dist": F.log1p(first["d"]), "lr_sd": F.sqrt(var)}


def local_reference(df: DataFrame, v: str, arr: str = "nbrs", min_d: float = 1.0) -> DataFrame:
    """Adds the columns of ``reference_of``."""
    return df.withColumns(reference_of(arr, v, min_d))
