"""Connected components and sites (positions chained by distances of at most r)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.functions.geo import distance, nowhere
from terrasift.operators import agg, groups
from terrasift.operators.quantiles import medians
from terrasift.session import cut


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, root) with root the smallest node of the component, for every node that has an edge.

    Large-star / small-star rounds (Kiveris et al., 2014): the number of rounds grows with the logarithm of the
    component size, not with its diameter, and each round is grouped minima and equality joins. Every round ends in a
    reliable checkpoint.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter(F.col("u") != F.col("v")).distinct()
    e = cut(e)
    mark = _mark(e)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e1 = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e1.groupBy("u").agg(F.min("v").alias("m"))
        j = e1.join(low, "u")
        e2 = j.select("u", F.col("m").alias("v")).unionByName(j.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = cut(e2.filter(F.col("u") != F.col("v")).distinct())
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(e):
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


# cells of side r / sqrt(2) whose gap can be at most r, one of each opposite pair
_RING = [(i, j) for i in range(-2, 3) for j in range(0, 3) if (j > 0 or i > 0) and not (abs(i) == 2 and j == 2)]
_MICRO = 8


def _pack(cx, cy):
    """Cell coordinates in one long."""
    return F.col(cx) * F.lit(2**32) + F.col(cy)


def _touching(loc: DataFrame, r: float, extra=()) -> DataFrame:
    """Pairs of (location, location) in neighbouring cells at most r apart, with both cells' extra columns."""
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _RING]))
    left = loc.select(F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy", *[F.col(c).alias(f"{c}_a") for c in extra], o.alias("o"))
    left = left.withColumns({"cell_a": _pack("cx", "cy"), "cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j")}).drop("o")
    right = loc.select("cx", "cy", F.col("x").alias("bx"), F.col("y").alias("by"), *[F.col(c).alias(f"{c}_b") for c in extra])
    j = left.join(right, ["cx", "cy"]).withColumn("cell_b", _pack("cx", "cy"))
    return j.filter(distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= r)


def sites(df: DataFrame, r: float, name: str = "site", *, id: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """Add the site of each row: the lowest id of its chain of positions at most r apart.

    All positions in a cell of side r / sqrt(2) are within r of each other, so cells are the nodes of the graph and
    no pairs are built inside a crowded cell. Two neighbouring cells are linked when any two of their positions are
    within r. That is tested on at most 64 representatives per cell first; only cells with more positions than
    representatives, in components still apart, are then tested position by position.
    """
    s = r / math.sqrt(2.0)
    m = s / _MICRO
    loc = df.filter(~nowhere(x, y)).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.min(id).alias("lid"))
    loc = loc.withColumns({"cx": F.floor(F.col("x") / s).cast("long"), "cy": F.floor(F.col("y") / s).cast("long")})
    micro = loc.withColumns({"mx": F.floor(F.col("x") / m), "my": F.floor(F.col("y") / m)}).groupBy("cx", "cy", "mx", "my")
    reps = micro.agg(F.min_by(F.struct("x", "y"), "lid").alias("p"), F.min("lid").alias("lid"), F.count(F.lit(1)).alias("k"))
    reps = cut(reps.select("cx", "cy", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "lid", "k"))  # read by both sides of the links and by the cells
    cells = reps.groupBy("cx", "cy").agg(F.min("lid").alias("cid"), (F.sum("k") > F.count(F.lit(1))).alias("crowded"))
    edges = _touching(reps, r).select(F.col("cell_a").alias("src"), F.col("cell_b").alias("dst")).distinct()
    comp = components(edges)
    lab = cells.withColumn("node", _pack("cx", "cy")).join(comp, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")
    apart = None if reps.filter("k > 1").isEmpty() else cut(_apart(lab))  # without crowded cells every position was tested
    if apart is not None and not apart.isEmpty():
        # only positions of cells that may still be joined: few, however crowded the rest is
        full = loc.join(lab.select("cx", "cy", "root", "crowded"), ["cx", "cy"]).join(apart, ["cx", "cy"], "left_semi")
        more = _touching(full, r, ["root", "crowded"]).filter((F.col("root_a") != F.col("root_b")) & (F.col("crowded_a") | F.col("crowded_b")))
        comp2 = components(more.select(F.col("root_a").alias("src"), F.col("root_b").alias("dst")).distinct())
        comp2 = comp2.select(F.col("node").alias("root"), F.col("root").alias("root2"))
        lab = lab.join(comp2, "root", "left").withColumn("root", F.coalesce("root2", "root")).drop("root2")
    low = lab.groupBy("root").agg(F.min("cid").alias(name))
    lab = lab.join(low, "root").select(F.col("cx").alias("__cx"), F.col("cy").alias("__cy"), name)
    here = df.drop(name).filter(~nowhere(x, y)).withColumns({"__cx": F.floor(F.col(x) / s).cast("long"), "__cy": F.floor(F.col(y) / s).cast("long")})
    placed = here.join(lab, ["__cx", "__cy"]).drop("__cx", "__cy")
    # rows without a position are sites of their own
    return placed.unionByName(df.drop(name).filter(nowhere(x, y)).withColumn(name, F.col(id)))


def _apart(lab: DataFrame) -> DataFrame:
    """Cells with a neighbouring cell of another component, where one of the two holds more positions than were tested."""
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _RING]))
    a = lab.select(F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("root").alias("ra"), F.col("crowded").alias("ca"), o.alias("o"))
    a = a.withColumns({"cx": F.col("ax") + F.col("o.i"), "cy": F.col("ay") + F.col("o.j")})
    j = a.join(lab.select("cx", "cy", "root", "crowded"), ["cx", "cy"]).filter((F.col("ra") != F.col("root")) & (F.col("ca") | F.col("crowded")))
    return j.select("cx", "cy").unionByName(j.select(F.col("ax").alias("cx"), F.col("ay").alias("cy"))).distinct()


def drop_large(df: DataFrame, site: str = "site", most: int = 10) -> DataFrame:
    """Rows of sites with at most ``most`` rows; larger ones are placeholder positions."""
    return groups.size(df, [site], "site_size").filter(F.col("site_size") <= most)


def merge(df: DataFrame, values, *, site: str = "site", id: str = "id", firsts=(), modes=(), lists=(), date: str | None = None) -> DataFrame:
    """One location per site: medians, first values by id, modes, joined lists, earliest date, members.

    Expects sites bounded by drop_large, so per-site lists are short.
    """
    aggs = [F.min(id).alias("id"), agg.joined_list(id).alias("ids_merged"), F.count(F.lit(1)).alias("n_merged")]
    aggs += [F.median(v).alias(v) for v in values]
    aggs += [F.min_by(c, id).alias(c) for c in firsts]
    aggs += [F.mode(c, True).alias(c) for c in modes]
    aggs += [agg.joined_list(c, "|", True).alias(c) for c in lists]
    if date:
        aggs.append(F.min(date).alias(date))
    return df.groupBy(site).agg(*aggs).drop(site)


def drop_close(df: DataFrame, r: float, **kw) -> DataFrame:
    """Remove every location that has another one within r."""
    from terrasift.operators.nearby import count_within

    return count_within(df, r, "__near", **kw).filter(F.col("__near") == 0).drop("__near")


def compare_rules(df: DataFrame, site: str = "site") -> DataFrame:
    """Samples and locations that each de-clustering rule keeps."""
    per = df.groupBy(site).agg(F.count(F.lit(1)).alias("m"))
    rules = {"isolated only": "m = 1", "drop > 5": "m <= 5", "drop > 10": "m <= 10", "merge all": "true"}
    row = per.agg(*[f.alias(f"{a}{i}") for i, c in enumerate(rules.values()) for a, f in (("s", F.sum(F.when(F.expr(c), F.col("m")).otherwise(0))), ("l", F.count_if(F.expr(c))))])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"s{i}").alias("samples"), F.col(f"l{i}").alias("locations")) for i, n in enumerate(rules)])))


def summary(df: DataFrame, top: int, *, site="site", x="x", y="y", distincts=(), ranges=()) -> DataFrame:
    """The largest sites: rows, extent, distinct counts, value ranges."""
    aggs = [F.count(F.lit(1)).alias("samples"), (F.max(x) - F.min(x)).alias("extent_x"), (F.max(y) - F.min(y)).alias("extent_y")]
    aggs += [F.count_distinct(c).alias(f"{c}_distinct") for c in distincts]
    aggs += [f.alias(f"{c}_{n}") for c in ranges for n, f in (("lo", F.min(c)), ("hi", F.max(c)))]
    return df.groupBy(site).agg(*aggs).orderBy(F.desc("samples"), site).limit(top)


def within_vs_overall(df: DataFrame, values, site="site") -> DataFrame:
    """Median sd inside sites of several rows against the overall sd."""
    per = df.groupBy(site).agg(*[F.stddev_samp(v).alias(v) for v in values]).unpivot([site], list(values), "column", "sd").filter("sd IS NOT NULL")
    med = medians(per, ["column"], ["sd"]).withColumnRenamed("sd", "within_site")
    tot = df.select(*values).unpivot([], list(values), "column", "v").groupBy("column").agg(F.stddev_samp("v").alias("overall"))
    return med.join(tot, "column")
