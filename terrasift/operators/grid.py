"""Focal operations on long pixel tables (tile, r, col, value), edges repeated.

A w x w window is two passes of w positions: along the row, then along the column. Window partitions are single raster
lines, so their size is the tile width, whatever the data volume. Frames follow the pixel index, so a missing pixel is a hole
and not a neighbour; a line's edge is its own first and last pixel, wherever the tile starts. A window that lacks a value (NULL, NaN
or no row) has no mean, deviation or gradient; minimum and maximum take the values that are there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE, ROW, COL = "tile", "r", "col"


def _line(along: str):
    across = ROW if along == COL else COL
    return Window.partitionBy(TILE, across).orderBy(along)


def _sum_pass(v: str, along: str, k: int):
    """Sum over 2k + 1 positions of a line, the first and last pixel repeated beyond the edge."""
    w = _line(along)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.greatest(F.lit(k) - (F.col(along) - F.min(along).over(full)), F.lit(0))
    after = F.greatest(F.lit(k) - (F.max(along).over(full) - F.col(along)), F.lit(0))
    return F.sum(v).over(w.rangeBetween(-k, k)) + before * F.first(v).over(full) + after * F.last(v).over(full)


def focal_sums(px: DataFrame, specs: dict[str, tuple[str, int]]) -> DataFrame:
    """name -> (value column, window w): focal sums for several columns and windows in the same two passes.

    The values of each window are counted beside the sum; a sum of fewer than w * w is NULL.
    """
    cols = sorted({v for v, _ in specs.values()})
    known = {v: F.nanvl(F.col(v).cast("double"), F.lit(None)) for v in cols}
    p = px.withColumns({f"__v_{v}": F.coalesce(known[v], F.lit(0.0)) for v in cols} | {f"__i_{v}": known[v].isNotNull().cast("int") for v in cols})
    parts = {f"__s_{n}": (f"__v_{v}", w) for n, (v, w) in specs.items()} | {f"__n_{v}_{w}": (f"__i_{v}", w) for v, w in sorted(set(specs.values()))}
    mid = p.withColumns({n: _sum_pass(v, COL, w // 2) for n, (v, w) in parts.items()})
    out = mid.withColumns({f"{n}_": _sum_pass(n, ROW, w // 2) for n, (_, w) in parts.items()})
    sums = {n: F.when(F.col(f"__n_{v}_{w}_") == w * w, F.col(f"__s_{n}_")) for n, (v, w) in specs.items()}
    return out.withColumns(sums).drop(*[c for n in parts for c in (n, f"{n}_")], *[f"__{t}_{v}" for t in "vi" for v in cols])


def focal_mean(px: DataFrame, w: int, v: str = "value", name: str = "focal_mean") -> DataFrame:
    return focal_sums(px, {name: (v, w)}).withColumn(name, F.col(name) / float(w * w))


def focal_sd(px: DataFrame, w: int = 3, v: str = "value", name: str = "focal_sd") -> DataFrame:
    p = px.withColumn("__sq", F.col(v) * F.col(v))
    p = focal_sums(p, {"__m": (v, w), "__q": ("__sq", w)})
    n = float(w * w)
    var = F.col("__q") / n - (F.col("__m") / n) * (F.col("__m") / n)
    return p.withColumn(name, F.when(var.isNotNull(), F.sqrt(F.greatest(var, F.lit(0.0))))).drop("__sq", "__m", "__q")


def focal_minmax(px: DataFrame, w: int, v: str = "value", lo: str = "focal_min", hi: str = "focal_max") -> DataFrame:
    """Repeating the edge changes neither minimum nor maximum, so a clipped frame is exact."""
    k = w // 2
    a = _line(COL).rangeBetween(-k, k)
    b = _line(ROW).rangeBetween(-k, k)
    p = px.withColumns({"__lo": F.min(v).over(a), "__hi": F.max(v).over(a)})
    return p.withColumns({lo: F.min("__lo").over(b), hi: F.max("__hi").over(b)}).drop("__lo", "__hi")


def focal_any(px: DataFrame, w: int, flag: str, name: str = "any_near") -> DataFrame:
    p = px.withColumn("__f", F.col(flag).cast("int"))
    return focal_minmax(p, w, "__f", "__lo", name).drop("__f", "__lo")


def _gradient(v: str, along: str, step):
    """Central difference, one-sided at the two ends of the line, NULL beside a hole."""
    w, at, here = _line(along), F.col(along), F.col(v)
    after, before = F.lead(along).over(w), F.lag(along).over(w)
    up, dn = F.when(after == at + 1, F.lead(v).over(w)), F.when(before == at - 1, F.lag(v).over(w))
    d = F.when(after.isNull() & before.isNull(), here * 0.0).when(before.isNull(), up - here).when(after.isNull(), here - dn).otherwise((up - dn) / 2.0)
    return d / step


def slope(px: DataFrame, dx: float, dy: float, v: str = "value") -> DataFrame:
    """Slope in degrees with both gradients."""
    p = px.withColumn("gx", _gradient(v, COL, dx)).withColumn("gy", _gradient(v, ROW, dy))
    return p.withColumn("slope", F.degrees(F.atan(F.hypot("gx", "gy"))))


def curvature(px: DataFrame, dx: float, dy: float, v: str = "value") -> DataFrame:
    """Profile and plan curvature from second central differences."""
    p = slope(px, dx, dy, v)
    p = p.withColumns({"__xx": _gradient("gx", COL, dx), "__xy": _gradient("gy", COL, dx)}).withColumn("__yy", _gradient("gy", ROW, dy))
    gx, gy = F.col("gx"), F.col("gy")
    g2 = gx * gx + gy * gy + 1e-12
    mixed = gx * gy * F.col("__xy") * 2.0
    return p.withColumns({
        "curv_profile": -(F.col("__xx") * gx * gx + mixed + F.col("__yy") * gy * gy) / g2,
        "curv_plan": -(F.col("__xx") * gy * gy - mixed + F.col("__yy") * gx * gx) / g2,
    }).drop("__xx", "__yy", "__xy")


def terrain(px: DataFrame, dx: float, dy: float, v: str = "value", tpi=(5, 17, 33), relief: int = 67) -> DataFrame:
    """Elevation, slope, position against the surroundings at several widths, roughness and relative position."""
    p = px.withColumn("__sq", F.col(v) * F.col(v))
    specs = {f"__t{w}": (v, w) for w in tpi} | {"__m3": (v, 3), "__q3": ("__sq", 3)}
    p = focal_minmax(focal_sums(p, specs), relief, v, "__low", "__high")
    p = slope(p, dx, dy, v)
    out = {f"tpi_{w}": F.col(v) - F.col(f"__t{w}") / float(w * w) for w in tpi}
    m = F.col("__m3") / 9.0
    out["rough"] = F.when(m.isNotNull(), F.sqrt(F.greatest(F.col("__q3") / 9.0 - m * m, F.lit(0.0))))
    out["relpos"] = (F.col(v) - F.col("__low")) / F.greatest(F.col("__high") - F.col("__low"), F.lit(1.0))
    return p.withColumns(out).drop("__sq", "__low", "__high", "gx", "gy", *specs)


def block_fraction(px: DataFrame, size: int, codes: dict, cls: str = "cls") -> DataFrame:
    """Share of each class in whole size x size blocks."""
    b = px.groupBy(TILE, F.floor(F.col(ROW) / size).alias("br"), F.floor(F.col(COL) / size).alias("bc"))
    return b.agg(*[F.avg((F.col(cls) == code).cast("double")).alias(n) for n, code in codes.items()], F.count(F.lit(1)).alias("cells"))
