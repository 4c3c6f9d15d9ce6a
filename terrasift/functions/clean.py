"""Column functions that clean text-typed records."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")

# Plausibility limits (fixed values): column -> (low, high, low end closed)
LIMITS = {
    "n": (20.0, 1500.0, False),
    "p": (1.0, 300.0, False),
    "k": (20.0, 3000.0, False),
    "oc": (0.0, 5.0, False),
    "ph": (3.5, 10.5, True),
    "ec": (0.0, 10.0, False),
}
TIGHTENED = {"oc": (0.02, INF, False), "ec": (0.005, INF, False)}
NATIONAL_LIMITS = {
    "n": (20.0, 1500.0, True),
    "p": (1.0, 300.0, True),
    "k": (20.0, 3000.0, True),
    "oc": (0.02, 5.0, False),
    "ph": (3.5, 10.5, True),
    "ec": (0.005, 10.0, False),
}
DATE_FORMAT = "M/d/yy, h:mm a"


def to_number(c) -> Column:
    """Text to double; anything unreadable becomes NULL."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def to_date(c, fmt: str = DATE_FORMAT) -> Column:
    """Text to timestamp; anything unreadable becomes NULL."""
    return F.try_to_timestamp(F.col(c) if isinstance(c, str) else c, F.lit(fmt))


def year_guard(c: Column, lo: int, hi: int) -> Column:
    """NULL for dates whose year is outside [lo, hi]."""
    return F.when(F.year(c).between(lo, hi), c)


def known(c: Column) -> Column:
    """A condition with NULL read as false."""
    return F.coalesce(c, F.lit(False))


def all_of(conds) -> Column:
    return reduce(and_, conds)


def any_of(conds) -> Column:
    return reduce(or_, conds)


def not_nan(c: Column) -> Column:
    """NaN compares as larger than everything in Spark; this turns it into NULL first."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def finite(*cols) -> Column:
    """True where every column holds a finite number (NULL, NaN and infinities are not)."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    return all_of(known(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))) for c in cs)


def within(c: Column, lo: float, hi: float, closed: bool) -> Column:
    """lo < c <= hi, or lo <= c <= hi when closed; NULL and NaN are outside."""
    v = not_nan(c)
    return known((v >= lo if closed else v > lo) & (v <= hi))


def within_limits(limits: dict) -> Column:
    """One condition over all limited columns, evaluated in the same codegen stage."""
    return all_of(within(F.col(c), *lim) for c, lim in limits.items())


def in_bbox(lon, lat, box) -> Column:
    """box = (lon low, lon high, lat low, lat high), closed; NaN and NULL positions are outside."""
    return within(F.col(lon), box[0], box[1], True) & within(F.col(lat), box[2], box[3], True)


def months(c: Column, lo: int, hi: int) -> Column:
    return known(F.month(c).between(lo, hi))


def id_parts(c: str = "id") -> tuple[Column, Column]:
    """State and district codes embedded in an id such as ``27_490_s_17``."""
    parts = F.split(F.col(c), "_")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def scene_tile(tile: Column, name: Column) -> Column:
    """Tile property of a scene, else the token inside its name."""
    return F.coalesce(tile, F.substring(F.get(F.split(name, "_"), F.lit(5)), 2, 100))


def day_diff(a: Column, b: Column) -> Column:
    """Whole days from b to a, times of day dropped."""
    return F.datediff(F.to_date(a), F.to_date(b))


def strict_bare(status="status", lo="scl_min", hi="scl_max", n="n_px", code=5, pixels=9) -> Column:
    """Window fetched, every pixel of the wanted class and none missing."""
    return known((F.col(status) == "ok") & (F.col(lo) == code) & (F.col(hi) == code) & (F.col(n) == pixels))


def majority_bare(status="status", major="scl_major", code=5) -> Column:
    return known((F.col(status) == "ok") & (F.col(major) == code))


def valid_reflectance(bands) -> Column:
    """Every band in (0, 1]."""
    return all_of(within(F.col(b), 0.0, 1.0, False) for b in bands)


def qa_mask(v: Column, qa: Column, worst: int = 1, floor: float = -2000.0) -> Column:
    """Value where its quality flag is good and it is above the fill value, else NULL."""
    return F.when((qa <= worst) & (v >= floor), v)


def eligible(df: DataFrame, box, *, lon="lon", lat="lat", date="sample_date", numeric=("n", "p", "k")) -> DataFrame:
    """Rows alone at their position, dated, inside the box and with readable numbers."""
    from terrasift.operators.groups import unique_points

    ok = in_bbox(lon, lat, box) & F.col(date).isNotNull() & all_of(to_number(F.col(c)).isNotNull() for c in numeric)
    return unique_points(df, [lon, lat]).filter(ok)


def fill_median(df: DataFrame, cols) -> DataFrame:
    """Replace NULL by the exact median of the column."""
    from terrasift.operators.quantiles import quantiles

    med = quantiles(df, [], cols, [0.5])
    med = med.select(*[F.col(f"{c}_p50").alias(f"__{c}") for c in cols])
    out = df.crossJoin(F.broadcast(med))  # one row by construction
    return out.select(*[F.coalesce(c, f"__{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def funnel(df: DataFrame, steps) -> DataFrame:
    """Rows left after each (name, condition), conditions applied cumulatively, in one pass."""
    conds, acc = [], F.lit(True)
    for name, cond in steps:
        acc = acc & known(cond)
        conds.append((name, acc))
    row = df.agg(*[F.count_if(c).alias(f"s{i}") for i, (_, c) in enumerate(conds)])
    pairs = F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(n).alias("step"), F.col(f"s{i}").alias("rows")) for i, (n, _) in enumerate(conds)])
    return row.select(F.inline(pairs))
