"""Feature expressions: reflectance, spectral indices, ratings, bins, seasons, screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.functions.clean import known

# Class cuts (fixed values)
CUTS = {"n": (280.0, 560.0), "p": (10.0, 25.0), "k": (110.0, 280.0), "oc": (0.5, 0.75)}
# Spectral indices (fixed values): normalised differences (a - b) / (a + b) and plain quotients a / b of two bands
DIFFERENCES = {"NDVI": ("B08", "B04"), "NBR2": ("B11", "B12"), "NDMI": ("B08", "B11"), "NDWI": ("B03", "B08"), "NDRE": ("B8A", "B05"), "CI": ("B04", "B03")}
QUOTIENTS = {"R_B4B2": ("B04", "B02"), "R_B11B12": ("B11", "B12"), "R_B12B8": ("B12", "B08"), "R_B11B8": ("B11", "B08"), "R_B7B5": ("B07", "B05"), "R_B6B5": ("B06", "B05")}
INDEX_NAMES = [*DIFFERENCES, "SAVI", "BSI", "BI", "RI", *QUOTIENTS]


def reflectance(df: DataFrame, bands, offset: float = 1000.0, scale: float = 10000.0) -> DataFrame:
    """Digital numbers to reflectance."""
    return df.withColumns({b: (F.col(b) - offset) / scale for b in bands})


def ratio(a: Column, b: Column) -> Column:
    """NULL where the divisor is zero, so that it counts as not finite."""
    return F.try_divide(a, b)


def nd(a: Column, b: Column) -> Column:
    """Normalised difference."""
    return ratio(a - b, a + b)


def indices(df: DataFrame, prefix: str = "", name=lambda b: b) -> DataFrame:
    """The 16 spectral indices as plain column arithmetic, one projection: two families and four of their own kind."""

    def band(code):
        return F.col(prefix + name(code))

    blue, green, red, infrared, short = (band(c) for c in ("B02", "B03", "B04", "B08", "B11"))
    out = {n: nd(band(a), band(b)) for n, (a, b) in DIFFERENCES.items()} | {n: ratio(band(a), band(b)) for n, (a, b) in QUOTIENTS.items()}
    out["SAVI"] = ratio((infrared - red) * 1.5, infrared + red + 0.5)
    out["BSI"] = nd(short + red, infrared + blue)
    out["BI"] = F.sqrt((red * red + green * green) / 2.0)
    out["RI"] = ratio(red * red, blue * green * green * green)
    return df.withColumns({prefix + n: out[n] for n in INDEX_NAMES})


def rating(c: Column, lo: float, hi: float, right_inclusive: bool = True) -> Column:
    """0 low, 1 medium, 2 high; a value equal to hi is medium when right_inclusive."""
    return F.when(c < lo, 0).when(c <= hi if right_inclusive else c < hi, 1).when(c.isNotNull(), 2)


def bin_index(c: Column, edges, right: bool = True) -> Column:
    """Index of the interval between consecutive edges, NULL outside; right: (lo, hi], else [lo, hi).

    One comparison per edge; NaN is above every edge and ends up outside.
    """
    below = (lambda e: c <= e) if right else (lambda e: c < e)
    out = F.when(below(edges[0]), F.lit(None).cast("int"))
    for i, hi in enumerate(edges[1:]):
        out = out.when(below(hi), F.lit(i))
    return out


def db(c: Column) -> Column:
    """Linear power to decibel; not positive becomes NULL."""
    return F.when(c > 0, F.log10(c) * 10.0)


def ag_year(c: Column) -> Column:
    """Agricultural year, starting in June."""
    return F.when(F.month(c) >= 6, F.year(c)).otherwise(F.year(c) - 1)


def season(c: Column) -> Column:
    m = F.month(c)
    return F.when(m.between(7, 10), "kharif").when(m.isin(11, 12, 1, 2), "rabi").when(m.between(3, 5), "zaid").otherwise("other")


def screen(df: DataFrame, cols, min_share: float = 0.5) -> DataFrame:
    """Per column: filled share, whether it varies, and whether it is kept; one pass, no distinct sets.

    More than one distinct value is the same as min <> max.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [F.count(c).alias(f"{c}__f"), (F.min(c) != F.max(c)).alias(f"{c}__v")]
    row = df.agg(*aggs)
    items = [
        F.struct(F.lit(c).alias("feature"), (F.col(f"{c}__f") / F.col("n")).alias("share"), known(F.col(f"{c}__v")).alias("varies"))
        for c in cols
    ]
    return row.select(F.inline(F.array(*items))).withColumn("kept", (F.col("share") > min_share) & F.col("varies"))


# Prefixes of input names and their group (fixed values)
GROUPS = [("c_std_", "temporal"), ("c_", "satellite"), ("B", "satellite"), ("ndvi", "season"), ("ppt", "climate"), ("tm", "climate"), ("elev", "terrain"), ("slope", "terrain"), ("tpi", "terrain")]


def group_of(c: Column, groups=GROUPS, other: str = "on-site") -> Column:
    """Input group of a feature name by its prefix; the first match wins."""
    out = F.lit(other)
    for prefix, g in reversed(groups):
        out = F.when(c.startswith(prefix), g).otherwise(out)
    return out


def hashed(key: Column, seed) -> Column:
    """md5 of key and seed: an order that does not depend on partitioning."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def uniform(key: Column, seed) -> Column:
    """Number in [0, 1) from the first 32 bits of the md5."""
    return F.conv(F.substring(hashed(key, seed), 1, 8), 16, 10).cast("double") / 4294967296.0


def add_noise(df: DataFrame, key: str, ph_sd: float, ec_rel: float, seed: int = 42, floor: float = 0.001) -> DataFrame:
    """Sensor noise on ph (absolute sd) and ec (relative sd, floored); the same on any partitioning."""

    def normal(salt):
        u1 = F.greatest(uniform(F.col(key), f"{seed}{salt}a"), F.lit(1e-12))
        return F.sqrt(F.log(u1) * -2.0) * F.cos(uniform(F.col(key), f"{seed}{salt}b") * 6.283185307179586)

    return df.withColumns({
        "ph": F.col("ph") + normal("p") * ph_sd,
        "ec": F.greatest(F.col("ec") * (normal("e") * ec_rel + 1.0), F.lit(floor)),
    })
