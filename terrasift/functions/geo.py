"""Position functions: local metres, blocks, tiles, rings, pixels and WKB points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

M_PER_DEG_LON, M_PER_DEG_LAT = 111320.0, 110574.0
STATE_BOX = (72.6, 80.9, 15.6, 22.1)
NATIONAL_BOX = (68.0, 98.0, 6.0, 37.5)


def x_of(lon, lat, unit: str = "m") -> Column:
    c = F.col(lon) * F.lit(M_PER_DEG_LON) * F.cos(F.radians(F.col(lat)))
    return c if unit == "m" else c / 1000.0


def y_of(lat, unit: str = "m") -> Column:
    c = F.col(lat) * F.lit(M_PER_DEG_LAT)
    return c if unit == "m" else c / 1000.0


def xy(df: DataFrame, unit: str = "m", lon="lon", lat="lat") -> DataFrame:
    """Add x and y; each point uses the cosine of its own latitude."""
    return df.withColumns({"x": x_of(lon, lat, unit), "y": y_of(lat, unit)})


def distance(ax, ay, bx, by) -> Column:
    """Euclidean distance of two projected positions."""
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)


def cell(c, size: float) -> Column:
    """Floor division, right for negative coordinates too."""
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(float(size)))


def block(x, y, km: float) -> Column:
    """Key of the square block of the given side that holds (x, y) in metres."""
    s = km * 1000.0
    return F.concat_ws("_", cell(x, s), cell(y, s))


def coord_key(lon="lon", lat="lat", decimals: int = 6) -> Column:
    """Exact-position key."""
    s = 10.0**decimals
    return F.concat_ws("_", F.round(F.col(lon) * s, 0).cast("long"), F.round(F.col(lat) * s, 0).cast("long"))


def pixel_centre(c: Column, size: float = 10.0) -> Column:
    return F.floor(c / size) * size + size / 2


def window_ring(x, y, half: float = 15.0, size: float = 10.0) -> Column:
    """Closed ring of the window around the pixel that holds (x, y)."""
    cx, cy = pixel_centre(F.col(x), size), pixel_centre(F.col(y), size)
    corners = [(-half, -half), (half, -half), (half, half), (-half, half), (-half, -half)]
    return F.array(*[F.struct((cx + a).alias("x"), (cy + b).alias("y")) for a, b in corners])


def tile_key(lon, lat) -> Column:
    """UTM zone with the 100 km square, by closed form."""
    zone = F.floor((F.col(lon) + 180.0) / 6.0) + 1
    central = zone * 6 - 183
    e = 500000.0 + (F.col(lon) - central) * M_PER_DEG_LON * F.cos(F.radians(F.col(lat)))
    return F.concat_ws("_", zone, F.floor(e / 100000.0), F.floor(F.col(lat) * M_PER_DEG_LAT / 100000.0))


def nearest_node(c, origin: float, step: float) -> Column:
    """Index of the grid node closest to a coordinate."""
    return F.floor((F.col(c) - origin) / step + 0.5).cast("long")


def pixel_index(c, origin: float, res: float, n: int) -> Column:
    """Pixel index along one axis, clipped to the raster."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(c) - origin) / res))).cast("long")


def ring_contains(ring: Column, px: Column, py: Column) -> Column:
    """Ray casting over a closed ring array<struct<x,y>>, JVM side."""
    edges = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"))

    def crosses(e):
        a, b = e["a"], e["b"]
        return ((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"])

    # the division is only reached where the edge spans py, so a level edge cannot divide by zero
    def safe(e):
        a, b = e["a"], e["b"]
        return F.when((a["y"] > py) != (b["y"] > py), crosses(e)).otherwise(F.lit(False))

    return (F.size(F.filter(edges, safe)) % 2) == 1


def nowhere(x: str, y: str) -> Column:
    """Rows whose position is NULL or not a number."""
    return F.col(x).isNull() | F.col(y).isNull() | F.isnan(F.col(x).cast("double")) | F.isnan(F.col(y).cast("double"))


def _bytes_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, start and length of each value) of a binary array, from its buffers; NULL has length 0."""
    n, wide = len(a), pa.types.is_large_binary(a.type)
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[a.offset : a.offset + n + 1].astype(np.int64) if offsets else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    size = np.where(np.asarray(a.is_valid()), np.diff(at), 0)
    return raw, at[:-1], size


def _gather(raw: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(raw[start[:, None] + np.arange(width)])


@F.arrow_udf(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))
def wkb_xy(wkb: pa.Array) -> pa.Array:
    """First two coordinates of WKB points of either byte order, with or without SRID, Z and M; anything else becomes NULL.

    All values are decoded at once from the array's buffers.
    """
    raw, start, size = _bytes_of(wkb)
    xy_ = np.full((len(start), 2), np.nan)
    rows = np.flatnonzero(size >= 21)
    head = _gather(raw, start[rows], 5)
    for mark, order in ((0, ">"), (1, "<")):
        own = head[:, 0] == mark
        kind = head[own, 1:].copy().view(f"{order}u4").ravel().astype(np.int64)
        base = kind & 0x1FFFFFFF
        skip = np.where(kind & 0x20000000, 9, 5)
        at = rows[own]
        fits = (base % 1000 == 1) & (base < 4000) & (size[at] >= skip + 16)
        xy_[at[fits]] = _gather(raw, start[at[fits]] + skip[fits], 16).view(f"{order}f8")
    hole = np.isnan(xy_)
    return pa.StructArray.from_arrays([pa.array(xy_[:, 0], mask=hole[:, 0]), pa.array(xy_[:, 1], mask=hole[:, 1])], ["lon", "lat"])


@F.arrow_udf(T.BinaryType())
def to_wkb(lon: pa.Array, lat: pa.Array) -> pa.Array:
    """Little-endian WKB point of two doubles."""
    n = len(lon)
    out = np.empty((n, 21), np.uint8)
    out[:, :5] = (1, 1, 0, 0, 0)
    xy_ = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (lon, lat)]).astype("<f8")
    out[:, 5:] = np.ascontiguousarray(xy_).view(np.uint8).reshape(n, 16)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 21).astype(np.int32)), pa.py_buffer(out)])
