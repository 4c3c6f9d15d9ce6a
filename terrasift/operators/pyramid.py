"""Pair statistics by distance over a pyramid of cells, for places where positions are crowded.

Cells hold sums over their rows. Two cells whose least and greatest distance fall into one bin count as a whole; pairs of cells that
straddle a bin edge are opened, level by level, as equality joins of their children; only where both are small are positions paired.
So the work follows the rim of the distance bands and not the number of pairs. Cells that hold few positions never enter the
pyramid: their pairs are built as they are.

Sums per bin never need the pairs as rows: a block of positions and the positions in reach of it meet in one task as NumPy arrays
(``_block_sums``), so a position is shuffled once for its block and once for each block it is near. The pyramid is then only for blocks
that are too large for a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.functions.geo import distance, nowhere
from terrasift.operators import groups, nearby
from terrasift.session import cut

CROWD = 256  # positions of a cell that is opened through the pyramid
DIRECT = 4096  # pairs of positions of two cells that are built as they are
BLOCK = 2048  # mean positions of a block whose pairs are summed in one task
HEAVY = 1 << 16  # positions of a block that is opened through the pyramid
PAIRED = 1 << 28  # pairs of positions of two opened cells that are summed in one task
PARTS = 1000  # partitions that the blocks are dealt over, at most
SHARE = 16  # blocks may hold one part in so many of all positions
TILE = 64  # positions of a tile of a block, which eight runs of b are held against
HELD = 1 << 16  # distances held at once
ORDER = 8  # of the series that sums the distances of two tiles
APART = 0.2  # greatest sum of the radii of two such tiles, by the distance of their centres
RIM = 32  # pixel positions of a rim cell that are compared one by one
FAN = 4  # a power of two, so that a child's index leads to its parent's without rounding
_BOX = ("x0", "x1", "y0", "y1")


def _at(df: DataFrame, side: float) -> DataFrame:
    return df.withColumns({"cx": F.floor(F.col("x") / side).cast("long"), "cy": F.floor(F.col("y") / side).cast("long")})


def _cells(loc: DataFrame, side: float, values, keys) -> DataFrame:
    """Per cell: positions c, rows n, the sum of squared row counts nn, bounds, and per value its sums over rows and over pairs of one position."""
    aggs = [F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"),
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]
    for v in values:
        m, ss = F.col(f"{v}__m"), F.col(f"{v}__ss")
        aggs += [F.sum(F.col("n") * m).alias(f"{v}__1"), F.sum(ss + F.col("n") * m * m).alias(f"{v}__2"), F.sum(F.col("n") * ss / 2.0).alias(f"{v}__own")]
    return _at(loc, side).groupBy(*keys, "cx", "cy").agg(*aggs)


def _side(cells: DataFrame, p: str, keys) -> DataFrame:
    """The cells as one side of a pair: keys, px, py and the sums under the side's name."""
    return cells.select(*keys, F.col("cx").alias(f"{p}x"), F.col("cy").alias(f"{p}y"), *[F.col(c).alias(f"{p}__{c}") for c in cells.columns if c not in (*keys, "cx", "cy")])


def _band(d: Column, edges) -> Column:
    """How many edges lie at or below d; a first edge of 0 or less lies below everything."""
    low = 1 if edges[0] <= 0 else 0
    return sum(((d >= F.lit(float(e))).cast("int") for e in edges[low:]), F.lit(low))


def _bounds() -> tuple[Column, Column]:
    """Least and greatest distance of two cells by the bounds of their positions."""
    a, b = ({k: F.col(f"{p}__{k}") for k in _BOX} for p in "ab")
    gap = [F.greatest(F.lit(0.0), b[f"{k}0"] - a[f"{k}1"], a[f"{k}0"] - b[f"{k}1"]) for k in "xy"]
    far = [F.greatest(b[f"{k}1"] - a[f"{k}0"], a[f"{k}1"] - b[f"{k}0"]) for k in "xy"]
    return tuple(F.sqrt(u * u + v * v) for u, v in (gap, far))


def opened(loc: DataFrame, edges, values=(), keys=(), side: float | None = None, crowd: int | None = None, direct: int | None = None, lag: bool = False, fan: int | None = None):
    """The cell pairs of crowded cells, level by level: [(side, whole, direct)].

    whole: pairs of cells with their sums and ``band``, all of whose pairs of positions are in one bin; direct: (keys, ax, ay, bx, by,
    home) of the cell pairs whose positions are still to be paired. ``loc`` is a stored table of positions (x, y, n, value moments).
    side: of the first cells, the last edge or more. With ``lag`` no pair is whole, as sums of distances do not follow from cell sums.
    """
    keys, side, out = list(keys), float(side or edges[-1]), []
    crowd, most, fan = CROWD if crowd is None else crowd, DIRECT if direct is None else direct, fan or FAN
    eps = 1e-6 * float(edges[-1])
    cells = _cells(loc, side, values, keys)
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in nearby.HALF]))
    near = _side(cells, "a", keys).withColumn("o", o).withColumns({"bx": F.col("ax") + F.col("o.i"), "by": F.col("ay") + F.col("o.j")}).drop("o")
    pairs = groups.same_keys(near, _side(cells, "b", keys), [*keys, "bx", "by"]).filter((F.col("a__c") > crowd) | (F.col("b__c") > crowd))
    pairs = pairs.withColumn("home", (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by")))
    while True:
        lo, hi = _bounds()
        first, last = _band(lo - eps, edges), _band(hi + eps, edges)
        size = F.when(F.col("home"), F.col("a__c") * (F.col("a__c") - 1) / 2).otherwise(F.col("a__c") * F.col("b__c"))
        fate = F.when(F.lit(not lag) & (first == last), "whole").when(size <= most, "direct").otherwise("open")
        pairs = cut(pairs.withColumns({"band": last, "fate": fate, "__far": first}).filter(f"__far < {len(edges)} AND band > 0").drop("__far"))
        out.append((side, pairs.filter("fate = 'whole'"), pairs.filter("fate = 'direct'").select(*keys, "ax", "ay", "bx", "by", "home")))
        todo = pairs.filter("fate = 'open'").select(*keys, "ax", "ay", "bx", "by", "home")
        if todo.isEmpty():
            return out
        side /= fan
        # only what lies in open cells goes on
        ends = todo.select(*keys, F.col("ax").alias("px"), F.col("ay").alias("py")).union(todo.select(*keys, "bx", "by")).distinct()
        child = _cells(loc, side, values, keys)
        up = {"px": F.floor(F.col("cx") / fan).cast("long"), "py": F.floor(F.col("cy") / fan).cast("long")}
        child = cut(groups.same_keys(child.withColumns(up), ends, [*keys, "px", "py"], "left_semi"))
        a = _side(child.drop("px", "py"), "a", keys).withColumns({"ux": F.floor(F.col("ax") / fan).cast("long"), "uy": F.floor(F.col("ay") / fan).cast("long")})
        b = _side(child.drop("px", "py"), "b", keys).withColumns({"vx": F.floor(F.col("bx") / fan).cast("long"), "vy": F.floor(F.col("by") / fan).cast("long")})
        todo = todo.withColumnsRenamed({"ax": "ux", "ay": "uy", "bx": "vx", "by": "vy", "home": "was"})
        pairs = groups.same_keys(groups.same_keys(todo, a, [*keys, "ux", "uy"]), b, [*keys, "vx", "vy"])
        home = (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by"))
        once = ~F.col("was") | home | (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by")))
        pairs = pairs.filter(once).withColumn("home", home).drop("was", "ux", "uy", "vx", "vy")


def positions(loc: DataFrame, side: float, direct: DataFrame, extra=(), keys=()) -> DataFrame:
    """The pairs of positions behind cell pairs: d, n and the extra columns of both, each pair once."""
    names = ("id", "x", "y", "n", *extra)
    at = _at(loc, side)
    a = at.select(*keys, F.col("cx").alias("ax"), F.col("cy").alias("ay"), *[F.col(c).alias(f"{c}_a") for c in names])
    b = at.select(*keys, F.col("cx").alias("bx"), F.col("cy").alias("by"), *[F.col(c).alias(f"{c}_b") for c in names])
    j = groups.same_keys(groups.same_keys(direct, a, [*keys, "ax", "ay"]), b, [*keys, "bx", "by"])
    once = ~F.col("home") | (F.col("x_a") < F.col("x_b")) | ((F.col("x_a") == F.col("x_b")) & (F.col("y_a") < F.col("y_b")))
    return j.filter(once).withColumn("d", distance(F.col("x_a"), F.col("y_a"), F.col("x_b"), F.col("y_b")))


def split(loc: DataFrame, r: float, keys=()) -> tuple[DataFrame, DataFrame, bool]:
    """(all positions, stored; those in cells that are not crowded; whether there are crowded cells)."""
    loc = cut(loc)
    if _at(loc, float(r)).groupBy(*keys, "cx", "cy").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > CROWD).isEmpty():
        return loc, loc, False
    sized = groups.size(_at(loc, float(r)), [*keys, "cx", "cy"], "__c")
    return loc, sized.filter(F.col("__c") <= CROWD).drop("cx", "cy", "__c"), True


def half_squares(v: str) -> Column:
    """Sum over the row pairs behind a pair of positions of half the squared difference."""
    dm = F.col(f"{v}__m_a") - F.col(f"{v}__m_b")
    return 0.5 * (F.col("n_b") * F.col(f"{v}__ss_a") + F.col("n_a") * F.col(f"{v}__ss_b") + F.col("n_a") * F.col("n_b") * dm * dm)


def _whole_squares(v: str) -> Column:
    apart = 0.5 * (F.col("b__n") * F.col(f"a__{v}__2") + F.col("a__n") * F.col(f"b__{v}__2")) - F.col(f"a__{v}__1") * F.col(f"b__{v}__1")
    own = 0.5 * (F.col("a__n") * F.col(f"a__{v}__2") - F.col(f"a__{v}__1") * F.col(f"a__{v}__1")) - F.col(f"a__{v}__own")
    return F.when(F.col("home"), own).otherwise(apart)


def _packed(xy: np.ndarray) -> np.ndarray:
    """An order in which runs of MID, TILE and FINE positions lie together: strips of equal counts by x, cut by y, level by level."""
    n, x, y = len(xy), *xy.T
    order, at = np.arange(n), np.arange(n)
    for size, parent in zip(_sizes(), (n, *_sizes())):
        runs = -(-min(n, parent) // size)
        per = size * -(-runs // max(1, round(runs**0.5)))
        g = at // parent
        order = order[np.lexsort((x[order], g))]
        order = order[np.lexsort((y[order], (at - g * parent) // per, g))]
    return order


def _sizes() -> tuple[int, int, int]:
    return 32 * TILE, TILE, max(1, TILE // 8)


class _Side:
    """Positions in packed order, and per size of run: bounds (x0, x1, y0, y1) and the sums of each weight. ``heads``: the columns that hold n."""

    def __init__(self, xy: np.ndarray, w: np.ndarray, heads, lag: bool):
        order = _packed(xy)
        self.xy, self.w = xy[order], w[order]
        self.n, self.bounds, self.sums = len(xy), {}, {}
        for size in _sizes():
            at = np.arange(0, self.n, size)
            low, high = np.minimum.reduceat(self.xy, at), np.maximum.reduceat(self.xy, at)
            self.bounds[size] = np.array([low[:, 0], high[:, 0], low[:, 1], high[:, 1]])
            self.sums[size] = np.add.reduceat(self.w, at).T.copy()
        if lag:
            x0, x1, y0, y1 = self.bounds[TILE]
            self.centre, self.radius = np.array([x0 + x1, y0 + y1]) / 2, np.hypot(x1 - x0, y1 - y0) / 2
            u, v = (self.xy - np.repeat(self.centre.T, TILE, axis=0)[: self.n]).T
            at = np.arange(0, self.n, TILE)
            pu, pv = [np.ones(self.n)], [np.ones(self.n)]
            for _ in range(ORDER):
                pu.append(pu[-1] * u)
                pv.append(pv[-1] * v)
            self.moments = [np.array([np.add.reduceat(self.w[:, h] * pu[i] * pv[j], at) for i, j in _POWERS]) for h in heads]

    def within(self, size: int, parents: np.ndarray, parent: int) -> np.ndarray:
        """The runs of a size (positions, if 1) in the given runs of a greater size."""
        k = parent // size
        out = (parents[:, None] * k + np.arange(k)).ravel()
        return out[out < -(-self.n // size)]


_POWERS = [(i, j) for t in range(ORDER + 1) for i in range(t, -1, -1) for j in (t - i,)]
_PLACE = {c: k for k, c in enumerate(_POWERS)}
#: (power of the difference, power of b, power of a, factor) of the binomial terms of (b - a) ** power
_TERMS = [(_PLACE[i, j], _PLACE[p, q], _PLACE[i - p, j - q], math.comb(i, p) * math.comb(j, q) * (-1) ** (i - p + j - q)) for i, j in _POWERS for p in range(i + 1) for q in range(j + 1)]
_TERM = [np.array(t) for t in zip(*_TERMS)]


def _series(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of the Taylor series of the length of (x + h, y + k) in the powers of h and k, up to ORDER."""
    r2 = x * x + y * y
    c = np.empty((len(_POWERS), len(x)))
    c[0] = np.sqrt(r2)
    x, y, one = x / r2, y / r2, 1.0 / r2

    def get(i, j):
        return c[_PLACE[i, j]]

    for k, (i, j) in enumerate(_POWERS[1:], 1):
        # from (q f') = f q' / 2 with q the square of the length, along one of the two directions
        (m, o, u, v) = (i, j, x, y) if i else (j, i, y, x)

        def at(a, b, swap=not i):
            return get(b, a) if swap else get(a, b)

        t = (2.0 * (0.5 - (m - 1)) / m) * u * at(m - 1, o)
        if o >= 1:
            t -= 2.0 * v * at(m, o - 1)
        if m >= 2:
            t += ((1.0 - (m - 2)) / m) * one * at(m - 2, o)
        if o >= 2:
            t -= one * at(m, o - 2)
        c[k] = t
    return c


def _square(e: float, closed: bool) -> float:
    """The least square of a distance that is not below ``e`` (not at or below it, if ``closed``), as the root is rounded."""
    e = np.nextafter(e, np.inf) if closed else e
    t = e * e
    while np.sqrt(t) >= e and t > 0:
        t = np.nextafter(t, -np.inf)
    while np.sqrt(t) < e:
        t = np.nextafter(t, np.inf)
    return float(t)


def _block_sums(a: _Side, b: _Side | None, edges, closed: bool, lag: bool, sets: int, nv: int) -> np.ndarray:
    """Per edge, over the pairs of positions (a, b) below it, or the pairs of two positions of a: (edges, sets, sums), sums of n n, of the half
    squared differences of each value, of n n d if ``lag``.

    Weights are per set n and per value its two sums over the rows of the position. Runs of both sides whose distances lie on one side of
    an edge count by their sums, from the longest runs down; only the shortest that straddle it are compared position by position. The
    distances of two runs that are far apart for their size are summed by the Taylor series of the distance about their centres.
    """
    home, b = b is None, a if b is None else b
    K, C = len(edges), 1 + 2 * nv
    skip = 1 if edges[0] <= 0 else 0  # nothing is below 0
    mid, tile, fine = _sizes()
    eps = 1e-6 * edges[-1]
    low2, high2 = ((np.maximum(np.array(edges[skip:]) + s * eps, 0.0)) ** 2 for s in (1, -1))
    limits = [_square(e, closed and k == K - 1) for k, e in enumerate(edges)]
    heads = [C * s for s in range(sets)]

    def joint(u, m):
        """Sums over pairs from weights u of a and the weights m of what each of them meets, per row: (rows, sets, 1 + nv)."""
        u, m = u.reshape(-1, sets, C), m.reshape(-1, sets, C)
        out = np.empty((max(len(u), len(m)), sets, 1 + nv))
        out[..., 0] = u[..., 0] * m[..., 0]
        for v in range(nv):
            i, j = 1 + 2 * v, 2 + 2 * v
            out[..., 1 + v] = 0.5 * (u[..., 0] * m[..., j] + u[..., j] * m[..., 0]) - u[..., i] * m[..., i]
        return out

    def fate(size, i, bsize, runs):
        """Of the run i of a and runs of b: the first edge that some pair may be below, and the first that all are below."""
        x0, x1, y0, y1 = a.bounds[size][:, i]
        u0, u1, v0, v1 = b.bounds[bsize][:, runs]
        gx, gy = np.maximum(np.maximum(u0 - x1, x0 - u1), 0.0), np.maximum(np.maximum(v0 - y1, y0 - v1), 0.0)
        fx, fy = np.maximum(u1 - x0, x1 - u0), np.maximum(v1 - y0, y1 - v0)
        least = gx * gx + gy * gy
        return skip + np.searchsorted(low2, least, "right"), skip + np.searchsorted(high2, fx * fx + fy * fy, "right"), least

    def meet(i, mids, rising, direct):
        """The run i of MID positions of a with such runs of b. ``rising[k]``: what is below edge k and all edges above, ``direct[k]``: below edge k."""

        def add(size, i, bsize, runs, last):
            s = b.sums[bsize]
            got = np.stack([np.bincount(last, s[c][runs], K + 1) for c in range(sets * C)], axis=1)
            rising[:, :, : 1 + nv] += joint(a.sums[size][:, i], got)

        first, last, _ = fate(mid, i, mid, mids)
        if not lag:
            whole = (first == last) & (first < K)
            add(mid, i, mid, mids[whole], last[whole])
            mids = mids[(first < K) & ~whole]
        else:
            mids = mids[first < K]
        if len(mids) == 0:
            return
        tiles = b.within(tile, mids, mid)
        for t in range(i * (mid // tile), min((i + 1) * (mid // tile), -(-a.n // tile))):
            first, last, _ = fate(tile, t, tile, tiles)
            done = (first == last) & (first < K)
            if lag and done.any():
                j = np.flatnonzero(done)
                x, y = b.centre[:, tiles[j]] - a.centre[:, [t]]
                far = a.radius[t] + b.radius[tiles[j]] < APART * np.hypot(x, y)
                done[j[~far]] = False
                j = j[far]
                if len(j):
                    c = _series(x[far], y[far])
                    for k in range(sets):
                        shift = np.zeros((len(_POWERS), len(_POWERS)))
                        shift[_TERM[0], _TERM[1]] = _TERM[3] * a.moments[k][_TERM[2], t]
                        each = np.einsum("pj,pj->j", c, shift @ b.moments[k][:, tiles[j]])
                        rising[:, k, -1] += np.bincount(last[j], each, K + 1)
            if done.any():
                add(tile, t, tile, tiles[done], last[done])
            runs = b.within(fine, tiles[(first < K) & ~done], tile)
            if len(runs) == 0:
                continue
            first, last, least = fate(tile, t, fine, runs)
            keep = first < K
            runs, first, last, least = runs[keep], first[keep], last[keep], least[keep]
            add(tile, t, fine, runs, last)
            p, u = a.xy[t * tile : (t + 1) * tile], a.w[t * tile : (t + 1) * tile]
            x0, x1, y0, y1 = a.bounds[tile][:, t]
            centre = np.array([(x0 + x1) / 2, (y0 + y1) / 2])
            near = least < (x1 - x0) ** 2 + (y1 - y0) ** 2
            q = p - centre
            left = np.column_stack([-2.0 * q, np.ones(len(q)), (q * q).sum(axis=1)])

            def squares(chosen):
                """(places in b, index into runs, squares of distances, their error) in parts of about HELD distances."""
                for close in (True, False):  # products lose the digits of small distances
                    at = chosen[near[chosen] == close]
                    step = max(1, HELD // (len(p) * fine))
                    for k in range(0, len(at), step):
                        part = at[k : k + step]
                        places = b.within(1, runs[part], fine)
                        of = np.repeat(part, np.minimum(fine, b.n - runs[part] * fine))
                        if close:
                            d = np.subtract(p[:, :1], b.xy[places, 0])
                            e = np.subtract(p[:, 1:], b.xy[places, 1])
                            np.multiply(d, d, out=d)
                            yield places, of, np.add(d, np.multiply(e, e, out=e), out=d), 0.0
                        else:
                            r = b.xy[places] - centre
                            r2 = (r * r).sum(axis=1)
                            yield places, of, left @ np.vstack([r.T, r2, np.ones(len(r))]), 1e-14 * r2.max()

            if lag:
                for k in range(skip, K):
                    for places, _, d, _ in squares(np.flatnonzero((first == k) & (last == k))):
                        rising[k, :, -1] += (u[:, heads] * (np.sqrt(d, out=d) @ b.w[places][:, heads])).sum(axis=0)
            for k in range(skip, K):
                for places, of, d, err in squares(np.flatnonzero((first <= k) & (last > k))):
                    below = d < limits[k] - err
                    if err and np.count_nonzero(below) != np.count_nonzero(d < limits[k] + err):
                        r, c = np.nonzero(np.abs(d - limits[k]) <= err)
                        below[r, c] = (p[r, 0] - b.xy[places[c], 0]) ** 2 + (p[r, 1] - b.xy[places[c], 1]) ** 2 < limits[k]
                    m, w = below.astype(np.float64), b.w[places]
                    direct[k, :, : 1 + nv] += joint(u, m @ w).sum(axis=0)
                    if lag:
                        n = w[:, heads]
                        np.sqrt(d, out=d)
                        if k + 1 < K:  # the edges above the last one that the run straddles
                            rising[k + 1, :, -1] += (u[:, heads] * (d @ (n * (last[of] == k + 1)[:, None]))).sum(axis=0)
                        direct[k, :, -1] += (u[:, heads] * (np.multiply(m, d, out=m) @ n)).sum(axis=0)

    def total(pairs):
        rising, direct = (np.zeros((K + 1, sets, 1 + nv + lag)) for _ in range(2))
        for i, mids in pairs:
            if len(mids):
                meet(i, mids, rising, direct)
        return (np.cumsum(rising, axis=0) + direct)[:K]

    n, m = -(-a.n // mid), -(-b.n // mid)
    if not home:
        return total((i, np.arange(m)) for i in range(n))
    twice = total((i, np.array([i])) for i in range(n))  # each pair from both ends, and each position with itself
    twice[skip:, :, : 1 + nv] -= joint(a.w, a.w).sum(axis=0)
    return total((i, np.arange(i + 1, m)) for i in range(n)) + twice / 2


def _summed(rows: DataFrame, group, parts: int, edges, values, closed: bool, lag: bool, without=()) -> DataFrame:
    """(left_out, bin, pairs, g_<value>, dist if ``lag``) of each group of rows (x, y, n, value moments, own, home): pairs of an own row and another, and if ``home`` of two own rows.

    One set of sums per number in ``without``, over the rows whose ``fold`` is another; without any, one over all rows.
    """
    edges, left = [float(e) for e in edges], list(without) or [None]
    names = [f"g_{v}" for v in values] + (["dist"] if lag else [])

    def block(t: pa.Table) -> pa.Table:
        own = t["own"].to_numpy()
        xy = np.column_stack([t["x"].to_numpy(), t["y"].to_numpy()]).astype(np.float64)
        n = t["n"].to_numpy().astype(np.float64)
        w = [n]
        for v in values:  # less their mean, which no difference depends on
            m, ss = t[f"{v}__m"].to_numpy(), t[f"{v}__ss"].to_numpy()
            m = m - m.mean()
            w += [n * m, ss + n * m * m]
        w = np.column_stack(w)
        heads = [w.shape[1] * k for k in range(len(left))]
        if without:
            fold = t["fold"].to_numpy()
            w = np.hstack([w * (fold != f)[:, None] for f in left])
        s = np.zeros((len(edges), len(left), 1 + len(names)))
        if own.any():
            a = _Side(xy[own], w[own], heads, lag)
            if t["home"][0].as_py():
                s += _block_sums(a, None, edges, closed, lag, len(left), len(values))
            if not own.all():
                s += _block_sums(a, _Side(xy[~own], w[~own], heads, lag), edges, closed, lag, len(left), len(values))
        s = np.diff(s, axis=0)
        bins, k = (g.ravel() for g in np.indices(s.shape[:2]))
        s = s.reshape(len(bins), -1)
        return pa.table({"left_out": pa.array([left[i] for i in k], pa.int32()), "bin": pa.array(bins, pa.int32()), "pairs": pa.array(np.rint(s[:, 0]).astype(np.int64)), **{c: pa.array(s[:, 1 + i]) for i, c in enumerate(names)}})

    schema = "left_out int, bin int, pairs long" + "".join(f", {c} double" for c in names)
    moments = [f"{v}__{s}" for v in values for s in ("m", "ss")]
    # few bytes and much work: a fixed number of partitions keeps the work spread
    return rows.select(*group, "x", "y", "n", *moments, *(["fold"] if without else []), "own", "home").repartition(parts, *group).groupBy(*group).applyInArrow(block, schema)


def _blocks(loc: DataFrame, side: float, r: float, keys) -> DataFrame:
    """The positions, own in their block and others in the half of the neighbouring blocks that they are within r of."""
    cx, cy = F.floor(F.col("x") / side).cast("long"), F.floor(F.col("y") / side).cast("long")
    u, v = F.col("x") - cx * side, F.col("y") - cy * side
    r = r * (1 + 1e-6)
    near = {-1: lambda w: w <= r, 0: lambda w: F.lit(True), 1: lambda w: side - w <= r}
    to = [F.when(near[-i](u) & near[-j](v), F.struct((cx - i).alias("bx"), (cy - j).alias("by"), F.lit(i == 0 and j == 0).alias("own"))) for i, j in nearby.HALF]
    return loc.withColumn("__t", F.explode(F.filter(F.array(*to), lambda t: t.isNotNull()))).select("*", "__t.*", F.lit(True).alias("home"), (F.to_json(F.struct(*keys)) if keys else F.lit("")).alias("__k"))


def binned(loc: DataFrame, edges, values=(), keys=(), closed: bool = False, lag: bool = False, without=()) -> DataFrame:
    """(bin, pairs, g_<value>) over the row pairs of different positions below the last edge: row pairs and the sum of half squared differences.

    Bins are half open, the last one closed if ``closed``. With ``keys``, positions pair within one value of the keys, NULL being one.
    With ``lag`` also dist, the sum of the row pairs' distances. ``loc`` comes from ``nearby.locations``. With ``without`` (and ``lag``), numbers,
    one row per number and bin, ``left_out`` and ``bin``, over the rows of ``loc`` whose ``fold`` is another.
    """
    keys, r, without = list(keys), float(edges[-1]), list(without)
    if without and not lag:
        raise ValueError("sums without a fold are made with lag only")
    extra = [f"{v}__{s}" for v in values for s in ("m", "ss")] + (["fold"] if without else [])
    loc = cut(loc.filter(~nowhere("x", "y")).select("x", "y", "n", *extra, *keys))
    row = _at(loc, r).groupBy(*keys, "cx", "cy").agg(F.count(F.lit(1)).alias("c")).agg(F.avg("c"), F.sum("c")).first()
    side = r * max(1, int((BLOCK / (row[0] or BLOCK)) ** 0.5))
    rows = row[1] or 0
    spread = min(PARTS, 8 + rows // BLOCK)
    # a position is copied to each block it meets, so blocks grow with the table
    heavy, paired = max(HEAVY, rows // SHARE), max(PAIRED, (rows // SHARE) ** 2)
    sized = _at(loc, side).groupBy(*keys, "cx", "cy").agg(F.count(F.lit(1)).alias("__c")).filter(F.col("__c") > heavy)
    crowded = not sized.isEmpty()
    light = groups.same_keys(_at(loc, side), sized, [*keys, "cx", "cy"], "left_anti").drop("cx", "cy") if crowded else loc
    parts = [_summed(_blocks(light, side, r, keys), ["__k", "bx", "by"], spread, edges, values, closed, lag, without)]
    for at, whole, direct in opened(loc, edges, values, keys, side, heavy, paired, lag, 2) if crowded else ():
        n = F.when(F.col("home"), F.expr("(a__n * a__n - a__nn) div 2")).otherwise(F.col("a__n") * F.col("b__n"))
        if not lag:
            parts.append(whole.select(F.lit(None).cast("int").alias("left_out"), (F.col("band") - 1).alias("bin"), n.alias("pairs"), *[_whole_squares(v).alias(f"g_{v}") for v in values]))
        ends = cut(direct.withColumn("__k", F.monotonically_increasing_id()))
        here = _at(loc, at).select(*keys, "cx", "cy", "x", "y", "n", *extra)
        a = ends.select(*keys, F.col("ax").alias("cx"), F.col("ay").alias("cy"), "__k", "home", F.lit(True).alias("own"))
        b = ends.filter("NOT home").select(*keys, F.col("bx").alias("cx"), F.col("by").alias("cy"), "__k", "home", F.lit(False).alias("own"))
        parts.append(_summed(groups.same_keys(a.unionByName(b), here, [*keys, "cx", "cy"]), ["__k"], spread, edges, values, closed, lag, without))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    sums = ["pairs", *[f"g_{v}" for v in values], *(["dist"] if lag else [])]
    return every.filter(f"bin >= 0 AND bin < {len(edges) - 1} AND pairs > 0").groupBy(*(["left_out"] if without else []), "bin").agg(*[F.sum(c).alias(c) for c in sums])


def neighbours(loc: DataFrame, r: float) -> DataFrame:
    """(lid, m): per position, by its id, the rows at other positions within r; positions without any may be missing."""
    loc, light, crowded = split(loc, r)

    def both(p: DataFrame) -> DataFrame:
        return p.select(F.col("id_a").alias("lid"), F.col("n_b").alias("m")).unionByName(p.select(F.col("id_b").alias("lid"), F.col("n_a").alias("m")))

    near = both(nearby.pairs_of(light, r))
    if crowded:
        for side, whole, direct in opened(loc, [0.0, r]):
            near = near.unionByName(both(positions(loc, side, direct).filter(F.col("d") <= r)))
            given = whole.select(F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.when(F.col("home"), F.col("a__n")).otherwise(F.col("b__n")).alias("m"), "home")
            given = given.unionByName(whole.filter("NOT home").select(F.col("bx").alias("cx"), F.col("by").alias("cy"), F.col("a__n").alias("m"), "home"))
            per = given.groupBy("cx", "cy").agg(F.sum("m").alias("m"), F.max("home").alias("home"))
            own = _at(loc, side).join(per, ["cx", "cy"]).select(F.col("id").alias("lid"), (F.col("m") - F.when(F.col("home"), F.col("n")).otherwise(0)).alias("m"))
            near = near.unionByName(own)
    return near.groupBy("lid").agg(F.sum("m").alias("m"))


def class_counts(points: DataFrame, px: DataFrame, r: float, names) -> DataFrame:
    """(x, y, n, <names>): sums of the pixel columns n and ``names`` within r of each distinct position; positions without pixels are absent.

    ``px``: one row per pixel position (x, y, n, <names>). Cells of pixels that lie wholly inside the circle count by their sums,
    cells on its rim are opened into FAN * FAN children, and only small rim cells are compared pixel by pixel.
    """
    sums = ["n", *names]
    px, side, eps = cut(px), float(r), 1e-6 * r
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in nearby.FULL]))
    todo = _at(points, side).withColumn("o", around).select("x", "y", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    out = []
    while True:
        cells = _at(px.withColumnsRenamed({"x": "bx", "y": "by"}).withColumns({"x": F.col("bx"), "y": F.col("by")}), side)
        boxes = cells.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("c"), *[F.sum(c).alias(c) for c in sums], F.min("bx").alias("x0"), F.max("bx").alias("x1"), F.min("by").alias("y0"), F.max("by").alias("y1"))
        gap = [F.greatest(F.lit(0.0), F.col(f"{k}0") - F.col(k), F.col(k) - F.col(f"{k}1")) for k in "xy"]
        far = [F.greatest(F.col(f"{k}1") - F.col(k), F.col(k) - F.col(f"{k}0")) for k in "xy"]
        least, most = (F.sqrt(u * u + v * v) for u, v in (gap, far))
        fate = F.when(most + eps <= r, "whole").when(F.col("c") <= RIM, "direct").otherwise("open")
        pairs = cut(todo.join(boxes, ["cx", "cy"]).filter(least - eps <= r).select("x", "y", "cx", "cy", *sums, fate.alias("fate")))
        out.append(pairs.filter("fate = 'whole'").select("x", "y", *sums))
        near = pairs.filter("fate = 'direct'").select("x", "y", "cx", "cy").join(cells.drop("x", "y"), ["cx", "cy"])
        out.append(near.filter(distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by")) <= r).select("x", "y", *sums))
        todo = pairs.filter("fate = 'open'")
        if todo.isEmpty():
            break
        side /= FAN
        inner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(FAN) for j in range(FAN)]))
        todo = todo.withColumn("o", inner).select("x", "y", (F.col("cx") * FAN + F.col("o.i")).alias("cx"), (F.col("cy") * FAN + F.col("o.j")).alias("cy"))
    every = out[0]
    for p in out[1:]:
        every = every.unionByName(p)
    return every.groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in sums])
