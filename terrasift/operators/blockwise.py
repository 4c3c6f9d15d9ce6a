"""Top-k by distance inside co-grouped blocks, vectorised over Arrow batches.

Spark decides which rows meet (the grouping keys) and shuffles them; inside a task one block of queries is compared
with one block of references as a NumPy matrix, in slices of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = 2_000_000  # distances held at once
TILE = 64  # queries of a tile


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray):
    """Common integer codes of two columns."""
    both = pa.chunked_array([*a.chunks, *b.chunks], type=a.type).combine_chunks()
    idx = both.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return idx[: len(a)], idx[len(a) :]


def _nearest(Q, R, k, tie, qg=None, rg=None, qid=None, rid=None, limit=None):
    """(query row, reference row, distance) of the k best per query; R must be in id order, which settles ties."""
    out = []
    for rows, near in _tiles(Q, R, tie, limit) if qid is not None else _closer(Q, R, k, tie, limit, qg, rg):
        refs = R if near is None else R[near]
        step = max(1, SLICE // max(1, len(refs)))
        for a in range(0, len(rows), step):
            at = rows[a : a + step]
            q = Q[at]
            d2 = np.zeros((len(q), len(refs)))
            for j in range(Q.shape[1]):
                t = q[:, j : j + 1] - refs[None, :, j]
                d2 += t * t
            d = np.round(np.sqrt(d2), tie)
            if qg is not None:
                d[qg[at, None] == (rg if near is None else rg[near])[None, :]] = np.inf
            if qid is not None:
                d[qid[at, None] == (rid if near is None else rid[near])[None, :]] = np.inf
            if limit is not None:
                d[d > limit[at, None]] = np.inf
            if len(refs) > k:
                kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                keep = (d <= kth) & np.isfinite(d)
            else:
                keep = np.isfinite(d)
            i, j = np.nonzero(keep)
            v = d[i, j]
            order = np.lexsort((j, v, i))
            i, j, v = i[order], j[order], v[order]
            starts = np.searchsorted(i, np.arange(len(q)))
            rank = np.arange(len(i)) - starts[i]
            m = rank < k
            out.append((at[i[m]], j[m] if near is None else near[j[m]], v[m]))
    if not out:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(0)
    return tuple(np.concatenate(p) for p in zip(*out))


def _tiles(Q, R, tie, limit):
    """(query rows, reference rows or None for all): with limits in the plane, tiles of about TILE queries and what is in their reach."""
    if limit is None or Q.shape[1] != 2 or len(R) <= TILE:
        yield np.arange(len(Q)), None
        return
    n = max(1, int(np.sqrt(len(Q) / TILE)))
    low = Q.min(axis=0)
    cell = np.minimum(((Q - low) / (np.maximum(Q.max(axis=0) - low, 1e-9) / n)).astype(np.int64), n - 1)
    key = cell[:, 0] * n + cell[:, 1]
    order = np.argsort(key, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        reach = limit[rows].max() + 10.0**-tie
        lo, hi = Q[rows].min(axis=0) - reach, Q[rows].max(axis=0) + reach
        yield rows, np.flatnonzero((R[:, 0] >= lo[0]) & (R[:, 0] <= hi[0]) & (R[:, 1] >= lo[1]) & (R[:, 1] <= hi[1]))


def _closer(Q, R, k, tie, limit, qg, rg):
    """The tiles, parted by exclusion value, with those references only that may be among the k best of one of their queries.

    If the k-th eligible reference is d away from the centre of queries at most r from it, each of them has k within d + r, and those are
    within d + 2 r of the centre. So a tile far from all it may match looks at each reference once, not once for each query.
    """
    for rows, near in _tiles(Q, R, tie, limit):
        if near is None:
            yield rows, None
            continue
        told = [(rows, near)]
        if qg is not None:
            of = qg[rows]
            same = [(v, of == v if v == v else of != of) for v in np.unique(of)]  # NaN stands for NULL, which excludes nothing
            told = [(rows[m], near[rg[near] != v]) for v, m in same]
        for own, refs in told:
            if len(refs) > max(k, TILE):
                q = Q[own]
                centre = (q.min(axis=0) + q.max(axis=0)) / 2
                d = np.hypot(*(R[refs] - centre).T)
                reach = np.partition(d, k - 1)[k - 1] + 2 * np.hypot(*(q - centre).T).max() + 2 * 10.0**-tie
                refs = refs[d <= reach]
            yield own, refs


def top_k(q: DataFrame, r: DataFrame, keys, coords, k: int, *, qid="id", rid="nb", rcoords=None, exclude: str | None = None, same_id: bool = False, radius: str | None = None, tie: int = 3, qcols=(), rcols=(), give: str = "rows") -> DataFrame:
    """Rows (qid, *qcols, rid, d, *rcols): per query the k nearest references sharing its grouping keys.

    give "lists": (qid, *qcols, near) per query that has any, near an array of (rid, d, *rcols) from the nearest on; "bound": (qid, *qcols,
    c, R) per query, how many were found and the distance of the last.

    exclude: column of both sides whose equal values never match; same_id: a row never matches its own id; radius:
    column of q beyond which nothing is wanted. Callers bound the rows per key.
    """
    rcoords = list(rcoords or coords)
    coords = list(coords)
    ex = [exclude] if exclude else []
    qsel = list(dict.fromkeys([*keys, qid, *qcols, *coords, *ex, *([radius] if radius else [])]))
    rsel = list(dict.fromkeys([*keys, rid, *rcols, *rcoords, *ex]))
    left = q.select(*qsel)
    right = r.select(*[F.col(c).alias(f"r__{c}") for c in rsel])  # fresh names: both sides may come from one table
    own = list(dict.fromkeys([qid, *qcols]))
    found = [T.StructField(rid, r.schema[rid].dataType), T.StructField("d", T.DoubleType()), *[r.schema[c] for c in rcols]]
    last = {"rows": found, "lists": [T.StructField("near", T.ArrayType(T.StructType(found)))], "bound": [T.StructField("c", T.LongType()), T.StructField("R", T.DoubleType())]}
    schema = T.StructType([*[left.schema[c] for c in own], *last[give]])

    def block(lt: pa.Table, rt: pa.Table) -> pa.Table:
        rt = rt.rename_columns(rsel)
        empty = lt.num_rows == 0 or rt.num_rows == 0
        if not empty:
            rt = rt.take(pc.sort_indices(rt, sort_keys=[(rid, "ascending")]))
            Q = np.column_stack([lt[c].to_numpy() for c in coords])
            R = np.column_stack([rt[c].to_numpy() for c in rcoords])
            qg, rg = _codes(lt[exclude], rt[exclude]) if exclude else (None, None)
            qi, ri = _codes(lt[qid], rt[rid]) if same_id else (None, None)
            i, j, d = _nearest(Q, R, k, tie, qg, rg, qi, ri, lt[radius].to_numpy() if radius else None)
        else:
            i = j = np.zeros(0, dtype=np.int64)
            d = np.zeros(0)
        mine = lt.select(own)
        if give == "bound":
            c = np.bincount(i, minlength=lt.num_rows)
            far = np.full(lt.num_rows, -1.0)
            np.maximum.at(far, i, d)
            return pa.table([*mine.columns, pa.array(c.astype(np.int64)), pa.array(far, mask=c == 0)], names=schema.names)
        b = rt.select([rid, *rcols]).take(pa.array(j))
        if give == "rows":
            return pa.table([*mine.take(pa.array(i)).columns, b.column(0), pa.array(d), *b.columns[1:]], names=schema.names)
        start = np.flatnonzero(np.diff(i, prepend=-1))  # the hits of a query are together
        parts = [b.column(0), pa.chunked_array([pa.array(d)]), *b.columns[1:]]
        items = pa.StructArray.from_arrays([c.combine_chunks() for c in parts], names=[rid, "d", *rcols])
        near = pa.ListArray.from_arrays(pa.array(np.append(start, len(i)), pa.int32()), items)
        return pa.table([*mine.take(pa.array(i[start])).columns, near], names=schema.names)

    return left.groupBy(*keys).cogroup(right.groupBy(*[f"r__{c}" for c in keys])).applyInArrow(block, schema)
