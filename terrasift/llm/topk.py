"""Exact top-k by integer inner product: a Voronoi kNN join.

Pivots cut the data into cells; queries are grouped by the nearest of a few pivots. Each query scores a bounded probe of the
data first, so its k-th probe score is a floor for its result. With p the pivot of a cell and d = |x - p|,
q.x = q.p + q.(x - p) <= q.p + |q| d, so a query needs from a cell only vectors at least (floor - q.p) / |q| away from the
pivot, and only vectors of norm floor / |q| or more. The least of these per group and cell are the group's bounds: a data row
is copied to a group only where it meets them, and the group is solved locally, block by block.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrasift.session import cut

RESULT = "query_id long, rank int, vec_id long, score long"
SLACK = 1e-6  # relative, far above the rounding of the bounds


def quantised(df: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) per component. Null vectors, and those with null or non-finite components, are left out."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return df.filter(x.isNotNull() & F.col(id).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.col(id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: by doubles while they are exact, else by Python integers; a score beyond a long raises."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if top < 2.0**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return (q.astype(object) @ x.astype(object).T).astype(np.int64)


def best(s: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k highest scores without the query's own row, ties to the smaller id."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        s_at = s[at]
        edge = np.partition(s_at, len(at) - k)[len(at) - k]
        at = at[s_at >= edge]
    return at[np.lexsort((ids[at], -s[at]))][:k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, *, pivots: int = 64, groups: int = 16, probe: int = 2048, group_rows: int = 2048, part_rows: int = 100_000) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of ``vectors`` for each row of ``queries`` (both vec_id, v).

    A query's own id is no candidate; vectors of another length than the query are none either. Repeated ids are separate
    candidates. ``probe`` and ``pivots`` bound what the driver holds (probe x length); ``group_rows`` and ``part_rows`` bound a task:
    a crowded group is cut into blocks of queries, and its data by a hash into parts. No table gives no rows.
    """
    vectors = cut(vectors)
    lengths = [r[0] for r in vectors.select(F.size("v").alias("n")).distinct().collect()]
    parts = [_one_length(vectors.filter(F.size("v") == n), queries.filter(F.size("v") == n), k, pivots, groups, probe, group_rows, part_rows) for n in sorted(lengths)]
    return reduce(DataFrame.unionByName, parts, vectors.sparkSession.createDataFrame([], RESULT))


def _one_length(data: DataFrame, queries: DataFrame, k: int, pivots: int, groups: int, probe: int, group_rows: int, part_rows: int) -> DataFrame:
    rows = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(probe).collect()
    pid = np.array([r.vec_id for r in rows], np.int64)
    px = np.array([r.v for r in rows], np.int64).reshape(len(rows), -1)
    centre = np.unique(px[: 4 * pivots], axis=0).astype(np.float64)
    centre = centre[:: max(1, len(centre) // pivots)][:pivots]
    few = min(groups, len(centre))
    half = (centre**2).sum(1) / 2

    def group_queries(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, q = b.column("vec_id").to_numpy(), _matrix(b.column("v"))
            s, norm = scores(q, px), np.sqrt((q.astype(np.float64) ** 2).sum(1))
            floor = np.array([-np.inf if (s_ok := np.sort(s[i][pid != ids[i]])).size < k else s_ok[-k] for i in range(len(q))], np.float64)
            floor -= SLACK * (1 + np.abs(floor))
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(norm[:, None] > 0, (floor[:, None] - q @ centre.T) / norm[:, None], -np.inf)
                least = np.where(norm > 0, floor / norm, -np.inf)
            need, least = np.nan_to_num(need, nan=-np.inf), np.nan_to_num(least, nan=-np.inf)
            g = np.argmax(q @ centre[:few].T - half[:few], axis=1)
            yield pa.record_batch({"vec_id": pa.array(ids), "v": b.column("v"), "g": pa.array(g.astype(np.int32)), "bounds": pa.array(list(np.column_stack([need, least])), pa.list_(pa.float64()))})

    q = cut(queries.mapInArrow(group_queries, "vec_id long, v array<long>, g int, bounds array<double>"))
    bounds = q.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.min(F.col("bounds")[i]).alias(f"b{i}") for i in range(len(centre) + 1)]).collect()
    if not bounds:
        return data.sparkSession.createDataFrame([], RESULT)
    table = {r.g: np.array(r[2:], np.float64) for r in bounds}
    blocks = {r.g: -(-r.n // group_rows) for r in bounds}
    total = data.count()
    salts = max(1, -(-total // part_rows))
    names = sorted(table)
    need = np.array([table[g] for g in names]).reshape(len(names), -1)

    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"))
            cell = np.argmax(x @ centre.T - half, axis=1)
            far = np.sqrt(((x - centre[cell]) ** 2).sum(1)) * (1 + SLACK) + SLACK
            norm = np.sqrt((x.astype(np.float64) ** 2).sum(1)) * (1 + SLACK) + SLACK
            for i, g in enumerate(names):
                at = pa.array(np.flatnonzero((far >= need[i][cell]) & (norm >= need[i][-1])))
                if len(at):
                    yield pa.record_batch({"vec_id": b.column("vec_id").take(at), "v": b.column("v").take(at), "g": pa.array(np.full(len(at), g, np.int32))})

    sent = data.mapInArrow(deal, "vec_id long, v array<long>, g int").withColumn("part", F.expr(f"CAST(pmod(xxhash64(vec_id, 7), {salts}) AS INT)"))
    most = max(blocks.values(), default=1)
    block = F.expr(f"CAST(pmod(xxhash64(vec_id, 11), {most}) AS INT)") if most > 1 else F.lit(0)
    left = q.select("vec_id", "v", "g", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("part"))
    right = sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))

    def solve(key, lq, lx):
        ids, x = lx.column("vec_id").to_numpy(), _matrix(lx.column("v")) if lx.num_rows else np.zeros((0, px.shape[1]), np.int64)
        out: list[tuple] = []
        own, m = lq.column("vec_id").to_numpy(), _matrix(lq.column("v")) if lq.num_rows else None
        for at in range(0, len(own) if len(ids) else 0, 64):
            s = scores(m[at : at + 64], x)
            for i, o in enumerate(own[at : at + 64]):
                out += [(o, ids[j], s[i, j]) for j in best(s[i], ids, o, k)]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    local = left.groupBy("g", "block", "part").cogroup(right.groupBy("g", "block", "part")).applyInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    data = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(data, data.filter("vec_id % 100 = 0"), 10)


SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.e, d.e), lambda z: z[1] * z[2])) AS score
 FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 10"""
