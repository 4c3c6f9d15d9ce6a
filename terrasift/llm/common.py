"""Shared helpers: rows in Arrow batches, words hashed in bulk, sums over tasks, the labelled sample."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept between calls up to 4 million."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        pair = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 1 << 22:
            return pair
        _POWERS.update(up=pair[0], down=pair[1])
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(blob: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, equal for equal bytes wherever they stand."""
    up, down = _powers(len(blob) + 1)
    total = np.zeros(len(blob) + 1, np.uint64)
    np.cumsum((blob.astype(np.uint64) + np.uint64(1)) * up[: len(blob)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def class_table(spec: Callable[[int], int]) -> np.ndarray:
    return np.array([spec(i) for i in range(256)], np.uint8)


def runs(blob: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes of one class; class 0 separates."""
    kind = table[blob]
    edge = np.flatnonzero(np.diff(kind, prepend=0, append=0) if len(kind) else kind)
    if not len(edge):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = edge[:-1]
    ends = edge[1:]
    keep = kind[starts] != 0
    return starts[keep], ends[keep]


def chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text is a chunk of its own."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def hashed_words(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and the offset of each text's first word (one more than texts)."""
    blob = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, ends = runs(blob, table)
    h = span_hashes(blob, starts, ends)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return h, np.searchsorted(starts, begin)


def lower(text: bytes) -> bytes:
    """A-Z lower-cased, all other bytes kept."""
    return text.translate(_LOWER)


_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def held_out(doc_id: str = "doc_id"):
    """Rows whose crc32(id as text) mod 5 is 0 teach nothing. A row without an id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, target: str, *, bound: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, y) of at most ``bound`` labelled documents, in the order of a hash of the id.

    Held-out ids and null labels are left out; an id with several labels counts by the largest. The sample is drawn from the
    labels alone, so the documents are only filtered by a table of at most ``bound`` rows.
    """
    y = labels.filter(F.col(target).isNotNull() & ~held_out(doc_id)).groupBy(doc_id).agg(F.max(target).cast("int").alias("y"))
    sample = y.orderBy(F.xxhash64(doc_id), doc_id).limit(bound)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample.withColumnRenamed(doc_id, "id")), "id")
    return rows.groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("y").alias("y"))


def tree_sum(parts: DataFrame, tasks: int, fan: int = 16) -> DataFrame:
    """Sum int64 vectors held as bytes: rows (part int, v binary) meet at most ``fan`` at a time, level by level."""

    def add(table: pa.Table) -> pa.Table:
        total = None
        for v in table.column("v").to_pylist():
            a = np.frombuffer(v, np.int64)
            total = a.copy() if total is None else total + a
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "v": [total.tobytes()]})

    while tasks > 1:
        parts = parts.select(F.expr(f"CAST(part DIV {fan} AS INT)").alias("part"), "v").groupBy("part").applyInArrow(add, "part int, v binary")
        tasks = -(-tasks // fan)
    return parts


def task_sums(df: DataFrame, count: Callable[[list[pa.RecordBatch]], np.ndarray], length: int, columns: list[str]) -> np.ndarray:
    """One vector of ``length`` int64 for the whole table: each task sums ``count(batch)``, tasks are added as a tree."""

    def work(batches):
        from pyspark import TaskContext

        total = np.zeros(length, np.int64)
        for b in batches:
            total += count(b)
        yield pa.record_batch({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    src = df.select(*columns)
    rows = tree_sum(in_batches(src, work, "part int, v binary"), src.rdd.getNumPartitions()).collect()
    return sum((np.frombuffer(r.v, np.int64) for r in rows), np.zeros(length, np.int64))



def extended(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of ``df`` with more columns behind."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def free(spark) -> None:
    """Let Spark's cleaner drop the shuffles of finished steps: it acts when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


BATCH_ROWS = 1000  # texts per Arrow batch; Spark's 10,000 hold tens of megabytes several times over in each worker
_RESIDENT: dict[str, object] = {}


def in_batches(df: DataFrame, work, schema, keeps: bool = False) -> DataFrame:
    """``df.mapInArrow`` for texts: small batches, and workers that give freed memory back when a task ends.

    The batch size is a setting of the session and stays set, since the plan runs later. ``keeps``: the work uses ``resident``;
    other work lets go of what an earlier operator left in the worker.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def task(batches):
        if not keeps:
            _RESIDENT.clear()
        yield from work(batches)
        trim()

    return df.mapInArrow(task, schema)


def resident(key: str, make: Callable[[], object]):
    """What a worker keeps between tasks (an automaton, a codec): one at a time, whatever operator it belongs to."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def trim() -> None:
    """Return free memory to the system; workers live on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
