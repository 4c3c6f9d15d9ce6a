"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import chunks, class_table, extended, hashed_words, held_out, in_batches, labelled, mix, task_sums, utf8

SLOTS = 1 << 14  # words share a vector by hash, so the table has the same size at every scale
DIM = 32
REACH = 2  # neighbours on either side that make up a word's context
#: Letters, digits and bytes of other characters make words, other printable ASCII makes tokens of its own.
TOKENS = class_table(lambda b: 0 if b <= 32 else 1 if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 2)


def index_vectors() -> np.ndarray:
    """One fixed ternary vector per slot: a third of the entries are -1 or 1."""
    bits = mix(np.arange(SLOTS * DIM, dtype=np.uint64) + np.uint64(0x51ED2701)) % np.uint64(6)
    return np.where(bits == 0, 1, np.where(bits == 1, -1, 0)).astype(np.int8).reshape(SLOTS, DIM)


def context_sums(texts: list[bytes], index: np.ndarray, total: np.ndarray) -> None:
    """Add to each word's row the index vectors of the words around it in the same text."""
    for a, b in chunks(texts):
        h, begin = hashed_words(texts[a:b], TOKENS)
        if not len(h):
            continue
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        doc = np.repeat(np.arange(b - a), np.diff(begin))
        own = index[slot]
        near = np.zeros((len(h), DIM), np.int16)
        for d in range(1, REACH + 1):
            same = (doc[d:] == doc[:-d])[:, None]
            near[d:] += own[:-d] * same
            near[:-d] += own[d:] * same
        for j in range(DIM):
            total[:, j] += np.bincount(slot, weights=near[:, j], minlength=SLOTS).astype(np.int64)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """SLOTS x 2*DIM: the unit context vector of each slot, from all documents, beside its unit index vector."""
    index = index_vectors()

    def count(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros((SLOTS, DIM), np.int64)
        context_sums(utf8(batch.column(0)), index, total)
        return total.ravel()

    context = task_sums(docs, count, SLOTS * DIM, [text]).reshape(SLOTS, DIM).astype(np.float64)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    return np.hstack([unit(context), unit(index.astype(np.float64))]).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of each text; a text without words is all zeros."""
    out = np.zeros((len(texts), vectors.shape[1]), np.float32)
    for a, b in chunks(texts):
        h, begin = hashed_words(texts[a:b], TOKENS)
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        n = np.diff(begin)
        full = np.flatnonzero(n)
        if len(full):
            out[a + full] = np.add.reduceat(vectors[slot], begin[:-1][full], axis=0) / n[full][:, None]
    return out


@dataclass
class Network:
    """tanh layer and one logit, on standardised inputs; the logit is divided by ``temperature``."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logit(x.astype(np.float64)) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, *, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-3, seed: int = 5) -> Network:
    """Adam on the log loss; every fifth row is kept back to choose the temperature."""
    if not len(y) or y.min() == y.max():  # nothing to tell apart: a constant, one pseudo row of either class
        p = (y.sum() + 1.0) / (len(y) + 2.0)
        d = x.shape[1]
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    x = x.astype(np.float64)
    back = np.arange(len(y)) % 5 == 4
    if y[~back].min() == y[~back].max():
        back[:] = False
    mean, scale = x[~back].mean(0), x[~back].std(0) + 1e-6
    z, t = (x[~back] - mean) / scale, y[~back].astype(np.float64)
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step, size = 0, 128
    for _ in range(max(epochs, -(-1500 * size // len(t)))):
        order = rng.permutation(len(t))
        for at in range(0, len(t), size):
            i = order[at : at + size]
            a = np.tanh(z[i] @ p[0] + p[1])
            err = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -30, 30))) - t[i]) / len(i)
            back_a = np.outer(err, p[2]) * (1 - a * a)
            grads = [z[i].T @ back_a + decay * p[0], back_a.sum(0), a.T @ err + decay * p[2], np.array([err.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    cal = back if back.any() else np.ones(len(y), bool)
    net.temperature = temperature(net.logit(x[cal]), y[cal])
    return net


def temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, between 1/4 and 8."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 120))
    loss = [np.mean(np.logaddexp(0, -np.clip(logit / t, -500, 500) * (2 * y - 1))) for t in grid]
    return float(grid[int(np.argmin(loss))])


@dataclass
class Model:
    vectors: np.ndarray
    net: Network


def fit(docs: DataFrame, labels: DataFrame, *, target: str = "quality", bound: int = 20_000, text: str = "text") -> Model:
    """Word vectors from all documents; the network from at most ``bound`` labelled rows that are not held out."""
    vectors = word_vectors(docs, text)

    def pool(batches):
        for b in batches:
            x = pooled(utf8(b.column(1)), vectors)
            yield pa.record_batch({"id": b.column(0), "x": pa.array(list(x.astype(np.float64)), pa.list_(pa.float64())), "y": b.column(2)})

    sample = labelled(docs, labels, target, bound=bound, text=text).select(F.col("id").cast("string").alias("id"), "text", "y")
    rows = in_batches(sample, pool, "id string, x array<double>, y int").toPandas().sort_values("id")
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), 2 * DIM)
    return Model(vectors, train(x, rows["y"].to_numpy(np.int64)))


def score(docs: DataFrame, model: Model, *, text: str = "text", cut_at: float = 0.3) -> DataFrame:
    """Add score (0 to 1) and predicted (score >= cut_at), in place of columns of these names.

    Null and empty texts are scored as documents without words.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index(text), docs.columns

    def work(batches):
        m = shared.value
        for b in batches:
            p = m.net.score(pooled(utf8(b.column(at)), m.vectors))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64()), pa.array((p >= cut_at).astype(np.int32))], names=[*names, "score", "predicted"])

    return in_batches(docs, work, extended(docs, "score double, predicted int"))


def keep(docs: DataFrame, model: Model, *, text: str = "text", cut_at: float = 0.3) -> DataFrame:
    """The rows whose score reaches ``cut_at``; columns as they came, whatever their names."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def work(batches):
        m = shared.value
        for b in batches:
            yield b.filter(pa.array(m.net.score(pooled(utf8(b.column(at)), m.vectors)) >= cut_at))

    return in_batches(docs, work, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; columns named so in ``docs`` are not read."""
    rows = docs.select("doc_id", "text")
    return score(rows, fit(rows, labels, **kw)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
