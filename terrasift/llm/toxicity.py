"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Terms are the stems of a text's words, their first STEM letters, by hash slot; a stem's weight is its count times the idf of its slot,
taken from all documents. The index holds a bounded sample of labelled documents with all their terms. It lies in the shared
folder in parts of bounded size, each with its postings in blocks of BLOCK examples and the largest weight of every term in every
block: a block is opened only if these maxima leave it a chance to hold one of the k nearest. Tasks open one part after another, and the
driver holds paths, the idf table of fixed size and two numbers per example.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasift.llm.common import chunks, class_table, extended, held_out, in_batches, labelled, lower, resident, runs, span_hashes, task_sums, utf8
from terrasift.session import scratch

#: Letters, digits and bytes of other characters, after A-Z are lower-cased.
WORDS = class_table(lambda b: 1 if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 0)
STEM = 4  # letters of a stem; shorter words have none
SLOTS = 1 << 17  # hash slots of the stems
BLOCK = 64  # examples per block of the index
#: A term of more than one in COMMON of a part's examples is a row of its matrix, the MOST most frequent ones at most.
COMMON, MOST = 16, 512
TOGETHER = 32  # texts scored at a time
SLACK = 1e-5  # far above the rounding of single precision
POSTINGS = 1_000_000  # postings per part of the index, by which parts are cut
KEPT_BYTES = 96 << 20  # parts that a worker keeps open
NEAREST = 40


def stems(blob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash slot of the stem of every word of at least STEM letters."""
    starts, ends = runs(blob, WORDS)
    first = np.flatnonzero((blob & 0xC0) != 0x80)  # where characters begin
    a, b = np.searchsorted(first, starts), np.searchsorted(first, ends)
    long = b - a >= STEM
    starts, at = starts[long], a[long] + STEM
    cut = np.where(at < len(first), first[np.minimum(at, max(len(first) - 1, 0))], len(blob)) if len(starts) else starts
    return starts, (span_hashes(blob, starts, cut) & np.uint64(SLOTS - 1)).astype(np.int64)


def bags(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The slots of each text, in order, and how often each occurs."""
    out = []
    low = [lower(t) for t in texts]
    for x, y in chunks(low):
        part = low[x:y]
        starts, slot = stems(np.frombuffer(b"\n".join(part) + b"\n", np.uint8))
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
        key, n = np.unique((np.searchsorted(begin, starts, side="right") - 1) * SLOTS + slot, return_counts=True)
        edge = np.searchsorted(key, np.arange(y - x + 1) * SLOTS)
        out += [(key[a:b] & (SLOTS - 1), n[a:b]) for a, b in zip(edge, edge[1:])]
    return out


def inverse_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """idf of each slot over all documents."""

    def count(batch: pa.RecordBatch) -> np.ndarray:
        texts = utf8(batch.column(0))
        found = [t for t, _ in bags(texts)]
        return np.append(np.bincount(np.concatenate(found), minlength=SLOTS) if found else np.zeros(SLOTS, np.int64), len(texts))

    total = task_sums(docs, count, SLOTS + 1, [text])
    return np.log((1.0 + total[-1]) / (1.0 + total[:-1])) + 1.0


def weights(slot: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights over their length."""
    w = n * idf[slot]
    return w / np.sqrt((w * w).sum()) if len(w) else w


def _find(among: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands in the sorted ``among``, and whether it does."""
    at = np.minimum(np.searchsorted(among, what), max(len(among) - 1, 0))
    return at, among[at] == what if len(among) else np.zeros(len(what), bool)


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first[i] .. first[i] + size[i] - 1, one after another."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


class Part:
    """One part of the index: its examples with their terms, a matrix of the terms that very many of them have, and postings of all
    other terms by block, with the block's largest weight."""

    def __init__(self, number: np.ndarray, ids: list[str], y: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]):
        size = np.array([len(t) for t, _ in vectors])
        self.begin = np.concatenate([[0], np.cumsum(size)])
        self.slot, self.value = np.concatenate([t for t, _ in vectors]).astype(np.int32), np.concatenate([w for _, w in vectors])
        self.number, self.ids, self.y, self.blocks = number, np.array(ids, object), y, -(-len(vectors) // BLOCK)
        own = np.repeat(np.arange(len(vectors)), size)
        slots, df = np.unique(self.slot, return_counts=True)
        often = np.argsort(-df, kind="stable")[:MOST]
        self.common = np.sort(slots[often[df[often] * COMMON > len(vectors)]])
        row, dense = _find(self.common, self.slot)
        self.matrix = np.zeros((len(self.common), self.blocks * BLOCK), np.float32)
        self.matrix[row[dense], own[dense]] = self.value[dense]
        term, own, w = self.slot[~dense], own[~dense], self.value[~dense]
        order = np.lexsort((own, term))
        term, self.example, self.weight = term[order], own[order].astype(np.int32), w[order]
        block = self.example // BLOCK
        new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))) if len(term) else np.zeros(0, np.int64)
        self.first = np.append(new, len(term))
        self.block, self.most = block[new], np.maximum.reduceat(w[order], new) if len(new) else np.zeros(0)
        self.term, at = np.unique(term[new], return_index=True)
        self.entry = np.append(at, len(new))

    _ARRAYS = ("begin", "slot", "value", "common", "matrix", "example", "weight", "first", "block", "most", "term", "entry", "number", "y")

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, blocks=self.blocks, ids=np.frombuffer("\n".join(self.ids).encode(), np.uint8), **{k: getattr(self, k) for k in self._ARRAYS})
        return out.getvalue()

    @classmethod
    def loads(cls, raw: bytes) -> Part:
        part, held = cls.__new__(cls), np.load(io.BytesIO(raw))
        for k in cls._ARRAYS:
            setattr(part, k, held[k])
        part.blocks, part.ids = int(held["blocks"]), np.array(held["ids"].tobytes().decode().split("\n"), object)
        return part

    @property
    def bytes(self) -> int:
        return sum(getattr(self, k).nbytes for k in self._ARRAYS)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, least: list[float], skip: list[int]):
        """(places, cosines, blocks skipped) per query: this part's k nearest examples among those of at least ``least``, ties to the lower place.

        The common terms are scored for all examples at once. A block's bound is its best such score and the sum of the query's other
        weights times the block's largest; blocks are opened in that order, a few first, for a k-th cosine to hold the others against.
        Both are in single precision with SLACK to spare, and what may be among the nearest is scored again in double precision.
        ``skip``: numbers of examples to leave out.
        """
        scratch = np.zeros(SLOTS)
        for x in range(0, len(queries), TOGETHER):
            part = queries[x : x + TOGETHER]
            q, rare = np.zeros((len(part), len(self.common)), np.float32), []
            for i, (t, w) in enumerate(part):
                at, hit = _find(self.common, t)
                q[i, at[hit]] = w[hit]
                rare.append((t[~hit], w[~hit]))
            scores = q @ self.matrix
            for i, (t, w) in enumerate(part):
                scratch[t] = w
                yield self._open(scratch, scores[i], *rare[i], k, least[x + i], skip[x + i])
                scratch[t] = 0

    def _open(self, query, score, slot, w, k, least, skip):
        at, hit = _find(self.term, slot)
        at, w = at[hit], w[hit]
        size = self.entry[at + 1] - self.entry[at]
        entry, share = _spans(self.entry[at], size), np.repeat(w, size)
        block = self.block[entry]
        bound = score.reshape(self.blocks, BLOCK).max(axis=1) + np.bincount(block, share * self.most[entry], minlength=self.blocks) + SLACK
        order = np.argsort(-bound, kind="stable")
        total, seen, step, floor = np.full(len(score), -1.0), 0, -(-2 * k // BLOCK), max(least - SLACK, SLACK)
        while seen < self.blocks and bound[order[seen]] > floor:
            end = seen + int(np.searchsorted(-bound[order[seen : seen + step]], -floor, side="right"))
            chosen = np.zeros(self.blocks, bool)
            chosen[order[seen:end]] = True
            seen, step = end, self.blocks
            take = chosen[block]
            e, q = entry[take], share[take]
            n = self.first[e + 1] - self.first[e]
            where = _spans(self.first[e], n)
            s = score + np.bincount(self.example[where], np.repeat(q, n) * self.weight[where], minlength=len(score))
            opened = np.repeat(chosen, BLOCK)
            total[opened] = s[opened]
            some = total[total > floor]
            if len(some) > k:  # one more than k, as one may be left out
                floor = max(floor, float(np.partition(some, len(some) - k - 1)[len(some) - k - 1]) - 2 * SLACK)
        found = np.flatnonzero(total >= floor)
        found = found[found < len(self.number)]
        found = found[self.number[found] != skip]
        exact = self._exact(query, found)
        keep = np.lexsort((found, -exact))[:k]
        keep = keep[(exact[keep] > 0) & (exact[keep] >= least)]
        return found[keep], exact[keep], self.blocks - seen

    def _exact(self, query, found):
        size = self.begin[found + 1] - self.begin[found]
        where = _spans(self.begin[found], size)
        return np.bincount(np.repeat(np.arange(len(found)), size), query[self.slot[where]] * self.value[where], minlength=len(found))


@dataclass
class Index:
    """Where the parts lie, the idf of the slots, the prior and the calibrated curve."""

    paths: list[str]
    idf: np.ndarray
    k: int = NEAREST
    prior: float = 0.5
    curve: tuple[float, float] = (1.0, 0.0)
    skipped: int = 0  # blocks not opened by the last search in this process

    def parts(self):
        """The parts one at a time; a worker keeps those that fit into KEPT_BYTES."""
        held = resident("toxicity " + "".join(self.paths[:1]), dict)
        for path in self.paths:
            part = held.get(path)
            if part is None:
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place) as f:
                    part = Part.loads(f.read())
                if part.bytes + sum(p.bytes for p in held.values()) <= KEPT_BYTES:
                    held[path] = part
            yield part

    def vectors(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(t, weights(t, n, self.idf)) for t, n in bags(texts)]

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], skip=None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, labels, cosines) of each query's k nearest examples of positive cosine, ties to the lower number."""
        best = [(np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))] * len(queries)
        self.skipped = 0
        for part in self.parts():
            least = [float(c[-1]) if len(c) == self.k else 0.0 for _, _, c, _ in best]
            for i, (at, more, skipped) in enumerate(part.nearest(queries, self.k, least, skip or [-1] * len(queries))):
                self.skipped += skipped
                if len(at):
                    ids, y, c, number = best[i]
                    c, number = np.append(c, more), np.append(number, part.number[at])
                    keep = np.lexsort((number, -c))[: self.k]
                    best[i] = np.append(ids, part.ids[at])[keep], np.append(y, part.y[at])[keep], c[keep], number[keep]
        return [b[:3] for b in best]

    def vote(self, y: np.ndarray, cosine: np.ndarray) -> float:
        """Log odds of votes that weigh the inverse of the distance, with one pseudo vote shared as the prior says."""
        w = cosine / (1.05 - np.minimum(cosine, 1.0))
        yes = float((w * y).sum()) + self.prior
        no = float(w.sum()) + 1.0 - yes
        return float(np.log(max(yes, 1e-9) / max(no, 1e-9)))

    def probability(self, vote: float) -> float:
        a, b = self.curve
        return 1.0 / (1.0 + np.exp(-np.clip(a * vote + b, -30, 30)))


def platt(vote: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0) and offset of the logistic curve through the votes, by Newton steps with a small ridge."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x, ab = np.column_stack([vote, np.ones(len(vote))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t) + 1e-3 * (ab - np.array([1.0, 0.0])))
        ab = ab - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(ab[0]), 0.0), float(ab[1])


def fit(docs: DataFrame, labels: DataFrame, *, target: str = "toxic", bound: int = 5000, k: int = NEAREST, text: str = "text") -> Index:
    """The index of at most ``bound`` labelled documents that are not held out, calibrated by leaving each one out.

    Examples are numbered by the term that weighs most in them and by id, so that like ones share a block. Examples without any term
    are in no part and have the vote of no neighbours. Without labelled rows every score is 0.5.
    """
    spark = docs.sparkSession
    index = Index([], inverse_frequencies(docs, text), k)
    sample = labelled(docs, labels, target, bound=bound, text=text).select(F.col("id").cast("string").alias("id"), "text", "y")

    def vectors(batches):
        for b in batches:
            v = index.vectors(utf8(b.column(1)))
            lead = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in v]
            yield pa.record_batch({"id": b.column(0), "y": b.column(2), "lead": pa.array(lead, pa.int32()), "size": pa.array([len(t) for t, _ in v], pa.int64()),
                                   "slot": pa.array([t.astype(np.int32).tobytes() for t, _ in v], pa.binary()), "weight": pa.array([w.tobytes() for _, w in v], pa.binary())})

    place = scratch(spark, "toxicity-examples")
    in_batches(sample, vectors, "id string, y int, lead int, size long, slot binary, weight binary").write.parquet(place)
    held = spark.read.parquet(place)
    counts = held.agg(F.count(F.lit(1)), F.sum("y")).first()
    n, yes = counts[0], int(counts[1] or 0)
    if not n:
        return index
    index.prior = (yes + 0.5) / (n + 1.0)
    order = Window.orderBy("lead", "id")  # at most ``bound`` rows of three numbers and an id
    numbers = held.filter("size > 0").select("id", (F.row_number().over(order) - 1).cast("long").alias("number"), F.floor((F.sum("size").over(order) - F.col("size")) / POSTINGS).cast("int").alias("part"))
    rows = held.join(F.broadcast(numbers), "id")
    folder = scratch(spark, "toxicity-index")

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        pairs = [(np.frombuffer(s, np.int32).astype(np.int64), np.frombuffer(w, np.float64)) for s, w in zip(table.column("slot").to_pylist(), table.column("weight").to_pylist())]
        part = Part(table.column("number").to_numpy(), table.column("id").to_pylist(), table.column("y").to_numpy().astype(np.int64), pairs)
        path = f"{folder}/part-{table.column('part')[0].as_py():06d}"
        uri = path if ":" in path.split("/")[0] else f"file://{path}"
        store, at = fs.FileSystem.from_uri(uri)
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(at) as f:  # a retried task writes the same bytes
            f.write(part.dumps())
        return pa.table({"path": [uri]})

    index.paths = sorted(r.path for r in rows.groupBy("part").applyInArrow(build, "path string").collect())

    def left_out(batches):
        for b in batches:
            v = [(np.frombuffer(s, np.int32).astype(np.int64), np.frombuffer(w, np.float64)) for s, w in zip(b.column("slot").to_pylist(), b.column("weight").to_pylist())]
            found = index.nearest(v, b.column("number").to_pylist())
            yield pa.record_batch({"y": b.column("y"), "vote": pa.array([index.vote(y, c) for _, y, c in found], pa.float64())})

    tasks = min(n, 4 * spark.sparkContext.defaultParallelism)
    votes = in_batches(rows.select("slot", "weight", "number", "y").repartition(tasks), left_out, "y int, vote double", keeps=True).collect()
    bare = index.vote(np.zeros(0), np.zeros(0))
    bare_yes = yes - sum(r.y for r in votes)
    y = np.array([r.y for r in votes] + [1] * bare_yes + [0] * (n - len(votes) - bare_yes))
    index.curve = platt(np.array([r.vote for r in votes] + [bare] * (n - len(votes))), y)
    return index


def score(docs: DataFrame, index: Index, *, text: str = "text", cut_at: float = 0.5) -> DataFrame:
    """Add score, predicted (score >= cut_at) and evidence (the nearest examples: id, label, cosine), in place of such columns.

    A text without any of the index's terms (null and empty texts too) has no neighbours: its score is the calibrated prior.
    """
    docs = docs.drop("score", "predicted", "evidence")
    at, names = docs.columns.index(text), docs.columns
    kind = pa.list_(pa.struct([("id", pa.string()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def work(batches):
        for b in batches:
            near = index.nearest(index.vectors(utf8(b.column(at))))
            p = np.array([index.probability(index.vote(y, c)) for _, y, c in near], np.float64)
            evidence = [[{"id": i, "label": int(t), "cosine": float(s)} for i, t, s in zip(*x, strict=True)] for x in near]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64()), pa.array((p >= cut_at).astype(np.int32)), pa.array(evidence, kind)], names=[*names, "score", "predicted", "evidence"])

    return in_batches(docs, work, extended(docs, "score double, predicted int, evidence array<struct<id:string,label:int,cosine:double>>"), keeps=True)


def keep(docs: DataFrame, index: Index, *, text: str = "text", cut_at: float = 0.5) -> DataFrame:
    """The rows whose score is below ``cut_at``; columns as they came, whatever their names."""
    at = docs.columns.index(text)

    def work(batches):
        for b in batches:
            p = [index.probability(index.vote(y, c)) for _, y, c in index.nearest(index.vectors(utf8(b.column(at))))]
            yield b.filter(pa.array(np.array(p, np.float64) < cut_at))

    return in_batches(docs, work, docs.schema, keeps=True)


def classify(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row of ``docs``."""
    rows = docs.select("doc_id", "text")
    return score(rows, fit(rows, labels, **kw)).select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("evidence")
