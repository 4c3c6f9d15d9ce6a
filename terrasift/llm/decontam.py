"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items, one scan per text."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import extended, in_batches, resident
from terrasift.session import cut

#: A-Z to a-z; ASCII letters, digits and all bytes of other characters stay; other ASCII bytes become a space.
NORMAL = bytes((i + 32 if 65 <= i <= 90 else i) if 48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


def windows(text: str | None, size: int) -> set[bytes]:
    """All runs of ``size`` words, joined by a space; a shorter text that has words is one window."""
    w = words(text)
    if not w:
        return set()
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def automaton(key: str, items: list[tuple[str, str]], size: int):
    """Automaton over the windows, each with a space on either side; kept by the worker for the last ``key``."""

    def make():
        import ahocorasick

        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            for w in windows(text, size):
                owners.setdefault(w, set()).add(item)
        a = ahocorasick.Automaton()
        for w, own in owners.items():
            a.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, sorted(own)))
        if owners:
            a.make_automaton()
        return a

    return resident(f"windows {key}", make)


def find(a, text: str | None) -> tuple[int, list[tuple[int, int, list[str]]]]:
    """Number of words of a text, and (first word, end word, items) of each window that occurs in it."""
    w = words(text)
    if not w or not len(a):
        return len(w), []
    line = f" {b' '.join(w).decode('latin-1')} "
    found, starts = [], None
    for end, (n, items) in a.iter(line):
        if starts is None:
            starts = np.cumsum([0] + [len(x) + 1 for x in w]).tolist()  # of the space before each word
        last = bisect_left(starts, end)  # words up to the space at ``end``
        found.append((last - n, last, items))
    return len(w), found


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of ranges of words: each byte keeps its place in normalisation."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(NORMAL))]
    size = lambda b: len(raw[:b].decode("utf-8", "surrogatepass"))
    return [(size(at[a][0]), size(at[b - 1][1])) for a, b in ranges]


def merged(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def annotate(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, shard_bytes: int = 16 << 20) -> DataFrame:
    """Add n_words, hits (array of word ranges with their items) and spans (character ranges of the original text).

    The items' bytes are counted first. Up to ``shard_bytes`` they make one automaton; beyond, items are dealt by a hash
    into shards of that size and the documents pass one automaton after another, each adding its hits, with a checkpoint
    between. Null and wordless texts have no words; items without words have no windows; items with a null id are ignored.
    Ranges of ``hits`` overlap where windows do; ``spans`` are merged.
    """
    spark = docs.sparkSession
    src = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    total = src.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    out = docs.drop("n_words", "hits", "spans").withColumn("hits", F.expr("CAST(array() AS array<struct<a:int,b:int,item:string>>)"))
    for s in range(shards):
        rows = [(r.item, r.text) for r in src.filter(F.expr(f"pmod(xxhash64(item), {shards})") == s).collect()]
        out = _pass(cut(out) if s else out, spark.sparkContext.broadcast(rows), text, size, last=s == shards - 1)
    return out


def _pass(docs: DataFrame, shared, text: str, size: int, last: bool) -> DataFrame:
    hit = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("item", pa.string())]))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    names = docs.columns
    key = hashlib.sha1(repr(sorted(shared.value)).encode("utf-8", "surrogatepass")).hexdigest() + str(size)

    def work(batches):
        a = automaton(key, shared.value, size)
        for b in batches:
            texts, hits = b.column(names.index(text)).to_pylist(), b.column(names.index("hits")).to_pylist()
            n, spans = [], []
            for i, t in enumerate(texts):
                count, found = find(a, t)
                hits[i] = [*hits[i], *({"a": x, "b": y, "item": o} for x, y, own in found for o in own)]
                n.append(count)
                ranges = merged((h["a"], h["b"]) for h in hits[i]) if last and hits[i] else []
                spans.append([{"start": x, "end": y} for x, y in original_spans(t, ranges)] if ranges else [])
            cols = [pa.array(hits, hit) if c == "hits" else b.column(j) for j, c in enumerate(names)]
            if last:
                cols += [pa.array(n, pa.int64()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(cols, names=names + (["n_words", "spans"] if last else []))

    return in_batches(docs, work, extended(docs, "n_words long, spans array<struct<start:int,end:int>>") if last else docs.schema, keeps=True)


def summary(annotated: DataFrame) -> DataFrame:
    """n_hit (words inside any window), n_items, the items' digest and the decision per document."""
    covered = F.expr("""aggregate(array_sort(transform(hits, h -> struct(h.a AS a, h.b AS b))), struct(0 AS n, 0 AS reach),
        (s, h) -> struct(s.n + greatest(0, h.b - greatest(h.a, s.reach)) AS n, greatest(s.reach, h.b) AS reach), s -> CAST(s.n AS long))""")
    items = F.array_sort(F.array_distinct(F.col("hits.item")))
    return annotated.withColumn("__items", items).withColumn("n_hit", covered).withColumns({
        "n_items": F.size("__items").cast("long"), "items_sha256": F.sha2(F.array_join("__items", ",").cast("binary"), 256), "contaminated": F.col("n_hit") > 0}).drop("__items")


def clean(docs: DataFrame, items: DataFrame, *, most: float = 0.0, text: str = "text", **kw) -> DataFrame:
    """The documents with at most the share ``most`` of their words inside windows; columns as they came, whatever their names."""
    held = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    return summary(annotate(held, items, **kw)).filter(F.col("n_hit") <= most * F.col("n_words")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = summary(annotate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""WITH norm AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM norm),
win AS (SELECT DISTINCT CAST(id AS VARCHAR) AS item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
 FROM (SELECT id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM w WHERE kind = 'b' AND len(w) > 0)),
pos AS (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM win) WHERE kind = 'd' AND len(w) >= n),
hit AS (SELECT p.id, p.i, p.n, win.item FROM (SELECT id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM pos) p JOIN win ON p.n = win.n AND p.s = win.s),
words AS (SELECT id, count(DISTINCT k) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY id),
items AS (SELECT id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY id)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
 sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (id) LEFT JOIN items USING (id) WHERE kind = 'd'"""
