"""MinHash near-duplicates: universal hash minima in bands, sketches, exact confirmation on full sets, connected components.

Exact copies are folded to one class first, so only different texts meet in a band. In every band bucket each class is paired
with the bucket's hub alone (a star), never with all others. Stars are confirmed on the full shingle sets; only buckets whose
classes are still in different components afterwards are paired across components. So no link that could join two components
is left out, and no pairs are built inside a component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import class_table, extended, free, hashed_words, in_batches, lower, mix, utf8
from terrasift.llm.graph import components
from terrasift.session import cut

BANDS, ROWS = 32, 5  # a pair of similarity 0.8 shares no band with probability 3e-6
#: A sketch has four bits of each minimum. At similarity 0.8, 130 of the 160 are equal in the mean with a deviation of 4.9, so
#: 55 that differ are five deviations off.
SKETCH_LONGS, SKETCH_DIFFER = BANDS * ROWS // 16, 55
#: Classes that are still apart in a bucket get one bit of each of 2048 further minima: at 0.8, 1843 bits are equal in the mean
#: with a deviation of 13.6, so 273 that differ are five deviations off.
FINE, FINE_DIFFER = 2048, 273
#: Everything but ASCII white space makes words.
WORDS = class_table(lambda b: 0 if b == 32 or 9 <= b <= 13 else 1)
SMALL = 100_000  # classes of 24 bytes that may be broadcast; more are joined by a shuffle
_SEEDS = mix(np.arange(1, 2 * (BANDS * ROWS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A, _B = _SEEDS[: BANDS * ROWS] | np.uint64(1), _SEEDS[BANDS * ROWS :]


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words make one run, none make none."""
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    out = np.full(n, 0x2545F4914F6CDD1D, np.uint64)
    for j in range(min(size, len(h))):
        out = mix(out + h[j : j + n])
    return np.unique(out)


def signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, sketch as ten longs) of a shingle set."""
    x = s >> np.uint64(32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 512):
        v = x[at : at + 512, None] * _A
        v += _B
        np.minimum(least, v.min(axis=0), out=least)
    least >>= np.uint64(32)
    band = least.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key + band[:, j])
    return key.view(np.int64), _sketch(least)


def _sketch(least: np.ndarray) -> np.ndarray:
    four = (mix(least + np.uint64(77)) & np.uint64(15)).reshape(SKETCH_LONGS, 16)
    return (four << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def fine_sketch(s: np.ndarray) -> np.ndarray:
    """32 longs of single bits of minima, by 32-bit linear permutations of the hashes."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    seeds = mix(np.arange(1, 2 * FINE + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).astype(np.uint32)
    a, b = seeds[:FINE] | np.uint32(1), seeds[FINE:]
    least = np.full(FINE, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 128):
        v = x[at : at + 128, None] * a
        v += b
        np.minimum(least, v.min(axis=0), out=least)
    bit = (mix(least.astype(np.uint64) + (a.astype(np.uint64) << np.uint64(32))) & np.uint64(1)).reshape(FINE // 64, 64)
    return (bit << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def sets(texts: list[bytes], size: int):
    """(digest of the word sequence, shingle set) of each text."""
    for t in texts:
        low = lower(t)
        h, _ = hashed_words([low], WORDS)
        yield (hashlib.blake2b(b" ".join(low.split()), digest_size=16).digest() if len(h) else b""), shingles(h, size)


def signatures(docs: DataFrame, size: int, text: str, id: str) -> DataFrame:
    """(doc_id, cls, n, bands, sketch) per row: cls is a 128-bit digest of the words, empty for a text without words."""

    def work(batches):
        for b in batches:
            cls, n, bands, sketches = [], [], [], []
            for c, s in sets(utf8(b.column(1)), size):
                k, sk = signature(s) if len(s) else (s.view(np.int64), s.view(np.int64))
                cls.append(c)
                n.append(len(s))
                bands.append(k)
                sketches.append(sk)
            yield pa.record_batch({"doc_id": b.column(0), "cls": pa.array(cls, pa.binary()), "n": pa.array(n, pa.int64()),
                                   "bands": pa.array(bands, pa.list_(pa.int64())), "sketch": pa.array(sketches, pa.list_(pa.int64()))})

    return in_batches(docs.select(F.col(id).cast("long").alias("doc_id"), text), work, "doc_id long, cls binary, n long, bands array<long>, sketch array<long>")


def _finely_alike(a: str, b: str):
    differ = (F.bit_count(F.col(f"{a}.fine")[i].bitwiseXOR(F.col(f"{b}.fine")[i])) for i in range(FINE // 64))
    return (5 * F.least(f"{a}.n", f"{b}.n") >= 4 * F.greatest(f"{a}.n", f"{b}.n")) & (sum(differ, F.lit(0)) <= FINE_DIFFER)


def _first_common(a: str, b: str):
    """The bucket in hand is the least of the pair's common ones, so that each pair is made once."""
    return F.array_min(F.array_intersect(f"{a}.bands", f"{b}.bands")) == F.col(f"{a}.key")


def _alike(a: str, b: str):
    """Pairs that can reach the similarity: sizes near enough and, by the sketches, most minima equal."""

    def differ(i):
        x = F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])
        for shift in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    return (5 * F.least(f"{a}.n", f"{b}.n") >= 4 * F.greatest(f"{a}.n", f"{b}.n")) & (sum((differ(i) for i in range(SKETCH_LONGS)), F.lit(0)) <= SKETCH_DIFFER)


class _Sets:
    """Full shingle sets of classes, from the texts of their representatives, and what follows from them."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, text: str, id: str, percent: int):
        self.docs, self.classes, self.size, self.text, self.id, self.percent = docs, classes, size, text, id, percent

    def of(self, cls: DataFrame, made, name: str) -> DataFrame:
        """(cls, name array<long>): ``made`` of the shingle set of each class."""
        size = self.size

        def work(batches):
            for b in batches:
                want, got = b.column(0).to_pylist(), list(sets(utf8(b.column(1)), size))
                at = [i for i, (c, _) in enumerate(got) if c == want[i]]
                yield pa.record_batch({"cls": pa.array([want[i] for i in at], pa.binary()), name: pa.array([made(got[i][1]) for i in at], pa.list_(pa.int64()))})

        need = cut(cls.distinct().join(self.classes.select("cls", "doc_id"), "cls"))
        if need.count() <= SMALL:
            need = F.broadcast(need)
        text = self.docs.select(F.col(self.id).cast("long").alias("__id"), F.col(self.text).alias("text"))
        rows = text.join(need, F.col("__id").eqNullSafe(F.col("doc_id"))).select("cls", "text")
        return cut(in_batches(rows, work, f"cls binary, {name} array<long>").dropDuplicates(["cls"]))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) with 100 * intersection >= percent * union."""
        pairs = cut(pairs)
        full = self.of(pairs.select(F.col("u").alias("cls")).union(pairs.select("v")), lambda s: s.view(np.int64), "items")
        both = pairs.join(full.select(F.col("cls").alias("u"), F.col("items").alias("a")), "u").join(full.select(F.col("cls").alias("v"), F.col("items").alias("b")), "v")
        same = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("i"), (F.size("a") + F.size("b")).alias("t"))
        return same.filter(100 * F.col("i") >= self.percent * (F.col("t") - F.col("i"))).select("u", "v")


def groups(docs: DataFrame, *, size: int = 5, percent: int = 80, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, cls, n_shingles, component_id, kept) for every row.

    component_id is the least id that can be reached over links of at least ``percent``; texts without words (null and empty
    too) are linked with nothing. Rows that repeat an id are rows of their own and share the component of their text. Null ids
    are no component ids: a component without any id has a null one, and its rows are kept. The bands and both sketches are laid out
    for a similarity of 0.8, so a lower ``percent`` is refused.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    sig = cut(signatures(docs, size, text, id))
    classes = cut(sig.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    keyed = classes.select("cls", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = cut(keyed.join(buckets, "key").select("key", "cls", "c"))
    facts = classes.select("cls", "n", "sketch")
    star = _stars(shared, facts)
    tested = star.select("u", "v").distinct()
    first = star.groupBy("cls").agg(F.max(F.struct("w", "u", "v")).alias("p")).select("p.u", "p.v").distinct()
    confirm = _Sets(docs, classes, size, text, id, percent)
    comp = cut(components(confirm.links(first)))
    free(docs.sparkSession)
    # the other stars, and then pairs across what is still apart in a bucket
    comp = _joined(comp, confirm.links(_apart(tested.join(first, ["u", "v"], "left_anti"), comp)))
    free(docs.sparkSession)
    comp = _joined(comp, confirm.links(_across(shared, comp, facts, tested, confirm)))
    return _labelled(sig, classes, comp)


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: those between the roots are enough, and nothing is done if there are none."""
    more = cut(_rooted(links, comp).filter("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct())
    if more.isEmpty():
        return comp
    top = cut(components(more)).withColumnsRenamed({"node": "old", "root": "new"})
    old = comp.unionByName(top.select(F.col("old").alias("node"), F.col("old").alias("root"))).distinct()
    return cut(old.join(top, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")))


def _stars(shared: DataFrame, facts: DataFrame) -> DataFrame:
    """(cls, u, v, w): each class paired, in each of its buckets, with the bucket's hub, as far as the pair can be alike.

    The hub is the class with the fullest buckets overall (w), so of a text and its edited copies the text they came from.
    """
    weight = shared.groupBy("cls").agg(F.sum("c").alias("w"))
    member = cut(shared.join(weight, "cls").select("key", "cls", "w"))
    hub = member.groupBy("key").agg(F.max(F.struct("w", "cls")).alias("h")).select("key", F.col("h.w").alias("w"), F.col("h.cls").alias("hub"))
    pairs = member.drop("w").join(hub, "key").filter("cls <> hub").select("cls", "hub", "w").distinct()
    a, b = facts.alias("a"), facts.alias("b")
    near = pairs.withColumnRenamed("cls", "own").join(a, F.col("own") == F.col("a.cls")).join(b, F.col("hub") == F.col("b.cls"))
    return cut(near.filter(_alike("a", "b")).select(F.col("own").alias("cls"), F.least("own", "hub").alias("u"), F.greatest("own", "hub").alias("v"), "w"))


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    return _rooted(pairs, comp).filter("ru <> rv").select("u", "v")


def _rooted(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs with the roots of both ends; a class in no component is its own root."""
    ru, rv = comp.select(F.col("node").alias("u"), F.col("root").alias("ru")), comp.select(F.col("node").alias("v"), F.col("root").alias("rv"))
    return pairs.join(ru, "u", "left").join(rv, "v", "left").select("u", "v", F.coalesce("ru", "u").alias("ru"), F.coalesce("rv", "v").alias("rv"))


def _across(shared: DataFrame, comp: DataFrame, facts: DataFrame, tested: DataFrame, full: _Sets) -> DataFrame:
    """Untested pairs of classes that share a bucket, are in different components and are alike by their fine sketches."""
    member = shared.join(comp.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = member.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c")).filter("lo <> hi AND c > 2").select("key")
    m = cut(member.join(mixed, "key").select("key", "cls", "root"))
    fine = full.of(m.select("cls"), fine_sketch, "fine").join(full.classes.select("cls", "n", "bands"), "cls")
    m = cut(m.join(fine, "cls"))
    a, b = m.alias("a"), m.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.cls") < F.col("b.cls")) & (F.col("a.root") != F.col("b.root")) & _finely_alike("a", "b") & _first_common("a", "b"))
    pairs = pairs.select(F.col("a.cls").alias("u"), F.col("b.cls").alias("v"))
    return pairs.join(tested, ["u", "v"], "left_anti")


def _labelled(sig: DataFrame, classes: DataFrame, comp: DataFrame) -> DataFrame:
    of = classes.select("cls", "doc_id").join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = of.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    names = of.select("cls", "root").join(least, "root").select("cls", "component_id")
    out = sig.select("doc_id", "cls", "n").join(names, "cls", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "cls", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _with_class(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``__cls``, the digest of the words that ``groups`` goes by."""
    at, names = docs.columns.index(text), docs.columns

    def work(batches):
        for b in batches:
            cls = [hashlib.blake2b(w, digest_size=16).digest() if (w := b" ".join(lower(t).split())) else b"" for t in utf8(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cls, pa.binary())], names=[*names, "__cls"])

    return in_batches(docs, work, extended(docs, "__cls binary"))


def keep_one(docs: DataFrame, *, text: str = "text", id: str = "doc_id", **kw) -> DataFrame:
    """One document of each group, the one with the least id, with its columns.

    Texts without words are linked with nothing, so all such rows stay. Of rows that repeat id and words one stays; rows that repeat an
    id with other words stay or go by their own group. Of rows without an id, those in a group with an id go, and of the others one
    stays for each sequence of words.
    """
    g = cut(groups(docs, text=text, id=id, **kw).select(F.col("doc_id").alias("__id"), F.col("cls").alias("__cls"), "n_shingles", "kept"))
    odd = cut(g.filter("__id IS NOT NULL").groupBy("__id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("__id"))
    once = g.filter("kept AND __id IS NOT NULL").select("__id").join(odd, "__id", "left_anti")
    key = F.col(id).cast("long") == F.col("__id")
    some = docs.join(once, key, "left_semi").select(*docs.columns)
    if odd.isEmpty() and g.filter("__id IS NULL").isEmpty():
        return some
    rest = cut(_with_class(docs.filter(F.col(id).isNull()).unionByName(docs.join(odd, key, "left_semi")), text))
    kept = g.filter("kept").select(F.col("__id").alias("__i"), F.col("__cls").alias("__c")).distinct()
    stay = rest.join(kept, F.col(id).cast("long").eqNullSafe(F.col("__i")) & (F.col("__cls") == F.col("__c")), "left_semi")
    words = stay.filter(F.length("__cls") > 0).dropDuplicates([id, "__cls"])
    return some.unionByName(words.unionByName(stay.filter(F.length("__cls") == 0)).select(*docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4).drop("cls")


SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 3], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
rare AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM (SELECT g.* FROM g JOIN rare USING (s)) a JOIN (SELECT g.* FROM g JOIN rare USING (s)) b ON a.s = b.s AND a.doc_id <> b.doc_id
 JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n"""
