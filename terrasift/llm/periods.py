"""Periodic runs of words by an online sparse diagonal DP, and texts with every run collapsed to its first period.

A text is read once, word by word. Each earlier occurrence of the word at hand stands on a diagonal, the lag between the two; a
diagonal that matched up to the word before grows by one, and one that does not go on ends and emits its run at once if it is
long enough. A run of ``least`` words or more has some least number of matches in a row (16 for 24 words and three periods), so
an occurrence counts once the words before it agree that far: occurrences are looked up by hashed stretches of that many words,
and only where the word before differs, since all others are on their diagonal already.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm.audit import words
from terrasift.llm.common import _powers, chunks, class_table, extended, hashed_words, in_batches, mix, utf8

LEAST, POWER = 24, 3
WORDS = class_table(lambda b: 0 if b == 32 or 9 <= b <= 13 else 1)
_RUNS = "n_words long, n_runs long, runs array<struct<start:long,length:long,period:long>>, strongest struct<start:long,length:long,period:long>, collapsed string"


def reach(least: int, power: int) -> int:
    """The fewest matches in a row that a run has: length less period, at its least over all periods."""
    short = least // power
    return min(least - short if short else power - 1, (power - 1) * (short + 1))


def stretches(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that end at each place from size - 1 on."""
    up, down = _powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h) * up[: len(h)], out=total[1:])
    n = len(h) - size + 1
    return mix((total[size:] - total[:n]) * down[:n])


def _factors(q: int) -> list[int]:
    out, d = [], 2
    while d * d <= q:
        if q % d == 0:
            out.append(d)
            while q % d == 0:
                q //= d
        d += 1
    return out + [q] if q > 1 else out


def _smaller_period(w: np.ndarray, start: int, end: int, q: int) -> bool:
    """Whether the stretch repeats with a part of q; a smaller period of three repeats always divides q."""
    return any(np.array_equal(w[start + q // f : end], w[start : end - q // f]) for f in _factors(q))


def find_runs(w: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the word codes, by start and period.

    Inside a run of period q that has all its repeats, occurrences a multiple of q back are left out: such a diagonal begins and ends with the run
    and has no smallest period of its own. Occurrences so far back that the rest of the text is too short are left out too.
    """
    size, n = reach(least, power), len(w)
    if n < least:
        return []
    key = stretches(w, size)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(key), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    live = np.flatnonzero(again)
    if not len(live):
        return []
    out: list[tuple[int, int, int]] = []
    seen: dict[int, dict[int, list[int]]] = {}
    before = [-1, *np.unique(w, return_inverse=True)[1].tolist()]  # the word before each stretch; -1: the text begins
    lags = first = np.zeros(0, np.int64)

    def ended(q: np.ndarray, a: np.ndarray, end: int) -> None:
        length = end - a + q
        for i in np.flatnonzero((length >= least) & (length >= power * q)):
            start, period = int(a[i] - q[i]), int(q[i])
            if not _smaller_period(w, start, end, period):
                out.append((start, int(length[i]), period))

    last = -1
    for at, k in zip(live.tolist(), key[live].tolist()):
        i = at + size - 1
        if len(lags):
            if at != last + 1:  # in between, a stretch without another occurrence ended all diagonals
                ended(lags, first, last + size)
                lags = first = lags[:0]
            else:
                on = w[i - lags] == w[i]
                if not on.all():
                    ended(lags[~on], first[~on], i)
                    lags, first = lags[on], first[on]
        last = at
        places = seen.setdefault(k, {})
        b = before[at]
        new = [j for v, js in places.items() if v != b for j in js]
        places.setdefault(b, []).append(at)
        if not new:
            continue
        new = at - np.array(new, np.int64)
        new = new[(n - at >= (power - 1) * new) & (n - at + new >= least)]
        if len(new) and len(lags):
            ripe = np.flatnonzero(i - first + 1 >= (power - 1) * lags)
            if len(ripe):
                r = ripe[np.argmin(lags[ripe])]
                new = new[(new % lags[r] != 0) | (at - new < first[r] - lags[r])]
        if len(new):
            lags = np.concatenate([lags, new])
            first = np.concatenate([first, np.full(len(new), at)])
    ended(lags, first, last + size)
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for each word that no run holds behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with most periods by the exact quotient, ties to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def collapse(docs: DataFrame, *, text: str = "text", least: int = LEAST, power: int = POWER) -> DataFrame:
    """Add n_words, n_runs, runs, strongest and collapsed (the kept words joined by one space), in place of such columns.

    A run is a stretch of at least max(``least``, ``power`` * q) words whose smallest period is q and that no neighbouring word extends.
    A null or empty text, or one of white space, has no words, no runs and an empty collapsed text. Every row is handled alone, so
    repeated rows, repeated and null ids change nothing. Words are compared by 64-bit hashes.
    """
    docs = docs.drop("n_words", "n_runs", "runs", "strongest", "collapsed")
    at, names = docs.columns.index(text), docs.columns
    one = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    size = reach(least, power)

    def work(batches):
        for b in batches:
            texts = utf8(b.column(at))
            n, found, short = [], [], []
            for x, y in chunks(texts):
                h, begin = hashed_words(texts[x:y], WORDS)
                some = _may_repeat(h, begin, size)
                for i in range(y - x):
                    w = h[begin[i] : begin[i + 1]]
                    runs = find_runs(w, least, power) if some[i] else []
                    part = texts[x + i].split()
                    if runs:
                        part = [part[j] for j in np.flatnonzero(kept_words(len(w), runs))]
                    n.append(len(w))
                    found.append(runs)
                    short.append(b" ".join(part))
            row = lambda r: r and dict(zip(("start", "length", "period"), r))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(list(map(len, found)), pa.int64()), pa.array([[row(r) for r in rs] for rs in found], pa.list_(one)),
                                              pa.array([row(strongest(rs)) for rs in found], one), pa.array(short, pa.binary()).cast(pa.string())], names=[*names, "n_words", "n_runs", "runs", "strongest", "collapsed"])

    return in_batches(docs, work, extended(docs, _RUNS))


def _may_repeat(h: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """The texts in which some stretch of ``size`` words occurs twice."""
    some = np.zeros(len(begin) - 1, bool)
    if len(h) < size:
        return some
    key = stretches(h, size)
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    own = doc[: len(key)]
    inside = own == doc[size - 1 :]
    own = own[inside]
    k = np.sort(mix(key[inside] + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    double = k[1:][k[1:] == k[:-1]]
    if len(double):
        hit = np.isin(mix(key[inside] + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), double)
        some[own[hit]] = True
    return some


def periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every text whose crc32(doc_id) ends in 0 goes over into a repeating part of its own, as the contract says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = F.when(h % 10 == 0, words(F.col("text")))
    rows = docs.select("doc_id", "text", w.alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.expr("CAST(IF(n > 0, g % n, 0) AS INT)"))
    rows = rows.withColumn("p", F.expr("CAST(1 + (n - a) DIV (3 + g % 8) AS INT)"))
    tail = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), CAST((n - a + p - 1) DIV p AS INT))), 1, n - a)")
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.expr("slice(w, 1, a)"), tail), " ")).otherwise(F.col("text")).alias("text"))


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns from those of ``collapse``."""
    lines: Column = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    best = [F.col(f"strongest.{c}").alias(c) for c in ("start", "length", "period")]
    return rows.select("doc_id", "n_runs", *best, F.expr("1000 * strongest.length DIV strongest.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return digest(collapse(periodic(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))))


SQL = r"""WITH t AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
 xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM documents, t),
a AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM d),
w AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) ELSE i END]) ELSE w END AS w FROM a),
g AS (SELECT doc_id, i, hash(array_to_string(w[i - 14 : i + 1], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(15, n)) AS i FROM w WHERE n >= 24)),
q AS (SELECT x.doc_id, x.i, x.i - y.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i > y.i),
s AS (SELECT doc_id, q, min(i) - 15 - q AS start, count(*) + 15 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM q) GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
o AS (SELECT * FROM r ANTI JOIN r AS z ON z.doc_id = r.doc_id AND (z.length * r.period > r.length * z.period OR z.length * r.period = r.length * z.period AND (z.start, z.period) < (r.start, r.period))),
x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS v, unnest(range(n)) AS i FROM w) ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, o.start::BIGINT AS start, o.length::BIGINT AS length, o.period::BIGINT AS period, (1000 * o.length // o.period)::BIGINT AS exponent_milli,
 sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN o ON o.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id"""
