"""Exact top-k, decontamination and archives against plain versions of their definitions."""

import hashlib
import math
import random
import re

import pytest

from terrasift.llm import decontam, topk, warc


def top_plain(rows, every, k):
    v = {}
    for i, x in rows:
        if x is not None and all(c is not None and math.isfinite(c) for c in x) and i is not None:
            v.setdefault(i, []).append([math.floor(1024 * c) for c in x])
    flat = [(i, x) for i, xs in v.items() for x in xs]
    out = []
    for i, q in flat:
        if i % every == 0:
            s = sorted(((-sum(a * b for a, b in zip(q, x)), j) for j, x in flat if j != i and len(x) == len(q)))[:k]
            out += [(i, r + 1, j, -n) for r, (n, j) in enumerate(s)]
    return sorted(out)


def test_top_k_matches_all_products(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-0.5, 0.5) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(150)]  # a hot vector, so many ties
    rows += [(900, None), (901, [0.1] * 5 + [float("nan")]), (902, [0.1] * 5 + [None]), (903, [float("inf")] * 6), (904, []), (905, [0.5, 0.25]), (910, [0.0] * 6), (None, [0.1] * 6)]
    df = spark.createDataFrame([(i, x, "a") for i, x in rows], "vec_id long, embedding array<double>, score string")
    data = topk.quantised(df)
    got = topk.top_k(data, data.filter("vec_id % 10 = 0"), 5, pivots=8, groups=3, probe=40, group_rows=7, part_rows=90)
    assert sorted(tuple(r) for r in got.collect()) == top_plain(rows, 10, 5)


def test_top_k_of_few_rows_and_large_values(spark):
    rows = [(0, [3e9, 1.0]), (1, [-2e9, 5.0]), (2, [1e3, 1e3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    data = topk.quantised(df, scale=1.0)
    got = sorted(tuple(r) for r in topk.top_k(data, data.filter("vec_id = 0"), 10).collect())
    assert got == [(0, 1, 2, 3 * 10**12 + 1000), (0, 2, 1, -6 * 10**18 + 5)]
    none = topk.quantised(df.filter("vec_id > 5"))
    assert topk.top_k(none, none, 3).collect() == []


def hits_plain(text, items, size=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, own = split(text), set(), set()
    for i, t in items:
        x = split(t)
        for a in range(max(1, len(x) - size + 1)) if x else ():
            p = x[a : a + size]
            for b in range(len(w) - len(p) + 1):
                if w[b : b + len(p)] == p:
                    hit |= set(range(b, b + len(p)))
                    own.add(str(i))
    return len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()


ITEMS = [(1, "One two three four five six seven eight nine ten, eleven! Twelve"), (2, "shörter item"), (10, "Shörter  ITEM"), (3, "..."), (4, None), (5, "a a a a a a a a a a a a"), (None, "one two"), (6, "q" * 3000 + " end")]
TEXTS = [None, "", "  ...  ", "one two three four five six seven eight nine ten", "x ONE-two three:four five six\nseven eight nine ten eleven twelve y", "a " * 40, "É shörter\titem; tshörter item", "ｓ shörter itemé 漢 shörter item",
         "q" * 3000 + " END of it", "one two three " * 500 + "one two three four five six seven eight nine ten eleven", "two three four five six seven eight nine"]


@pytest.mark.parametrize("shard", [1 << 20, 120])
def test_decontamination_matches_windows(spark, shard):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], 0)], "doc_id long, text string, n_words long")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontam.summary(decontam.annotate(docs, items, shard_bytes=shard)).collect()
    assert len(out) == len(TEXTS) + 1
    for r in out:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == hits_plain(TEXTS[r.doc_id], [x for x in ITEMS if x[0] is not None]), r.doc_id
        assert r.contaminated == (r.n_hit > 0)
        text = TEXTS[r.doc_id]
        if r.spans:  # the spans of the original hold the words that are hit
            assert sum(len(decontam.words(text[s.start : s.end])) for s in r.spans) == r.n_hit


def test_decontamination_without_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.summary(decontam.annotate(docs, items)).first().contaminated is False
    assert decontam.clean(docs.filter("false"), items).columns == ["doc_id", "text"]
    hits = spark.createDataFrame([(1, "a b", "x"), (2, "c", "y")], "doc_id long, text string, hits string")
    assert [tuple(r) for r in decontam.clean(hits, spark.createDataFrame([(1, "A, b")], items.schema)).collect()] == [(2, "c", "y")]


PAGES = [(1, "http://a.example/x y\n", "<p>é</p>"), (2, None, None), (3, "http://a.example/2", ""), (4, "http://b.example/", "<p>é</p>"), (5, "u", "<p>same\r\n\r\n</p>" * 50), (None, "n", "<p>é</p>"), (6, "u6", "x" * 400_000), (4, "http://b.example/", "<p>é</p>")]


def test_archives_round_trip(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumnRenamed("x", "y")
    files = warc.write(df, str(tmp_path / "a"), shard_bytes=500, file_bytes=200)
    assert files.count() > 3 and files.filter("records < 1").isEmpty()
    got = warc.read(spark, str(tmp_path / "a")).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == sorted((str(i), len((h or "").encode()), warc.digest((h or "").encode())) for i, _, h in PAGES)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds == [(0, "revisit", 4), (1, "revisit", 4), (2, "revisit", 3), (3, "response", None), (4, "response", None), (4, "revisit", 4), (5, "response", None), (6, "response", None)]
    assert {r.html for r in got if r.record_type == "response"} == {(h or "") for _, _, h in PAGES}
    # the same rows in other partitions give the same bytes
    again = warc.write(df.repartition(5, "html"), str(tmp_path / "b"), shard_bytes=500, file_bytes=200)
    assert sorted(map(tuple, files.collect())) == sorted(map(tuple, again.collect()))
    assert not list((tmp_path / "a" / "_temporary").iterdir())


def test_damaged_archives_are_refused(spark, tmp_path):
    df = spark.createDataFrame(PAGES[:1], "page_id long, url string, html string")
    name = warc.write(df, str(tmp_path / "a")).first().name
    path = tmp_path / "a" / name
    path.write_bytes(path.read_bytes() + b"\0")
    with pytest.raises(Exception, match="differs from the manifest"):
        warc.read(spark, str(tmp_path / "a")).collect()
    assert warc.read(spark, str(tmp_path / "e")).count() == 0 if warc.write(df.filter("false"), str(tmp_path / "e")).count() == 0 else False
