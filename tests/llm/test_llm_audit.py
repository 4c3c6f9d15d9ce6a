"""The filter audit against a run of every order, row by row."""

import re
from collections import Counter
from itertools import permutations

from terrasift.llm import audit

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = " ".join(f"w{i}" for i in range(60))
DOCS = [
    (1, WORDS, "a"), (2, WORDS, "a"), (3, WORDS.upper(), "b"), (4, "few words", "b"), (5, None, None), (6, "", None), (6, "", None), (7, "x " * 80, "a"),
    (8, WORDS + " #", "b"), (None, WORDS, "a"), (None, "few words", None), (9, "é漢 |" + "\x1c" * 60, ""), (10, "a\x0bb\tc\n" * 30, "a"), (11, "few words", "c"), (12, WORDS + " é", "only clean"),
    (1, WORDS + " other", "a"), (13, "B" * 200_000, "b"),
]
LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, None), (3, 0, 1), (4, 1, 1), (None, 1, 1), (7, None, None), (8, 1, 0), (11, 0, 0)]


def fails(i, t, docs):
    t = t or ""
    w = SPACE.findall(t)
    return {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": bool(set(t) & set("#$%&*|")),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}


def plain(docs, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    rows = [(s or "", fails(i, t, docs), i in good, i in toxic) for i, t, s in docs]
    out, total = {}, Counter()
    for p in permutations("ABCDE"):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(p, 1):
                gone = [r for r in left if r[1][f]]
                own = [r for r in rows if r[0] == part and r[1][f]]
                left = [r for r in left if not r[1][f]]
                total[part, f] += len(gone)
                out[part, "".join(p), step] = (len(left), len(gone), len(own) - len(gone), sum(sum(r[1].values()) == 1 for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def tables(spark, docs=DOCS, labels=LABELS):
    d = spark.createDataFrame([(*r, 7, True) for r in docs], "doc_id long, text string, source string, kept int, good boolean").repartition(3)
    return d, spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")


def test_every_order_matches_a_plain_run(spark):
    got = audit.audit(*audit.relations(*tables(spark)))
    want = plain(DOCS, LABELS)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()} == want
    assert got.count() == len(want) == 5 * 120 * len({s or "" for _, _, s in DOCS})


def test_no_rows_no_labels_and_nothing_failing(spark):
    docs, labels = tables(spark)
    assert audit.audit(*audit.relations(docs.filter("false"), labels)).count() == 0
    none = audit.audit(*audit.relations(docs, labels.filter("false")))
    assert none.selectExpr("sum(good_lost) + sum(toxic_lost) AS n").first().n == 0
    ids, failing = audit.relations(docs.filter("doc_id = 12"), labels)
    assert [f.count() for f in failing.values()] == [0] * 5
    assert {tuple(r)[3:] for r in audit.audit(ids, failing).collect()} == {(1, 0, 0, 0, 0, 0, 0)}


def test_other_relations(spark):
    """Three relations of one's own: the audit is not tied to the five text filters."""
    ids = spark.range(30).selectExpr("id AS rid", "'p' AS part", "id % 2 = 0 AS good", "id % 3 = 0 AS toxic")
    of = lambda c: spark.range(30).filter(c).selectExpr("id AS rid")
    rows = audit.audit(ids, {"X": of("id < 10"), "Y": of("id >= 5 AND id < 20"), "Z": of("false")}).collect()
    assert len(rows) == 18
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in rows}
    assert got["XYZ", 1] == (20, 10, 0, 5, 45) and got["XYZ", 2] == (10, 10, 5, 10, 75) and got["YXZ", 2] == (10, 5, 5, 5, 45) and got["ZXY", 1] == (30, 0, 0, 0, 0)


def test_orders_are_all():
    got = audit.orders("ABC")
    assert len(got) == 18 and len({o for o, *_ in got}) == 6 and all(after == seen | 1 << f for _, _, f, seen, after in got)
