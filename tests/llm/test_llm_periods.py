"""Periodic runs against all lags of every word."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from terrasift.llm import periods


def plain(w, least=24, power=3):
    n, out = len(w), {}
    for q in range(1, n // power + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            a = i
            while i < n and w[i] == w[i - q]:
                i += 1
            if i - a + q >= max(least, power * q):
                out.setdefault((a - q, i - a + q), q)  # lags go up, so the smallest period comes first
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def codes(w):
    return np.array(w, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(5)


@pytest.mark.parametrize("least, power", [(24, 3), (6, 3), (4, 2), (9, 2), (1, 3), (7, 4)])
def test_runs_match_all_lags(least, power):
    rng, seen = random.Random(least), 0
    for _ in range(400):
        a = rng.choice([1, 2, 2, 3, 4, 8])
        w = [rng.randrange(a) for _ in range(rng.randint(0, 130))]
        for _ in range(rng.randint(0, 4)):
            b = [rng.randrange(a) for _ in range(rng.randint(1, 14))]
            at = rng.randint(0, len(w))
            w[at:at] = (b * rng.randint(2, 12))[: rng.randint(1, 110)]
        got = periods.find_runs(codes(w), least, power)
        assert got == plain(w, least, power), w
        seen += len(got)
    assert seen > 50


def test_long_repetitive_texts():
    assert periods.find_runs(codes([1] * 40_000)) == [(0, 40_000, 1)]
    assert periods.find_runs(codes([*range(10)] * 3000)) == [(0, 30_000, 10)]
    blocks = ([1] * 100 + [2]) * 60
    assert periods.find_runs(codes(blocks)) == plain(blocks)
    assert periods.find_runs(codes([*range(5000)] * 2)) == []


def test_reach_is_least_length_less_period():
    for least in range(1, 40):
        for power in (2, 3, 4):
            assert periods.reach(least, power) == min(max(least, power * q) - q for q in range(1, 200)), (least, power)


def contract(i, text):
    w = text.split(" ") if text else []
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
    runs = plain(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else None
    drop = {j for s, n, q in runs for j in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for j, x in enumerate(w) if j not in drop)))


def test_contract_columns(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 90)))) for i in range(150)]
    docs += [(200 + i, " ".join(["é", "x#"] * k + ["|"])) for i, k in enumerate([11, 12, 13, 40, 500])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, runs string")
    got = periods.digest(periods.collapse(periods.periodic(df)))
    assert sorted(tuple(r) for r in got.collect()) == sorted(contract(i, t) for i, t in docs)


def test_odd_rows(spark):
    run = "a b c " * 8
    rows = [(None, run, 1), (1, None, 2), (1, "", 3), (1, " \t\n\x0b\f\r", 4), (2, run, 5), (2, run, 6), (3, "a\tb\nc  " * 8 + "\x1c", 7), (4, "lo rem\n" * 60_000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, collapsed long")
    got = periods.collapse(df)
    assert got.columns == ["doc_id", "text", "n_words", "n_runs", "runs", "strongest", "collapsed"]
    found = [(r.n_words, r.n_runs, r.strongest and tuple(r.strongest), r.collapsed) for r in got.collect()]
    one = (24, 1, (0, 24, 3), "a b c")
    assert sorted(map(str, found)) == sorted(map(str, [one, (0, 0, None, ""), (0, 0, None, ""), (0, 0, None, ""), one, one, (25, 1, (0, 24, 3), "a b c \x1c"), (120_000, 1, (0, 120_000, 2), "lo rem")]))
    assert periods.digest(periods.collapse(periods.periodic(df))).filter("runs_sha256 IS NULL OR collapsed_sha256 IS NULL").count() == 0
    assert periods.collapse(df.filter("false")).count() == 0
    assert periods.collapse(df, least=6, power=2).filter("n_runs > 0").count() == 5
