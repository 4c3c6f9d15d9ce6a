"""The n-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest
from test_llm_text import link_plain, near_texts

from terrasift.llm import jaccard


def found(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, cls string").repartition(4)
    return sorted(tuple(r) for r in jaccard.groups(df, **kw).drop("cls").collect())


def plain(texts, size, percent):
    return [(i, n, c) for i, n, c, _ in link_plain(texts, size, percent)]


def short_texts():
    """Sets of 1 to 25 shingles, where one shingle more or less decides."""
    rng, texts = random.Random(5), []
    for n in range(1, 28):
        base = [f"{n}_{j}" for j in range(n)]
        texts += [" ".join(base), " ".join(base[1:]), " ".join(base + ["end"]), " ".join([*base[:-1], "else"]), " ".join(base + base)]
        rng.shuffle(base)
        texts.append(" ".join(base))
    return texts


@pytest.mark.parametrize("size, percent", [(3, 90), (2, 80), (1, 50), (3, 100)])
def test_links_match_all_pairs(spark, size, percent):
    texts = list(enumerate([t for _, t in near_texts()] + short_texts()))
    assert found(spark, texts, size=size, percent=percent) == plain(texts, size, percent)


@pytest.mark.parametrize("bound", [0, 60, 10**9])
def test_both_ways_find_the_same(spark, bound, monkeypatch):
    """Inverted lists alone, a mix, subsets alone; with one round of hubs, what is left is paired."""
    monkeypatch.setattr(jaccard.Join, "boundary", lambda self, postings: bound)
    if bound == 60:
        monkeypatch.setattr(jaccard, "ROUNDS", 1)
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(84)]
    crowd = [" ".join(passage + [f"{k}_{j}" for j in range(n)]) for k, n in enumerate([30] * 20 + [8, 7, 6, 5, 5, 5])]
    for k in range(40):  # edited copies of one text, each too far from it, some of them near each other by an edit they share
        far = [f"f{i}" for i in range(120)]
        for j in range(4):
            far[(7 * (k // 4) + 29 * j) % 120] = f"shared{k // 4}_{j}"
        far[(11 * k + 5) % 120] = f"own{k}"
        crowd.append(" ".join(far))
    crowd.append(" ".join(f"f{i}" for i in range(120)))
    chain = [f"c{i}" for i in range(90)]
    for _ in range(12):
        crowd.append(" ".join(chain))
        chain[rng.randrange(90)] = f"new{rng.random()}"
    texts = list(enumerate(crowd))
    assert found(spark, texts, size=3, percent=90) == plain(texts, 3, 90)


def edited_copies(n):
    """Copies of one text, each with an edit of its own and edits shared with a few others, and the text itself."""
    out = []
    for k in range(n):
        far = [f"f{i}" for i in range(120)]
        for j in range(3):
            far[(7 * (k // 3) + 29 * j) % 120] = f"shared{k // 3}_{j}"
        far[(11 * k + 5) % 120] = f"own{k}"
        out.append(" ".join(far))
    return list(enumerate([*out, " ".join(f"f{i}" for i in range(120))]))


def test_moderate_lists_need_no_hubs(spark, monkeypatch):
    """Lists of some 15 classes have few pairs for their postings, so all links come from one count of pairs."""

    def none(self, lists):
        raise AssertionError("hubs")

    monkeypatch.setattr(jaccard.Join, "stars", none)
    texts = edited_copies(15)
    assert found(spark, texts, size=3, percent=90) == plain(texts, 3, 90)


@pytest.mark.parametrize("pairs, prefixes", [(0.0, 1.0), (0.0, 1e9), (1.0, 1e-9)])
def test_hubs_and_pairs_find_the_same(spark, pairs, prefixes, monkeypatch):
    """Long lists go by hubs; what a hub leaves open is paired where that is cheap, and goes to the next hub where not."""
    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    monkeypatch.setattr(jaccard, "PREFIXES", prefixes)
    texts = edited_copies(30)
    assert found(spark, texts, size=3, percent=90) == plain(texts, 3, 90)


def test_boundary_follows_the_costs(spark):
    """Small sets with few shared shingles go by subsets, long ones that share very many by lists."""
    texts = [f"{i} " + " ".join(f"s{i // 2}_{j}" for j in range(12)) for i in range(60)] + [" ".join(f"l{j}" for j in range(4000)) + f" e{i}" for i in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    level = jaccard.levels(docs, 1, "text")
    join = jaccard.Join(docs, jaccard.prefixes(docs, 1, 80, level, "text", "doc_id"), level, 1, 80, "text", "doc_id")
    x = join.boundary(join.postings())
    assert 13 <= x < 4001


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "z"), (None, "z"), (2, None), (3, None), (1, "other words here"), (4, "A B\x0bC D"), (5, " \t\n")]
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=90).drop("cls").collect()
    want = [(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 1, None), (None, 1, None), (2, 0, 2), (3, 0, 3), (1, 1, 1), (4, 2, 1), (5, 0, 5)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert jaccard.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_long_text_and_equal_sets(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = [(1, long), (2, long + " end"), (3, "x y " * 10), (4, "y x " * 9 + "y"), (5, "x y x y")]
    assert found(spark, texts, size=3, percent=90) == [(1, 59_998, 1), (2, 59_999, 1), (3, 2, 3), (4, 2, 3), (5, 2, 3)]


def test_percent_out_of_range(spark):
    with pytest.raises(ValueError):
        jaccard.groups(spark.createDataFrame([], "doc_id long, text string"), percent=40)


@pytest.mark.parametrize("percent", [75, 80, 90, 99, 100])
def test_links_have_an_equal_part(percent):
    """Two sets that just reach the similarity share a part, and differ in no more bins than shingles."""
    rng = np.random.default_rng(3)
    first = np.array(jaccard.steps(5000, percent))
    for n in [*range(1, 60), 100, 333, 1000, 4000]:
        for _ in range(6):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            gone = int(rng.integers(0, jaccard.may_differ(n, n, percent) + 1))
            b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)])
            while len(b) > len(a) - gone and 100 * (n - gone) < percent * (gone + len(b)):
                b = b[:-1]
            a, b = np.unique(a), np.unique(b)
            differ = len(np.setxor1d(a, b))
            assert jaccard.bins_apart(jaccard.bins(a), jaccard.bins(b)) <= differ
            if len(b) and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
                assert differ <= jaccard.may_differ(len(a), len(b), percent)
                assert np.isin(jaccard.keys(a, percent, first), jaccard.keys(b, percent, first)).any()


def test_unlike_texts_of_frequent_shingles_make_no_lists(spark, monkeypatch):
    """Every shingle is in many texts, but no part of one is that of another: nothing is left for hubs."""

    def none(self, lists):
        raise AssertionError("hubs")

    monkeypatch.setattr(jaccard.Join, "stars", none)
    monkeypatch.setattr(jaccard, "PAIRS", 0.0)
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice("abcdefghijkl") for _ in range(100))) for i in range(200)]
    assert found(spark, texts, size=3, percent=90) == plain(texts, 3, 90)


@pytest.mark.parametrize("bound", [0, 60, 10**9])
def test_rare_shingles_find_the_same(spark, bound, monkeypatch):
    """The way for low similarities, on edited copies of high ones."""
    monkeypatch.setattr(jaccard, "PARTED", 101)
    monkeypatch.setattr(jaccard, "PAIRS", 0.0)
    monkeypatch.setattr(jaccard.Join, "boundary", lambda self, postings: bound)
    texts = edited_copies(20)
    assert found(spark, texts, size=3, percent=90) == plain(texts, 3, 90)
