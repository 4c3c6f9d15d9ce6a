"""Tokens, pieces and near-duplicates against the libraries and brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from terrasift.llm import graph, minhash, pieces, tokencount

TEXTS = [None, "", " ", "  a  b ", "The quick  brown\n\n fox's don't\tI'LL", "é漢字 ﬁ ½ ①٣ x²", "\x1c\x85 a　b c​ d", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endof", "▁a ▁▁ b", "0123456789" * 30, "a" * 5000,
         "👩‍👩‍👧 ﻿\x00end", "### --- !!! ... ''s 're", "thththth ininin " * 400, "\n" * 77, "<s> </s> <unk> <0x41>"]


def docs_of(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "x y", 5)], "doc_id long, text string, n_tokens long")


def test_token_counts_match_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in tokencount.counted(docs_of(spark), tokencount.tokenizer_file(), group=3).collect()}
    assert got == {**{i: len(t.encode(x or "", add_special_tokens=False)) for i, x in enumerate(TEXTS)}, None: len(t.encode("x y", add_special_tokens=False))}
    assert tokencount.counted(docs_of(spark).filter("false"), tokencount.tokenizer_file()).count() == 0


def test_token_memory_is_bounded():
    c = tokencount.PieceCounter(tokencount.tokenizer_file(), kept=10)
    for i in range(0, 100, 5):
        c.learn({f" w{j}" for j in range(i, i + 5)} | {" the"})
        assert len(c.new) + len(c.old) <= 40 and c.new[" the"] == 1


def test_pieces_match_the_library(spark):
    import sentencepiece

    model = pieces.model_bytes()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = pieces.encode(docs_of(spark).withColumn("ids", F.lit(1)), model).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = "x y" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert list(r.ids) == sp.encode(text), repr(text)
        assert r.round_trip == ("▁" not in text), repr(text)
    back = pieces.decode(spark.createDataFrame([(list(r.ids),) for r in rows] + [(None,)], "ids array<int>"), model, out="back").collect()
    assert [r.back for r in back[:-1]] == [sp.decode(list(r.ids)) for r in rows] and back[-1].back is None


def unigram(model: bytes) -> bytes:
    """The same pieces and scores as a unigram model."""
    def varint(n):
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    out = b""
    for number, value in pieces._fields(model):
        if number == 2:
            at = value.index(b"\x18\x02")
            value = value[:at] + b"\x18\x01" + value[at + 2 :]
        out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def test_unigram_relaxes_to_the_best_score():
    c = pieces.Codec(unigram(pieces.model_bytes()))
    assert c.kind == "unigram"

    def top(s):  # the best sum over all cuts
        best = [0.0] + [float("-inf")] * len(s)
        for e in range(1, len(s) + 1):
            for a in range(e):
                i = c.id_of.get(s[a:e])
                if i is not None:
                    best[e] = max(best[e], best[a] + c.score[i])
            if s[e - 1] not in c.id_of:
                best[e] = max(best[e], best[e - 1] + c.penalty)
        return best[-1]

    rng = random.Random(1)
    for _ in range(200):
        s = "".join(rng.choice("thein  ao漢\n") for _ in range(rng.randint(1, 30)))
        marked = pieces.SPACE + s.replace(" ", pieces.SPACE)
        ids = c.encode(s)
        unknown = sum(ch not in c.id_of for ch in marked)
        assert sum(c.score[i] for i in ids if i not in c.of_byte) + unknown * c.penalty == pytest.approx(top(marked))
        assert c.decode(ids) == s


def link_plain(texts, size, percent):
    def words(t):
        low = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in t or "")
        for ch in "\t\n\v\f\r":
            low = low.replace(ch, " ")
        return [w for w in low.split(" ") if w]

    s = {}
    for i, t in texts:
        w = words(t)
        s[i] = {tuple(w[a : a + size]) for a in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(s), 2):
        n = len(s[a] & s[b])
        if s[a] and s[b] and 100 * n >= percent * (len(s[a]) + len(s[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((i, len(s[i]), find(i), find(i) == i) for i in s)


def near_texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [None, "", " \t\n", "one", "ONE", "one two", "é one\x0btwo three four", "É one two three four"]
    for family in range(6):  # chains of edits: neighbours are near, ends are not
        t = [word() for _ in range(60 + 40 * family)]
        for _ in range(14):
            texts.append(" ".join(t))
            t = list(t)
            t[rng.randrange(len(t))] = word()
            if rng.random() < 0.3:
                t = t[1:]
    base = [word() for _ in range(120)]  # a family just below the similarity: a shared passage with ends of their own
    for _ in range(25):
        texts.append(" ".join(base + [word() for _ in range(rng.choice([10, 14, 30, 60]))]))
    texts += [texts[20]] * 30 + [texts[20].upper(), texts[20].replace(" ", "\n\n")]
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_match_all_pairs(spark, size):
    texts = near_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, component_id string").repartition(4)
    got = minhash.groups(df, size=size).drop("cls")
    assert sorted(tuple(r) for r in got.collect()) == link_plain(texts, size, 80)
    kept = minhash.keep_one(df, size=size)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, _, k in link_plain(texts, size, 80) if k]


def test_near_duplicates_of_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "z"), (None, "z"), (2, None), (3, None), (1, "other words here")]
    got = minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), size=4).drop("cls").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(1, 3, 1, True), (1, 3, 1, True), (None, 3, 1, False), (None, 1, None, True), (None, 1, None, True), (2, 0, 2, True), (3, 0, 3, True), (1, 1, 1, True)]))
    assert minhash.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, None), (7, 7)]
    root: dict[int, int] = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = graph.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((i, find(i)) for i in root)


def test_keep_one_loses_no_text_of_its_own(spark):
    """Repeated ids with other texts, null ids, texts without words: only copies go."""
    rows = [(1, "a b c d e f g", 1), (1, "h i j k l m n", 2), (1, "a b c d e f g", 3), (None, None, 4), (None, "", 5), (None, "", 6), (None, "q r s", 7), (None, "Q r  s", 8), (None, "a b c d e f g", 9),
            (2, "a b c d e f g", 10), (3, None, 11), (3, None, 12), (3, "h i j k l m n", 13), (4, "u v w x y z", 14)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3)
    kept = {r.row for r in minhash.keep_one(df).collect()}
    assert kept - {1, 3, 7, 8} == {2, 4, 5, 6, 11, 12, 14} and len(kept & {1, 3}) == 1 and len(kept & {7, 8}) == 1


def test_percents_the_bands_are_not_made_for_are_refused(spark):
    with pytest.raises(ValueError):
        minhash.groups(spark.createDataFrame([], "doc_id long, text string"), percent=50)
