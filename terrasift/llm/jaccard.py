"""N-gram Jaccard join: equal parts of two sets where links differ little, rare shingles where they may differ much.

From PARTED percent on, shingles are dealt by hash into one part more than the shingles two linked sets may differ in, so at least one
part is equal in both (``parts``). Parts hold several shingles, which few unlike sets share, so lists of the sets with an equal part are
short but for families of edited copies. Bins of parities, whose differences are at most the sets', turn away what is no link before
full sets are compared.

Below, the join is size-aware: subsets of rare shingles for small sets, inverted lists for large ones. Shingles are ordered from rare to frequent by a sketch of their document frequencies. Two sets that reach the similarity have at
least k common shingles among the first p + k of each, p being how many shingles a set may miss. So small sets are found by the
subsets of k = 2 shingles of that prefix, which few unlike sets share, and large sets, which have too many subsets, by the
inverted lists of the first p + 1 single shingles. Where small ends follows from the cost of both ways for each size, counted on
the data. Only shingles that two different sets hold take part, and sets that are equal are one class from the start.

Lists are paired as they are, from the short ones on, as long as their pairs stay in proportion to the postings. Only longer ones go
by subsets and hubs. In each of these every class is compared with one hub. What is then still apart is settled by what the sets have outside the hub: two
sets with i and j shingles in common with hub H have at most min(i, j) + |(a - H) & (b - H)| in common. So a pair is a link only if
min(i, j) is enough, which is seen from numbers, or if it shares a shingle outside H, for which the rarest shingles of a - H make new
lists. A family of many edited copies is thus settled without building its pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import class_table, free, hashed_words, in_batches, lower, mix, task_sums, utf8
from terrasift.llm.graph import components
from terrasift.llm.minhash import shingles
from terrasift.session import cut

WORDS = class_table(lambda b: 0 if b == 32 or 9 <= b <= 13 else 1)
SLOTS = 1 << 17  # slots of the frequency sketch
SUBSET = 2  # shingles of a small set's subsets
AHEAD = 8  # shingles of the prefix beyond those a set may miss; as many must be common
ROUNDS = 12  # of hubs; lists left after that are paired as they are
FEW = 8  # classes of a list whose pairs are built in any case
PAIRS = 8.0  # pairs counted, for each posting of the table, before longer lists go to hubs
PREFIXES = 32.0  # a pair that is compared by its prefixes, against one that is counted
SCAN = 4.0  # cost of a posting of an inverted list, which is compared with a hub, against a subset's
WIDTH = 3  # steps of a size class; a step is as far as a link goes
DEALT = 8  # keys of parts, for each pair that is compared by its bins, before longer lists go to hubs
PARTED = 75  # percent from which sets go by equal parts: parts then have three shingles or more on average
BROADCAST = 100_000  # classes of 24 bytes that may be broadcast; more are joined by a shuffle


def sets(texts: list[bytes], size: int):
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    for t in texts:
        yield shingles(hashed_words([lower(t)], WORDS)[0], size)


def levels(docs: DataFrame, size: int, text: str) -> np.ndarray:
    """Per slot of the shingles' hashes, an eighth-octave level of how many (document, shingle) fall there."""

    def count(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(SLOTS, np.int64)
        held, n = [], 0
        for s in sets(utf8(batch.column(0)), size):
            held.append(s)
            n += len(s)
            if n > 1 << 18:
                total += _slots(held)
                held, n = [], 0
        return total + _slots(held) if held else total

    total = task_sums(docs, count, SLOTS, [text])
    return np.minimum(np.log2(total + 1.0) * 8, 255).astype(np.uint8)


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)


def _rare_first(s: np.ndarray, level: np.ndarray | None) -> np.ndarray:
    """The shingles in one order for all sets; without levels, that of their hashes."""
    if level is None:
        return s
    return s[np.argsort(level[_slot(s)], kind="stable")]


def _slots(held: list[np.ndarray]) -> np.ndarray:
    return np.bincount(_slot(np.concatenate(held)), minlength=SLOTS)


def may_miss(n, percent: int):
    """How many shingles of a set of n the other set of a link may lack."""
    return (100 - percent) * n // 100


def prefixes(docs: DataFrame, size: int, percent: int, level: np.ndarray, text: str, id: str) -> DataFrame:
    """(doc_id, cls, n, prefix) per row: cls is a digest of the set, prefix its rarest shingles, none where nothing different can be linked."""

    def work(batches):
        for b in batches:
            cls, size_of, prefix = [], [], []
            for s in sets(utf8(b.column(1)), size):
                n = len(s)
                cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else b"")
                size_of.append(n)
                alone = 100 * n < percent * (n + 1)
                prefix.append(s[:0].view(np.int64) if alone else _rare_first(s, level)[: may_miss(n, percent) + AHEAD].view(np.int64))
            yield pa.record_batch({"doc_id": b.column(0), "cls": pa.array(cls, pa.binary()), "n": pa.array(size_of, pa.int64()), "prefix": pa.array(prefix, pa.list_(pa.int64()))})

    return in_batches(docs.select(F.col(id).cast("long").alias("doc_id"), text), work, "doc_id long, cls binary, n long, prefix array<long>")


def may_differ(a, b, percent: int):
    """In how many shingles two linked sets of a and b may differ."""
    return (100 - percent) * (a + b) // (100 + percent)


def steps(n: int, percent: int) -> list[int]:
    """First sizes of the size classes up to that after n: linked sets are in the same class or in two next to each other."""
    out = [1]
    while len(out) < 3 or out[-2] <= n:
        out.append(out[-1])
        for _ in range(WIDTH):
            out[-1] = 100 * out[-1] // percent + 1
    return out


def keys(s: np.ndarray, percent: int, first: np.ndarray) -> np.ndarray:
    """Hashes of the parts of a set, among sets up to the top of its size class, and up to that of the next if it can be linked there."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s), dtype=np.uint64)])
    high, n = s >> np.uint64(32), len(s)
    at = int(np.searchsorted(first, n, "right"))
    out = []
    for k in (at, at + 1) if 100 * n >= percent * int(first[at]) else (at,):
        top = int(first[k]) - 1
        m = may_differ(top, top, percent) + 1
        i = np.arange(m + 1, dtype=np.uint64)
        edge = np.searchsorted(high, ((i << np.uint64(32)) + np.uint64(m - 1)) // np.uint64(m))
        out.append(mix(mix(total[edge[1:]] - total[edge[:-1]] + np.uint64(k)) + i[:-1]))
    return np.concatenate(out)


def bins(s: np.ndarray) -> bytes:
    """Parities of the shingles in each of at least 4 n bins, a power of two. Sets that differ in d shingles differ in at most d bins."""
    size = 1 << max(6, (4 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def bins_apart(a: bytes, b: bytes) -> int:
    """In how many bins two sets differ; the longer row of bins is folded to the length of the other."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def parts(docs: DataFrame, size: int, percent: int, text: str, id: str) -> DataFrame:
    """(doc_id, cls, n, bins, keys) per row: cls is a digest of the set, keys its parts; bins and keys none where nothing different can be linked."""

    def work(batches):
        first = np.array(steps(1, percent))
        for b in batches:
            cls, size_of, parity, part = [], [], [], []
            for s in sets(utf8(b.column(1)), size):
                n = len(s)
                if n >= first[-2]:  # the class after that of n must have its top
                    first = np.array(steps(n, percent))
                alone = 100 * n < percent * (n + 1)
                cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else b"")
                size_of.append(n)
                parity.append(b"" if alone else bins(s))
                part.append(s[:0].view(np.int64) if alone else keys(s, percent, first).view(np.int64))
            yield pa.record_batch({"doc_id": b.column(0), "cls": pa.array(cls, pa.binary()), "n": pa.array(size_of, pa.int64()), "bins": pa.array(parity, pa.binary()), "keys": pa.array(part, pa.list_(pa.int64()))})

    return in_batches(docs.select(F.col(id).cast("long").alias("doc_id"), text), work, "doc_id long, cls binary, n long, bins binary, keys array<long>")


class Join:
    """The join of one table: its classes, and what is known of their components so far."""

    def __init__(self, docs: DataFrame, classes: DataFrame, level: np.ndarray, size: int, percent: int, text: str, id: str):
        self.docs, self.classes, self.level, self.size, self.percent, self.text, self.id = docs, classes, level, size, percent, text, id
        self.comp = None
        self.listed = None  # the classes in lists of equal parts, with their bins
        self.few = 1  # classes of the longest lists that have gone by counts
        self.most = 0.0  # pairs that may be built from lists at once

    @property
    def _missing(self) -> Column:
        """How many shingles a set of ``n`` may miss, in integers."""
        return F.expr(f"CAST({100 - self.percent} * n DIV 100 AS INT)")

    def postings(self) -> DataFrame:
        """(cls, n, w, tokens): per class its prefix shingles that another class has too, each as (at, token, c), rare ones first.

        c: how many classes have it in their prefix; w: the sum of c. A class with fewer such shingles than every link has in common
        takes no part, and then neither do the shingles that only one of the others has.
        """
        each = self.classes.filter(F.size("prefix") > 0).select("cls", "n", F.posexplode(F.slice("prefix", F.lit(1), self._missing + AHEAD)).alias("at", "token"))
        for _ in range(2):
            often = each.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
            both = each.join(often, "token").select("cls", "n", F.struct("at", "token", "c").alias("t"))
            some = both.groupBy("cls").agg(F.first("n").alias("n"), F.sum("t.c").alias("w"), F.array_sort(F.collect_list("t")).alias("tokens"))
            some = cut(some.filter(F.size("tokens") >= F.least(F.lit(AHEAD), F.ceil(self.percent * F.col("n") / 100))))
            free(self.docs.sparkSession)
            each = some.select("cls", "n", F.explode("tokens").alias("t")).select("cls", "n", "t.at", "t.token")
        return some

    def counted(self, postings: DataFrame) -> DataFrame:
        """Pairs (u, v) that share enough short lists: all but SUBSET - 1 of the prefix shingles that a link has in common.

        A link that shares fewer has SUBSET long lists in common, where subsets and hubs find it. How long a short list may be follows
        from the pairs of all lists up to its length, PAIRS for each posting.
        """
        self.most = PAIRS * (postings.agg(F.sum(F.size("tokens"))).first()[0] or 0)
        self.few = self._affordable(postings.select(F.explode("tokens").alias("t")).select("t.c"), self.most)
        each = postings.select("cls", "n", F.explode(F.filter("tokens", lambda t: t.c <= self.few)).alias("t")).select("cls", "n", "t.token")
        a, b = each.alias("a"), each.alias("b")
        both = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.cls") < F.col("b.cls")) & self._near(F.col("a.n"), F.col("b.n")))
        same = both.groupBy(F.col("a.cls").alias("u"), F.col("b.cls").alias("v")).agg(F.count(F.lit(1)).alias("c"), F.max(F.greatest("a.n", "b.n")).alias("n"))
        return same.filter(F.col("c") > F.least(F.lit(AHEAD), F.ceil(self.percent * F.col("n") / 100)) - SUBSET).select("u", "v")

    @staticmethod
    def _affordable(entries: DataFrame, most: float) -> int:
        """The length c, FEW at least, up to which all lists together have at most ``most`` pairs. ``entries`` has one row per class of a list.

        Lengths are taken by octaves, so the driver sees some thirty rows.
        """
        rows = entries.groupBy(F.floor(F.log2("c")).alias("b")).agg(F.max("c").alias("top"), F.sum((F.col("c") - 1) / 2).alias("pairs")).orderBy("b").collect()
        few, pairs = FEW, 0.0
        for r in rows:
            pairs += r.pairs
            if pairs > most:
                break
            few = max(few, r.top)
        return few

    def _long(self) -> Column:
        """The tokens of a posting whose lists have not gone by counts."""
        return F.transform(F.filter("tokens", lambda t: t.c > self.few), lambda t: t.token)

    def paired(self, lists: DataFrame, most: float) -> tuple[DataFrame, DataFrame]:
        """(pairs (u, v) of the shorter lists whose ends are apart, the longer lists). The pairs are ``most``, or those of FEW classes each."""
        sized = lists.join(lists.groupBy("key").agg(F.count(F.lit(1)).alias("c")), "key")
        few = self._affordable(sized.select("c"), most)
        m = sized.filter(F.col("c") <= few)
        a, b = m.alias("a"), m.alias("b")
        able = (F.col("a.cls") < F.col("b.cls")) & (F.col("a.root") != F.col("b.root")) & self._near(F.col("a.n"), F.col("b.n"))
        pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & able).select(F.col("a.cls").alias("u"), F.col("b.cls").alias("v"))
        return pairs, sized.filter(F.col("c") > few).drop("c")

    def boundary(self, postings: DataFrame) -> int:
        """The size up to which subsets cost less than inverted lists.

        A subset costs 1, a posting of the sets that large ones may be linked with SCAN. Costs are summed per size class of an eighth
        octave, so the driver sees at most some hundred rows.
        """
        k = F.size(self._long())
        sums = (F.min("n").alias("low"), F.max("n").alias("top"), F.sum(k.cast("long") * (k - 1) / 2).alias("subsets"), F.sum(k).alias("posted"))
        rows = postings.groupBy(F.floor(8 * F.log2("n")).alias("b")).agg(*sums).orderBy("b").collect()
        largest = rows[-1].top if rows else 0

        def cost(x: int) -> float:
            return sum(r.subsets for r in rows if r.top <= x) + (SCAN * sum(r.posted for r in rows if 100 * r.top >= self.percent * x) if x < largest else 0.0)

        # a size class goes up to the next one's first size, so that no more sets than needed are posted; equal costs go by subsets, whose lists are shorter
        return min([0, *(r.low - 1 for r in rows[1:]), largest], key=lambda x: (cost(x), -x))

    def lists(self, postings: DataFrame, x: int) -> DataFrame:
        """(key, cls, n, w): subsets of the sets up to size x, single shingles of those large ones may be linked with; in two classes or more."""
        facts = postings.select("cls", "n", "w", self._long().alias("tokens"))
        first = facts.filter(F.col("n") <= x).select("cls", "n", "w", "tokens", F.posexplode("tokens").alias("at", "a"))
        small = first.select("cls", "n", "w", "a", F.explode(F.slice("tokens", F.col("at") + 2, F.size("tokens"))).alias("b")).select(F.array_sort(F.array("a", "b")).alias("key"), "cls", "n", "w")
        # a pair of sets that need not have SUBSET shingles in common is found by single ones at any size
        large = facts.filter((F.lit(100) * F.col("n") >= self.percent * x) | (self.percent * F.col("n") <= 100 * (SUBSET - 1))).select("cls", "n", "w", F.explode("tokens").alias("a")).select(F.array("a").alias("key"), "cls", "n", "w")
        return self._shared(small.unionByName(large))

    @staticmethod
    def _shared(keyed: DataFrame) -> DataFrame:
        """The lists of two classes or more. Of lists that hold the same classes (a family's common subsets) one stays, told by count and two XOR sums."""
        sums = (F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("y"))
        held = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), *sums).filter("c > 1")
        return cut(keyed.join(held.groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key"), "key"))

    def _near(self, a: Column, b: Column) -> Column:
        return F.lit(100) * F.least(a, b) >= self.percent * F.greatest(a, b)

    def stars(self, lists: DataFrame) -> DataFrame:
        """(cls, u, v, w): each class with the hub of each of its lists, the class with most common shingles overall."""
        hub = lists.groupBy("key").agg(F.max(F.struct("w", "cls", "n")).alias("h"))
        pairs = lists.select("key", "cls", "n").join(hub, "key").filter((F.col("cls") != F.col("h.cls")) & self._near(F.col("n"), F.col("h.n")))
        return cut(pairs.select("cls", F.least("cls", "h.cls").alias("u"), F.greatest("cls", "h.cls").alias("v"), F.col("h.w").alias("w")).distinct())

    def rooted(self, rows: DataFrame, node: str, root: str) -> DataFrame:
        """``rows`` with the root of a class; a class in no component is its own root."""
        if self.comp is None:
            return rows.withColumn(root, F.col(node))
        of = self.comp.select(F.col("node").alias(node), F.col("root").alias("__r"))
        return rows.join(of, node, "left").withColumn(root, F.coalesce("__r", node)).drop("__r")

    def by_parts(self, rows: DataFrame) -> DataFrame:
        """(key, cls, n, w) of the parts that two classes or more have; w: over how many classes its lists have, the sum.

        Rows are dealt by key once, for the counts and for the members, with a hash of the class, which meets its classes again in the
        few lists that are left. Of lists that hold the same classes one stays.
        """
        each = rows.select(F.explode("keys").alias("key"), F.xxhash64("cls").alias("id")).filter("key IS NOT NULL").repartition("key").distinct()
        held = each.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.bit_xor("id").alias("x"), F.bit_xor(F.xxhash64("id")).alias("y")).filter("c > 1")
        one = held.groupBy("c", "x", "y").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("alike"))
        lists = cut(each.join(one.select("key", (F.col("c") * F.col("alike")).alias("c")), "key"))
        free(self.docs.sparkSession)
        facts = lists.groupBy("id").agg(F.sum("c").alias("w")).join(self.classes.select("cls", "n", "bins", F.xxhash64("cls").alias("id")), "id")
        self.listed = facts = cut(facts)
        self.most = max(PAIRS * lists.count(), (rows.agg(F.sum(F.size("keys"))).first()[0] or 0) / DEALT)
        return cut(lists.select(F.array("key").alias("key"), "id").join(facts.drop("bins"), "id").select("key", "cls", "n", "w"))

    def absorb(self, pairs: DataFrame) -> None:
        """Confirm the pairs (u, v) whose ends are apart and join the components of those that are links."""
        apart = self.rooted(self.rooted(pairs.select("u", "v").distinct(), "u", "ru"), "v", "rv").filter("ru <> rv").select("u", "v")
        alike = self._alike(apart)
        if alike.isEmpty():
            return
        links = self.rooted(self.rooted(self._links(alike), "u", "ru"), "v", "rv")
        more = cut(links.filter("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct())
        free(self.docs.sparkSession)
        if not more.isEmpty():
            top = cut(components(more))
            if self.comp is None:
                self.comp = top
            else:
                new = top.select(F.col("node").alias("root"), F.col("root").alias("__new"))
                old = self.comp.unionByName(top.select(F.col("node"), F.col("node").alias("root"))).distinct()
                self.comp = cut(old.join(new, "root", "left").select("node", F.coalesce("__new", "root").alias("root")).distinct())
        free(self.docs.sparkSession)

    def _alike(self, pairs: DataFrame) -> DataFrame:
        """Pairs that may be links by their bins; without those, by their prefixes.

        The prefixes of a link have as many shingles in common as every link has; exact, as they are ordered alike.
        """
        if self.listed is not None:
            return self._near_bins(pairs)
        side = self.classes.filter(F.size("prefix") > 0)
        a, b = (side.select(F.col("cls").alias(c), "n", F.col("prefix").alias(f"prefix_{c}")) for c in "uv")
        both = pairs.join(a.withColumn("n_u", F.col("n")), "u").drop("n").join(b.withColumn("n_v", F.col("n")), "v")
        least = F.ceil(self.percent * F.greatest("n_u", "n_v") / 100)
        alike = cut(both.filter(F.size(F.array_intersect("prefix_u", "prefix_v")) >= F.least(F.lit(AHEAD), least)).select("u", "v"))
        free(self.docs.sparkSession)
        return alike

    def _near_bins(self, pairs: DataFrame) -> DataFrame:
        """Pairs that differ in no more bins than a link may in shingles."""
        percent = self.percent

        def work(batches):
            for b in batches:
                n = np.asarray(b.column("n_u")) + np.asarray(b.column("n_v"))
                apart = [bins_apart(x, y) for x, y in zip(b.column("bins_u").to_pylist(), b.column("bins_v").to_pylist(), strict=True)]
                yield b.select(["u", "v"]).filter(pa.array(np.array(apart, np.int64) <= may_differ(n, 0, percent)))

        for c in "uv":
            pairs = pairs.join(self.listed.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("bins").alias(f"bins_{c}")), c)
        alike = cut(in_batches(pairs.filter(self._near(F.col("n_u"), F.col("n_v"))), work, "u binary, v binary"))
        free(self.docs.sparkSession)
        return alike

    def _links(self, pairs: DataFrame) -> DataFrame:
        """The pairs with 100 * intersection >= percent * union."""
        same = self._both(pairs).select("u", "v", F.size(F.array_intersect("a", "b")).alias("i"), (F.size("a") + F.size("b")).alias("t"))
        return cut(same.filter(100 * F.col("i") >= self.percent * (F.col("t") - F.col("i"))).select("u", "v"))

    def _both(self, pairs: DataFrame) -> DataFrame:
        """The pairs, a stored table, with both full sets (a, b), rare shingles first, made again from the texts of the classes."""
        size, level = self.size, self.level

        def work(batches):
            for b in batches:
                want, got = b.column(0).to_pylist(), list(sets(utf8(b.column(1)), size))
                at = [i for i, s in enumerate(got) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == want[i]]
                yield pa.record_batch({"cls": pa.array([want[i] for i in at], pa.binary()), "items": pa.array([_rare_first(got[i], level).view(np.int64) for i in at], pa.list_(pa.int64()))})

        need = cut(pairs.select(F.col("u").alias("cls")).union(pairs.select("v")).distinct().join(self.classes.select("cls", "doc_id"), "cls"))
        if need.count() <= BROADCAST:
            need = F.broadcast(need)
        texts = self.docs.select(F.col(self.id).cast("long").alias("__id"), F.col(self.text).alias("text"))
        rows = texts.join(need, F.col("__id").eqNullSafe(F.col("doc_id"))).select("cls", "text")
        full = cut(in_batches(rows, work, "cls binary, items array<long>").dropDuplicates(["cls"]))
        free(self.docs.sparkSession)
        return pairs.join(full.select(F.col("cls").alias("u"), F.col("items").alias("a")), "u").join(full.select(F.col("cls").alias("v"), F.col("items").alias("b")), "v")

    def open_lists(self, lists: DataFrame) -> DataFrame:
        """(key, cls, n, w, root) of the lists in which classes other than the hub are in different components."""
        m = self.rooted(lists.select("key", "cls", "n", "w"), "cls", "root")
        mixed = m.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c")).filter("lo <> hi AND c > 2")
        return cut(m.join(mixed.select("key"), "key"))

    def families(self, lists: DataFrame) -> DataFrame:
        """(hub, cls, n, w, root, top, i, rest) of the members of open lists: their shingles in common with the hub, the component of the hub, and
        the rarest shingles outside it, of which two sets share one if min(i, j) is not enough."""
        hub = lists.groupBy("key").agg(F.max(F.struct("w", "cls", "root")).alias("h"))
        pairs = cut(lists.join(hub, "key").filter("cls <> h.cls").select(F.col("cls").alias("u"), F.col("h.cls").alias("v"), "n", "w", "root", F.col("h.root").alias("top")).distinct())
        both = self._both(pairs)
        return cut(both.select(F.col("v").alias("hub"), F.col("u").alias("cls"), "n", "w", "root", "top", F.size(F.array_intersect("a", "b")).alias("i"),
                               F.slice(F.array_except("a", "b"), F.lit(1), self._missing + 1).alias("rest")))

    def enough(self, family: DataFrame) -> DataFrame:
        """Pairs (u, v) of a family whose numbers alone allow a link; one of them is outside the hub's component."""
        a, b = family.filter("root <> top").alias("a"), family.alias("b")
        need = F.ceil(self.percent * (F.col("a.n") + F.col("b.n")) / (100 + self.percent))
        able = self._near(F.col("a.n"), F.col("b.n")) & (F.least("a.i", "b.i") >= need) & (F.col("a.root") != F.col("b.root"))
        return a.join(b, (F.col("a.hub") == F.col("b.hub")) & able).select(F.least("a.cls", "b.cls").alias("u"), F.greatest("a.cls", "b.cls").alias("v"))

    def residual(self, family: DataFrame) -> DataFrame:
        """The lists (hub, shingle outside it), the hub by hash."""
        return self._shared(family.select("hub", "cls", "n", "w", F.explode("rest").alias("t")).select(F.array(F.xxhash64("hub"), "t").alias("key"), "cls", "n", "w"))

    def settle(self, postings: DataFrame) -> None:
        """All links: by the counts of short lists, then hub by hub in the long ones, whose shorter remainders are paired."""
        self.absorb(self.counted(postings))
        if postings.filter(F.size(self._long()) > 0).isEmpty():
            return
        self.rounds(self.lists(postings, self.boundary(postings)))

    def settle_parts(self, lists: DataFrame) -> None:
        """All links: by the pairs of short lists of equal parts, then hub by hub in the longer ones."""
        self.rounds(self.short(lists))

    def short(self, lists: DataFrame) -> DataFrame:
        """The longer lists that are still open, once the pairs of the shorter ones are settled by their bins."""
        pairs, left = self.paired(self.rooted(lists.select("key", "cls", "n", "w"), "cls", "root"), self.most)
        self.absorb(pairs)
        return self.open_lists(left)

    def rounds(self, lists: DataFrame) -> None:
        """All links of lists, hub by hub, and by pairs where these are few."""
        for _ in range(ROUNDS):
            free(self.docs.sparkSession)
            if lists.isEmpty():
                return
            star = self.stars(lists)
            self.absorb(star.groupBy("cls").agg(F.max(F.struct("w", "u", "v")).alias("p")).select("p.u", "p.v"))
            self.absorb(star)
            pairs, left = self.paired(self.open_lists(lists), self.most / PREFIXES)
            self.absorb(pairs)
            left = cut(left)
            if left.isEmpty():
                return
            family = self.families(left)
            self.absorb(self.enough(family))
            lists = self.residual(family) if self.listed is None else self.short(self.residual(family))
        m = self.rooted(lists.select("key", "cls", "n"), "cls", "root")
        a, b = m.alias("a"), m.alias("b")
        rest = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.cls") < F.col("b.cls")) & (F.col("a.root") != F.col("b.root")) & self._near(F.col("a.n"), F.col("b.n")))
        self.absorb(rest.select(F.col("a.cls").alias("u"), F.col("b.cls").alias("v")))


def groups(docs: DataFrame, *, size: int = 5, percent: int = 80, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, cls, n_shingles, component_id) for every row.

    component_id is the least id that can be reached over links of at least ``percent`` (50 to 100); texts without words (null and
    empty too) are linked with nothing. Rows that repeat an id are rows of their own and share the component of their text; a
    component without any id has a null one. Columns of ``docs`` besides the two named are not used.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    level = None if percent >= PARTED else levels(docs, size, text)
    rows = cut(parts(docs, size, percent, text, id) if level is None else prefixes(docs, size, percent, level, text, id))
    kept = "bins" if level is None else "prefix"
    classes = cut(rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first(kept).alias(kept)))
    join = Join(docs, classes, level, size, percent, text, id)
    if level is None:
        join.settle_parts(join.by_parts(rows))
    else:
        join.settle(join.postings())
    names = join.rooted(classes.select("cls", "doc_id"), "cls", "root")
    least = names.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rows.select("doc_id", "cls", "n").join(names.select("cls", "root").join(least, "root").select("cls", "component_id"), "cls", "left")
    return out.select("doc_id", "cls", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, percent=90).drop("cls")


SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 2], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
f AS (SELECT s, count(*) AS c FROM g GROUP BY s),
p AS (SELECT g.doc_id, g.s, n.n, row_number() OVER (PARTITION BY g.doc_id ORDER BY c, g.s) AS place FROM g JOIN f USING (s) JOIN n USING (doc_id)),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM (SELECT * FROM p WHERE place <= n // 10 + 1) a JOIN (SELECT * FROM p WHERE place <= n // 10 + 1) b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
k AS (SELECT c.a, c.b, count(*) AS i FROM c JOIN g x ON x.doc_id = c.a JOIN g y ON y.doc_id = c.b AND y.s = x.s GROUP BY c.a, c.b),
l AS (SELECT a, b FROM k JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 90 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n"""
