"""Filter interaction audit by failing-id relations: one stored id table per filter, prefixes by left-anti and left-semi joins.

What a prefix of filters leaves depends on the set of its filters alone, so the 2**m sets stand for all m! orders. Level k holds the
survivors of every set of k filters, among the rows that fail anything: a left-anti join of a set's survivors with one more
filter's id table gives those of the larger set, a left-semi join gives what that filter removes there. Rows that fail nothing
survive every prefix and are only counted.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.session import scratch

ORDER_COLUMNS = "filter_order string, step int, f int, seen int, after int"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: what follows does not depend on lost executors."""
    path = scratch(df.sparkSession, f"audit-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def words(text: Column) -> Column:
    """The maximal runs of characters that are no ASCII white space."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", " " * 5), " "), "")


def rules(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that see one text: short, repetitive, shouting, with symbols."""
    w = words(text)
    n, kinds = F.size(w), F.size(F.array_distinct(w))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 50, "B": 100 * kinds < 65 * n, "C": 100 * capitals > 5 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def later_copies(rows: DataFrame, *, id: str, digest: str) -> DataFrame:
    """Rows whose digest a smaller id has too. Each digest's least (id, digest) is grouped with map-side minima and taken away by a
    left-anti join on both, so a digest with very many rows never meets in one task. Rows without an id are never later copies."""
    first = rows.filter(F.col(id).isNotNull()).groupBy(digest).agg(F.min(id).alias(id))
    return rows.filter(F.col(id).isNotNull()).join(first, [id, digest], "left_anti")


def relations(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", part: str = "source") -> tuple[DataFrame, dict[str, DataFrame]]:
    """The stored id table (rid, part, good, toxic) of all rows, and per filter A-E the stored table (rid) of the rows that fail it.

    ``rid`` numbers rows, so repeated and null ids stay apart. Null texts are empty, null parts are ''. A row is good (toxic) if any
    label row of its id has quality (toxic) 1; a null id has no labels. Filter E fails rows whose text a smaller id has. Columns of
    ``docs`` besides the three named are not used.
    """
    t = F.coalesce(text, F.lit(""))
    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id).cast("long").alias("__id"), F.coalesce(part, F.lit("")).alias("part"), t.alias("__text"))
    fails = F.array_compact(F.array(*(F.when(c, F.lit(f)) for f, c in rules(F.col("__text")).items())))
    facts = stored(own.select("rid", "__id", "part", F.unhex(F.sha2("__text", 256)).alias("digest"), fails.alias("fails")), "facts")
    by_text = stored_by_filter(facts.select(F.explode("fails").alias("filter"), "rid"), "ABCD")
    failing = by_text | {"E": stored(later_copies(facts.select("rid", "__id", "digest"), id="__id", digest="digest").select("rid"), "E")}
    marks = labels.filter(F.col(id).isNotNull()).groupBy(F.col(id).cast("long").alias("__id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    ids = facts.select("rid", "__id", "part").join(marks, "__id", "left").select("rid", "part", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    return stored(ids, "ids"), failing


def stored_by_filter(rows: DataFrame, names: str) -> dict[str, DataFrame]:
    """One id table per filter from rows (filter, rid), written in one pass; a filter that nothing fails has an empty table."""
    spark = rows.sparkSession
    path = scratch(spark, "audit-failing")
    rows.write.partitionBy("filter").parquet(path)
    table = spark.read.schema("rid long, filter string").parquet(path)
    return {f: table.filter(F.col("filter") == f).select("rid") for f in names}


def prefixes(ids: DataFrame, failing: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(part, seen, f, removed, good_lost, toxic_lost) per set of earlier filters and next filter, and (part, seen, kept) per set.

    ``seen`` has bit i set for the i-th filter. Combinations without rows are absent. ``ids``: (rid, part, good, toxic); each of
    ``failing``: (rid).
    """
    tables = list(failing.values())
    anything = tables[0]
    for t in tables[1:]:
        anything = anything.unionByName(t)
    clean = ids.join(anything, "rid", "left_anti").groupBy("part").agg(F.count(F.lit(1)).alias("kept"))
    level = stored(ids.join(anything, "rid", "left_semi").withColumn("seen", F.lit(0)), "level-0")
    removals, kept = [], []
    for k in range(len(tables) + 1):
        kept.append(level.groupBy("part", "seen").agg(F.count(F.lit(1)).alias("kept")))
        if k == len(tables):
            break
        larger, gone = [], []
        for i, fails in enumerate(tables):
            removed = level.filter(F.col("seen").bitwiseAND(F.lit(1 << i)) == 0).join(fails, "rid", "left_semi")
            gone.append(removed.groupBy("part", "seen").agg(
                F.count(F.lit(1)).alias("removed"), F.count_if("good").alias("good_lost"), F.count_if("toxic").alias("toxic_lost")).withColumn("f", F.lit(i)))
            if i >= k:  # sets are built in the order of the filters, so each is reached once
                larger.append(level.filter(F.col("seen") < (1 << i)).join(fails, "rid", "left_anti").withColumn("seen", F.col("seen").bitwiseOR(F.lit(1 << i))))
        removals.append(stored(_union(gone), f"removed-{k}"))
        level = stored(_union(larger), f"level-{k + 1}")
    sets = stored(_union(kept), "kept")
    every = clean.select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(tables)) - 1))).alias("seen"), "kept")
    return _union(removals), sets.unionByName(every).groupBy("part", "seen").agg(F.sum("kept").alias("kept"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orders(names: str) -> list[tuple[str, int, int, int, int]]:
    """(order, step, filter, set of the filters before, set with it) for all orders of the filters; m * m! rows."""
    out = []
    for p in permutations(names):
        seen = 0
        for step, name in enumerate(p, 1):
            i = names.index(name)
            out.append(("".join(p), step, i, seen, seen | 1 << i))
            seen |= 1 << i
    return out


def audit(ids: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    No rows for an empty table. Parts whose rows fail nothing have their rows, with zeros.
    """
    spark, m, names = ids.sparkSession, len(failing), "".join(failing)
    removed, kept = prefixes(ids, failing)
    pairs = [(s, i) for s in range(1 << m) for i in range(m) if not s >> i & 1]
    parts = ids.select("part").distinct()
    zeros = parts.select("part", F.explode(F.array(*(F.struct(F.lit(s).alias("seen"), F.lit(i).alias("f")) for s, i in pairs))).alias("p")).select("part", "p.seen", "p.f", *(F.lit(0).cast("long").alias(c) for c in ("removed", "good_lost", "toxic_lost")))
    cells = stored(removed.unionByName(zeros).groupBy("part", "seen", "f").agg(*(F.sum(c).alias(c) for c in ("removed", "good_lost", "toxic_lost"))), "cells")
    before = F.bit_count("seen")
    ways = F.element_at(F.array(*(F.lit(factorial(k) * factorial(m - 1 - k)) for k in range(m))), before.cast("int") + 1)
    alone = (1 << m) - 1
    totals = cells.groupBy("part", "f").agg(
        F.sum(F.when(F.col("seen") == 0, F.col("removed")).otherwise(0)).alias("fails"),
        F.sum(F.when(before == m - 1, F.col("removed")).otherwise(0)).alias("unique_fails"),
        F.sum(ways * F.col("removed")).alias("shapley"))
    steps = F.broadcast(spark.createDataFrame(orders(names), ORDER_COLUMNS))  # m * m! rows, whatever the input
    none = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit(alone))).alias("after"), F.lit(0).cast("long").alias("kept"))
    left = kept.select("part", F.col("seen").alias("after"), "kept").unionByName(none).groupBy("part", "after").agg(F.sum("kept").alias("kept"))
    wide = cells.join(totals, ["part", "f"]).join(steps, ["seen", "f"]).join(left, ["part", "after"])
    return wide.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def query(spark, sf_dir: str) -> DataFrame:
    return audit(*relations(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT t, min(doc_id) AS least FROM w GROUP BY t),
b AS (SELECT w.part, w.doc_id, [len(w.w) < 50, 100 * len(list_distinct(w.w)) < 65 * len(w.w), 100 * (length(w.t) - length(translate(w.t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(w.t),
 regexp_matches(w.t, '[#$%&*|]'), coalesce(w.doc_id > m.least, false)] AS x FROM w JOIN m ON m.t = w.t),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, sum(CASE WHEN x[i] THEN 1 << (i - 1) ELSE 0 END)::INT AS bits, any_value(good) AS good, any_value(toxic) AS toxic
 FROM (SELECT row_number() OVER () AS r, part, x, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM b LEFT JOIN l USING (doc_id)), (SELECT unnest([1, 2, 3, 4, 5]) AS i) GROUP BY r, part),
c AS (SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, bits),
o(filter_order, seen, step, i) AS (SELECT '', 0, 0, 0 UNION ALL SELECT filter_order || substr('ABCDE', k, 1), seen | (1 << (k - 1)), step + 1, k FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE seen & (1 << (k - 1)) = 0),
s AS (SELECT z.filter_order, o.step, 1 << (o.i - 1) AS own, o.seen - (1 << (o.i - 1)) AS before FROM o JOIN o z ON z.step = 5 AND o.step > 0 AND starts_with(z.filter_order, o.filter_order)),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (bits & (own | before) = 0), 0) AS kept, coalesce(sum(n) FILTER (bits & own <> 0 AND bits & before = 0), 0) AS removed,
 coalesce(sum(n) FILTER (bits & own <> 0 AND bits & before <> 0), 0) AS redundant, coalesce(sum(n) FILTER (bits = own), 0) AS unique_fails,
 coalesce(sum(good) FILTER (bits & own <> 0 AND bits & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (bits & own <> 0 AND bits & before = 0), 0) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
 (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""
