"""Streaming jobs: replays, unordered files, crashes between write and commit, bounded parts, and what a batch reads."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from terrasift.streaming import incremental as inc
from terrasift.streaming.log import KEPT, MOST, Log

ROWS = "id long, dt date, ndvi double"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def feed(spark, path, rows, schema=ROWS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_late_rows_have_their_own_table(spark, tmp_path):
    src, sink, ck = (str(tmp_path / n) for n in ("in", "sink", "ck"))
    rng = random.Random(1)
    steps = [[(rng.randrange(5), day(30 * k + rng.randrange(30)), rng.random()) for _ in range(60)] for k in range(5)]
    steps[3] += [(1, day(2), 0.9), (2, day(5), None)]  # long closed
    steps[4] += [(3, day(118), 0.8), (3, None, 0.1)]  # behind the newest, but its window may still be open
    for s in steps:
        feed(spark, src, s)
        inc.composite(inc.source(spark, src, spark.read.parquet(src).schema, 100), sink, ck)
    late = [(r.id, r["dt"]) for r in inc.late_rows(spark, sink).collect()]
    assert {(1, day(2)), (2, day(5))} <= set(late)
    log = Log(spark, sink)
    counted = sum(log.table(t).agg(F.sum("rows")).first()[0] or 0 for t in ("open", "closed"))
    assert counted + len(late) == sum(len(s) for s in steps) - 1  # one row has no time
    got = {(r.id, r.start): (r.best, r.n) for r in inc.composites(spark, sink).collect()}
    want: dict = {}
    gone = list(late)
    for i, d, v in (r for s in steps for r in s if r[1] is not None):
        if (i, d) in gone:
            gone.remove((i, d))
            continue
        start = dt.date(1970, 1, 1) + dt.timedelta(days=(d - dt.date(1970, 1, 1)).days // 16 * 16)
        best, n = want.get((i, start), (None, 0))
        want[i, start] = (v if best is None or (v is not None and v > best) else best, n + (v is not None))
    assert got == want


def test_parts_stay_bounded_and_batches_can_be_replayed(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    for n in range(30):
        df = spark.createDataFrame([(k, n, n) for k in range(n % 4, 6)], "k long, v long, batch long")
        log.commit(n, {"rows": df}, merge=lambda t: inc._latest(t, ["k"]))
        log.commit(n, {"rows": df.withColumn("v", F.lit(-1).cast("long"))})  # a replay changes nothing
        assert len(log.state()["tables"]["rows"]) <= MOST
    folders = [f for f in os.listdir(tmp_path / "log") if f.startswith("rows-")]
    assert len(folders) <= MOST + 1 + KEPT and len(os.listdir(tmp_path / "log" / "_log")) <= 2 * (KEPT + 1)
    got = {r.k: r.v for r in inc.latest(spark, log.path, ["k"]).collect()}
    assert got == {k: max(n for n in range(30) if n % 4 <= k) for k in range(6)}


def test_a_crash_before_the_commit_is_harmless(spark, tmp_path, monkeypatch):
    log = Log(spark, str(tmp_path / "log"))
    one = spark.createDataFrame([(1, 1, 0)], "k long, v long, batch long")
    log.commit(0, {"rows": one})
    with monkeypatch.context() as m:
        m.setattr(Log, "_publish", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            log.commit(1, {"rows": one.withColumn("v", F.lit(2).cast("long"))})
    assert log.state()["last"] == {"": 0} and log.table().count() == 1
    log.commit(1, {"rows": one.withColumn("v", F.lit(3).cast("long"))})
    assert sorted(r.v for r in log.table().collect()) == [1, 3]
    with pytest.raises(RuntimeError):  # a second writer of one version
        log._publish(log.state())


def test_ingest_reads_nothing_of_its_own_store(spark, tmp_path):
    src, sink, ck = (str(tmp_path / n) for n in ("in", "sink", "ck"))
    for k in range(3):
        feed(spark, src, [(i, day(0), 1.0) for i in range(10 * k, 10 * k + 15)] + [(None, day(0), 0.0)])
        inc.ingest(inc.source(spark, src, spark.read.parquet(src).schema, 100), sink, ["id"], ck)
        if k == 0:
            first = next(iter(Log(spark, sink).state()["tables"].values()))
            assert spark.read.parquet(*first).count() == 16
            os.rename(first[0].removeprefix("file:"), tmp_path / "away")  # later batches do without the stored rows
    os.rename(tmp_path / "away", first[0].removeprefix("file:"))
    assert sorted(r.id for r in inc.ingested(spark, sink).collect() if r.id is not None) == list(range(35))
    assert inc.ingested(spark, sink).filter("id IS NULL").count() == 1
    inc.ingest(inc.source(spark, src, spark.read.parquet(src).schema, 100), sink, ["id"], str(tmp_path / "other"))  # a lost checkpoint
    assert inc.ingested(spark, sink).count() == 36


def test_rounds_serve_only_open_ids(spark, tmp_path):
    src, store, ck = (str(tmp_path / n) for n in ("in", "store", "ck"))
    schema = "id long, scene string, ok boolean"
    for rows in ([(1, "a", True), (2, "a", False), (3, "a", None)], [(1, "b", True), (2, "b", True), (2, "c", False), (3, "b", False)], [(1, "d", True), (2, "d", False), (3, "d", True)]):
        feed(spark, src, rows, schema)
        inc.rounds(inc.source(spark, src, spark.read.parquet(src).schema, 100), store, F.col("ok"), ck)
    got = sorted((r.id, r.scene, r["round"]) for r in inc.served(spark, store).collect())
    assert got == [(1, "a", 0), (2, "a", 0), (2, "b", 1), (2, "c", 1), (3, "a", 0), (3, "b", 1), (3, "d", 2)]


def test_rounds_of_one_bucket_keep_long_ids_and_null_ids(spark, tmp_path):
    """Ids that share a state bucket are told apart, longs beside NULLs stay exact, and NULL is an id of its own."""
    from terrasift.streaming import incremental as inc

    big = 2**60 + 1
    steps = [[(big, None, True), (7, 1, False), (None, big, False)], [(big, 2, True), (7, big, True), (None, 3, True)], [(7, 4, True), (None, 5, True), (8, 6, False)]]
    path, store, ck = (str(tmp_path / n) for n in ("in", "store", "ck"))
    for rows in steps:
        df = spark.createDataFrame(rows, "id long, scene_id long, ok boolean").coalesce(1)
        df.write.mode("append").parquet(path)
        inc.rounds(inc.source(spark, path, df.schema, 100), store, F.col("ok"), ck, buckets=1)
    got = sorted(((r["id"], r["scene_id"], r["round"]) for r in inc.served(spark, store).collect()), key=str)
    assert got == sorted([(big, None, 0), (7, 1, 0), (None, big, 0), (7, big, 1), (None, 3, 1), (8, 6, 2)], key=str)
