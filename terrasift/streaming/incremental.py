"""Incremental jobs with Structured Streaming. Every sink can be replayed after a failure.

State is bounded by the number of result keys or by the watermark. On a cluster set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider, so that state spills to local disk.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from terrasift.functions import feat
from terrasift.sources import tables
from terrasift.streaming.log import Log

BUCKETS = 1024  # of the ids whose state a round keeps


def source(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Part files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run(writer, checkpoint: str) -> None:
    """Process everything available, then stop."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def ingest(stream: DataFrame, sink: str, keys, checkpoint: str) -> None:
    """Append every key once. Which keys were there is keyed state of the query, so a batch reads nothing of what is stored.

    A replayed batch adds nothing. Only where the sink also has rows of another checkpoint (a lost one) are those parts, and no
    others, held against each batch. NULL keys are keys.
    """
    keys = list(keys)

    def batch(df, n):
        log = Log(df.sparkSession, sink)
        state = log.state()
        mine, all_parts = f"rows-{_tag(checkpoint)}", {k: v for k, v in state["tables"].items() if k.startswith("rows-")}
        other = [p for k, parts in all_parts.items() if k != mine for p in parts]
        if other:
            df = tables.missing_keys(df, df.sparkSession.read.parquet(*other), keys)
        log.commit(n, {mine: df}, origin=checkpoint)

    run(stream.dropDuplicates(keys).writeStream.foreachBatch(batch), checkpoint)


def _tag(checkpoint: str) -> str:
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:12]


def ingested(spark: SparkSession, sink: str) -> DataFrame:
    """All rows of an ingest sink."""
    parts = [p for k, ps in Log(spark, sink).state()["tables"].items() if k.startswith("rows-") for p in ps]
    return spark.read.parquet(*parts)


def _latest(t: DataFrame, keys) -> DataFrame:
    """The row of the last batch per key."""
    cols = [c for c in t.columns if c not in {*keys, "batch"}]
    best = t.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("b"), F.max("batch").alias("batch"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in cols], "batch")


def _upsert(sink: str, keys, checkpoint: str):
    """Changed rows of each batch under their batch number; merged parts keep the latest row per key."""

    def batch(df, n):
        Log(df.sparkSession, sink).commit(n, {"rows": df.withColumn("batch", F.lit(n).cast("long"))}, origin=checkpoint, merge=lambda t: _latest(t, keys))

    return batch


def latest(spark: SparkSession, sink: str, keys) -> DataFrame:
    """Current value per key of an upsert sink; its parts are bounded by the log's merges."""
    return _latest(Log(spark, sink).table(), list(keys)).drop("batch")


def season_state(stream: DataFrame, sink: str, checkpoint: str, key="id", ts="dt", v="ndvi") -> None:
    """Running max, min, sum and count per point, agricultural year and season; no history is kept."""
    s = stream.withColumns({"agyear": feat.ag_year(F.col(ts)), "season": feat.season(F.col(ts))})
    g = s.groupBy(key, "agyear", "season").agg(F.max(v).alias("hi"), F.min(v).alias("lo"), F.sum(v).alias("total"), F.count(v).alias("n"))
    run(g.writeStream.outputMode("update").foreachBatch(_upsert(sink, [key, "agyear", "season"], checkpoint)), checkpoint)


def composite(stream: DataFrame, sink: str, checkpoint: str, width_days: int = 16, late_days: int = 16, key="id", ts="dt", v="ndvi") -> None:
    """Tumbling composite per point. A window closes once its end lies ``late_days`` before the newest time of all earlier batches.

    Three tables change together: open windows (sums so far, replaced by each batch), closed ones (appended once, never read
    again) and late rows, whose window was closed when they came, as they came. So a batch reads the open windows only, and no row is
    lost: counts of the windows and late rows add up to the rows with a time.
    """
    spark = stream.sparkSession
    day = F.expr(f"CAST(floor(datediff(CAST({ts} AS DATE), DATE'1970-01-01') / {width_days}) AS INT)")
    sums = [F.max("best").alias("best"), F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("rows").alias("rows")]

    def batch(df, k):
        log = Log(spark, sink)
        state = log.state()
        if log.done(k, checkpoint):
            return
        rows = df.filter(F.col(ts).isNotNull()).withColumn("w", day).persist()
        seen = state["facts"].get("newest")
        newest = rows.agg(F.max(F.expr(f"datediff(CAST({ts} AS DATE), DATE'1970-01-01')"))).first()[0]
        shut = -1 << 31 if seen is None else (seen - late_days) // width_days  # windows below this number are closed
        late = rows.filter(F.col("w") < shut).drop("w")
        fresh = rows.filter(F.col("w") >= shut).groupBy(key, "w").agg(F.max(v).alias("best"), F.sum(v).alias("total"), F.count(v).alias("n"), F.count(F.lit(1)).alias("rows"))
        held = log.table("open", state)
        every = (fresh if held is None else held.unionByName(fresh)).groupBy(key, "w").agg(*sums)
        newest = max(x for x in (seen, newest, -1 << 31) if x is not None)
        edge = (newest - late_days) // width_days
        parts = {"open": every.filter(F.col("w") >= edge), "closed": every.filter(F.col("w") < edge), "late": late}
        log.commit(k, parts, origin=checkpoint, replace=("open",), facts={"newest": newest})
        rows.unpersist()

    run(stream.writeStream.foreachBatch(batch), checkpoint)


def composites(spark: SparkSession, sink: str, width_days: int = 16, key="id") -> DataFrame:
    """(key, start, best, mean, n) of all windows so far, closed and open."""
    log = Log(spark, sink)
    state = log.state()
    w = log.table("closed", state).unionByName(log.table("open", state))
    return w.select(key, F.expr(f"date_add(DATE'1970-01-01', w * {width_days})").alias("start"), "best", F.try_divide("total", "n").alias("mean"), "n")


def late_rows(spark: SparkSession, sink: str) -> DataFrame:
    """The rows that came after their window was closed."""
    return Log(spark, sink).table("late")


def match(samples: DataFrame, scenes: DataFrame, sink: str, checkpoint: str, days: int = 3, tile="tile", ts="ts", scene_ts="scene_ts") -> None:
    """Stream-stream join on tile and at most ``days`` days; both sides' state ends with the watermark."""
    a = samples.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, "1 day").alias("a")
    b = scenes.withColumn(scene_ts, F.col(scene_ts).cast("timestamp")).withWatermark(scene_ts, "1 day").alias("b")
    span = F.expr(f"INTERVAL {days + 1} DAYS")
    on = (F.col(f"a.{tile}") == F.col(f"b.{tile}")) & (F.col(f"b.{scene_ts}") >= F.col(f"a.{ts}") - span) & (F.col(f"b.{scene_ts}") <= F.col(f"a.{ts}") + span)
    diff = F.datediff(F.to_date(f"b.{scene_ts}"), F.to_date(f"a.{ts}"))
    j = a.join(b, on).filter(F.abs(diff) <= days).select("a.id", "b.scene_id", diff.alias("date_difference_days"))
    run(j.writeStream.format("parquet").option("path", sink).outputMode("append"), checkpoint)


def rounds(stream: DataFrame, store: str, usable: Column, checkpoint: str, key: str = "id", buckets: int = BUCKETS) -> None:
    """Late results by rounds: a batch only serves ids without a usable row so far. Which ids have one is keyed state.

    The state is kept by hash buckets of the ids, so a batch makes one call per bucket and not per id; a bucket's state is its ids that have
    a usable row. The number of buckets is fixed for a checkpoint. Long columns pass as text, since pandas turns longs beside NULLs into doubles.
    """
    schema = stream.schema
    longs = [f.name for f in schema if f.dataType == T.LongType()]

    def serve(_, frames, state):
        had = set(state.get[0]) if state.exists else set()
        good = set()
        for f in frames:
            good.update(f.loc[f["__ok"], "__k"])
            yield f.loc[~f["__k"].isin(had)].drop(columns=["__ok", "__k", "__b"])
        if not good <= had:
            state.update((sorted(had | good),))

    def batch(df, n):
        Log(df.sparkSession, store).commit(n, {"rows": df.withColumn("round", F.lit(n))}, origin=checkpoint)

    text = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null"))
    flagged = stream.withColumns({"__ok": F.coalesce(usable, F.lit(False)), "__k": text, "__b": F.pmod(F.xxhash64(text), F.lit(buckets))})
    passing = flagged.withColumns({c: F.col(c).cast("string") for c in longs})
    out = T.StructType([T.StructField(f.name, T.StringType() if f.name in longs else f.dataType) for f in schema])
    open_ids = passing.groupBy("__b").applyInPandasWithState(serve, out, "had array<string>", "append", GroupStateTimeout.NoTimeout)
    back = open_ids.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in longs else F.col(f.name) for f in schema])
    run(back.writeStream.outputMode("append").foreachBatch(batch), checkpoint)


def served(spark: SparkSession, store: str) -> DataFrame:
    """All rows served so far, with their round."""
    return Log(spark, store).table()
