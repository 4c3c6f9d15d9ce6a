"""Readers, writers and the incremental (resume, retry, next round) table steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.operators.groups import same_keys


def read(spark: SparkSession, path: str, cols=None) -> DataFrame:
    """Parquet scan; a projection reaches the scan's ReadSchema."""
    df = spark.read.parquet(path)
    return df.select(*cols) if cols else df


def read_parts(spark: SparkSession, *globs: str) -> DataFrame:
    """Several part files or folders as one table, missing columns filled."""
    return spark.read.option("mergeSchema", "true").parquet(*globs)


def read_csv(spark: SparkSession, path: str, schema=None, all_text: bool = False) -> DataFrame:
    r = spark.read.option("header", "true")
    if schema is not None:
        return r.schema(schema).csv(path)
    return r.option("inferSchema", str(not all_text).lower()).csv(path)


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Raster as long cells (tile, row, col, value)."""
    return spark.read.parquet(path)


def profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, rows, NULLs. One pass."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"f{i}") for i, c in enumerate(df.columns)])
    items = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("n").alias("rows"), (F.col("n") - F.col(f"f{i}")).alias("nulls"))
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return row.select(F.inline(F.array(*items)))


def peek(df: DataFrame, n: int, *order) -> DataFrame:
    """First n rows in a stated order (TakeOrderedAndProject, no full sort)."""
    return df.orderBy(*order).limit(n)


def write(df: DataFrame, path: str, codec: str = "zstd", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", codec).parquet(path)


def write_verified(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """Write, read back, and report rows written, rows expected and whether the schema is the same."""
    write(df, path, codec, "overwrite")
    back = df.sparkSession.read.parquet(path)
    same = [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in df.schema]
    expected = df.agg(F.count(F.lit(1)).alias("rows_expected"))
    return back.agg(F.count(F.lit(1)).alias("rows_written")).crossJoin(expected).withColumn("same_schema", F.lit(same))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def to_json(*cols) -> Column:
    return F.to_json(F.struct(*cols))


def json_field(c: str, path: str) -> Column:
    return F.get_json_object(F.col(c), path)


def funnel_json(df: DataFrame, steps) -> DataFrame:
    """Cumulative stage counts as one JSON record."""
    from terrasift.functions.clean import known

    acc, cols = F.lit(True), []
    for name, cond in steps:
        acc = acc & known(cond)
        cols.append(F.count_if(acc).alias(name))
    return df.agg(*cols).select(F.to_json(F.struct("*")).alias("log"))


def missing_keys(todo: DataFrame, stored: DataFrame, keys) -> DataFrame:
    """Work not stored yet; a NULL key is stored once like any other."""
    return same_keys(todo, stored.select(*keys).distinct(), keys, "left_anti")


def append_missing(todo: DataFrame, path: str, keys) -> None:
    """Append only rows whose key the store does not hold. A rerun after a crash adds nothing twice.

    The input should hold one row per key; the stored side is read before the append starts.
    """
    spark = todo.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    new = missing_keys(todo, spark.read.parquet(path), keys) if fs.exists(hadoop) else todo
    new.write.mode("append").option("compression", "zstd").parquet(path)


def requeue_failed(results: DataFrame, pairs: DataFrame, keys, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """(results without failures, pairs of the failed keys to fetch again)."""
    bad = F.coalesce(F.col(status).startswith("failed"), F.lit(False))  # a row without a status has not failed
    return results.filter(~bad), same_keys(pairs, results.filter(bad).select(*keys).distinct(), keys, "left_semi")


def next_round(pairs: DataFrame, results: DataFrame, rnd: int, usable: Column, id_col: str = "id", keys=("id", "scene_id")) -> DataFrame:
    """Pairs of the given rank for ids without a usable result, minus the pairs already fetched."""
    done = results.select(*keys).distinct()
    good = results.filter(usable).select(id_col).distinct()
    return pairs.filter(F.col("rank") == rnd).join(good, id_col, "left_anti").join(done, list(keys), "left_anti")


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(F.substring(status, 1, 40).alias("status")).agg(F.count(F.lit(1)).alias("n"))
