"""Corpus pipeline: quality, toxicity, near-duplicates, benchmark passages, pieces; each stage stored and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrasift.llm import decontam, minhash, pieces, quality, toxicity
from terrasift.session import scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of quality 1 likelier than the threshold of 0.3; the model learns from the stage's own input."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    index = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep(docs, index)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return minhash.keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's pieces, and whether they decode to the text again."""
    return pieces.encode(docs, pieces.model_bytes()).select("doc_id", "lang", "source", "n_pieces", "ids", "round_trip")


STAGES = [
    ("quality", keep_quality),
    ("toxicity", keep_civil),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("pieces", to_pieces),
]
#: The classifiers are learned, so SQL can't give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read back as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
