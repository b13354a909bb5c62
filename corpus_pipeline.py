"""Stages that turn raw documents into packed training sequences, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import decontaminate, packing, pii, queries, simhash, toxicity
from ledgerlens.session import cut_lineage

#: Documents handed to Python at a time. The JVM and the worker each hold a batch, texts included, once or more.
BATCH_ROWS = 1_000


def in_small_batches(stage):
    """The stage with the session set to BATCH_ROWS, since its result is computed after it returns; a smaller setting stays."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        if not 0 < rows <= BATCH_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not mark as toxic."""
    model = queries.toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates: SimHash links first, then an exact search for the rest."""
    return simhash.one_of_each_group(docs, shingle_words=5, similarity=0.8, radius=4)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row for each piece of a document and its place."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", in_small_batches(drop_toxic)),
    ("simhash_dedup", in_small_batches(drop_near_copies)),
    ("decontamination", in_small_batches(drop_benchmark_leaks)),
    ("pii", in_small_batches(mask_personal_data)),
    ("packing", in_small_batches(pack_sequences)),
]

#: Learned models, hashing and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
