"""From documents to packed token ids: quality, near-duplicates, benchmark leaks, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm.decontamination import remove_leaks
from foliospark.llm.mixing import mix_sources
from foliospark.llm.near_dedup import keep_one_each
from foliospark.llm.quality import keep_good
from foliospark.llm.token_packing import pack_documents
from foliospark.session import fresh_path, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_each(docs).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("near_dedup", without_copies),
    ("decontamination", without_benchmark),
    ("source_mixing", mixed),
    ("token_packing", packed),
]

#: SQL cannot express the classifier, the sampling signatures, the alignments or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is a table in the shared folder before the next reads it, and what it stored on the way is removed then. Runs all of them but the last while the query is built."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
