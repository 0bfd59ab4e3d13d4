"""The corpus pipeline: language ID, quality rules, near-duplicate removal, mixing and packing, stage after stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanlake.llm import language_id, mixture_tree, near_dedup, packing_tiers, quality_llr
from spanlake.llm.common import table
from spanlake.session import scratch_path

#: Share of the tokens left after filtering that the mixture takes.
MIX_SHARE = (9, 10)


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough confidence; the model learns from docs that are not held out."""
    model = language_id.language_model(docs)
    return docs.where(~language_id.predicted(model, docs["text"])["rejected"])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio against the documents labelled good."""
    return quality_llr.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the token budget of their domain, language and source takes, each once at most."""
    return mixture_tree.keep_mixed(docs, MIX_SHARE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of all documents that are left."""
    return packing_tiers.pack(docs)


STAGES = [
    ("language_id", tell_language),
    ("quality_rules", keep_good),
    ("near_dedup", drop_copies),
    ("mixture", mix),
    ("packing", pack),
]
#: The stages run a trained model, a tokenizer and hashes that SQL lacks; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each one's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
