"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.session import scratch_path

#: What splits words: the ASCII white space, as a Java character class.
BLANK = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write rows to the shared folder and read them again: cuts the lineage and survives lost executors.

    Unlike a checkpoint, which hands on the estimate of the plan that it cut, the files have a true size; in loops of joins
    those estimates would multiply without bound.
    """
    path = scratch_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Words between ASCII white space; null or blank text gives an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK + "+"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups_for(df: DataFrame, size: Column, target: int) -> int:
    """Number of groups of about target size each, from one pass over the rows; at least one."""
    total = df.agg(F.sum(size).alias("n")).first()["n"] or 0
    return int(total // target) + 1


def text_key(text: Column) -> Column:
    """Tells rows that repeat an id apart by their text."""
    return F.xxhash64(text)


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of docs, with all their columns, whose (doc_id, text) has a row (_id, _text) in kept."""
    same = docs["doc_id"].eqNullSafe(kept["_id"]) & (text_key(docs["text"]) == kept["_text"])
    return docs.join(kept, same, "left_semi")
