"""Small tables with every odd case, shared by the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LONG = "the of and " * 4000 + "x" * 30000

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog.", "en", "src0"),
    (2, None, "en", "src1"),
    (3, "", None, "src0"),
    (4, " \t\n\x0b\f\r ", "de", None),
    (5, LONG, "en", "src0"),
    (6, "Σίσυφος İstanbul ǅ ßtraße 日本語テキスト <|endoftext|> \U0001f600", None, "odd"),
    (7, "The quick brown fox jumps over the lazy dog.", "en", "src0"),
    (7, "The quick brown fox jumps over the lazy dog.", "en", "src0"),
    (None, "a row without id", "fr", "src2"),
    (8, "12 34 !! ?? ***", "es", "src3"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that operators use inside; a table may have them too.
CLASH = ["_text", "_id", "key", "u", "v", "w", "h", "t", "n", "score", "kept", "window", "bucket", "component_id", "n_tokens", "epoch", "domain", "cell", "shard", "rank"]


def clashing(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH if c not in df.columns])


def odd_docs(spark: SparkSession) -> DataFrame:
    return clashing(spark.createDataFrame(TEXTS, SCHEMA))


def no_docs(spark: SparkSession) -> DataFrame:
    return clashing(spark.createDataFrame([], SCHEMA))
