"""Interval join by time bins.

Both sides are cut into bins of one width and joined on (keys, bin), so a long clip spreads over
many join keys. With the mean duration as width the copies stay below three per row on average.
A pair that shares several bins is kept only in the bin that holds the later of the two starts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions.intervals import intersection, tiou


def mean_duration(*dfs: DataFrame) -> float:
    spans = reduce(
        DataFrame.unionByName,
        [d.select(F.count("*").alias("n"), F.sum(F.col("t_end") - F.col("t_start")).alias("s")) for d in dfs],
    )
    row = spans.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    if not row["n"] or not row["s"] or row["s"] <= 0:
        return 1.0
    return float(row["s"]) / float(row["n"])


def with_bins(df: DataFrame, start: str, end: str, width: float) -> DataFrame:
    first = F.floor(F.col(start) / width)
    last = F.greatest(first, F.floor(F.col(end) / width))
    return df.withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: float | None = None) -> DataFrame:
    """Pairs of rows of a and b with equal keys whose [t_start, t_end] strictly intersect.

    Non-key columns come back prefixed a_ and b_, with inter (overlap length) and tiou.
    """
    width = width or mean_duration(a, b)

    def side(df: DataFrame, p: str) -> DataFrame:
        named = df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys])
        return with_bins(named, f"{p}_t_start", f"{p}_t_end", width)

    s1, e1, s2, e2 = (F.col(c) for c in ("a_t_start", "a_t_end", "b_t_start", "b_t_end"))
    return (
        side(a, "a")
        .join(side(b, "b"), [*keys, "_bin"])
        .where((s1 < e2) & (s2 < e1) & (F.floor(F.greatest(s1, s2) / width) == F.col("_bin")))
        .drop("_bin")
        .withColumn("inter", intersection(s1, e1, s2, e2))
        .withColumn("tiou", tiou(s1, e1, s2, e2))
    )
