"""Distributed ordered scans: running sums, maxima and last values without one task per key.

A plain window over a key sends all rows of that key to one task. Here rows are first
range-partitioned by (key, order), so a hot key spreads over many partitions. Each
(partition, key) run is scanned locally and the totals of the earlier runs of the same key,
at most one row per partition and key, are added as a carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.session import cut, shuffle_width

KINDS = ("sum", "max", "min", "last")


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    outputs: dict[str, tuple[str, Column, bool]],
    partitions: int | None = None,
) -> DataFrame:
    """Add one running value per output: name -> (kind, expression, inclusive).

    kind is sum, max, min or last (last non-null). order must be total within a key for the
    result to be unique. Keys must not be null. The ranged rows are checkpointed, because the
    local scan and the carry must see the same partition numbers.
    """
    for kind, _, _ in outputs.values():
        if kind not in KINDS:
            raise ValueError(f"unknown scan kind {kind}")
    width = partitions or shuffle_width(df.sparkSession)
    names = list(outputs)
    staged = df.select("*", *[outputs[n][1].alias(f"_v_{n}") for n in names])
    ranged = cut(
        staged.repartitionByRange(width, *[F.col(k) for k in keys], *order).withColumn(
            "_scan_run", F.spark_partition_id()
        )
    )
    by_run = Window.partitionBy("_scan_run", *keys).orderBy(*order)
    until_here = by_run.rowsBetween(Window.unboundedPreceding, 0)
    before = by_run.rowsBetween(Window.unboundedPreceding, -1)
    folds = {
        "sum": F.sum,
        "max": F.max,
        "min": F.min,
        "last": lambda c: F.last(c, ignorenulls=True),
    }
    local = ranged.select(
        "*",
        F.row_number().over(by_run).alias("_scan_pos"),
        *[
            folds[outputs[n][0]](F.col(f"_v_{n}")).over(until_here if outputs[n][2] else before).alias(f"_l_{n}")
            for n in names
        ],
        *[F.last(f"_v_{n}", ignorenulls=True).over(until_here).alias(f"_z_{n}") for n in names if outputs[n][0] == "last"],
    )

    def total(n: str) -> Column:
        if outputs[n][0] == "last":
            return F.max_by(f"_z_{n}", "_scan_pos").alias(f"_t_{n}")
        return folds[outputs[n][0]](F.col(f"_v_{n}")).alias(f"_t_{n}")

    totals = local.groupBy("_scan_run", *keys).agg(*[total(n) for n in names])
    earlier = Window.partitionBy(*keys).orderBy("_scan_run").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        "_scan_run", *keys, *[folds[outputs[n][0]](F.col(f"_t_{n}")).over(earlier).alias(f"_c_{n}") for n in names]
    )

    def combine(n: str) -> Column:
        a, c = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        kind = outputs[n][0]
        if kind == "sum":
            zero = F.lit(0)
            return (F.coalesce(a, zero) + F.coalesce(c, zero)).alias(n)
        if kind == "max":
            return F.greatest(a, c).alias(n)
        if kind == "min":
            return F.least(a, c).alias(n)
        return F.coalesce(a, c).alias(n)

    keep = [c for c in df.columns if c not in names]
    return local.join(carry, ["_scan_run", *keys], "left").select(*keep, *[combine(n) for n in names])


def global_index(df: DataFrame, order: list[Column], name: str = "idx", partitions: int | None = None) -> DataFrame:
    """Dense zero-based position in a total order, computed without one sorting task."""
    return ordered_scan(df, [], order, {name: ("sum", F.lit(1).cast("long"), False)}, partitions)


def keyed_index(df: DataFrame, keys: list[str], order: list[Column], name: str = "idx") -> DataFrame:
    """Zero-based position within each key; a hot key is spread over partitions."""
    return ordered_scan(df, keys, order, {name: ("sum", F.lit(1).cast("long"), False)})


def draw_key(seed: int | str, *cols: Column) -> Column:
    """Seeded pseudo-random order key, equal in every engine that has md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def draw_unit(seed: int | str, *cols: Column) -> Column:
    """Seeded uniform value in [0, 1): the first 12 hex digits of the draw key over 16^12."""
    return F.conv(F.substring(draw_key(seed, *cols), 1, 12), 16, 10).cast("long") / F.lit(float(16**12))
