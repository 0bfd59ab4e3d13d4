"""Incremental meters, dedup, activity runs, average precision and covariance over streams.

The first three are stateful streaming plans bounded by a watermark: rows later than it are dropped and state older than it is
freed. They run in update or append mode; what a micro-batch updates is written under its batch id, so a batch that is repeated after a
failure replaces its rows, and a key's last batch holds its value. Average precision and covariance
keep mergeable sums in the same way, which are added up when read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.operators.retrieval import steps_average_precision


def stream_meters(stream: DataFrame, time: str, value: str, weight: str | None = None, window: str = "1 hour", slide: str | None = None, watermark: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """Weighted average, sum, count and rate per second for each event-time window (and key).

    A window is a scope: it starts empty and closes when the watermark passes it. Ratios are formed
    after the aggregation.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    win = F.window(time, window, slide) if slide else F.window(time, window)
    agg = (
        stream.withWatermark(time, watermark)
        .groupBy(win.alias("w"), *(keys or []))
        .agg(F.sum(F.col(value) * w).alias("weighted"), F.sum(w).alias("weight"), F.sum(value).alias("total"), F.count("*").alias("n"))
    )
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return agg.select(
        F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), *(keys or []),
        F.try_divide("weighted", "weight").alias("avg"), "total", "n", (F.col("n") / seconds).alias("rate"),
    )


def stream_dedup_lines(stream: DataFrame, time: str, text: str, watermark: str = "1 hour") -> DataFrame:
    """First row of each text within the watermark; the state holds a 16-byte digest per text."""
    return stream.withColumn("line_md5", F.md5(text)).withWatermark(time, watermark).dropDuplicatesWithinWatermark(["line_md5"])


def stream_islands(stream: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Activity runs per key: events closer than gap belong to one run, which ends gap after its last event."""
    return (
        stream.withWatermark(time, watermark)
        .groupBy(*keys, F.session_window(time, gap).alias("s"))
        .agg(F.count("*").alias("n"))
        .select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
    )


# ---- tables of batches ---------------------------------------------------------------------


def partial_writer(path: str, partial=lambda batch: batch):
    """foreachBatch function that writes partial(batch) under its batch id; a repeated batch replaces what it wrote."""

    def write(batch: DataFrame, batch_id: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def read_partials(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of all batches written so far, with their batch_id."""
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch_id=*")


def latest(rows: DataFrame, keys: list[str], batch: str = "batch_id") -> DataFrame:
    """The value of each key from the last batch that updated it; folds before the shuffle."""
    values = [c for c in rows.columns if c not in (*keys, batch)]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), batch).alias("_v"))
    return last.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


SCORE_STATE = "label int, score double, pos long, n long"


def score_state(batch: DataFrame) -> DataFrame:
    """(label, score, pos, n): one row per distinct score, exact and mergeable; rows without a score take no part."""
    known = batch.where("score IS NOT NULL AND label IS NOT NULL")
    return known.groupBy("label", F.col("score").cast("double").alias("score")).agg(
        F.sum(F.col("target").cast("long")).alias("pos"), F.count("*").alias("n")
    )


def stream_ap(stream: DataFrame, path: str):
    """Writer that adds every batch to the score states at path; read with ap_from_state."""
    return stream.writeStream.foreachBatch(partial_writer(path, score_state))


def ap_from_state(state: DataFrame) -> DataFrame:
    """(label, ap) of all scores seen so far, by an ordered scan over the merged states; equal scores form one step.

    With distinct scores this is average_precision of all rows at once, whatever their range and number.
    """
    merged = state.groupBy("label", "score").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    return steps_average_precision(merged, ["label"])


def moment_sums(batch: DataFrame, vec: str = "embedding") -> DataFrame:
    """(i, j, v, n): sums of x_i x_j for i <= j and, at j = -1, of x_i; as many rows as the matrix has cells."""
    import numpy as np
    import pandas as pd

    def per_task(it):
        n, s, m = 0, None, None
        for pdf in it:
            x = np.stack(pdf[vec].to_numpy()).astype(float) if len(pdf) else None
            if x is None:
                continue
            n += len(x)
            s = x.sum(0) if s is None else s + x.sum(0)
            m = x.T @ x if m is None else m + x.T @ x
        if n:
            i, j = np.triu_indices(len(s))
            yield pd.DataFrame({
                "i": np.concatenate([np.arange(len(s)), i]).astype("int32"),
                "j": np.concatenate([np.full(len(s), -1), j]).astype("int32"),
                "v": np.concatenate([s, m[i, j]]), "n": n,
            })

    # one small matrix per task, merged by a hash aggregate
    part = batch.select(vec).mapInPandas(per_task, "i int, j int, v double, n long")
    return part.groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))


def stream_covariance(stream: DataFrame, path: str, vec: str = "embedding"):
    """Writer that adds every batch to the moment sums at path; read with covariance_from_sums."""
    return stream.writeStream.foreachBatch(partial_writer(path, lambda b: moment_sums(b, vec)))


def covariance_from_sums(sums: DataFrame) -> DataFrame:
    """(i, j, cov) for i <= j: sample covariance from the merged moment sums."""
    m = sums.groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    mean = m.where("j = -1").select(F.col("i").alias("k"), F.col("v").alias("s"))
    a = mean.select(F.col("k").alias("i"), F.col("s").alias("si"))
    b = mean.select(F.col("k").alias("j"), F.col("s").alias("sj"))
    return m.where("j >= 0").join(a, "i").join(b, "j").select(
        "i", "j", ((F.col("v") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)).alias("cov")
    )
