"""Sinks: tables per clip, label lines; nested submissions are in submission.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, by: str | None = "clip_id") -> None:
    """Tab-separated files with header, one folder per clip.

    Rows are sorted by clip inside their task, so a task keeps one file open at a time and a large
    clip may be written by many tasks.
    """
    if by is None:
        df.write.csv(path, sep="\t", header=True)
        return
    df.sortWithinPartitions(by).write.partitionBy(by).csv(path, sep="\t", header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def label_lines(frames: DataFrame, labels: DataFrame, split: str, path: str = "path", on: tuple = ("clip_id", "frame_index")) -> DataFrame:
    """Text lines "<path> <label>" per (clip, frame, label) of one split."""
    rows = frames.where(F.col("subset") == split).join(labels, list(on))
    return rows.select(F.concat_ws(" ", path, F.col("label").cast("string")).alias("value"))


def write_label_lines(frames: DataFrame, labels: DataFrame, split: str, out: str, **names) -> None:
    label_lines(frames, labels, split, **names).write.text(out)
