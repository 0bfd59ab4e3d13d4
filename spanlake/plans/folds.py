"""Sequential folds over many bounded groups: rows sorted by key pass in Arrow batches, so a small group costs no call of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanlake.session import shuffle_width


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, bounds) of whole groups from batches sorted by keys; group i is rows bounds[i] to bounds[i + 1]."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch] if carry is None else [carry, batch]).combine_chunks().to_batches()[0]
        fresh = np.zeros(held.num_rows, bool)
        fresh[0] = True
        for k in keys:
            number = held[k].dictionary_encode(null_encoding="encode").indices.to_numpy()
            fresh[1:] |= number[1:] != number[:-1]
        starts = np.flatnonzero(fresh)
        if starts[-1]:
            yield held.slice(0, int(starts[-1])), starts
        carry = held.slice(int(starts[-1]))
    if carry is not None:
        yield carry, np.array([0, carry.num_rows])


def fold_groups(df: DataFrame, keys: list[str], fold: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema) -> DataFrame:
    """fold(rows, bounds) over all groups of df; groups must be of bounded size, as one lies in a task as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_groups(batches, keys):
            yield fold(rows, bounds)

    # an explicit width keeps the fold parallel where a small shuffle would be merged into one task
    return df.repartition(shuffle_width(df.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
