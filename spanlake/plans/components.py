"""Connected components by random contraction, for splitting work into independent parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.session import cut


def _spanning_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each batch as stars around one node of every component of the batch, so paths inside a task are short at once."""
    for b in batches:
        ids, at = np.unique(np.concatenate([b["u"].to_numpy(), b["v"].to_numpy()]), return_inverse=True)
        x, y = at[: b.num_rows], at[b.num_rows :]
        head = np.arange(len(ids))
        while (head[x] != head[y]).any():
            low = np.minimum(head[x], head[y])
            np.minimum.at(head, head[x], low)
            np.minimum.at(head, head[y], low)
            while (head != head[head]).any():
                head = head[head]
        tail = np.flatnonzero(head != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[head[tail]]), pa.array(ids[tail])], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (u, v: long, not null); ids of one component share a component number.

    Each round, every node joins the neighbour of the least hash under that round's seed, if it is less than its own, and chains of
    such choices are cut short once; the graph of what is left shrinks by a constant share in expectation, whatever its
    shape. Only minima are taken per node, and they combine before the shuffle.
    """
    nodes = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    label = cut(nodes.select("id", F.col("id").alias("component")))
    left = cut(edges.where("u <> v").select("u", "v").mapInArrow(_spanning_stars, "u long, v long").distinct())
    seed = 0
    while not left.isEmpty():
        rank = lambda c, s=seed: F.struct(F.xxhash64(F.lit(s), c).alias("h"), c.alias("id"))
        both = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min(rank(F.col("v"))).alias("m"))
        first = near.select(F.col("u").alias("id"), F.least("m", rank(F.col("u")))["id"].alias("to"))
        jumped = first.alias("a").join(first.alias("b"), F.col("a.to") == F.col("b.id")).select("a.id", "b.to")
        points = cut(jumped)
        label = cut(label.join(points.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("to", "component").alias("component")))
        moved = left.join(points.toDF("u", "x"), "u").join(points.toDF("v", "y"), "v").where("x <> y")
        left = cut(moved.select(F.col("x").alias("u"), F.col("y").alias("v")).mapInArrow(_spanning_stars, "u long, v long").distinct())
        seed += 1
    return label
