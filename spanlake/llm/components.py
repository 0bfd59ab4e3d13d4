"""Connected components by repeated contraction, each round written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import stored


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected edges (u, v) with u < v, each once; loops and edges with a null end go."""
    pairs = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), (F.col("u") != F.col("v")).alias("ok"))
    return pairs.where("ok").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges that connect what the edges of one partition connect, batch by batch; never more edges than came in."""
    for b in batches:
        u, v = b["u"].to_numpy(), b["v"].to_numpy()
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        above = np.arange(len(ids))
        x, y = at[: len(u)], at[len(u) :]
        while True:
            low = np.minimum(above[x], above[y])
            before = above.copy()
            np.minimum.at(above, above[x], low)
            np.minimum.at(above, above[y], low)
            np.minimum.at(above, x, low)
            np.minimum.at(above, y, low)
            above = above[above]
            if (above == before).all():
                break
        leaf = np.flatnonzero(above != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[above[leaf]]), pa.array(ids[leaf])], names=["u", "v"])


def components(edges: DataFrame, local: bool = True) -> DataFrame:
    """(id, component) for every id that occurs in edges (u, v: long); component is the smallest id reachable.

    With local, each task first replaces its edges by star edges that connect the same (numpy on Arrow batches), which
    leaves fewer rounds; without, only DataFrame operations are used.

    In a round every node points to the one of lowest rank among itself and its neighbours, and edges are moved to what
    their ends point to. Ranks are the ids for two rounds, after which a star is gone, and then hashes for one, which shrinks a
    path by a constant share in expectation, whatever its numbering. A node's neighbours are only ever folded by min(),
    which combines before the shuffle; no component and no neighbourhood is gathered.
    """
    near = lambda e: canonical(e.where("u <> v").mapInArrow(forest, "u long, v long") if local else e)
    left, levels = stored(near(edges.select("u", "v"))), []
    while not left.isEmpty():
        seed = len(levels)
        if seed % 3 < 2:
            rank = lambda c: F.struct(c.alias("r"), c.alias("id"))
        else:
            rank = lambda c, n=seed: F.struct(F.xxhash64(F.lit(n), c).alias("r"), c.alias("id"))
        both = left.select("u", "v").union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min(rank(F.col("v"))).alias("m"))
        points = stored(lowest.select(F.col("u").alias("id"), F.least("m", rank(F.col("u")))["id"].alias("to")))
        levels.append(points)
        moved = left.join(points.toDF("u", "a"), "u").join(points.toDF("v", "b"), "v")
        left = stored(near(moved.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    if not levels:
        return left.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = levels.pop()
    while levels:
        below = levels.pop()
        roots = below.join(roots.toDF("to", "_top"), "to", "left").select("id", F.coalesce("_top", "to").alias("to"))
    roots = stored(roots)
    smallest = roots.groupBy("to").agg(F.min("id").alias("least"))
    # the root points to itself or is reached only through `to`, so it takes part in the minimum by name
    return roots.join(smallest, "to").select("id", F.least("least", "to").alias("component"))
