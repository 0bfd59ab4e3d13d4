"""Approximate nearest neighbours with a vantage-point tree per shard.

Vectors are dealt to cells by their nearest pivot; pivots come from a bounded sample (the SAMPLE vectors of lowest hash),
every vector is indexed. A cell of more than shard_rows is split by hash, so a hot vector fills several shards. A query
first searches the shards of its own cell, which bounds its k-th distance; it then goes to those other cells that may hold
something nearer. Inside a shard a vantage-point tree is descended for a block of queries at once.

A cell or subtree at least b away (by the triangle inequality) is skipped if factor * b exceeds the k-th distance so far.
factor = 1 gives the exact result; a larger factor visits less and may miss neighbours.

Shards and query blocks are bounded, and a task holds one of each. Scores are sums of squares in double precision, taken
component by component.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those of
another length than most have (ties: the shorter length), nor rows with a null vec_id; rows that repeat a vec_id count once,
with the smallest vector; ties in distance go to the smaller vec_id; fewer than k candidates are all returned; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import stored

FACTOR = 1.0
SHARD_ROWS = 8192
QUERY_BLOCK = 1024
#: Share of the distances that every bound gives up, so that rounding hides no tie.
ROUNDING = 1e-12
SAMPLE = 4096
MOST_CELLS = 256
LEAF = 256
FOUND = "query_id long, vec_id long, score double"


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """(queries, points): Euclidean distances, squares added component by component."""
    total = np.zeros((len(queries), len(points)))
    for a, b in zip(queries.T, points.T, strict=True):
        total += (a[:, None] - b[None, :]) ** 2
    return np.sqrt(total)


class VpTree:
    """Vantage points with median radii; leaves of LEAF points, larger only if all are equally far from their vantage point."""

    def __init__(self, points: np.ndarray, seed: int = 5):
        self.points = points
        self.nodes: list[tuple] = []
        draw = np.random.default_rng(seed)
        stack = [(np.arange(len(points)), None, 0)]
        while stack:
            rows, parent, side = stack.pop()
            if parent is not None:
                self.nodes[parent][side] = len(self.nodes)
            if len(rows) > LEAF:
                tries, trial = draw.choice(rows, 4), draw.choice(rows, 64)
                best = int(tries[np.argmax(distances(points[tries], points[trial]).var(1))])
                d = distances(points[[best]], points[rows])[0]
                middle = float(np.median(d))
                inside = d <= middle
                if not inside.all():
                    self.nodes.append([best, middle, -1, -1])
                    stack += [(rows[inside], len(self.nodes) - 1, 2), (rows[~inside], len(self.nodes) - 1, 3)]
                    continue
            self.nodes.append([rows])

    def bounds(self, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows of each leaf, and how far each query is from it at least."""
        leaves, stack = [], [(0, np.zeros(len(queries)))]
        while stack:
            node, bound = stack.pop()
            entry = self.nodes[node]
            if len(entry) == 1:
                leaves.append((entry[0], bound))
                continue
            vantage, middle, inner, outer = entry
            d = distances(queries, self.points[[vantage]])[:, 0]
            slack = ROUNDING * (d + middle)
            stack += [(inner, np.maximum(bound, d - middle - slack)), (outer, np.maximum(bound, middle - d - slack))]
        return leaves

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, factor: float, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Row and distance of the k nearest per query (-1 where there are fewer), and how many distances were taken.

        own holds the id that a query must not find, reach a distance that is known to suffice. A block of queries goes
        through a leaf together: first each query through the leaf that it lies in, then through the others by rising
        bound, as far as its k-th distance asks for.
        """
        at = np.full((len(queries), k), -1)
        near = np.full((len(queries), k), np.inf)
        limit = reach.copy()
        taken = 0
        leaves = self.bounds(queries)
        rising = sorted(range(len(leaves)), key=lambda i: leaves[i][1].mean())
        for home, order in ((True, range(len(leaves))), (False, rising)):
            for i in order:
                rows, bound = leaves[i]
                who = np.flatnonzero(bound <= 0) if home else np.flatnonzero((bound > 0) & (factor * bound <= limit))
                if not len(who):
                    continue
                d = distances(queries[who], self.points[rows])
                taken += d.size
                d[ids[rows][None, :] == own[who][:, None]] = np.inf
                some = d <= limit[who][:, None]
                keep = np.flatnonzero(some.any(1))
                if not len(keep):
                    continue
                columns = np.flatnonzero(some.any(0))
                who, d, rows = who[keep], d[np.ix_(keep, columns)], rows[columns]
                all_d = np.concatenate([near[who], d], 1)
                all_at = np.concatenate([at[who], np.broadcast_to(rows, d.shape)], 1)
                # distance first, then id
                first = np.lexsort((np.where(all_at >= 0, ids[all_at], np.iinfo(np.int64).max), all_d), axis=1)[:, :k]
                near[who] = np.take_along_axis(all_d, first, 1)
                at[who] = np.where(np.isfinite(near[who]), np.take_along_axis(all_at, first, 1), -1)
                limit[who] = np.minimum(limit[who], near[who][:, -1])
        return at, near, taken


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Cells:
    pivots: np.ndarray
    radius: np.ndarray
    shards: np.ndarray  # how many shards a cell has


def choose_pivots(sample: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """n centres of the sample after a few Lloyd steps."""
    centres = sample[np.sort(np.random.default_rng(seed).permutation(len(sample))[:n])]
    for _ in range(5):
        nearest = distances(sample, centres).argmin(1)
        centres = np.array([sample[nearest == i].mean(0) if (nearest == i).any() else c for i, c in enumerate(centres)])
    return centres


def stack_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def searched(index: DataFrame, probes: DataFrame, query_block: int, k: int, factor: float) -> DataFrame:
    """The k nearest of each probe (shard, query_id, q, reach) within its shard.

    A shard's probes are dealt to blocks of about query_block, and the shard is copied once for each block that visits it.
    """

    def run(points: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not (points.num_rows and asked.num_rows):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        points = points.sort_by("vec_id")
        ids, own = points["vec_id"].to_numpy(), asked["query_id"].to_numpy()
        at, near, _ = VpTree(stack_of(points["v"])).search(stack_of(asked["q"]), own, ids, k, factor, asked["reach"].to_numpy())
        query, place = np.nonzero(at >= 0)
        return pa.table([own[query], ids[at[query, place]], near[query, place]], names=names)

    probes = stored(probes)
    visits = stored(probes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / query_block).alias("blocks")))
    left = index.join(visits, "shard").select("shard", "vec_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    right = probes.join(visits, "shard").select("shard", "query_id", "q", "reach", F.pmod(F.xxhash64("query_id"), F.col("blocks")).alias("block"))
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, FOUND)


def nearest(
    vectors: DataFrame,
    k: int = 10,
    every: int = 100,
    factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each vector whose vec_id is divisible by every."""
    if factor < 1:
        raise ValueError("factor is at least 1")
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == common["d"]).groupBy("vec_id").agg(F.min("v").alias("v"))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    pivots = choose_pivots(stack_of(drawn["v"]), min(MOST_CELLS, -(-common["count"] // shard_rows), drawn.num_rows))

    @F.pandas_udf("struct<cell:int,d:double>")
    def cell_of(v: pd.Series) -> pd.DataFrame:
        d = distances(np.stack(v.to_numpy()), pivots) if len(v) else np.zeros((0, len(pivots)))
        return pd.DataFrame({"cell": d.argmin(1).astype("int32"), "d": d.min(1)})

    celled = stored(rows.withColumn("c", cell_of("v")).select("vec_id", "v", "c.cell", "c.d"))
    n_cells = len(pivots)
    cells = Cells(pivots, np.full(n_cells, -np.inf), np.zeros(n_cells, np.int64))
    counted = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("r"))
    for r in counted.collect():  # at most MOST_CELLS rows
        cells.radius[r["cell"]], cells.shards[r["cell"]] = r["r"], -(-r["n"] // shard_rows)
    per_cell = F.array(*[F.lit(int(s)) for s in cells.shards])
    shards = F.get(per_cell, F.col("cell"))
    index = celled.select("vec_id", "v", (F.col("cell") * F.lit(1 << 32) + F.pmod(F.xxhash64("vec_id"), shards)).alias("shard"))
    queries = celled.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "cell")

    def every_shard(df: DataFrame) -> DataFrame:
        own = F.explode(F.sequence(F.lit(0), F.get(per_cell, F.col("cell")) - 1))
        return df.select("query_id", "q", "reach", "cell", own.alias("_s")).select("query_id", "q", "reach", (F.col("cell") * F.lit(1 << 32) + F.col("_s")).alias("shard"))

    home = every_shard(queries.withColumn("reach", F.lit(float("inf"))))
    found = stored(best(searched(index, home, query_block, k, factor), k))
    if n_cells > 1:
        reached = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.max("score")).alias("reach"))
        told = queries.join(reached, "query_id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))

        @F.pandas_udf("array<int>")
        def others(q: pd.Series, cell: pd.Series, reach: pd.Series) -> pd.Series:
            if not len(q):
                return pd.Series([], dtype=object)
            d = distances(np.stack(q.to_numpy()), cells.pivots)
            own = d[np.arange(len(d)), cell.to_numpy()][:, None]
            # no point of a cell is nearer than its ball, nor than the plane between the two pivots
            bound = np.maximum(np.maximum(d - cells.radius - ROUNDING * (d + cells.radius), (d - own) / 2 - ROUNDING * (d + own)), 0)
            visit = (factor * bound <= reach.to_numpy()[:, None]) & (cells.shards > 0)
            visit[np.arange(len(d)), cell.to_numpy()] = False
            return pd.Series([np.flatnonzero(x).astype("int32") for x in visit])

        away = told.select("query_id", "q", "reach", F.explode(others("q", "cell", "reach")).alias("cell"))
        found = best(found.drop("rank").unionByName(searched(index, every_shard(away), query_block, k, factor)), k)
    return found.select("query_id", "rank", "vec_id", "score")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
