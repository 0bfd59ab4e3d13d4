"""PCA, k-means, exact nearest neighbours, pair mining and batch predictors over embedding tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.vectors import bound
from spanlake.operators.sets import greedy_one_to_one
from spanlake.plans.scan import draw_key, draw_unit, global_index
from spanlake.session import cut, scratch_path, shuffle_width

# ---- PCA and k-means -----------------------------------------------------------------------


def _vectors(df: DataFrame, vec: str) -> DataFrame:
    return df.select("*", array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))


class Reduction:
    """A fitted linear map: mean, components (d x k) and the explained variance ratios."""

    def __init__(self, mean: np.ndarray, components: np.ndarray, ratio: np.ndarray):
        self.mean, self.components, self.ratio = mean, components, ratio

    @property
    def k(self) -> int:
        return self.components.shape[1]

    def transform(self, df: DataFrame, vec: str = "embedding", name: str = "reduced") -> DataFrame:
        mean = df.sparkSession.sparkContext.broadcast(self.mean)
        comp = df.sparkSession.sparkContext.broadcast(self.components)

        @F.pandas_udf("array<double>")
        def project(col: pd.Series) -> pd.Series:
            if len(col) == 0:
                return pd.Series([], dtype=object)
            x = np.stack(col.to_numpy()).astype(float)
            return pd.Series(list((x - mean.value) @ comp.value))

        return df.withColumn(name, project(F.col(vec)))


def pca_fit(train: DataFrame, vec: str = "embedding", max_k: int = 256, variance: float = 0.95) -> Reduction:
    """Smallest number of components whose cumulative ratio reaches variance, max_k if none does.

    One pass sums the d x d scatter matrix on the executors; components nest, so no second fit is needed.
    """
    v = _vectors(train, vec)
    d = len(v.select(vec).first()[0])
    k = min(max_k, d)
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    mean = v.select(Summarizer.mean(F.col("_v"))).first()[0].toArray()
    ratio = np.asarray(model.explainedVariance.toArray())
    reached = np.flatnonzero(np.cumsum(ratio) >= variance - 1e-12)
    keep = int(reached[0]) + 1 if len(reached) else k
    return Reduction(mean, model.pc.toArray()[:, :keep], ratio[:keep])


def pca_fit_transform(frames: DataFrame, train: DataFrame, vec: str = "embedding", max_k: int = 256, variance: float = 0.95) -> DataFrame:
    """All frames reduced by a PCA fitted on train."""
    return pca_fit(train, vec, max_k, variance).transform(frames, vec)


def pca_whiten(frames: DataFrame, k: int, power: float = -0.5, vec: str = "embedding") -> DataFrame:
    """First k principal coordinates, each scaled by its eigenvalue to the power (-0.5 gives unit variance)."""
    fit = pca_fit(frames, vec, k, 2.0)
    var = _vectors(frames, vec).select(Summarizer.variance(F.col("_v"))).first()[0].toArray().sum()
    scale = np.power(np.maximum(fit.ratio * var, 1e-30), power)
    return Reduction(fit.mean, fit.components * scale, fit.ratio).transform(frames, vec)


#: Rows that the seedings of k-means are drawn from, whatever the size of the table.
SEED_ROWS = 10_000


def spread_centers(x: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """k rows of x, each drawn with a chance in proportion to its squared distance from those before."""
    centers = [x[draw.integers(len(x))]]
    far = ((x - centers[0]) ** 2).sum(1)
    while len(centers) < k:
        total = far.sum()
        centers.append(x[draw.choice(len(x), p=far / total) if total > 0 else draw.integers(len(x))])
        far = np.minimum(far, ((x - centers[-1]) ** 2).sum(1))
    return np.array(centers)


def nearest_centers(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row, ties to the first, and the squared distance to it."""
    d = ((x * x).sum(1)[:, None] - 2 * x @ centers.T) + (centers * centers).sum(1)[None, :]
    at = d.argmin(1)
    return at, ((x - centers[at]) ** 2).sum(1)


def center_sums(rows: DataFrame, sets: np.ndarray, vec: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count (set, k) and sum (set, k, d) of the rows nearest to each centre, and the squared distance per set, for several sets at once.

    Every task adds up its own rows; only its sums leave it.
    """
    n_sets, k, d = sets.shape

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = np.zeros((n_sets, k)), np.zeros((n_sets, k, d)), np.zeros(n_sets)
        for b in batches:
            if len(b):
                x = np.stack(b[vec].to_numpy()).astype(float)
                for i, centers in enumerate(sets):
                    at, far = nearest_centers(x, centers)
                    hot = np.zeros((len(x), k))
                    hot[np.arange(len(x)), at] = 1
                    n[i] += hot.sum(0)
                    s[i] += hot.T @ x
                    q[i] += far.sum()
        yield pd.DataFrame({"n": [n.ravel()], "s": [s.ravel()], "q": [q]})

    parts = rows.select(vec).mapInPandas(added, "n array<double>, s array<double>, q array<double>")
    total = parts.select(*[Summarizer.sum(array_to_vector(c)).alias(c) for c in ("n", "s", "q")]).first()
    return total["n"].toArray().reshape(n_sets, k), total["s"].toArray().reshape(n_sets, k, d), total["q"].toArray()


def kmeans_fit(train: DataFrame, k: int, seed: int = 0, vec: str = "embedding", batch_rows: int = 10_000, steps: int = 20, n_init: int = 3) -> np.ndarray:
    """Centres by mini-batches: each moves to the mean of all rows that it was given so far; of n_init seedings the one of least inertia.

    Rows fall to batches of about batch_rows by a seeded hash of their vector and are stored by batch, so a step reads
    its own batch only. All seedings, drawn from SEED_ROWS rows, take a step in one pass. The result hangs on
    rows and seed alone, but for the order in which sums are added.
    """
    n = train.count()
    if n == 0:
        raise ValueError("k-means needs rows")
    parts = min(steps, max(1, -(-n // batch_rows)))
    lot = F.pmod(F.xxhash64(F.lit(seed), F.col(vec)), F.lit(1 << 30))
    path = scratch_path(train.sparkSession, "kmeans")
    train.select(vec, lot.alias("lot"), F.pmod("lot", F.lit(parts)).alias("batch")).repartition("batch").write.partitionBy("batch").parquet(path)
    rows = train.sparkSession.read.parquet(path)
    sample = np.array([r[0] for r in rows.orderBy("lot", vec).limit(SEED_ROWS).select(vec).collect()], float)
    draw = np.random.default_rng(seed)
    sets = np.stack([spread_centers(sample, k, draw) for _ in range(n_init)])
    seen = np.zeros(sets.shape[:2])
    for step in range(steps):
        count, total, _ = center_sums(rows.where(F.col("batch") == step % parts), sets, vec)
        seen += count
        moved = sets + (total - count[:, :, None] * sets) / np.maximum(seen, 1)[:, :, None]
        if np.allclose(moved, sets, rtol=0, atol=1e-9) and parts == 1:
            break
        sets = moved
    return sets[int(np.argmin(center_sums(rows, sets, vec)[2]))]


def assign_centers(frames: DataFrame, centers: np.ndarray, vec: str = "embedding") -> DataFrame:
    """Add cluster, the nearest centre, ties to the first, and sq_dist."""
    @F.pandas_udf("struct<cluster:int,sq_dist:double>")
    def told(col: pd.Series) -> pd.DataFrame:
        at, far = nearest_centers(np.stack(col.to_numpy()).astype(float), centers) if len(col) else (np.empty(0), np.empty(0))
        return pd.DataFrame({"cluster": at.astype(np.int32), "sq_dist": far})

    return frames.withColumn("_k", told(F.col(vec).cast("array<double>"))).select("*", "_k.cluster", "_k.sq_dist").drop("_k")


def kmeans_fit_assign(frames: DataFrame, k: int, percent: float = 1.0, seed: int = 0, utterance: str = "clip_id", vec: str = "embedding", **options) -> DataFrame:
    """Add cluster and sq_dist: mini-batch k-means fitted on a seeded share of whole utterances, applied to all rows."""
    train = frames if percent >= 1 else frames.where(draw_unit(seed, F.col(utterance)) < percent)
    return assign_centers(frames, kmeans_fit(train, k, seed, vec, **options), vec)


def inertia(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.avg("sq_dist").alias("inertia"))


# ---- exact nearest neighbours ---------------------------------------------------------------

#: Bytes of the vectors on each side of a block product. A row moves once for every block that it meets, so small blocks cost moves.
BLOCK_BYTES = 16 << 20
SLICE_X, SLICE_Y = 512, 4096


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length as one array."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def largest_products(a: np.ndarray, b: np.ndarray, k: int, low: np.ndarray, skip_same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, product): the k largest products of each row of a that are not below its low, ties to the first of b.

    Products are taken slice by slice. Once k of a row are known, only those that reach the k-th go on.
    """
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    out = []
    for i in range(0, len(a), SLICE_X):
        x, least = a[i : i + SLICE_X], low[i : i + SLICE_X].copy()
        row, col, sim = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for j in range(0, len(b), SLICE_Y):
            s = x @ b[j : j + SLICE_Y].T
            if skip_same:
                s[s >= (1 - 1e-9) * na[i : i + SLICE_X, None] * nb[None, j : j + SLICE_Y]] = -np.inf
            s[~np.isfinite(s)] = -np.inf
            if j == 0 and s.shape[1] > k:
                least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k])
            r, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
            row, col, sim = np.concatenate([row, r]), np.concatenate([col, c + j]), np.concatenate([sim, s[r, c]])
            order = np.lexsort((col, -sim, row))
            row, col, sim = row[order], col[order], sim[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            least[row[place == k - 1]] = np.maximum(least[row[place == k - 1]], sim[place == k - 1])
            row, col, sim = row[place < k], col[place < k], sim[place < k]
        out.append((row + i, col, sim))
    return tuple(np.concatenate(part) for part in zip(*out))


def knn_join(
    x: DataFrame, y: DataFrame, k: int, x_id: str = "x_id", y_id: str = "y_id", vec: str = "embedding",
    skip_same: bool = False, block_rows: int | None = None, pivots: int | None = None,
) -> DataFrame:
    """(x_id, y_id, sim): the k rows of y with the largest inner product for every x, exact, ties to the smaller id.

    y is split into cells around pivots, cells into blocks of bounded size. By Cauchy-Schwarz no row
    of a cell with pivot c and radius r exceeds x.c + |x| r. First every x visits the cells with the
    best bounds that hold k rows; their k-th similarity then rules out all cells with a smaller
    bound. Rows of x that visit one block are split as well, so a task multiplies two bounded
    matrices. skip_same leaves out rows with the same direction (for unit vectors: zero distance).
    """
    spark = x.sparkSession
    xs = cut(x.select(F.col(x_id).alias("x"), F.col(vec).cast("array<double>").alias("xv")))
    ys = y.select(F.col(y_id).alias("y"), F.col(vec).cast("array<double>").alias("yv"))
    n_y = ys.count()
    if n_y == 0:
        return spark.createDataFrame([], f"{x_id} long, {y_id} long, sim double")
    block_rows = block_rows or max(1024, BLOCK_BYTES // (8 * max(1, len(ys.first()["yv"]))))
    # the number of pivots is limited, so the pivot matrix stays small on the driver
    n_piv = pivots or max(1, min(1024, n_y // block_rows))
    piv = np.array([r[0] for r in ys.orderBy(draw_key("pivot", F.col("y")), "y").limit(n_piv).select("yv").collect()])
    b_piv = spark.sparkContext.broadcast(piv)

    def to_cell(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = b_piv.value
        for pdf in it:
            v = np.stack(pdf["yv"].to_numpy())
            d2 = (v * v).sum(1)[:, None] - 2 * v @ c.T + (c * c).sum(1)[None, :]
            cell = d2.argmin(axis=1)
            dist = np.sqrt(((v - c[cell]) ** 2).sum(1))
            yield pdf.assign(cell=cell.astype(np.int32), dist=dist)

    celled = cut(ys.mapInPandas(to_cell, "y long, yv array<double>, cell int, dist double"))
    stat = {r["cell"]: (r["n"], r["r"]) for r in celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("r")).collect()}
    count = np.array([stat.get(i, (0, 0.0))[0] for i in range(len(piv))])
    radius = np.array([stat.get(i, (0, 0.0))[1] for i in range(len(piv))]) * (1 + 1e-9) + 1e-9
    n_blocks = np.maximum(1, np.ceil(count / block_rows)).astype(int)
    b_stat = spark.sparkContext.broadcast((count, radius, n_blocks))

    def visits(second: bool):
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = b_piv.value
            cnt, rad, nb = b_stat.value
            for pdf in it:
                v = np.stack(pdf["xv"].to_numpy())
                norm = np.sqrt((v * v).sum(1))
                bound = v @ c.T + norm[:, None] * rad[None, :] + 1e-9
                bound[:, cnt == 0] = -np.inf
                order = np.argsort(-bound, axis=1, kind="stable")
                before = np.cumsum(cnt[order], axis=1) - cnt[order]
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, order, before < k, axis=1)
                first &= cnt[None, :] > 0
                if second:
                    low = pdf["low"].fillna(-np.inf).to_numpy()
                    pick = (cnt[None, :] > 0) & ~first & (bound >= low[:, None])
                else:
                    pick = first
                row, cell = np.nonzero(pick)
                rep = nb[cell]
                row, cell = np.repeat(row, rep), np.repeat(cell, rep)
                sub = np.arange(len(row)) - np.repeat(np.cumsum(rep) - rep, rep)
                known = pdf["low"].to_numpy(float)[row] if second else np.full(len(row), -np.inf)
                yield pd.DataFrame({"x": pdf["x"].to_numpy()[row], "cell": cell.astype(np.int32), "sub": sub.astype(np.int32), "low": np.nan_to_num(known, nan=-np.inf)})

        return run

    nb = F.element_at(F.array(*[F.lit(int(b)) for b in n_blocks]), F.col("cell") + 1)
    blocks = celled.select("y", "yv", "cell", F.pmod(F.xxhash64("y"), nb).cast("int").alias("sub"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"x": pa.array([], pa.int64()), "y": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        # rows of y are in id order, so ties go to the smaller id
        right = right.sort_by("y")
        low = left["low"].fill_null(-np.inf).to_numpy()
        at, near, sim = largest_products(matrix(left["xv"]), matrix(right["yv"]), k, low, skip_same)
        return pa.table({"x": left["x"].to_numpy()[at], "y": right["y"].to_numpy()[near], "sim": sim})

    def probe(plan: DataFrame) -> DataFrame:
        plan = cut(plan)
        parts = plan.groupBy("cell", "sub").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
        left = plan.join(parts, ["cell", "sub"]).withColumn("salt", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int")).join(xs, "x").select("cell", "sub", "salt", "x", "xv", "low")
        right = blocks.join(parts, ["cell", "sub"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "sub", "salt", "y", "yv")
        keys = ["cell", "sub", "salt"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "x long, y long, sim double")

    w = Window.partitionBy("x").orderBy(F.col("sim").desc(), "y")

    def top_k(df: DataFrame) -> DataFrame:
        return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")

    plan_schema = "x long, cell int, sub int, low double"
    found = top_k(probe(xs.mapInPandas(visits(False), plan_schema)))
    if len(piv) > 1:
        found = cut(found)
        low = found.groupBy("x").agg(F.when(F.count("*") >= k, F.min("sim")).alias("low"))
        more = xs.join(low, "x", "left").mapInPandas(visits(True), plan_schema)
        found = top_k(found.unionByName(probe(more)))
    return found.select(F.col("x").alias(x_id), F.col("y").alias(y_id), "sim")


def mine_pairs(x: DataFrame, y: DataFrame, k: int = 4, threshold: float = 1.06, min_count: int = 0, vec: str = "embedding", text: str | None = None, ident: str = "id") -> DataFrame:
    """(src, tgt, score): margin-scored mutual candidates, one-to-one, above threshold or among the first min_count.

    margin = similarity over the mean of the two sides' average k-NN similarity. With a text column,
    accepted pairs whose source text is blank are left out and not counted.
    """
    xs, ys = x.select(F.col(ident).alias("x_id"), vec), y.select(F.col(ident).alias("y_id"), vec)
    fwd = cut(knn_join(xs, ys, k, vec=vec))
    bwd = cut(knn_join(ys, xs, k, "y_id", "x_id", vec))
    fm = fwd.groupBy("x_id").agg(F.avg("sim").alias("fm"))
    bm = bwd.groupBy("y_id").agg(F.avg("sim").alias("bm"))

    def scored(df: DataFrame, own: str) -> DataFrame:
        s = df.join(fm, "x_id").join(bm, "y_id").withColumn("score", F.try_divide(F.col("sim"), (F.col("fm") + F.col("bm")) / 2))
        other = "y_id" if own == "x_id" else "x_id"
        top = s.groupBy(own).agg(F.max(F.struct("score", (-F.col(other)).alias("o"))).alias("m"))
        return top.select(F.col(own), (-F.col("m.o")).alias(other), F.col("m.score").alias("score"))

    both = scored(fwd, "x_id").unionByName(scored(bwd, "y_id")).groupBy(F.col("x_id").alias("src"), F.col("y_id").alias("tgt")).agg(F.max("score").alias("score"))
    taken = greedy_one_to_one(both)
    if text:
        named = x.where(F.trim(F.col(text)) != "").select(F.col(ident).alias("src"))
        taken = taken.join(named, "src", "left_semi")
    if min_count <= 0:
        return taken.where(F.col("score") > threshold)
    rank = global_index(taken, [F.col("score").desc(), F.col("src")], "_i")
    return rank.where((F.col("score") > threshold) | (F.col("_i") < min_count)).drop("_i")


def similar_partner(x: DataFrame, top_k: int, n: int, seed: int = 0, ident: str = "id", vec: str = "embedding") -> DataFrame:
    """(id, pick, partner, distance): n seeded picks among the top_k nearest rows by cosine distance above zero."""
    v = F.col(vec).cast("array<double>")
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, a: s + a * a))
    scaled = bound(size, lambda n: F.transform(v, lambda a: F.try_divide(a, n)))
    unit = x.where(size > 0).select(F.col(ident).alias("x_id"), scaled.alias(vec))
    near = knn_join(unit, unit.withColumnRenamed("x_id", "y_id"), top_k, vec=vec, skip_same=True)
    w = Window.partitionBy("x_id").orderBy(F.col("sim").desc(), "y_id")
    ranked = near.withColumn("_r", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("x_id")))
    picks = ranked.withColumn("pick", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = F.floor(draw_unit(seed, F.col("x_id"), F.col("pick")) * F.col("_n"))
    return picks.where(F.col("_r") == at).select(F.col("x_id").alias(ident), "pick", F.col("y_id").alias("partner"), (1 - F.col("sim")).alias("distance"))


# ---- batch predictors -------------------------------------------------------------------------


def map_features(df: DataFrame, predict: Callable, schema: str, setup: Callable | None = None, rows: int | None = None) -> DataFrame:
    """Apply predict(batch, model) to Arrow batches; setup() builds the model once per task.

    rows spreads the input over about that many rows per task first, for heavy models on few files.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = setup() if setup else None
        for pdf in it:
            yield predict(pdf, model)

    if rows:
        n = max(1, math.ceil(df.count() / rows))
        df = df.repartition(max(n, shuffle_width(df.sparkSession)))
    return df.mapInPandas(run, schema)
