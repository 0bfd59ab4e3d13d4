"""Non-maximum suppression of segments and boxes, score fusion, segment voting.

Greedy suppression is order dependent inside a group. Groups of checked, bounded size are folded
with numpy inside their task. Larger groups are first split into islands (runs of intervals that
touch no other run and so cannot influence each other); islands that are still too large are
folded tile by tile, and only rows that hang on a tile's border wait for the next round.
All three give the same rows as the fold.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.operators.sets import split_by_size
from spanlake.plans.binned import overlap_join
from spanlake.plans.folds import fold_groups
from spanlake.plans.scan import ordered_scan
from spanlake.session import cut

GROUP_ROWS = 20_000
MATRIX_ROWS = 512
HARD, LINEAR, GAUSS = "hard", "linear", "gauss"
SEGMENT = ("t_start", "t_end")
BOX = ("x0", "x1", "y0", "y1")


def _overlap_arrays(p, i) -> np.ndarray:
    """Overlap of the rows i with all rows; p is a list of (low, high) arrays per dimension.

    An integer i gives one row of the overlap matrix, a column of indices gives several at once.
    """
    inter, area_i, area = 1.0, 1.0, 1.0
    for lo, hi in p:
        inter = inter * np.maximum(0.0, np.minimum(hi[i], hi) - np.maximum(lo[i], lo))
        area_i = area_i * (hi[i] - lo[i])
        area = area * (hi - lo)
    pad = 1e-6 if len(p) == 1 else 0.0
    union = area_i + pad + area + pad - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def _overlap_columns(dims, a: str, b: str) -> Column:
    """The same overlap as an expression over columns prefixed a and b."""
    spans = [(dims[i], dims[i + 1]) for i in range(0, len(dims), 2)]

    def prod(cols):
        return reduce(lambda x, y: x * y, cols)

    inter = prod(
        [
            F.greatest(
                F.lit(0.0),
                F.least(F.col(a + hi), F.col(b + hi)) - F.greatest(F.col(a + lo), F.col(b + lo)),
            )
            for lo, hi in spans
        ]
    )
    pad = 1e-6 if len(spans) == 1 else 0.0
    area = [prod([F.col(s + hi) - F.col(s + lo) for lo, hi in spans]) + pad for s in (a, b)]
    return F.coalesce(F.try_divide(inter, area[0] + area[1] - inter), F.lit(0.0))


def _decay(method, threshold, strict, sigma):
    """What a kept row leaves of the rows that it overlaps by ovr."""

    def decay(ovr):
        hit = ovr > threshold if strict else ovr >= threshold
        if method == HARD:
            return np.where(hit, 0.0, 1.0)
        if method == LINEAR:
            return np.where(hit, 1.0 - ovr, 1.0)
        return np.exp(-(ovr * ovr) / sigma)

    return decay


def _fold(dims, ident, method, threshold, strict, sigma, min_score):
    """The sequential fold over bounded groups, many to a batch."""
    decay = _decay(method, threshold, strict, sigma)

    def group(spans, score) -> tuple[list, list]:
        """Kept rows and their final scores; rows come in id order."""
        n = len(score)
        # the whole decay matrix for small groups, row by row otherwise
        table = decay(_overlap_arrays(spans, np.arange(n)[:, None])) if n <= MATRIX_ROWS else None

        def weights(i: int) -> np.ndarray:
            return table[i] if table is not None else decay(_overlap_arrays(spans, i))

        kept, final = [], []
        if method == HARD:
            # scores never change: one pass in score order, ties by id
            gone = np.zeros(n, bool)
            for i in np.argsort(-score, kind="stable"):
                if not gone[i]:
                    kept.append(i)
                    final.append(score[i])
                    gone |= weights(i) == 0.0
        else:
            live = score.copy()
            for _ in range(n):
                i = int(live.argmax())  # rows are in id order, so ties go to the smaller id
                if live[i] == -np.inf:
                    break
                kept.append(i)
                final.append(live[i])
                live[i] = -np.inf
                live = np.where(live == -np.inf, live, live * weights(i))
                live[live < min_score] = -np.inf
        return kept, final

    def run(rows: pa.RecordBatch, bounds: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((rows[ident].to_numpy(zero_copy_only=False), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))))
        sides = [rows[c].to_numpy(zero_copy_only=False).astype(float)[order] for c in dims]
        score = rows["score"].to_numpy(zero_copy_only=False).astype(float)[order]
        at, final = [], []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            kept, last = group([(sides[i][lo:hi], sides[i + 1][lo:hi]) for i in range(0, len(dims), 2)], score[lo:hi])
            at += [lo + i for i in kept]
            final += last
        out = rows.take(pa.array(order[np.asarray(at, np.int64)]))
        place = rows.schema.get_field_index("score")
        return out.set_column(place, rows.schema.field(place), pa.array(final, pa.float64()).cast(rows.schema.field(place).type))

    return run


def islands(df: DataFrame, keys: list[str], start: str, end: str, ident: str, name: str = "island") -> DataFrame:
    """Number the maximal runs of intervals of one key that overlap in a chain; touching runs stay apart."""
    order = [F.col(start), F.col(ident)]
    reach = ordered_scan(df, keys, order, {"_reach": ("max", F.col(end), False)})
    opens = F.when(F.col("_reach").isNull() | (F.col(start) >= F.col("_reach")), 1).otherwise(0)
    return ordered_scan(reach, keys, order, {name: ("sum", opens, True)}).drop("_reach")


def _tile(dims, ident, method, threshold, strict, sigma, min_score):
    """The fold over one tile, as far as it can be told from the tile's rows alone.

    A row that lies inside the tile has all its neighbours here; one that crosses a border may have others. Rows come up by falling
    score. One inside that no undecided row before it can touch is kept for certain, and decays the others. One that crosses
    a border is undecided, and so is all that an undecided row can touch. Scores only fall, so a row that comes up has no
    neighbour of a higher one.
    """
    decay = _decay(method, threshold, strict, sigma)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ident)
        spans = [(pdf[dims[i]].to_numpy(float), pdf[dims[i + 1]].to_numpy(float)) for i in range(0, len(dims), 2)]
        inside, live = pdf["_inside"].to_numpy(bool), pdf["score"].to_numpy(float).copy()
        n = len(live)
        factor, final = np.ones(n), np.full(n, np.nan)
        waits, gone, top = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        fixed = iter(np.argsort(-live, kind="stable")) if method == HARD else None
        while True:
            if fixed is not None:
                i = next(fixed, None)
                if i is None:
                    break
                if gone[i]:
                    continue
            else:
                open_ = np.where(gone, -np.inf, live)
                i = int(open_.argmax())
                if open_[i] == -np.inf:
                    break
            w = decay(_overlap_arrays(spans, i))
            w[i] = 1.0
            gone[i] = True
            if inside[i] and not waits[i]:
                final[i] = live[i]
                factor *= w
                live = live * w
                gone |= (w == 0.0) if method == HARD else live < min_score
            else:
                top[i] = not waits[i]
                waits |= w != 1.0
        return pd.DataFrame({"_id": pdf[ident].to_numpy(), "_final": final, "_top": top, "_f": factor})

    return run


def suppress_by_tiles(
    df: DataFrame, keys: list[str], dims, ident: str, method: str, threshold: float,
    strict: bool = False, sigma: float = 0.5, min_score: float = 0.0, tile_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Suppression without gathering a group.

    Every round cuts the first dimension into tiles, moved by half a tile from round to round, and folds each tile. Rows inside a tile
    are decided there unless an undecided row touches them. A row that crosses borders is kept if it comes up undisturbed in all its
    tiles. A tile with more rows than tile_rows is not folded: only its best row comes up, and the next round's tiles
    are half as wide, down to the mean length of a row. The best row that is left always comes up, so every round decides some; a chain of
    dependent rows costs a round per tile that it runs through, not per row.
    """
    lo, hi = dims[0], dims[1]
    per = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(hi) - F.col(lo)).alias("w"), (F.max(hi) - F.min(lo)).alias("s"))
    row = per.agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("s").alias("s")).first()
    if not row["n"]:
        return df
    mean = row["w"] / row["n"] or 1.0
    width = max(4 * mean, row["s"] / row["n"] * tile_rows / 2)
    columns, left, kept, turn = df.columns, cut(df), [], 0
    fold = _tile(dims, ident, method, threshold, strict, sigma, min_score)
    told = f"_id {dict(df.dtypes)[ident]}, _final double, _top boolean, _f double"
    rank = F.struct(F.col("score").alias("s"), (-F.col(ident)).alias("i"))

    def tiled(rows: DataFrame) -> DataFrame:
        first, last = (F.floor((F.col(c) + shift) / width) for c in (lo, hi))
        return rows.withColumn("_inside", first == last).withColumn("_bin", F.explode(F.sequence(first, F.greatest(first, last))))

    while not left.isEmpty():
        shift = width / 2 * (turn % 2)
        turn += 1
        cells = cut(tiled(left.select(*keys, ident, *dims, "score")))
        small, large = split_by_size(cells, [*keys, "_bin"], tile_rows)
        seen = small.groupBy(*keys, "_bin").applyInPandas(fold, told)
        if large is not None:
            lead = large.groupBy(*keys, "_bin").agg(F.max(rank).alias("_best"))
            wins = rank == F.col("_best")
            seen = seen.unionByName(large.join(lead, [*keys, "_bin"]).select(F.col(ident).alias("_id"), F.lit(None).cast("double").alias("_final"), wins.alias("_top"), F.lit(1.0).alias("_f")))
        told_of = seen.groupBy("_id").agg(F.max("_final").alias("_final"), F.min("_top").alias("_top"), F.product("_f").alias("_f")).withColumnRenamed("_id", ident)
        now = cut(left.join(told_of, ident))
        # a row that lost score this round may no longer come first in all its tiles
        undisturbed = F.col("_top") & ((F.col("_f") > 0) if method == HARD else (F.col("_f") == 1.0))
        own = {"score": F.coalesce("_final", "score").alias("score")}
        kept.append(cut(now.where(F.col("_final").isNotNull() | undisturbed).select(*[own.get(c, F.col(c)) for c in columns])))
        # rows kept inside a tile have decayed all their neighbours there; the others meet theirs in the tile of the later start
        late = now.where(F.col("_final").isNull() & undisturbed).select(*keys, ident, *dims)
        rest = now.where(F.col("_final").isNull() & ~undisturbed & (F.col("_f") > 0)).withColumn("score", F.col("score") * F.col("_f")).select(columns)
        near = tiled(late).select(*keys, "_bin", *[F.col(c).alias(f"w_{c}") for c in dims])
        ovr = _overlap_columns(dims, "", "w_")
        hit = ovr > threshold if strict else ovr >= threshold
        if method == HARD:
            factor = F.when(hit, 0.0).otherwise(1.0)
        elif method == LINEAR:
            factor = F.when(hit, 1.0 - ovr).otherwise(1.0)
        else:
            factor = F.exp(-(ovr * ovr) / sigma)
        met = (
            tiled(rest.select(*keys, ident, *dims))
            .join(near, [*keys, "_bin"])
            .where(F.floor((F.greatest(F.col(lo), F.col(f"w_{lo}")) + shift) / width) == F.col("_bin"))
            .groupBy(ident)
            .agg(F.product(factor).alias("_m"))
        )
        scaled = rest.join(met, ident, "left").withColumn("_m", F.coalesce("_m", F.lit(1.0)))
        alive = F.col("_m") > 0 if method == HARD else F.col("score") >= min_score
        left = cut(scaled.withColumn("score", F.col("score") * F.col("_m")).where(alive).select(columns))
        if large is not None:
            width = max(width / 2, mean)
    return reduce(DataFrame.unionByName, kept)


def suppress(
    df: DataFrame, keys: list[str], dims=SEGMENT, ident: str = "pred_id", method: str = HARD,
    threshold: float = 0.5, strict: bool = False, sigma: float = 0.5, min_score: float = 0.0,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Rows kept by greedy suppression inside each key group; soft methods rewrite score."""
    if method == HARD:
        df = df.where(F.col("score") > min_score) if min_score > 0 else df
    else:
        df = df.where(F.col("score") >= min_score)
    if method == HARD and threshold <= 0 and not strict:
        # every row is hit, near or far: the best one of each group stays, whatever the group's size
        best = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col(ident))
        return df.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")
    fold = _fold(dims, ident, method, threshold, strict, sigma, min_score)
    small, large = split_by_size(df, keys, group_rows)
    parts = [fold_groups(small, keys, fold, df.schema)]
    if large is not None:
        runs = cut(islands(large, keys, dims[0], dims[1], ident, "_island"))
        small, large = split_by_size(runs, [*keys, "_island"], group_rows)
        parts.append(fold_groups(small, [*keys, "_island"], fold, runs.schema).drop("_island"))
        if large is not None:
            parts.append(
                suppress_by_tiles(
                    large.drop("_island"), keys, dims, ident, method, threshold, strict, sigma, min_score, group_rows
                )
            )
    return reduce(DataFrame.unionByName, parts)


def top_predictions(pred: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The k best rows of each clip by score, ties by id; the limit is applied before the shuffle, too."""
    w = Window.partitionBy(*(by or ["clip_id"])).orderBy(F.col("score").desc(), F.col("pred_id"))
    return pred.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def nms(
    pred: DataFrame, iou: float = 0.1, min_score: float = 0.001, max_seg: int = 2000, multiclass: bool = True,
    soft: bool = False, sigma: float = 0.5, voting: float = 0.0, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Suppression per clip (and label), optional voting in class-agnostic mode, best max_seg rows of each clip."""
    keys = ["clip_id", "label"] if multiclass else ["clip_id"]
    kept = suppress(
        pred, keys, method=GAUSS if soft else HARD, threshold=iou, sigma=sigma, min_score=min_score,
        group_rows=group_rows,
    )
    kept = top_predictions(kept, max_seg)
    if voting > 0 and not multiclass:
        kept = segment_voting(kept, pred, voting)
    return kept


def soft_nms(
    pred: DataFrame, sigma: float = 0.5, min_score: float = 0.001, method: int = 2, iou: float = 0.1,
    multiclass: bool = True, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Score decay by already kept rows: method 0 removes, 1 scales by 1 - overlap, 2 by exp(-overlap^2 / sigma)."""
    keys = ["clip_id", "label"] if multiclass else ["clip_id"]
    return suppress(
        pred, keys, method=(HARD, LINEAR, GAUSS)[method], threshold=iou, sigma=sigma, min_score=min_score,
        group_rows=group_rows,
    )


def segment_voting(kept: DataFrame, everything: DataFrame, thresh: float = 0.75) -> DataFrame:
    """Kept segments moved to the mean of all segments of the clip with tIoU >= thresh, weighted by tIoU * score.

    A segment whose weights sum to zero stays where it is.
    """
    near = overlap_join(
        kept.select("clip_id", "pred_id", "t_start", "t_end"),
        everything.select("clip_id", "t_start", "t_end", "score"),
        ["clip_id"],
    ).where(F.col("tiou") >= thresh)
    w = F.col("tiou") * F.col("b_score")
    moved = near.groupBy(F.col("a_pred_id").alias("pred_id")).agg(
        F.try_divide(F.sum(w * F.col("b_t_start")), F.sum(w)).alias("t_start"),
        F.try_divide(F.sum(w * F.col("b_t_end")), F.sum(w)).alias("t_end"),
    )
    voted = kept.join(moved.toDF("pred_id", "_s", "_e"), "pred_id", "left")
    own = {"t_start": F.coalesce("_s", "t_start").alias("t_start"), "t_end": F.coalesce("_e", "t_end").alias("t_end")}
    return voted.select(*[own.get(c, F.col(c)) for c in kept.columns])


def box_nms(boxes: DataFrame, iou: float = 0.5, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per frame greedy suppression of boxes with IoU > iou; det_index renumbers the kept boxes by score."""
    kept = suppress(
        boxes, ["frame_id"], dims=BOX, ident="det_id", method=HARD, threshold=iou, strict=True,
        group_rows=group_rows,
    )
    w = Window.partitionBy("frame_id").orderBy(F.col("score").desc(), F.col("det_id"))
    return kept.withColumn("det_index", F.row_number().over(w) - 1)


def fuse_class_scores(pred: DataFrame, cls: DataFrame, num_pred: int = 200, topk: int = 2) -> DataFrame:
    """Each of the best num_pred segments of a clip with each of the clip's topk classes; score sqrt(class * segment)."""
    segs = top_predictions(pred, num_pred).drop("label").withColumnRenamed("score", "seg_score")
    w = Window.partitionBy("clip_id").orderBy(F.col("score").desc(), F.col("label"))
    best = (
        cls.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= topk)
        .select("clip_id", "label", F.col("score").alias("cls_score"))
    )
    return segs.join(best, "clip_id").select(
        "clip_id", "pred_id", "t_start", "t_end", "label",
        F.sqrt(F.col("cls_score") * F.col("seg_score")).alias("score"),
    )


def ensemble_predictions(systems: dict[str, DataFrame]) -> DataFrame:
    """All predictions of several systems with the system name."""
    return reduce(DataFrame.unionByName, [d.withColumn("system", F.lit(n)) for n, d in systems.items()])
