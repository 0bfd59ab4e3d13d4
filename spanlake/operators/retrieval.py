"""Ranked-retrieval and detection evaluation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.operators.sets import FOLD_ROWS, split_by_size, with_component
from spanlake.plans.binned import overlap_join
from spanlake.plans.folds import fold_groups
from spanlake.plans.scan import keyed_index, ordered_scan
from spanlake.session import cut

TIOUS = (0.1, 0.2, 0.3, 0.4, 0.5)


def match_segments(pred: DataFrame, gt: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All intersecting (prediction, annotation) pairs of one clip and label with their tIoU."""
    return overlap_join(
        pred.select("clip_id", "label", "pred_id", "t_start", "t_end", "score"),
        gt.select("clip_id", "label", "seg_id", "t_start", "t_end"),
        keys or ["clip_id", "label"],
    ).select(
        "clip_id", "label", F.col("a_pred_id").alias("pred_id"), F.col("b_seg_id").alias("seg_id"),
        F.col("a_score").alias("score"), "tiou",
    )


def retrieval_recall(pred: DataFrame, gt: DataFrame, tious=TIOUS, ks=(1, 5)) -> DataFrame:
    """Share of annotations hit (tIoU > t) by one of the first k * n predictions, n annotations per clip and label.

    Predictions rank by score, then id. Clips or labels without prediction count as misses.
    """
    group = ["clip_id", "label"]
    n_gt = gt.groupBy(*group).agg(F.count("*").alias("n_gt"))
    ranked = keyed_index(
        pred.select(*group, "pred_id", "t_start", "t_end", "score"), group,
        [F.col("score").desc(), F.col("pred_id")], "rank",
    )
    depth = F.floor(F.col("rank") / F.col("n_gt")) + 1  # smallest k whose first k * n hold this rank
    usable = ranked.join(n_gt, group).where(F.col("rank") < max(ks) * F.col("n_gt")).select(
        *group, "t_start", "t_end", depth.alias("depth")
    )
    best = (
        overlap_join(usable, gt.select(*group, "seg_id", "t_start", "t_end"), group)
        .groupBy(F.col("b_seg_id").alias("seg_id"))
        .agg(*[F.max(F.when(F.col("a_depth") <= k, F.col("tiou"))).alias(f"best_{k}") for k in ks])
    )
    per_gt = gt.select("seg_id").join(best, "seg_id", "left")
    sums = per_gt.agg(
        *[
            F.avg(F.when(F.col(f"best_{k}") > t, 1.0).otherwise(0.0)).alias(f"r_{i}_{k}")
            for i, t in enumerate(tious)
            for k in ks
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(float(t)).alias("tiou"), F.lit(k).alias("k"), F.col(f"r_{i}_{k}").alias("recall"))
            for i, t in enumerate(tious)
            for k in ks
        ]
    )
    return sums.select(F.inline(rows))


# ---- average precision -------------------------------------------------------------------


def _ranked_sums(df: DataFrame, keys: list[str], order: list[Column], hit: Column, mass: Column) -> DataFrame:
    return ordered_scan(df, keys, order, {"cum_tp": ("sum", hit, True), "cum_n": ("sum", mass, True)})


def average_precision(scores: DataFrame, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Non-interpolated AP per key: mean precision at the positions of the positives, by score, ties by (video, t).

    With a weight column both the true positives and the ranks accumulate weights.
    """
    keys = keys or ["label"]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    order = [F.col("score").desc(), *[F.col(c) for c in ("video_id", "t") if c in scores.columns]]
    run = _ranked_sums(scores, keys, order, F.col("target") * w, w)
    return run.groupBy(*keys).agg(
        (
            F.sum(F.when(F.col("target") == 1, F.try_divide("cum_tp", "cum_n")).otherwise(0.0))
            / F.greatest(F.sum("target"), F.lit(1))
        ).alias("ap")
    )


def interpolated_ap(curve: DataFrame, keys: list[str], order: str = "rank") -> DataFrame:
    """Area under the precision envelope of (recall, precision) points given in rank order.

    The envelope at a rank is the largest precision at that rank or later; each rise of recall
    adds its width times the envelope.
    """
    env = ordered_scan(curve, keys, [F.col(order).desc()], {"envelope": ("max", F.col("precision"), True)})
    step = ordered_scan(env, keys, [F.col(order)], {"prev_recall": ("last", F.col("recall"), False)})
    rise = F.col("recall") - F.coalesce("prev_recall", F.lit(0.0))
    return step.groupBy(*keys).agg(F.sum(rise * F.col("envelope")).alias("ap"))


def assign_detections(pairs: DataFrame, tious=TIOUS, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """(tiou_t, pred_id, seg_id): one-to-one greedy assignment at each threshold.

    pairs has (clip_id, label, pred_id, seg_id, score, tiou). Predictions in score order, ties by id, each take the best free
    annotation with tiou >= tiou_t, ties to the smaller seg_id. Pairs of a clip and label depend on no others: bounded ones are
    folded in one task, larger ones are cut into connected components first, and only components beyond the bound go through rounds.
    """
    levels = [float(t) for t in tious]
    schema = "tiou_t double, pred_id long, seg_id long"
    narrow = pairs.where(F.col("tiou") >= min(levels)).select("clip_id", "label", "pred_id", "seg_id", "score", "tiou")

    def fold(rows: pa.RecordBatch, bounds: np.ndarray) -> pa.RecordBatch:
        pred, seg, rank, tiou = (rows[c].to_numpy(zero_copy_only=False) for c in ("pred_id", "seg_id", "score", "tiou"))
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        order = np.lexsort((seg, -tiou, pred, -rank, group))
        out = []
        for t in levels:
            at = order[tiou[order] >= t]
            done, used = set(), set()
            for g, p, s in zip(group[at].tolist(), pred[at].tolist(), seg[at].tolist()):
                if (g, p) not in done and (g, s) not in used:
                    done.add((g, p))
                    used.add((g, s))
                    out.append((t, p, s))
        columns = list(zip(*out)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.float64(), pa.int64(), pa.int64()))], names=["tiou_t", "pred_id", "seg_id"])

    keys = ["clip_id", "label"]
    narrow = cut(narrow)
    small, large = split_by_size(narrow, keys, fold_rows)
    parts = [fold_groups(small, keys, fold, schema)]
    if large is not None:
        parted = cut(with_component(large, ["pred_id"], ["seg_id"]))
        small, large = split_by_size(parted, ["_part"], fold_rows)
        parts.append(fold_groups(small, ["_part"], fold, schema))
        if large is not None:
            at = large.withColumn("tiou_t", F.explode(F.array(*map(F.lit, levels)))).where("tiou >= tiou_t")
            parts.append(assign_by_rounds(at).select("tiou_t", "pred_id", "seg_id"))
    return reduce(DataFrame.unionByName, parts)


def assign_by_rounds(pairs: DataFrame) -> DataFrame:
    """The same for pairs (tiou_t, pred_id, seg_id, score, tiou) without a bound on their number, in rounds of proposals.

    The greedy result is the stable matching in which annotations prefer higher scores and predictions prefer higher tIoU: every
    prediction proposes its best remaining annotation, every annotation keeps its best proposer and drops all weaker candidates.
    """
    left = cut(pairs.select("tiou_t", "pred_id", "seg_id", "score", "tiou"))
    size = left.count()
    pred_best = F.max_by(F.struct("seg_id", "score", "tiou"), F.struct("tiou", -F.col("seg_id")))
    while True:
        offers = left.groupBy("tiou_t", "pred_id").agg(pred_best.alias("o")).select("tiou_t", "pred_id", "o.*")
        held = offers.groupBy("tiou_t", "seg_id").agg(
            F.max(F.struct(F.col("score").alias("s"), (-F.col("pred_id")).alias("p"))).alias("h")
        )
        kept = left.join(held, ["tiou_t", "seg_id"], "left").where(
            F.col("h").isNull() | (F.struct(F.col("score").alias("s"), (-F.col("pred_id")).alias("p")) >= F.col("h"))
        )
        kept = cut(kept.select(left.columns))
        now = kept.count()
        if now == size:
            # nothing was refused, so every offer is accepted
            return offers
        left, size = kept, now


def detection_map(pred: DataFrame, gt: DataFrame, tious=TIOUS) -> DataFrame:
    """(label, tiou_t, ap, n_gt): interpolated AP of greedily matched detections per label and threshold.

    Predictions are ranked once per label; only the matched ones go through the running sums, as
    recall rises and the envelope changes nowhere else.
    """
    levels = F.array(*[F.lit(float(t)) for t in tious])
    hits = assign_detections(match_segments(pred, gt), tious).select("tiou_t", "pred_id")
    n_gt = gt.groupBy("label").agg(F.count("*").alias("n_gt"))
    ranked = keyed_index(
        pred.select("label", "pred_id", "score"), ["label"], [F.col("score").desc(), F.col("pred_id")], "rank"
    )
    keys = ["label", "tiou_t"]
    run = ordered_scan(
        ranked.join(hits, "pred_id"), keys, [F.col("rank")], {"cum_tp": ("sum", F.lit(1), True)}
    ).select(*keys, "rank", (F.col("cum_tp") / (F.col("rank") + 1)).alias("precision"))
    env = ordered_scan(run, keys, [F.col("rank").desc()], {"envelope": ("max", F.col("precision"), True)})
    area = env.groupBy(*keys).agg(F.sum("envelope").alias("area"))
    return (
        n_gt.withColumn("tiou_t", F.explode(levels))
        .join(area, keys, "left")
        .select("label", "tiou_t", (F.coalesce("area", F.lit(0.0)) / F.col("n_gt")).alias("ap"), "n_gt")
    )


def mean_ap(ap: DataFrame) -> DataFrame:
    """mAP per threshold and, with a null threshold, the mean over all thresholds."""
    return ap.rollup("tiou_t").agg(F.avg("ap").alias("map"))


# ---- thresholded and conditional metrics ---------------------------------------------------


def multilabel_prf(scores: DataFrame, thresh: float = 0.5) -> DataFrame:
    """Per class precision, recall, support (0 where undefined) and average precision at ties-as-one steps."""
    said = F.col("score") >= thresh
    base = scores.groupBy("label").agg(
        F.count(F.when(said & (F.col("target") == 1), 1)).alias("tp"),
        F.count(F.when(said, 1)).alias("n_pred"),
        F.sum("target").alias("support"),
    )
    ap = step_average_precision(scores, ["label"])
    return base.join(ap, "label").select(
        "label",
        F.coalesce(F.try_divide("tp", "n_pred"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)).alias("recall"),
        "support",
        "ap",
    )


def step_average_precision(scores: DataFrame, keys: list[str]) -> DataFrame:
    """AP as the sum over distinct scores of recall gain times precision; equal scores form one step."""
    return steps_average_precision(scores.groupBy(*keys, "score").agg(F.sum("target").alias("pos"), F.count("*").alias("n")), keys)


def steps_average_precision(steps: DataFrame, keys: list[str]) -> DataFrame:
    """The same from (keys, score, pos, n), one row per distinct score with its positives and rows."""
    run = _ranked_sums(steps, keys, [F.col("score").desc()], F.col("pos"), F.col("n"))
    return run.groupBy(*keys).agg(
        F.coalesce(
            F.try_divide(F.sum(F.col("pos") * F.col("cum_tp") / F.col("cum_n")), F.sum("pos")), F.lit(0.0)
        ).alias("ap")
    )


def tau_mask(active: DataFrame, tau: int) -> DataFrame:
    """Sparse (video_id, t, label): label inactive at t but active in the tau steps before it (after it for tau < 0).

    active holds the (video_id, t, label) rows with the label on. Steps are integers of one video;
    rows outside the observed steps are removed by the caller's join.
    """
    if tau == 0:
        return active.select("video_id", "t", "label").distinct()
    reach = F.sequence(F.lit(1), F.lit(abs(tau)))
    sign = 1 if tau > 0 else -1
    on = active.select("video_id", F.col("t").cast("long").alias("t"), "label")
    near = on.select("video_id", "label", F.explode(F.transform(reach, lambda d: F.col("t") + sign * d)).alias("t"))
    return near.distinct().join(on, ["video_id", "t", "label"], "left_anti").select("video_id", "t", "label")


def conditional_metrics(scores: DataFrame, tau: int = 0, thresh: float = 0.5) -> DataFrame:
    """(cond, label, n, precision, recall, ap) of class `label` over the steps where class `cond` is (or was) active.

    Pairs without a positive and the diagonal are left out, as in an average that skips undefined cells.
    """
    long_t = scores.withColumn("t", F.col("t").cast("long"))
    mask = tau_mask(long_t.where("target = 1"), tau).withColumnRenamed("label", "cond")
    sub = long_t.join(mask, ["video_id", "t"]).where("cond <> label")
    said = F.col("score") >= thresh
    base = sub.groupBy("cond", "label").agg(
        F.count(F.when(said & (F.col("target") == 1), 1)).alias("tp"),
        F.count(F.when(said, 1)).alias("n_pred"),
        F.sum("target").alias("n"),
    ).where("n > 0")
    ap = step_average_precision(sub.select("cond", "label", "score", "target"), ["cond", "label"])
    return base.join(ap, ["cond", "label"]).select(
        "cond", "label", "n",
        F.coalesce(F.try_divide("tp", "n_pred"), F.lit(0.0)).alias("precision"),
        (F.col("tp") / F.col("n")).alias("recall"),
        "ap",
    )


def conditional_summary(cells: DataFrame) -> DataFrame:
    return cells.agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("ap").alias("map")
    ).withColumn(
        "f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-9)
    )


def classification_metrics(df: DataFrame, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """Accuracy, F1 and Matthews correlation of two binary columns, and the mean of accuracy and F1."""
    g, p = F.col(gt) == 1, F.col(pred) == 1
    cells = df.agg(
        F.count(F.when(g & p, 1)).cast("double").alias("tp"),
        F.count(F.when(~g & p, 1)).cast("double").alias("fp"),
        F.count(F.when(g & ~p, 1)).cast("double").alias("fn"),
        F.count(F.when(~g & ~p, 1)).cast("double").alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    zero = F.lit(0.0)
    acc = F.try_divide(tp + tn, tp + fp + fn + tn)
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero)
    return cells.select(
        acc.alias("accuracy"),
        f1.alias("f1"),
        F.coalesce(F.try_divide(tp * tn - fp * fn, den), zero).alias("mcc"),
        ((acc + f1) / 2).alias("acc_and_f1"),
    )


def correlation_metrics(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson, Spearman (average ranks) and their mean.

    Ranks come from the table of distinct values with counts, so ties share one row and only
    distinct values are scanned in order.
    """

    def ranks(c: str, out: str) -> DataFrame:
        vals = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n"))
        run = ordered_scan(vals, [], [F.col(c)], {"_before": ("sum", F.col("_n"), False)})
        return run.select(c, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(out))

    rx, ry = ranks(x, "_rx"), ranks(y, "_ry")
    joined = df.select(x, y).join(rx, x).join(ry, y)
    return joined.agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman")).withColumn(
        "corr", (F.col("pearson") + F.col("spearman")) / 2
    )


def vqa_accuracy(df: DataFrame, answers: str = "answers", pred: str = "pred") -> DataFrame:
    """Mean reference weight of the predicted answer; answers is a map answer -> weight."""
    return df.agg(F.avg(F.coalesce(F.try_element_at(F.col(answers), F.col(pred)), F.lit(0.0))).alias("accuracy"))
