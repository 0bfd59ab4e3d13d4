"""Filters, aggregates and statistics over clip annotations."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.plans.binned import overlap_join
from spanlake.operators.sets import split_by_size
from spanlake.plans.scan import ordered_scan
from spanlake.session import cut


# ---- projections and filters -------------------------------------------------------------


def flatten_annotations(segments: DataFrame, clips: DataFrame) -> DataFrame:
    """One row per annotation with its clip attributes; clips without annotation keep one null row."""
    return clips.join(segments, "clip_id", "left").select(
        "subset",
        "label",
        "video_id",
        "clip_id",
        F.col("duration").alias("clip_duration"),
        "fps",
        (F.col("t_end") - F.col("t_start")).alias("label_duration"),
        F.col("t_start").alias("label_start"),
        F.col("t_end").alias("label_end"),
    )


def filter_split(df: DataFrame, splits: list[str]) -> DataFrame:
    return df.where(F.lower("subset").isin([s.lower() for s in splits]))


def filter_fps(clips: DataFrame, lo: float = 10, hi: float = 100) -> DataFrame:
    """Add fps = frames / duration of the clip in its video and keep lo <= fps <= hi."""
    start = F.greatest(F.col("video_start_sec").cast("double"), F.lit(0.0))
    frames = F.col("video_end_frame") - F.greatest(F.col("video_start_frame"), F.lit(0))
    return clips.withColumn("fps", F.try_divide(frames, F.col("video_end_sec").cast("double") - start)).where(
        F.col("fps").between(lo, hi)
    )


def score_threshold(df: DataFrame, t: float) -> DataFrame:
    return df.where(F.col("score") > t)


def validate_labels(df: DataFrame, lo: int, hi: int, value: str = "label", sizes: tuple[str, str] | None = None) -> DataFrame:
    """Violating rows with a reason: label_out_of_range, and size_mismatch when two size columns are named."""
    bad = [df.where(~F.col(value).between(lo, hi)).withColumn("reason", F.lit("label_out_of_range"))]
    if sizes:
        bad.append(
            df.where(~F.col(sizes[0]).eqNullSafe(F.col(sizes[1]))).withColumn("reason", F.lit("size_mismatch"))
        )
    return reduce(DataFrame.unionByName, bad)


def drop_empty_videos(videos: DataFrame, actions: DataFrame, key: str = "video_uid") -> DataFrame:
    """Videos that still have at least one action."""
    return videos.join(actions.select(key).distinct(), key, "left_semi")


def empty_video_report(videos: DataFrame, actions: DataFrame, key: str = "video_uid") -> DataFrame:
    """Number of videos before and after drop_empty_videos."""
    flag = actions.select(key).distinct().withColumn("_has", F.lit(1))
    return videos.join(flag, key, "left").agg(
        F.count("*").alias("n_before"), F.count("_has").alias("n_after")
    )


# ---- counts ------------------------------------------------------------------------------


def clips_per_subset(df: DataFrame, rollup: bool = False) -> DataFrame:
    distinct = df.select("subset", "clip_id").dropDuplicates(["clip_id"])
    grouped = distinct.rollup("subset") if rollup else distinct.groupBy("subset")
    return grouped.agg(F.count("*").alias("n_clips"))


def annotations_per_clip(flat: DataFrame) -> DataFrame:
    return flat.groupBy("clip_id").agg(F.count("*").alias("n_annotations"))


def clips_per_video(df: DataFrame) -> DataFrame:
    return df.groupBy("video_id").agg(F.countDistinct("clip_id").alias("n_clips"))


def label_counts(df: DataFrame) -> DataFrame:
    return (
        df.where("label is not null")
        .groupBy("label")
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "label")
    )


def label_frequencies(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Counter over a column of label arrays."""
    return df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def clip_label_map(df: DataFrame) -> DataFrame:
    """Per clip a map label -> count; a map holds at most one entry per label class."""
    return (
        df.groupBy("clip_id", "label")
        .agg(F.count("*").alias("n"))
        .groupBy("clip_id")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("label_map"))
    )


def presence_counts(df: DataFrame, image: str = "frame_id", label: str = "label", groups: dict[str, list] | None = None) -> DataFrame:
    """Number of images in which each label, or each named group of labels, occurs."""
    if groups is None:
        return df.select(image, label).distinct().groupBy(label).agg(F.count("*").alias("n_images"))
    lookup: Column = F.lit(None).cast("string")
    tagged = F.array(*[F.when(F.col(label).isin(v), F.lit(k)) for k, v in groups.items()]) if groups else F.array(lookup)
    return (
        df.select(image, F.explode(F.array_compact(tagged)).alias("label_group"))
        .distinct()
        .groupBy("label_group")
        .agg(F.count("*").alias("n_images"))
    )


def video_action_counts(actions: DataFrame, key: str = "video_uid") -> DataFrame:
    """Actions per video and, in each row, the total; the total is summed over the small count table."""
    per = actions.groupBy(key).agg(F.count("*").alias("n_actions"))
    total = actions.agg(F.count("*").alias("n_total"))
    return per.join(F.broadcast(total))  # total is one row


def pair_counts(df: DataFrame, first: str = "verb", second: str = "noun") -> DataFrame:
    filled = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "" for c in (first, second)]
    return df.where(filled[0] & filled[1]).groupBy(first, second).agg(F.count("*").alias("n"))


# ---- distributions -----------------------------------------------------------------------


def percentiles(df: DataFrame, col: str, ps: list[float], accuracy: int = 10_000) -> DataFrame:
    """(p, n, value): exact percentiles by linear interpolation, without nulls and NaN; no rows if nothing is left.

    A first pass counts the rows and brackets each wanted rank between two approximate percentiles; a second one counts the rows below
    each bracket. Only the rows inside are then folded by value and scanned in order, spread over all tasks. A bracket
    that misses its rank, as an approximation may, is widened to the whole range.
    """
    spark = df.sparkSession
    values = df.select(F.col(col).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    slack = 4.0 / accuracy
    asked = sorted({min(1.0, max(0.0, p + d)) for p in ps for d in (-slack, slack)})
    head = values.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.percentile_approx("v", asked, accuracy).alias("q")).first()
    n = head["n"]
    kind = "p double, n long, value double"
    if not n:
        return spark.createDataFrame([], kind)
    at = dict(zip(asked, head["q"]))
    ranks = {p: (int((n - 1) * p), min(n - 1, int((n - 1) * p) + 1)) for p in ps}
    ends = {p: (at[max(0.0, p - slack)], at[min(1.0, p + slack)]) for p in ps}

    def sizes(ends):
        """Rows below and up to the end of each bracket."""
        row = values.agg(*[F.count(F.when(c, 1)) for p in ps for c in (F.col("v") < ends[p][0], F.col("v") <= ends[p][1])]).first()
        return {p: (row[2 * i], row[2 * i + 1]) for i, p in enumerate(ps)}

    held = sizes(ends)
    missed = [p for p in ps if not held[p][0] <= ranks[p][0] <= ranks[p][1] < held[p][1]]
    for p in missed:
        ends[p], held[p] = (head["lo"], head["hi"]), (0, n)
    rows = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(ends[p][0]).alias("a"), F.lit(ends[p][1]).alias("b"), F.lit(held[p][0]).alias("below"), F.lit(ranks[p][0]).alias("r0"), F.lit(ranks[p][1]).alias("r1")) for p in ps])
    inside = values.select("v", F.explode(F.filter(rows, lambda x: (F.col("v") >= x["a"]) & (F.col("v") <= x["b"]))).alias("x"))
    steps = inside.groupBy("x.p", "v").agg(F.count("*").alias("m"), *[F.first(f"x.{c}").alias(c) for c in ("below", "r0", "r1")])
    run = ordered_scan(steps, ["p"], [F.col("v")], {"upto": ("sum", F.col("m"), True)})
    last, first = F.col("below") + F.col("upto"), F.col("below") + F.col("upto") - F.col("m")
    holds = lambda r: (first <= F.col(r)) & (F.col(r) < last)
    found = run.groupBy("p").agg(F.max(F.when(holds("r0"), F.col("v"))).alias("v0"), F.max(F.when(holds("r1"), F.col("v"))).alias("v1"))
    part = F.lit(float(n - 1)) * F.col("p") - F.floor(F.lit(float(n - 1)) * F.col("p"))
    return found.select("p", F.lit(n).cast("long").alias("n"), (F.col("v0") + (F.col("v1") - F.col("v0")) * part).alias("value"))


def distribution_summary(df: DataFrame, col: str, approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Count, median and interquartile range without nulls and NaN, exact at any number of distinct values.

    approx takes one pass less and values that occur, off by at most n / accuracy ranks.
    """
    ps = [0.25, 0.5, 0.75]
    if approx:
        clean = df.select(F.col(col).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
        q = clean.agg(F.count("*").alias("n"), F.percentile_approx("v", ps, accuracy).alias("q"))
    else:
        at = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
        q = percentiles(df, col, ps, accuracy).agg(F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("n"), F.array(*map(at, ps)).alias("q"))
    return q.select(
        "n",
        F.col("q")[1].alias("median"),
        F.col("q")[0].alias("q1"),
        F.col("q")[2].alias("q3"),
        (F.col("q")[2] - F.col("q")[0]).alias("iqr"),
    )


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin includes its right edge; empty bins are rows too."""
    v = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).select(
        F.col(col).cast("double").alias("v")
    )
    span = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    # a single value is widened by one half to both sides
    edge = span.select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    ).where("lo is not null")
    w = (F.col("hi") - F.col("lo")) / bins
    counts = (
        v.join(F.broadcast(edge))  # edge is one row
        .select(F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / w)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    grid = edge.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(F.broadcast(counts), "bin", "left").select(  # counts has at most `bins` rows
        "bin",
        (F.col("lo") + F.col("bin") * w).alias("left_edge"),
        (F.col("lo") + (F.col("bin") + 1) * w).alias("right_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def overlap_pairs(segments: DataFrame) -> DataFrame:
    """Ordered pairs of different annotations of one clip that intersect, with tiou.

    Each unordered pair is found once and mirrored, which halves the join.
    """
    narrow = segments.select("clip_id", "seg_id", "t_start", "t_end")
    once = overlap_join(narrow, narrow, ["clip_id"]).where("a_seg_id < b_seg_id").select(
        "clip_id", "a_seg_id", "b_seg_id", "tiou"
    )
    both = F.array(F.struct(F.col("a_seg_id").alias("a"), F.col("b_seg_id").alias("b")),
                   F.struct(F.col("b_seg_id").alias("a"), F.col("a_seg_id").alias("b")))
    return once.select("clip_id", "tiou", F.explode(both).alias("p")).select(
        "clip_id", F.col("p.a").alias("a_seg_id"), F.col("p.b").alias("b_seg_id"), "tiou"
    )


def overlap_stats(segments: DataFrame) -> DataFrame:
    """Per clip the number of ordered intersecting pairs and their tIoU mean and maximum; 0 for none.

    Each unordered pair is formed once and folded at once, as the tIoU of a pair needs both its ends; a pair's mirror
    has the same tIoU and only doubles the number. Counts alone come from overlap_partners without pairs.
    """
    narrow = segments.select("clip_id", "seg_id", "t_start", "t_end")
    pairs = (
        overlap_join(narrow, narrow, ["clip_id"]).where("a_seg_id < b_seg_id")
        .groupBy("clip_id")
        .agg((2 * F.count("*")).alias("n_pairs"), F.avg("tiou").alias("mean_tiou"), F.max("tiou").alias("max_tiou"))
    )
    return (
        segments.select("clip_id")
        .distinct()
        .join(pairs, "clip_id", "left")
        .select("clip_id", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "mean_tiou", "max_tiou")
    )


def overlap_partners(segments: DataFrame) -> DataFrame:
    """(clip_id, seg_id, n_partners): how many other segments of the clip strictly intersect each one, without forming pairs.

    The partners of [s, e) are the segments that start before e, less those that end by s. Both ranks come from one scan over
    all starts and ends in order of time, so a second that holds many segments costs no more than its rows. A segment
    without length meets those that contain its point strictly; others at the same point do not meet it.
    """
    point = F.col("t_start") == F.col("t_end")
    ends = F.array(
        # at one time ends come first: they ask for starts before them, and starts ask for ends up to them
        F.struct(F.col("t_end").alias("x"), F.lit(0).alias("kind"), (F.lit(0)).alias("s"), F.lit(1).alias("e")),
        F.struct(F.col("t_start").alias("x"), F.lit(1).alias("kind"), F.lit(1).alias("s"), F.lit(0).alias("e")),
    )
    events = segments.where("t_start IS NOT NULL AND t_end IS NOT NULL").select("clip_id", "seg_id", point.alias("point"), F.explode(ends).alias("v")).select("clip_id", "seg_id", "point", "v.*")
    sums = {"starts": ("sum", F.col("s").cast("long"), True), "ends": ("sum", F.col("e").cast("long"), True), "points": ("sum", (F.col("point") & (F.col("kind") == 1)).cast("long"), True)}
    run = ordered_scan(events, ["clip_id"], [F.col("x"), F.col("kind"), F.col("seg_id")], sums)
    asked = F.when(F.col("kind") == 0, F.col("starts")).otherwise(-F.col("ends"))
    per = run.groupBy("clip_id", "seg_id").agg(F.sum(asked).alias("n"), F.max("point").alias("point"), F.max("x").alias("x"))
    # a point at x subtracts all points at x, itself among them, though none of them was counted
    here = segments.where(point).groupBy("clip_id", F.col("t_start").alias("x")).agg(F.count("*").alias("_m"))
    fixed = per.join(here, ["clip_id", "x"], "left")
    own = F.when(F.col("point"), F.coalesce("_m", F.lit(0))).otherwise(-1)
    return fixed.select("clip_id", "seg_id", (F.col("n") + own).alias("n_partners"))


def activity_islands(segments: DataFrame, clips: DataFrame) -> DataFrame:
    """(clip_id, label, s, e): the whole seconds [s, e) in which a label is active, as disjoint islands.

    Times are truncated to whole seconds and cut at the clip's whole duration; a segment of a clip without a row has none.
    """
    cut = segments.join(clips.select("clip_id", F.floor("duration").alias("_d")), "clip_id").select(
        "clip_id", "label", F.greatest(F.floor("t_start"), F.lit(0)).alias("s"), F.least(F.floor("t_end"), F.col("_d")).alias("e")
    )
    # of equal starts the longest counts
    whole = cut.where("e > s AND label IS NOT NULL").groupBy("clip_id", "label", "s").agg(F.max("e").alias("e"))
    seen = ordered_scan(whole, ["clip_id", "label"], [F.col("s")], {"until": ("max", F.col("e"), False)})
    first = F.when(F.col("until").isNull() | (F.col("s") > F.col("until")), F.col("s"))
    island = ordered_scan(seen, ["clip_id", "label"], [F.col("s")], {"island": ("last", first, True)})
    return island.groupBy("clip_id", "label", F.col("island").alias("s")).agg(F.max("e").alias("e"))


#: Seconds of a clip that one group holds: at most this many flags per label, whatever the number of segments.
CHUNK_SECONDS = 3600


#: Islands up to which those of a chunk are joined with each other; a chunk with more is read off flags.
CHUNK_ISLANDS = 64


def _active_pairs(chunk: pa.Table) -> pa.Table:
    """Pairs of labels that share a second of one chunk."""
    labels, of = np.unique(chunk["label"].to_numpy(zero_copy_only=False), return_inverse=True)
    active = np.zeros((len(labels), CHUNK_SECONDS + 1), np.float32)
    np.add.at(active, (of, chunk["s"].to_numpy()), 1)
    np.add.at(active, (of, chunk["e"].to_numpy()), -1)
    active = active.cumsum(1)
    a, b = np.nonzero(np.triu(active @ active.T, 1) > 0)
    clip = pa.array([chunk["clip_id"][0].as_py()] * len(a), chunk.schema.field("clip_id").type)
    return pa.table({"clip_id": clip, "x": pa.array(labels[a], pa.string()), "y": pa.array(labels[b], pa.string())})


def label_cooccurrence(segments: DataFrame, clips: DataFrame) -> DataFrame:
    """(label_a, label_b, n_clips, weight): clips in which both labels are active in one whole second.

    weight is the natural log of the count; absent edges and the diagonal are not rows. Islands of activity are cut into
    chunks of CHUNK_SECONDS. The islands of a sparse chunk are joined, at most CHUNK_ISLANDS with each other; a dense one costs a call, and its
    flags are bounded by the number of labels.
    """
    w = CHUNK_SECONDS
    kind = dict(segments.dtypes)
    chunk = F.explode(F.sequence(F.floor(F.col("s") / w), F.floor((F.col("e") - 1) / w))).alias("chunk")
    pieces = activity_islands(segments, clips).select("clip_id", F.col("label").cast("string").alias("label"), "s", "e", chunk).select(
        "clip_id", "chunk", "label", (F.greatest("s", F.col("chunk") * w) - F.col("chunk") * w).alias("s"), (F.least("e", (F.col("chunk") + 1) * w) - F.col("chunk") * w).alias("e")
    )
    keys = ["clip_id", "chunk"]
    sparse, dense = split_by_size(cut(pieces), keys, CHUNK_ISLANDS)
    one, other = sparse.select(*keys, F.col("label").alias("x"), "s", "e"), sparse.select(*keys, F.col("label").alias("y"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    pairs = one.join(other, keys).where("x < y AND s < e2 AND s2 < e").select("clip_id", "x", "y")
    if dense is not None:
        pairs = pairs.unionByName(dense.groupBy(*keys).applyInArrow(_active_pairs, f"clip_id {kind['clip_id']}, x string, y string"))
    counted = pairs.distinct().groupBy("x", "y").agg(F.count("*").alias("n_clips"))
    both = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    return counted.select(F.explode(both).alias("e"), "n_clips").select(
        F.col("e.x").cast(kind["label"]).alias("label_a"), F.col("e.y").cast(kind["label"]).alias("label_b"), "n_clips", F.log("n_clips").alias("weight"),
    )


def label_activity(segments: DataFrame, clips: DataFrame) -> DataFrame:
    """(label, n, n_clips, seconds): annotations of each label, the clips that show it and its active whole seconds."""
    n = segments.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))
    shown = activity_islands(segments, clips).groupBy("label").agg(F.countDistinct("clip_id").alias("n_clips"), F.sum(F.col("e") - F.col("s")).alias("seconds"))
    zero = F.lit(0).cast("long")
    return n.join(shown, "label", "left").select("label", "n", F.coalesce("n_clips", zero).alias("n_clips"), F.coalesce("seconds", zero).alias("seconds"))


def confusion_matrix(df: DataFrame, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """Counts per (gt, pred) and percent within each gt."""
    cells = df.groupBy(gt, pred).agg(F.count("*").alias("n"))
    return cells.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(gt)))


def confusion_pivot(df: DataFrame, classes: list, gt: str = "gt", pred: str = "pred") -> DataFrame:
    return df.groupBy(gt).pivot(pred, classes).agg(F.count(F.lit(1))).na.fill(0)


# ---- comparisons -------------------------------------------------------------------------


def leaderboard(df: DataFrame, params: list[str], metric: str, rollup: bool = False) -> DataFrame:
    """Mean metric per configuration, best first."""
    grouped = df.rollup(*params) if rollup else df.groupBy(*params)
    return grouped.agg(F.avg(metric).alias(metric)).orderBy(F.col(metric).desc(), *params)


def parameter_grid(spark, grid: dict[str, list]) -> DataFrame:
    """All combinations of the given parameter values; as large as the product of the lists."""
    out = spark.range(1).drop("id")
    for name, values in grid.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def merge_partials(dfs: list[DataFrame], key: str) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs).orderBy(key)


def percent_diff(new: DataFrame, ref: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    r = ref.select(*keys, F.col(value).alias("ref_value"))
    return new.join(r, keys).select(
        *keys,
        value,
        "ref_value",
        (100 * F.try_divide(F.col(value) - F.col("ref_value"), F.col("ref_value"))).alias("percent_diff"),
    )
