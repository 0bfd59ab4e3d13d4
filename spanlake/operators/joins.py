"""Lookups, anti joins, positional and nearest joins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.boxes import box_cols, int_center
from spanlake.plans.scan import global_index, keyed_index, ordered_scan


# ---- lookups and membership ----------------------------------------------------------------


def missing_keys(df: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(lookup.select(*keys), keys, "left_anti")


def enrich_actions(actions: DataFrame, lookup: DataFrame, keys=("frame_path",), strict: bool = False) -> DataFrame:
    """Add the lookup columns by key. strict runs an anti join first and refuses missing keys."""
    keys = list(keys)
    if strict:
        lost = missing_keys(actions, lookup, keys).select(*keys).limit(1).collect()
        if lost:
            raise KeyError(f"no lookup row for {lost[0]}")
    return actions.join(lookup, keys)


def join_manifest(audio: DataFrame, translations: DataFrame, split: str, alt_suffix: str = "covost") -> DataFrame:
    """Audio rows with their translation for one split, by index; train also takes train_<alt_suffix>."""
    wanted = [split, f"{split}_{alt_suffix}"] if split == "train" else [split]
    return audio.join(translations.where(F.col("split").isin(wanted)), "path").orderBy("idx")


def part_lists(df: DataFrame, keys: list[str], order: str, cols: list[str], name: str, rows: int) -> DataFrame:
    """(keys, part, list of structs): the rows of each key in lists of `rows` entries, part by part in the given order.

    Every key has this shape, whatever its size: rows are numbered by a distributed scan, and no list is longer than `rows`.
    """
    placed = keyed_index(df.select(*keys, *cols), keys, [F.col(order)], "_pos")
    part = F.floor(F.col("_pos") / rows).alias("part")
    listed = placed.groupBy(*keys, part).agg(F.sort_array(F.collect_list(F.struct("_pos", *cols))).alias("_l"))
    return listed.select(*keys, "part", F.transform("_l", lambda x: F.struct(*[x[c].alias(c) for c in cols])).alias(name))


def attach_detections(frames: DataFrame, boxes: DataFrame, rows: int = 10_000) -> DataFrame:
    """Frames with their detections in order of det_id: one row per frame and part of at most `rows` detections.

    part counts from 0; a frame without detections has part 0 with an empty list.
    """
    cols = ["det_id", *[c for c in boxes.columns if c not in ("frame_id", "det_id")]]
    lists = part_lists(boxes, ["frame_id"], "det_id", cols, "detections", rows)
    joined = frames.join(lists, "frame_id", "left")
    return joined.withColumn("part", F.coalesce("part", F.lit(0).cast("long"))).withColumn("detections", F.coalesce("detections", F.array()))


def restrict_to(df: DataFrame, ids: DataFrame, key: str = "clip_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def decontaminate(train: DataFrame, heldout: DataFrame, sides=("src", "tgt"), text: str = "text") -> DataFrame:
    """Pairs of which neither side occurs as a line of the held-out text.

    The join key is a 64-bit hash, which keeps the shuffle narrow; the text itself decides.
    """
    seen = heldout.select(F.col(text).alias("_t")).distinct().withColumn("_k", F.xxhash64("_t"))
    out = train
    for side in sides:
        out = out.withColumn("_k", F.xxhash64(side))
        out = out.join(seen, (out["_k"] == seen["_k"]) & (out[side] == seen["_t"]), "left_anti").drop("_k")
    return out


# ---- comparisons of two tables -------------------------------------------------------------


def compare_versions(old: DataFrame, new: DataFrame, key: str = "clip_id") -> DataFrame:
    """Keys whose row counts differ; a key of one side only has a null count on the other."""
    a = old.groupBy(key).agg(F.count("*").alias("n_old"))
    b = new.groupBy(key).agg(F.count("*").alias("n_new"))
    return a.join(b, key, "full").where(~F.col("n_old").eqNullSafe(F.col("n_new")))


def verify_splits(listing: DataFrame, table: DataFrame, expected: DataFrame, path: str = "frame_path", video: str = "video_uid") -> DataFrame:
    """(issue, item, n_expected, n_found): rows on one side only and videos with other than the expected count."""
    null = F.lit(None).cast("long")
    only_l = listing.join(table.select(path), path, "left_anti").select(
        F.lit("not_in_table").alias("issue"), F.col(path).cast("string").alias("item"), null.alias("n_expected"), null.alias("n_found")
    )
    only_t = table.join(listing.select(path), path, "left_anti").select(
        F.lit("not_in_listing").alias("issue"), F.col(path).cast("string").alias("item"), null.alias("n_expected"), null.alias("n_found")
    )

    def counts(df: DataFrame, issue: str) -> DataFrame:
        found = df.groupBy(video).agg(F.count("*").alias("n_found"))
        return (
            expected.join(found, video, "left")
            .withColumn("n_found", F.coalesce("n_found", F.lit(0).cast("long")))
            .where("n_found <> n_expected")
            .select(F.lit(issue).alias("issue"), F.col(video).cast("string").alias("item"),
                    F.col("n_expected").cast("long").alias("n_expected"), "n_found")
        )

    return reduce(
        DataFrame.unionByName, [only_l, only_t, counts(table, "table_count"), counts(listing, "listing_count")]
    )


def plan_split_moves(expected: DataFrame, from_tab: DataFrame, to_tab: DataFrame, video: str = "video_uid", path: str = "frame_path") -> DataFrame:
    """(action, video, path): rows to move for videos incomplete in the target and complete in the source.

    A video that is complete in neither table gives one error row without path.
    """
    n_from = from_tab.groupBy(video).agg(F.count("*").alias("n_from"))
    n_to = to_tab.groupBy(video).agg(F.count("*").alias("n_to"))
    state = (
        expected.join(n_to, video, "left").join(n_from, video, "left")
        .where(F.coalesce("n_to", F.lit(0)) != F.col("n_expected"))
        .select(video, F.coalesce(F.col("n_from") == F.col("n_expected"), F.lit(False)).alias("ok"))
    )
    moves = from_tab.join(state.where("ok"), video, "left_semi").select(
        F.lit("move").alias("action"), video, F.col(path).cast("string").alias(path)
    )
    errors = state.where("not ok").select(
        F.lit("error").alias("action"), video, F.lit(None).cast("string").alias(path)
    )
    return moves.unionByName(errors)


def compare_extracted(orig: DataFrame, extracted: DataFrame, video: str = "video_uid", order: str = "clip_index", text: str = "text") -> DataFrame:
    """Per video with a difference: row counts and the first position whose texts differ (null if only the length does)."""
    def numbered(df: DataFrame, p: str) -> DataFrame:
        return keyed_index(df.select(video, order, text), [video], [F.col(order)], "pos").select(
            video, "pos", F.col(text).alias(p)
        )

    both = numbered(orig, "_o").join(numbered(extracted, "_e"), [video, "pos"], "full")
    return (
        both.groupBy(video)
        .agg(
            F.count("_o").alias("n_orig"), F.count("_e").alias("n_extracted"),
            F.min(F.when(F.col("_o").isNotNull() & F.col("_e").isNotNull() & (F.col("_o") != F.col("_e")), F.col("pos"))).alias("first_diff"),
        )
        .where("n_orig <> n_extracted or first_diff is not null")
    )


def remap_categories(ann: DataFrame, cats: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations and categories moved to target ids through the synset; unmapped rows drop, ids are renumbered from 1."""
    mapping = cats.join(target.select("synset", "target_id"), "synset").select("category_id", "synset", "target_id")
    moved = ann.join(mapping.select("category_id", "target_id"), "category_id").drop("category_id")
    numbered = global_index(moved.withColumnRenamed("target_id", "category_id"), [F.col("ann_id")], "_i")
    numbered = numbered.withColumn("new_id", F.col("_i") + 1).drop("_i")
    used = numbered.select(F.col("category_id").alias("target_id")).distinct()
    return numbered, mapping.join(used, "target_id", "left_semi")


# ---- positional and nearest joins ----------------------------------------------------------


def round_robin_zip(dfs: dict[str, DataFrame], order: dict[str, str]) -> DataFrame:
    """Rows zipped by position; shorter data sets repeat until the longest ends.

    Each short row is copied to all its positions before the join, so the join key is unique on
    both sides and a tiny data set makes no hot key.
    """
    sizes = {k: d.count() for k, d in dfs.items()}
    longest = max(sizes.values())
    out = None
    for name, df in dfs.items():
        idx = global_index(df, [F.col(order[name])], "_i")
        at = F.sequence(F.col("_i"), F.lit(longest - 1).cast("long"), F.lit(sizes[name]).cast("long"))
        laid = idx.withColumn("pos", F.explode(at)).select(
            "pos", *[F.col(c).alias(f"{name}_{c}") for c in df.columns]
        )
        out = laid if out is None else out.join(laid, "pos")
    return out


def nearest_center(hands: DataFrame, objs: DataFrame) -> DataFrame:
    """(frame_id, hand_id, det_id, dist): object nearest to hand centre + unit offset * magnitude * 1000, ties to the first.

    hands carry dx, dy, magnitude. Objects are first reduced to one per frame and integer centre,
    so a frame never holds more candidates than pixels.
    """
    ox, oy = int_center(box_cols())
    spots = objs.groupBy("frame_id", ox.alias("ox"), oy.alias("oy")).agg(F.min("det_id").alias("det_id"))
    hx, hy = int_center(box_cols())
    aim = hands.select(
        "frame_id", F.col("det_id").alias("hand_id"),
        (hx + F.col("dx") * F.col("magnitude") * 1000).alias("ax"),
        (hy + F.col("dy") * F.col("magnitude") * 1000).alias("ay"),
    )
    # a frame's spots travel as one list; each hand takes the least of its list inside its own row, so no pair is sorted
    lists = spots.groupBy("frame_id").agg(F.collect_list(F.struct("ox", "oy", "det_id")).alias("spots"))

    def seen(o: Column) -> Column:
        # nine decimals, so that equal distances tie whatever the rounding of the last bit
        return F.struct(F.round(F.hypot(o["ox"] - F.col("ax"), o["oy"] - F.col("ay")), 9).alias("dist"), o["det_id"].alias("det_id"))

    return (
        aim.join(lists, "frame_id")
        .select("frame_id", "hand_id", F.array_min(F.transform("spots", seen)).alias("m"))
        .groupBy("frame_id", "hand_id").agg(F.min("m").alias("m"))
        .select("frame_id", "hand_id", "m.det_id", "m.dist")
    )


def nearest_time_join(true: DataFrame, est: DataFrame, key: str, value: str = "value") -> DataFrame:
    """True rows (key, t, ...) with the estimate value nearest in time; 0 outside the estimate range, ties to the earlier.

    Two ordered scans carry the last estimate forward and the next one backward, so a long track
    is not held by one task.
    """
    keep = [c for c in true.columns if c not in (key, "t")]
    point = F.struct(F.col("t").alias("t"), F.col(value).cast("double").alias("v"))
    e = est.groupBy(key, "t").agg(F.min(value).alias(value))
    a = true.select(key, "t", F.struct(*keep, F.monotonically_increasing_id().alias("_u")).alias("_row"), F.lit(None).cast("struct<t:double,v:double>").alias("_pt"), F.lit(1).alias("_q"))
    b = e.select(key, F.col("t").cast("double").alias("t"), point.cast("struct<t:double,v:double>").alias("_pt"), F.lit(0).alias("_q"))
    mixed = a.withColumn("t", F.col("t").cast("double")).unionByName(b, allowMissingColumns=True)
    fwd = ordered_scan(mixed, [key], [F.col("t"), F.col("_q"), F.col("_row._u")], {"_prev": ("last", F.col("_pt"), True)})
    bwd = ordered_scan(
        fwd, [key], [F.col("t").desc(), F.col("_q"), F.col("_row._u")], {"_next": ("last", F.col("_pt"), True)}
    ).where("_q = 1")
    near = F.when(F.col("t") - F.col("_prev.t") <= F.col("_next.t") - F.col("t"), F.col("_prev.v")).otherwise(F.col("_next.v"))
    inside = F.col("_prev").isNotNull() & F.col("_next").isNotNull()
    return bwd.select(key, "t", *[F.col(f"_row.{c}").alias(c) for c in keep], F.when(inside, near).otherwise(0.0).alias("est_value"))


def pitch_errors(true: DataFrame, est: DataFrame, key: str, value: str = "f0") -> DataFrame:
    """Gross pitch error, voicing decision error and F0 frame error over all frames."""
    e = est.select(key, "t", F.col(value).alias("value"))
    j = nearest_time_join(true.select(key, "t", F.col(value).alias("f")), e, key)
    voiced = (F.col("f") != 0) & (F.col("est_value") != 0)
    gross = voiced & (F.abs(F.try_divide(F.col("est_value"), F.col("f") + 1e-8) - 1) > 0.2)
    differ = (F.col("f") != 0) != (F.col("est_value") != 0)

    def n(c: Column) -> Column:
        return F.count(F.when(c, 1))

    return j.agg(n(voiced).alias("v"), n(gross).alias("g"), n(differ).alias("d"), F.count("*").alias("n")).select(
        F.try_divide("g", "v").alias("gross_pitch_error"),
        F.try_divide("d", "n").alias("voicing_decision_error"),
        F.try_divide(F.col("g") + F.col("d"), F.col("n")).alias("f0_frame_error"),
    )


def _corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pixel runs (frame_id, object_label, y, x_start, x_end) as changes of change: what differs between a line's edges and those of the line above.

    Both ends of a run are a step along its line, and a line that ends its runs where the one above does adds nothing, so a
    batch of runs shrinks to the corners of its masks. Equal places of a batch are summed and zeros go.
    """
    for b in batches:
        if not b.num_rows:
            continue
        frame, label = (b[c].dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64) for c in ("frame_id", "object_label"))
        of = frame * (int(label.max()) + 1) + label
        y, x0, x1 = (b[c].to_numpy() for c in ("y", "x_start", "x_end"))
        owner, line, place = np.tile(of, 4), np.concatenate([y, y, y + 1, y + 1]), np.concatenate([x0, x1, x0, x1])
        step = np.repeat(np.array([1, -1, -1, 1], np.int64), b.num_rows)
        order = np.lexsort((place, line, owner))
        owner, line, place, step = owner[order], line[order], place[order], step[order]
        fresh = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(line) != 0) | (np.diff(place) != 0)]))
        total = np.add.reduceat(step, fresh)
        keep = fresh[total != 0]
        source = pa.array(order[keep] % b.num_rows)
        yield pa.RecordBatch.from_arrays(
            [b["frame_id"].take(source), b["object_label"].take(source), pa.array(line[keep]), pa.array(place[keep]), pa.array(total[total != 0])],
            names=["frame_id", "object_label", "y", "x", "d"],
        )


def _areas(boxes: pa.Table, corners: pa.Table) -> pa.Table:
    """Pixels of each mask inside each box, and of the whole mask, from sums over all lines above and columns left of a corner."""
    out: dict[str, list] = {c: [] for c in ("det_id", "object_label", "inside", "total")}
    x0, y0, x1, y1 = (boxes[c].to_numpy() for c in ("x0", "y0", "x1", "y1"))
    ids, box = np.unique(boxes["det_id"].to_numpy(), return_inverse=True)  # boxes of one number count together
    labels, of = np.unique(corners["object_label"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    line, column, step = (corners[c].to_numpy() for c in ("y", "x", "d"))
    for n, label in enumerate(labels):
        own = of == n
        ys, iy = np.unique(line[own], return_inverse=True)
        xs, ix = np.unique(column[own], return_inverse=True)
        cover = np.zeros((len(ys), len(xs)), np.int64)  # row k: pixels of each line from ys[k] on, by column between edges
        np.add.at(cover, (iy, ix), step[own])
        cover = cover.cumsum(1).cumsum(0)
        left = np.zeros_like(cover)
        left[:, 1:] = (cover[:, :-1] * np.diff(xs)).cumsum(1)
        # the same over all lines before ys[k]
        high = np.diff(ys)[:, None]
        above, above_left = np.zeros_like(cover), np.zeros_like(cover)
        above[1:], above_left[1:] = (cover[:-1] * high).cumsum(0), (left[:-1] * high).cumsum(0)

        def before(x, y):
            """Pixels with a smaller column than x on lines before y."""
            k, c = np.searchsorted(ys, y, "right") - 1, np.searchsorted(xs, x, "right") - 1
            inside = (c >= 0) & (k >= 0)
            k, c = np.maximum(k, 0), np.maximum(c, 0)
            more, right = y - ys[k], x - xs[c]
            return np.where(inside, above_left[k, c] + above[k, c] * right + more * (left[k, c] + cover[k, c] * right), 0)

        area = np.zeros(len(ids), np.int64)
        np.add.at(area, box, before(x1, y1) - before(x0, y1) - before(x1, y0) + before(x0, y0))
        hit = np.flatnonzero(area > 0)
        out["det_id"].append(ids[hit])
        out["object_label"] += [label] * len(hit)
        out["inside"].append(area[hit])
        out["total"].append(np.full(len(hit), above_left[-1, -1]))
    whole = {c: np.concatenate(v or [np.empty(0, np.int64)]) for c, v in out.items() if c != "object_label"}
    return pa.table({"det_id": whole["det_id"], "object_label": pa.array(out["object_label"], pa.string()), "inside": whole["inside"], "total": whole["total"]})


def box_mask_join(boxes: DataFrame, runs: DataFrame, diagonal: Column | float, min_ratio: float = 0.25, boxes_per_task: int = 50_000) -> DataFrame:
    """(frame_id, det_id, object_label, inside, outside) where a mask lies enough inside a box.

    runs are (frame_id, object_label, y, x_start, x_end) pixel runs with x_end exclusive; pixels drawn twice count twice. Each mask
    becomes a table of running sums over lines and columns between run edges, and a box reads its four corners
    there: its cost does not depend on its height. Runs shrink to the corners of their masks before they move, and a frame
    with more than boxes_per_task boxes is cut into parts that each get the masks. Kept are pairs with
    inside >= diagonal and inside / (outside + 1e-6) >= min_ratio.
    """
    corner = {c: F.bround(F.col(c)).cast("long") for c in ("x0", "y0", "x1", "y1")}
    b = boxes.select("frame_id", "det_id", *[e.alias(c) for c, e in corner.items()]).where("y1 > y0 and x1 > x0")
    kind = dict(boxes.dtypes)
    flat = runs.where("x_end > x_start").select("frame_id", F.col("object_label").cast("string").alias("object_label"), *[F.col(c).cast("long").alias(c) for c in ("y", "x_start", "x_end")])
    corners = (
        flat.mapInArrow(_corners, f"frame_id {dict(runs.dtypes)['frame_id']}, object_label string, y long, x long, d long")
        .groupBy("frame_id", "object_label", "y", "x").agg(F.sum("d").alias("d")).where("d <> 0")
    )
    parts = b.groupBy("frame_id").agg(F.ceil(F.count("*") / boxes_per_task).cast("int").alias("_parts"))
    left = b.join(parts, "frame_id").withColumn("part", F.pmod(F.xxhash64("det_id"), F.col("_parts")).cast("int")).drop("_parts")
    right = corners.join(parts, "frame_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")

    def summed(key, these: pa.Table, masks: pa.Table) -> pa.Table:
        found = _areas(these, masks)
        return found.add_column(0, "frame_id", pa.array([key[0].as_py()] * found.num_rows, these.schema.field("frame_id").type))

    schema = f"frame_id {kind['frame_id']}, det_id {kind['det_id']}, object_label string, inside long, total long"
    areas = left.groupBy("frame_id", "part").cogroup(right.groupBy("frame_id", "part")).applyInArrow(summed, schema)
    d = diagonal if isinstance(diagonal, Column) else F.lit(float(diagonal))
    return (
        areas.where(F.col("inside") >= d)
        .withColumn("outside", F.col("total") - F.col("inside"))
        .where(F.col("inside") / (F.col("outside") + 1e-6) >= min_ratio)
        .select("frame_id", "det_id", "object_label", "inside", "outside")
    )


def mask_to_box(runs: DataFrame) -> DataFrame:
    """Bounding box of each mask: extreme pixel positions of its runs."""
    return runs.groupBy("frame_id", "object_label").agg(
        F.min("x_start").alias("x0"), F.min("y").alias("y0"),
        (F.max("x_end") - 1).alias("x1"), F.max("y").alias("y1"),
    )
