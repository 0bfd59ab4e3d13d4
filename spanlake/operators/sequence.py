"""Windows, grids, runs, prompts and token-sequence operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.vectors import bound
from spanlake.functions.text import clean_label
from spanlake.plans.packing import CHUNK_ROWS, batch_pointers, greedy_blocks, sum_pointers
from spanlake.plans.scan import draw_unit, global_index, keyed_index, ordered_scan
from spanlake.session import spread


# ---- clip and frame windows ----------------------------------------------------------------


def split_common_rare(counts: DataFrame, fraction: float, keys=("verb", "noun")) -> DataFrame:
    """Add part: common up to and including the first pair whose running count reaches fraction of the total."""
    run = ordered_scan(counts, [], [F.col("n").desc(), *[F.col(k) for k in keys]], {"before": ("sum", F.col("n"), False)})
    total = counts.agg((F.sum("n") * fraction).alias("goal"))
    return run.join(F.broadcast(total)).select(  # goal is one row
        *keys, "n", F.when(F.col("before") < F.col("goal"), "common").otherwise("rare").alias("part")
    )


def running_prefix(df: DataFrame, order: list[Column], value: str, name: str = "running") -> DataFrame:
    """Inclusive running sum over a total order of the whole table."""
    return ordered_scan(df, [], order, {name: ("sum", F.col(value), True)})


# fixed connector words of the prompt
MEANWHILE = ["meanwhile ", "simultaneously ", "same time ", "meantime "]
THEN = ["then ", "later ", "afterwards ", "after "]


def build_prompt(segments: DataFrame, seed: int = 0) -> DataFrame:
    """(clip_id, prompt): first occurrence of each clean label in start order, joined by time connectors.

    Only the first row of a (clip, label) matters, so each clip is reduced to one row per label
    class before its list is built.
    """
    first = (
        segments.withColumn("label", clean_label(F.col("label")))
        .groupBy("clip_id", "label")
        .agg(F.min(F.struct("t_start", "seg_id", "t_end")).alias("s"))
    )
    acts = first.groupBy("clip_id").agg(
        F.sort_array(F.collect_list(F.struct("s.t_start", "s.seg_id", "s.t_end", "label"))).alias("a")
    )

    def word(words: list[str], clip: Column, seg: Column) -> Column:
        pick = F.floor(draw_unit(seed, clip, seg) * len(words)).cast("int")
        return F.element_at(F.array(*[F.lit(w) for w in words]), pick + 1)

    def step(state, x):
        end = state["end"]
        link = (
            F.when(x["t_start"] < end - 1, word(MEANWHILE, F.col("clip_id"), x["seg_id"]))
            .when((x["t_start"] >= end + 1) & (state["text"] != ""), word(THEN, F.col("clip_id"), x["seg_id"]))
            .otherwise("")
        )
        return F.struct(F.concat(state["text"], link, F.lit("I "), x["label"], F.lit(" .")).alias("text"), x["t_end"].alias("end"))

    start = F.struct(F.lit("").alias("text"), F.lit(-1.0).alias("end"))
    return acts.select("clip_id", F.aggregate("a", start, step, lambda s: s["text"]).alias("prompt"))


def narration_windows(df: DataFrame, length: float = 8.0, t: str = "t", duration: str = "duration") -> DataFrame:
    """Window of fixed length centred on t, moved into [0, duration]."""
    start = F.greatest(F.col(t) - length / 2, F.lit(0.0))
    over = start + length > F.col(duration)
    return df.withColumn("w_start", F.when(over, F.col(duration) - length).otherwise(start)).withColumn(
        "w_end", F.col("w_start") + length
    )


def clip_feature_windows(clips: DataFrame, clip_size: int = 32, stride: int = 16, inclusive_end: bool = False) -> DataFrame:
    """Feature index range [si, ei) of each clip: start aligned down to stride, length padded up to whole strides."""
    sf = F.greatest(F.col("video_start_frame"), F.lit(0))
    ef = F.col("video_end_frame")
    head = F.pmod(sf, F.lit(stride))
    rest = F.pmod(ef - sf + head - clip_size, F.lit(stride))
    tail = F.when(rest != 0, stride - rest).otherwise(0)
    ei = F.floor((ef + tail - clip_size) / stride) + (1 if inclusive_end else 0)
    return clips.withColumn("si", F.floor((sf - head) / stride)).withColumn("ei", ei)


def slice_clip_features(windows: DataFrame, features: DataFrame, video: str = "video_uid") -> DataFrame:
    """Feature rows (clip, t) with si <= t < ei; clips whose range passes the feature length give one error row.

    A clip of a video without any feature gives an error row, too.
    """
    n = features.groupBy(video).agg(F.count("*").alias("n_feats"))
    w = windows.join(n, video, "left")
    good = w.where("ei <= n_feats").withColumn("_t", F.explode(F.when(F.col("ei") > F.col("si"), F.sequence("si", F.col("ei") - 1))))
    rows = good.join(features.withColumnRenamed("t", "_t"), [video, "_t"]).select(
        "clip_uid", (F.col("_t") - F.col("si")).alias("t"), "_t", F.lit(None).cast("string").alias("error")
    )
    error = F.when(F.col("n_feats").isNull(), "no features").otherwise("end index exceeds feature length")
    bad = w.where("n_feats is null or ei > n_feats").select(
        "clip_uid", F.lit(None).cast("long").alias("t"), F.lit(None).cast("long").alias("_t"), error.alias("error")
    )
    return rows.unionByName(bad)


def stride_grid(clips: DataFrame, stride: int, frames: str = "n_frames") -> DataFrame:
    """Every stride-th frame index of each clip."""
    last = F.col(frames).cast("long") - 1
    return clips.where(last >= 0).withColumn("frame_index", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long"))))


def uniform_grid(clips: DataFrame, n: int = 1024, frames: str = "n_frames") -> DataFrame:
    """n frame indices int(i * N / n) spread over each clip."""
    return clips.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "frame_index", F.floor(F.col("i") * F.col(frames) / n)
    )


def pad_or_trim(frames: DataFrame, n: int = 1024, clip: str = "clip_id", order: str = "t") -> DataFrame:
    """First n rows of each clip that has at least n; the rank limit is applied before the shuffle, too."""
    w = Window.partitionBy(clip).orderBy(order)
    head = frames.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return head.drop("_rn").join(short_clips(frames, n, clip).select(clip), clip, "left_anti")


def short_clips(frames: DataFrame, n: int = 1024, clip: str = "clip_id") -> DataFrame:
    """Clips with fewer than n frames, which pad_or_trim refuses."""
    return frames.groupBy(clip).agg(F.count("*").alias("n_frames")).where(F.col("n_frames") < n)


def rasterize(segments: DataFrame) -> DataFrame:
    """(clip_id, t, label) for every integer t with t_start < t < t_end, once per label."""
    lo, hi = F.floor("t_start") + 1, F.ceil("t_end") - 1
    return segments.where(hi >= lo).select("clip_id", "label", F.explode(F.sequence(lo, hi)).alias("t")).distinct()


def to_feature_grid(segments: DataFrame, fps: Column | float | None, num_frames: int, stride: int, n_feats: Column | None = None, duration: Column | None = None) -> DataFrame:
    """Segment times as feature positions (t * fps - num_frames / 2) / stride; without fps it is n_feats / duration."""
    if fps is None:
        if n_feats is None or duration is None:
            raise ValueError("fps is unknown: give n_feats and duration")
        rate = F.try_divide(n_feats, duration)
    else:
        rate = fps if isinstance(fps, Column) else F.lit(float(fps))

    def pos(c: str) -> Column:
        return (F.col(c) * rate - 0.5 * num_frames) / stride

    return segments.withColumn("t_start", pos("t_start")).withColumn("t_end", pos("t_end"))


def downsample(frames: DataFrame, k: int) -> DataFrame:
    """Every k-th vector with its new position."""
    return frames.where(F.col("t") % k == 0).withColumn("t", F.floor(F.col("t") / k))


def random_window_crop(
    segments: DataFrame, clips: DataFrame, max_len: int, thresh: float = 0.5,
    crop_ratio: tuple[float, float] | None = None, mode: str = "has_action", seed: int = 0, trials: int = 200,
) -> DataFrame:
    """Segments of one seeded window per clip: the first of up to `trials` windows that is valid, else the last.

    clips are (clip_id, feat_len). has_action wants a segment kept by at least thresh; no_trunc also
    wants no partly cut segment; none takes the first window. Clips no longer than the window stay
    whole. Trials run in waves, so most clips are done after the first few.
    """
    low = F.lit(max_len)
    if crop_ratio is not None:
        lo = F.greatest(F.bround(F.col("feat_len") * crop_ratio[0]), F.lit(1))
        hi = F.least(F.bround(F.col("feat_len") * crop_ratio[1]), F.col("feat_len"))
        drawn = lo + F.floor(draw_unit(seed, F.lit("len"), F.col("clip_id")) * (hi - lo + 1))
        low = F.when(F.col("feat_len") <= max_len, drawn).otherwise(F.lit(max_len))
    base = clips.withColumn("win", low.cast("long")).withColumn("feat_len", F.col("feat_len").cast("long"))
    whole = base.where("feat_len <= win").select("clip_id", F.lit(0).cast("long").alias("st"), F.col("feat_len").alias("ed"))
    todo = base.where("feat_len > win")

    def window_at(df: DataFrame, a: int, b: int) -> DataFrame:
        d = df.withColumn("trial", F.explode(F.sequence(F.lit(a), F.lit(b - 1))))
        u = draw_unit(seed, F.col("clip_id"), F.col("trial"))
        st = F.floor(u * (F.col("feat_len") - F.col("win") + 1))
        return d.withColumn("st", st).withColumn("ed", F.col("st") + F.col("win"))

    chosen = []
    if mode == "none":
        chosen.append(window_at(todo, 0, 1).select("clip_id", "st", "ed"))
    else:
        a = 0
        for b in (8, 64, trials):
            b = min(b, trials)
            if b <= a:
                break
            tries = window_at(todo, a, b)
            inter = F.greatest(F.lit(0.0), F.least(F.col("ed"), F.col("t_end")) - F.greatest(F.col("st"), F.col("t_start")))
            ratio = F.try_divide(inter, F.abs(F.col("t_end") - F.col("t_start")))
            ok = F.max((ratio >= thresh).cast("int")) == 1
            if mode == "no_trunc":
                ok = ok & (F.max(((ratio > 0) & (ratio < 1)).cast("int")) == 0)
            valid = (
                segments.select("clip_id", "t_start", "t_end")
                .join(tries, "clip_id")
                .groupBy("clip_id", "trial", "st", "ed")
                .agg(ok.alias("ok"))
                .where("ok")
                .groupBy("clip_id")
                .agg(F.min(F.struct("trial", "st", "ed")).alias("m"))
                .select("clip_id", "m.st", "m.ed")
            )
            chosen.append(valid)
            todo = todo.join(valid.select("clip_id"), "clip_id", "left_anti")
            a = b
        chosen.append(window_at(todo, trials - 1, trials).select("clip_id", "st", "ed"))
    win = whole
    for c in chosen:
        win = win.unionByName(c)
    j = segments.join(win, "clip_id")
    left, right = F.greatest(F.col("st"), F.col("t_start")), F.least(F.col("ed"), F.col("t_end"))
    kept = F.try_divide(F.greatest(F.lit(0.0), right - left), F.abs(F.col("t_end") - F.col("t_start"))) >= thresh
    is_whole = F.col("clip_id").isNotNull() & (F.col("st") == 0) & F.col("_whole")
    flagged = j.join(whole.select("clip_id", F.lit(True).alias("_whole")), "clip_id", "left").withColumn("_whole", F.coalesce("_whole", F.lit(False)))
    return flagged.where(is_whole | kept).select(
        "clip_id", "seg_id", "label", "st", "ed",
        F.when(F.col("_whole"), F.col("t_start")).otherwise(left - F.col("st")).alias("t_start"),
        F.when(F.col("_whole"), F.col("t_end")).otherwise(right - F.col("st")).alias("t_end"),
    )


def gaps_and_islands(frames: DataFrame, keys: list[str], pos: str = "t", active: str = "active", stride: int = 1) -> DataFrame:
    """Runs of active frames as (keys, start, end), end exclusive, in units of stride.

    Position minus rank among the active frames is constant within a run.
    """
    on = frames.where(F.col(active) == 1).select(*keys, F.col(pos).cast("long").alias("_p"))
    rank = keyed_index(on, keys, [F.col("_p")], "_i")
    return rank.groupBy(*keys, (F.col("_p") - F.col("_i")).alias("_run")).agg(
        (F.min("_p") * stride).alias("start"), ((F.max("_p") + 1) * stride).alias("end")
    ).drop("_run")


def avg_segment_duration(frames: DataFrame, keys: list[str], pos: str = "t", label: str = "label") -> DataFrame:
    """Frames divided by the number of runs of equal label, over all sequences."""
    prev = ordered_scan(frames.select(*keys, pos, label), keys, [F.col(pos)], {"_prev": ("last", F.col(label), False)})
    starts = F.sum(F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col(label)), 1).otherwise(0))
    return prev.agg((F.count("*") / starts).alias("avg_duration"))


def sample_25(scores: DataFrame, video: str = "video_id", t: str = "t", n: int = 25) -> DataFrame:
    """Steps 1, 1 + s, ... with s = int(T / n), at most n, for videos longer than n steps; t counts from 0."""
    steps = scores.groupBy(video).agg(F.countDistinct(t).alias("_T")).where(F.col("_T") > n)
    s = F.floor(F.col("_T") / n)
    return (
        scores.join(steps, video)
        .where((F.col(t) >= 1) & ((F.col(t) - 1) % s == 0) & ((F.col(t) - 1) / s < n))
        .drop("_T")
    )


# ---- token sequences -----------------------------------------------------------------------


def token_blocks(docs: DataFrame, size: int, mode: str = "none", ident: str = "doc_id", tokens: str = "tokens", group: str | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(block, tokens) from sentences in id order.

    none: equal cuts over the concatenation. complete: whole sentences while they fit, a longer one
    alone. complete_doc: the same inside each group, blocks of one token dropped. eos: one sentence
    per block. block is the dense position of the block.
    """
    by = [group] if group else []
    # positions are found on the narrow (id, length) table; the tokens are joined once afterwards
    rows = docs.select(*by, ident, F.size(tokens).cast("long").alias("_n")).where("_n > 0")
    order = [F.col(c) for c in [*by, ident]]
    text = docs.select(ident, tokens)
    if mode == "none":
        pos = ordered_scan(rows, [], order, {"_s": ("sum", F.col("_n"), False)}).join(text, ident)
        first, last = F.floor(F.col("_s") / size), F.floor((F.col("_s") + F.col("_n") - 1) / size)
        piece = pos.withColumn("block", F.explode(F.sequence(first, last)))
        lo = F.greatest(F.col("block") * size - F.col("_s"), F.lit(0))
        hi = F.least((F.col("block") + 1) * size - F.col("_s"), F.col("_n"))
        piece = piece.select("block", "_s", F.slice(F.col(tokens), (lo + 1).cast("int"), (hi - lo).cast("int")).alias("_t"))
        return _join_pieces(piece, "block", "_s", tokens)
    idx = global_index(rows, order, "idx")
    if mode == "eos":
        return idx.join(text, ident).select(F.col("idx").alias("block"), tokens)
    if mode not in ("complete", "complete_doc"):
        raise ValueError(f"unknown mode {mode}")
    by_doc = mode == "complete_doc"
    if by_doc and not group:
        raise ValueError("complete_doc needs the document column")
    at = greedy_blocks(sum_pointers(idx, {"_n": size}, "idx", group if by_doc else None), "idx", chunk_rows)
    place = idx.select(ident, "idx", "_n").join(at, "idx")
    if by_doc:
        # blocks of one token drop; the kept starts are numbered on the narrow table
        big = place.groupBy("block_start").agg(F.sum("_n").alias("_w")).where("_w > 1")
    else:
        big = place.select("block_start").distinct()
    number = global_index(big.select("block_start"), [F.col("block_start")], "block")
    pieces = place.join(number, "block_start").join(text, ident).select("block", "idx", F.col(tokens).alias("_t"))
    return _join_pieces(pieces, "block", "idx", tokens)


def _join_pieces(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Concatenate the pieces of a block; a block holds at most its size in tokens or one sentence."""
    lists = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "_t"))).alias("_l"))
    return lists.select(key, F.flatten(F.transform("_l", lambda x: x["_t"])).alias(name))


def pack_pairs(df: DataFrame, max_tokens: int, ident: str = "id", src: str = "src", tgt: str = "tgt", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(block, src, tgt): consecutive pairs joined by spaces while both sides have at most max_tokens words."""

    def words(c: str) -> Column:
        return F.size(F.filter(F.split(F.col(c), r"\s+"), lambda x: x != "")).cast("long")

    idx = global_index(df.select(ident, words(src).alias("_a"), words(tgt).alias("_b")), [F.col(ident)], "idx")
    at = greedy_blocks(sum_pointers(idx, {"_a": max_tokens, "_b": max_tokens}), "idx", chunk_rows)
    place = idx.select(ident, "idx").join(at, "idx")
    rows = df.select(ident, src, tgt).join(place, ident).groupBy("block_start").agg(F.sort_array(F.collect_list(F.struct("idx", src, tgt))).alias("l"))
    return rows.select(
        F.col("block_start").alias("block"),
        F.array_join(F.transform("l", lambda x: x[src]), " ").alias(src),
        F.array_join(F.transform("l", lambda x: x[tgt]), " ").alias(tgt),
    )


def batch_by_size(df: DataFrame, max_tokens: int = 0, max_sentences: int = 0, multiple: int = 1, ident: str = "id", size: str = "n", order: list[Column] | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(id, n, batch): consecutive rows with longest * count <= max_tokens and count <= max_sentences (0: no limit).

    batch is the position of its first row; counts above `multiple` are cut to a multiple of it.
    """
    idx = global_index(df.select(ident, size), order or [F.col(size), F.col(ident)], "idx")
    at = greedy_blocks(batch_pointers(idx, size, max_tokens, max_sentences, multiple, "idx", chunk_rows), "idx", chunk_rows)
    return idx.join(at, "idx").select(ident, size, F.col("block_start").alias("batch"))


def context_window(blocks: DataFrame, ctx: int, stream: str = "stream", pos: str = "pos", tokens: str = "tokens", max_len: int | None = None) -> DataFrame:
    """Blocks with the last ctx tokens before them in the stream as prefix; start counts the prefix tokens.

    max_len caps prefix + block by cutting the prefix from the left. Only token tails are exchanged,
    keyed by (stream, position // ctx), so a long stream is spread.
    """
    if max_len is not None and max_len < 2 * ctx:
        raise ValueError("max_len must be at least twice ctx")
    place = ordered_scan(
        blocks.select(stream, pos, F.size(tokens).cast("long").alias("_n")), [stream], [F.col(pos)], {"_s": ("sum", F.col("_n"), False)}
    )
    run = place.join(blocks.select(stream, pos, tokens), [stream, pos])
    if ctx <= 0:
        return run.select(stream, pos, tokens, F.lit(0).alias("start"))
    end = F.col("_s") + F.col("_n")
    tail_from = F.greatest(F.col("_s"), end - ctx)
    tails = run.where("_n > 0").select(
        stream, tail_from.alias("_ts"), end.alias("_te"),
        F.slice(F.col(tokens), (tail_from - F.col("_s") + 1).cast("int"), ctx).alias("_t"),
    ).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_ts") / ctx), F.floor((F.col("_te") - 1) / ctx))))
    room = F.least(F.lit(ctx).cast("long"), F.col("_s"))
    if max_len is not None:
        room = F.least(room, F.greatest(F.lit(0), F.lit(max_len) - F.col("_n")))
    want = place.select(stream, pos, (F.col("_s") - room).alias("_ws"), F.col("_s").alias("_we")).where("_we > _ws").withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col("_ws") / ctx), F.floor((F.col("_we") - 1) / ctx)))
    )
    lo = F.greatest("_ts", "_ws", F.col("_bin") * ctx)
    hi = F.least("_te", "_we", (F.col("_bin") + 1) * ctx)
    piece = want.join(tails, [stream, "_bin"]).where(hi > lo).select(
        stream, pos, lo.alias("_at"), F.slice("_t", (lo - F.col("_ts") + 1).cast("int"), (hi - lo).cast("int")).alias("_t")
    )
    pre = piece.groupBy(stream, pos).agg(F.sort_array(F.collect_list(F.struct("_at", "_t"))).alias("_l")).select(
        stream, pos, F.flatten(F.transform("_l", lambda x: x["_t"])).alias("_pre")
    )
    out = run.join(pre, [stream, pos], "left")
    return out.select(
        stream, pos, F.when(F.col("_pre").isNull(), F.col(tokens)).otherwise(F.concat("_pre", tokens)).alias(tokens),
        F.coalesce(F.size("_pre"), F.lit(0)).alias("start"),
    ).withColumn("start", F.greatest("start", F.lit(0)))


def truncate_tokens(tokens: Column, n: int) -> Column:
    return F.slice(tokens, 1, n)


def random_crop_tokens(tokens: Column, n: int, seed: int, ident: Column) -> Column:
    """Seeded contiguous crop of n tokens; shorter rows stay whole."""
    start = F.floor(draw_unit(seed, ident) * (F.size(tokens) - n + 1)).cast("int")
    return F.when(F.size(tokens) <= n, tokens).otherwise(F.slice(tokens, F.greatest(start, F.lit(0)) + 1, n))


def words_of(tokens: Column, begins: Column) -> Column:
    """String tokens as an array of words; begins marks with 1 the tokens that open a word.

    Tokens are joined and split again at two control characters, which is linear in the text.
    """
    marked = F.zip_with(tokens, begins, lambda t, b: F.when(b == 1, F.concat(F.lit("\x01"), t)).otherwise(t))
    pieces = F.split(F.array_join(marked, "\x02"), "\x01")
    return F.transform(F.slice(pieces, 2, F.size(pieces)), lambda w: F.split(F.rtrim(w, F.lit("\x02")), "\x02"))


def mask_tokens(
    df: DataFrame, mask, prob: float = 0.15, multi_len: int = 1, leave: float = 0.1, random: float = 0.1,
    seed: int = 0, epoch: int = 0, vocab: list | None = None, ident: str = "id", tokens: str = "tokens",
    whole_words: bool = False,
) -> DataFrame:
    """Add masked: int(prob * n / multi_len + u) seeded spans of multi_len positions become mask.

    Of the chosen positions a share `leave` keeps its token and a share `random` gets a vocab entry.
    A position opens a span if its draw is among the smallest, which needs one sort per row and
    no search per token. With whole_words the tokens column holds arrays of words.
    """
    if random > 0 and not vocab:
        raise ValueError("random replacement needs a vocabulary")
    n = F.size(tokens)
    spots = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    key = F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(ident).cast("string"))
    d = spread(df).withColumn("_key", key).withColumn("_h", F.transform(spots, lambda i: F.md5(F.concat_ws(":", "_key", i.cast("string")))))
    unit = draw_unit(seed, F.lit(str(epoch)), F.col(ident), F.lit("n"))
    count = F.least(n, F.floor(F.lit(float(prob)) * n / float(multi_len) + unit).cast("int"))
    last = F.when(count > 0, F.try_element_at(F.array_sort("_h"), count))

    def draw(i: Column, what: str) -> Column:
        h = F.md5(F.concat_ws(":", F.col("_key"), i.cast("string"), F.lit(what)))
        return F.conv(F.substring(h, 1, 12), 16, 10).cast("long") / F.lit(float(16**12))

    def one(x: Column, i: Column, last: Column) -> Column:
        opened = F.lit(False)
        for back in range(multi_len):
            opened = opened | ((i >= back) & (F.get("_h", i - back) <= last))
        chosen = F.coalesce(opened, F.lit(False))

        def fill(value: Column) -> Column:
            return F.transform(x, lambda _: value) if whole_words else value

        u = draw(i, "u")
        new = fill(F.lit(mask))
        if random > 0:
            at = F.floor(draw(i, "v") * len(vocab)).cast("int")
            new = F.when(u < leave + random, fill(F.element_at(F.array(*[F.lit(v) for v in vocab]), at + 1))).otherwise(new)
        if leave > 0:
            new = F.when(u < leave, x).otherwise(new)
        return F.when(chosen, new).otherwise(x)

    out = bound(last, lambda c: F.transform(F.col(tokens), lambda x, i: one(x, i, c)))
    if whole_words:
        out = F.flatten(out)
    return d.withColumn("masked", out).drop("_key", "_h")


def length_buckets(df: DataFrame, n: int, size: str = "n") -> DataFrame:
    """Add pad_to: the smallest of n percentile bounds (rounded up) that holds the row."""
    ps = F.array(*[F.lit((i + 1) / n) for i in range(n)])
    bounds = df.agg(F.array_sort(F.array_distinct(F.transform(F.percentile(size, ps), lambda x: F.ceil(x)))).alias("_b"))
    return df.join(F.broadcast(bounds)).withColumn(  # bounds is one row
        "pad_to", F.element_at(F.filter("_b", lambda b: b >= F.col(size)), 1)
    ).drop("_b")


def max_lengths(df: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    return df.withColumn("max_len", F.greatest(F.size(F.split(src, " ")), F.size(F.split(tgt, " "))))


def pack_repeats(df: DataFrame, max_reps: int, tokens: str = "tokens") -> DataFrame:
    """Runs of a token as the token and a repeat symbol "1".."max_reps" (extra copies); longer runs start over.

    tokens are strings that are not numerals themselves.
    """

    @F.pandas_udf("array<string>")
    def run(col: pd.Series) -> pd.Series:
        def one(a):
            a = np.asarray(a, dtype=object)
            if len(a) == 0 or max_reps <= 0:
                return list(a)
            heads = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            lens = np.diff(np.append(heads, len(a)))
            out = []
            for tok, k in zip(a[heads], lens):
                full, rest = divmod(int(k), max_reps + 1)
                out += [tok, str(max_reps)] * full
                if rest:
                    out += [tok] if rest == 1 else [tok, str(rest - 1)]
            return out

        return col.map(one)

    return spread(df).withColumn(tokens, run(F.col(tokens)))


def unpack_repeats(df: DataFrame, max_reps: int, tokens: str = "tokens") -> DataFrame:
    """Inverse of pack_repeats: a repeat symbol copies the token before it."""
    marks = [str(i) for i in range(1, max_reps + 1)]
    t = F.col(tokens)

    def one(x: Column, i: Column) -> Column:
        is_mark = x.isin(marks) & (i > 0)
        return F.when(is_mark, F.array_repeat(F.get(t, i - 1), x.try_cast("int"))).otherwise(F.array(x))

    return df.withColumn(tokens, F.flatten(F.transform(t, one)))


def shift_targets(df: DataFrame, pad, eos, tokens: str = "tokens", before: str | None = None) -> DataFrame:
    """Add source (previous token), target (same token) and past (token before the previous one) per block.

    before names an array with the up to two tokens that precede the block in its sentence; a block
    that opens a sentence is led by eos, and past by pad and eos.
    """
    t = F.col(tokens)
    n = F.size(t)
    lead = F.array(F.lit(pad), F.lit(eos))
    if before is not None:
        lead = F.concat(lead, F.col(before))
    full = F.concat(F.slice(lead, -2, 2), t)
    return df.withColumn("source", F.slice(full, 2, n)).withColumn("target", t).withColumn("past", F.slice(full, 1, n))
