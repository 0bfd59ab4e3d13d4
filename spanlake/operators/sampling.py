"""Splits, shards, weighted and balanced samples, mixtures. Every draw is a seeded hash of the row id."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.text import clean_label
from spanlake.operators.sequence import build_prompt, split_common_rare
from spanlake.plans.scan import draw_key, draw_unit, global_index, keyed_index, ordered_scan
from spanlake.session import spread

TOP_ROWS = 10_000


def _hash_order(seed, *ids: str) -> list[Column]:
    return [draw_key(seed, *[F.col(i) for i in ids]), *[F.col(i) for i in ids]]


def first_by_hash(df: DataFrame, k: int, ident: str, seed) -> DataFrame:
    """The ids of the k rows with the smallest draws; small k is a top-k, large k an index filter."""
    ids = df.select(ident)
    if k <= TOP_ROWS:
        return ids.orderBy(*_hash_order(seed, ident)).limit(k)
    return global_index(ids, _hash_order(seed, ident), "_i").where(F.col("_i") < k).select(ident)


# ---- splits and shards -----------------------------------------------------------------------


def quota_split(videos: DataFrame, fraction: float, seed, names=("first", "second"), key: str = "video_uid", n: str = "n_actions", goal: float | None = None) -> DataFrame:
    """Add split: in seeded order a video joins the first split while the running count before it is below the goal.

    The goal is fraction of the total count unless given.
    """
    run = ordered_scan(videos, [], _hash_order(seed, key), {"_before": ("sum", F.col(n), False)})
    if goal is None:
        total = videos.agg(F.floor(F.sum(n) * fraction).alias("_goal"))
        run = run.join(F.broadcast(total))  # one row
    else:
        run = run.withColumn("_goal", F.lit(goal))
    return run.withColumn("split", F.when(F.col("_before") < F.col("_goal"), names[0]).otherwise(names[1])).drop("_before", "_goal")


def three_way_split(videos: DataFrame, train: float, val: float, seed, key: str = "video_uid", n: str = "n_actions") -> DataFrame:
    """train, val and test by two quota splits: first train + val against test, then train against val."""
    total = videos.agg(F.sum(n)).first()[0] or 0
    outer = quota_split(videos, 0, f"{seed}a", ("train_val", "test"), key, n, math.floor(total * (train + val)))
    inner = quota_split(
        outer.where("split = 'train_val'").drop("split"), 0, f"{seed}b", ("train", "val"), key, n, math.floor(total * train)
    )
    return inner.unionByName(outer.where("split = 'test'"))


def held_out_split(actions: DataFrame, fraction: float, seed, ident: str = "id", keys=("verb", "noun")) -> DataFrame:
    """Add split: common pairs are shuffled into train and val, rare pairs are test, rows without a pair unused."""
    keys = list(keys)
    filled = F.lit(True)
    for k in keys:
        filled = filled & (F.coalesce(F.col(k).cast("string"), F.lit("")) != "")
    counts = actions.where(filled).groupBy(*keys).agg(F.count("*").alias("n"))
    parts = split_common_rare(counts, fraction, keys).select(*keys, "part")
    tagged = actions.join(parts, keys, "left")
    common = tagged.where("part = 'common'")
    order = global_index(common.select(ident), _hash_order(seed, ident), "_i")
    cutoff = common.agg(F.bround(F.count("*") * F.lit(fraction)).alias("_cut"))
    side = order.join(F.broadcast(cutoff)).select(ident, F.when(F.col("_i") < F.col("_cut"), "train").otherwise("val").alias("_s"))  # one row
    rare = F.when(F.col("part") == "rare", "test").otherwise("unused")
    return tagged.join(side, ident, "left").withColumn("split", F.coalesce("_s", rare)).drop("_s", "part")


def reservoir_split(docs: DataFrame, k: int, seed, ident: str = "doc_id") -> DataFrame:
    """Add part: sample for exactly k rows (all if fewer), remainder for the rest."""
    chosen = first_by_hash(docs, k, ident, seed).withColumn("_s", F.lit("sample"))
    return docs.join(chosen, ident, "left").withColumn("part", F.coalesce("_s", F.lit("remainder"))).drop("_s")


def shard_docs(docs: DataFrame, n: int, ident: str = "doc_id") -> DataFrame:
    return global_index(docs, [F.col(ident)], "_i").withColumn("shard", (F.col("_i") % n).cast("int")).drop("_i")


def contiguous_shard(df: DataFrame, q: int, n: int, ident: str) -> DataFrame:
    """Rows [int(q N / n), int((q + 1) N / n)) of the id order."""
    total = df.count()
    lo, hi = q * total // n, (q + 1) * total // n
    return global_index(df, [F.col(ident)], "_i").where((F.col("_i") >= lo) & (F.col("_i") < hi)).drop("_i")


def padded_shard(df: DataFrame, rank: int, n: int, seed, ident: str) -> DataFrame:
    """Slice `rank` of a seeded permutation that wraps around until n equal slices are full; pos is its position."""
    total = df.count()
    size = math.ceil(total / n)
    idx = global_index(df, _hash_order(seed, ident), "_i")
    both = F.array_compact(F.array(F.col("_i"), F.when(F.col("_i") < size * n - total, F.col("_i") + total)))
    return idx.withColumn("pos", F.explode(both)).where((F.col("pos") >= rank * size) & (F.col("pos") < (rank + 1) * size)).drop("_i")


def subsample(df: DataFrame, ratio: float, seed, ident: str) -> DataFrame:
    """ceil(n * ratio) rows without replacement."""
    k = math.ceil(df.count() * ratio)
    return df.join(first_by_hash(df, k, ident, seed), ident, "left_semi")


# ---- weighted samples --------------------------------------------------------------------------


def resample(df: DataFrame, ident: str, weight: str | None = None, size_ratio: float = 1.0, replace: bool = True, seed: int = 0, epoch: int = 0) -> DataFrame:
    """(id, draw): ceil(n * size_ratio) weighted draws; another epoch gives other draws.

    With replacement a draw falls into the running weight interval of a row; rows and draws meet in
    one ordered scan, so neither a range join nor a driver-side table is needed. Without replacement
    the rows with the smallest exponential keys -ln(u) / w are taken.
    """
    rows = df.select(ident, (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    n = rows.count()
    size = math.ceil(n * size_ratio)
    if not replace:
        u = draw_unit(f"{seed}:{epoch}", F.col(ident))
        key = -F.log(F.greatest(u, F.lit(1e-300))) / F.col("_w")
        live = rows.where("_w > 0").select(ident, key.alias("_k"))
        if size <= TOP_ROWS:
            kept = live.orderBy("_k", ident).limit(size)
        else:
            kept = global_index(live, [F.col("_k"), F.col(ident)], "_i").where(F.col("_i") < size)
        return kept.select(ident, F.lit(0).cast("long").alias("draw"))
    cum = ordered_scan(rows.where("_w > 0"), [], [F.col(ident)], {"_pos": ("sum", F.col("_w"), False)})
    total = rows.agg(F.sum("_w")).first()[0] or 0.0
    draws = df.sparkSession.range(size).select(
        (draw_unit(f"{seed}:{epoch}", F.col("id")) * total).alias("_pos"), F.col("id").alias("draw"), F.lit(1).alias("_q")
    )
    marks = cum.select(F.col("_pos").cast("double").alias("_pos"), F.col(ident).alias("_id"), F.lit(0).alias("_q"))
    mixed = marks.unionByName(draws, allowMissingColumns=True)
    hit = ordered_scan(mixed, [], [F.col("_pos"), F.col("_q"), F.col("_id"), F.col("draw")], {ident: ("last", F.col("_id"), True)})
    return hit.where("_q = 1").select(ident, "draw")


def temperature_weights(sizes: DataFrame, temp: float = 1.0, method: str = "temperature", n: str = "n", ratio: str | None = None) -> DataFrame:
    """Add weight per data set: (n / total) ** (1 / temp), 1 for uniform, or the given ratio column."""
    if method == "uniform":
        return sizes.withColumn("weight", F.lit(1.0))
    if method == "ratio":
        return sizes.withColumn("weight", F.col(ratio).cast("double"))
    total = sizes.agg(F.sum(n).alias("_t"))
    return sizes.join(F.broadcast(total)).withColumn("weight", F.pow(F.col(n) / F.col("_t"), F.lit(1.0 / temp))).drop("_t")  # one row


def class_balanced_weights(ann: DataFrame, lam: float = 1.0, ratios: dict | None = None, image: str = "image_id", category: str = "category_id", source: str = "source", balance: set | None = None) -> DataFrame:
    """(source, image, weight): sum of 1 / freq^lam over the image's classes, scaled to mean 1 per source, times the source weight.

    freq counts the images of a source with the class. The source weight is max(n) / n * ratio / sum of
    ratios. balance names the sources that use class balancing; the others use 1.
    """
    pairs = ann.select(source, image, category).distinct()
    freq = pairs.groupBy(source, category).agg(F.count("*").alias("_f"))
    raw = pairs.join(freq, [source, category]).groupBy(source, image).agg(F.sum(F.pow(F.col("_f"), F.lit(-float(lam)))).alias("_w"))
    size = raw.groupBy(source).agg(F.count("*").alias("_n"), F.sum("_w").alias("_s"))
    top = size.agg(F.max("_n").alias("_m"), F.count("*").alias("_k"))
    r, total = F.lit(1.0), F.col("_k").cast("double")
    if ratios:
        r = F.coalesce(*[F.when(F.col(source) == F.lit(k), F.lit(float(v))) for k, v in ratios.items()], F.lit(0.0))
        total = F.lit(float(sum(ratios.values())))
    scale = size.join(F.broadcast(top)).select(source, "_n", "_s", (F.col("_m") / F.col("_n") * r / total).alias("_d"))  # one row
    cas = F.col("_w") * F.col("_n") / F.col("_s")
    if balance is not None:
        cas = F.when(F.col(source).isin(list(balance)), cas).otherwise(1.0)
    return raw.join(scale, source).select(source, image, (cas * F.col("_d")).alias("weight"))


def aspect_buckets(images: DataFrame, batch: int, ident: str = "image_id", source: str = "source", width: str = "width", height: str = "height") -> DataFrame:
    """(id, bucket, batch): full batches of one source and orientation in id order; incomplete batches drop."""
    b = images.select(ident, (F.col(source) * 2 + (F.col(width) <= F.col(height)).cast("int")).alias("bucket"))
    full = b.groupBy("bucket").agg((F.floor(F.count("*") / batch) * batch).alias("_full"))
    idx = keyed_index(b, ["bucket"], [F.col(ident)], "_i")
    return idx.join(full, "bucket").where(F.col("_i") < F.col("_full")).select(ident, "bucket", F.floor(F.col("_i") / batch).alias("batch"))


# ---- mixtures ----------------------------------------------------------------------------------


def corpus_mixture(dfs: dict[str, DataFrame], distribution: list[float], seed, ident: str = "id") -> DataFrame:
    """int(p_i * N) rows of each corpus: whole copies plus a random rest; the last corpus fills up to N."""
    sizes = {k: d.count() for k, d in dfs.items()}
    total = sum(sizes.values())
    out, taken = [], 0
    for i, (name, df) in enumerate(dfs.items()):
        want = int(distribution[i] * total) if i < len(dfs) - 1 else total - taken
        taken += want
        if not sizes[name]:
            continue
        copies, rest = divmod(want, sizes[name])
        part = global_index(df, _hash_order(f"{seed}:{name}", ident), "_i")
        n_copies = F.lit(copies) + (F.col("_i") < rest).cast("int")
        part = part.withColumn("copy", F.explode(F.when(n_copies > 0, F.sequence(F.lit(0), n_copies - 1)))).drop("_i")
        out.append(part.withColumn("corpus", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


def interleave_corpora(dfs: dict[str, DataFrame], weights: list[float], n: int, seed, ident: str = "id") -> DataFrame:
    """(pos, corpus, id): each of n positions draws a corpus by weight and takes row pos modulo its size.

    A small corpus serves many positions with few rows; its rows are copied over salts so that no
    row is a hot join key.
    """
    names = list(dfs)
    sizes = {k: d.count() for k, d in dfs.items()}
    total = float(sum(weights))
    u = draw_unit(seed, F.col("id"))
    pick, acc = None, 0.0
    for name, w in zip(names, weights):
        acc += w / total
        pick = F.when(u < acc, name) if pick is None else pick.when(u < acc, name)
    at = dfs[names[0]].sparkSession.range(n).select(F.col("id").alias("pos"), pick.otherwise(names[-1]).alias("corpus"))
    out = []
    for name in names:
        salts = max(1, min(1024, math.ceil(n / (sizes[name] * 1000)))) if sizes[name] else 1
        rows = global_index(dfs[name].select(ident), [F.col(ident)], "_i").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        p = at.where(F.col("corpus") == name).withColumn("_i", F.col("pos") % max(sizes[name], 1)).withColumn("_salt", F.pmod(F.xxhash64("pos"), F.lit(salts)).cast("int"))
        out.append(p.join(rows, ["_i", "_salt"]).select("pos", "corpus", ident))
    return reduce(DataFrame.unionByName, out)


# ---- examples and prompts ----------------------------------------------------------------------


def in_context_samples(query: DataFrame, pool: DataFrame, shots: int, match_ratio: float, seed, ident: str = "id", keys=("verb", "noun")) -> DataFrame:
    """(query id, slot, example id, matched): `shots` examples per query, round(shots * match_ratio) of the same verb and noun.

    Pool rows are numbered in seeded order, within their pair and over all; a query starts at a drawn
    position and takes the rows that follow, so the joins are on exact positions and no group is
    multiplied out. Missing matches are filled from the whole pool; a row is used once per query and
    never for itself.
    """
    keys = list(keys)
    want = round(shots * match_ratio)
    q = query.select(F.col(ident).alias("q"), *keys)
    by_pair = keyed_index(pool.select(ident, *keys), keys, _hash_order(seed, ident), "_pos")
    m = pool.groupBy(*keys).agg(F.count("*").alias("_m"))
    u = draw_unit(seed, F.lit("start"), F.col("q"))

    def ask(df: DataFrame, size: Column, n: int) -> DataFrame:
        steps = F.sequence(F.lit(0), F.least(F.lit(n), size.cast("int")) - 1)
        return df.withColumn("_j", F.explode(steps)).withColumn("_pos", (F.floor(u * size) + F.col("_j")) % size)

    chosen = None
    if want > 0:
        asked = ask(q.join(m, keys), F.col("_m"), want + 1)
        w = Window.partitionBy("q").orderBy("_j")
        hit = asked.join(by_pair, [*keys, "_pos"]).where(F.col("q") != F.col(ident))
        chosen = hit.withColumn("slot", F.row_number().over(w) - 1).where(F.col("slot") < want).select("q", "slot", ident, F.lit(True).alias("matched"))
    everywhere = global_index(pool.select(ident), _hash_order(f"{seed}:all", ident), "_pos")
    n_pool = pool.agg(F.count("*").alias("_m"))
    asked = ask(q.select("q").join(F.broadcast(n_pool)), F.col("_m"), shots + want + 1)  # one row
    fill = asked.join(everywhere, "_pos").where(F.col("q") != F.col(ident)).select("q", "_j", ident)
    w = Window.partitionBy("q").orderBy("_j")
    if chosen is None:
        return fill.withColumn("slot", F.row_number().over(w) - 1).where(F.col("slot") < shots).select("q", "slot", ident, F.lit(False).alias("matched"))
    have = chosen.groupBy("q").agg(F.count("*").alias("_h"))
    fresh = fill.join(chosen.select("q", ident), ["q", ident], "left_anti").join(have, "q", "left")
    slot = F.row_number().over(w) - 1 + F.coalesce("_h", F.lit(0))
    rest = fresh.withColumn("slot", slot).where(F.col("slot") < shots).select("q", F.col("slot").cast("int").alias("slot"), ident, F.lit(False).alias("matched"))
    return chosen.unionByName(rest)


def negative_prompts(segments: DataFrame, classes: list[str], n_replace: int = 27, n_add: int = 4, seed: int = 0) -> DataFrame:
    """(clip_id, kind, i, prompt): prompts with classes that the clip does not show.

    replace: the first action always and each other with probability one half becomes an absent
    class. add: an absent class is put in front. A clip that shows every class gives no rows.
    """
    first = (
        segments.withColumn("label", clean_label(F.col("label")))
        .groupBy("clip_id", "label").agg(F.min(F.struct("t_start", "seg_id")).alias("s"))
        .groupBy("clip_id")  # one entry per label class
        .agg(F.sort_array(F.collect_list(F.struct("s", "label"))).alias("a"))
        .select("clip_id", F.transform("a", lambda x: x["label"]).alias("acts"))
    )
    names = F.array(*[clean_label(F.lit(c)) for c in sorted(classes)])
    base = build_prompt(segments, seed).join(first, "clip_id").withColumn("absent", F.array_except(names, F.col("acts"))).where(F.size("absent") > 0)

    def choice(*what: Column) -> Column:
        return F.get("absent", F.floor(draw_unit(seed, F.col("clip_id"), *what) * F.size("absent")).cast("int"))

    rep = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_replace - 1))))
    numbered = F.transform("acts", lambda x, j: F.struct(x.alias("x"), j.alias("j")))

    def swap(text: Column, e: Column) -> Column:
        turn = (e["j"] == 0) | (draw_unit(seed, F.lit("p"), F.col("clip_id"), F.col("i"), e["j"]) > 0.5)
        return F.when(turn, F.replace(text, e["x"], choice(F.lit("r"), F.col("i"), e["j"]))).otherwise(text)

    replaced = rep.select("clip_id", F.lit("replace").alias("kind"), "i", F.aggregate(numbered, F.col("prompt"), swap).alias("prompt"))
    add = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_add - 1))))
    added = add.select("clip_id", F.lit("add").alias("kind"), "i", F.concat(F.lit("I "), choice(F.lit("a"), F.col("i")), F.lit(" . Then "), F.col("prompt")).alias("prompt"))
    return replaced.unionByName(added)


def sample_constraints(pairs: DataFrame, number: int, length: int, seed: int = 0, ident: str = "id", tgt: str = "tgt") -> DataFrame:
    """Add constraints: up to `number` non-overlapping phrases of `length` target words, in target order.

    Each draw picks a free stretch and a start in it; the phrase ends with the stretch. Targets
    shorter than `length` words have none. Rows are independent; the helper sees one row at a time.
    """

    @F.pandas_udf("array<string>")
    def draw(ids: pd.Series, texts: pd.Series) -> pd.Series:
        import random

        def one(i, text):
            words = text.split()
            if len(words) < length:
                return []
            rng = random.Random(f"{seed}:{i}")
            free, taken = [(0, len(words))], []
            for _ in range(number):
                if not free:
                    break
                lo, hi = free.pop(rng.randrange(len(free)))
                at = lo + rng.randrange(hi - lo)
                end = min(hi, at + length)
                taken.append((at, end))
                free += [s for s in ((lo, at), (end, hi)) if s[1] > s[0]]
            return [" ".join(words[a:b]) for a, b in sorted(taken)]

        return pd.Series([one(i, t) for i, t in zip(ids, texts)])

    return spread(pairs).withColumn("constraints", draw(F.col(ident), F.col(tgt)))
