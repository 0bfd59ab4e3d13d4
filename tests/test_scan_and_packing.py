"""Ordered scans and greedy packing against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from spanlake.operators import sequence as Q
from spanlake.plans.packing import greedy_blocks, sum_pointers
from spanlake.plans.scan import global_index, keyed_index, ordered_scan


def test_scan_with_hot_key(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.6 else rng.randrange(1, 9), i, rng.choice([None, rng.randrange(50)])) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, t int, v int").repartition(7)
    out = ordered_scan(
        df, ["k"], [F.col("t")],
        {"s": ("sum", F.col("v"), True), "m": ("max", F.col("v"), False), "l": ("last", F.col("v"), False)}, 5,
    ).collect()
    state, want = {}, {}
    for k, t, v in sorted(rows, key=lambda r: (r[0], r[1])):
        s, m, last = state.get(k, (0, None, None))
        want[k, t] = (s + (v or 0), m, last)
        state[k] = (s + (v or 0), v if m is None else m if v is None else max(m, v), last if v is None else v)
    assert {(r.k, r.t): (r.s, r.m, r.l) for r in out} == want


def test_indices_do_not_depend_on_partitioning(spark):
    df = spark.range(500).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7))
    a = {(r.id, r.idx) for r in global_index(df.repartition(3), [F.col("id").desc()]).collect()}
    b = {(r.id, r.idx) for r in global_index(df.repartition(11), [F.col("id").desc()], partitions=9).collect()}
    assert a == b == {(i, 499 - i) for i in range(500)}
    per = keyed_index(df, ["k"], [F.col("id")]).collect()
    seen = {}
    for r in sorted(per, key=lambda r: r.id):
        assert r.idx == seen.get(r.k, 0)
        seen[r.k] = r.idx + 1


def slow_starts(sizes, limits, groups=None):
    """sizes: one tuple per row, one number per limit."""
    want, start, cur = {}, 0, [0] * len(limits)
    for i, n in enumerate(sizes):
        over = any(c + x > limit for c, x, limit in zip(cur, n, limits))
        if i > start and (over or (groups and groups[i] != groups[i - 1])):
            start, cur = i, [0] * len(limits)
        cur = [c + x for c, x in zip(cur, n)]
        want[i] = start
    return want


@pytest.mark.parametrize("chunk", [7, 40, 1000])
@pytest.mark.parametrize("low", [0, 1])
def test_greedy_blocks_chunked(spark, chunk, low):
    rng = random.Random(chunk)
    sizes = [(rng.randrange(low, 9), rng.choice([0, 1, 50])) for _ in range(300)]
    groups = sorted(rng.randrange(5) for _ in range(300))
    df = spark.createDataFrame([(i, a, b, g) for i, ((a, b), g) in enumerate(zip(sizes, groups))], "idx long, n long, m long, g int")
    for limits, cols, group in ((([20]), ["n"], None), ([20, 60], ["n", "m"], None), ([20], ["n"], "g")):
        pointers = sum_pointers(df, dict(zip(cols, limits)), "idx", group)
        got = {r.idx: r.block_start for r in greedy_blocks(pointers, "idx", chunk).collect()}
        assert got == slow_starts([s[: len(cols)] for s in sizes], limits, groups if group else None)
    assert greedy_blocks(sum_pointers(df.limit(0), {"n": 3}), "idx", chunk).count() == 0


def test_a_block_longer_than_all_chunks(spark):
    df = spark.range(5000).select(F.col("id").alias("idx"), F.when(F.col("id") == 4000, 10).otherwise(0).alias("n"))
    got = greedy_blocks(sum_pointers(df, {"n": 9}), "idx", 16).groupBy("block_start").agg(F.min("idx").alias("a"), F.count("*").alias("n")).orderBy("a")
    assert [(r.block_start, r.a, r.n) for r in got.collect()] == [(0, 0, 4000), (4000, 4000, 1), (4001, 4001, 999)]


def blocks(spark, seqs, size, mode, **kw):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "doc_id long, tokens array<int>")
    return [r.tokens for r in Q.token_blocks(df, size, mode, **kw).orderBy("block").collect()]


def test_token_block_examples(spark):
    a = [[5, 4, 3, 2, 1], [8, 7, 6, 1], [9, 1]]
    assert blocks(spark, a, 3, "none") == [[5, 4, 3], [2, 1, 8], [7, 6, 1], [9, 1]]
    assert blocks(spark, a, 6, "complete") == [[5, 4, 3, 2, 1], [8, 7, 6, 1, 9, 1]]
    b = [[4, 3, 2, 1], [5, 1], [1], [6, 1]]
    assert blocks(spark, b, 3, "complete", chunk_rows=2) == [[4, 3, 2, 1], [5, 1, 1], [6, 1]]
    assert blocks(spark, b, 3, "eos") == b


def test_context_window_example(spark):
    df = spark.createDataFrame([(0, 0, [4, 5, 6, 7]), (0, 1, [8, 9, 10, 11]), (0, 2, [12, 13])], "stream int, pos int, tokens array<int>")
    out = Q.context_window(df, 2).orderBy("pos").collect()
    assert [r.tokens for r in out] == [[4, 5, 6, 7], [6, 7, 8, 9, 10, 11], [10, 11, 12, 13]]
    assert [r.start for r in out] == [0, 2, 2]


def slow_batches(lengths, max_tokens, max_rows, multiple):
    out, start = [], 0
    while start < len(lengths):
        end = start + 1
        while end < len(lengths):
            n = end - start + 1
            if (0 < max_tokens < max(lengths[start:end + 1]) * n) or (0 < max_rows < n):
                break
            end += 1
        n = end - start
        if n > multiple:
            n -= n % multiple
        out.append(list(range(start, start + n)))
        start += n
    return out


@pytest.mark.parametrize("args", [(60, 0, 1, 9), (0, 5, 1, 1000), (80, 6, 4, 25), (100, 8, 3, 1000), (0, 0, 1, 9), (0, 0, 7, 50), (5000, 0, 1, 16)])
def test_batches_match_slow_baseline(spark, args):
    max_tokens, max_rows, multiple, chunk = args
    rng = random.Random(3)
    lengths = [rng.randrange(1, 20) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(lengths)), "id long, n int")
    got = {}
    for r in Q.batch_by_size(df, max_tokens, max_rows, multiple, order=[F.col("id")], chunk_rows=chunk).collect():
        got.setdefault(r.batch, []).append(r.id)
    assert [sorted(got[b]) for b in sorted(got)] == slow_batches(lengths, max_tokens, max_rows, multiple)


def test_repeats_round_trip(spark):
    seqs = [list("aaab"), list("a"), [], list("aabbbbbc")]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id int, tokens array<string>")
    packed = Q.pack_repeats(df, 2)
    assert [r.tokens for r in packed.orderBy("id").collect()] == [["a", "2", "b"], ["a"], [], ["a", "1", "b", "2", "b", "1", "c"]]
    assert [r.tokens for r in Q.unpack_repeats(packed, 2).orderBy("id").collect()] == seqs


def test_whole_word_masking(spark):
    df = spark.createDataFrame([(1, ["a", "##b", "c", "d", "##e"], [1, 0, 1, 1, 0])], "id int, tokens array<string>, b array<int>")
    words = df.withColumn("w", Q.words_of(F.col("tokens"), F.col("b")))
    assert words.first().w == [["a", "##b"], ["c"], ["d", "##e"]]
    out = Q.mask_tokens(words, "M", 1.0, leave=0.0, random=0.0, tokens="w", whole_words=True).first()
    assert out.masked == ["M"] * 5


def test_shift_targets(spark):
    df = spark.createDataFrame([(1, ["x", "y", "z"], ["p", "q"])], "id int, tokens array<string>, before array<string>")
    r = Q.shift_targets(df, "<pad>", "</s>").first()
    assert (r.source, r.target, r.past) == (["</s>", "x", "y"], ["x", "y", "z"], ["<pad>", "</s>", "x"])
    r = Q.shift_targets(df, "<pad>", "</s>", before="before").first()
    assert (r.source, r.past) == (["q", "x", "y"], ["p", "q", "x"])


def test_narration_window_examples(spark):
    for duration, ts, want in ((12.0, (2, 6, 10), [(0, 8), (2, 10), (4, 12)]), (14.0, (3, 7, 10), [(0, 8), (3, 11), (6, 14)])):
        df = spark.createDataFrame([(float(t), duration) for t in ts], "t double, duration double")
        got = [(r.w_start, r.w_end) for r in Q.narration_windows(df).orderBy("t").collect()]
        assert got == want


def test_clip_of_a_video_without_features_gives_an_error_row(spark):
    from spanlake.operators import sequence as Q

    windows = spark.createDataFrame([("c", "v", 0, 2), ("d", "w", 0, 1)], "clip_uid string, video_uid string, si long, ei long")
    feats = spark.createDataFrame([("v", 0), ("v", 1)], "video_uid string, t long")
    got = sorted((r.clip_uid, r.t, r.error) for r in Q.slice_clip_features(windows, feats).collect())
    assert got == [("c", 0, None), ("c", 1, None), ("d", None, "no features")]
