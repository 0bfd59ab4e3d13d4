"""Findings of round 3: steps whose memory, moves or calls grew faster than their input."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spanlake.functions import text as T
from spanlake.operators import annotations as A
from spanlake.operators import corpus as C
from spanlake.operators import joins as J
from spanlake.operators import retrieval as R
from spanlake.operators import sets as S
from spanlake.operators import suppress as N
from spanlake.operators import text_metrics as M
from spanlake.operators.embeddings import largest_products
from spanlake.plans.folds import whole_groups


def test_gram_counts_leave_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(M, "GRAM_ROWS", 3)
    df = spark.createDataFrame([(1, "a", "x y x y"), (2, None, ""), (3, "b", None), (4, "c", "x y")], "id long, k string, t string").coalesce(1)
    rows = M.gram_counts(df, ["id", "k"], F.split("t", " "), 2).withColumn("part", F.spark_partition_id()).collect()
    got = sorted((r.id, r.k, r.order, r.tf) for r in rows if r.id != 2)
    assert got == [(1, "a", 1, 2), (1, "a", 1, 2), (1, "a", 2, 1), (1, "a", 2, 2), (4, "c", 1, 1), (4, "c", 1, 1), (4, "c", 2, 1)]
    shared = {r.gram for r in rows if r.id == 1} & {r.gram for r in rows if r.id == 4}
    assert len(shared) == 3
    # counts reach the JVM as flat rows: no list of one Python object per n-gram
    plan = M.gram_counts(df, ["id"], F.split("t", " "), 2)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_mask_runs_shrink_to_corners(spark):
    # two towers of 100 equal lines, one of them drawn twice, and a gap: runs of a batch leave as corners
    runs = [(1, "a", y, 10, 20) for y in range(100)] + [(1, "a", y, 15, 40) for y in range(100)] * 2 + [(1, "b", y, 0, 5) for y in (3, 4, 9)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("frame_id", "object_label", "y", "x_start", "x_end"), r)) for r in runs])
    (out,) = J._corners(iter([batch]))
    assert out.num_rows == 8 + 8
    boxes = spark.createDataFrame([(1, 1, 12.0, 5.0, 30.0, 8.0), (1, 2, 0.0, 0.0, 5.0, 4.0)], "frame_id long, det_id long, x0 double, y0 double, x1 double, y1 double")
    df = spark.createDataFrame(runs, "frame_id long, object_label string, y int, x_start int, x_end int")
    got = {(r.det_id, r.object_label): (r.inside, r.outside) for r in J.box_mask_join(boxes, df, 1.0, 0.0).collect()}
    whole = 100 * 10 + 2 * 100 * 25
    assert got == {(1, "a"): (3 * (8 + 2 * 15), whole - 3 * (8 + 2 * 15)), (2, "b"): (5, 10)}


def test_groups_meet_in_batches():
    rows = pa.RecordBatch.from_pydict({"a": [1, 1, 1, 2, None, None, 3], "v": list(range(7))})
    batches = [rows.slice(0, 2), rows.slice(2, 3), rows.slice(5, 0), rows.slice(5, 2)]
    got = [held["v"].to_pylist()[lo:hi] for held, bounds in whole_groups(iter(batches), ["a"]) for lo, hi in zip(bounds[:-1], bounds[1:])]
    assert got == [[0, 1, 2], [3], [4, 5], [6]]


def test_small_groups_cost_no_call_each(spark):
    pred = spark.createDataFrame([(c, c, "x", 0.0, 1.0, 0.5) for c in range(50)], "clip_id long, pred_id long, label string, t_start double, t_end double, score double")
    gt = pred.select("clip_id", F.col("pred_id").alias("seg_id"), "label", "t_start", "t_end")
    for out in (N.nms(pred), N.soft_nms(pred), R.assign_detections(R.match_segments(pred, gt))):
        plan = out._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    assert N.soft_nms(pred).count() == 50


def test_largest_products_equal_brute_force():
    draw = np.random.default_rng(3)
    a, b = draw.normal(size=(700, 5)).round(1), draw.normal(size=(9000, 5)).round(1)  # many ties, several slices
    row, col, sim = largest_products(a, b, 4, np.full(len(a), -np.inf), False)
    whole = np.round(a @ b.T, 9)
    want = [np.lexsort((np.arange(len(b)), -w))[:4] for w in whole[:50]]
    for i, w in enumerate(want):
        got = whole[i, col[row == i]]
        assert (got == whole[i, w]).all()
    assert (np.bincount(row) == 4).all()
    low = np.full(len(a), np.inf)
    assert len(largest_products(a, b, 4, low, False)[0]) == 0


def test_cooccurrence_of_sparse_and_dense_chunks(spark, monkeypatch):
    draw = np.random.default_rng(5)
    rows = [(int(c), i, "abcd"[draw.integers(4)], float(s := draw.integers(0, 9000)), float(s + draw.integers(0, 400))) for i, c in enumerate(draw.integers(0, 6, 120))]
    seg = spark.createDataFrame(rows, "clip_id long, seg_id long, label string, t_start double, t_end double")
    clips = seg.groupBy("clip_id").agg(F.max("t_end").alias("duration"))
    got = []
    for islands in (0, 3, 64):
        monkeypatch.setattr(A, "CHUNK_ISLANDS", islands)
        got.append(sorted((r.label_a, r.label_b, r.n_clips) for r in A.label_cooccurrence(seg, clips).collect()))
    assert got[0] == got[1] == got[2] and got[0]


def test_nearest_center_sorts_no_pairs(spark):
    hands = spark.createDataFrame([(1, 7, 0.0, 0.0, 2.0, 2.0, 0.0, 0.0, 0.0)], "frame_id long, det_id long, x0 double, y0 double, x1 double, y1 double, dx double, dy double, magnitude double")
    objs = spark.createDataFrame([(1, 5, 4.0, 0.0, 6.0, 2.0), (1, 3, 0.0, 4.0, 2.0, 6.0), (1, 1, 8.0, 8.0, 10.0, 10.0), (2, 9, 0.0, 0.0, 1.0, 1.0)], "frame_id long, det_id long, x0 double, y0 double, x1 double, y1 double")
    out = J.nearest_center(hands, objs)
    assert [(r.hand_id, r.det_id, r.dist) for r in out.collect()] == [(7, 3, 4.0)]
    assert "transform(spots" in out._jdf.queryExecution().optimizedPlan().toString()


def test_unknown_words_move_once(spark):
    df = spark.createDataFrame([(1, "x a x b", "b x c"), (2, None, "a"), (3, "", None)], "id long, src string, tgt string")
    vocab = spark.createDataFrame([("a",)], "symbol string")
    out = C.encode_oov(df, vocab)
    assert sorted(map(tuple, out.collect())) == [(1, "<unk-0> a <unk-0> <unk-3>", "<unk-3> <unk-0> c"), (2, "", "a"), (3, "", "")]
    # positions stay inside the row; before, every word of both sides was a row
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_strip_token_splits_once(spark):
    df = spark.createDataFrame([("##a#b#",), ("###",), ("",), (None,), ("ab",)], "s string")
    out = df.select(T.strip_token(F.split("s", ""), "#").alias("t"))
    assert [r.t for r in out.collect()] == [["a", "#", "b"], [], [""], None, ["a", "b"]]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_bleu_counts_inside_rows(spark):
    df = spark.createDataFrame([(1, 0, "a b c d e"), (1, 1, "a b c d f"), (1, 2, "a b c x")], "id long, hyp_id long, text string")
    assert "MapInArrow" in M.pairwise_bleu(df)._jdf.queryExecution().toString()


def test_many_pairs_step_at_once():
    draw = np.random.default_rng(8)
    sizes = [0, 1, 5, 63, 64, 65, 128, 200]
    a = [draw.integers(0, 4, draw.choice(sizes)) for _ in range(60)]
    b = [np.concatenate([x[: draw.integers(0, len(x) + 1)], draw.integers(0, 5, draw.choice(sizes))]) for x in a]

    def plain(x, y):
        far, same = list(range(len(y) + 1)), [0] * (len(y) + 1)
        for i, u in enumerate(x, 1):
            f, c = [i], [0]
            for j, v in enumerate(y, 1):
                f.append(min(far[j] + 1, f[-1] + 1, far[j - 1] + (u != v)))
                c.append(same[j - 1] + 1 if u == v else max(same[j], c[-1]))
            far, same = f, c
        return far[-1], same[-1]

    want = [plain(x, y) for x, y in zip(a, b)]
    assert M.by_slices(M._edit_distances, a + [None], b + [a[0]], lambda x, y: len(x) + len(y)) == [w[0] for w in want] + [None]
    assert M.by_slices(M._common_lengths, a, b, lambda x, y: 0) == [w[1] for w in want]


def test_rows_of_quadratic_cost_are_dealt_out(spark):
    # a join's estimated size is the product of its sides, which kept such rows where they lay
    one = spark.range(40).select("id", F.repeat(F.lit("ab "), 50).alias("pred")).coalesce(1)
    both = one.join(one.select("id", F.col("pred").alias("ref")), "id")
    parts = M.error_counts(both, char_level=True).groupBy(F.spark_partition_id()).count().count()
    assert parts > 1


def test_greedy_pairs_fold_components_together(spark):
    pairs = spark.createDataFrame([(i, i + j, float(10 * i - j)) for i in range(0, 60, 3) for j in (0, 1)] + [(0, 3, 5.0)], "src long, tgt long, score double")
    out = S.greedy_one_to_one(pairs)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    # (3, 3) scores 30 and goes before (0, 3); (0, 0) scores 0 and goes before (0, 1)
    assert sorted((r.src, r.tgt) for r in out.collect()) == [(i, i) for i in range(0, 60, 3)]
