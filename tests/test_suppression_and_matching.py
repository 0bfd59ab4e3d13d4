"""Suppression, assignment and linking against slow baselines."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spanlake.operators import retrieval as R
from spanlake.operators import sets as S
from spanlake.operators import suppress as N


def ovr(a, b):
    inter = max(0.0, min(a[1], b[1]) - max(a[0], b[0]))
    return inter / ((a[1] - a[0] + 1e-6) + (b[1] - b[0] + 1e-6) - inter)


def slow_suppress(rows, method, thr, sigma, low):
    live = {i: s for i, _, _, s in rows if (s > low if method == "hard" else s >= low)}
    span = {i: (a, b) for i, a, b, _ in rows}
    out = {}
    while live:
        i = max(live, key=lambda k: (live[k], -k))
        out[i] = live.pop(i)
        for j in list(live):
            o = ovr(span[i], span[j])
            if method == "hard":
                w = 0.0 if o >= thr else 1.0
            elif method == "linear":
                w = 1 - o if o >= thr else 1.0
            else:
                w = math.exp(-o * o / sigma)
            live[j] *= w
            if (method == "hard" and w == 0.0) or (method != "hard" and live[j] < low):
                del live[j]
    return out


@pytest.fixture(scope="module")
def preds(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        s = rng.uniform(0, 90)
        rows.append((0, i, "a", s, s + rng.uniform(0.5, 9), rng.random()))
    return rows, spark.createDataFrame(rows, "clip_id int, pred_id long, label string, t_start double, t_end double, score double")


@pytest.mark.parametrize("method", ["hard", "linear", "gauss"])
@pytest.mark.parametrize("group_rows", [1000, 8])
def test_fold_and_rounds_equal_baseline(preds, method, group_rows):
    rows, df = preds
    want = slow_suppress([(r[1], r[3], r[4], r[5]) for r in rows], method, 0.3, 0.5, 0.4)
    got = {r.pred_id: r.score for r in N.suppress(df, ["clip_id"], method=method, threshold=0.3, min_score=0.4, group_rows=group_rows).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


@pytest.mark.parametrize("shape", ["chain", "clique", "mixed"])
@pytest.mark.parametrize("method", ["hard", "linear", "gauss"])
def test_tiles_equal_the_fold(spark, shape, method):
    rng = random.Random(11)
    n = 150
    rows = []
    for i in range(n):
        if shape == "chain":  # each row hangs on the one before
            s, e, score = float(i), i + 1.5, 1 - i / 1000
        elif shape == "clique":  # all overlap all
            s, e, score = 50 - rng.uniform(0, 50), 50 + rng.uniform(0.1, 50), rng.random()
        else:
            s = rng.uniform(0, 200)
            e, score = s + (rng.uniform(0.5, 5) if i % 10 else rng.uniform(50, 150)), rng.choice([0.5, rng.random()])
        rows.append((0, i, "a", s, e, score))
    df = spark.createDataFrame(rows, "clip_id int, pred_id long, label string, t_start double, t_end double, score double")
    want = slow_suppress([(r[1], r[3], r[4], r[5]) for r in rows], method, 0.15, 0.5, 0.2)
    got = N.suppress_by_tiles(df.where("score > 0.2"), ["clip_id"], N.SEGMENT, "pred_id", method, 0.15, sigma=0.5, min_score=0.2, tile_rows=40)
    got = {r.pred_id: r.score for r in got.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_a_falling_chain_takes_a_round_per_tile(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(N, "split_by_size", lambda df, keys, bound: rounds.append(1) or S.split_by_size(df, keys, bound))
    n = 20_000
    df = spark.range(n).select(F.lit(0).alias("clip_id"), F.col("id").alias("pred_id"), F.lit("a").alias("label"), F.col("id").cast("double").alias("t_start"), (F.col("id") + 1.6).alias("t_end"), (1 - F.col("id") / 1e6).alias("score"))
    got = [r.pred_id for r in N.suppress_by_tiles(df, ["clip_id"], N.SEGMENT, "pred_id", "hard", 0.2, tile_rows=8000).orderBy("pred_id").collect()]
    assert got == list(range(0, n, 2)) and len(rounds) < 20


def test_box_rounds_equal_fold(spark):
    rng = random.Random(2)
    rows = [(0, i, *(lambda x, y: (x, y, x + rng.uniform(5, 30), y + rng.uniform(5, 30)))(rng.uniform(0, 80), rng.uniform(0, 80)), rng.random()) for i in range(40)]
    df = spark.createDataFrame(rows, "frame_id int, det_id long, x0 double, y0 double, x1 double, y1 double, score double")
    a = {(r.det_id, r.det_index) for r in N.box_nms(df, 0.2).collect()}
    b = {(r.det_id, r.det_index) for r in N.box_nms(df, 0.2, group_rows=10).collect()}
    assert a == b and 0 < len(a) < 40


def greedy_assignment(pairs, t):
    """pairs: (clip, label, pred, seg, score, tiou)."""
    used, want = set(), set()
    for p, _ in sorted({(q[2], -q[4]) for q in pairs}, key=lambda x: (x[1], x[0])):
        cands = sorted((-q[5], q[3]) for q in pairs if q[2] == p and q[5] >= t and q[3] not in used)
        if cands:
            used.add(cands[0][1])
            want.add((p, cands[0][1]))
    return want


@pytest.mark.parametrize("fold_rows", [1000, 20, 0])  # by group, by component and by rounds
def test_assignment_is_greedy(spark, fold_rows):
    rng = random.Random(7)
    pairs = [(p % 2, "ab"[p % 3 == 0], p, 100 * (p % 6) + g, round(1 - (p // 2) / 100, 3), rng.choice([0.2, 0.5, rng.random()])) for p in range(60) for g in rng.sample(range(12), 4)]
    df = spark.createDataFrame(pairs, "clip_id int, label string, pred_id long, seg_id long, score double, tiou double")
    got = {}
    for r in R.assign_detections(df, (0.1, 0.4), fold_rows).collect():
        got.setdefault(r.tiou_t, set()).add((r.pred_id, r.seg_id))
    assert got == {t: greedy_assignment(pairs, t) for t in (0.1, 0.4)}


def greedy_pairs(pairs):
    us, ut, want = set(), set(), set()
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in us and b not in ut:
            us.add(a), ut.add(b), want.add((a, b))
    return want


@pytest.mark.parametrize("fold_rows", [1000, 10, 0])
def test_greedy_one_to_one(spark, fold_rows):
    rng = random.Random(9)
    pairs = [(a, 1000 + b if a < 15 else b, rng.choice([0.5, rng.random()])) for a in range(30) for b in rng.sample(range(25), 6)]
    pairs += [(500 + i, 600 + i, 0.1) for i in range(5)] + [(500, 600, 0.9)]  # a pair with two scores
    df = spark.createDataFrame([*pairs, (None, 1, 0.9), (1, None, 0.9), (2, 3, None)], "src long, tgt long, score double")
    got = [(r.src, r.tgt) for r in S.greedy_one_to_one(df, fold_rows=fold_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy_pairs(pairs)
    assert S.greedy_one_to_one(df.limit(0)).count() == 0


def test_a_falling_chain_needs_no_round_per_pair(spark):
    n = 2000
    pairs = [(i, i + d, 1 - (2 * i + d) / 1e4) for i in range(n) for d in (0, 1)]  # each pair is blocked by the one before
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "falling chain")
    try:
        got = {(r.src, r.tgt) for r in S.greedy_one_to_one(spark.createDataFrame(pairs, "src long, tgt long, score double").repartition(8)).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == greedy_pairs(pairs)
    assert len(tracker.getJobIdsForGroup("chain")) < 200


def test_components_of_paths_stars_and_loops(spark):
    from spanlake.plans.components import components

    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(400)] + [(1000, 1001 + i) for i in range(200)] + [(5000 + rnd.randrange(150), 5000 + rnd.randrange(150)) for _ in range(90)] + [(7777, 7777)]
    label = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(500):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    groups = {}
    for x, c in label.items():
        groups.setdefault(c, set()).add(root[x])
    assert label.keys() == root.keys() and all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(root.values()))


def test_tracklets_chain(spark):
    # 1 -> 2 -> 3 in a row, 4 and 5 start together after 3, so neither is the only candidate
    spans = {1: (0, 10), 2: (40, 50), 3: (90, 95), 4: (130, 140), 5: (131, 150)}
    rows = [("s", i, f) for i, (a, b) in spans.items() for f in (a, b)]
    out = S.merge_tracklets(spark.createDataFrame(rows, "seq string, id long, frame int"), 20, 100)
    assert {(r.id, r.merged_id) for r in out.collect()} == slow_tracklets(spans)


def slow_tracklets(spans, tmin=20, tmax=100):
    up = {i: i for i in spans}
    for i, (_, e) in spans.items():
        for j, (s, _) in spans.items():
            if i == j or not tmin < s - e < tmax:
                continue
            if sum(0 <= s - x[1] < tmax for x in spans.values()) > 1 or sum(0 <= x[0] - e < tmax for x in spans.values()) > 1:
                continue
            up[j] = i

    def root(i):
        return i if up[i] == i else root(up[i])

    return {(i, root(i)) for i in spans}


def test_random_tracklets(spark):
    rng = random.Random(4)
    spans = {}
    t = 0
    for i in range(1, 40):
        t += rng.randrange(10, 120)
        spans[i] = (t, t + rng.randrange(0, 60))
    rows = [("s", i, f) for i, (a, b) in spans.items() for f in (a, b)]
    out = S.merge_tracklets(spark.createDataFrame(rows, "seq string, id long, frame int"))
    assert {(r.id, r.merged_id) for r in out.collect()} == slow_tracklets(spans)


def test_recall_counts_missing_clips(spark):
    gt = spark.createDataFrame([(1, 1, "a", 0.0, 10.0), (2, 2, "a", 0.0, 10.0)], "clip_id int, seg_id long, label string, t_start double, t_end double")
    pred = spark.createDataFrame([(1, 1, "a", 0.0, 10.0, 0.5)], "clip_id int, pred_id long, label string, t_start double, t_end double, score double")
    got = {(r.tiou, r.k): r.recall for r in R.retrieval_recall(pred, gt).collect()}
    assert set(got.values()) == {0.5} and len(got) == 10


def test_average_precision_example(spark):
    rows = [("c", 0.9, 1, 0, 0), ("c", 0.8, 0, 0, 1), ("c", 0.7, 1, 0, 2)]
    df = spark.createDataFrame(rows, "label string, score double, target int, video_id int, t int")
    assert abs(R.average_precision(df).first().ap - (1 + 2 / 3) / 2) < 1e-12
    assert abs(R.multilabel_prf(df, 0.75).first().precision - 0.5) < 1e-12
    tau = R.tau_mask(spark.createDataFrame([(0, 5, "a"), (0, 6, "a")], "video_id int, t long, label string"), -2)
    assert {(r.t, r.label) for r in tau.collect()} == {(3, "a"), (4, "a")}


def test_nms_defaults_and_voting(preds):
    _, df = preds
    kept = N.nms(df, iou=0.3, multiclass=False, voting=0.75, max_seg=10).cache()
    assert kept.count() == 10
    assert kept.where(F.col("t_end") <= F.col("t_start")).count() == 0


def test_threshold_zero_keeps_the_best_row_for_any_group_size(spark):
    rows = [(1, 1, "a", 0.0, 1.0, 0.9), (1, 2, "a", 5.0, 6.0, 0.9), (1, 3, "a", 9.0, 9.5, 0.7)]
    df = spark.createDataFrame(rows, "clip_id int, pred_id long, label string, t_start double, t_end double, score double")
    for group_rows in (1, 100):
        assert [r.pred_id for r in N.suppress(df, ["clip_id"], threshold=0.0, group_rows=group_rows).collect()] == [1]


def test_segment_voting_votes_every_prediction(spark, sf):
    import __spark_entry__ as entry
    from spanlake.sources.tables import Tables

    rows = Tables(spark, sf).predictions().select("clip_id", "pred_id", "t_start", "t_end", "score").collect()
    by_clip, want = {}, {}
    for r in rows:
        by_clip.setdefault(r.clip_id, []).append(r)
    for r in rows:
        total = start = end = 0.0
        for o in by_clip[r.clip_id]:
            tiou = (min(r.t_end, o.t_end) - max(r.t_start, o.t_start)) / (max(r.t_end, o.t_end) - min(r.t_start, o.t_start))
            if tiou >= 0.5:
                total, start, end = total + tiou * o.score, start + tiou * o.score * o.t_start, end + tiou * o.score * o.t_end
        want[r.pred_id] = (start / total, end / total) if total else (r.t_start, r.t_end)
    got = {r.pred_id: (r.t_start, r.t_end) for r in entry.queries()["segment_voting"](spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(abs(x - y) < 0.0101 for i, w in want.items() for x, y in zip(got[i], w))
