"""Statistics over annotations against brute force, with hot seconds, points and many distinct values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.operators import annotations as A
from spanlake.operators import joins as J

SEG = "clip_id long, seg_id long, label string, t_start double, t_end double"


def segments(seed=1, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        s = rnd.choice([rnd.uniform(0, 60), float(rnd.randrange(60)), 30.0])
        rows.append((rnd.choice([0, 0, 0, 1, 2]), i, rnd.choice("abcd"), s, s + rnd.choice([0.0, 0.5, 1.0, rnd.uniform(0, 20)])))
    return rows


def test_partners_equal_brute_force(spark):
    rows = segments()
    got = {r.seg_id: r.n_partners for r in A.overlap_partners(spark.createDataFrame(rows, SEG)).collect()}
    want = {i: sum(1 for c2, j, _, a, b in rows if j != i and c2 == c and s < b and a < e) for c, i, _, s, e in rows}
    assert got == want


def test_partners_of_a_hot_second(spark):
    hot = spark.range(100_000).select(F.lit(1).cast("long").alias("clip_id"), F.col("id").alias("seg_id"), F.lit("x").alias("label"), (F.col("id") / 1e6).alias("t_start"), F.lit(5.0).alias("t_end"))
    row = A.overlap_partners(hot).agg(F.min("n_partners").alias("a"), F.max("n_partners").alias("b"), F.count("*").alias("n")).first()
    assert (row.a, row.b, row.n) == (99_999, 99_999, 100_000)


def brute_activity(rows, clips):
    active = {}
    for c, _, label, s, e in rows:
        if c in clips and label is not None:
            active.setdefault((c, label), set()).update(range(max(0, math.floor(s)), min(math.floor(e), math.floor(clips[c]))))
    return {k: v for k, v in active.items() if v}


@pytest.mark.parametrize("chunk", [7, 3600])
def test_cooccurrence_and_activity_equal_flags(spark, monkeypatch, chunk):
    monkeypatch.setattr(A, "CHUNK_SECONDS", chunk)
    rows = segments(2, 60) + [(1, 900, None, 0.0, 9.0), (7, 901, "a", 0.0, 9.0), (2, 902, "e", 70.0, 90.0)]
    clips = {0: 55.5, 1: 40.0, 2: 61.0}
    seg, cl = spark.createDataFrame(rows, SEG), spark.createDataFrame(list(clips.items()), "clip_id long, duration double")
    active = brute_activity(rows, clips)
    want = {}
    for (c, x), s in active.items():
        for (d, y), u in active.items():
            if c == d and x != y and s & u:
                want[x, y] = want.get((x, y), 0) + 1
    got = {(r.label_a, r.label_b): (r.n_clips, r.weight) for r in A.label_cooccurrence(seg, cl).collect()}
    assert {k: v[0] for k, v in got.items()} == want and all(abs(w - math.log(n)) < 1e-12 for n, w in got.values())
    act = {r.label: (r.n, r.n_clips, r.seconds) for r in A.label_activity(seg, cl).collect()}
    labels = {r[2] for r in rows} - {None}
    assert act == {
        x: (sum(r[2] == x for r in rows), sum(1 for c, y in active if y == x), sum(len(s) for (c, y), s in active.items() if y == x)) for x in labels
    }


@pytest.mark.parametrize("values", [[], [4.0], [1.0, 1.0, 1.0, 2.0], list(np.random.default_rng(1).normal(size=5001)), [5.0] * 3000 + list(range(1000))])
def test_percentiles_are_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in [*map(float, values), None, float("nan")]], "v double")
    for accuracy in (10_000, 20):
        got = A.distribution_summary(df, "v", accuracy=accuracy).first()
        assert got.n == len(values)
        if values:
            q1, q2, q3 = np.percentile(values, [25, 50, 75])
            assert all(abs(a - b) < 1e-9 for a, b in zip((got.q1, got.median, got.q3, got.iqr), (q1, q2, q3, q3 - q1)))
        else:
            assert got.median is None


def test_percentiles_of_a_million_distinct_values(spark):
    df = spark.range(1_000_000).select(((F.col("id") * 7919) % 1_000_003).cast("double").alias("v"))
    rows = {r.p: r.value for r in A.percentiles(df, "v", [0.1, 0.5, 0.999]).collect()}
    v = np.sort((np.arange(1_000_000) * 7919) % 1_000_003)
    assert all(abs(rows[p] - np.percentile(v, 100 * p)) < 1e-6 for p in rows) and len(rows) == 3


@pytest.mark.parametrize("per_task", [50_000, 7])
def test_boxes_and_masks_equal_counted_pixels(spark, per_task):
    rnd = random.Random(4)
    boxes = [(f, d, *(lambda x, y: (x, y, x + rnd.randint(-2, 30) + rnd.choice([0, 0.4, 0.5]), y + rnd.randint(0, 40)))(rnd.randint(-5, 40) + 0.25, float(rnd.randint(-5, 40)))) for f in range(3) for d in range(30)]
    runs = [(f, rnd.choice("ab"), rnd.randint(0, 40), x, x + rnd.randint(0, 15)) for f in (0, 1, 5) for x in (rnd.randint(0, 40) for _ in range(80))]
    b = spark.createDataFrame(boxes, "frame_id long, det_id long, x0 double, y0 double, x1 double, y1 double")
    r = spark.createDataFrame(runs, "frame_id long, object_label string, y int, x_start int, x_end int")
    got = {(x.frame_id, x.det_id, x.object_label): (x.inside, x.outside) for x in J.box_mask_join(b, r, 3.0, 0.05, per_task).collect()}
    want = {}
    for f, d, *corner in boxes:
        x0, y0, x1, y1 = (round(c) for c in corner)
        for label in "ab":
            own = [q for q in runs if q[0] == f and q[1] == label]
            inside = sum(max(0, min(x1, e) - max(x0, s)) for _, _, y, s, e in own if y0 <= y < y1)
            outside = sum(e - s for _, _, _, s, e in own) - inside
            if inside >= 3 and inside / (outside + 1e-6) >= 0.05:
                want[f, d, label] = (inside, outside)
    assert got == want and want
