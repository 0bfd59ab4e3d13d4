"""Queries over annotations: filters, counts, distributions, overlaps, recall, detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import annotations as A
from spanlake.operators import retrieval as R
from spanlake.plans.binned import overlap_join
from spanlake.plans.registry import query

# both sides report values rounded to six digits


def r6(c, name=None):
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c)


@query(
    "retrieval_recall",
    """
    , ranked AS (SELECT p.*, row_number() OVER (PARTITION BY p.clip_id, p.label ORDER BY score DESC, pred_id) AS rk
        FROM predictions p),
    n AS (SELECT clip_id, label, count(*) AS n FROM segments GROUP BY 1, 2),
    hit AS (SELECT s.seg_id, k, max(CASE WHEN rk <= k * n AND least(s.t_end, r.t_end) > greatest(s.t_start, r.t_start)
              THEN (least(s.t_end, r.t_end) - greatest(s.t_start, r.t_start))
                 / (greatest(s.t_end, r.t_end) - least(s.t_start, r.t_start)) ELSE 0 END) AS best
        FROM segments s JOIN n USING (clip_id, label) CROSS JOIN (VALUES (1), (5)) kk(k)
        LEFT JOIN ranked r ON r.clip_id = s.clip_id AND r.label = s.label GROUP BY 1, 2)
    SELECT tiou::DOUBLE AS tiou, k, round(avg(CASE WHEN best > tiou THEN 1.0 ELSE 0.0 END), 6) AS recall
    FROM hit CROSS JOIN (VALUES (0.1::DOUBLE), (0.2), (0.3), (0.4), (0.5)) tt(tiou) GROUP BY 1, 2
    """.replace(", ranked", "WITH ranked", 1),
    ["segments", "predictions"],
)
def _(t):
    return R.retrieval_recall(t.predictions(), t.segments()).select("tiou", "k", r6("recall"))


@query(
    "overlap_join",
    """SELECT a.clip_id, a.seg_id AS a_seg_id, b.seg_id AS b_seg_id,
        round(least(a.t_end, b.t_end) - greatest(a.t_start, b.t_start), 6) AS inter,
        round((least(a.t_end, b.t_end) - greatest(a.t_start, b.t_start))
            / (greatest(a.t_end, b.t_end) - least(a.t_start, b.t_start)), 6) AS tiou
    FROM segments a JOIN segments b ON a.clip_id = b.clip_id AND a.seg_id < b.seg_id
        AND a.t_start < b.t_end AND b.t_start < a.t_end""",
    ["segments"],
)
def _(t):
    s = t.segments().select("clip_id", "seg_id", "t_start", "t_end")
    return overlap_join(s, s, ["clip_id"]).where("a_seg_id < b_seg_id").select(
        "clip_id", "a_seg_id", "b_seg_id", r6("inter"), r6("tiou")
    )


@query(
    "match_segments",
    """SELECT p.clip_id, p.label, p.pred_id, s.seg_id,
        round((least(p.t_end, s.t_end) - greatest(p.t_start, s.t_start))
            / (greatest(p.t_end, s.t_end) - least(p.t_start, s.t_start)), 6) AS tiou
    FROM predictions p JOIN segments s ON p.clip_id = s.clip_id AND p.label = s.label
        AND p.t_start < s.t_end AND s.t_start < p.t_end""",
    ["segments", "predictions"],
)
def _(t):
    return R.match_segments(t.predictions(), t.segments()).select(
        "clip_id", "label", "pred_id", "seg_id", r6("tiou")
    )


FLAT_SQL = """SELECT subset, label, video_id, c.clip_id, round(duration, 6) AS clip_duration, fps,
        round(t_end - t_start, 6) AS label_duration, round(t_start, 6) AS label_start, round(t_end, 6) AS label_end
    FROM clips c LEFT JOIN segments s ON c.clip_id = s.clip_id"""


@query("flatten_annotations", FLAT_SQL, ["segments", "clips"])
def _(t):
    f = A.flatten_annotations(t.segments(), t.clips())
    return f.select(
        "subset", "label", "video_id", "clip_id", r6("clip_duration"), "fps", r6("label_duration"),
        r6("label_start"), r6("label_end"),
    )


@query(
    "filter_split",
    "SELECT clip_id, subset FROM clips WHERE lower(subset) IN ('train', 'val')",
    ["segments", "clips"],
)
def _(t):
    return A.filter_split(t.clips(), ["TRAIN", "val"]).select("clip_id", "subset")


@query(
    "filter_fps",
    """SELECT o_orderkey AS clip_uid, round(frames / dur, 6) AS fps FROM (
        SELECT o_orderkey, o_orderkey % 600 AS frames, o_custkey % 29 + 1 AS dur FROM orders)
        WHERE frames / dur BETWEEN 10 AND 100""",
)
def _(t):
    c = t.raw("orders").select(
        F.col("o_orderkey").alias("clip_uid"), F.lit(0.0).alias("video_start_sec"),
        (F.col("o_custkey") % 29 + 1).alias("video_end_sec"), F.lit(0).alias("video_start_frame"),
        (F.col("o_orderkey") % 600).alias("video_end_frame"),
    )
    return A.filter_fps(c).select("clip_uid", r6("fps"))


@query(
    "score_threshold",
    "SELECT frame_id, det_id, round(score, 6) AS score FROM boxes WHERE score > 0.95",
    ["boxes"],
)
def _(t):
    return A.score_threshold(t.boxes(), 0.95).select("frame_id", "det_id", r6("score"))


@query(
    "validate_labels",
    """SELECT vec_id, label, 'label_out_of_range' AS reason FROM embeddings WHERE NOT label BETWEEN 1 AND 7
    UNION ALL SELECT vec_id, label, 'size_mismatch' FROM embeddings WHERE label <> vec_id % 10""",
)
def _(t):
    e = t.raw("embeddings").select("vec_id", "label", (F.col("vec_id") % 10).alias("m"))
    return A.validate_labels(e, 1, 7, "label", ("label", "m")).select("vec_id", "label", "reason")


@query(
    "drop_empty_videos",
    """SELECT c_custkey AS video_uid, c_nationkey FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def _(t):
    v = t.raw("customer").select(F.col("c_custkey").alias("video_uid"), "c_nationkey")
    a = t.raw("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("video_uid"))
    return A.drop_empty_videos(v, a)


@query(
    "empty_video_report",
    """SELECT count(*) AS n_before, count(*) FILTER (WHERE c_custkey IN
        (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')) AS n_after FROM customer""",
)
def _(t):
    v = t.raw("customer").select(F.col("c_custkey").alias("video_uid"))
    a = t.raw("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("video_uid"))
    return A.empty_video_report(v, a)


@query("clips_per_subset", "SELECT subset, count(*) AS n_clips FROM clips GROUP BY 1", ["segments", "clips"])
def _(t):
    return A.clips_per_subset(t.clips())


@query(
    "clips_per_subset_rollup",
    "SELECT subset, count(*) AS n_clips FROM clips GROUP BY ROLLUP (subset)",
    ["segments", "clips"],
)
def _(t):
    return A.clips_per_subset(t.clips(), rollup=True)


@query(
    "annotations_per_clip",
    "SELECT clip_id, count(*) AS n_annotations FROM segments GROUP BY 1",
    ["segments"],
)
def _(t):
    return A.annotations_per_clip(A.flatten_annotations(t.segments(), t.clips()))


@query("clips_per_video", "SELECT video_id, count(*) AS n_clips FROM clips GROUP BY 1", ["segments", "clips"])
def _(t):
    return A.clips_per_video(t.clips())


@query("label_counts", "SELECT label, count(*) AS n FROM segments GROUP BY 1", ["segments"])
def _(t):
    return A.label_counts(t.segments())


@query(
    "distribution_summary",
    """SELECT count(*) AS n, round(median(d), 6) AS median, round(quantile_cont(d, 0.25), 6) AS q1,
        round(quantile_cont(d, 0.75), 6) AS q3,
        round(quantile_cont(d, 0.75) - quantile_cont(d, 0.25), 6) AS iqr
    FROM (SELECT t_end - t_start AS d FROM segments)""",
    ["segments"],
)
def _(t):
    d = t.segments().select((F.col("t_end") - F.col("t_start")).alias("d"))
    return A.distribution_summary(d, "d").select("n", *[r6(c) for c in ("median", "q1", "q3", "iqr")])


@query(
    "histogram",
    """WITH e AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 50 AS w FROM events),
    c AS (SELECT least(49, floor((value - lo) / w))::INT AS bin, count(*) AS n FROM events, e GROUP BY 1)
    SELECT g.bin, round(lo + g.bin * w, 6) AS left_edge, round(lo + (g.bin + 1) * w, 6) AS right_edge,
        coalesce(n, 0) AS n
    FROM (SELECT unnest(range(50))::INT AS bin) g CROSS JOIN e LEFT JOIN c ON c.bin = g.bin""",
)
def _(t):
    return A.histogram(t.raw("events"), "value").select("bin", r6("left_edge"), r6("right_edge"), "n")


@query(
    "overlap_stats",
    """WITH p AS (SELECT a.clip_id, (least(a.t_end, b.t_end) - greatest(a.t_start, b.t_start))
            / (greatest(a.t_end, b.t_end) - least(a.t_start, b.t_start)) AS tiou
        FROM segments a JOIN segments b ON a.clip_id = b.clip_id AND a.seg_id <> b.seg_id
            AND a.t_start < b.t_end AND b.t_start < a.t_end)
    SELECT clip_id, count(tiou) AS n_pairs, round(avg(tiou), 6) AS mean_tiou, round(max(tiou), 6) AS max_tiou
    FROM (SELECT DISTINCT clip_id FROM segments) LEFT JOIN p USING (clip_id) GROUP BY 1""",
    ["segments"],
)
def _(t):
    return A.overlap_stats(t.segments()).select("clip_id", "n_pairs", r6("mean_tiou"), r6("max_tiou"))


@query(
    "overlap_tiou_summary",
    """SELECT count(*) AS n, round(median(tiou), 6) AS median, round(quantile_cont(tiou, 0.25), 6) AS q1,
        round(quantile_cont(tiou, 0.75), 6) AS q3,
        round(quantile_cont(tiou, 0.75) - quantile_cont(tiou, 0.25), 6) AS iqr FROM (
        SELECT (least(a.t_end, b.t_end) - greatest(a.t_start, b.t_start))
            / (greatest(a.t_end, b.t_end) - least(a.t_start, b.t_start)) AS tiou
        FROM segments a JOIN segments b ON a.clip_id = b.clip_id AND a.seg_id <> b.seg_id
            AND a.t_start < b.t_end AND b.t_start < a.t_end)""",
    ["segments"],
)
def _(t):
    p = A.overlap_pairs(t.segments())
    return A.distribution_summary(p, "tiou").select("n", *[r6(c) for c in ("median", "q1", "q3", "iqr")])


@query(
    "clip_label_map",
    """SELECT clip_id, string_agg(label || '=' || n, ';' ORDER BY label) AS label_map FROM (
        SELECT clip_id, label, count(*) AS n FROM segments GROUP BY 1, 2) GROUP BY 1""",
    ["segments"],
)
def _(t):
    m = A.clip_label_map(t.segments())
    flat = F.array_join(
        F.transform(F.map_entries("label_map"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";"
    )
    return m.select("clip_id", flat.alias("label_map"))


@query(
    "label_frequencies",
    """SELECT label, count(*) AS n FROM (SELECT unnest([p_brand, p_type]) AS label FROM part) GROUP BY 1""",
)
def _(t):
    return A.label_frequencies(t.raw("part").select(F.array("p_brand", "p_type").alias("labels")))


#: Whole seconds of each segment, cut where the clip ends; clips here end at nine tenths of their last annotation.
WHOLE = """w AS (SELECT s.clip_id, label, floor(t_start) AS s, least(floor(t_end), floor(duration * 0.9)) AS e
        FROM segments s JOIN clips USING (clip_id) WHERE least(floor(t_end), floor(duration * 0.9)) > floor(t_start))"""


def _short_clips(t):
    return t.clips().withColumn("duration", F.col("duration") * 0.9)


@query(
    "label_cooccurrence",
    f"""WITH {WHOLE}
    SELECT a.label AS label_a, b.label AS label_b, count(DISTINCT a.clip_id) AS n_clips,
        round(ln(count(DISTINCT a.clip_id)), 6) AS weight
    FROM w a JOIN w b ON a.clip_id = b.clip_id AND a.label <> b.label AND a.s < b.e AND b.s < a.e GROUP BY 1, 2""",
    ["segments", "clips"],
)
def _(t):
    return A.label_cooccurrence(t.segments(), _short_clips(t)).select("label_a", "label_b", "n_clips", r6("weight"))


@query(
    "label_activity",
    f"""WITH {WHOLE}, f AS (SELECT *, max(e) OVER (PARTITION BY clip_id, label ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM w),
    a AS (SELECT label, count(DISTINCT clip_id) AS n_clips, sum(greatest(0, e - greatest(s, coalesce(u, s))))::BIGINT AS seconds FROM f GROUP BY 1)
    SELECT label, count(*) AS n, any_value(n_clips) AS n_clips, any_value(seconds) AS seconds FROM segments JOIN a USING (label) GROUP BY 1""",
    ["segments", "clips"],
)
def _(t):
    return A.label_activity(t.segments(), _short_clips(t))


@query(
    "overlap_partners",
    """SELECT a.clip_id, a.seg_id, count(b.seg_id) AS n_partners FROM segments a LEFT JOIN segments b ON a.clip_id = b.clip_id AND a.seg_id <> b.seg_id
        AND a.t_start < b.t_end AND b.t_start < a.t_end GROUP BY 1, 2""",
    ["segments"],
)
def _(t):
    return A.overlap_partners(t.segments())


@query(
    "confusion_matrix",
    """SELECT quality AS gt, toxic AS pred, count(*) AS n,
        round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS percent
    FROM labels GROUP BY 1, 2""",
)
def _(t):
    l = t.raw("labels").select(F.col("quality").alias("gt"), F.col("toxic").alias("pred"))
    return A.confusion_matrix(l).select("gt", "pred", "n", r6("percent"))


@query(
    "confusion_pivot",
    """SELECT quality AS gt, count(*) FILTER (WHERE toxic = 0) AS "0", count(*) FILTER (WHERE toxic = 1) AS "1"
    FROM labels GROUP BY 1""",
)
def _(t):
    l = t.raw("labels").select(F.col("quality").alias("gt"), F.col("toxic").alias("pred"))
    return A.confusion_pivot(l, [0, 1])


@query(
    "presence_counts",
    """SELECT grp AS label_group, count(DISTINCT frame_id) AS n_images FROM (
        SELECT frame_id, 'ret' AS grp FROM boxes WHERE label IN ('A', 'R')
        UNION ALL SELECT frame_id, 'any' FROM boxes) GROUP BY 1""",
    ["boxes"],
)
def _(t):
    return A.presence_counts(t.boxes(), groups={"ret": ["A", "R"], "any": ["A", "N", "R"]})


@query(
    "video_action_counts",
    """SELECT video_uid, count(*) AS n_actions, (SELECT count(*) FROM narrations) AS n_total
    FROM narrations GROUP BY 1""",
    ["narrations"],
)
def _(t):
    return A.video_action_counts(t.narrations())


@query(
    "pair_counts",
    """SELECT l_returnflag AS verb, l_suppkey % 40 AS noun, count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    l = t.raw("lineitem").select(F.col("l_returnflag").alias("verb"), (F.col("l_suppkey") % 40).alias("noun"))
    return A.pair_counts(l)


@query(
    "leaderboard",
    """SELECT l_returnflag AS flag, l_linestatus AS status, round(avg(l_discount), 6) AS metric
    FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    l = t.raw("lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_discount").alias("metric")
    )
    return A.leaderboard(l, ["flag", "status"], "metric").select("flag", "status", r6("metric"))


@query(
    "merge_partials",
    "SELECT o_orderkey AS id, o_totalprice AS v FROM orders",
)
def _(t):
    o = t.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    return A.merge_partials([o.where(F.pmod("id", F.lit(3)) == i) for i in range(3)], "id")


@query(
    "percent_diff",
    """WITH m AS (SELECT l_returnflag AS model, l_linestatus AS shot, avg(l_tax) AS v, avg(l_discount) AS r
        FROM lineitem GROUP BY 1, 2)
    SELECT model, shot, round(v, 6) AS value, round(r, 6) AS ref_value, round(100 * (v - r) / r, 6) AS percent_diff
    FROM m""",
)
def _(t):
    l = t.raw("lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("shot"))
    new = l.agg(F.avg("l_tax").alias("value"))
    ref = l.agg(F.avg("l_discount").alias("value"))
    return A.percent_diff(new, ref, ["model", "shot"]).select(
        "model", "shot", r6("value"), r6("ref_value"), r6("percent_diff")
    )


# ---- precision metrics ---------------------------------------------------------------------

AP_SQL = """WITH r AS (SELECT *, sum(target) OVER w AS tp, row_number() OVER w AS n FROM frame_scores
        WINDOW w AS (PARTITION BY label ORDER BY score DESC, video_id, t ROWS UNBOUNDED PRECEDING))
    SELECT label, round(sum(CASE WHEN target = 1 THEN tp / n ELSE 0 END) / greatest(sum(target), 1), 6) AS ap
    FROM r GROUP BY 1"""


@query("average_precision", AP_SQL, ["frames", "frame_scores"])
def _(t):
    return R.average_precision(t.frame_scores()).select("label", r6("ap"))


@query(
    "average_precision_weighted",
    """WITH s AS (SELECT *, 1.0 + t % 3 AS w FROM frame_scores),
    r AS (SELECT *, sum(target * w) OVER x AS tp, sum(w) OVER x AS n FROM s
        WINDOW x AS (PARTITION BY label ORDER BY score DESC, video_id, t ROWS UNBOUNDED PRECEDING))
    SELECT label, round(sum(CASE WHEN target = 1 THEN tp::DOUBLE / n::DOUBLE ELSE 0 END)
        / greatest(sum(target), 1), 6) AS ap
    FROM r GROUP BY 1""",
    ["frames", "frame_scores"],
)
def _(t):
    s = t.frame_scores().withColumn("w", 1.0 + F.col("t") % 3)
    return R.average_precision(s, weight="w").select("label", r6("ap"))


@query(
    "interpolated_ap",
    """WITH r AS (SELECT *, sum(target) OVER w AS tp, row_number() OVER w AS n,
            sum(target) OVER (PARTITION BY label) AS np FROM frame_scores
        WINDOW w AS (PARTITION BY label ORDER BY score DESC, video_id, t ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT label, n, tp / np AS recall, tp / n AS prec FROM r),
    e AS (SELECT *, max(prec) OVER (PARTITION BY label ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS env,
            lag(recall, 1, 0) OVER (PARTITION BY label ORDER BY n) AS prev FROM c)
    SELECT label, round(sum((recall - prev) * env), 6) AS ap FROM e GROUP BY 1""",
    ["frames", "frame_scores"],
)
def _(t):
    s = t.frame_scores()
    run = R._ranked_sums(
        s, ["label"], [F.col("score").desc(), F.col("video_id"), F.col("t")], F.col("target"), F.lit(1)
    )
    npos = s.groupBy("label").agg(F.sum("target").alias("np"))
    curve = run.join(npos, "label").select(
        "label", F.col("cum_n").alias("rank"), (F.col("cum_tp") / F.col("np")).alias("recall"),
        (F.col("cum_tp") / F.col("cum_n")).alias("precision"),
    )
    return R.interpolated_ap(curve, ["label"]).select("label", r6("ap"))


STEP_AP = """steps AS (SELECT {k}, score, sum(target) AS pos, count(*) AS n FROM {src} GROUP BY ALL),
    run AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS cn FROM steps
        WINDOW w AS (PARTITION BY {k} ORDER BY score DESC)),
    ap AS (SELECT {k}, sum(pos * tp / cn) / sum(pos) AS ap FROM run GROUP BY ALL)"""


@query(
    "multilabel_prf",
    "WITH "
    + STEP_AP.format(k="label", src="frame_scores")
    + """ SELECT label, round(coalesce(sum(target) FILTER (WHERE score >= 0.1)
            / nullif(count(*) FILTER (WHERE score >= 0.1), 0), 0), 6) AS precision,
        round(coalesce(sum(target) FILTER (WHERE score >= 0.1) / sum(target), 0), 6) AS recall,
        sum(target) AS support, round(max(ap), 6) AS ap FROM frame_scores JOIN ap USING (label) GROUP BY 1""",
    ["frames", "frame_scores"],
)
def _(t):
    return R.multilabel_prf(t.frame_scores(), 0.1).select(
        "label", r6("precision"), r6("recall"), "support", r6("ap")
    )


COND_SQL = (
    "WITH pos AS (SELECT DISTINCT video_id, t, label FROM frame_scores WHERE target = 1), mask AS ({mask}), "
    "sub AS (SELECT f.*, m.label AS cond FROM frame_scores f JOIN mask m USING (video_id, t) WHERE m.label <> f.label), "
    + STEP_AP.format(k="cond, label", src="sub")
    + """ SELECT cond, label, sum(target) AS n,
        round(coalesce(sum(target) FILTER (WHERE score >= 0.1)
            / nullif(count(*) FILTER (WHERE score >= 0.1), 0), 0), 6) AS precision,
        round(coalesce(sum(target) FILTER (WHERE score >= 0.1), 0) / sum(target), 6) AS recall,
        round(max(ap), 6) AS ap
    FROM sub JOIN ap USING (cond, label) GROUP BY 1, 2 HAVING sum(target) > 0"""
)


def _cond(t, tau):
    # a second active class per step makes in-step co-occurrence possible
    s = t.frame_scores().withColumn(
        "target", F.greatest("target", (F.pmod(F.col("t") + F.col("video_id"), F.lit(10)) == F.col("label")).cast("int"))
    )
    return R.conditional_metrics(s, tau, 0.1).select(
        "cond", "label", "n", r6("precision"), r6("recall"), r6("ap")
    )


FS2 = """WITH fs0 AS (SELECT * FROM frame_scores), fs AS (SELECT video_id, t, label, score,
    greatest(target, CASE WHEN (t + video_id) % 10 = label THEN 1 ELSE 0 END) AS target FROM fs0), """


def _cond_sql(mask):
    return FS2 + COND_SQL.format(mask=mask)[5:].replace("frame_scores", "fs")


@query("conditional_metrics", _cond_sql("SELECT * FROM pos"), ["frames", "frame_scores"])
def _(t):
    return _cond(t, 0)


NEAR = """SELECT DISTINCT p.video_id, p.t {op} d AS t, p.label FROM pos p, (VALUES (1), (2), (3)) dd(d)
    WHERE NOT EXISTS (SELECT 1 FROM pos q WHERE q.video_id = p.video_id AND q.label = p.label AND q.t = p.t {op} d)"""


@query("conditional_metrics_past", _cond_sql(NEAR.format(op="+")), ["frames", "frame_scores"])
def _(t):
    return _cond(t, 3)


@query("conditional_metrics_future", _cond_sql(NEAR.format(op="-")), ["frames", "frame_scores"])
def _(t):
    return _cond(t, -3)


@query(
    "tau_mask",
    "WITH pos AS (SELECT DISTINCT video_id, t, label FROM frame_scores WHERE target = 1) " + NEAR.format(op="+"),
    ["frames", "frame_scores"],
)
def _(t):
    return R.tau_mask(t.frame_scores().where("target = 1"), 3)


@query(
    "classification_metrics",
    """WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1)::DOUBLE AS tp,
        count(*) FILTER (WHERE quality <> 1 AND toxic = 1)::DOUBLE AS fp,
        count(*) FILTER (WHERE quality = 1 AND toxic <> 1)::DOUBLE AS fn,
        count(*) FILTER (WHERE quality <> 1 AND toxic <> 1)::DOUBLE AS tn FROM labels)
    SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
        round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
        round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6)
            AS mcc,
        round(((tp + tn) / (tp + fp + fn + tn) + coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) / 2, 6)
            AS acc_and_f1 FROM c""",
)
def _(t):
    l = t.raw("labels").select(F.col("quality").alias("gt"), F.col("toxic").alias("pred"))
    return R.classification_metrics(l).select(*[r6(c) for c in ("accuracy", "f1", "mcc", "acc_and_f1")])


@query(
    "correlation_metrics",
    """WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y,
        rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rx,
        rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS ry
        FROM lineitem)
    SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman,
        round((corr(x, y) + corr(rx, ry)) / 2, 6) AS corr FROM r""",
)
def _(t):
    return R.correlation_metrics(t.raw("lineitem"), "l_quantity", "l_extendedprice").select(
        r6("pearson"), r6("spearman"), r6("corr")
    )
