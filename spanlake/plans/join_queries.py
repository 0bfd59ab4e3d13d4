"""Queries over lookups, comparisons, positional and nearest joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import joins as J
from spanlake.plans.annotation_queries import r6
from spanlake.plans.registry import query

def actions(t):
    n = t.narrations()
    return n.withColumn("frame_path", F.concat_ws("|", F.col("video_uid").cast("string"), F.col("clip_index").cast("string")))


@query(
    "enrich_actions",
    """SELECT video_uid || '|' || clip_index AS frame_path, verb, 'n' || (length(text) % 7) AS noun
    FROM narrations JOIN conversations ON conv_id = video_uid AND turn = clip_index""",
    ["narrations"],
)
def _(t):
    look = t.raw("conversations").select(
        F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("frame_path"),
        F.concat(F.lit("n"), (F.length("text") % 7).cast("string")).alias("noun"),
    )
    return J.enrich_actions(actions(t), look, strict=True).select("frame_path", "verb", "noun")


@query(
    "missing_keys",
    """SELECT video_uid || '|' || clip_index AS frame_path FROM narrations WHERE verb = 'system'""",
    ["narrations"],
)
def _(t):
    a = actions(t)
    return J.missing_keys(a, a.where("verb <> 'system'"), ["frame_path"]).select("frame_path")


@query(
    "join_manifest",
    """SELECT d.doc_id AS idx, quality AS translation FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(t):
    a = t.raw("documents").select(F.col("doc_id").alias("path"), F.col("doc_id").alias("idx"))
    l = t.raw("labels").select(
        F.col("doc_id").alias("path"), F.col("quality").alias("translation"),
        F.when(F.col("toxic") == 1, "train_covost").otherwise("train").alias("split"),
    )
    return J.join_manifest(a, l, "train").select("idx", "translation")


@query(
    "attach_detections",
    """WITH p AS (SELECT *, (row_number() OVER (PARTITION BY frame_id ORDER BY det_id) - 1) // 3 AS part FROM boxes)
    SELECT o_orderkey AS frame_id, coalesce(part, 0) AS part, coalesce(string_agg(det_id || ':' || label, ';' ORDER BY det_id), '') AS dets
    FROM orders LEFT JOIN p ON frame_id = o_orderkey GROUP BY 1, 2""",
    ["boxes"],
)
def _(t):
    f = t.raw("orders").select(F.col("o_orderkey").alias("frame_id"))
    out = J.attach_detections(f, t.boxes(), rows=3)
    text = F.array_join(F.transform("detections", lambda d: F.concat_ws(":", d["det_id"].cast("string"), d["label"])), ";")
    return out.select("frame_id", "part", text.alias("dets"))


@query(
    "restrict_to",
    "SELECT seg_id FROM segments WHERE clip_id IN (SELECT clip_id FROM clips WHERE subset = 'val')",
    ["segments", "clips"],
)
def _(t):
    return J.restrict_to(t.segments(), t.clips().where("subset = 'val'")).select("seg_id")


@query(
    "decontaminate",
    """WITH held AS (SELECT text FROM benchmark UNION SELECT text FROM documents WHERE lang = 'de')
    SELECT id FROM texts WHERE pred NOT IN (SELECT text FROM held) AND ref NOT IN (SELECT text FROM held)""",
    ["texts"],
)
def _(t):
    held = t.raw("benchmark").select("text").union(t.raw("documents").where("lang = 'de'").select("text"))
    pairs = t.texts().select("id", F.col("pred").alias("src"), F.col("ref").alias("tgt"))
    return J.decontaminate(pairs, held).select("id")


@query(
    "compare_versions",
    """WITH a AS (SELECT clip_id, count(*) AS n_old FROM segments WHERE label <> 'view' OR clip_id % 7 > 0 GROUP BY 1),
    b AS (SELECT clip_id, count(*) AS n_new FROM segments WHERE label <> 'error' OR clip_id % 3 > 0 GROUP BY 1)
    SELECT clip_id, n_old, n_new FROM a FULL JOIN b USING (clip_id) WHERE n_old IS DISTINCT FROM n_new""",
    ["segments"],
)
def _(t):
    s = t.segments()
    return J.compare_versions(s.where("label <> 'view' or clip_id % 7 > 0"), s.where("label <> 'error' or clip_id % 3 > 0"))


@query(
    "verify_splits",
    """WITH l AS (SELECT *, conv_id || '|' || turn AS p FROM conversations WHERE role <> 'system'),
    t AS (SELECT *, conv_id || '|' || turn AS p FROM conversations WHERE turn < 6),
    e AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
    SELECT 'not_in_table' AS issue, p AS item, NULL::BIGINT AS n_expected, NULL::BIGINT AS n_found FROM l WHERE p NOT IN (SELECT p FROM t)
    UNION ALL SELECT 'not_in_listing', p, NULL, NULL FROM t WHERE p NOT IN (SELECT p FROM l)
    UNION ALL SELECT 'table_count', conv_id::VARCHAR, n, coalesce(k, 0) FROM e LEFT JOIN (SELECT conv_id, count(*) AS k FROM t GROUP BY 1) USING (conv_id) WHERE n <> coalesce(k, 0)
    UNION ALL SELECT 'listing_count', conv_id::VARCHAR, n, coalesce(k, 0) FROM e LEFT JOIN (SELECT conv_id, count(*) AS k FROM l GROUP BY 1) USING (conv_id) WHERE n <> coalesce(k, 0)""",
)
def _(t):
    a = actions(t)
    exp = a.groupBy("video_uid").agg(F.count("*").alias("n_expected"))
    return J.verify_splits(a.where("verb <> 'system'"), a.where("clip_index < 6"), exp)


@query(
    "plan_split_moves",
    """WITH e AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1),
    st AS (SELECT e.conv_id, coalesce(f.k, -1) = n AS ok FROM e
        LEFT JOIN (SELECT conv_id, count(*) AS k FROM conversations WHERE role = 'user' GROUP BY 1) t USING (conv_id)
        LEFT JOIN (SELECT conv_id, count(*) AS k FROM conversations WHERE conv_id % 3 <> 0 GROUP BY 1) f USING (conv_id)
        WHERE coalesce(t.k, 0) <> n)
    SELECT 'move' AS action, conv_id AS video_uid, conv_id || '|' || turn AS frame_path FROM conversations
        WHERE conv_id % 3 <> 0 AND conv_id IN (SELECT conv_id FROM st WHERE ok)
    UNION ALL SELECT 'error', conv_id, NULL FROM st WHERE NOT ok""",
)
def _(t):
    a = actions(t)
    exp = a.groupBy("video_uid").agg(F.count("*").alias("n_expected"))
    return J.plan_split_moves(exp, a.where("video_uid % 3 <> 0"), a.where("verb = 'user'"))


@query(
    "compare_extracted",
    """WITH a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, text FROM conversations),
    b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, text FROM conversations WHERE role <> 'system')
    SELECT conv_id AS video_uid, count(a.text) AS n_orig, count(b.text) AS n_extracted,
        min(CASE WHEN a.text <> b.text THEN pos END) AS first_diff
    FROM a FULL JOIN b USING (conv_id, pos) GROUP BY 1 HAVING count(a.text) <> count(b.text) OR min(CASE WHEN a.text <> b.text THEN pos END) IS NOT NULL""",
)
def _(t):
    c = t.raw("conversations").select(F.col("conv_id").alias("video_uid"), F.col("turn").alias("clip_index"), "text", "role")
    return J.compare_extracted(c, c.where("role <> 'system'"))


@query(
    "remap_categories",
    """WITH m AS (SELECT p_partkey, n_nationkey FROM part JOIN nation ON p_size % 7 = n_nationkey AND n_nationkey < 5)
    SELECT p_partkey AS ann_id, n_nationkey AS category_id, row_number() OVER (ORDER BY p_partkey) AS new_id FROM m""",
)
def _(t):
    ann = t.raw("part").select(F.col("p_partkey").alias("ann_id"), F.col("p_size").alias("category_id"))
    cats = ann.select("category_id").distinct().withColumn("synset", F.concat(F.lit("s"), (F.col("category_id") % 7).cast("string")))
    target = t.raw("nation").where("n_nationkey < 5").select(
        F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("synset"), F.col("n_nationkey").alias("target_id")
    )
    return J.remap_categories(ann, cats, target)[0].select("ann_id", "category_id", "new_id")


@query(
    "remap_categories_used",
    """SELECT DISTINCT p_size AS category_id, 's' || n_nationkey AS synset, n_nationkey AS target_id
    FROM part JOIN nation ON p_size % 7 = n_nationkey AND n_nationkey < 5""",
)
def _(t):
    ann = t.raw("part").select(F.col("p_partkey").alias("ann_id"), F.col("p_size").alias("category_id"))
    cats = ann.select("category_id").distinct().withColumn("synset", F.concat(F.lit("s"), (F.col("category_id") % 7).cast("string")))
    target = t.raw("nation").where("n_nationkey < 5").select(
        F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("synset"), F.col("n_nationkey").alias("target_id")
    )
    return J.remap_categories(ann, cats, target)[1].select("category_id", "synset", "target_id")


@query(
    "round_robin_zip",
    """WITH a AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer),
    b AS (SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier),
    c AS (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS n FROM nation)
    SELECT a.i AS pos, a.k AS c_k, b.k AS s_k, c.k AS n_k FROM a JOIN b ON a.i % b.n = b.i JOIN c ON a.i % c.n = c.i""",
)
def _(t):
    return J.round_robin_zip(
        {
            "c": t.raw("customer").select(F.col("c_custkey").alias("k")),
            "s": t.raw("supplier").select(F.col("s_suppkey").alias("k")),
            "n": t.raw("nation").select(F.col("n_nationkey").alias("k")),
        },
        {"c": "k", "s": "k", "n": "k"},
    )


FRAME50 = """g AS (SELECT frame_id // 50 AS frame_id, frame_id * 8 + det_id AS det_id, x0, y0, x1, y1, label, score FROM boxes)"""


def frames50(t):
    """Fifty orders share a frame, so that a frame holds many boxes."""
    return t.boxes().withColumn("det_id", F.col("frame_id") * 8 + F.col("det_id")).withColumn(
        "frame_id", F.floor(F.col("frame_id") / 50)
    )


@query(
    "nearest_center",
    f"""WITH {FRAME50},
    h AS (SELECT frame_id, det_id AS hand_id, trunc((x0 + x1) / 2) + 0.6 * score / 10 * 1000 AS ax,
        trunc((y0 + y1) / 2) + 0.8 * score / 10 * 1000 AS ay FROM g WHERE label = 'A'),
    d AS (SELECT h.frame_id, hand_id, o.det_id, sqrt(pow(trunc((x0 + x1) / 2) - ax, 2) + pow(trunc((y0 + y1) / 2) - ay, 2)) AS dist
        FROM h JOIN g o ON o.frame_id = h.frame_id AND o.label <> 'A')
    SELECT frame_id, hand_id, det_id, round(dist, 4) AS dist FROM d
    QUALIFY row_number() OVER (PARTITION BY frame_id, hand_id ORDER BY round(dist, 9), det_id) = 1""",
    ["boxes"],
)
def _(t):
    g = frames50(t)
    hands = g.where("label = 'A'").select(
        "frame_id", "det_id", "x0", "y0", "x1", "y1", F.lit(0.6).alias("dx"), F.lit(0.8).alias("dy"),
        (F.col("score") / 10).alias("magnitude"),
    )
    out = J.nearest_center(hands, g.where("label <> 'A'"))
    return out.select("frame_id", "hand_id", "det_id", F.round("dist", 4).alias("dist"))


NEAREST = """true_t AS (SELECT clip_id, seg_id, t_start AS t, CASE WHEN t_end - t_start < 1200 THEN 0 ELSE t_end - t_start END AS f
        FROM segments WHERE label = 'click'),
    est AS (SELECT clip_id, t_start AS t, CASE WHEN t_end - t_start < 900 THEN 0 ELSE t_end - t_start END AS v
        FROM segments WHERE label = 'view'),
    near AS (SELECT x.*, CASE WHEN p.t IS NULL OR n.t IS NULL THEN 0.0 WHEN x.t - p.t <= n.t - x.t THEN p.v ELSE n.v END AS est_value
        FROM true_t x ASOF LEFT JOIN est p ON x.clip_id = p.clip_id AND x.t >= p.t
        ASOF LEFT JOIN est n ON x.clip_id = n.clip_id AND x.t <= n.t)"""


def _f0(t):
    s = t.segments().withColumn("d", F.col("t_end") - F.col("t_start"))
    true = s.where("label = 'click'").select(
        "clip_id", "seg_id", F.col("t_start").alias("t"), F.when(F.col("d") < 1200, 0.0).otherwise(F.col("d")).alias("f0")
    )
    est = s.where("label = 'view'").select(
        "clip_id", F.col("t_start").alias("t"), F.when(F.col("d") < 900, 0.0).otherwise(F.col("d")).alias("f0")
    )
    return true, est


@query("nearest_time_join", f"WITH {NEAREST} SELECT seg_id, round(est_value, 6) AS est_value FROM near", ["segments"])
def _(t):
    true, est = _f0(t)
    return J.nearest_time_join(true, est, "clip_id", "f0").select("seg_id", r6("est_value"))


@query(
    "pitch_errors",
    f"""WITH {NEAREST}, c AS (SELECT count(*) FILTER (WHERE f <> 0 AND est_value <> 0) AS v,
        count(*) FILTER (WHERE f <> 0 AND est_value <> 0 AND abs(est_value / (f + 1e-8) - 1) > 0.2) AS g,
        count(*) FILTER (WHERE (f <> 0) <> (est_value <> 0)) AS d, count(*) AS n FROM near)
    SELECT round(g / v, 6) AS gross_pitch_error, round(d / n, 6) AS voicing_decision_error,
        round((g + d) / n, 6) AS f0_frame_error FROM c""",
    ["segments"],
)
def _(t):
    true, est = _f0(t)
    out = J.pitch_errors(true.drop("seg_id"), est, "clip_id")
    return out.select(*[r6(c) for c in out.columns])


RUNS = """r AS (SELECT frame_id, label AS object_label, y0::INT + k AS y, x0::INT AS x_start, x1::INT AS x_end
        FROM g, (SELECT unnest(range(30))::INT AS k) WHERE label <> 'A')"""


def runs(t):
    return frames50(t).where("label <> 'A'").select(
        "frame_id", F.col("label").alias("object_label"), F.col("x0").cast("int").alias("x_start"),
        F.col("x1").cast("int").alias("x_end"),
        F.explode(F.sequence(F.col("y0").cast("int"), F.col("y0").cast("int") + 29)).alias("y"),
    )


@query(
    "box_mask_join",
    f"""WITH {FRAME50}, {RUNS},
    tot AS (SELECT frame_id, object_label, sum(x_end - x_start) AS total FROM r GROUP BY 1, 2),
    i AS (SELECT g.frame_id, g.det_id, r.object_label, sum(greatest(0, least(x1::INT, x_end) - greatest(x0::INT, x_start))) AS inside
        FROM g JOIN r ON g.frame_id = r.frame_id AND r.y >= g.y0 AND r.y < g.y1 WHERE g.label = 'A' GROUP BY 1, 2, 3)
    SELECT i.frame_id, det_id, i.object_label, inside, total - inside AS outside FROM i JOIN tot USING (frame_id, object_label)
    WHERE inside >= 30 AND inside / (total - inside + 1e-6) >= 0.02""",
    ["boxes"],
)
def _(t):
    return J.box_mask_join(frames50(t).where("label = 'A'"), runs(t), 30.0, 0.02)


@query(
    "mask_to_box",
    f"""WITH {FRAME50}, {RUNS}
    SELECT frame_id, object_label, min(x_start) AS x0, min(y) AS y0, max(x_end) - 1 AS x1, max(y) AS y1 FROM r GROUP BY 1, 2""",
    ["boxes"],
)
def _(t):
    return J.mask_to_box(runs(t))
