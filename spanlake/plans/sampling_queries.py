"""Queries over splits, samples, mixtures and embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from spanlake.operators import embeddings as E
from spanlake.operators import sampling as S
from spanlake.plans.annotation_queries import r6
from spanlake.plans.registry import query
from spanlake.plans.sequence_queries import PROMPT_SQL, unit_sql
from spanlake.plans.suppression_queries import rec_query


def key_sql(*parts: str) -> str:
    return "md5(" + " || ':' || ".join(f"({p})::VARCHAR" for p in parts) + ")"


def _videos(t):
    return t.narrations().groupBy("video_uid").agg(F.count("*").alias("n_actions"))


V = "v AS (SELECT conv_id AS id, count(*) AS n FROM conversations GROUP BY 1)"


@query(
    "quota_split",
    f"""WITH {V}, o AS (SELECT *, sum(n) OVER (ORDER BY {key_sql("'11'", 'id')}, id) - n AS b, sum(n) OVER () AS tot FROM v)
    SELECT id AS video_uid, n AS n_actions, CASE WHEN b < floor(tot * 0.6::DOUBLE) THEN 'first' ELSE 'second' END AS split FROM o""",
)
def _(t):
    return S.quota_split(_videos(t), 0.6, 11)


@query(
    "three_way_split",
    f"""WITH {V}, o AS (SELECT *, sum(n) OVER (ORDER BY {key_sql("'5a'", 'id')}, id) - n AS b, sum(n) OVER () AS tot FROM v),
    i AS (SELECT id, tot, sum(n) OVER (ORDER BY {key_sql("'5b'", 'id')}, id) - n AS b2 FROM o WHERE b < floor(tot * 0.75::DOUBLE))
    SELECT id AS video_uid, CASE WHEN b2 IS NULL THEN 'test' WHEN b2 < floor(tot * 0.5::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM o LEFT JOIN i USING (id, tot)""",
)
def _(t):
    return S.three_way_split(_videos(t), 0.5, 0.25, 5).select("video_uid", "split")


@query(
    "held_out_split",
    f"""WITH a AS (SELECT event_id AS id, event_type AS verb, user_id % 40 AS noun FROM events),
    p AS (SELECT verb, noun, count(*) AS n FROM a GROUP BY 1, 2),
    c AS (SELECT *, sum(n) OVER (ORDER BY n DESC, verb, noun) - n < 0.7 * sum(n) OVER () AS common FROM p),
    x AS (SELECT id, row_number() OVER (ORDER BY {key_sql("'3'", 'id')}, id) - 1 AS i, count(*) OVER () AS m FROM a JOIN c USING (verb, noun) WHERE common)
    SELECT a.id, CASE WHEN x.id IS NULL THEN 'test' WHEN i < round_even(m * 0.7::DOUBLE, 0) THEN 'train' ELSE 'val' END AS split FROM a LEFT JOIN x USING (id)""",
)
def _(t):
    a = t.raw("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("verb"), (F.col("user_id") % 40).alias("noun"))
    return S.held_out_split(a, 0.7, 3).select("id", "split")


@query(
    "reservoir_split",
    f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {key_sql("'9'", 'doc_id')}, doc_id) <= 120 THEN 'sample' ELSE 'remainder' END AS part FROM documents""",
)
def _(t):
    return S.reservoir_split(t.raw("documents").select("doc_id"), 120, 9)


@query("shard_docs", "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 7)::INT AS shard FROM documents")
def _(t):
    return S.shard_docs(t.raw("documents").select("doc_id"), 7)


@query(
    "contiguous_shard",
    """SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
    WHERE i >= 2 * n // 7 AND i < 3 * n // 7""",
)
def _(t):
    return S.contiguous_shard(t.raw("orders").select("o_orderkey"), 2, 7, "o_orderkey")


@query(
    "padded_shard",
    f"""WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY {key_sql("'4'", 'c_custkey')}, c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer),
    w AS (SELECT c_custkey, i AS pos, ceil(n / 7) AS sz FROM o UNION ALL SELECT c_custkey, i + n, ceil(n / 7) FROM o WHERE i < ceil(n / 7) * 7 - n)
    SELECT c_custkey, pos FROM w WHERE pos >= 6 * sz AND pos < 7 * sz""",
)
def _(t):
    return S.padded_shard(t.raw("customer").select("c_custkey"), 6, 7, 4, "c_custkey")


@query(
    "subsample",
    f"SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY {key_sql(chr(39) + '8' + chr(39), 'o_orderkey')}, o_orderkey) <= ceil((SELECT count(*) FROM orders) * 0.13::DOUBLE)",
)
def _(t):
    return S.subsample(t.raw("orders").select("o_orderkey"), 0.13, 8, "o_orderkey")


@query(
    "resample",
    f"""WITH c AS (SELECT event_id, sum(value) OVER (ORDER BY event_id) - value AS pos FROM events WHERE value > 0),
    d AS (SELECT id AS draw, {unit_sql("'1'", "'2'", 'id')} * (SELECT sum(value) FROM events) AS pos FROM (SELECT unnest(range((SELECT ceil(count(*) * 0.5)::BIGINT FROM events))) AS id))
    SELECT event_id, draw FROM d ASOF JOIN c ON d.pos >= c.pos""",
)
def _(t):
    return S.resample(t.raw("events").select("event_id", "value"), "event_id", "value", 0.5, True, 1, 2)


@query(
    "resample_without_replacement",
    f"""SELECT event_id, 0::BIGINT AS draw FROM events WHERE value > 0
    QUALIFY row_number() OVER (ORDER BY -ln(greatest({unit_sql("'1'", "'2'", 'event_id')}, 1e-300)) / value, event_id) <= (SELECT ceil(count(*) * 0.2) FROM events)""",
)
def _(t):
    return S.resample(t.raw("events").select("event_id", "value"), "event_id", "value", 0.2, False, 1, 2)


@query(
    "temperature_weights",
    "SELECT source, n, round(pow(n / sum(n) OVER (), 1 / 3e0), 6) AS weight FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)",
)
def _(t):
    s = t.raw("documents").groupBy("source").agg(F.count("*").alias("n"))
    return S.temperature_weights(s, 3.0).select("source", "n", r6("weight"))


@query(
    "class_balanced_weights",
    """WITH p AS (SELECT DISTINCT l_orderkey % 3 AS source, l_orderkey AS image_id, l_suppkey % 10 AS c FROM lineitem),
    f AS (SELECT source, c, count(*) AS f FROM p GROUP BY 1, 2),
    r AS (SELECT source, image_id, sum(pow(f, -0.5)) AS w FROM p JOIN f USING (source, c) GROUP BY 1, 2),
    z AS (SELECT source, count(*) AS n, sum(w) AS s FROM r GROUP BY 1)
    SELECT source, image_id, round(w * n / s * ((SELECT max(n) FROM z) / n) * CASE source WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END / 6, 6) AS weight FROM r JOIN z USING (source)""",
)
def _(t):
    a = t.raw("lineitem").select(
        (F.col("l_orderkey") % 3).alias("source"), F.col("l_orderkey").alias("image_id"), (F.col("l_suppkey") % 10).alias("category_id")
    )
    return S.class_balanced_weights(a, 0.5, {0: 1, 1: 2, 2: 3}).select("source", "image_id", r6("weight"))


@query(
    "aspect_buckets",
    """WITH b AS (SELECT p_partkey AS image_id, p_partkey % 2 * 2 + CASE WHEN p_size <= 25 THEN 1 ELSE 0 END AS bucket FROM part),
    i AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY image_id) - 1 AS i, count(*) OVER (PARTITION BY bucket) AS n FROM b)
    SELECT image_id, bucket, i // 16 AS batch FROM i WHERE i < n // 16 * 16""",
)
def _(t):
    p = t.raw("part").select(
        F.col("p_partkey").alias("image_id"), (F.col("p_partkey") % 2).alias("source"), F.col("p_size").alias("width"), F.lit(25).alias("height")
    )
    return S.aspect_buckets(p, 16)


@query(
    "corpus_mixture",
    f"""WITH c AS (SELECT 'c' AS corpus, c_custkey AS id, row_number() OVER (ORDER BY {key_sql("'2'", "'c'", 'c_custkey')}, c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer),
    p AS (SELECT 'p' AS corpus, p_partkey AS id, row_number() OVER (ORDER BY {key_sql("'2'", "'p'", 'p_partkey')}, p_partkey) - 1 AS i, count(*) OVER () AS n FROM part),
    s AS (SELECT 's' AS corpus, s_suppkey AS id, row_number() OVER (ORDER BY {key_sql("'2'", "'s'", 's_suppkey')}, s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier),
    k AS (SELECT *, floor(0.5::DOUBLE * tot)::BIGINT AS wc, floor(0.3::DOUBLE * tot)::BIGINT AS wp FROM (SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) AS tot)),
    u AS (SELECT c.*, wc AS want FROM c, k UNION ALL SELECT p.*, wp FROM p, k UNION ALL SELECT s.*, tot - wc - wp FROM s, k)
    SELECT corpus, id, unnest(range(want // n + CASE WHEN i < want % n THEN 1 ELSE 0 END))::INT AS copy FROM u""",
)
def _(t):
    dfs = {
        "c": t.raw("customer").select(F.col("c_custkey").alias("id")), "p": t.raw("part").select(F.col("p_partkey").alias("id")),
        "s": t.raw("supplier").select(F.col("s_suppkey").alias("id")),
    }
    return S.corpus_mixture(dfs, [0.5, 0.3, 0.2], 2).select("corpus", "id", "copy")


@query(
    "interleave_corpora",
    f"""WITH d AS (SELECT i AS pos, CASE WHEN u < 0.5 THEN 'c' WHEN u < 0.8 THEN 'n' ELSE 's' END AS corpus FROM (SELECT i, {unit_sql("'6'", 'i')} AS u FROM (SELECT unnest(range((SELECT count(*) FROM orders))) AS i))),
    r AS (SELECT 'c' AS corpus, c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer
        UNION ALL SELECT 'n', n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1, count(*) OVER () FROM nation
        UNION ALL SELECT 's', s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1, count(*) OVER () FROM supplier)
    SELECT pos, d.corpus, id FROM d JOIN r ON d.corpus = r.corpus AND d.pos % r.n = r.i""",
)
def _(t):
    dfs = {
        "c": t.raw("customer").select(F.col("c_custkey").alias("id")), "n": t.raw("nation").select(F.col("n_nationkey").cast("long").alias("id")),
        "s": t.raw("supplier").select(F.col("s_suppkey").alias("id")),
    }
    return S.interleave_corpora(dfs, [5, 3, 2], t.raw("orders").count(), 6)


@query(
    "in_context_samples",
    f"""WITH a AS (SELECT event_id AS id, event_type AS verb, event_id % 5 AS noun, user_id % 3 AS r FROM events),
    q AS (SELECT id AS q, verb, noun FROM a WHERE r = 0), p AS (SELECT * FROM a WHERE r > 0),
    m AS (SELECT verb, noun, count(*) AS m FROM p GROUP BY 1, 2),
    bp AS (SELECT id, verb, noun, row_number() OVER (PARTITION BY verb, noun ORDER BY {key_sql("'4'", 'id')}, id) - 1 AS pos FROM p),
    ap AS (SELECT id, row_number() OVER (ORDER BY {key_sql("'4:all'", 'id')}, id) - 1 AS pos, count(*) OVER () AS n FROM p),
    st AS (SELECT q, verb, noun, {unit_sql("'4'", "'start'", 'q')} AS u FROM q),
    h AS (SELECT q, j AS slot, bp.id, true AS matched FROM st JOIN m USING (verb, noun), (SELECT unnest(range(2)) AS j) JOIN bp ON bp.verb = st.verb AND bp.noun = st.noun AND bp.pos = (floor(u * m)::BIGINT + j) % m WHERE j < m),
    f AS (SELECT q, j, ap.id FROM st, (SELECT unnest(range(7)) AS j) JOIN ap ON ap.pos = (floor(u * n)::BIGINT + j) % n WHERE (q, ap.id) NOT IN (SELECT q, id FROM h)),
    k AS (SELECT q, count(*) AS k FROM h GROUP BY 1),
    z AS (SELECT f.q, row_number() OVER (PARTITION BY f.q ORDER BY j) - 1 + coalesce(k, 0) AS slot, id, false AS matched FROM f LEFT JOIN k ON k.q = f.q)
    SELECT q, slot, id, matched FROM h UNION ALL SELECT q, slot, id, matched FROM z WHERE slot < 4""",
)
def _(t):
    a = t.raw("events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("verb"), (F.col("event_id") % 5).alias("noun"), (F.col("user_id") % 3).alias("r")
    )
    return S.in_context_samples(a.where("r = 0"), a.where("r > 0"), 4, 0.5, 4)


# fixed values: event labels and a few further class names
CLASSES = ["click", "error", "purchase", "signup", "view", "cut_dough", "wash_hands", "fold_clothes_/_sheets"]
_ABSENT = "list_filter(['click', 'cut dough', 'error', 'fold clothes or sheets', 'purchase', 'signup', 'view', 'wash hands'], lambda c: NOT list_contains(acts, c))"


def _pick(*parts: str) -> str:
    return f"absent[floor({unit_sql(*parts)} * len(absent))::INT + 1]"


@rec_query(
    "negative_prompts",
    PROMPT_SQL.format(u=unit_sql("'0'", "clip_id", "s.i")).replace("SELECT clip_id, prompt FROM run QUALIFY", ", pr AS (SELECT clip_id, prompt FROM run QUALIFY") + f"""),
    ac AS (SELECT clip_id, list(label ORDER BY rk) AS acts FROM o GROUP BY 1),
    b AS (SELECT clip_id, prompt, acts, {_ABSENT} AS absent FROM pr JOIN ac USING (clip_id)),
    rp AS (SELECT b.*, i, 0 AS j, prompt AS cur FROM b, (SELECT unnest(range(27)) AS i)
        UNION ALL SELECT clip_id, prompt, acts, absent, i, j + 1, CASE WHEN j = 0 OR {unit_sql("'0'", "'p'", 'clip_id', 'i', 'j')} > 0.5 THEN replace(cur, acts[j + 1], {_pick("'0'", 'clip_id', "'r'", 'i', 'j')}) ELSE cur END
        FROM rp WHERE j < len(acts))
    SELECT clip_id, 'replace' AS kind, i, cur AS prompt FROM rp WHERE j = len(acts)
    UNION ALL SELECT clip_id, 'add', i, 'I ' || {_pick("'0'", 'clip_id', "'a'", 'i')} || ' . Then ' || prompt FROM b, (SELECT unnest(range(4)) AS i)""",
    ["segments"],
)
def _(t):
    return S.negative_prompts(t.segments(), CLASSES)


@query("sample_constraints")
def _(t):
    out = S.sample_constraints(t.texts(), 3, 4, 1, "id", "ref")
    return out.select("id", F.array_join("constraints", " | ").alias("constraints"))


# ---- embeddings -------------------------------------------------------------------------------


def _sides(t):
    e = t.raw("embeddings")
    x = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("x_id"), "embedding")
    y = e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("y_id"), "embedding")
    return x, y


SIM = """s AS (SELECT a.vec_id AS x, b.vec_id AS y, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
    FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)"""


@query(
    "knn_join",
    f"WITH {SIM} SELECT x AS x_id, y AS y_id, round(sim, 6) AS sim FROM s QUALIFY row_number() OVER (PARTITION BY x ORDER BY sim DESC, y) <= 4",
)
def _(t):
    x, y = _sides(t)
    return E.knn_join(x, y, 4, pivots=8).select("x_id", "y_id", r6("sim"))


@rec_query(
    "mine_pairs",
    f"""WITH RECURSIVE {SIM}, f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY x ORDER BY sim DESC, y) <= 4),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY y ORDER BY sim DESC, x) <= 4),
    fm AS (SELECT x, avg(sim) AS fm FROM f GROUP BY 1), bm AS (SELECT y, avg(sim) AS bm FROM b GROUP BY 1),
    fs AS (SELECT x, y, sim / ((fm + bm) / 2) AS sc FROM f JOIN fm USING (x) JOIN bm USING (y) QUALIFY row_number() OVER (PARTITION BY x ORDER BY sim / ((fm + bm) / 2) DESC, y) = 1),
    bs AS (SELECT x, y, sim / ((fm + bm) / 2) AS sc FROM b JOIN fm USING (x) JOIN bm USING (y) QUALIFY row_number() OVER (PARTITION BY y ORDER BY sim / ((fm + bm) / 2) DESC, x) = 1),
    u AS (SELECT x, y, max(sc) AS sc FROM (SELECT * FROM fs UNION ALL SELECT * FROM bs) GROUP BY 1, 2),
    p AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY sc DESC, x, y) AS rk FROM u),
    run AS (SELECT rk, x, y, sc, true AS ok, [x] AS us, [y] AS ut FROM p WHERE rk = 1
        UNION ALL SELECT p.rk, p.x, p.y, p.sc, NOT list_contains(us, p.x) AND NOT list_contains(ut, p.y),
            CASE WHEN NOT list_contains(us, p.x) AND NOT list_contains(ut, p.y) THEN list_append(us, p.x) ELSE us END,
            CASE WHEN NOT list_contains(us, p.x) AND NOT list_contains(ut, p.y) THEN list_append(ut, p.y) ELSE ut END
        FROM run JOIN p ON p.rk = run.rk + 1)
    SELECT x AS src, y AS tgt, round(sc, 6) AS score FROM run WHERE ok AND sc > 1.06""",
    [],
)
def _(t):
    x, y = _sides(t)
    out = E.mine_pairs(x.withColumnRenamed("x_id", "id"), y.withColumnRenamed("y_id", "id"))
    return out.select("src", "tgt", r6("score"))


@query(
    "similar_partner",
    f"""WITH n AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: v / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
    s AS (SELECT a.vec_id AS x, b.vec_id AS y, list_inner_product(a.e, b.e) AS sim FROM n a, n b),
    k AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY sim DESC, y) - 1 AS r FROM s WHERE sim < 1 - 1e-9 QUALIFY r < 5)
    SELECT x AS vec_id, p::INT AS pick, y AS partner, round(1 - sim, 6) AS distance FROM k, (SELECT unnest(range(3)) AS p) WHERE r = floor({unit_sql("'0'", 'x', 'p')} * 5)""",
)
def _(t):
    out = E.similar_partner(t.raw("embeddings"), 5, 3, 0, "vec_id")
    return out.select("vec_id", "pick", "partner", r6("distance"))


@query(
    "pca_full_rank_norms",
    """WITH m AS (SELECT p, avg(v) AS m FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY 1)
    SELECT vec_id, round(sum((v - m) * (v - m)), 6) AS sq_norm FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM embeddings) JOIN m USING (p) GROUP BY 1""",
)
def _(t):
    f = t.frames().select("vec_id", "embedding")
    out = E.pca_fit_transform(f, f, max_k=64, variance=1.0)
    return out.select("vec_id", r6(F.aggregate("reduced", F.lit(0.0), lambda s, x: s + x * x), "sq_norm"))


@query("pca_fit_transform")
def _(t):
    f = t.frames().select("clip_id", "vec_id", "embedding")
    out = E.pca_fit_transform(f, f.where("clip_id % 4 < 3"))
    return out.select("vec_id", F.size("reduced").alias("k"), r6(F.aggregate("reduced", F.lit(0.0), lambda s, x: s + x * x), "sq_norm"))


@query("pca_whiten")
def _(t):
    out = E.pca_whiten(t.frames().select("vec_id", "embedding"), 16)
    return out.select("vec_id", r6(F.aggregate("reduced", F.lit(0.0), lambda s, x: s + x * x), "sq_norm"))


@query("kmeans_fit_assign")
def _(t):
    out = E.kmeans_fit_assign(t.frames().select("clip_id", "vec_id", "embedding"), 10, 0.8, 1)
    return out.groupBy("cluster").agg(F.count("*").alias("n"), r6(F.avg("sq_dist"), "inertia"))


@query(
    "map_features",
    "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE * 2)), 6) AS total FROM embeddings",
)
def _(t):
    def setup():
        return 2.0

    def predict(pdf: pd.DataFrame, scale) -> pd.DataFrame:
        return pd.DataFrame({"vec_id": pdf["vec_id"], "total": [scale * float(np.asarray(v, float).sum()) for v in pdf["embedding"]]})

    return E.map_features(t.raw("embeddings").select("vec_id", "embedding"), predict, "vec_id long, total double", setup).select("vec_id", r6("total"))
