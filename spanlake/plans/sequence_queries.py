"""Queries over windows, grids, runs, prompts and token sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import annotations as A
from spanlake.operators import sequence as Q
from spanlake.plans.annotation_queries import r6
from spanlake.plans.registry import query
from spanlake.plans.suppression_queries import rec_query


def unit_sql(*parts: str) -> str:
    """SQL twin of the seeded uniform draw."""
    joined = " || ':' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5({joined}), 1, 12))::BIGINT / 281474976710656e0)"


@query(
    "split_common_rare",
    """WITH p AS (SELECT l_returnflag AS verb, l_suppkey % 40 AS noun, count(*) AS n FROM lineitem GROUP BY 1, 2),
    c AS (SELECT *, sum(n) OVER (ORDER BY n DESC, verb, noun) - n AS b, sum(n) OVER () AS tot FROM p)
    SELECT verb, noun, n, CASE WHEN b < 0.6 * tot THEN 'common' ELSE 'rare' END AS part FROM c""",
)
def _(t):
    l = t.raw("lineitem").select(F.col("l_returnflag").alias("verb"), (F.col("l_suppkey") % 40).alias("noun"))
    return Q.split_common_rare(A.pair_counts(l), 0.6)


@query(
    "running_prefix",
    "SELECT o_orderkey, sum(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey) AS running FROM orders",
)
def _(t):
    o = t.raw("orders").select("o_orderkey", "o_orderdate", "o_custkey")
    return Q.running_prefix(o, [F.col("o_orderdate"), F.col("o_orderkey")], "o_custkey").select("o_orderkey", "running")


PROMPT_SQL = """WITH RECURSIVE f AS (SELECT clip_id, label, min({{'t': t_start, 'i': seg_id, 'e': t_end}}) AS s FROM
        (SELECT clip_id, replace(replace(label, '/', 'or'), '_', ' ') AS label, t_start, seg_id, t_end FROM segments) GROUP BY 1, 2),
    o AS MATERIALIZED (SELECT clip_id, label, s.t AS ts, s.e AS te,
        ['meanwhile ', 'simultaneously ', 'same time ', 'meantime '][floor({u} * 4)::INT + 1] AS mw,
        ['then ', 'later ', 'afterwards ', 'after '][floor({u} * 4)::INT + 1] AS tw,
        row_number() OVER (PARTITION BY clip_id ORDER BY s.t, s.i) AS rk FROM f),
    run AS (SELECT clip_id, rk, 'I ' || label || ' .' AS prompt, te FROM o WHERE rk = 1
        UNION ALL SELECT o.clip_id, o.rk, run.prompt || CASE WHEN ts < run.te - 1 THEN mw WHEN ts >= run.te + 1 THEN tw ELSE '' END
            || 'I ' || label || ' .', o.te
        FROM run JOIN o ON o.clip_id = run.clip_id AND o.rk = run.rk + 1)
    SELECT clip_id, prompt FROM run QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY rk DESC) = 1"""


@rec_query("build_prompt", PROMPT_SQL.format(u=unit_sql("'0'", "clip_id", "s.i")), ["segments"])
def _(t):
    return Q.build_prompt(t.segments())


@query(
    "narration_windows",
    """SELECT event_id, round(CASE WHEN greatest(value - 4, 0) + 8 > 40 THEN 32 ELSE greatest(value - 4, 0) END, 6) AS w_start,
        round(CASE WHEN greatest(value - 4, 0) + 8 > 40 THEN 40 ELSE greatest(value - 4, 0) + 8 END, 6) AS w_end FROM events""",
)
def _(t):
    e = t.raw("events").select("event_id", F.col("value").alias("t"), F.lit(40.0).alias("duration"))
    return Q.narration_windows(e).select("event_id", r6("w_start"), r6("w_end"))


WIN_SQL = """w AS (SELECT o_orderkey AS clip_uid, o_orderkey % 20 AS video_uid, greatest(o_custkey % 100 - 10, 0) AS sf,
        o_custkey % 100 - 10 + 100 + o_orderkey % 400 AS ef FROM orders),
    x AS (SELECT *, (ef - sf + sf % 16 - 32) % 16 AS rest FROM w),
    win AS (SELECT clip_uid, video_uid, (sf - sf % 16) // 16 AS si,
        floor((ef + CASE WHEN ((rest + 16) % 16) <> 0 THEN 16 - (rest + 16) % 16 ELSE 0 END - 32) / 16)::BIGINT AS ei FROM x)"""


def _windows(t):
    o = t.raw("orders").select(
        F.col("o_orderkey").alias("clip_uid"), (F.col("o_orderkey") % 20).alias("video_uid"),
        (F.col("o_custkey") % 100 - 10).alias("video_start_frame"),
        (F.col("o_custkey") % 100 - 10 + 100 + F.col("o_orderkey") % 400).alias("video_end_frame"),
    )
    return Q.clip_feature_windows(o)


@query("clip_feature_windows", f"WITH {WIN_SQL} SELECT clip_uid, si, ei FROM win")
def _(t):
    return _windows(t).select("clip_uid", "si", "ei")


@query(
    "slice_clip_features",
    f"""WITH {WIN_SQL}, n AS (SELECT clip_id AS video_uid, count(*) AS nf FROM frames GROUP BY 1)
    SELECT clip_uid, f.t - si AS t, NULL AS error FROM win JOIN n USING (video_uid) JOIN frames f
        ON f.clip_id = win.video_uid AND f.t >= si AND f.t < ei WHERE ei <= nf
    UNION ALL SELECT clip_uid, NULL, CASE WHEN nf IS NULL THEN 'no features' ELSE 'end index exceeds feature length' END
    FROM win LEFT JOIN n USING (video_uid) WHERE nf IS NULL OR ei > nf""",
    ["frames"],
)
def _(t):
    feats = t.frames().select(F.col("clip_id").alias("video_uid"), "t")
    return Q.slice_clip_features(_windows(t), feats).select("clip_uid", "t", "error")


@query(
    "stride_grid",
    """SELECT c_custkey AS clip_id, f AS frame_index FROM (SELECT c_custkey, unnest(range(0, c_custkey % 200, 30)) AS f FROM customer)""",
)
def _(t):
    c = t.raw("customer").select(F.col("c_custkey").alias("clip_id"), (F.col("c_custkey") % 200).alias("n_frames"))
    return Q.stride_grid(c, 30).select("clip_id", "frame_index")


@query(
    "uniform_grid",
    """SELECT c_custkey AS clip_id, i, (i * (c_custkey % 200)) // 16 AS frame_index
    FROM customer, (SELECT unnest(range(16))::INT AS i)""",
)
def _(t):
    c = t.raw("customer").select(F.col("c_custkey").alias("clip_id"), (F.col("c_custkey") % 200).alias("n_frames"))
    return Q.uniform_grid(c, 16).select("clip_id", "i", "frame_index")


@query(
    "pad_or_trim",
    """WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
    SELECT conv_id, turn FROM conversations JOIN n USING (conv_id) WHERE n >= 5
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 5""",
)
def _(t):
    return Q.pad_or_trim(t.raw("conversations").select("conv_id", "turn"), 5, "conv_id", "turn")


@query("short_clips", "SELECT conv_id, count(*) AS n_frames FROM conversations GROUP BY 1 HAVING count(*) < 5")
def _(t):
    return Q.short_clips(t.raw("conversations"), 5, "conv_id")


RASTER_SQL = """g AS (SELECT clip_id, seg_id, label, t_start * (1 / 600e0) AS t_start, t_end * (1 / 600e0) AS t_end FROM segments),
    ras AS (SELECT DISTINCT clip_id, label, unnest(range(floor(t_start)::BIGINT + 1, ceil(t_end)::BIGINT)) AS t FROM g)"""


def _grid(t):
    # ten-minute steps
    return Q.to_feature_grid(t.segments(), 1 / 600, 0, 1)


@query("rasterize", f"WITH {RASTER_SQL} SELECT clip_id, label, t FROM ras", ["segments"])
def _(t):
    return Q.rasterize(_grid(t))


@query(
    "to_feature_grid",
    """SELECT seg_id, round((t_start * (100 / duration) - 16) / 4, 6) AS t_start, round((t_end * (100 / duration) - 16) / 4, 6) AS t_end
    FROM segments JOIN clips USING (clip_id)""",
    ["segments", "clips"],
)
def _(t):
    s = t.segments().join(t.clips().select("clip_id", "duration"), "clip_id")
    out = Q.to_feature_grid(s, None, 32, 4, F.lit(100.0), F.col("duration"))
    return out.select("seg_id", r6("t_start"), r6("t_end"))


@query("downsample", "SELECT vec_id, t // 4 AS t FROM frames WHERE t % 4 = 0", ["frames"])
def _(t):
    return Q.downsample(t.frames().select("vec_id", "t"), 4)


CROP_SQL = """WITH {raster}, c AS (SELECT clip_id, ceil(max(t_end))::BIGINT AS feat_len FROM g GROUP BY 1),
    w AS (SELECT clip_id, trial, floor({u} * (feat_len - 200 + 1))::BIGINT AS st FROM c, (SELECT unnest(range(200)) AS trial) WHERE feat_len > 200),
    v AS (SELECT w.clip_id, trial, st, max(greatest(0, least(st + 200, t_end) - greatest(st, t_start)) / abs(t_end - t_start)) AS best,
            count(*) FILTER (WHERE greatest(0, least(st + 200, t_end) - greatest(st, t_start)) / abs(t_end - t_start) > 0
                AND greatest(0, least(st + 200, t_end) - greatest(st, t_start)) / abs(t_end - t_start) < 1) AS cutn
        FROM w JOIN g USING (clip_id) GROUP BY 1, 2, 3),
    pick AS (SELECT clip_id, st FROM v WHERE trial = 199 OR ({ok}) QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY trial) = 1),
    win AS (SELECT clip_id, st, false AS whole FROM pick UNION ALL SELECT clip_id, 0, true FROM c WHERE feat_len <= 200)
    SELECT g.seg_id, round(CASE WHEN whole THEN t_start ELSE greatest(st, t_start) - st END, 6) AS t_start,
        round(CASE WHEN whole THEN t_end ELSE least(st + 200, t_end) - st END, 6) AS t_end FROM g JOIN win USING (clip_id)
    WHERE whole OR greatest(0, least(st + 200, t_end) - greatest(st, t_start)) / abs(t_end - t_start) >= 0.5"""


def _crop(t, mode):
    g = _grid(t)
    c = g.groupBy("clip_id").agg(F.ceil(F.max("t_end")).alias("feat_len"))
    return Q.random_window_crop(g, c, 200, 0.5, mode=mode).select("seg_id", r6("t_start"), r6("t_end"))


@query("random_window_crop", CROP_SQL.format(raster=RASTER_SQL, u=unit_sql("'0'", "clip_id", "trial"), ok="best >= 0.5"), ["segments"])
def _(t):
    return _crop(t, "has_action")


@query("random_window_crop_no_trunc", CROP_SQL.format(raster=RASTER_SQL, u=unit_sql("'0'", "clip_id", "trial"), ok="best >= 0.5 AND cutn = 0"), ["segments"])
def _(t):
    return _crop(t, "no_trunc")


@query(
    "gaps_and_islands",
    f"""WITH {RASTER_SQL}, a AS (SELECT DISTINCT clip_id, t FROM ras),
    i AS (SELECT clip_id, t, t - row_number() OVER (PARTITION BY clip_id ORDER BY t) AS k FROM a)
    SELECT clip_id, min(t) AS start, max(t) + 1 AS "end" FROM i GROUP BY clip_id, k""",
    ["segments"],
)
def _(t):
    on = Q.rasterize(_grid(t)).select("clip_id", "t").distinct().withColumn("active", F.lit(1))
    return Q.gaps_and_islands(on, ["clip_id"])


@query(
    "avg_segment_duration",
    """SELECT round(count(*) / count(*) FILTER (WHERE p IS NULL OR p <> label), 6) AS avg_duration FROM (
        SELECT label, lag(label) OVER (PARTITION BY clip_id ORDER BY seg_id) AS p FROM segments)""",
    ["segments"],
)
def _(t):
    s = t.segments().select("clip_id", "seg_id", "label")
    return Q.avg_segment_duration(s, ["clip_id"], "seg_id").select(r6("avg_duration"))


@query(
    "sample_25",
    """WITH n AS (SELECT video_id, count(DISTINCT t) AS n FROM frame_scores GROUP BY 1 HAVING count(DISTINCT t) > 10)
    SELECT video_id, t, label FROM frame_scores JOIN n USING (video_id)
    WHERE t >= 1 AND (t - 1) % floor(n / 10) = 0 AND (t - 1) / floor(n / 10) < 10""",
    ["frames", "frame_scores"],
)
def _(t):
    return Q.sample_25(t.frame_scores(), n=10).select("video_id", "t", "label")


# ---- token sequences -----------------------------------------------------------------------


def _docs(t):
    return t.raw("documents").select("doc_id", "source", F.split("text", " ").alias("tokens"))


def _shown(df, key="block"):
    return df.select(key, F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("h"))


BLOCK_OUT = "len(tokens) AS n, md5(array_to_string(tokens, ' ')) AS h"


@query(
    "token_blocks_none",
    f"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS tok, generate_subscripts(string_split(text, ' '), 1) AS p FROM documents),
    o AS (SELECT (row_number() OVER (ORDER BY doc_id, p) - 1) // 64 AS block, doc_id, p, tok FROM w),
    b AS (SELECT block, list(tok ORDER BY doc_id, p) AS tokens FROM o GROUP BY 1)
    SELECT block, {BLOCK_OUT} FROM b""",
)
def _(t):
    return _shown(Q.token_blocks(_docs(t), 64, "none"))


COMPLETE_SQL = """WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {ord}) AS rk, source, string_split(text, ' ') AS toks FROM documents),
    run AS (SELECT rk, source, len(toks) AS cur, 0 AS b FROM d WHERE rk = 1
        UNION ALL SELECT d.rk, d.source, CASE WHEN run.cur + len(toks) <= 512 {same} THEN run.cur + len(toks) ELSE len(toks) END,
            CASE WHEN run.cur + len(toks) <= 512 {same} THEN run.b ELSE run.b + 1 END
        FROM run JOIN d ON d.rk = run.rk + 1),
    g AS (SELECT b, flatten(list(toks ORDER BY rk)) AS tokens FROM run JOIN d USING (rk) GROUP BY 1)
    SELECT row_number() OVER (ORDER BY b) - 1 AS block, """ + BLOCK_OUT + " FROM g {having}"


@rec_query("token_blocks_complete", COMPLETE_SQL.format(ord="doc_id", same="", having=""), [])
def _(t):
    return _shown(Q.token_blocks(_docs(t), 512, "complete", chunk_rows=2000))


@rec_query(
    "token_blocks_complete_doc",
    COMPLETE_SQL.format(ord="source, doc_id", same="AND d.source = run.source", having="WHERE len(tokens) > 1"), [],
)
def _(t):
    return _shown(Q.token_blocks(_docs(t), 512, "complete_doc", group="source"))


@query(
    "token_blocks_eos",
    f"""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS block, {BLOCK_OUT}
    FROM (SELECT doc_id, string_split(text, ' ') AS tokens FROM documents)""",
)
def _(t):
    return _shown(Q.token_blocks(_docs(t), 512, "eos"))


@rec_query(
    "pack_pairs",
    """WITH RECURSIVE p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) AS rk, pred, ref,
            len(list_filter(string_split_regex(pred, '\\s+'), lambda x: x <> '')) AS a,
            len(list_filter(string_split_regex(ref, '\\s+'), lambda x: x <> '')) AS b FROM texts),
    run AS (SELECT rk, a, b, rk - 1 AS block FROM p WHERE rk = 1
        UNION ALL SELECT p.rk, CASE WHEN run.a + p.a <= 400 AND run.b + p.b <= 400 THEN run.a + p.a ELSE p.a END,
            CASE WHEN run.a + p.a <= 400 AND run.b + p.b <= 400 THEN run.b + p.b ELSE p.b END,
            CASE WHEN run.a + p.a <= 400 AND run.b + p.b <= 400 THEN run.block ELSE p.rk - 1 END
        FROM run JOIN p ON p.rk = run.rk + 1)
    SELECT block, md5(string_agg(pred, ' ' ORDER BY rk)) AS src, md5(string_agg(ref, ' ' ORDER BY rk)) AS tgt
    FROM run JOIN p USING (rk) GROUP BY 1""",
    ["texts"],
)
def _(t):
    x = t.texts().select("id", F.col("pred").alias("src"), F.col("ref").alias("tgt"))
    return Q.pack_pairs(x, 400).select("block", F.md5("src").alias("src"), F.md5("tgt").alias("tgt"))


@rec_query(
    "batch_by_size",
    """WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, n_chars AS n, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i FROM documents),
    e AS (SELECT a.i, coalesce(min(b.i) - a.i, (SELECT count(*) FROM s) - a.i) AS k FROM s a
        LEFT JOIN s b ON b.i > a.i AND b.i <= a.i + 16 AND (b.n * (b.i - a.i + 1) > 9000 OR b.i - a.i + 1 > 16) GROUP BY a.i),
    nx AS MATERIALIZED (SELECT i, i + CASE WHEN k > 4 THEN k - k % 4 ELSE k END AS j FROM e),
    run AS (SELECT 0::BIGINT AS i UNION ALL SELECT j FROM run JOIN nx ON nx.i = run.i WHERE j < (SELECT count(*) FROM s))
    SELECT doc_id, n, max(run.i) AS batch FROM s JOIN run ON run.i <= s.i GROUP BY 1, 2""",
    [],
)
def _(t):
    d = t.raw("documents").select("doc_id", F.col("n_chars").alias("n"))
    return Q.batch_by_size(d, 9000, 16, 4, "doc_id", "n", chunk_rows=2000)


@query(
    "context_window",
    """WITH b AS (SELECT conv_id, turn, string_split(text, ' ') AS tk FROM conversations),
    s AS (SELECT *, sum(len(tk)) OVER (PARTITION BY conv_id ORDER BY turn) - len(tk) AS st FROM b),
    w AS (SELECT conv_id, unnest(tk) AS tok, st + generate_subscripts(tk, 1) - 1 AS p FROM s),
    pre AS (SELECT s.conv_id, s.turn, list(tok ORDER BY p) AS pr FROM s JOIN w ON w.conv_id = s.conv_id
        AND w.p >= s.st - least(least(5, s.st), greatest(0, 60 - len(s.tk))) AND w.p < s.st GROUP BY 1, 2)
    SELECT s.conv_id, s.turn, coalesce(len(pr), 0) AS start, md5(array_to_string(list_concat(coalesce(pr, []), tk), ' ')) AS h
    FROM s LEFT JOIN pre USING (conv_id, turn)""",
)
def _(t):
    c = t.raw("conversations").select("conv_id", "turn", F.split("text", " ").alias("tokens"))
    out = Q.context_window(c, 5, "conv_id", "turn", "tokens", 60)
    return out.select("conv_id", "turn", "start", F.md5(F.array_join("tokens", " ")).alias("h"))


@query(
    "truncate_tokens",
    "SELECT doc_id, array_to_string(string_split(text, ' ')[1:4], ' ') AS head FROM documents",
)
def _(t):
    return _docs(t).select("doc_id", F.array_join(Q.truncate_tokens(F.col("tokens"), 4), " ").alias("head"))


@query(
    "random_crop_tokens",
    f"""WITH d AS (SELECT doc_id, string_split(text, ' ') AS tk FROM documents),
    s AS (SELECT *, CASE WHEN len(tk) <= 10 THEN 0 ELSE floor({unit_sql("'3'", "doc_id")} * (len(tk) - 10 + 1))::INT END AS st FROM d)
    SELECT doc_id, array_to_string(CASE WHEN len(tk) <= 10 THEN tk ELSE tk[st + 1:st + 10] END, ' ') AS crop FROM s""",
)
def _(t):
    return _docs(t).select(
        "doc_id", F.array_join(Q.random_crop_tokens(F.col("tokens"), 10, 3, F.col("doc_id")), " ").alias("crop")
    )


def _draw12(expr: str) -> str:
    return f"(('0x' || substr(md5({expr}), 1, 12))::BIGINT / 281474976710656e0)"


def _masked_sql(span: int) -> str:
    wider = "".join(f" OR (i > {back} AND hs[i - {back}] <= cut)" for back in range(1, span))
    return f"""WITH d AS (SELECT doc_id, string_split(text, ' ') AS tk, '7:1:' || doc_id AS key,
            least(len(string_split(text, ' ')), floor(0.15::DOUBLE * len(string_split(text, ' ')) / {span}e0 + {unit_sql("'7'", "'1'", "doc_id", "'n'")})::INT) AS cnt FROM documents),
    h AS (SELECT *, list_transform(range(len(tk)), lambda i: md5(key || ':' || i)) AS hs FROM d),
    c AS (SELECT *, CASE WHEN cnt > 0 THEN list_sort(hs)[cnt] END AS cut FROM h)
    SELECT doc_id, md5(array_to_string(list_transform(tk, lambda x, i:
        CASE WHEN cut IS NOT NULL AND (hs[i] <= cut{wider}) THEN
            CASE WHEN {_draw12("key || ':' || (i - 1) || ':u'")} < 0.1 THEN x
                 WHEN {_draw12("key || ':' || (i - 1) || ':u'")} < 0.2
                 THEN ['aa', 'bb', 'cc'][floor({_draw12("key || ':' || (i - 1) || ':v'")} * 3)::INT + 1]
                 ELSE '<mask>' END ELSE x END), ' ')) AS h FROM c"""


def _masked(span: int):
    def run(t):
        out = Q.mask_tokens(_docs(t), "<mask>", 0.15, span, 0.1, 0.1, 7, 1, ["aa", "bb", "cc"], "doc_id", "tokens")
        return out.select("doc_id", F.md5(F.array_join("masked", " ")).alias("h"))

    return run


query("mask_tokens", _masked_sql(2))(_masked(2))
query("mask_tokens_single", _masked_sql(1))(_masked(1))


@query(
    "length_buckets",
    """WITH q AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(n_chars, [0.25, 0.5, 0.75, 1.0]), lambda x: ceil(x)::BIGINT))) AS b FROM documents)
    SELECT doc_id, list_filter(b, lambda x: x >= n_chars)[1] AS pad_to FROM documents, q""",
)
def _(t):
    d = t.raw("documents").select("doc_id", F.col("n_chars").alias("n"))
    return Q.length_buckets(d, 4).select("doc_id", "pad_to")


@query(
    "max_lengths",
    "SELECT id, greatest(len(string_split(pred, ' ')), len(string_split(ref, ' '))) AS max_len FROM texts",
    ["texts"],
)
def _(t):
    return Q.max_lengths(t.texts(), "pred", "ref").select("id", "max_len")


def _chars(t):
    clean = F.translate("text", "0123456789", "##########")
    return t.raw("conversations").select(
        "conv_id", "turn", F.filter(F.split(clean, ""), lambda c: c != "").alias("tokens")
    )


@query(
    "pack_repeats",
    """WITH w AS (SELECT conv_id, turn, unnest(string_split(translate(text, '0123456789', '##########'), '')) AS c,
            generate_subscripts(string_split(translate(text, '0123456789', '##########'), ''), 1) AS p FROM conversations),
    f AS (SELECT *, CASE WHEN lag(c) OVER x = c THEN 0 ELSE 1 END AS n FROM w WINDOW x AS (PARTITION BY conv_id, turn ORDER BY p)),
    g AS (SELECT *, sum(n) OVER (PARTITION BY conv_id, turn ORDER BY p) AS run FROM f),
    k AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, turn, run ORDER BY p) - 1) // 2 AS part FROM g),
    o AS (SELECT conv_id, turn, min(p) AS p, CASE WHEN count(*) = 1 THEN min(c) ELSE min(c) || (count(*) - 1) END AS s FROM k GROUP BY conv_id, turn, run, part)
    SELECT conv_id, turn, md5(string_agg(s, '' ORDER BY p)) AS h FROM o GROUP BY 1, 2""",
)
def _(t):
    return Q.pack_repeats(_chars(t), 1).select("conv_id", "turn", F.md5(F.array_join("tokens", "")).alias("h"))


@query(
    "unpack_repeats",
    "SELECT conv_id, turn, md5(translate(text, '0123456789', '##########')) AS h FROM conversations",
)
def _(t):
    both = Q.unpack_repeats(Q.pack_repeats(_chars(t), 3), 3)
    return both.select("conv_id", "turn", F.md5(F.array_join("tokens", "")).alias("h"))


@query(
    "shift_targets",
    """WITH d AS (SELECT doc_id, list_concat(['<pad>', '</s>'], string_split(text, ' ')) AS f FROM documents)
    SELECT doc_id, md5(array_to_string(f[2:-2], ' ')) AS source, md5(array_to_string(f[3:], ' ')) AS target,
        md5(array_to_string(f[1:-3], ' ')) AS past FROM d""",
)
def _(t):
    out = Q.shift_targets(_docs(t), "<pad>", "</s>")
    return out.select("doc_id", *[F.md5(F.array_join(c, " ")).alias(c) for c in ("source", "target", "past")])
