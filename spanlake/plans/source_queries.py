"""Readers and sinks over files that Spark writes from the given tables to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.plans.annotation_queries import r6
from spanlake.plans.registry import query
from spanlake.plans.sequence_queries import unit_sql
from spanlake.session import scratch_path
from spanlake.sources import readers as R
from spanlake.sources import sinks as K
from spanlake.sources import submission as U


def _file(t, df, stem: str) -> str:
    """The `value` column of df as text files in the shared folder."""
    path = scratch_path(t.spark, stem)
    df.select("value").write.text(path)
    return path


@query(
    "read_annotation_db",
    """SELECT c.clip_id::VARCHAR AS clip_id, subset, label, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end
    FROM clips c LEFT JOIN segments s ON c.clip_id = s.clip_id AND c.subset <> 'test'""",
    ["segments", "clips"],
)
def _(t):
    seg = F.when(
        F.col("subset") != "test",
        F.struct("label", F.lit(0).alias("label_id"), F.array("t_start", "t_end").alias("segment")),
    )
    clips = t.clips().join(t.segments(), "clip_id").groupBy("clip_id", "video_id", "subset", "duration", "fps").agg(F.collect_list(seg).alias("annotations"))
    body = F.create_map(
        F.col("clip_id").cast("string"),
        F.struct(F.col("video_id").cast("string").alias("video_id"), "subset", "duration", "fps", "annotations"),
    )
    out = R.read_annotation_db(t.spark, _file(t, clips.select(F.to_json(body).alias("value")), "db"), lines=True)
    return out.select("clip_id", "subset", "label", r6("t_start"), r6("t_end"))


def _keyed(t) -> str:
    """Clips as {"database": {id: {...}}} documents, one a line; some without duration or rate."""
    seg = F.when(F.col("subset") != "test", F.struct("label", F.lit(0).alias("label_id"), F.array("t_start", "t_end").alias("segment")))
    clips = t.clips().join(t.segments(), "clip_id").groupBy("clip_id", "subset", "duration", "fps").agg(F.array_compact(F.collect_list(seg)).alias("annotations"))
    body = F.struct(
        F.upper("subset").alias("subset"), F.when(F.col("clip_id") % 3 > 0, F.col("duration")).alias("duration"),
        F.when(F.col("clip_id") % 2 > 0, F.col("fps")).alias("fps"), "annotations",
    )
    doc = F.to_json(F.struct(F.create_map(F.col("clip_id").cast("string"), body).alias("database")))
    return _file(t, clips.select(doc.alias("value")), "keyed")


KEYED_SQL = """SELECT c.clip_id::VARCHAR AS clip_id, subset, round(CASE WHEN c.clip_id % 3 > 0 THEN duration ELSE 1e8 END, 6) AS duration, 25.0::DOUBLE AS fps, label,
        round(t_start, 6) AS t_start, round(t_end, 6) AS t_end FROM clips c LEFT JOIN segments s ON c.clip_id = s.clip_id AND c.subset <> 'test'"""


@query("read_keyed_database", KEYED_SQL, ["segments", "clips"])
def _(t):
    out = R.read_keyed_database(t.spark, _keyed(t), 25.0, lines=True)
    return out.select("clip_id", "subset", r6("duration"), "fps", "label", r6("t_start"), r6("t_end"))


@query("dataset_registry", KEYED_SQL, ["segments", "clips"])
def _(t):
    out = R.make_dataset("keyed_database", t.spark, path=_keyed(t), default_fps=25.0, lines=True)
    return out.select("clip_id", "subset", r6("duration"), "fps", "label", r6("t_start"), r6("t_end"))


@query(
    "read_moments_json",
    """SELECT o_custkey::VARCHAR AS video_uid, o_orderkey::VARCHAR AS clip_uid, o_orderkey % 600 AS video_end_frame,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS cpos FROM orders""",
)
def _(t):
    clip = F.struct(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("o"), F.col("o_orderkey").cast("string").alias("clip_uid"),
        F.lit(0.0).alias("video_start_sec"), F.lit(1.0).alias("video_end_sec"), F.lit(0).alias("video_start_frame"),
        (F.col("o_orderkey") % 600).alias("video_end_frame"),
    )
    v = t.raw("orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(clip)), lambda c: c.dropFields("o")).alias("clips"))
    doc = F.to_json(F.struct(F.array(F.struct(F.col("o_custkey").cast("string").alias("video_uid"), "clips")).alias("videos")))
    out = R.read_moments_json(t.spark, [_file(t, v.select(doc.alias("value")), "moments")], lines=True)
    return out.select("video_uid", "clip_uid", "video_end_frame", F.col("cpos").cast("long").alias("cpos"))


@query(
    "read_actions_json",
    "SELECT clip_id::VARCHAR AS clip_id, seg_id % 10 - 1 AS label_id, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end FROM segments",
    ["segments"],
)
def _(t):
    a = t.segments().groupBy("clip_id").agg(F.collect_list(F.array((F.col("seg_id") % 10).cast("double"), "t_start", "t_end")).alias("actions"))
    body = F.create_map(F.col("clip_id").cast("string"), F.struct(F.lit("train").alias("subset"), F.lit(1.0).alias("duration"), "actions"))
    out = R.read_actions_json(t.spark, _file(t, a.select(F.to_json(body).alias("value")), "actions"), 1, lines=True)
    return out.select("clip_id", "label_id", r6("t_start"), r6("t_end"))


@query(
    "read_narrations",
    """SELECT video_uid::VARCHAR AS video_uid, row_number() OVER (PARTITION BY video_uid ORDER BY clip_index) - 1 AS clip_index, verb AS structured_verb
    FROM narrations WHERE verb <> 'system'""",
    ["narrations"],
)
def _(t):
    act = F.struct(
        F.col("clip_index").alias("o"), (F.col("verb") == "system").alias("is_rejected"), F.lit(True).alias("is_valid_action"),
        "narration_text", F.col("verb").alias("structured_verb"),
    )
    v = t.narrations().groupBy("video_uid").agg(F.sort_array(F.collect_list(act)).alias("narrated_actions"))
    doc = F.to_json(F.struct(F.array(F.struct(F.col("video_uid").cast("string").alias("video_uid"), F.array(F.struct("narrated_actions")).alias("annotated_intervals"))).alias("videos")))
    out = R.read_narrations(t.spark, _file(t, v.select(doc.alias("value")), "narr"), lines=True)
    return out.select("video_uid", F.col("clip_index").cast("long").alias("clip_index"), "structured_verb")


@query("read_selected_tsv", "SELECT event_id AS c0, value AS c2, event_type AS c1 FROM events")
def _(t):
    lines = t.raw("events").select(F.concat_ws("\t", F.col("event_id").cast("string"), "event_type", F.col("value").cast("string"), "props").alias("value"))
    return R.read_selected_tsv(t.spark, _file(t, lines, "tsv"), [0, 2, 1], ["long", "double", "string"])


@query(
    "read_embeddings_tsv",
    "SELECT vec_id AS frame_index, unnest(range(len(embedding)))::INT AS pos, round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings",
)
def _(t):
    path = scratch_path(t.spark, "emb")
    t.raw("embeddings").select(F.col("vec_id").alias("frame_index"), F.to_json("embedding").alias("encoder_output")).write.csv(path, sep="\t", header=True)
    out = R.read_embeddings_tsv(t.spark, path)
    return out.select("frame_index", F.posexplode("embedding").alias("pos", "value")).select("frame_index", "pos", r6(F.col("value").cast("double"), "value"))


@query(
    "read_blocked_tokens",
    """SELECT len(tk) AS n, md5(array_to_string(tk, ' ')) AS words, md5(array_to_string(list_transform(tk, lambda w, i: CASE WHEN i % 2 = 1 THEN 'B' ELSE 'O' END), ' ')) AS labels
    FROM (SELECT list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS tk FROM conversations)""",
)
def _(t):
    tk = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = F.transform(tk, lambda w, i: F.when(i % 2 == 0, F.concat(w, F.lit(" B"))).otherwise(w))
    blocks = t.raw("conversations").select(F.concat(F.lit("-DOCSTART-\n"), F.array_join(rows, "\n"), F.lit("\n")).alias("value"))
    out = R.read_blocked_tokens(t.spark, _file(t, blocks, "blocks"))
    return out.select(F.size("words").alias("n"), F.md5(F.array_join("words", " ")).alias("words"), F.md5(F.array_join("labels", " ")).alias("labels"))


@query(
    "read_generation_log",
    """SELECT o_orderkey AS id, 'src ' || o_custkey AS source, 'tgt' AS target, 'h1;h2' AS hypotheses, round(-(o_orderkey % 9) / 10, 6) AS first_prob FROM orders""",
)
def _(t):
    k = F.col("o_orderkey").cast("string")
    lines = t.raw("orders").select(
        F.concat(
            F.lit("S-"), k, F.lit("\tsrc "), F.col("o_custkey").cast("string"), F.lit("\nT-"), k, F.lit("\ttgt\nH-"), k, F.lit("\t-1\tskip\nD-"), k,
            F.lit("\t"), (-(F.col("o_orderkey") % 9) / 10).cast("string"), F.lit("\th1\nD-"), k, F.lit("\t-2.5\th2\nnoise"),
        ).alias("value")
    )
    out = R.read_generation_log(t.spark, _file(t, lines, "gen"))
    return out.select("id", "source", "target", F.array_join("hypotheses", ";").alias("hypotheses"), (F.round(F.col("log_probs")[0], 6) + F.lit(0.0)).alias("first_prob"))


@query(
    "read_json_logs",
    """WITH e AS (SELECT event_id, (user_id % 20)::INT AS epoch, value, CASE WHEN event_type <> 'click' THEN user_id::DOUBLE END AS lr FROM events WHERE event_type <> 'view'),
    m AS (SELECT event_id, epoch, 'loss' AS metric, value FROM e UNION ALL SELECT event_id, epoch, 'lr', lr FROM e WHERE lr IS NOT NULL)
    SELECT epoch, metric, row_number() OVER (PARTITION BY epoch, metric ORDER BY event_id) - 1 AS pos, round(value, 6) AS value FROM m""",
)
def _(t):
    e = t.raw("events").orderBy("event_id")  # the log's order
    body = F.struct(
        F.when(F.col("event_type") != "view", F.col("user_id") % 20).alias("epoch"), F.col("value").alias("loss"),
        F.when(F.col("event_type") != "click", F.col("user_id").cast("double")).alias("lr"),
    )
    return R.read_json_logs(t.spark, _file(t, e.select(F.to_json(body).alias("value")), "logs"), ["loss", "lr"]).select("epoch", "metric", "pos", r6("value"))


@query(
    "read_coco",
    """WITH k AS (SELECT p_partkey, p_size, p_size % 3 AS m, dense_rank() OVER (ORDER BY p_size) - 1 AS category FROM part)
    SELECT p_partkey AS image_id, CASE WHEN m <> 1 THEN category END AS category, CASE WHEN m <> 1 THEN 1 END AS n_poly FROM k""",
)
def _(t):
    good = F.array(*[F.lit(float(i)) for i in range(6)])
    odd = F.array(*[F.lit(float(i)) for i in range(5)])
    polys = F.when(F.col("p_size") % 3 == 1, F.array(odd)).otherwise(F.array(good, odd))
    p = t.raw("part")
    images = F.array(F.struct(F.col("p_partkey").alias("id"), F.lit("f").alias("file_name"), F.lit(1).alias("height"), F.lit(1).alias("width")))
    ann = F.array(F.struct(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("image_id"), F.col("p_size").alias("category_id"), polys.alias("segmentation")))
    cats = F.array(F.struct(F.col("p_size").alias("id"), F.lit("c").alias("name")))
    doc = F.to_json(F.struct(images.alias("images"), ann.alias("annotations"), cats.alias("categories")))
    out = R.read_coco(t.spark, _file(t, p.select(doc.alias("value")), "coco"), lines=True)
    return out.select("image_id", "category", F.when(F.col("polygons").isNotNull(), F.size("polygons")).alias("n_poly"))


def _tracks(t):
    return t.raw("lineitem").select(
        F.concat_ws(
            ",", (F.col("l_orderkey") % 50).cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("string"), F.lit("1.0"),
            F.lit("2.0"), F.lit("3.0"), (F.col("l_linenumber") % 2).cast("string"), (F.col("l_partkey") % 4).cast("string"), F.lit("0.5"),
        ).alias("value")
    )


@query(
    "read_mot",
    """SELECT 'gt' AS mode, (l_orderkey % 50)::INT AS frame, count(*) AS n, round(sum(l_quantity), 4) AS x FROM lineitem WHERE l_orderkey % 50 >= 1 AND l_linenumber % 2 <> 0 AND l_partkey % 4 = 1 GROUP BY 2
    UNION ALL SELECT 'ignore', (l_orderkey % 50)::INT, count(*), round(sum(l_quantity), 4) FROM lineitem WHERE l_orderkey % 50 >= 1 AND l_partkey % 4 IN (0, 2) GROUP BY 2
    UNION ALL SELECT 'result', (l_orderkey % 50)::INT, count(*), round(sum(l_quantity), 4) FROM lineitem WHERE l_orderkey % 50 >= 1 GROUP BY 2""",
)
def _(t):
    path = _file(t, _tracks(t), "mot")
    out = None
    for mode in ("gt", "ignore", "result"):
        m = R.read_mot(t.spark, path, mode).groupBy("frame").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("x")).withColumn("mode", F.lit(mode))
        out = m if out is None else out.unionByName(m)
    return out


@query(
    "read_race",
    """SELECT md5(text) AS context, pos, CASE WHEN pos = 0 THEN 'is b ok' ELSE 'which b' END AS second, CASE WHEN pos = 0 THEN 2 ELSE 3 END AS label
    FROM (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations), (SELECT unnest([0, 1]) AS pos)""",
)
def _(t):
    opts = F.array(*[F.lit(x) for x in "abcd"])
    doc = F.struct(
        F.col("text").alias("article"), F.array(F.lit("C"), F.lit("D")).alias("answers"), F.array(F.lit("is _ ok"), F.lit("which")).alias("questions"),
        F.array(opts, opts).alias("options"),
    )
    out = R.read_race(t.spark, _file(t, t.raw("conversations").select(F.to_json(doc).alias("value")), "race"), lines=True)
    return out.select(F.md5(F.trim("context")).alias("context"), "pos", F.col("choices")[1].alias("second"), "label")


@query(
    "read_xnli",
    """SELECT 'n' || o_custkey AS text_a, o_orderpriority AS text_b, CASE WHEN o_orderstatus = 'F' THEN 'contradiction' ELSE o_orderstatus END AS label FROM orders WHERE o_orderkey % 3 = 0""",
)
def _(t):
    path = scratch_path(t.spark, "xnli")
    t.raw("orders").select(
        F.when(F.col("o_orderkey") % 3 == 0, "fr").otherwise("en").alias("language"),
        F.when(F.col("o_orderstatus") == "F", "contradictory").otherwise(F.col("o_orderstatus")).alias("gold_label"),
        F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("sentence1"), F.col("o_orderpriority").alias("sentence2"),
    ).write.csv(path, sep="\t", header=True)
    return R.read_xnli(t.spark, path, "fr")


@query("read_fasta", "SELECT 'id' || c_custkey || ' x' AS header, c_mktsegment || 'AC' AS sequence FROM customer")
def _(t):
    rec = F.concat(F.lit(">id"), F.col("c_custkey").cast("string"), F.lit(" x\n"), "c_mktsegment", F.lit("\nAC"))
    return R.read_fasta(t.spark, _file(t, t.raw("customer").select(rec.alias("value")), "fasta")).select("header", "sequence")


@query("read_segment_xml", "SELECT c_name AS text FROM customer")
def _(t):
    line = F.concat(F.lit('<doc>\n<seg id="'), F.col("c_custkey").cast("string"), F.lit('"> '), "c_name", F.lit(" </seg>\n</doc>"))
    return R.read_segment_xml(t.spark, _file(t, t.raw("customer").select(line.alias("value")), "xml")).select("text")


@query("read_segment_xml_training", "SELECT c_name AS text FROM customer")
def _(t):
    line = F.concat(F.lit("<url>a</url>\n"), "c_name")
    return R.read_segment_xml(t.spark, _file(t, t.raw("customer").select(line.alias("value")), "xml"), training=True).select("text")


@query(
    "write_tsv",
    "SELECT l_returnflag AS clip_id, l_orderkey, l_linenumber, l_quantity FROM lineitem",
)
def _(t):
    path = scratch_path(t.spark, "out-tsv")
    K.write_tsv(t.raw("lineitem").select(F.col("l_returnflag").alias("clip_id"), "l_orderkey", "l_linenumber", "l_quantity"), path)
    return t.spark.read.csv(path, sep="\t", header=True, schema="l_orderkey long, l_linenumber int, l_quantity double, clip_id string")


@query("write_csv", "SELECT c_custkey, c_name FROM customer")
def _(t):
    path = scratch_path(t.spark, "out-csv")
    K.write_csv(t.raw("customer").select("c_custkey", "c_name"), path)
    return t.spark.read.csv(path, header=True, schema="c_custkey long, c_name string")


@query(
    "write_submission",
    """SELECT r AS results, clip_id::VARCHAR AS clip_id, label, round(score, 6) AS score, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end
    FROM predictions, (VALUES ('detect_results'), ('retrieve_results')) v(r)""",
    ["segments", "predictions"],
)
def _(t):
    path = f"{scratch_path(t.spark, 'submission')}.json"
    U.write_submission(t.predictions(), path)
    return U.read_submission(t.spark, path).select("results", "clip_id", "label", r6("score"), r6("t_start"), r6("t_end"))


@query(
    "write_label_lines",
    "SELECT 'clips/' || user_id || '/' || event_id || ' ' || event_type AS value FROM events WHERE user_id % 4 < 2",
)
def _(t):
    s = t.segments().select("clip_id", F.col("seg_id").alias("frame_index"), "label")
    name = F.concat(F.lit("clips/"), F.col("clip_id").cast("string"), F.lit("/"), F.col("frame_index").cast("string"))
    frames = s.join(t.clips().select("clip_id", "subset"), "clip_id").select("clip_id", "frame_index", "subset", name.alias("path"))
    out = scratch_path(t.spark, "labels")
    K.write_label_lines(frames, s, "train", out)
    return t.spark.read.text(out)


@query("pack_files", "SELECT l_returnflag AS name, count(*) AS n, sum(l_linenumber) AS total FROM lineitem GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "pack")
    t.raw("lineitem").select("l_returnflag", F.col("l_linenumber").cast("string").alias("v")).write.partitionBy("l_returnflag").text(path)
    lines = R.pack_files(t.spark, path).select(
        F.regexp_extract("name", r"l_returnflag=(\w)", 1).alias("name"), F.filter(F.split("content", "\n"), lambda s: s != "").alias("l")
    )
    return lines.groupBy("name").agg(
        F.sum(F.size("l")).alias("n"), F.sum(F.aggregate("l", F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))).alias("total")
    )


@query(
    "build_manifest",
    f"""SELECT p_name || '/' || p_partkey || '.wav' AS path, p_size AS size, CASE WHEN {unit_sql("'0'", "p_name || '/' || p_partkey || '.wav'")} > 0.2 THEN 'train' ELSE 'valid' END AS split
    FROM part WHERE contains(p_name || '/' || p_partkey || '.wav', '1')""",
)
def _(t):
    f = t.raw("part").select(F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".wav")).alias("path"), F.col("p_size").alias("size"))
    return R.build_manifest(f, 0.2, 0, "1")


@query("resume_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return R.resume_pending(t.raw("documents").select("doc_id"), t.raw("labels"), "doc_id")
