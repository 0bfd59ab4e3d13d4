"""Readers for annotation, detection, text and log formats.

Every reader is a parse function over a DataFrame of documents or lines plus a thin read function
that scans the files. A JSON document is one row, so a large database is best kept as many
documents (a folder of files, or one map per line); lines of a plain file are split by Spark.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.plans.scan import global_index, keyed_index

# ---- files as rows ---------------------------------------------------------------------------


def read_documents(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    """(file, value): one row per file, or per line when each line is a document of its own."""
    df = spark.read.text(path, wholetext=not lines)
    return df.select(F.col("_metadata.file_path").alias("file"), "value")


def read_lines(spark: SparkSession, path, sep: str | None = None) -> DataFrame:
    """(file, block, seq, value): lines with a position that orders them within a file.

    A file may be split over tasks: the byte offset of the split, then the running id inside the
    task, give the order without gathering the file.
    """
    reader = spark.read.option("lineSep", sep) if sep else spark.read
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), "value",
    )


LINE_ORDER = ("file", "block", "seq")


# ---- annotation databases ----------------------------------------------------------------------

CLIP = (
    "video_id string, clip_id string, subset string, duration double, fps double, parent_start_sec double, "
    "parent_end_sec double, v_duration double, annotations array<struct<label string, label_id int, segment array<double>>>"
)


def parse_annotation_db(docs: DataFrame) -> DataFrame:
    """One row per (clip, annotation) of clip-keyed JSON maps; a clip without annotations gives one row of nulls."""
    m = docs.select(F.explode(F.from_json("value", f"map<string, struct<{_ddl(CLIP)}>>")).alias("clip_id", "c"))
    return m.select(
        "clip_id", "c.video_id", "c.subset", "c.duration", "c.fps", "c.parent_start_sec", "c.parent_end_sec", "c.v_duration",
        F.explode_outer("c.annotations").alias("a"),
    ).select(
        "clip_id", "video_id", "subset", "duration", "fps", "parent_start_sec", "parent_end_sec", "v_duration",
        F.col("a.label").alias("label"), F.col("a.label_id").alias("label_id"),
        F.col("a.segment")[0].alias("t_start"), F.col("a.segment")[1].alias("t_end"),
    )


def _ddl(fields: str) -> str:
    """Column list as struct fields: name: type."""
    out, depth, word = [], 0, ""
    for ch in fields + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = word.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            word = ""
        else:
            word += ch
    return ", ".join(out)


def read_annotation_db(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    return parse_annotation_db(read_documents(spark, path, lines))


def parse_keyed_database(docs: DataFrame, default_fps: float | None = None) -> DataFrame:
    """{"database": {id: {...}}} documents; a missing duration is 1e8, fps is the default, else the value, else an error."""
    kind = f"struct<database: map<string, struct<{_ddl(CLIP)}>>>"
    m = docs.select(F.explode(F.from_json("value", kind)["database"]).alias("clip_id", "c"))
    fps = F.lit(float(default_fps)) if default_fps else F.coalesce("c.fps", F.raise_error(F.lit("unknown fps")).cast("double"))
    return m.select(
        "clip_id", F.lower("c.subset").alias("subset"), F.coalesce("c.duration", F.lit(1e8)).alias("duration"), fps.alias("fps"),
        F.explode_outer("c.annotations").alias("a"),
    ).select(
        "clip_id", "subset", "duration", "fps", F.col("a.label").alias("label"), F.col("a.label_id").alias("label_id"),
        F.col("a.segment")[0].alias("t_start"), F.col("a.segment")[1].alias("t_end"),
    )


def read_keyed_database(spark: SparkSession, path, default_fps: float | None = None, lines: bool = False) -> DataFrame:
    return parse_keyed_database(read_documents(spark, path, lines), default_fps)


MOMENTS = (
    "videos array<struct<video_uid: string, clips: array<struct<clip_uid: string, video_start_sec: double, "
    "video_end_sec: double, video_start_frame: long, video_end_frame: long>>>>"
)


def parse_moments(docs: DataFrame) -> DataFrame:
    """(file, video_uid, clip_uid, times, frames, position) of nested video documents, in document order."""
    v = docs.select("file", F.posexplode("videos").alias("vpos", "v"))
    return v.select("file", "vpos", "v.video_uid", F.posexplode("v.clips").alias("cpos", "c")).select(
        "file", "vpos", "cpos", "video_uid", "c.*"
    )


def read_moments_json(spark: SparkSession, paths: list, lines: bool = False) -> DataFrame:
    """Clips of several split documents, with the number of the document they come from."""
    parts = []
    for i, p in enumerate(paths):
        d = spark.read.schema(MOMENTS).json(p, multiLine=not lines).withColumn("file", F.lit(i))
        parts.append(parse_moments(d))
    return reduce(DataFrame.unionByName, parts)


def parse_actions(docs: DataFrame, label_offset: int = 0) -> DataFrame:
    """(clip_id, subset, duration, label_id, t_start, t_end) from maps with actions [label, start, end]."""
    kind = "map<string, struct<subset: string, duration: double, actions: array<array<double>>>>"
    m = docs.select(F.explode(F.from_json("value", kind)).alias("clip_id", "c"))
    return m.select("clip_id", "c.subset", "c.duration", F.explode("c.actions").alias("a")).select(
        "clip_id", "subset", "duration", (F.element_at("a", 1).cast("int") - label_offset).alias("label_id"),
        F.element_at("a", 2).alias("t_start"), F.element_at("a", 3).alias("t_end"),
    )


def read_actions_json(spark: SparkSession, path, label_offset: int = 0, lines: bool = False) -> DataFrame:
    return parse_actions(read_documents(spark, path, lines), label_offset)


NARRATIONS = (
    "videos array<struct<video_uid: string, annotated_intervals: array<struct<narrated_actions: array<struct<"
    "is_rejected: boolean, is_valid_action: boolean, narration_text: string, narration_timestamp_sec: double, "
    "structured_verb: string, frames: array<struct<frame_type: string, boxes: array<struct<object_type: string, "
    "structured_noun: string>>>>>>>>>>"
)


def parse_narrations(docs: DataFrame) -> DataFrame:
    """Accepted camera-wearer actions of nested videos; clip_index is the position among them in one video."""
    v = docs.select(F.explode("videos").alias("v"))
    every = F.flatten(F.transform(F.coalesce("v.annotated_intervals", F.array()), lambda i: F.coalesce(i["narrated_actions"], F.array())))
    kept = F.filter(
        every,
        lambda a: ~a["is_rejected"] & a["is_valid_action"] & a["narration_text"].rlike(r"(?i)^#C C"),
    )
    return v.select("v.video_uid", F.posexplode(kept).alias("clip_index", "a")).select("video_uid", "clip_index", "a.*")


def read_narrations(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    return parse_narrations(spark.read.schema(NARRATIONS).json(path, multiLine=not lines))


# ---- tables in text files ------------------------------------------------------------------------


def read_selected_tsv(spark: SparkSession, path, col_ids: list[int], dtypes: list[str], sep: str = "\t") -> DataFrame:
    """Chosen columns by position, cast to the given types; Spark splits the file evenly over tasks."""
    parts = F.split("value", F.lit(_literal(sep)))
    return spark.read.text(path).select(
        *[parts[c].cast(t).alias(f"c{c}") for c, t in zip(col_ids, dtypes)]
    )


def _literal(sep: str) -> str:
    return "\\Q" + sep + "\\E"


def read_embeddings_tsv(spark: SparkSession, path, sep: str = "\t") -> DataFrame:
    """(frame_index, embedding) from a table whose vectors are written as list literals."""
    raw = spark.read.csv(path, sep=sep, header=True, schema="frame_index long, encoder_output string")
    return raw.select("frame_index", F.from_json("encoder_output", "array<float>").alias("embedding"))


def parse_blocked_tokens(blocks: DataFrame) -> DataFrame:
    """(file, block, seq, part, words, labels) from blocks of "word ... label" lines.

    Blocks are cut at empty lines by the scan itself; a -DOCSTART- line inside a block ends an
    example as well. A line without label gets O.
    """
    lines = F.filter(F.split("value", "\r?\n"), lambda s: s != "")
    # document marks become cuts of the same block
    marked = F.array_join(F.transform(lines, lambda s: F.when(s.startswith("-DOCSTART-"), F.lit("\x01")).otherwise(s)), "\n")
    parts = blocks.select("file", "block", "seq", F.posexplode(F.split(marked, "\x01")).alias("part", "p"))
    rows = parts.withColumn("l", F.filter(F.split("p", "\n"), lambda s: s != "")).where(F.size("l") > 0)
    cols = F.transform("l", lambda s: F.split(s, " "))
    return rows.select(
        "file", "block", "seq", "part", F.transform(cols, lambda c: c[0]).alias("words"),
        F.transform(cols, lambda c: F.when(F.size(c) > 1, F.element_at(c, -1)).otherwise("O")).alias("labels"),
    )


def read_blocked_tokens(spark: SparkSession, path) -> DataFrame:
    return parse_blocked_tokens(read_lines(spark, path, "\n\n"))


def parse_generation_log(lines: DataFrame, tag: str = "D") -> DataFrame:
    """(id, source, target, hypotheses, log_probs) from S-, T- and hypothesis lines, hypotheses in file order."""
    t = lines.select(
        *[c for c in LINE_ORDER if c in lines.columns], F.regexp_extract("value", r"^([STHD])-\d+\t", 1).alias("tag"),
        F.regexp_extract("value", r"^[STHD]-(\d+)\t", 1).alias("id"), F.split("value", "\t").alias("f"),
    ).where(F.col("tag").isin("S", "T", tag))
    place = [F.col(c) for c in LINE_ORDER if c in lines.columns]
    hyp = F.when(F.col("tag") == tag, F.struct(*place, F.col("f")[2].alias("h"), F.col("f")[1].cast("double").alias("p")))
    g = t.groupBy(F.col("id").cast("long").alias("id")).agg(
        F.max(F.when(F.col("tag") == "S", F.col("f")[1])).alias("source"),
        F.max(F.when(F.col("tag") == "T", F.col("f")[1])).alias("target"),
        F.sort_array(F.collect_list(hyp)).alias("l"),
    )
    return g.select("id", "source", "target", F.transform("l", lambda x: x["h"]).alias("hypotheses"), F.transform("l", lambda x: x["p"]).alias("log_probs"))


def read_generation_log(spark: SparkSession, path, tag: str = "D") -> DataFrame:
    return parse_generation_log(read_lines(spark, path), tag)


def parse_json_logs(logs: DataFrame, metrics: list[str]) -> DataFrame:
    """(epoch, metric, pos, value): the values of each metric in log order, pos from 0; lines without epoch drop, nulls have no place."""
    place = [c for c in LINE_ORDER if c in logs.columns]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")
    rows = logs.where("epoch IS NOT NULL").select("epoch", *place, each).select("epoch", *place, "m.metric", "m.value").where("value IS NOT NULL")
    return keyed_index(rows, ["epoch", "metric"], [F.col(c) for c in place], "pos").select("epoch", "metric", "pos", "value")


def read_json_logs(spark: SparkSession, path, metrics: list[str]) -> DataFrame:
    fields = ", ".join(["epoch int", *[f"{m} double" for m in metrics]])
    rows = read_lines(spark, path).withColumn("j", F.from_json("value", fields))
    return parse_json_logs(rows.select(*LINE_ORDER, "j.*"), metrics)


COCO = (
    "images array<struct<id: long, file_name: string, height: int, width: int>>, "
    "annotations array<struct<id: long, image_id: long, category_id: int, iscrowd: int, bbox: array<double>, segmentation: array<array<double>>>>, "
    "categories array<struct<id: int, name: string>>"
)


def parse_coco(docs: DataFrame) -> DataFrame:
    """One row per kept instance (and per image without any) with a contiguous category number.

    Polygons with an odd number of or fewer than six coordinates drop, and with them an instance that
    has none left; instances without polygons stay.
    """
    images = docs.select(F.explode("images").alias("i")).select(
        F.col("i.id").alias("image_id"), "i.file_name", "i.height", "i.width"
    )
    ann = docs.select(F.explode("annotations").alias("a")).select(
        F.col("a.id").alias("ann_id"), "a.image_id", "a.category_id", "a.iscrowd", "a.bbox", "a.segmentation"
    )
    valid = F.filter("segmentation", lambda p: (F.size(p) % 2 == 0) & (F.size(p) >= 6))
    kept = ann.withColumn("polygons", valid).where(F.col("segmentation").isNull() | (F.size("polygons") > 0)).drop("segmentation")
    cats = docs.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id")).distinct()
    ids = global_index(cats, [F.col("category_id")], "category")
    return images.join(kept.join(ids, "category_id"), "image_id", "left").drop("category_id")


def read_coco(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    return parse_coco(spark.read.schema(COCO).json(path, multiLine=not lines))


# fixed values: classes of the tracking format
VALID_CLASSES = (1,)
IGNORED_CLASSES = (0, 2, 7, 8, 12)


def parse_mot(lines: DataFrame, mode: str = "result", labelled: bool = True) -> DataFrame:
    """(frame, id, x, y, w, h, score) from comma-separated tracks; lines with fewer than 7 fields or frame < 1 drop.

    gt keeps marked rows of valid classes, ignore keeps rows of ignored classes or negative
    visibility, result keeps every row with its score. labelled says whether mark, class and visibility have columns of
    their own; without, the seventh column is the class of an ignored row and gt keeps every row.
    """
    f = F.split("value", ",")
    d = lines.select(f.alias("f")).where(F.size("f") >= 7).where(F.col("f")[0].cast("int") >= 1)
    label = F.get("f", F.lit(7)).cast("double").cast("int")
    score = F.lit(1.0)
    if mode == "gt":
        if labelled:
            d = d.where((F.col("f")[6].cast("double").cast("int") != 0) & label.isin(*VALID_CLASSES))
    elif mode == "ignore":
        if not labelled:
            d = d.where(F.col("f")[6].cast("double").cast("int").isin(*IGNORED_CLASSES))
        else:
            d = d.where(label.isin(*IGNORED_CLASSES) | (F.get("f", F.lit(8)).cast("double") < 0))
    elif mode == "result":
        score = F.col("f")[6].cast("double")
    else:
        raise ValueError(f"unknown mode {mode}")
    num = [F.col("f")[i].cast("double").alias(n) for i, n in enumerate(("x", "y", "w", "h"), 2)]
    return d.select(F.col("f")[0].cast("int").alias("frame"), F.col("f")[1].cast("int").alias("id"), *num, score.alias("score"))


def read_mot(spark: SparkSession, path, mode: str = "result", labelled: bool = True) -> DataFrame:
    return parse_mot(spark.read.text(path), mode, labelled)


PASSAGE = "article string, answers array<string>, questions array<string>, options array<array<string>>"


def parse_passages(docs: DataFrame) -> DataFrame:
    """One row per question: the passage, four question + option texts and the number of the right option."""
    gap = r"(?U)\s+"
    z = docs.select(
        F.regexp_replace("article", gap, " ").alias("context"),
        F.posexplode(F.arrays_zip("questions", "options", "answers")).alias("pos", "z"),
    )
    q = F.col("z.questions")

    def merged(option: Column) -> Column:
        text = F.when(q.contains("_"), F.replace(q, F.lit("_"), option)).otherwise(F.concat(q, F.lit(" "), option))
        return F.regexp_replace(text, gap, " ")

    return z.select("context", "pos", F.transform(F.slice("z.options", 1, 4), merged).alias("choices"), (F.ascii("z.answers") - F.lit(65)).alias("label"))


def read_race(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    return parse_passages(spark.read.schema(PASSAGE).json(path, multiLine=not lines))


def parse_xnli(rows: DataFrame, lang: str | None = None) -> DataFrame:
    """(text_a, text_b, label) from train rows (premise, hypo, label) or test rows, which are filtered by language."""
    if lang is not None:
        rows = rows.where(F.col("language") == lang)
    label = F.when(F.col("label") == "contradictory", "contradiction").otherwise(F.col("label"))
    return rows.select(F.col("premise").alias("text_a"), F.col("hypo").alias("text_b"), label.alias("label"))


def read_xnli(spark: SparkSession, path, lang: str | None = None) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", header=True, quote="", escape="")
    if lang is None:
        return parse_xnli(raw)
    names = {"sentence1": "premise", "sentence2": "hypo", "gold_label": "label"}
    return parse_xnli(raw.withColumnsRenamed(names), lang)


def parse_fasta(records: DataFrame) -> DataFrame:
    """(file, header, sequence) from records cut at line starts with ">"."""
    lines = F.split(F.regexp_replace("value", r"^>", ""), "\r?\n")
    return records.where(F.trim("value") != "").select(
        "file", "block", "seq", lines[0].alias("header"), F.array_join(F.slice(lines, 2, F.size(lines)), "").alias("sequence")
    )


def read_fasta(spark: SparkSession, path) -> DataFrame:
    return parse_fasta(read_lines(spark, path, "\n>"))


def parse_segment_xml(lines: DataFrame, training: bool = False) -> DataFrame:
    """Text of <seg ...> lines; of training files every line that opens no tag."""
    s = F.trim("value")
    if training:
        return lines.where(~s.startswith("<")).withColumn("text", s).drop("value")
    return lines.where(s.startswith("<seg")).withColumn("text", F.trim(F.regexp_extract(s, r"^<seg[^>]*>([^<]*)", 1))).drop("value")


def read_segment_xml(spark: SparkSession, path, training: bool = False) -> DataFrame:
    return parse_segment_xml(read_lines(spark, path), training)


# ---- many files ----------------------------------------------------------------------------------


def pack_files(spark: SparkSession, path) -> DataFrame:
    """(name, content) of many small text files as one keyed table."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("name"), F.col("value").alias("content"))


def list_files(spark: SparkSession, path, pattern: str = "*") -> DataFrame:
    """(path, size) of files; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
        .select("path", F.col("length").alias("size"))
    )


def build_manifest(files: DataFrame, valid_fraction: float = 0.01, seed=0, must_contain: str | None = None) -> DataFrame:
    """(path, size, split): seeded train and valid rows of a file listing."""
    from spanlake.plans.scan import draw_unit

    kept = files.where(F.col("path").contains(must_contain)) if must_contain else files
    return kept.select("path", "size", F.when(draw_unit(seed, F.col("path")) > valid_fraction, "train").otherwise("valid").alias("split"))


def resume_pending(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs without output."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


# ---- registry --------------------------------------------------------------------------------------

DATASETS: dict = {}


def register_dataset(name: str):
    """Register a loader (spark, **options) -> DataFrame."""

    def wrap(fn):
        if name in DATASETS:
            raise ValueError(f"data set {name} is registered already")
        DATASETS[name] = fn
        return fn

    return wrap


def make_dataset(name: str, spark: SparkSession, **options) -> DataFrame:
    return DATASETS[name](spark, **options)


register_dataset("annotation_db")(read_annotation_db)
register_dataset("actions_json")(read_actions_json)
register_dataset("coco")(read_coco)
register_dataset("keyed_database")(read_keyed_database)
