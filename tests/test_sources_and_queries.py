"""Readers on small files, sinks, and registered queries against their SQL."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_oracle import TABLES, key, same
from spanlake.operators import joins as J
from spanlake.plans.binned import overlap_join
from spanlake.sources import readers as R
from spanlake.sources import submission as U


def test_annotation_db_document(spark, tmp_path):
    db = {
        "c1": {"video_id": "v", "clip_id": "c1", "subset": "train", "duration": 9.0, "fps": 30.0,
               "annotations": [{"label": "a", "label_id": 1, "segment": [0.5, 2.0]}, {"label": "b", "label_id": 2, "segment": [1.0, 3.0]}]},
        "c2": {"video_id": "v", "clip_id": "c2", "subset": "test", "duration": 5.0, "fps": 30.0, "annotations": []},
    }
    (tmp_path / "db.json").write_text(json.dumps(db, indent=1))
    rows = R.read_annotation_db(spark, str(tmp_path / "db.json")).orderBy("clip_id", "label").collect()
    assert [(r.clip_id, r.label, r.t_start, r.t_end) for r in rows] == [("c1", "a", 0.5, 2.0), ("c1", "b", 1.0, 3.0), ("c2", None, None, None)]


def test_keyed_database_defaults(spark):
    doc = json.dumps({"database": {"x": {"subset": "Val", "annotations": []}}})
    df = spark.createDataFrame([("f", doc)], "file string, value string")
    r = R.parse_keyed_database(df, 25).first()
    assert (r.subset, r.duration, r.fps) == ("val", 1e8, 25.0)
    with pytest.raises(Exception, match="unknown fps"):
        R.parse_keyed_database(df).collect()


def test_blocked_tokens_keep_file_order(spark, tmp_path):
    text = "-DOCSTART- X O\n\nEU B-ORG\nrejects O\n\n\nPeter\nB I-PER\n"
    (tmp_path / "a.txt").write_text(text)
    rows = R.read_blocked_tokens(spark, str(tmp_path / "a.txt")).orderBy(*R.LINE_ORDER, "part").collect()
    assert [(r.words, r.labels) for r in rows] == [(["EU", "rejects"], ["B-ORG", "O"]), (["Peter", "B"], ["O", "I-PER"])]


def test_lines_keep_order_over_splits(spark, tmp_path):
    lines = [f"line {i}" for i in range(5000)]
    (tmp_path / "l.txt").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = R.read_lines(spark, str(tmp_path / "l.txt"))
        assert df.rdd.getNumPartitions() > 1
        assert [r.value for r in df.orderBy(*R.LINE_ORDER).collect()] == lines
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fasta_and_tracks(spark, tmp_path):
    (tmp_path / "p.fa").write_text(">s1 x\nAC\nGT\n>s2\nTT\n")
    got = {r.header: r.sequence for r in R.read_fasta(spark, str(tmp_path / "p.fa")).collect()}
    assert got == {"s1 x": "ACGT", "s2": "TT"}
    (tmp_path / "m.txt").write_text("1,7,1,2,3,4,1,1,0.5\n0,7,1,2,3,4,1,1,0.5\n2,8,1,2,3,4,0,1,1\n3,9,1,2,3,4,1,8,1\n4,1,1\n")
    ids = {m: sorted(r.id for r in R.read_mot(spark, str(tmp_path / "m.txt"), m).collect()) for m in ("gt", "ignore", "result")}
    assert ids == {"gt": [7], "ignore": [9], "result": [7, 8, 9]}


PRED = "clip_id string, pred_id long, label string, t_start double, t_end double, score double"


def nested(rows):
    out = {}
    for c, i, label, a, b, s in sorted(rows, key=lambda r: (-r[5], r[1])):
        out.setdefault(c, []).append({"label": label, "score": s, "segment": [a, b]})
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_submission_is_one_nested_object(spark, tmp_path, partitions):
    odd = 'c"1]: [\\ é\n'
    rows = [(odd, i, "a", float(i), i + 1.0, i / 50) for i in range(50)] + [("2", 100, 'b", {', 0.0, 1.0, 0.5), ("{", 101, "}", 0.0, 1.0, 0.5)]
    other = [("2", 7, "r", 1.0, 2.0, 0.25)]
    path = str(tmp_path / "s.json")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        U.write_submission(spark.createDataFrame(rows, PRED), path, spark.createDataFrame(other, PRED), challenge="x")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    doc = json.loads((tmp_path / "s.json").read_text())
    assert doc == {"version": "1.0", "challenge": "x", "detect_results": nested(rows), "retrieve_results": nested(other)}
    back = {(r.results, r.clip_id, r.label, r.t_start, r.t_end, r.score) for r in U.read_submission(spark, path).collect()}
    assert back == {("detect_results", c, x, a, b, s) for c, _, x, a, b, s in rows} | {("retrieve_results", c, x, a, b, s) for c, _, x, a, b, s in other}
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["s.json"]


def test_submission_without_rows_or_without_one_section(spark, tmp_path):
    none = spark.createDataFrame([], PRED)
    one = [("1", 1, None, 0.0, 1.0, 0.5)]
    for name, detect, retrieve in (("a", none, None), ("b", none, spark.createDataFrame(one, PRED)), ("c", spark.createDataFrame(one, PRED), none)):
        U.write_submission(detect, str(tmp_path / name), retrieve)
        doc = json.loads((tmp_path / name).read_text())
        assert (doc["detect_results"], doc["retrieve_results"]) == (nested(one) if name == "c" else {}, nested(one) if name == "b" else {})


@pytest.mark.parametrize("split", [120, 1000, 1 << 27])
def test_submission_is_read_split_by_split_and_never_sorted(spark, tmp_path, split):
    rows = [(str(i % 3), i, "a" if i % 7 else None, float(i), i + 1.0, float("nan") if i == 5 else i / 200) for i in range(200)]
    for name in ("a.json", "b.json"):  # with large splits one task reads both files
        U.write_submission(spark.createDataFrame(rows, PRED), str(tmp_path / name))
    sizes = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        back = U.read_submission(spark, str(tmp_path))
        plan = back._jdf.queryExecution().executedPlan().toString()
        got = sorted(repr(tuple(r)) for r in back.collect())
    finally:
        for k in sizes:
            spark.conf.unset(k)
    # two scans of the text; only the ends of splits, one row each, are shuffled
    assert plan.count("FileScan text") == 2 and plan.count("Exchange hashpartitioning") == 1 and "ExistingRDD" not in plan and "rangepartitioning" not in plan
    want = [(s, c, x, v, a, b) for c, _, x, a, b, v in rows for s in ("detect_results", "retrieve_results")] * 2
    assert got == sorted(repr(r) for r in want)


def test_detections_have_one_shape_at_every_size(spark):
    frames = spark.range(5).withColumnRenamed("id", "frame_id")
    boxes = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id") % 4).cast("long").alias("frame_id"), F.col("id").alias("det_id"), F.lit("x").alias("label"))
    for rows in (1, 7, 10_000):
        got = {}
        for r in J.attach_detections(frames, boxes, rows).orderBy("frame_id", "part").collect():
            assert len(r.detections) <= rows and r.part == len(got.setdefault(r.frame_id, [])) // rows
            got[r.frame_id] += [d.det_id for d in r.detections]
        assert got == {k: [i for i in range(1000) if (0 if i < 900 else i % 4) == k] for k in range(5)}


def test_strict_lookup_reports_missing(spark):
    a = spark.createDataFrame([("x",), ("y",)], "frame_path string")
    with pytest.raises(KeyError):
        J.enrich_actions(a, a.where("frame_path = 'x'").withColumn("v", F.lit(1)), strict=True)


@pytest.mark.parametrize("width", [0.3, 2.0, 50.0])
def test_overlap_join_widths(spark, width):
    a = [(1, i, i * 0.7, i * 0.7 + 1 + (i % 5)) for i in range(60)]
    df = spark.createDataFrame(a, "clip_id int, seg_id long, t_start double, t_end double")
    got = {(r.a_seg_id, r.b_seg_id) for r in overlap_join(df, df, ["clip_id"], width).collect()}
    assert got == {(x[1], y[1]) for x in a for y in a if x[2] < y[3] and y[2] < x[3]}
    touching = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 1.0, 2.0)], df.schema)
    assert overlap_join(touching, touching, ["clip_id"], width).where("a_seg_id <> b_seg_id").count() == 0


def test_registry_is_consistent(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150
    assert entry.entry(spark).count() == 10


SAMPLE = [
    "overlap_stats", "conditional_metrics_past", "detection_map", "soft_nms", "build_prompt", "random_window_crop", "mask_tokens",
    "corpus_bleu", "resample", "in_context_samples", "write_submission", "stream_islands",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=key)
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    pos = [names.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in pos) for r in res.fetchall()), key=key)
    assert len(got) == len(want)
    assert all(same(x, y) for g, w in zip(got, want) for x, y in zip(g, w))


def test_ignored_rows_of_the_older_track_format(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1,7,1,2,3,4,1,-1,-1,-1\n2,8,1,2,3,4,8,-1,-1,-1\n3,9,1,2,3,4,12\n")
    assert sorted(r.id for r in R.read_mot(spark, str(tmp_path / "m.txt"), "ignore", False).collect()) == [8, 9]
