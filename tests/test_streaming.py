"""Streaming operators: late rows, replayed batches, exact states."""

import random

from pyspark.sql import functions as F

from spanlake.operators import retrieval as R
from spanlake.streaming import operators as ST


def scored(spark, rows):
    return spark.createDataFrame(rows, "video_id int, t long, label int, score double, target int")


def test_ap_from_states_equals_average_precision(spark, tmp_path):
    rnd = random.Random(1)
    scores = rnd.sample(range(-50_000, 50_000), 6000)  # distinct, outside [0, 1], closer than any bin
    rows = [(0, i, i % 3, s / 7e5 + (3 if s % 5 else -2), int(rnd.random() < 0.3)) for i, s in enumerate(scores)]
    write = ST.partial_writer(str(tmp_path / "ap"), ST.score_state)
    for n in range(4):
        write(scored(spark, rows[n::4]), n)
    write(scored(spark, rows[2::4]), 2)  # a batch that is repeated after a failure
    state = ST.read_partials(spark, str(tmp_path / "ap"), ST.SCORE_STATE)
    got = {r.label: r.ap for r in ST.ap_from_state(state).collect()}
    want = {r.label: r.ap for r in R.average_precision(scored(spark, rows)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_ties_nulls_and_empty_batches(spark, tmp_path):
    rows = [(0, 0, 1, 0.5, 1), (0, 1, 1, 0.5, 0), (0, 2, 1, None, 1), (0, 3, None, 0.1, 1), (0, 4, 2, 0.9, 0)]
    write = ST.partial_writer(str(tmp_path / "ap"), ST.score_state)
    write(scored(spark, rows), 0)
    write(scored(spark, []), 1)
    got = {r.label: r.ap for r in ST.ap_from_state(ST.read_partials(spark, str(tmp_path / "ap"), ST.SCORE_STATE)).collect()}
    assert got == {1: 0.5, 2: 0.0}


def test_ap_keeps_a_million_distinct_scores_apart(spark, tmp_path):
    rows = spark.range(1_000_000).select(
        F.lit(0).alias("video_id"), F.col("id").alias("t"), F.lit(1).alias("label"), (F.col("id") / 1e9).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("target")
    )
    write = ST.partial_writer(str(tmp_path / "ap"), ST.score_state)
    write(rows.where("id % 2 = 0"), 0)
    write(rows.where("id % 2 = 1"), 1)
    got = ST.ap_from_state(ST.read_partials(spark, str(tmp_path / "ap"), ST.SCORE_STATE)).first().ap
    assert abs(got - R.average_precision(rows).first().ap) < 1e-9


def test_late_rows_are_dropped_and_replays_replace(spark, tmp_path):
    source, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    at = lambda hour, value: (hour * 3600, value)
    parts = [[at(0, 1.0), at(1, 2.0)], [at(30, 5.0)], [at(2, 100.0), at(31, 7.0)]]  # hour 2 comes when its day is closed
    emitted = []

    def write(batch, n):
        for _ in range(2):  # every batch is written twice
            ST.partial_writer(out)(batch, n)
        emitted.append(n)

    for rows in parts:
        spark.createDataFrame(rows, "s long, value double").select(F.timestamp_seconds("s").alias("ts"), "value").write.mode("append").parquet(source)
        stream = spark.readStream.schema("ts timestamp, value double").parquet(source)
        plan = ST.stream_meters(stream, "ts", "value", None, "1 day", watermark="1 hour")
        plan.writeStream.outputMode("update").option("checkpointLocation", ck).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rows = ST.latest(ST.read_partials(spark, out, plan.schema), ["w_start", "w_end"])
    assert sorted((r.total, r.n) for r in rows.collect()) == [(3.0, 2), (12.0, 2)]
    assert len(emitted) >= 3
