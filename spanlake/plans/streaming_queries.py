"""Streaming operators run to the end over the given tables as file streams, several files per trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.plans.annotation_queries import r6
from spanlake.plans.registry import query
from spanlake.session import scratch_path
from spanlake.streaming import operators as ST


def _stream(t, name: str, files: int = 4, order: str | None = None):
    """The table as a stream of several files, by time where a column is named."""
    df = t.raw(name)
    path = scratch_path(t.spark, f"stream-{name}")
    if order:
        df = df.repartitionByRange(files, order)
    else:
        df = df.repartition(files)
    df.write.parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(t, df):
    """Run a streaming plan in append mode over all available input into a table and read it back."""
    out, ck = scratch_path(t.spark, "stream-out"), scratch_path(t.spark, "stream-ck")
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(df.schema).parquet(out)


def _timed(df):
    """ts as an instant: the table's times are read as UTC, whatever the session's zone."""
    return df.withColumn("ts", F.expr("CAST(convert_timezone('UTC', current_timezone(), CAST(ts AS TIMESTAMP_NTZ)) AS TIMESTAMP)"))


def _fed(t, parts, plan, mode: str):
    """Rows of a stateful plan whose input arrives part by part; the query stops and resumes from its checkpoint in between.

    Returns all rows that the batches emitted, each under its batch_id.
    """
    source, out, ck = (scratch_path(t.spark, f"stream-{x}") for x in ("in", "out", "ck"))
    for n, part in enumerate(parts):
        part.write.mode("append").parquet(source)
        df = plan(t.spark.readStream.schema(parts[0].schema).parquet(source))
        q = df.writeStream.outputMode(mode).option("checkpointLocation", ck).trigger(availableNow=True).foreachBatch(ST.partial_writer(out)).start()
        q.awaitTermination()
    return ST.read_partials(t.spark, out, df.schema)


#: Events arrive in steps of ten days, and one in twenty comes two steps late.
STEP_DAYS, LATE = 10, 20


def _arrivals(t):
    """The events as they arrive, step by step."""
    e = _timed(t.raw("events"))
    days = F.floor(F.unix_micros("ts") / 86400000000)
    e = e.withColumn("step", F.floor((days - days_of(e)) / STEP_DAYS) + F.when(F.col("event_id") % LATE == 0, 2).otherwise(0))
    steps = [r["step"] for r in e.select("step").distinct().orderBy("step").collect()]  # a step is ten days
    return [e.where(F.col("step") == s).drop("step") for s in steps]


def days_of(e):
    """Day number of the first event."""
    return F.lit(e.agg(F.floor(F.min(F.unix_micros("ts")) / 86400000000)).first()[0])


#: Rows that the watermark lets pass: their window (ending at `ends`, in milliseconds) is still open when their step begins.
PASSED = f"""d AS (SELECT *, epoch_ms(ts) // 86400000 AS dy FROM events),
    a AS (SELECT *, (dy - (SELECT min(dy) FROM d)) // {STEP_DAYS} + CASE WHEN event_id % {LATE} = 0 THEN 2 ELSE 0 END AS step FROM d),
    m AS (SELECT step, max(epoch_ms(ts)) AS hi FROM a GROUP BY step),
    k AS (SELECT step, max(hi) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 600000 AS mark FROM m)"""


@query(
    "stream_meters",
    f"""WITH {PASSED}, p AS (SELECT a.*, time_bucket(INTERVAL 1 DAY, ts) AS b FROM a JOIN k USING (step)
        WHERE mark IS NULL OR epoch_ms(time_bucket(INTERVAL 1 DAY, ts)) + 86400000 > mark)
    SELECT epoch(b)::BIGINT AS w_start, event_type, round(sum(value * (1 + user_id % 3)) / sum(1 + user_id % 3), 6) AS avg,
        round(sum(value), 4) AS total, count(*) AS n, round(count(*) / 86400, 6) AS rate FROM p GROUP BY 1, 2""",
)
def _(t):
    def plan(s):
        return ST.stream_meters(s.withColumn("w", 1 + F.col("user_id") % 3), "ts", "value", "w", "1 day", keys=["event_type"])

    out = ST.latest(_fed(t, _arrivals(t), plan, "update"), ["w_start", "w_end", "event_type"])
    return out.select(
        F.unix_timestamp("w_start").alias("w_start"), "event_type", r6("avg"), F.round("total", 4).alias("total"), "n", r6("rate")
    )


@query(
    "stream_meters_sliding",
    f"""WITH {PASSED}, p AS (SELECT step, epoch_ms(time_bucket(INTERVAL 12 HOUR, ts)) - o * 43200000 AS b FROM a, (SELECT unnest([0, 1]) AS o))
    SELECT b // 1000 AS w_start, count(*) AS n FROM p JOIN k USING (step) WHERE mark IS NULL OR b + 86400000 > mark GROUP BY 1""",
)
def _(t):
    rows = _fed(t, _arrivals(t), lambda s: ST.stream_meters(s, "ts", "value", None, "1 day", "12 hours"), "update")
    return ST.latest(rows, ["w_start", "w_end"]).select(F.unix_timestamp("w_start").alias("w_start"), "n")


@query("stream_dedup_lines", "SELECT DISTINCT event_type || user_id % 7 AS line FROM events")
def _(t):
    s = _timed(_stream(t, "events", order="ts")).withColumn("line", F.concat("event_type", (F.col("user_id") % 7).cast("string")))
    return _run(t, ST.stream_dedup_lines(s.select("ts", "line"), "ts", "line", "60 days")).select("line")


@query(
    "stream_islands",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 43200000000 AS "end", count(*) AS n FROM r GROUP BY user_id, k""",
)
def _(t):
    # steps in order of time, then one row from the far future, which closes every run and stays open itself
    e = _timed(t.raw("events")).select("ts", "user_id")
    step = F.floor((F.floor(F.unix_micros("ts") / 86400000000) - days_of(e)) / STEP_DAYS)
    steps = [r["s"] for r in e.select(step.alias("s")).distinct().orderBy("s").collect()]
    end = t.spark.range(1).select(F.timestamp_micros(F.lit(4102444800000000)).alias("ts"), F.lit(-1).cast("long").alias("user_id"))
    parts = [*[e.where(step == s) for s in steps], end]
    out = _fed(t, parts, lambda s: ST.stream_islands(s, "ts", ["user_id"], "12 hours", "1 hour"), "append")
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query(
    "stream_ap",
    """WITH s AS (SELECT cls AS label, abs(embedding[cls + 1]::DOUBLE) AS score, CASE WHEN label = cls THEN 1 ELSE 0 END AS target FROM embeddings, (SELECT unnest(range(10))::INT AS cls)),
    h AS (SELECT label, score, sum(target) AS pos, count(*) AS n FROM s GROUP BY 1, 2),
    r AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS c FROM h WINDOW w AS (PARTITION BY label ORDER BY score DESC))
    SELECT label, round(sum(pos * tp / c) / sum(pos), 6) AS ap FROM r GROUP BY 1""",
)
def _(t):
    s = _stream(t, "embeddings").select("label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("cls"))
    s = s.select(F.col("cls").alias("label"), F.abs(F.expr("element_at(embedding, cls + 1)").cast("double")).alias("score"), (F.col("label") == F.col("cls")).cast("int").alias("target"))
    path = scratch_path(t.spark, "ap")
    q = ST.stream_ap(s, path).option("checkpointLocation", scratch_path(t.spark, "stream-ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return ST.ap_from_state(ST.read_partials(t.spark, path, ST.SCORE_STATE)).select("label", r6("ap"))


@query(
    "stream_covariance",
    """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
    SELECT a.i, b.i AS j, round(covar_samp(a.x, b.x), 6) + 0.0::DOUBLE AS cov FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2""",
)
def _(t):
    path = scratch_path(t.spark, "cov")
    q = ST.stream_covariance(_stream(t, "embeddings"), path).option("checkpointLocation", scratch_path(t.spark, "stream-ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return ST.covariance_from_sums(t.spark.read.parquet(path)).select("i", "j", (F.round("cov", 6) + F.lit(0.0)).alias("cov"))
