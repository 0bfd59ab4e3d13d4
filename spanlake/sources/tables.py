"""Adapters from the given star-schema and corpus tables to the canonical tables.

Every adapter exists twice: as a DataFrame (class Tables) and as a SQL common table
expression (CTES) for checking against another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake.session import shuffle_width

EPOCH_US = 1704067200000000  # 2024-01-01T00:00:00Z in microseconds


class Tables:
    """Lazy access to the raw tables of one directory and the canonical tables made from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def segments(self) -> DataFrame:
        """(clip_id, seg_id, label, t_start, t_end), times in seconds since 2024-01-01."""
        gap = F.expr("ts - TIMESTAMP_NTZ'2024-01-01 00:00:00'")
        micros = (
            F.expr("extract(DAY FROM gap)").cast("long") * 86400000000
            + F.expr("extract(HOUR FROM gap)").cast("long") * 3600000000
            + F.expr("extract(MINUTE FROM gap)").cast("long") * 60000000
            + (F.expr("extract(SECOND FROM gap)") * 1000000).cast("long")
        )
        ev = self.raw("events").select(
            "user_id", "event_id", "event_type", "value", F.col("ts").cast("timestamp_ntz").alias("ts")
        )
        start = micros / F.lit(1e6)
        return (
            ev.withColumn("gap", gap)
            .select(
                F.col("user_id").alias("clip_id"),
                F.col("event_id").alias("seg_id"),
                F.col("event_type").alias("label"),
                start.alias("t_start"),
                (start + 60 * F.col("value")).alias("t_end"),
            )
        )

    def clips(self) -> DataFrame:
        """(clip_id, video_id, subset, duration, fps), one row per clip."""
        phase = F.pmod("clip_id", F.lit(4))
        return (
            self.segments()
            .groupBy("clip_id")
            .agg(F.max("t_end").alias("duration"))
            .select(
                "clip_id",
                F.pmod("clip_id", F.lit(50)).alias("video_id"),
                F.when(phase < 2, "train").when(phase == 2, "val").otherwise("test").alias("subset"),
                "duration",
                F.lit(30.0).alias("fps"),
            )
        )

    def predictions(self) -> DataFrame:
        """Three jittered predictions per segment with distinct scores."""
        pid = F.col("seg_id") * 3 + F.col("j")
        shake_s = (F.col("pred_id") * 7919) % 601 - 300
        shake_e = (F.col("pred_id") * 104729) % 601 - 300
        j1 = 1 + F.col("j")
        start = F.col("t_start") + j1 * shake_s
        return (
            self.segments()
            .withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
            .withColumn("pred_id", pid)
            .select(
                "clip_id",
                "pred_id",
                "label",
                start.alias("t_start"),
                F.greatest(F.col("t_end") + j1 * shake_e, start + 1).alias("t_end"),
                (((F.col("pred_id") * 15485863) % 1000003) / F.lit(1000003.0)).alias("score"),
            )
        )

    def frames(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.pmod("vec_id", F.lit(20)).alias("clip_id"),
            F.floor(F.col("vec_id") / 20).alias("t"),
            "vec_id",
            "label",
            "embedding",
        )

    def frame_scores(self) -> DataFrame:
        """(video_id, t, label, score, target) for ten classes."""
        return (
            self.frames()
            .select("clip_id", "t", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("cls"))
            .select(
                F.col("clip_id").alias("video_id"),
                "t",
                F.col("cls").alias("label"),
                F.abs(F.expr("element_at(embedding, cls + 1)").cast("double")).alias("score"),
                (F.col("label") == F.col("cls")).cast("int").alias("target"),
            )
        )

    def boxes(self) -> DataFrame:
        """(frame_id, det_id, x0, y0, x1, y1, label, score), one row per line; lines of one number are told apart by rank."""
        same = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(
            "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_discount"
        )
        x0 = 10 * F.col("l_quantity")
        y0 = F.pmod(F.col("l_partkey"), F.lit(500)).cast("double")
        return (
            self.raw("lineitem")
            .withColumn("rn", F.row_number().over(same))
            .select(
                F.col("l_orderkey").alias("frame_id"),
                (F.col("l_linenumber") + 8 * (F.col("rn") - 1)).alias("det_id"),
                x0.alias("x0"),
                y0.alias("y0"),
                (x0 + 20 + F.pmod(F.col("l_suppkey"), F.lit(50))).alias("x1"),
                (y0 + 30).alias("y1"),
                F.col("l_returnflag").alias("label"),
                (1 - F.col("l_discount")).alias("score"),
            )
        )

    def narrations(self) -> DataFrame:
        return self.raw("conversations").select(
            F.col("conv_id").alias("video_uid"),
            F.col("turn").alias("clip_index"),
            F.col("role").alias("verb"),
            F.concat(F.lit("#C C "), "text").alias("narration_text"),
        )

    def texts(self) -> DataFrame:
        """(id, pred, ref): a document and the next document of its source.

        Each text moves once: documents are dealt out by runs of (source, doc_id), and the first of a run goes to the run before
        it, too, as the document that follows there.
        """
        docs = self.raw("documents").select("doc_id", "source", "text")
        key = F.struct("source", "doc_id")
        width = shuffle_width(self.spark)
        # the smallest keys of even ranges, one row for each: runs are many more than tasks, so tasks get like shares
        ranged = docs.select("source", "doc_id").repartitionByRange(4 * width, "source", "doc_id")
        firsts = ranged.groupBy(F.spark_partition_id()).agg(F.min(key).alias("k")).orderBy("k").collect()
        kind = docs.select(key.alias("k")).schema["k"].dataType
        bounds = [F.struct(F.lit(x.k.source).alias("source"), F.lit(x.k.doc_id).alias("doc_id")).cast(kind) for x in firsts]
        if not bounds:
            return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("pred"), F.col("text").alias("ref")).where(F.lit(False))
        step = max(1, int(len(bounds) ** 0.5))

        def until(own: Column) -> Column:
            """Number of bounds up to the row's key."""
            return F.size(F.filter(own, lambda x: x <= F.col("_key")))

        # bounds in two steps, as each is compared with the row's key
        coarse = (until(F.array(*bounds[::step])) - 1) * step
        marked = docs.withColumn("_key", key).withColumn("_coarse", coarse)
        marked = marked.withColumn("_run", F.col("_coarse") + until(F.slice(F.array(*bounds), F.col("_coarse") + 1, F.lit(step))) - 1)
        own = F.struct(F.col("_run").alias("run"), F.lit(False).alias("after"))
        before = F.struct((F.col("_run") - 1).alias("run"), F.lit(True).alias("after"))
        first = (F.col("_run") > 0) & (F.get(F.array(*bounds), F.col("_run")) == F.col("_key"))
        dealt = marked.select("doc_id", "source", "text", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own))).alias("_at"))
        dealt = dealt.select("doc_id", "source", "text", F.col("_at.run").alias("_run"), F.col("_at.after").alias("_after")).repartition(width, "_run")
        follows = Window.partitionBy("_run", "source").orderBy("doc_id")
        return (
            dealt.withColumn("ref", F.lead("text").over(follows))
            .where(~F.col("_after") & F.col("ref").isNotNull())
            .select(F.col("doc_id").alias("id"), F.col("text").alias("pred"), "ref")
        )


CTES: dict[str, str] = {
    "segments": """SELECT user_id AS clip_id, event_id AS seg_id, event_type AS label,
        (epoch_us(ts) - 1704067200000000) / 1e6 AS t_start,
        (epoch_us(ts) - 1704067200000000) / 1e6 + 60 * value AS t_end FROM events""",
    "clips": """SELECT clip_id, clip_id % 50 AS video_id,
        CASE WHEN clip_id % 4 < 2 THEN 'train' WHEN clip_id % 4 = 2 THEN 'val' ELSE 'test' END AS subset,
        max(t_end) AS duration, 30.0::DOUBLE AS fps FROM segments GROUP BY clip_id""",
    "predictions": """SELECT clip_id, pred_id, label, p_start AS t_start,
        greatest(t_end + (1 + j) * ((pred_id * 104729) % 601 - 300), p_start + 1) AS t_end,
        ((pred_id * 15485863) % 1000003) / 1000003e0 AS score
        FROM (SELECT *, t_start + (1 + j) * ((pred_id * 7919) % 601 - 300) AS p_start
              FROM (SELECT s.*, j, seg_id * 3 + j AS pred_id FROM segments s, (VALUES (0), (1), (2)) v(j)))""",
    "frames": """SELECT vec_id % 20 AS clip_id, vec_id // 20 AS t, vec_id, label, embedding FROM embeddings""",
    "frame_scores": """SELECT clip_id AS video_id, t, cls AS label, abs(embedding[cls + 1]::DOUBLE) AS score,
        CASE WHEN label = cls THEN 1 ELSE 0 END AS target
        FROM frames, (SELECT unnest(range(10))::INT AS cls)""",
    "boxes": """SELECT l_orderkey AS frame_id, l_linenumber + 8 * (row_number() OVER (PARTITION BY l_orderkey, l_linenumber
              ORDER BY l_partkey, l_suppkey, l_quantity, l_returnflag, l_discount) - 1) AS det_id, 10 * l_quantity AS x0,
        (l_partkey % 500)::DOUBLE AS y0, 10 * l_quantity + 20 + l_suppkey % 50 AS x1,
        (l_partkey % 500)::DOUBLE + 30 AS y1, l_returnflag AS label, 1 - l_discount AS score FROM lineitem""",
    "narrations": """SELECT conv_id AS video_uid, turn AS clip_index, role AS verb,
        '#C C ' || text AS narration_text FROM conversations""",
    "texts": """SELECT id, pred, ref FROM (SELECT doc_id AS id, text AS pred,
        lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS ref FROM documents)
        WHERE ref IS NOT NULL""",
}


def with_ctes(names: list[str], body: str) -> str:
    if not names:
        return body
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in names)
    tail = body.lstrip()
    if tail.upper().startswith("WITH "):
        return f"WITH {head}, {tail[5:]}"
    return f"WITH {head} {tail}"
