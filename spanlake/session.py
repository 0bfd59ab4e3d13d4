"""Session helpers: local session for tests, durable lineage cuts, sizing."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spanlake")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        # as many shuffle partitions as cores: merging them further would only idle cores
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the cluster names; a local master may do without and gets a temporary one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spanlake-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, stem: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_free(df: DataFrame) -> DataFrame:
    """cut, after which Spark drops the shuffle files that only df was made from; else they stay until the driver collects garbage."""
    out = cut(df)
    made = df._jdf.queryExecution().toRdd()
    made.toDebugString()  # an RDD names its dependencies only once it was asked for them
    made.cleanShuffleDependencies(True)
    return out


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


SMALL_BYTES = 32 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a small table over all tasks ahead of work that is heavy per row.

    A table with less than SMALL_BYTES per shuffle partition may sit in one file split or one merged
    shuffle partition; moving it costs little. A larger table already has splits enough and is left
    as it is.
    """
    width = shuffle_width(df.sparkSession)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(width, *keys) if size < width * SMALL_BYTES else df
