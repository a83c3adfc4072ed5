"""Session defaults and lineage cutting."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "corvida", **conf) -> SparkSession:
    """Session with adaptive execution and skew-join splitting switched on."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


_released = [0.0]


def release(spark: SparkSession, every: float = 2.0) -> None:
    """Let go of the shuffle files of plans that nothing refers to any more, at most once in ``every`` seconds.

    Spark deletes them only when the driver happens to collect its garbage, so the shuffles of every earlier step would lie on disk together."""
    if time.monotonic() - _released[0] >= every:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _released[0] = time.monotonic()


def _shared_folder(spark: SparkSession) -> str:
    """Reliable checkpoint folder named by ``spark.checkpoint.dir``.

    A folder of our own is made only for a local master, where it is shared by
    definition; on a cluster an unset folder is an error, not a silent local path.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="corvida-checkpoint-")
            folder = sc._jvm.org.apache.hadoop.fs.Path(shared)
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(folder)
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    release(df.sparkSession)
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`cut_lineage`, as a Parquet table beside the checkpoints: columns of few values take little room there.
    It goes when the driver's JVM ends."""
    spark = df.sparkSession
    release(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_shared_folder(spark)}/stored-{uuid.uuid4().hex}")
    df.write.parquet(path.toString())
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(path.toString())
