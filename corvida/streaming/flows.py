"""Streaming use of the stateless scorer, keyed upserts by partition and the search journal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvida.operators.bank import journal_decision, upsert
from corvida.operators.gram import LinearModel

EPOCH, BUCKET = "_epoch", "_bucket"
COMMITS = T.StructType([T.StructField(BUCKET, T.IntegerType()), T.StructField(EPOCH, T.LongType())])


def score_stream(model: LinearModel, stream: DataFrame) -> DataFrame:
    """Prediction column on a streaming frame (a plain expression, no state)."""
    return stream.withColumn("prediction", model.column())


def without_repeats(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """First row of each key; a key is remembered until the watermark (latest ``time`` less ``delay``) passes it, so state stays bounded."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Bucket -> its latest committed epoch: at most one entry per bucket reaches the driver."""
    if not _exists(spark, f"{path}/commits"):
        return {}
    c = spark.read.schema(COMMITS).parquet(f"{path}/commits")
    c = c if before is None else c.where(F.col(EPOCH) < before)
    return {r[BUCKET]: r["e"] for r in c.groupBy(BUCKET).agg(F.max(EPOCH).alias("e")).collect()}


def _read(spark: SparkSession, path: str, schema: T.StructType, versions: dict[int, int]) -> DataFrame:
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/rows/{EPOCH}={e}/{BUCKET}={b}" for b, e in sorted(versions.items())])


def read_upserted(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The current rows of a table kept by :func:`upsert_stream`."""
    return _read(spark, path, schema, _versions(spark, path))


def merge_batch(batch: DataFrame, epoch: int, path: str, keys: Sequence[str], order: Sequence[str], buckets: int) -> None:
    """Write the buckets that the batch touches anew under its epoch, then commit them in one small file.

    Reading goes by the commits before this epoch, so a batch that is tried again finds what it found first and replaces
    its own rows; a writer that dies before the commit leaves nothing that a reader sees. Other buckets are neither read nor written.
    """
    spark = batch.sparkSession
    # A row with a null key still has a bucket, and copies of a hot key have collapsed within the batch before it meets the table.
    bucket = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")
    batch = batch.persist()
    try:
        touched = {r[0] for r in batch.select(bucket).distinct().collect()}
        if not touched:
            return
        old = _read(spark, path, batch.schema, {b: e for b, e in _versions(spark, path, epoch).items() if b in touched})
        # Rebalancing gives a bucket few files and splits a large one, such as that of the rows without a key.
        upsert(old, batch, keys, order).withColumn(BUCKET, bucket).hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/rows/{EPOCH}={epoch}")
        spark.createDataFrame([(b, epoch) for b in sorted(touched)], COMMITS).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={epoch}")
    finally:
        batch.unpersist()


def upsert_stream(stream: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], checkpoint: str, buckets: int = 256):
    """Latest row per key under ``path``, rows without a key all kept; a batch touches only the buckets of its keys.

    Late rows (smaller ``order``) lose against the newer row. The folder belongs to one checkpoint: epochs count from its start.
    """
    return stream.writeStream.foreachBatch(lambda batch, epoch: merge_batch(batch, epoch, path, keys, order, buckets)).option("checkpointLocation", checkpoint)


def journal_stream(stream: DataFrame, sources_key: str, path: str, checkpoint: str, keys: Sequence[str] = ("key", "spectrum_type"), order: str = "ts", buckets: int = 256):
    """Search decisions kept up to date: state per key holds its latest statuses, and a batch rewrites the buckets of changed keys only."""
    def merge(batch: DataFrame, epoch: int) -> None:
        merge_batch(batch.withColumn("decided_in", F.lit(epoch).cast("long")), epoch, path, keys, ["decided_in"], buckets)

    return journal_decision(stream, sources_key, keys, order).writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint)
