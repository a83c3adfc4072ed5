"""Small frame helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a global aggregate (exactly one row, so safe to broadcast)."""
    one = F.broadcast(one_row.withColumn("_one", F.lit(0)))
    return df.withColumn("_one", F.lit(0)).join(one, "_one").drop("_one")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before heavy per-row work, only when the input has fewer splits than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
