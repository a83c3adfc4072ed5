"""Table readers and writers: compounds, spectra index, single spectra, bank and shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvida.functions.columns import col, to_number

S, D, B, I = T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType()
INDEX_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    [(c, S) for c in ("spectrum_id", "compound_id", "name", "cas", "canonical_smiles", "inchikey", "source", "source_database", "source_url",
                      "spectrum_type", "phase", "intensity_type", "sample_type")] + [("is_experimental", B), ("is_quantitative", B)]
    + [(c, S) for c in ("download_mode", "confidence_level", "format", "raw_file", "processed_file")]
    + [("wavenumber_min", D), ("wavenumber_max", D), ("n_points_raw", I), ("n_points_processed", I), ("status", S), ("date_downloaded", T.TimestampType()), ("comment", S), ("active", B)])])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project onto a schema: absent columns become nulls, present ones are cast (unreadable -> null)."""
    return df.select(*[(F.col(f.name).cast("string").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; without a schema every column stays text (typed later by ``to_number``)."""
    r = spark.read.option("header", True).option("encoding", "UTF-8")
    return (r.schema(schema) if schema else r).csv(path)


def read_compounds(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return conform(read_compounds(spark, path), INDEX_SCHEMA)


def read_spectra(spark: SparkSession, folder: str) -> DataFrame:
    """(spectrum_id, x, y) from a folder of two-column CSV files, the file name being the id."""
    d = read_csv(spark, folder)
    d = d.toDF(*[c.strip().lower() for c in d.columns])
    ident = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    d = d.select(ident.alias("spectrum_id"), to_number("wavenumber").alias("x"), to_number("intensity").alias("y"), F.monotonically_increasing_id().alias("_o"))
    d = d.where("x IS NOT NULL AND y IS NOT NULL")
    return d.groupBy("spectrum_id", "x").agg(F.min_by("y", "_o").alias("y"))


def shard_key(key) -> Column:
    """First two letters or digits of the key, empty when there are fewer."""
    t = F.regexp_replace(F.upper(F.trim(F.coalesce(col(key).cast("string"), F.lit("")))), "[^A-Z0-9]+", "")
    return F.when(t.isin("NAN", "NONE", "NULL") | (F.length(t) < 2), "").otherwise(F.substring(t, 1, 2))


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Rows of one partition value may be spread over several files; nothing is funnelled into one task."""
    w = df.write.mode(mode).partitionBy(*by) if by else df.write.mode(mode)
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def read_bank(spark: SparkSession, path: str, source: str, profile: str) -> DataFrame:
    """Bank rows of one source and profile; both are partition columns, so only their folders are read."""
    return spark.read.parquet(path).where((F.col("descriptor_source") == source) & (F.col("descriptor_profile") == profile))


def shards_for(keys: DataFrame, shards: DataFrame, full: DataFrame, key: str) -> DataFrame:
    """Rows for the wanted keys from the shards they live in, back-filled from the full table."""
    want = keys.select(key, shard_key(key).alias("shard")).distinct()
    found = shards.join(want, ["shard", key], "left_semi")
    rest = want.select(key).join(found.select(key).distinct(), key, "left_anti")
    return found.unionByName(full.join(rest, key, "left_semi"), allowMissingColumns=True)


def inventory(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table, kind, n) row counts per kind of every bank table."""
    out = None
    for name, (df, kind) in tables.items():
        d = df.groupBy(F.col(kind).cast("string").alias("kind")).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "kind", "n")
        out = d if out is None else out.unionByName(d)
    return out
