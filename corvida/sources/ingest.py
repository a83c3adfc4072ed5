"""Import of raw spectrum files: whole texts in, points and index rows out, appended so that a second run adds nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.sources import parsers
from corvida.sources.tables import INDEX_SCHEMA, conform, shard_key
from corvida.session import cut_lineage

POINTS = "spectrum_id string, x double, y double"
NAMED = ("name", "cas", "canonical_smiles", "compound_id")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text): one row per file below the folder, read by the executors; bad bytes become replacement marks.

    Spark plans no task for a file of zero bytes, so such files have no row and no status."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return d.select("path", F.regexp_replace(text, "^\ufeff", "").alias("text"))


def _signature(splash, url, low, high, n) -> Column:
    """What tells two spectra of one compound, type and source apart: the hash of the peaks, else the address, else the range and size."""
    numbers = F.concat_ws("|", F.lit("r"), *[F.round(c, 9).cast("string") for c in (low, high)], n.cast("string"))
    return F.when(splash != "", F.concat(F.lit("s|"), splash)).when(url != "", F.concat(F.lit("u|"), url)).otherwise(numbers)


def file_points(files: DataFrame) -> DataFrame:
    """(path, x, y) of the files (path, text, format): stored records, JCAMP and two-column texts; the first of equal x stays."""
    of = lambda f: files.where(F.col("format") == f)
    record = of("MASSBANK_JSON").select("path", parsers.record_columns("text")["peaks"].alias("peaks"))
    parts = [parsers.peak_table(record, "path", "peaks").toDF("path", "x", "y"), parsers.jcamp_points(of("JCAMP_DX"), "path", "text"), parsers.two_column_points(of("NUMERIC_TABLE"), "path", "text")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")


def import_files(files: DataFrame, index: DataFrame, hints: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(status per path, points, index rows) of raw files (path, text) against the stored index.

    ``hints`` (path, inchikey, canonical_smiles, name, cas, compound_id) fills what a file does not say. Statuses, first that
    applies: unsupported_format, parse_error (no points), unmatched_compound (no key inside the file, in the hints or in full
    in the file name), already_registered (active index row of the same compound, type and source with the same
    peak hash, address or range, or an earlier path of this import), imported_local. The spectrum id is a digest of
    compound, type, source and signature, so it is the same in every run."""
    rec, name = parsers.record_columns("text"), parsers.key_from_name("path")
    d = files.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("format", parsers.sniff_format("text"))
    d = d.groupBy("path").agg(F.min(F.struct("format", "text")).alias("f")).select("path", "f.format", "f.text")  # one row per path
    json = F.col("format") == "MASSBANK_JSON"
    d = d.withColumns({**{f"_{k}": F.when(json, F.trim(v)) for k, v in rec.items() if k != "peaks"}, "_file": F.when(name["key_kind"] == "full", name["inchikey"])})
    wanted = ("inchikey", *NAMED)
    given = hints.select("path", *[(F.trim(F.col(c)) if c in hints.columns else F.lit(None).cast("string")).alias(f"h_{c}") for c in wanted]) if hints is not None else None
    d = d.join(given.dropDuplicates(["path"]), "path", "left") if given is not None else d.withColumns({f"h_{c}": F.lit(None).cast("string") for c in wanted})
    first = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c], F.lit(""))
    header = parsers.header_map("text")
    d = d.select(
        "path", "format", "text", first("_inchikey", "h_inchikey", "_file").alias("inchikey"), first("_smiles", "h_canonical_smiles").alias("canonical_smiles"), first("h_name", "_name").alias("name"),
        first("h_cas", "_cas").alias("cas"), first("h_compound_id").alias("compound_id"), F.coalesce(F.nullif("_source_database", F.lit("")), F.lit("LOCAL")).alias("source_database"),
        first("_source_url").alias("source_url"), first("_splash").alias("splash"), F.when(json, "Mass").otherwise("IR").alias("spectrum_type"),
        F.when(F.col("format") == "JCAMP_DX", parsers.header_phase("text")).otherwise("unknown").alias("phase"), F.when(F.col("format") == "JCAMP_DX", F.coalesce(header["YUNITS"], F.lit(""))).otherwise("").alias("intensity_type"),
        F.when(F.coalesce(F.col("_inchikey"), F.lit("")) != "", "metadata_in_file").otherwise("filename_or_manual").alias("confidence_level"))
    d = cut_lineage(d)
    points = cut_lineage(file_points(d))
    span = points.groupBy("path").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").cast("int").alias("n"))
    d = d.drop("text").join(span, "path", "left")
    d = d.withColumn("signature", F.when(F.col("n").isNotNull() & (F.col("inchikey") != ""), _signature(F.col("splash"), F.col("source_url"), F.col("low"), F.col("high"), F.col("n"))))
    same = ["inchikey", "spectrum_type", "source_database", "signature"]
    active = F.lower(F.trim(F.coalesce(F.col("active").cast("string"), F.lit("")))).isin("true", "1", "yes", "y", "active", "", "nan", "none")
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    known = index.where(active).select(text("inchikey").alias("inchikey"), "spectrum_type", F.lower(text("source_database")).alias("_db"), F.explode(F.array(
        _signature(F.regexp_extract(text("comment"), r"splash=([^;\s]+)", 1), F.lit(""), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("int")),
        _signature(F.lit(""), text("source_url"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("int")),
        _signature(F.lit(""), F.lit(""), F.col("wavenumber_min"), F.col("wavenumber_max"), F.col("n_points_processed")))).alias("signature")).distinct().withColumn("_known", F.lit(True))
    d = d.withColumn("_db", F.lower("source_database")).join(known, ["inchikey", "spectrum_type", "_db", "signature"], "left").drop("_db")
    lead = d.where("signature IS NOT NULL").groupBy(*same).agg(F.min("path").alias("_lead"))
    d = d.join(lead, same, "left")
    status = (F.when(F.col("format") == "UNKNOWN", "unsupported_format").when(F.col("n").isNull(), "parse_error").when(F.col("inchikey") == "", "unmatched_compound")
              .when(F.col("_known") | (F.col("_lead") != F.col("path")), "already_registered").otherwise("imported_local"))
    digest = F.substring(F.sha2(F.concat_ws("\n", *same), 256), 1, 16)
    d = cut_lineage(d.withColumns({"status": status, "spectrum_id": F.concat_ws("_", "spectrum_type", "inchikey", digest)}))
    new = d.where("status = 'imported_local'")
    out = points.join(new.select("path", "spectrum_id"), "path").select("spectrum_id", "x", "y")
    rows = new.withColumns({
        "source": F.lit("User local import"), "sample_type": F.lit("pure compound"), "is_experimental": F.lit(True), "is_quantitative": F.lit(False), "download_mode": F.lit("local_import"),
        "raw_file": F.col("path"), "wavenumber_min": F.col("low"), "wavenumber_max": F.col("high"), "n_points_raw": F.col("n"), "n_points_processed": F.col("n"), "date_downloaded": F.current_timestamp(),
        "comment": F.concat(F.lit("local_file="), F.element_at(F.split("path", "/"), -1), F.lit("; splash="), F.col("splash")), "active": F.lit(True)})
    return d.select("path", "format", "inchikey", "spectrum_id", "n", "status"), out, conform(rows, INDEX_SCHEMA)


def append_new(rows: DataFrame, folder: str, ident: list[str], shard: Column, overwrite_key: str = "shard") -> None:
    """Append rows to a Parquet table partitioned by ``shard`` so that a repeated run changes nothing.

    Only the partitions that the new rows fall into are read, freed of rows with the same ``ident`` and written again
    (dynamic partition overwrite); a run that dies before the commit leaves them as they were."""
    spark = rows.sparkSession
    new = cut_lineage(rows.withColumn(overwrite_key, shard))
    if new.isEmpty():
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        touched = [r[0] for r in new.select(overwrite_key).distinct().collect()]  # at most one value per two characters
        old = spark.read.schema(new.schema).parquet(folder).where(F.col(overwrite_key).isin(touched))
        new = cut_lineage(old.join(new.select(*ident).distinct(), ident, "left_anti").unionByName(new))
    new.repartition(overwrite_key, F.pmod(F.xxhash64(*ident), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(overwrite_key).parquet(folder)


def import_folder(spark: SparkSession, folder: str, bank: str, hints: DataFrame | None = None) -> DataFrame:
    """Import every file below ``folder`` into the bank (``points`` and ``index`` below it); returns the status per path.

    Points are written before index rows: a file counts as registered only once its points are there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{bank}/index")
    known = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    index = spark.read.parquet(f"{bank}/index") if known else spark.createDataFrame([], INDEX_SCHEMA)
    status, points, rows = import_files(read_files(spark, folder), index, hints)
    status, rows = cut_lineage(status), cut_lineage(rows)
    key = F.regexp_extract("spectrum_id", "^[^_]*_(.*)$", 1)
    append_new(points, f"{bank}/points", ["spectrum_id"], F.nullif(shard_key(key), F.lit("")))
    append_new(rows, f"{bank}/index", ["spectrum_id"], F.nullif(shard_key(key), F.lit("")))
    return status
