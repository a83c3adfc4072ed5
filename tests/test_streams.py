"""Streams in several batches against the same work in one batch: late rows, repeated rows, batches tried again."""

import os

import pytest
from pyspark.sql import functions as F

from corvida.operators import bank
from corvida.streaming import flows

ROWS = "k string, ts int, v double"
BATCHES = [[("a", 2, 5.0), ("b", 1, 2.0), ("b", 1, 2.0), (None, 1, 7.0)], [("a", 1, 9.0), ("c", 1, 3.0)], [("c", 4, 4.0), (None, 9, 8.0), ("a", 3, 6.0)]]
WANT = [("a", 3, 6.0), ("b", 1, 2.0), ("c", 4, 4.0), (None, 1, 7.0), (None, 9, 8.0)]


def content(spark, path, schema):
    return sorted((tuple(r) for r in flows.read_upserted(spark, path, schema).collect()), key=repr)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_stream_upsert_by_partition(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "t")
    for rows in BATCHES:  # one run per batch: the stream goes on where it stopped
        before = files(out)
        frame = spark.createDataFrame(rows, ROWS)
        frame.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ROWS).parquet(src)
        q = flows.upsert_stream(stream, out, ["k"], ["ts"], str(tmp_path / "c"), buckets=64).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        new = files(out)
        assert all(new[f] == t for f, t in before.items())  # nothing written before is touched again
        added = {f.split("_bucket=")[1].split("/")[0] for f in new if f not in before and "/rows/" in f}
        assert 0 < len(added) <= len({r[0] for r in rows})
    assert content(spark, out, frame.schema) == sorted(WANT, key=repr)


def test_batches_tried_again(spark, tmp_path):
    out = str(tmp_path / "t")
    frames = [spark.createDataFrame(rows, ROWS) for rows in BATCHES]
    schema = frames[0].schema
    assert flows.read_upserted(spark, out, schema).count() == 0
    for epoch, frame in enumerate(frames):
        flows.merge_batch(frame, epoch, out, ["k"], ["ts"], 8)
        flows.merge_batch(frame, epoch, out, ["k"], ["ts"], 8)  # rows without a key are not doubled
        flows.merge_batch(frame.limit(0), epoch + 100, out, ["k"], ["ts"], 8)
    assert content(spark, out, schema) == sorted(WANT, key=repr)
    # A batch that dies between its rows and its commit changes nothing for readers.
    frame = spark.createDataFrame([("a", 99, 0.0)], ROWS)
    frame.withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(f"{out}/rows/_epoch=3")
    assert content(spark, out, schema) == sorted(WANT, key=repr)
    flows.merge_batch(frame, 3, out, ["k"], ["ts"], 8)
    assert ("a", 99, 0.0) in content(spark, out, schema)


@pytest.mark.parametrize("per_batch", [1, 2])
def test_journal_stream_matches_one_batch(spark, tmp_path, per_batch):
    schema = "key string, spectrum_type string, status string, sources_key string, ts int"
    rows = [(f"k{i % 7}", "IR", ["found_downloaded", "not_found", "search_error", "not_found"][(i * i // 3) % 4], ["nist", "nist|mona"][i % 2], (i * 37) % 101) for i in range(60)]
    src, out = str(tmp_path / "in"), str(tmp_path / "t")
    df = spark.createDataFrame(rows, schema)
    df.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(src)
    assert flows.journal_stream(stream, "nist", out, str(tmp_path / "c"), buckets=4).trigger(availableNow=True).start().awaitTermination(180)
    want = bank.journal_decision(df, "nist")
    got = flows.read_upserted(spark, out, want.withColumn("decided_in", F.lit(0).cast("long")).schema).drop("decided_in")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_repeats_leave_within_the_watermark(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:00:05'), ('b', timestamp'2024-01-01 00:00:01') AS t(k, at)").write.parquet(src)
    stream = flows.without_repeats(spark.readStream.schema("k string, at timestamp").parquet(src), ["k"], "at", "10 minutes")
    q = stream.writeStream.format("memory").queryName("kept_rows").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r["k"] for r in spark.table("kept_rows").collect()) == ["a", "b"]
