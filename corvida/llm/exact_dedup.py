"""Exact duplicates by two-pass Bloom filtering.

Pass one sets, for every row, two slots chosen by its text hash, and keeps the slots that were hit twice as a bitmap. A
row whose two slots were both hit again is possibly repeated; every other row is certainly alone. Pass two shuffles the
possibly repeated rows only, compares their full 256-bit digests, and lets the others through untouched. The bitmap is
sized by the row count and never above ``max_bits`` (128 MB at the default), so its broadcast is bounded; beyond that
size more single rows are checked needlessly, with the same result.

Defined cases: null text counts as empty; texts are equal when identical after each run of ASCII white space becomes one
space; of equal texts the row with the smallest doc_id stays (null ids last); rows repeated with the same id are one
group; an empty table gives an empty result; other columns are carried untouched whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import WS_CLASS, written

SLOTS_PER_ROW = 2


def normalised(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), WS_CLASS, " ")


def digest(c: Column) -> Column:
    return F.unhex(F.sha2(normalised(c), 256))


def _slots(sha: Column, bits: int) -> list[Column]:
    return [F.xxhash64(sha, F.lit(i)).bitwiseAND(F.lit(bits - 1)) for i in range(SLOTS_PER_ROW)]


def repeated_filter(digests: DataFrame, sha: str = "sha", slots_per_row: int = 16, max_bits: int = 1 << 30) -> tuple[np.ndarray, int]:
    """Bitmap of the slots hit at least twice, and its number of bits."""
    rows = digests.count()
    bits = min(max_bits, 1 << max(16, (rows * slots_per_row - 1).bit_length() if rows else 16))
    hit = digests.select(F.explode(F.array(*_slots(F.col(sha), bits))).alias("slot")).groupBy("slot").count().where("count > 1")
    pieces = hit.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("piece"))
    bitmap = np.zeros(bits // 8, dtype=np.uint8)
    for r in pieces.collect():
        at = (r["bucket"] - 1) * 4096
        part = np.frombuffer(bytes(r["piece"]), dtype=np.uint8)[: len(bitmap) - at]
        bitmap[at : at + len(part)] = part
    return bitmap, bits


def maybe_repeated(digests: DataFrame, bitmap: np.ndarray, bits: int, sha: str = "sha", out: str = "maybe") -> DataFrame:
    """Adds ``out``: false only for rows whose text is certainly alone."""
    sent = digests.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def probe(a: pa.Array, b: pa.Array) -> pa.Array:
        seen = np.ones(len(a), dtype=bool)
        for c in (a, b):
            slot = c.to_numpy(zero_copy_only=False)
            seen &= (sent.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
        return pa.array(seen)

    return digests.withColumn(out, probe(*_slots(F.col(sha), bits)))


def duplicate_groups(docs: DataFrame, ident: str = "doc_id", text: str = "text", **filter_args) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    table = written(docs.select(F.col(ident).alias("doc_id"), digest(F.col(text)).alias("sha")))
    bitmap, bits = repeated_filter(table, **filter_args)
    rows = maybe_repeated(table, bitmap, bits)
    again = rows.where("maybe").drop("maybe")
    groups = written(again.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    checked = again.join(groups, "sha").select("doc_id", "keep_id", "group_size", "sha")
    alone = rows.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    return checked.unionByName(alone).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", **filter_args) -> DataFrame:
    """``docs`` without the repeated texts; exactly one row of each group stays, with its own columns."""
    bitmap, bits = repeated_filter(written(docs.select(digest(F.col(text)).alias("sha"))), **filter_args)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(ident).alias("id"), digest(F.col(text)).alias("sha"))
    rows = maybe_repeated(rows, bitmap, bits)
    first = F.min_by("row", F.struct(F.col("id").isNull().alias("no_id"), F.col("id")))
    again = rows.where("maybe").groupBy("sha").agg(first.alias("row")).select("row.*")
    return rows.where(~F.col("maybe")).select("row.*").unionByName(again)
