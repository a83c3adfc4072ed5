"""Threshold-scaled document fingerprints, in built-in functions only.

A fingerprint keeps every five-word shingle hash below a fixed fraction of the hash range. The kept part of a text does
not depend on other texts or on its length, so fingerprints merge by union, and the share of one text contained in a
far longer one can be estimated from them. Text form: a digest of the words, a colon, the kept hashes in order.

Neighbours in doc_id order are found without a global sort: ids fall into at most ``CELLS`` equal ranges whose counts are
collected, crowded ranges are divided further in proportion to their rows, and one shuffle by these buckets serves the
window that fetches the next text. The first row of each bucket is handed to the bucket before it.

Defined cases: null text is empty; an empty text has no hashes; texts with fewer than five words have their whole
sequence as one shingle; equal word sequences are alike 1.0, otherwise two sketches without a common hash 0.0; null ids sort
first, repeated ids by their text; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvida.llm.common import WS_CLASS

FRACTION = 0.25
CELLS = 4096


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WS_CLASS), lambda w: w != "")


def sketch(text: Column, fraction: float = FRACTION, words: int = 5) -> Column:
    """struct(digest, hashes): the kept shingle hashes, distinct and sorted."""
    bound = int(fraction * (1 << 32))

    def kept(w: Column) -> Column:
        last = F.greatest(F.size(w) - words, F.lit(0))
        hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(words)]))
        hashes = F.when(F.size(w) > 0, hashes).otherwise(F.array().cast("array<bigint>"))
        few = F.filter(hashes, lambda h: F.shiftrightunsigned(h, 32) < bound)
        return F.struct(F.xxhash64(w).alias("digest"), F.array_sort(F.array_distinct(few)).alias("hashes"))

    return F.transform(F.array(word_list(text)), kept)[0]


def as_text(s: Column) -> Column:
    def hex16(x):
        return F.lpad(F.lower(F.hex(x)), 16, "0")

    return F.concat(hex16(s["digest"]), F.lit(":"), F.array_join(F.transform(s["hashes"], hex16), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance, 0 to 1."""
    both = F.size(F.array_union(a["hashes"], b["hashes"]))
    return (F.when(a["digest"] == b["digest"], 1.0).when(both == 0, 0.0)
            .otherwise(F.size(F.array_intersect(a["hashes"], b["hashes"])) / both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds, 0 to 1."""
    n = F.size(a["hashes"])
    return F.when(a["digest"] == b["digest"], 1.0).when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a["hashes"], b["hashes"])) / n)


def merged(a: Column, b: Column) -> Column:
    """Sketch of two texts together."""
    return F.struct(F.xxhash64(a["digest"], b["digest"]).alias("digest"), F.array_sort(F.array_union(a["hashes"], b["hashes"])).alias("hashes"))


def bucketed(docs: DataFrame, rows_per_bucket: int = 400) -> tuple[DataFrame, list]:
    """Rows with their (cell, sub) bucket in id order and the bucket before it; the list holds at most CELLS cells."""
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    width = (hi - lo) // CELLS + 1
    cell = F.coalesce(F.floor((F.col("doc_id") - F.lit(lo)) / F.lit(width)).cast("long"), F.lit(-1).cast("long"))
    docs = docs.withColumn("cell", cell)
    found = docs.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).orderBy("cell").collect()
    cells = []
    for r in found:
        k = max(1, min(-(-r["n"] // rows_per_bucket), (r["hi"] - r["lo"] + 1) if r["lo"] is not None else 1))
        step = 1 if r["lo"] is None else -(-(r["hi"] - r["lo"] + 1) // k)
        cells.append((r["cell"], r["lo"] or 0, step, 0 if r["lo"] is None else (r["hi"] - r["lo"]) // step))
    table = [(c, base, step, *cells[i - 1][::3]) for i, (c, base, step, _) in enumerate(cells)]
    made = docs.sparkSession.createDataFrame(table, "cell long, base long, step long, cell_before long, sub_before long")
    docs = docs.join(F.broadcast(made), "cell")
    return docs.withColumn("sub", F.coalesce(F.floor((F.col("doc_id") - F.col("base")) / F.col("step")).cast("long"), F.lit(0).cast("long"))), cells


def fingerprint_edits(docs: DataFrame, fraction: float = FRACTION, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows, _ = bucketed(docs.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    w = Window.partitionBy("cell", "sub").orderBy("doc_id", F.xxhash64("text"))
    rows = rows.select("cell", "sub", "cell_before", "sub_before", "doc_id", "text", F.row_number().over(w).alias("nth"), F.lead("text").over(w).alias("next_text"))
    inner = Window.partitionBy("cell").orderBy("sub")
    first = rows.where("nth = 1").select("cell", "cell_before", "sub_before", F.lag("sub").over(inner).alias("sub_left"), F.col("text").alias("first_text"))
    first = first.select(
        F.when(F.col("sub_left").isNull(), F.col("cell_before")).otherwise(F.col("cell")).alias("cell"),
        F.coalesce("sub_left", "sub_before").alias("sub"), F.lit(True).alias("last"), "first_text")
    rows = rows.withColumn("last", F.col("next_text").isNull()).drop("cell_before", "sub_before").join(first, ["cell", "sub", "last"], "left")
    rows = rows.withColumn("next_text", F.coalesce("next_text", "first_text")).withColumn("own", sketch(F.col("text"), fraction))
    order = Window.partitionBy("cell", "sub").orderBy("doc_id", "nth")
    rows = rows.withColumn("following", F.lead("own").over(order))
    rows = rows.withColumn("following", F.when(F.col("following").isNull(), sketch(F.col("next_text"), fraction)).otherwise(F.col("following")))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited_text", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited", sketch(F.col("edited_text"), fraction))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited")).cast("double").alias("near_edited"),
        likeness(F.col("own"), F.col("following")).cast("double").alias("near_next"))
