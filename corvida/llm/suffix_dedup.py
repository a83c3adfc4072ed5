"""Repeated passages by prefix-free parsing.

A text is cut where a rolling hash of ``GRAM`` bytes is the smallest of ``SPAN`` in a row. Every window of ``WINDOW`` bytes holds
such a trigger at a place that its own bytes decide, so equal windows fall into phrases with the same trigger, wherever
they stand. A phrase is the run of windows of one trigger; its core is what all those windows share.

No suffix array is built and nothing is ordered: the deletion rule only asks which suffixes agree on their first ``WINDOW``
bytes, and grouping the windows by fingerprints answers that. So

1. phrases whose core stands alone have no repeat and leave;
2. phrases that occur twice as a whole are repeated in every window;
3. the windows of the other phrases, one copy per distinct phrase, are grouped by (core, window fingerprint), and groups of
   two and more are repeats.

All grouping is by aggregates with partial sums and by joins against written tables, so a passage of thousands of
documents is one row after the first step. Texts are shuffled only for documents that have repeats, found by a bitmap of
bounded size.

Defined cases: null text is empty; texts shorter than the window keep all bytes; a row repeated with the same id repeats its
windows; an empty table gives no rows; other columns are carried untouched by ``drop_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import U64, SpanHash, as_long, id_bitmap, maybe_in, mix, text_slices, trim, written

WINDOW, GRAM, SPAN = 400, 16, 200
LOW32 = U64((1 << 32) - 1)


def sliding_min(v: np.ndarray, m: int) -> np.ndarray:
    """Smallest of each m values in a row."""
    n = len(v) - m + 1
    padded = np.full(-(-len(v) // m) * m, np.iinfo(v.dtype).max, dtype=v.dtype)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, m)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[m - 1 : m - 1 + n])


def phrases(buf: np.ndarray, off: np.ndarray, window: int, gram: int, span: int):
    """(document, start, windows, core hash, phrase hash) of every phrase; starts count from the buffer's begin."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    lengths = np.diff(off)
    long_enough = np.flatnonzero(lengths >= window)
    valid = np.zeros(n + 2, dtype=np.int8)
    valid[off[long_enough]] = 1
    np.subtract.at(valid, off[long_enough + 1] - window + 1, 1)
    valid = np.cumsum(valid, dtype=np.int8)[: n - window + 1].astype(bool)
    h = SpanHash(buf, 3)
    at = np.arange(n - gram + 1)
    v = mix(h.raw(at, at + gram)) & ~LOW32 | at.astype(np.uint64)
    before = (window - gram - span) // 2
    anchor = (sliding_min(v, span)[before : before + n - window + 1] & LOW32).astype(np.int64)
    del v, at
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    begin = off[long_enough]
    new[begin] = True
    start = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= new[1:] | ~valid[1:]
    end = np.flatnonzero(stop) + 1
    core = anchor[start] - before
    doc = np.searchsorted(off, start, side="right") - 1
    whole = mix(h.span(start, end - 1 + window) ^ mix((core - start).astype(np.uint64)))
    return doc, start - off[doc], end - start, h.span(core, core - span + 1 + window), whole


def keyed(docs: DataFrame, ident: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(F.col(ident), t).alias("uid"), t.alias("text"))


def parse(keyed_docs: DataFrame, window: int = WINDOW, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """uid, start, windows, core, phrase: one row per phrase of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, buf, off in text_slices(batch.column(1)):
                doc, start, n, core, whole = phrases(buf, off, window, gram, span)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + doc]), pa.array(start), pa.array(n.astype(np.int32)), pa.array(as_long(core)), pa.array(as_long(whole))],
                                                 names=["uid", "start", "windows", "core", "phrase"])
        trim()  # an idle worker holds no more than its modules

    return keyed_docs.mapInArrow(cut, "uid long, start long, windows int, core long, phrase long")


def suffixes(texts: DataFrame, window: int) -> DataFrame:
    """core, name, uid, start: the windows of the listed phrases; ``texts`` has uid, text, list of (start, windows, core)."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0).to_pylist()
            lists = batch.column(2)
            for a, b, buf, off in text_slices(batch.column(1)):
                part = lists.slice(a, b - a)
                rows = part.flatten()
                n_rows = np.diff(part.offsets.to_numpy())
                start, windows, core = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                doc = np.repeat(np.arange(b - a), n_rows)
                of = np.repeat(np.arange(len(start)), windows)
                step = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
                local = start[of] + step
                at = local + off[doc[of]]
                named = SpanHash(buf, 7).span(at, at + window)
                ids = np.array(uid[a:b], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(core[of]), pa.array(as_long(named)), pa.array(ids[doc[of]]), pa.array(local)], names=["core", "name", "uid", "start"])
        trim()

    return texts.mapInArrow(name, "core long, name long, uid long, start long")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """uid, spans (byte ranges that windows with a second occurrence cover, not yet merged)."""
    table = written(parse(docs, window, gram, span))
    cores = written(table.groupBy("core").agg(F.count(F.lit(1)).alias("n"), (F.min("phrase") != F.max("phrase")).alias("mixed")).where("n > 1").drop("n"))
    bitmap, bits = id_bitmap(cores, "core")
    shared = written(table.where(maybe_in(table, "core", bitmap, bits)).join(cores, "core"))
    one = F.min(F.struct("uid", "start", "windows"))
    whole = written(shared.where("mixed").groupBy("core", "phrase").agg(F.count(F.lit(1)).alias("n"), one.alias("one")))
    certain = shared.where("NOT mixed").select("uid", "start", "windows").unionByName(
        shared.where("mixed").join(whole.where("n > 1").select("core", "phrase"), ["core", "phrase"]).select("uid", "start", "windows"))
    spans = certain.select("uid", "start", (F.col("start") + F.col("windows") - 1 + window).alias("end"))

    lists = written(whole.select("core", "one.*").groupBy("uid").agg(F.collect_list(F.struct("start", "windows", "core")).alias("list")))
    bitmap, bits = id_bitmap(lists, "uid")
    texts = docs.where(maybe_in(docs, "uid", bitmap, bits)).dropDuplicates(["uid"]).join(lists, "uid").select("uid", "text", "list")
    named = written(suffixes(texts, window))
    again = written(named.groupBy("core", "name").count().where("count > 1").select("core", "name"))
    bitmap, bits = id_bitmap(again, "name")
    hit = named.where(maybe_in(named, "name", bitmap, bits)).join(again, ["core", "name"])
    spans = spans.unionByName(hit.select("uid", "start", (F.col("start") + window).alias("end")))
    return written(spans.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans")))


def merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching ranges."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.concatenate((first[1:] - 1, [len(start) - 1]))]


def _kept(raw: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    out, at = [], 0
    for s, e in zip(start.tolist(), end.tolist()):
        out.append(raw[at:s])
        at = e
    out.append(raw[at:])
    return b"".join(out)


def _with_spans(docs: DataFrame, keys: DataFrame, columns: list, window: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their spans, rows certainly without)."""
    spans = repeated_spans(keys, window=window)
    bitmap, bits = id_bitmap(spans, "uid")
    rows = docs.select(*columns)
    hit = maybe_in(rows, "uid", bitmap, bits)
    flagged = rows.withColumn("hit", hit)
    return flagged.where("hit").drop("hit").join(spans, "uid", "left"), flagged.where("NOT hit").drop("hit")


def repeated_bytes(docs: DataFrame, window: int = WINDOW, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows, clean = _with_spans(docs, keyed(docs, ident, text), [F.col(ident).cast("long").alias("doc_id"), t.alias("text"), F.xxhash64(F.col(ident), t).alias("uid")], window)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, t_, sp in zip(*(batch.column(k) for k in range(3))):
                raw = t_.as_py().encode()
                v = sp.values if sp.is_valid else None
                start, end = (np.zeros(0, np.int64),) * 2 if v is None else merge(*(v.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
                out.append((key.as_py(), len(raw), int((end - start).sum()), len(start), hashlib.sha256(_kept(raw, start, end)).hexdigest(), np.stack((start, end), axis=1).tolist()))
            cols = list(zip(*out)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    done = rows.select("doc_id", "text", "spans").mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")
    zero = F.lit(0).cast("long")
    rest = clean.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"),
                        F.array().cast("array<array<long>>").alias("spans"))
    return done.unionByName(rest)


def drop_repeats(docs: DataFrame, window: int = WINDOW, ident: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with the repeated passages cut from the text, whole characters only; ``length`` follows the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows, clean = _with_spans(docs, keyed(docs, ident, text), [whole, t.alias("text"), F.xxhash64(F.col(ident), t).alias("uid")], window)

    @F.arrow_udf("string")
    def strip(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t_, sp in zip(texts, spans):
            raw = t_.as_py().encode()
            if sp.is_valid:
                start, end = merge(*(sp.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
                lead = np.flatnonzero((np.frombuffer(raw + b" ", dtype=np.uint8) & 0xC0) != 0x80)
                start = lead[np.searchsorted(lead, start)]
                end = np.maximum(lead[np.searchsorted(lead, end, side="right") - 1], start)
                raw = _kept(raw, start, end)
            out.append(raw.decode())
        return pa.array(out, pa.string())

    def column(c: str, new):
        if c == text:
            return new.alias(c)
        if c == length:
            return F.char_length(new).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"row.`{c}`").alias(c)

    cut = rows.withColumn("new", strip("text", "spans"))
    return cut.select(*[column(c, F.col("new")) for c in docs.columns]).unionByName(clean.select("row.*"))
