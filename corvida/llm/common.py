"""Shared pieces of the corpus operators: written tables, Arrow text slices, vectorised byte hashing.

Hashing works on the raw UTF-8 bytes of many documents at once. A prefix sum of table[byte] * B**position modulo 2**64
gives the hash of any span in constant time, because B is odd and so has an inverse.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
WS_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

ARROW_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``, or one of our own on a local master only."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="corvida-shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; it goes with :func:`dropped`, or when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corvida-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in ARROW_LIMITS}
    for k, most in ARROW_LIMITS.items():  # whole texts travel in these batches: a few MB each
        spark.conf.set(k, str(most if before[k] is None or int(before[k].rstrip("b") or 0) <= 0 else min(int(before[k].rstrip("b")), most)))
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    p, files = _folder(spark, path)
    files.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def dropped(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` whose last reader has been written itself."""
    for t in tables:
        p, files = _folder(t.sparkSession, t._written_at)
        files.delete(p, True)
    tables[0].sparkSession.sparkContext._jvm.System.gc()  # the shuffles behind them go once their plans are collected


# What a reused Python worker keeps from an earlier operator; the scans of other operators let it go first.
KEPT: list[Callable[[], bool]] = []


def forget() -> None:
    """Clear what other operators keep in this worker and hand the memory back."""
    if any([clear() for clear in KEPT]):
        trim()


def trim() -> None:
    """Hand freed memory of this worker back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def text_slices(col: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, local offsets) of consecutive rows holding about ``limit`` bytes; null text is empty."""
    forget()
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bit mixer over uint64."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


BASE = 0x9E3779B97F4A7C15
STEP = 1 << 16


def _powers(b: int) -> np.ndarray:
    x = np.full(STEP, b, dtype=np.uint64)
    x[0] = 1
    return np.cumprod(x, dtype=np.uint64)


UP, DOWN = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))  # one pair for all seeds, 1 MB together


class SpanHash:
    """Prefix hashes of one byte buffer; ``span`` hashes any slices of it, equal bytes giving equal values.

    Powers beyond ``STEP`` are the product of one inside the table and one per block of ``STEP`` bytes."""

    def __init__(self, buf: np.ndarray, seed: int = 1, fold: np.ndarray | None = None):
        n = len(buf)
        table = mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD1B54A32D192ED03) + U64(seed))
        if fold is not None:
            table = table[fold]
        blocks = n // STEP + 1
        self.down = np.array([pow(BASE, -STEP * k, 1 << 64) for k in range(blocks)], dtype=np.uint64)
        self.pre = np.zeros(n + 1, dtype=np.uint64)
        values = self.pre[1:]
        for k in range(blocks):
            part = buf[k * STEP : (k + 1) * STEP]
            values[k * STEP : k * STEP + len(part)] = table[part] * UP[: len(part)] * U64(pow(BASE, STEP * k, 1 << 64))
        np.cumsum(values, out=values)

    def raw(self, start, end) -> np.ndarray:
        return (self.pre[end] - self.pre[start]) * DOWN[start % STEP] * self.down[start // STEP]

    def span(self, start, end) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * U64(0xA0761D6478BD642F))


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs without ASCII white space), and the first word's number of each document (n + 1)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~SPACE[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    before = np.concatenate(([False], solid[:-1]))
    after = np.concatenate((solid[1:], [False]))
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def id_bitmap(ids: DataFrame, column: str, max_bits: int = 1 << 28) -> tuple[np.ndarray, int]:
    """Bitmap of hashed ids, at most ``max_bits`` long; false positives grow beyond that size, misses never happen."""
    bits = min(max_bits, 1 << max(16, (16 * ids.count()).bit_length()))
    slot = (F.xxhash64(column).bitwiseAND(F.lit(bits - 1)) + 1).alias("slot")
    pieces = ids.select(slot).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("piece"))
    bitmap = np.zeros(bits // 8, dtype=np.uint8)
    for r in pieces.collect():
        at = (r["bucket"] - 1) * 4096
        part = np.frombuffer(bytes(r["piece"]), dtype=np.uint8)[: len(bitmap) - at]
        bitmap[at : at + len(part)] = part
    return bitmap, bits


def id_slot(column: str, bits: int) -> Column:
    """The bit of a bitmap of :func:`id_bitmap` that stands for the id."""
    return F.xxhash64(column).bitwiseAND(F.lit(bits - 1))


def maybe_in(df: DataFrame, column: str, bitmap: np.ndarray, bits: int) -> Column:
    """False only where the id is certainly not in the bitmap."""
    sent = df.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def probe(slot: pa.Array) -> pa.Array:
        s = slot.to_numpy(zero_copy_only=False)
        return pa.array((sent.value[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1)

    return probe(id_slot(column, bits))
