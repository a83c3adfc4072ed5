"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are gathered from all training documents. Frequent words (at most ``TABLE_WORDS``) keep exact
counts in a small table; rarer words and all pairs, those seen once too, go to the filter as quantised counts: an n-gram of
level q is entered with 1, 2, ..., q appended, and its level is read back by probing 1, 2, ... until one is missing. Levels
are powers of two. All probes of an n-gram fall into one block of the filter, so tasks build whole blocks without merging.
The filter is broadcast in segments of at most ``SEGMENT_BLOCKS`` blocks (128 MB); a larger filter takes several passes, each
adding the levels of its own blocks to the documents, so memory stays bounded and the result is the same.

P(w|v) = a(v) c(vw) / c(v) + (1 - a(v)) c(w) / (N + (V + 1) / 2), with c rounded down above and up below the bar, one half for
an unseen word, and a(v) = a for words seen twice, else 0. The trust a is learnt: one less the share of training pairs that
occur once, which estimates how often the next pair is one seen before. So the probabilities of a context never sum above one
but for the filter's false hits (about one in a hundred pairs).

The base score needs exact counts of all words: frequent ones come from the table, the tokens of the others are joined
with the count table, one row per document and word.

Defined cases: null text is empty, which is the end token alone; a null id is a training row; without training documents N
and V are 0 and the base of every token is log10(0.5 / 0.5) = 0; repeated rows are scored each and count each; an empty
table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import LOWER, U64, SpanHash, as_long, mix, text_slices, word_bounds, written

TABLE_WORDS = 1 << 19
BLOCK_BITS = 1 << 20
SEGMENT_BLOCKS = 1024
BITS_PER_ENTRY, PROBES, MAX_LEVEL = 10, 4, 40
END = U64(0x2545F4914F6CDD1D)
START = U64(0x27BB2EE687B0B0FD)


def token_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with one end token after each document, and each document's first token number."""
    starts, ends, first = word_bounds(buf, off)
    w = SpanHash(buf, 31, LOWER).span(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    docs = len(off) - 1
    return np.insert(w, first[1:], END), first + np.arange(docs + 1)


def pair_hashes(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of (previous, own) for every token, and the previous tokens."""
    before = np.concatenate(([START], tokens[:-1])) if len(tokens) else tokens
    before[first[:-1]] = START
    return mix(before * U64(0x9E3779B97F4A7C15) ^ mix(tokens + U64(0x632BE59BD9B4E019))), before


def is_held_out(ident):
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def ngram_counts(training: DataFrame) -> DataFrame:
    """pair, key, n: counts of words and pairs over the texts, added up within each slice before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, off in text_slices(batch.column(0)):
                tokens, first = token_hashes(buf, off)
                for pair, keys in ((False, tokens), (True, pair_hashes(tokens, first)[0])):
                    keys, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), pair)), pa.array(as_long(keys)), pa.array(n)], names=["pair", "key", "n"])

    return training.mapInArrow(count, "pair boolean, key long, n long").groupBy("pair", "key").agg(F.sum("n").alias("n"))


def probes(key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(key + U64(level * 0xA24BAED4963EE407 % (1 << 64)))
    return a, (a >> U64(32)) | U64(1)


def block_of(key: np.ndarray, blocks: int) -> np.ndarray:
    return ((mix(key) >> U64(32)) * U64(blocks) >> U64(32)).astype(np.int64)


def build_filter(entries: DataFrame, n_entries: int) -> tuple[DataFrame, int]:
    """(block, bits) rows of the filter, and the number of blocks; ``entries`` has key, level."""
    blocks = max(1, -(-n_entries * BITS_PER_ENTRY // BLOCK_BITS))

    @F.arrow_udf("long")
    def block(key: pa.Array) -> pa.Array:
        return pa.array(block_of(key.to_numpy(zero_copy_only=False).view(np.uint64), blocks))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits = None, None
        for batch in batches:
            no, key, level = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            cut = np.flatnonzero(np.diff(no)) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(no)]):
                if s == e:
                    continue
                if no[s] != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pydict({"block": [at], "bits": [np.packbits(bits, bitorder="little").tobytes()]})
                    at, bits = int(no[s]), np.zeros(BLOCK_BITS, dtype=bool)
                k, lv = key[s:e].view(np.uint64), level[s:e]
                for j in range(1, int(lv.max()) + 1):
                    a, b = probes(k[lv >= j], j)
                    for i in range(PROBES):
                        bits[((a + U64(i) * b) & U64(BLOCK_BITS - 1)).astype(np.int64)] = True
        if at is not None:
            yield pa.RecordBatch.from_pydict({"block": [at], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    placed = entries.select(block("key").alias("block"), "key", F.col("level").cast("long").alias("level"))
    spread = placed.repartition(F.col("block")).sortWithinPartitions("block")
    return written(spread.mapInArrow(build, "block long, bits binary")), blocks


def levels(key: np.ndarray, segment: np.ndarray, low: int, blocks: int) -> np.ndarray:
    """Levels of the keys whose block lies in the segment (blocks from ``low`` on), 0 for others."""
    out = np.zeros(len(key), dtype=np.uint8)
    no = block_of(key, blocks) - low
    live = np.flatnonzero((no >= 0) & (no < len(segment) * 8 // BLOCK_BITS))
    for j in range(1, MAX_LEVEL + 1):
        a, b = probes(key[live], j)
        base = no[live] * BLOCK_BITS
        for i in range(PROBES):
            at = base + ((a + U64(i) * b) & U64(BLOCK_BITS - 1)).astype(np.int64)
            hit = (segment[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            live, a, b, base = live[hit], a[hit], b[hit], base[hit]
        if not len(live):
            break
        out[live] = j
    return out


def token_levels(tokens: np.ndarray, first: np.ndarray, old: pa.Array, segment: np.ndarray, low: int, blocks: int) -> np.ndarray:
    """(tokens, 2) levels of each token's pair and word: the segment's own and those of earlier segments."""
    words, inside = np.unique(tokens, return_inverse=True)
    own = levels(words, segment, low, blocks)[inside]
    pair = levels(pair_hashes(tokens, first)[0], segment, low, blocks)
    both = np.stack((pair, own), axis=1)
    if old.null_count == 0:
        both = np.maximum(both, np.frombuffer(b"".join(x.as_py() for x in old), dtype=np.uint8).reshape(-1, 2))
    return both


def with_levels(docs: DataFrame, segment: np.ndarray, low: int, blocks: int) -> DataFrame:
    """Adds the segment's part to ``levels``: for every token the level of its pair, then the level of its word."""
    sent = docs.sparkSession.sparkContext.broadcast(segment)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for a, b, buf, off in text_slices(batch.column(names.index("text"))):
                tokens, first = token_hashes(buf, off)
                flat = token_levels(tokens, first, batch.column(names.index("levels")).slice(a, b - a), sent.value, low, blocks).ravel()
                made = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(2 * first.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
                piece = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([made if n == "levels" else piece.column(i) for i, n in enumerate(names)], names=names)

    return docs.mapInArrow(probe, docs.schema)


def score_documents(docs: DataFrame, table_words: int = TABLE_WORDS, segment_blocks: int = SEGMENT_BLOCKS, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), is_held_out(F.col(ident)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = written(ngram_counts(rows.where("NOT held_out").select("text")))
    words = counts.where("NOT pair").select("key", "n")
    one = F.count_if(F.col("pair") & (F.col("n") == 1))
    total, distinct, once = counts.agg(F.coalesce(F.sum(F.when(~F.col("pair"), F.col("n"))), F.lit(0)), F.count_if(~F.col("pair")), one).first()
    believed = 1 - once / total if total else 0.0  # every token ends one pair, so N counts the pairs too

    frequency = sorted(((r["n"], r["words"]) for r in words.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    least, held = (1 << 62), 0
    for n, w in frequency:
        if held + w > table_words:
            break
        least, held = n, held + w
    top = words.where(F.col("n") >= least).toArrow()
    key = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    table = (key[order], top.column("n").to_numpy()[order])

    rare = words.where(F.col("n") < least)
    level = (F.floor(F.log2("n") + 1e-9)).cast("long")
    entries = rare.select("key", (level + 1).alias("level")).unionByName(counts.where("pair").select("key", (level + 1).alias("level")))
    n_entries = entries.agg(F.coalesce(F.sum("level"), F.lit(0))).first()[0]
    parts, blocks = build_filter(entries, n_entries)

    def segment_of(low: int) -> np.ndarray:
        bits = np.zeros(min(segment_blocks, blocks - low) * BLOCK_BITS // 8, dtype=np.uint8)
        for r in parts.where((F.col("block") >= low) & (F.col("block") < low + segment_blocks)).collect():
            at = (r["block"] - low) * BLOCK_BITS // 8
            bits[at : at + BLOCK_BITS // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
        return bits

    state = rows.withColumn("levels", F.lit(None).cast("binary"))
    *earlier, last = range(0, blocks, segment_blocks)
    for low in earlier:
        state = written(with_levels(state, segment_of(low), low, blocks))
    probed = docs.sparkSession.sparkContext.broadcast(segment_of(last))  # the scoring pass probes the last segment itself
    sent = docs.sparkSession.sparkContext.broadcast(table)
    below = float(total + 0.5 * (distinct + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ns = sent.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            names = batch.schema.names
            raw_levels = batch.column(names.index("levels"))
            for a, b, buf, off in text_slices(batch.column(names.index("text"))):
                tokens, first = token_hashes(buf, off)
                words_, inside = np.unique(tokens, return_inverse=True)
                at = np.minimum(np.searchsorted(keys, words_), max(len(keys) - 1, 0))
                in_table = keys[at] == words_ if len(keys) else np.zeros(len(words_), bool)
                exact = np.where(in_table, ns[at] if len(ns) else 0, 0)
                lv = token_levels(tokens, first, raw_levels.slice(a, b - a), probed.value, last, blocks)
                pair, own = lv[:, 0].astype(float), lv[:, 1].astype(float)
                known = in_table[inside]
                n_low = np.where(known, exact[inside], np.where(own > 0, 2.0 ** (own - 1), 0.0))
                n_high = np.where(known, exact[inside], np.where(own > 0, 2.0**own, 0.0))
                before = np.concatenate(([0.0], n_high[:-1]))
                before[first[:-1]] = 0.0
                low_before = np.concatenate(([0.0], n_low[:-1]))
                low_before[first[:-1]] = 0.0
                trust = np.where(low_before >= 2, believed, 0.0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    seen = np.where((pair > 0) & (trust > 0), np.minimum(2.0 ** (pair - 1) / before, 1.0), 0.0)
                p = trust * seen + (1 - trust) * np.maximum(n_low, 0.5) / below

                def per_doc(v):
                    c = np.concatenate(([0.0], np.cumsum(v)))
                    return c[first[1:]] - c[first[:-1]]

                base = per_doc(np.where(known, np.log10((exact[inside] + 0.5) / below), 0.0))
                lost = np.flatnonzero(~known)
                doc = np.repeat(np.arange(b - a), np.diff(first))[lost]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)), pa.array(as_long(tokens[lost])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(b - a)), batch.column(names.index("doc_id")).slice(a, b - a), batch.column(names.index("held_out")).slice(a, b - a), pa.array(np.diff(first)),
                     pa.array(per_doc(known).astype(np.int64)), pa.array(base), pa.array(per_doc(np.log10(p))), lists],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "others"])
                row += b - a

    scored = written(state.mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, others array<long>"))
    others = scored.select("row", F.explode("others").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("times"))
    found = others.join(rare, "key", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(below))).alias("extra"))
    out = scored.join(found, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("extra", F.lit(0.0))).alias("base_score"), "score")
