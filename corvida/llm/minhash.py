"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

Sketch of a shingle set, of t coordinates: in round i < t every shingle is hashed to one bin, in rounds i >= t to bin i - t; a
bin keeps its smallest (round, hash). Rounds end once every bin is filled, so all coordinates are filled however small the
set, and two sets agree on a coordinate with the probability of their resemblance. Bands of r coordinates give the buckets.

Links are found without listing the pairs of a bucket. Equal sets collapse into one class first. Each bucket compares its
members with one pivot, the member that shares the most buckets' rows; a bucket whose members are then in one component
is done. The others get further pivots. In what is still open, the members outside a bucket's largest component are
compared with all its members, in blocks of bounded size whose common shingles come from one matrix product; a block returns
links between different components only. Every link is confirmed on full shingle sets. Only documents that take part in a
comparison are read again for their sets; they are recognised by a bitmap of bounded size.

At threshold 0.85, 40 bands of 6 coordinates miss a linked pair with a chance below 1e-8.

Defined cases: null or word-free text has no shingles and is linked with nothing; fewer words than a shingle make one
shingle; equal texts are one class; rows without an id are compared with nothing and stay in ``drop_near_copies``;
repeated ids are one document; an empty table gives no rows; other columns are
carried untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import LOWER, U64, SpanHash, as_long, id_bitmap, maybe_in, mix, text_slices, word_bounds, written

WORDS = 5
PERCENT = 85
BANDS, ROWS = 40, 6
LOT, LOT_SHINGLES = 128, 1 << 18


def shingles(buf: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document, and the first one's number of each document (n + 1)."""
    starts, ends, first = word_bounds(buf, off)
    docs = len(off) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    w = SpanHash(buf, 11, LOWER).span(starts, ends)
    count = np.diff(first)
    n = np.where(count == 0, 0, np.maximum(count - words + 1, 1))
    of = np.repeat(np.arange(docs), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    size = np.minimum(count, words)[of]
    h = size.astype(np.uint64)
    for k in range(words):
        have = k < size
        h = np.where(have, mix(h * U64(0x9E3779B97F4A7C15) + w[np.minimum(at + k, len(w) - 1)]), h)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(docs + 1))


def sketches(h: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """(documents, t) sketch values; documents without shingles keep the empty mark."""
    docs = len(first) - 1
    empty = np.iinfo(np.uint64).max
    out = np.full(docs * t, empty, dtype=np.uint64)
    of = np.repeat(np.arange(docs), np.diff(first))
    for i in range(2 * t):
        if not len(h):
            break
        v = mix(h + U64((i + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))
        bin_ = ((v >> U64(44)) * U64(t) >> U64(20)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, of * t + bin_, U64(i << 52) | (v & U64((1 << 44) - 1)))
        if i < 2 or i % 4 == 0 or i >= t:
            full = (out.reshape(docs, t) != empty).all(axis=1)
            if full[of[0]] or full[of].any():
                stay = ~full[of]
                h, of = h[stay], of[stay]
    return out.reshape(docs, t)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets), bands (array of band hashes)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, buf, off in text_slices(batch.column(1)):
                h, first = shingles(buf, off)
                n = np.diff(first)
                total = np.concatenate(([U64(0)], np.cumsum(mix(h ^ U64(0x5851F42D4C957F2D)), dtype=np.uint64)))
                key = mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64))
                s = sketches(h, first, bands * rows).reshape(b - a, bands, rows)
                band = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (b - a, bands)).copy()
                for k in range(rows):
                    band = mix(band * U64(0x9E3779B97F4A7C15) ^ s[:, :, k])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * bands + 1, bands), pa.int32()), pa.array(as_long(band.ravel())))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n), pa.array(as_long(key)), lists], names=["doc_id", "n_shingles", "set_key", "bands"])

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, set_key long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, shingles (sorted 64-bit hashes as bytes) of the wanted ids; the scan skips others by a bitmap."""
    bitmap, bits = id_bitmap(wanted, "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    slot = F.xxhash64("doc_id").bitwiseAND(F.lit(bits - 1))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(2).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero((sent.value[s >> 3] >> (s & 7).astype(np.uint8)) & 1)
            if not len(hit):
                continue
            batch = batch.take(pa.array(hit))
            ids = batch.column(0)
            for a, b, buf, off in text_slices(batch.column(1)):
                h, first = shingles(buf, off)
                raw = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(8 * first.astype(np.int64)), pa.py_buffer(h)])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), raw.cast(pa.binary())], names=["doc_id", "shingles"])

    found = docs.select("doc_id", "text", slot.alias("slot")).mapInArrow(take, "doc_id long, shingles binary")
    return found.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def lots_of(n: Column, shingles: Column) -> Column:
    """Number of lots for ``n`` sets: a lot holds about ``LOT`` members and ``LOT_SHINGLES`` shingles (one longer set is its own lot)."""
    return F.ceil(F.greatest(n / LOT, shingles / LOT_SHINGLES)).cast("int")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """u, v of the pairs (hub, node, n_shingles of the node) whose full sets share at least ``percent`` of their union.

    The texts, which compress well, meet the list of lots they belong to; a set is made there and sent once to each of its
    pairs. A hub's nodes are cut into lots of bounded size, and the hub's set goes to each of them."""
    hubs = pairs.groupBy("hub").agg(lots_of(F.count(F.lit(1)), F.sum("n_shingles")).alias("lots"))
    hubs = written(hubs)
    nodes = pairs.join(hubs, "hub").select(F.col("node").alias("of"), "hub", F.pmod(F.xxhash64("node"), F.col("lots")).cast("int").alias("lot"))
    sides = nodes.unionByName(hubs.select(F.col("hub").alias("of"), "hub", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot")))
    asked = written(sides.groupBy("of").agg(F.collect_list(F.struct("hub", "lot")).alias("lots")))
    bitmap, bits = id_bitmap(asked, "of")
    texts = docs.where(maybe_in(docs, "doc_id", bitmap, bits)).dropDuplicates(["doc_id"]).join(asked, F.col("doc_id") == F.col("of"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 4, kinds)], names=["hub", "lot", "node", "shingles"])

        for batch in batches:
            ids, lots = batch.column(0).to_pylist(), batch.column(2)
            for a, b, buf, off in text_slices(batch.column(1)):
                h, first = shingles(buf, off)
                rows, held = [], 0
                for i in range(a, b):
                    own = h[first[i - a] : first[i - a + 1]].tobytes()
                    for r in lots[i].as_py():
                        rows.append((r["hub"], r["lot"], ids[i], own))
                        held += len(own)
                        if held > 1 << 22:
                            yield made(rows)
                            rows, held = [], 0
                yield made(rows)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for u, v, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                b = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                if u == v:
                    hub, own = u, b.copy()
                elif u == hub and len(own) and len(b):
                    common = int((b[np.minimum(np.searchsorted(b, own), len(b) - 1)] == own).sum())
                    if 100 * common >= percent * (len(own) + len(b) - common):
                        out.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out)) or [[]] * 2], names=["u", "v"])

    sets = texts.select("doc_id", "text", "lots").mapInArrow(send, "hub long, lot int, node long, shingles binary")
    lots = sets.repartition("hub", "lot").sortWithinPartitions("hub", "lot", F.col("node") != F.col("hub"))  # a lot begins with its hub
    return written(lots.mapInArrow(compare, "u long, v long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node id of each component, by alternating stars; nodes without edges are absent.

    Aggregated tables are written before they are joined, so that a hub's rows can be split among tasks."""
    e = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    signed = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = signed(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = written(both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct())
        low = written(large.groupBy("v").agg(F.min("u").alias("m")))
        small = large.join(low, "v").select(F.col("m").alias("v0"), F.col("u").alias("x")).where("v0 <> x").unionByName(low.select(F.col("m").alias("v0"), F.col("v").alias("x")))
        e = written(small.select(F.col("v0").alias("u"), F.col("x").alias("v")).distinct())
        sign = signed(e)
        if sign == before:
            break
        before = sign
    return written(e.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()))


def block_links(left: list[tuple], right: list[tuple], percent: int, columns: int = 8192) -> list[tuple[int, int]]:
    """Links (u, v) between members (node, component, sorted shingles) of two blocks, one for each row and other component."""
    sizes = [np.array([len(m[2]) for m in side], dtype=np.float32) for side in (left, right)]
    flat = [np.concatenate([m[2] for m in side]) for side in (left, right)]
    of = [np.repeat(np.arange(len(side)), sz.astype(int)) for side, sz in zip((left, right), sizes)]
    both = np.intersect1d(*(np.unique(f) for f in flat), assume_unique=True)
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    where = [np.searchsorted(both, f) for f in flat]
    hit = [(w < len(both)) & (both[np.minimum(w, max(len(both) - 1, 0))] == f) if len(both) else np.zeros(len(f), bool) for w, f in zip(where, flat)]
    for low in range(0, len(both), columns):
        width = min(columns, len(both) - low)
        parts = []
        for side, w, h, o in zip((left, right), where, hit, of):
            use = h & (w >= low) & (w < low + width)
            m = np.zeros((len(side), width), dtype=np.float32)
            m[o[use], w[use] - low] = 1
            parts.append(m)
        common += parts[0] @ parts[1].T
    exact = np.rint(common).astype(np.int64)
    union = sizes[0][:, None].astype(np.int64) + sizes[1][None, :].astype(np.int64) - exact
    component = [np.array([m[1] for m in side]) for side in (left, right)]
    linked = (100 * exact >= percent * union) & (component[0][:, None] != component[1][None, :])
    out = []
    for i in np.flatnonzero(linked.any(axis=1)):
        j = np.flatnonzero(linked[i])
        _, one = np.unique(component[1][j], return_index=True)
        out += [(min(left[i][0], right[k][0]), max(left[i][0], right[k][0])) for k in j[one]]
    return out


def open_links(member: DataFrame, docs: DataFrame, percent: int, block: int = 128, shingles_at_once: int = 1 << 18) -> DataFrame:
    """Links across components inside the buckets that pivots left open; ``member`` has band, node, n_shingles, component.

    A block holds about ``block`` members and ``shingles_at_once`` shingles (one longer set is a block of its own size)."""
    sets = written(shingle_sets(docs, written(member.select(F.col("node").alias("doc_id")).distinct())))
    per = written(member.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s")))
    bands = per.groupBy("band").agg(F.max(F.struct("n", "component", "s")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    cuts = lambda n, s: F.ceil(F.greatest(n / block, s / shingles_at_once)).cast("long")
    rest = cuts(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s"))
    bands = written(bands.select("band", F.col("top.component").alias("top"), cuts(F.col("n"), F.col("s")).alias("blocks"), rest.alias("few")))
    rows = member.select("band", "node", "component").join(bands, "band").join(sets.withColumnRenamed("doc_id", "node"), "node")
    cell = F.collect_list(F.struct("node", "component", "shingles"))
    every = rows.groupBy("band", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("no")).agg(cell.alias("y")).select("band", "y")
    rest = rows.where("component <> top").groupBy("band", F.pmod(F.xxhash64("node"), F.col("few")).alias("no")).agg(cell.alias("x")).select("band", "x")

    @F.arrow_udf("array<struct<u: long, v: long>>")
    def compare(x: pa.Array, y: pa.Array) -> pa.Array:
        def block_of(c):
            v = c.values
            return [(n, k, np.frombuffer(b.as_buffer(), dtype=np.uint64)) for n, k, b in zip(v.field(0).to_pylist(), v.field(1).to_pylist(), v.field(2))]

        kind = pa.list_(pa.struct([("u", pa.int64()), ("v", pa.int64())]))
        return pa.array([[{"u": u, "v": v} for u, v in block_links(block_of(p), block_of(q), percent)] for p, q in zip(x, y)], kind)

    pairs = written(rest).join(written(every), "band").select(F.explode(compare("x", "y")).alias("e"))
    return written(pairs.select("e.u", "e.v").distinct())


def near_groups(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, pivots: int = 1, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signs = written(signatures(docs, bands, rows))
    classes = written(signs.where("n_shingles > 0").groupBy("set_key", "n_shingles").agg(F.min("doc_id").alias("node")))
    kept = signs.where("n_shingles > 0").join(classes, ["set_key", "n_shingles"]).where("doc_id = node").dropDuplicates(["doc_id"])
    member = written(kept.select("node", "n_shingles", "bands")).select("node", "n_shingles", F.explode("bands").alias("band"))
    bucket = written(member.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    bitmap, bits = id_bitmap(bucket, "band")
    member = written(member.where(maybe_in(member, "band", bitmap, bits)).join(bucket, "band"))
    degree = written(member.groupBy("node").agg(F.sum("n").alias("degree")))
    member = written(member.drop("n").join(degree, "node"))
    edges = None
    for i in range(pivots):
        by = F.struct(-F.col("degree"), "node") if i == 0 else F.xxhash64("node", F.lit(i))
        pivot = written(member.groupBy("band").agg(F.min_by(F.struct("node", "n_shingles", *(["component"] if i else [])), by).alias("pivot")))
        far = member.join(pivot, "band").where(F.col("component") != F.col("pivot.component") if i else F.col("node") != F.col("pivot.node"))
        small, large = F.least("pivot.n_shingles", "n_shingles"), F.greatest("pivot.n_shingles", "n_shingles")
        pairs = written(far.where(100 * small >= percent * large).select(F.col("pivot.node").alias("hub"), "node", "n_shingles").distinct())
        found = confirmed(pairs, docs, percent)
        edges = found if edges is None else written(edges.unionByName(found))
        label = components(edges)
        member = _open_members(member, label)
        if not member.take(1):
            break
    else:
        more = open_links(member, docs, percent)
        if more.take(1):  # stars of the components found so far, and the links across them
            label = components(label.select(F.col("component").alias("u"), F.col("node").alias("v")).unionByName(more))
    top = classes.join(label, "node", "left").select("set_key", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    out = signs.select("doc_id", "n_shingles", "set_key").join(written(top), ["set_key", "n_shingles"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _open_members(member: DataFrame, label: DataFrame) -> DataFrame:
    """Members, with their component, of the buckets that hold more than one component."""
    named = member.drop("component").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = written(named.select("band", "node", "n_shingles", "degree", "component"))
    split = written(named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band"))
    return written(named.join(split, "band"))


def drop_near_copies(docs: DataFrame, ident: str = "doc_id", text: str = "text", **args) -> DataFrame:
    """``docs`` without all but the first document of each near-duplicate group."""
    gone = written(near_groups(docs, ident=ident, text=text, **args).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(ident).cast("long").alias("id"))
    return rows.join(gone, rows["id"] == gone["_gone"], "left_anti").select("row.*")
