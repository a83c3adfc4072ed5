"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups are equal texts and stay together. A group above a small share of one shard in any dimension is heavy; at most
3 * shards * ``heavy_parts`` groups can be, so their list is bounded. Heavy groups are placed one by one, other groups are gathered by
hash into a fixed number of bundles. Groups and bundles go, largest first, to the shard where the dot product of their vector with
the shard's residual capacity is highest among those with room. Only a heavy group that exceeds a
shard in some dimension, or for whose bytes even the emptiest shard lacks room, is split by row. Exchanges then even out the bytes, which is the law kept here; among exchanges that narrow the bytes the one that
also leaves tokens and rows closest is taken, until none narrows them.
Nothing larger than the table of bundles and parts of heavy groups reaches the driver.

Defined cases: null text has no bytes (size 8) and no tokens; an empty table gives no rows; repeated rows count each;
only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvida.llm.common import WORD_CLASS, written


def place_bundles(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item; ``vectors`` has the columns bytes, tokens, rows."""
    n = len(vectors)
    if not n:
        return np.zeros(0, dtype=np.int64)
    capacity = np.maximum(vectors.sum(axis=0) / shards, 1e-9)
    v = vectors / capacity
    residual = np.ones((shards, v.shape[1]))
    out = np.zeros(n, dtype=np.int64)
    for i in np.argsort(-v.sum(axis=1), kind="stable"):
        room = (residual >= v[i]).all(axis=1)
        score = np.where(room, residual @ v[i], -np.inf) if room.any() else residual.min(axis=1)
        s = int(np.argmax(score))
        out[i] = s
        residual[s] -= v[i]
    return even_out(vectors, out, shards)


def even_out(vectors: np.ndarray, shard: np.ndarray, shards: int) -> np.ndarray:
    """Move or exchange items between the fullest and the emptiest shard by bytes. Every step narrows their gap in bytes, so the
    sum of squared loads falls and the walk ends; of the steps that narrow it, the one with the smallest gaps in all three sizes is taken."""
    v = vectors.astype(np.int64)
    unit = np.maximum(v.sum(axis=0) / shards, 1e-9)
    load = np.zeros((shards, 3), dtype=np.int64)
    np.add.at(load, shard, v)
    members = [list(np.flatnonzero(shard == s)) for s in range(shards)]
    open_ = np.ones(shards, dtype=bool)  # shards that can still give
    while open_.any():
        hi, lo = int(np.argmax(np.where(open_, load[:, 0], -1))), int(np.argmin(load[:, 0]))
        gap = load[hi] - load[lo]
        if gap[0] <= 1:
            break
        if not members[hi]:
            open_[hi] = False
            continue
        a, b = np.array(members[hi]), np.array([-1, *members[lo]])
        vb = np.vstack((np.zeros((1, 3), dtype=np.int64), v[b[1:]]))
        order = np.argsort(vb[:, 0], kind="stable")
        at = np.searchsorted(vb[order, 0], v[a, 0] - gap[0] / 2)
        best = None
        for near in range(-2, 2):
            k = order[np.clip(at + near, 0, len(b) - 1)]
            left = np.abs(gap - 2 * (v[a] - vb[k]))
            cost = np.where(left[:, 0] < gap[0], (left / unit * (1.0, 0.1, 0.1)).sum(axis=1), np.inf)
            j = int(np.argmin(cost))
            if np.isfinite(cost[j]) and (best is None or cost[j] < best[0]):
                best = (cost[j], int(a[j]), int(b[k[j]]))
        if best is None:
            open_[hi] = False
            continue
        _, x, y = best
        for item, source, target in ((x, hi, lo), (y, lo, hi)):
            if item >= 0:
                members[source].remove(item)
                members[target].append(item)
                shard[item] = target
                load[source] -= v[item]
                load[target] += v[item]
    return shard


def without_room(groups: np.ndarray, capacity: np.ndarray, shards: int, slack: float) -> np.ndarray:
    """Groups that fit no shard: those above a shard in some dimension, and, largest first, those for whose bytes the emptiest
    shard has no room, but for ``slack`` of a shard."""
    size = groups[:, 0]
    out = (groups > capacity * (1 + slack)).any(axis=1)
    load = np.full(shards, size[out].sum() / shards)
    for i in np.argsort(-size, kind="stable"):
        if out[i]:
            continue
        s = int(np.argmin(load))
        out[i] = load[s] + size[i] > capacity[0] * (1 + slack)
        if out[i]:
            load += size[i] / shards
        else:
            load[s] += size[i]
    return out


def shard(docs: DataFrame, shards: int = 24, bundles: int = 16_384, heavy_parts: int = 20, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = written(docs.select(
        F.col(ident).alias("doc_id"), (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        F.regexp_count(t, F.lit(WORD_CLASS)).cast("long").alias("tokens"), F.xxhash64(t).alias("key"), F.monotonically_increasing_id().alias("row")))
    sums = (F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r"))
    total = rows.agg(*sums).first()
    share = F.greatest(*[F.col(c) / F.lit(float(max(1, total[c] or 0))) for c in "btr"])
    heavy = rows.groupBy("key").agg(*sums).where(share * shards * heavy_parts > 1).select("key", F.ceil(share * bundles).cast("long").alias("parts"))
    # At most 3 * shards * heavy_parts groups can exceed that share, so this side of the join is small by construction.
    rows = rows.join(F.broadcast(heavy), "key", "left")
    own = F.pmod(F.xxhash64("row"), F.col("parts"))
    light = F.col("parts").isNull()
    rows = rows.withColumns({"heavy": ~light, "of": F.when(light, F.lit(0).cast("long")).otherwise(F.col("key")), "no": F.when(light, F.pmod("key", F.lit(bundles))).otherwise(own)})
    # A heavy group is counted in parts of a bundle's size, which also number its rows; bounded: bundles, and parts of heavy groups.
    found = sorted(rows.groupBy("heavy", "of", "no").agg(*sums).collect())
    vectors = np.array([[r["b"], r["t"], r["r"]] for r in found], dtype=float).reshape(-1, 3)
    groups: dict[int, list[int]] = {}
    for i, r in enumerate(found):
        if r["heavy"]:
            groups.setdefault(r["of"], []).append(i)
    whole = list(groups.values())
    split = without_room(np.array([vectors[g].sum(axis=0) for g in whole]).reshape(-1, 3), vectors.sum(axis=0) / shards, shards, 1 / heavy_parts)
    items = [g for g, cut in zip(whole, split) if not cut] + [[i] for g, cut in zip(whole, split) if cut for i in g] + [[i] for i, r in enumerate(found) if not r["heavy"]]
    on = place_bundles(np.array([vectors[g].sum(axis=0) for g in items]).reshape(-1, 3), shards)
    placed = np.zeros(len(found), dtype=np.int64)
    for g, s in zip(items, on):
        placed[g] = s
    first = [0] * shards
    table = []
    for r, s in zip(found, placed.tolist()):
        table.append((r["heavy"], r["of"], r["no"], s, first[s]))
        first[s] += r["r"]
    spark = docs.sparkSession
    to = spark.createDataFrame(table, "heavy boolean, of long, no long, shard int, first long")
    slot = F.row_number().over(Window.partitionBy("heavy", "of", "no").orderBy("doc_id", "row"))
    return rows.join(F.broadcast(to), ["heavy", "of", "no"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + slot - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "tokens")
