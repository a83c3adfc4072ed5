"""Exact set-similarity joins, similarity graphs, components, clusters and the space map.

Identical sets are collapsed first: a group of copies is one node with a member count and a
membership table, so copies never multiply into pairs. Every count and mean is weighted by the
member counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from corvida.functions.columns import HASH_PRIME, portable_hash
from corvida.functions.frames import with_scalars
from corvida.functions.labels import space_class
from corvida.functions.ranks import with_position
from corvida.operators.errors import top_per_key
from corvida.session import cut_lineage

HOT_TOKEN = 20_000
MOST_GROUPS = 1 << 19  # groups of copies that are broadcast
TOKENS_AT_ONCE, MOST_LOTS = 1 << 23, 8  # tokens in one shuffle
BUCKET_TOKENS = 1 << 18
BLOCK_TOKENS = 1 << 20
MATCHES_AT_ONCE, COUNTS_AT_ONCE = 1 << 21, 1 << 18  # the counts stay in a core's cache


def token_set(df: DataFrame, tokens: str, ident: str = "id") -> DataFrame:
    """(id, set): distinct, sorted 64-bit token codes; empty sets are left out.

    The generator is a barrier: a plain filter on the set would move below the expressions that make the tokens and
    evaluate all of them again, once per place where it names them."""
    s = F.sort_array(F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t))))
    held = df.select(F.col(ident).alias("id"), F.explode_outer(F.filter(F.array(s), lambda x: F.size(x) > 0)).alias("set"))
    return held.where("set IS NOT NULL")


def collapse_copies(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, set, size, copies; members: id, node); node is the smallest member id.

    Only the groups that have copies travel to the sets, which stay where they are unless there are more than ``MOST_GROUPS``."""
    keyed = sets.withColumn("_k", F.struct(F.xxhash64("set").alias("a"), F.xxhash64(F.lit(1), "set").alias("b")))
    again = cut_lineage(keyed.select("id", "_k").groupBy("_k").agg(F.min("id").alias("node"), F.count("*").alias("copies")).where("copies > 1"))
    again = F.broadcast(again) if again.count() <= MOST_GROUPS else again
    named = keyed.join(again, "_k", "left").withColumn("node", F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("node")))
    members = named.select("id", "node")
    full = named.where(F.col("id") == F.col("node")).select("node", "set", F.size("set").alias("size"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))
    return full, members


def _lots(sets: DataFrame, at_once: int) -> int:
    return max(1, min(MOST_LOTS, -(-(sets.agg(F.sum("size")).first()[0] or 0) // at_once)))


def shared_tokens(sets: DataFrame, keys: Sequence[str], between: str | None = None, at_once: int = TOKENS_AT_ONCE) -> DataFrame:
    """(keys, size, f, token): the tokens of a set that stand in other sets too, and for each the binary logarithm f of how many it
    stands in, rounded up; with ``between``, the tokens that stand with sets of both values of that flag, without f. Sets without one are left out.
    ``sets`` has keys, size and set.

    A token is sent once, with its keys, in lots of about ``at_once`` tokens (``MOST_LOTS`` lots at most), so that only the kept tokens of
    the earlier lots lie on disk beside a lot."""
    lots, w, by = _lots(sets, at_once), Window.partitionBy("token"), [*keys, "size"]
    every, out = None, ["token"] if between else ["f", "token"]
    for lot in range(lots):
        tok = sets.select(*by, F.explode("set").alias("token"))
        tok = tok if lots == 1 else tok.where(F.pmod("token", F.lit(lots)) == lot)
        tok = tok.withColumn("f", F.ceil(F.log2(F.count("*").over(w))).cast("tinyint"))
        tok = tok.withColumn("_both", F.min(between).over(w) != F.max(between).over(w)).where("_both") if between else tok.where("f > 0")
        part = cut_lineage(tok.groupBy(*by).agg(*[F.collect_list(c).alias(c) for c in out]))
        every = part if every is None else every.unionByName(part)
    if lots > 1:
        every = every.groupBy(*by).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in out])
    return every


def _flat(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all rows, and the number of the row each belongs to."""
    a = table[column].combine_chunks()
    return pc.list_flatten(a).to_numpy(), np.repeat(np.arange(len(a)), pc.list_value_length(a).to_numpy())


class Postings:
    """Tokens of a block of sets in order, with the sets that hold them."""

    def __init__(self, token: np.ndarray, owner: np.ndarray):
        order = np.argsort(token, kind="stable")
        self.owner = owner[order]
        self.token, self.start = np.unique(token[order], return_index=True)
        self.end = np.append(self.start[1:], len(order))

    def meet(self, token: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first place, number of places) of the tokens that stand in the block."""
        at = np.minimum(np.searchsorted(self.token, token), len(self.token) - 1) if len(self.token) else np.zeros(0, np.int64)
        hit = np.flatnonzero(self.token[at] == token) if len(at) else at
        at = at[hit]
        return row[hit], self.start[at], self.end[at] - self.start[at]

    def counts(self, rows: int, sets: int, row: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
        """(rows, sets): how many tokens each row shares with each set."""
        out = None
        ends = np.cumsum(many)
        a = 0
        while a < len(row):  # a part of the matches at a time
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MATCHES_AT_ONCE, "right")))
            m = many[a:b]
            place = np.repeat(first[a:b] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            found = np.bincount(np.repeat(row[a:b] * sets, m) + self.owner[place], minlength=rows * sets)
            out = found if out is None else out + found
            a = b
        return (np.zeros(rows * sets, dtype=np.int64) if out is None else out).reshape(rows, sets)


def similar_pairs(nodes: DataFrame, threshold: float, hot_token: int = HOT_TOKEN, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """(a, b, inter, similarity) with similarity = |A and B| / |A or B| >= threshold, a < b. Exact.

    Tokens are ordered from rare to common; two sets reaching the threshold must share a token
    in their first |A| - ceil(t*|A|) + 1 tokens. Tokens seen once come first in the order, so they use up prefix places
    but are neither indexed nor compared, and a set whose prefix they fill is done.

    Sets lie in buckets by their smallest token, so that similar ones tend to lie together; a smallest token with more than
    ``bucket_tokens`` tokens is spread over several. A set is sent to every bucket that holds a later set with a token of its
    prefix, once, and is compared there with the whole bucket: what is sent follows sets and buckets, not pairs. The list of
    buckets of a token is met by parts of at most ``hot_token`` of its sets.
    """
    places = lambda m: m - F.ceil(F.col("size") * threshold - 1e-9).cast("int") + 1
    found = shared_tokens(nodes, ["node"]).select("node", "size", F.size("f").alias("m"), F.arrays_zip("f", "token").alias("o"))
    found = found.withColumn("keep", places(F.col("m"))).where("keep > 0")
    # The token codes of a row that comes twice are there twice.
    lists = found.select("node", "size", "keep", F.array_distinct(F.transform(F.array_sort("o"), lambda t: t["token"])).alias("rest"))
    lists = cut_lineage(lists.withColumns({"low": F.array_min("rest"), "w": F.size("rest")}))
    buckets = max(1, -(-(lists.agg(F.sum("w")).first()[0] or 0) // bucket_tokens))
    wide = lists.groupBy("low").agg(F.sum("w").alias("t")).where(F.col("t") > bucket_tokens).select("low", F.ceil(F.col("t") / bucket_tokens).alias("cuts"))
    wide = F.broadcast(cut_lineage(wide))  # at most one for every ``bucket_tokens`` tokens
    lists = lists.join(wide, "low", "left").withColumn("cut", F.pmod(F.xxhash64("node"), F.coalesce("cuts", F.lit(1))))
    lists = lists.select("node", "size", "keep", "rest", "w", F.pmod(F.xxhash64("low", "cut"), F.lit(buckets)).cast("int").alias("bucket"))

    index = lists.select("node", "size", "w", "bucket", F.explode(F.slice("rest", F.lit(1), F.col("keep"))).alias("token"))
    index = cut_lineage(index.withColumn("f", F.count("*").over(Window.partitionBy("token"))).where("f > 1"))
    parts = F.ceil(F.col("f") / hot_token).cast("int")
    held = index.groupBy("token", "bucket").agg(F.max("node").alias("last"), F.min("size").alias("least"), F.max("size").alias("most"), F.first("f").alias("f"))
    held = held.select("token", "bucket", "last", "least", "most", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    asks = index.select("token", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), "node", "size", "w")
    routes = held.join(asks, ["token", "part"]).where((F.col("node") < F.col("last")) & (F.col("most") >= threshold * F.col("size") - 1e-9) & (F.col("size") >= threshold * F.col("least") - 1e-9))
    routes = cut_lineage(routes.select("node", "size", "w", "bucket").distinct())
    load = F.broadcast(cut_lineage(routes.groupBy("bucket").agg(F.ceil(F.sum("w") / bucket_tokens).cast("int").alias("copies"))))
    sent = routes.join(load, "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int"))
    sent = sent.select("node", "size", "bucket", "part").join(lists.select("node", "size", "rest"), ["node", "size"])
    there = lists.join(load, "bucket").select(*[F.col(c).alias(c) for c in ("node", "size", "rest", "bucket")], F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"))
    kind = nodes.schema["node"].dataType
    out = StructType([StructField("a", kind), StructField("b", kind), StructField("inter", IntegerType()), StructField("similarity", DoubleType())])
    arrow = to_arrow_schema(out)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        posts = Postings(*_flat(right, "rest"))
        mine, theirs = left["size"].to_numpy().astype(np.int64), right["size"].to_numpy().astype(np.int64)
        a_ids, b_ids = left["node"].combine_chunks(), right["node"].combine_chunks()
        row, first, many = posts.meet(*_flat(left, "rest"))
        made, step = [], max(1, COUNTS_AT_ONCE // len(theirs))
        for at in range(0, len(mine), step):
            lo, hi = np.searchsorted(row, [at, at + step])
            inter = posts.counts(min(step, len(mine) - at), len(theirs), row[lo:hi] - at, first[lo:hi], many[lo:hi])
            i, j = np.nonzero(inter)
            n = inter[i, j]
            sim = n / (mine[at + i] + theirs[j] - n)
            k = sim >= threshold - 1e-12
            made.append(pa.RecordBatch.from_arrays([a_ids.take(pa.array(at + i[k])), b_ids.take(pa.array(j[k])), pa.array(n[k].astype(np.int32)), pa.array(sim[k])], names=out.names))
        return pa.Table.from_batches(made).cast(arrow)

    pairs = sent.groupBy("bucket", "part").cogroup(there.groupBy("bucket", "part")).applyInArrow(compare, out).where("a < b")
    twice = cut_lineage(nodes.groupBy("node").count().where("count > 1"))
    if twice.isEmpty():
        return pairs
    for side in "ab":  # rows that come twice give their pairs twice
        pairs = pairs.join(twice.select(F.col("node").alias(side), F.col("count").alias(f"n{side}")), side, "left")
    return pairs.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("na", F.lit(1)) * F.coalesce("nb", F.lit(1))))).select(*out.names)


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "similarity").unionByName(
        pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), "similarity"))


def _packed(lists: DataFrame, block_tokens: int) -> DataFrame:
    """One row per block of about ``block_tokens`` tokens: ids in order, sizes, lengths and tokens of its sets."""
    total = lists.agg(F.sum(F.size("token"))).first()[0] or 0
    blocks = max(1, -(-total // block_tokens), min(lists.sparkSession.sparkContext.defaultParallelism, total >> 16))
    kind = lists.schema["node"].dataType
    fields = (("ids", kind), ("sizes", IntegerType()), ("lengths", IntegerType()), ("tokens", LongType()))
    schema = StructType([StructField(n, ArrayType(k)) for n, k in fields])
    names = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held).sort_by("node").combine_chunks()
            columns = (t["node"], t["size"], pc.list_value_length(t["token"]), pc.list_flatten(t["token"]))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c.combine_chunks().cast(f.type.value_type)) for c, f in zip(columns, names)], names=names.names)

    return cut_lineage(lists.select("node", "size", "token").repartition(blocks, "node").mapInArrow(pack, schema))


def best_match(queries: DataFrame, train: DataFrame, hot_token: int = HOT_TOKEN, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(id, best, similarity): most similar training set of each query (null when nothing is shared).

    Only tokens that stand on both sides are kept. The distinct sets of either side lie in blocks of about ``block_tokens`` tokens, and every
    block of queries meets every training block in a task of its own, which counts the shared tokens there and sends out the best set of
    each query: no pair of sets is written. A part of the matches is held at a time, so a token that everyone has needs no care;
    ``hot_token`` is no longer used.
    """
    qn, qm = collapse_copies(queries)
    tn, _ = collapse_copies(train)
    side = lambda n, trained: n.select("node", "size", "set", F.lit(trained).alias("train"))
    qm = cut_lineage(qm)  # else the sets would have to stay for the ids
    lists = cut_lineage(shared_tokens(side(qn, False).unionByName(side(tn, True)), ["node", "train"], "train").select("node", "train", "size", "token"))
    q, t = (_packed(lists.where(F.col("train") == trained), block_tokens) for trained in (False, True))
    pairs = q.select(*[F.col(c).alias(f"q_{c}") for c in q.columns]).crossJoin(t.hint("shuffle_replicate_nl"))
    out = StructType([StructField("q", qn.schema["node"].dataType), StructField("t", tn.schema["node"].dataType), StructField("s", DoubleType())])
    arrow = to_arrow_schema(out)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q_sizes, q_lengths, q_tokens, ids, sizes, lengths, tokens = (c[i].values for c in batch.columns)
                mine, theirs = q_sizes.to_numpy().astype(np.int64), sizes.to_numpy().astype(np.int64)
                posts = Postings(tokens.to_numpy(), np.repeat(np.arange(len(ids)), lengths.to_numpy()))
                row, first, many = posts.meet(q_tokens.to_numpy(), np.repeat(np.arange(len(q_ids)), q_lengths.to_numpy()))
                step = max(1, COUNTS_AT_ONCE // len(theirs))
                for at in range(0, len(mine), step):
                    lo, hi = np.searchsorted(row, [at, at + step])
                    inter = posts.counts(min(step, len(mine) - at), len(theirs), row[lo:hi] - at, first[lo:hi], many[lo:hi]).ravel()
                    place = np.flatnonzero(inter)
                    if not len(place):
                        continue
                    k, j = np.divmod(place, len(theirs))
                    n = inter[place]
                    union = mine[at + k] + theirs[j] - n
                    if not union.all():  # ids that come twice count their tokens twice, as the check SQL does
                        raise ZeroDivisionError("a repeated id leaves nothing in a union of sets")
                    sim = n / union
                    start = np.flatnonzero(np.diff(k, prepend=-1))
                    top = np.maximum.reduceat(sim, start)
                    best = np.flatnonzero(sim == np.repeat(top, np.diff(np.append(start, len(k)))))
                    best = best[np.flatnonzero(np.diff(k[best], prepend=-1))]  # ids are in order, so the first is the smallest
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(at + k[best])), ids.take(pa.array(j[best])), pa.array(sim[best])], schema=arrow)

    best = pairs.mapInArrow(meet, out).groupBy("q").agg(F.max(F.struct("s", (-F.col("t")).alias("t"))).alias("m"))
    return qm.join(best, qm["node"] == best["q"], "left").select("id", (-F.col("m.t")).alias("best"), F.col("m.s").alias("similarity"))


def duplicate_detail(members: DataFrame, pairs: DataFrame, near: float = 0.95, analogue: float = 0.85) -> DataFrame:
    """(a, b, similarity, kind): copies as (representative, copy) links, other pairs as near duplicate or strong analogue."""
    exact = members.where("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"), F.lit("exact duplicate").alias("kind"))
    close = pairs.where(F.col("similarity") >= analogue).select(
        "a", "b", "similarity", F.when(F.col("similarity") >= near, "near duplicate").otherwise("strong analogue").alias("kind"))
    return exact.unionByName(close)


def copy_groups(nodes: DataFrame) -> DataFrame:
    """One row per group of copies: representative, size and the number of pairs it stands for."""
    return nodes.where("copies > 1").select("node", "copies", (F.col("copies") * (F.col("copies") - 1) / 2).cast("bigint").alias("pairs"))


def similarity_summary(nodes: DataFrame, pairs: DataFrame, cuts=(0.85, 0.95)) -> DataFrame:
    """Counts over all row pairs (copies included) and the mean similarity of the pairs found."""
    n = nodes.agg(F.sum("copies").alias("rows"), F.count("*").alias("distinct_sets"), F.sum(F.col("copies") * (F.col("copies") - 1) / 2).cast("bigint").alias("copy_pairs"))
    c = nodes.select("node", "copies")
    w = pairs.join(c.select(F.col("node").alias("a"), F.col("copies").alias("ca")), "a").join(c.select(F.col("node").alias("b"), F.col("copies").alias("cb")), "b").withColumn("w", F.col("ca") * F.col("cb"))
    p = w.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("near_pairs"), (F.sum(F.col("w") * F.col("similarity")) / F.sum("w")).alias("mean_similarity"), F.max("similarity").alias("max_similarity"),
              *[F.coalesce(F.sum(F.when(F.col("similarity") > t, F.col("w"))), F.lit(0)).alias(f"pairs_gt_{int(t * 100)}") for t in cuts])
    return with_scalars(n, p)


def drawn_pairs(spark: SparkSession, rows: int, pairs: int, salt: int = 11) -> DataFrame:
    """(draw, i, j) with 0 <= j < i < rows: every pair once where there are at most ``pairs``, else that many uniform draws.

    A draw is the number of a pair (two hashes make up to 62 bits); the triangular root turns it into positions, and one
    step by whole numbers mends what the root's rounding may miss."""
    every = rows * (rows - 1) // 2
    number = F.col("id")
    if every > pairs:
        number = (portable_hash("id", salt) * F.lit(HASH_PRIME) + portable_hash("id", salt + 1)) % F.lit(every)
    half = lambda a, b: F.call_function("div", a * b, F.lit(2))
    d = spark.range(min(every, pairs)).select(F.col("id").alias("draw"), number.alias("t"))
    d = d.withColumn("r", F.floor((1 + F.sqrt(1 + F.lit(8.0) * F.col("t"))) / 2))
    r = F.col("r")
    d = d.withColumn("i", F.when(half(r, r - 1) > F.col("t"), r - 1).when(half(r + 1, r) <= F.col("t"), r + 1).otherwise(r))
    return d.select("draw", "i", (F.col("t") - half(F.col("i"), F.col("i") - 1)).alias("j"))


def pair_statistics(sets: DataFrame, pairs: int = 200_000, salt: int = 11) -> DataFrame:
    """One row on the similarity of all row pairs: mode (full or sampled), pairs used, mean, median, minimum, maximum, and the
    errors of a sample: standard error of the mean and the 95 % bounds of the median from order statistics.

    ``sets`` (id, set) is joined by position with the drawn pairs, so the work is ``pairs`` comparisons at any row count."""
    rows = sets.count()
    placed = with_position(sets.select("id"), [], "id", "pos")
    drawn = drawn_pairs(sets.sparkSession, rows, pairs, salt)
    side = lambda at, out: placed.select(F.col("pos").alias(at), F.col("id").alias(out))
    # Only the ids travel to the draws; the sets then meet at most two ids per draw.
    named = cut_lineage(drawn.join(side("i", "x"), "i").join(side("j", "y"), "j").select("draw", "x", "y"))
    a, b = (sets.select(F.col("id").alias(c), F.col("set").alias(f"s{c}")) for c in "xy")
    both = named.join(a, "x").join(b, "y")
    inter = F.size(F.array_intersect("sx", "sy"))
    sim = cut_lineage(both.select((inter / (F.size("sx") + F.size("sy") - inter)).alias("s")))
    m = min(rows * (rows - 1) // 2, pairs)
    full = rows * (rows - 1) // 2 <= pairs
    out = sim.agg(F.count("s").alias("pairs_used"), F.avg("s").alias("mean_similarity"), F.percentile("s", 0.5).alias("median_similarity"), F.min("s").alias("min_similarity"),
                  F.max("s").alias("max_similarity"), F.stddev_samp("s").alias("_sd"), *[F.percentile("s", min(max(0.5 + z / max(m, 1) ** 0.5, 0.0), 1.0)).alias(n) for z, n in ((-0.98, "_lo"), (0.98, "_hi"))])
    error = F.lit(0.0) if full else F.col("_sd") / F.sqrt("pairs_used")
    return out.select(F.lit("full" if full else "sampled").alias("mode"), "pairs_used", "mean_similarity", "median_similarity", "min_similarity", "max_similarity",
                      error.alias("mean_error"), (F.col("median_similarity") if full else F.col("_lo")).alias("median_low"), (F.col("median_similarity") if full else F.col("_hi")).alias("median_high"))


def diversity_status(rows: int, nodes: DataFrame, clusters: DataFrame, pairs: DataFrame, statistics: DataFrame, very_close: float = 0.95) -> DataFrame:
    """One row: valid, invalid and unique counts, clusters by size, very close row pairs, the pair statistics, a status and its reasons.

    ``rows`` counts all input rows; ``clusters`` is (node, cluster) of any clustering. Statuses: insufficient_data (below three
    valid rows), low_diversity, high_diversity, moderate_diversity, heterogeneous, not_computed."""
    c = nodes.select("node", "copies")
    size = clusters.join(c, "node").groupBy("cluster").agg(F.sum("copies").alias("n"))
    groups = size.agg(F.count("*").alias("clusters"), F.count_if(F.col("n") == 1).alias("singleton_clusters"), F.max("n").alias("largest_cluster"))
    counts = nodes.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("valid_rows"), F.count("*").alias("unique_sets"), F.coalesce(F.sum(F.col("copies") * (F.col("copies") - 1) / 2), F.lit(0)).cast("bigint").alias("_same"))
    w = pairs.where(F.col("similarity") > very_close).join(c.select(F.col("node").alias("a"), F.col("copies").alias("ca")), "a").join(c.select(F.col("node").alias("b"), F.col("copies").alias("cb")), "b")
    close = w.agg(F.coalesce(F.sum(F.col("ca") * F.col("cb")), F.lit(0)).alias("_near"))
    d = with_scalars(with_scalars(with_scalars(counts, groups), close), statistics)
    n, k, mean = F.col("valid_rows"), F.col("clusters"), F.col("mean_similarity")
    d = d.withColumns({"invalid_rows": F.lit(rows) - n, "largest_cluster_percent": F.when(n > 0, F.col("largest_cluster") * 100.0 / n), "very_close_pairs": F.col("_same") + F.col("_near")})
    low = (mean > 0.70) & (k <= F.greatest(F.lit(3), F.floor(n * 0.10)))
    high = (mean < 0.40) & (k >= F.greatest(F.lit(4), F.floor(n * 0.10)))
    mixed = (F.col("largest_cluster_percent") >= 45.0) & (F.col("singleton_clusters") >= F.greatest(F.lit(3), F.floor(k * 0.25)))
    status = (F.when(n < 3, "insufficient_data").when(mixed, "heterogeneous").when(mean.isNull(), "not_computed")
              .when(low, "low_diversity").when(high, "high_diversity").otherwise("moderate_diversity"))
    first = F.when(mean.isNull(), F.lit(None)).when(low, "high_mean_similarity").when(high, "low_mean_many_clusters").otherwise("several_regions")
    second = F.when(mixed, "large_cluster_and_singletons").when(F.col("very_close_pairs") > 0, "very_close_pairs")
    reasons = F.when(n < 3, "fewer_than_three").otherwise(F.coalesce(F.nullif(F.concat_ws("; ", first, second), F.lit("")), F.lit("none")))
    return d.withColumns({"status": status, "reasons": reasons}).drop("_same", "_near")


def similarity_histogram(pairs: DataFrame, nodes: DataFrame, bins: int = 20) -> DataFrame:
    """Row pairs per similarity bin."""
    c = nodes.select("node", "copies")
    w = pairs.join(c.select(F.col("node").alias("a"), F.col("copies").alias("ca")), "a").join(c.select(F.col("node").alias("b"), F.col("copies").alias("cb")), "b")
    b = F.least(F.floor(F.col("similarity") * bins + 1e-9), F.lit(bins - 1)).cast("int")
    return w.groupBy(b.alias("bin")).agg(F.sum(F.col("ca") * F.col("cb")).alias("count")).withColumn("similarity_from", F.col("bin") / float(bins))


def top_edges(pairs: DataFrame, k: int = 5, max_edges: int | None = None) -> DataFrame:
    """Each node's k most similar neighbours (ties to the larger id), as undirected distinct edges."""
    t = top_per_key(both_ways(pairs), ["node"], [F.col("similarity").desc(), F.col("other").desc()], k, "other")
    e = t.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "similarity").distinct()
    return e.orderBy(F.col("similarity").desc(), "a", "b").limit(max_edges) if max_edges else e


def max_similarity(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, similarity, nearest): largest similarity per node; copies count as 1.0, no match as 0."""
    best = both_ways(pairs).groupBy("node").agg(F.max(F.struct("similarity", (-F.col("other")).alias("o"))).alias("m"))
    d = nodes.select("node", "copies").join(best, "node", "left")
    return d.select("node", F.when(F.col("copies") > 1, 1.0).otherwise(F.coalesce("m.similarity", F.lit(0.0))).alias("similarity"),
                    F.when(F.col("copies") > 1, F.col("node")).otherwise(-F.col("m.o")).alias("nearest"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): smallest node id of the component, by alternating large-star / small-star rounds.

    Each round is a min per node and a join, with no neighbour lists, so a hub of any degree is
    handled; every round is checkpointed.
    """
    e = cut_lineage(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        sym = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low2.select("u", F.col("m").alias("v")))
        e = cut_lineage(small.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        sign = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (sign["n"], sign["h"]):
            break
        before = (sign["n"], sign["h"])
    lab = e.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    return nodes.select("node").join(lab, "node", "left").withColumn("component", F.coalesce("component", "node"))


def leader_clusters(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, leader): greedy clustering, most neighbours first and smaller id on ties.

    A node becomes a leader when it beats all undecided neighbours, which gives the same leaders as
    the sequential pass over fixed neighbour counts; members join their best-placed leader.
    Counts include copies. (Counts are not updated while clusters form.)
    """
    arcs = cut_lineage(both_ways(pairs).select("node", "other"))
    c = nodes.select("node", "copies")
    deg = arcs.join(c.select(F.col("node").alias("other"), "copies"), "other").groupBy("node").agg(F.sum("copies").alias("d"))
    rank = c.join(deg, "node", "left").select("node", F.struct((-(F.coalesce("d", F.lit(0)) + F.col("copies") - 1)).alias("d"), F.col("node").alias("i")).alias("o"))
    rank = cut_lineage(rank)
    state = rank.select("node", "o", F.lit(None).cast("struct<d:bigint,i:bigint>").alias("leader")).withColumn("done", F.lit(False))
    links = cut_lineage(arcs.join(rank.select(F.col("node").alias("other"), F.col("o").alias("oo")), "other").select("node", "other", "oo"))
    leaders = None
    while True:
        open_ = state.where("NOT done")
        rival = links.join(open_.select(F.col("node").alias("other")), "other", "left_semi").groupBy("node").agg(F.min("oo").alias("r"))
        new = cut_lineage(open_.join(rival, "node", "left").where("r IS NULL OR o < r").select("node", "o"))
        leaders = new if leaders is None else leaders.unionByName(new)
        hit = links.join(new.select(F.col("node").alias("other")), "other", "left_semi").select("node").distinct().unionByName(new.select("node")).distinct().withColumn("_hit", F.lit(True))
        state = cut_lineage(state.join(hit, "node", "left").select("node", "o", "leader", (F.col("done") | F.coalesce("_hit", F.lit(False))).alias("done")))
        if state.where("NOT done").isEmpty():
            break
    leaders = cut_lineage(leaders)
    own = leaders.select("node", F.col("node").alias("leader"))
    near = links.join(leaders.select(F.col("node").alias("other")), "other", "left_semi").groupBy("node").agg(F.min("oo").alias("m"))
    rest = near.join(leaders.select("node"), "node", "left_anti").select("node", F.col("m.i").alias("leader"))
    return own.unionByName(rest)


def cluster_table(clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows, share and representative of each leader cluster."""
    g = clusters.join(nodes.select("node", "copies"), "node").groupBy("leader").agg(F.sum("copies").alias("n"), F.count("*").alias("distinct_sets"))
    g = with_scalars(g, nodes.agg(F.sum("copies").alias("_t")))
    return g.withColumn("percent", F.round(F.col("n") / F.col("_t") * 100, 2)).drop("_t")


def dbscan(nodes: DataFrame, pairs: DataFrame, min_samples: int = 2) -> DataFrame:
    """(node, cluster, is_noise): cores have at least ``min_samples`` rows in reach (self and copies included)."""
    arcs = both_ways(pairs).select("node", "other")
    c = nodes.select("node", "copies")
    deg = arcs.join(c.select(F.col("node").alias("other"), F.col("copies").alias("oc")), "other").groupBy("node").agg(F.sum("oc").alias("d"))
    core = cut_lineage(c.join(deg, "node", "left").where(F.coalesce("d", F.lit(0)) + F.col("copies") >= min_samples).select("node"))
    cc = pairs.join(core.select(F.col("node").alias("a")), "a", "left_semi").join(core.select(F.col("node").alias("b")), "b", "left_semi")
    comp = connected_components(core, cc.select("a", "b"))
    border = arcs.join(comp.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("cluster"))
    d = c.select("node").join(comp, "node", "left").join(border, "node", "left")
    lab = F.coalesce("component", "cluster")
    return d.select("node", F.coalesce(lab, -(F.col("node") + 1)).alias("cluster"), lab.isNull().alias("is_noise"))


def space_map(nodes: DataFrame, members: DataFrame, pairs: DataFrame, threshold: float, k: int = 5) -> DataFrame:
    """Per row: nearest neighbour, close analogues, local density, component, class and outlier flags.

    ``pairs`` must hold all pairs at or above the lowest similarity of interest; a row without
    any listed neighbour has nearest similarity 0.
    """
    near = max_similarity(nodes, pairs)
    c = nodes.select("node", "copies")
    arcs = both_ways(pairs).join(c.select(F.col("node").alias("other"), F.col("copies").alias("oc")), "other")
    close = arcs.where(F.col("similarity") >= threshold).groupBy("node").agg(F.sum("oc").alias("cl"))
    topk = top_per_key(arcs, ["node"], [F.col("similarity").desc(), F.col("other")], k, "other", "rk")
    # Copies of the node fill the first places with 1.0; a neighbour set fills as many places as it has copies.
    w = Window.partitionBy("node").orderBy("rk").rowsBetween(Window.unboundedPreceding, -1)
    topk = topk.join(c, "node").withColumn("_before", F.least(F.col("copies") - 1, F.lit(k)) + F.coalesce(F.sum("oc").over(w), F.lit(0)))
    take = F.greatest(F.least(F.col("oc"), F.lit(k) - F.col("_before")), F.lit(0))
    dens = topk.groupBy("node").agg(F.sum(take * F.col("similarity")).alias("ts"), F.sum(take).alias("tn"))
    comp = connected_components(nodes.select("node"), pairs.where(F.col("similarity") >= threshold).select("a", "b"))
    own = F.least(F.col("copies") - 1, F.lit(k))
    d = c.join(near, "node").join(close, "node", "left").join(dens, "node", "left").join(comp, "node")
    places = own + F.coalesce("tn", F.lit(0))
    d = d.select("node", "nearest", F.col("similarity").alias("nearest_similarity"), (F.coalesce("cl", F.lit(0)) + F.col("copies") - 1).alias("close_analog_count"),
                 F.when(places > 0, (own + F.coalesce("ts", F.lit(0.0))) / F.when(places > 0, places)).alias("local_density"), "component")
    d = d.withColumns({"space_class": space_class("nearest_similarity"), "is_singleton": F.col("close_analog_count") == 0})
    return members.join(d.withColumn("is_outlier", F.col("space_class") == "Singleton / outlier"), "node")


def community_nodes(nodes: DataFrame, labels: DataFrame, edges: DataFrame, small: int = 3) -> DataFrame:
    """Degree, group size and the singleton criteria of every node under a labelling (node, group_id, is_noise)."""
    deg = both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"))
    d = labels.join(nodes.select("node", "copies"), "node").join(deg, "node", "left").na.fill(0, ["degree"])
    size = d.groupBy("group_id").agg(F.sum("copies").alias("group_size"))
    d = d.join(size, "group_id").withColumns({
        "no_neighbors": (F.col("degree") == 0) & (F.col("copies") == 1), "single_component": F.col("group_size") == 1, "small_group": F.col("group_size") <= small})
    return d.withColumn("is_singleton", F.col("no_neighbors") | F.col("single_component") | F.col("is_noise"))


def community_groups(nodes: DataFrame, pairs: DataFrame, small: int = 3) -> DataFrame:
    """Per group: size, representative (largest degree, smallest id), mean internal similarity of listed pairs, singletons."""
    rep = nodes.groupBy("group_id").agg(F.sum("copies").alias("group_size"), F.min(F.struct((-F.col("degree")).alias("d"), F.col("node").alias("n"))).alias("m"),
                                        F.count_if("is_singleton").alias("singletons"))
    g = nodes.select("node", "group_id")
    inner = (pairs.join(g.select(F.col("node").alias("a"), "group_id"), "a").join(g.select(F.col("node").alias("b"), F.col("group_id").alias("gb")), "b")
             .where("group_id = gb").groupBy("group_id").agg(F.avg("similarity").alias("internal_similarity")))
    return rep.join(inner, "group_id", "left").select("group_id", "group_size", F.col("m.n").alias("representative"), "internal_similarity", "singletons", (F.col("group_size") <= small).alias("is_small"))


def community_summary(nodes: DataFrame, small: int = 3) -> DataFrame:
    groups = nodes.groupBy("group_id").agg(F.max("group_size").alias("s"))
    a = nodes.agg(F.sum("copies").alias("n_rows"), F.sum(F.when(F.col("is_singleton"), F.col("copies")).otherwise(0)).alias("n_singletons"), F.count_if("is_noise").alias("noise_points"), F.avg("degree").alias("mean_degree"))
    b = groups.agg(F.count("*").alias("n_groups"), F.max("s").alias("largest_group_size"), F.count_if((F.col("s") > 1) & (F.col("s") <= small)).alias("n_small_groups"))
    return with_scalars(a, b)
