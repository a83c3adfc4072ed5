"""Exact order statistics of all differences a - b between two groups of values, without listing the pairs.

The distinct values of a group lie sorted in blocks of bounded size. Differences fall along a row and rise down a column of the
sorted matrix, so how many lie at or below a pivot is a search per row. Two groups of one block each are selected in one step.
For longer ones the least and largest difference of every pair of blocks bracket the wanted rank; only the pairs that
straddle the bracket, a staircase of about as many pairs as there are blocks, stay. Rounds of two pivots
then narrow the bracket until its few differences can be taken as they are. The result always is an actual difference.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvida.functions.columns import finite
from corvida.session import cut_lineage

BLOCK = 4096
LAST = 1 << 18  # differences of one bracket that are taken as they are
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession):
    """Rows here carry whole blocks of values, so Arrow batches are bounded by bytes while the steps inside run."""
    before = spark.conf.get(BATCH_LIMIT, None)
    set_ = int(before.rstrip("b") or 0) if before else 0
    spark.conf.set(BATCH_LIMIT, str(min(set_, BATCH_BYTES) if set_ > 0 else BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_LIMIT) if before is None else spark.conf.set(BATCH_LIMIT, before)


def first_within(a: np.ndarray, b: np.ndarray, p, strict: bool = False) -> np.ndarray:
    """For every a the first place in ascending b with a - b <= p (or < p), by the differences as they are rounded."""
    p = np.broadcast_to(np.asarray(p, dtype=float), a.shape)
    with np.errstate(invalid="ignore"):
        t = np.searchsorted(b, np.where(np.isinf(p), -p, a - p), "left")
    holds = (lambda d, q: d < q) if strict else (lambda d, q: d <= q)
    while True:
        back = t > 0
        back[back] = holds(a[back] - b[t[back] - 1], p[back])
        if not back.any():
            break
        t = t - back
    while True:
        on = t < len(b)
        on[on] = ~holds(a[on] - b[t[on]], p[on])
        if not on.any():
            return t
        t = t + on


def after(w: np.ndarray) -> np.ndarray:
    """Weight from each place to the end; one more entry, 0, behind the last place."""
    return np.concatenate((np.cumsum(w[::-1])[::-1], [0]))


def weighted_rank(values: np.ndarray, weights: np.ndarray, k: int):
    """The value that holds the k-th unit of weight (from 1)."""
    order = np.argsort(values, kind="stable")
    run = np.cumsum(weights[order])
    return values[order][min(int(np.searchsorted(run, k, "left")), len(order) - 1)]


def select_difference(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray, k: int) -> float:
    """The k-th smallest difference a - b (from 1) of ascending values with whole weights."""
    if len(a) * len(b) <= 1 << 14:
        return float(weighted_rank(np.subtract.outer(a, b).ravel(), np.multiply.outer(wa, wb).ravel(), k))
    s = after(wb)
    start, stop = np.zeros(len(a), dtype=np.int64), np.full(len(a), len(b), dtype=np.int64)  # open places of each row
    while True:
        rows = np.flatnonzero(start < stop)
        x, lo, hi = a[rows], start[rows], stop[rows]
        middle = np.searchsorted(-s, -((s[lo] + s[hi]) / 2), "right") - 1
        middle = np.clip(middle, lo, hi - 1)
        weight = wa[rows] * (s[lo] - s[hi])
        p = weighted_rank(x - b[middle], weight, (int(weight.sum()) + 1) // 2)
        within, below = first_within(a, b, p), first_within(a, b, p, strict=True)
        if (wa * s[below]).sum() >= k:
            start = np.maximum(start, below)
        elif (wa * s[within]).sum() >= k:
            return float(p)
        else:
            stop = np.minimum(stop, within)


def value_blocks(df: DataFrame, keys: list[str], value: str, block: int = BLOCK) -> DataFrame:
    """(keys, no, blocks, values, counts, weight, low, high): sorted distinct values of each key in blocks, numbered from 0.

    Keys are text or numbers. The values are sorted by range over (keys, value), so one key may hold any share of them."""
    v = F.col(value).cast("double")
    counted = df.where(finite(v).isNotNull()).groupBy(*keys, v.alias("v")).agg(F.count("*").alias("c"))
    ordered = counted.repartitionByRange(*keys, "v").sortWithinPartitions(*keys, "v")
    n = len(keys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            new = np.zeros(rows, dtype=bool)
            for k in range(n):
                col = batch.column(k)
                same = pa.compute.equal(col.slice(1), col.slice(0, rows - 1)).fill_null(False).to_numpy(zero_copy_only=False)
                new[1:] |= ~same.astype(bool)
            begin = np.flatnonzero(new | (np.arange(rows) == 0))
            sizes = np.diff(np.concatenate((begin, [rows])))
            at = np.concatenate([np.arange(s, s + m, block) for s, m in zip(begin, sizes)])
            end = np.concatenate((at[1:], [rows]))
            v, c = (batch.column(n + i).to_numpy(zero_copy_only=False) for i in range(2))
            offsets = pa.array(np.concatenate((at, [rows])), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (v, c)]
            weight = np.add.reduceat(c, at)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at)) for k in range(n)), *lists, pa.array(weight), pa.array(v[at]), pa.array(v[end - 1])],
                                             names=[*keys, "values", "counts", "weight", "low", "high"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    made = ordered.mapInArrow(cut, f"{kinds}, values array<double>, counts array<bigint>, weight bigint, low double, high double")
    every = Window.partitionBy(*keys)  # a row stands for a block of values
    return made.withColumns({"no": F.row_number().over(every.orderBy("low")) - 1, "blocks": F.count("*").over(every)})


def next_below(column: str) -> Column:
    """The largest double below each value."""

    def below(v: pa.Array) -> pa.Array:
        got = np.nextafter(v.to_numpy(zero_copy_only=False).astype(float), -np.inf)
        return pa.array(got, pa.float64(), mask=np.isnan(got))

    return F.arrow_udf(below, "double")(column)


def _numbers(col: pa.Array) -> np.ndarray:
    return col.values.to_numpy(zero_copy_only=False)


def _one_block(pairs: DataFrame) -> DataFrame:
    """(unit, k, value) from rows (unit, k, va, ca, vb, cb)."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, *sides in zip(*(batch.column(i) for i in range(1, 6))):
                va, ca, vb, cb = map(_numbers, sides)
                out.append(select_difference(va, ca, vb, cb, k.as_py()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["unit", "k", "value"])

    return pairs.select("unit", "k", "va", "ca", "vb", "cb").mapInArrow(pick, "unit bigint, k bigint, value double")


def _brackets(units: DataFrame, shape: DataFrame) -> DataFrame:
    """(unit, k, lo, hi, no_a, from, to): the bracket of each wanted rank and the places of the block pairs that straddle it.

    Per unit only the ends and weights of the blocks meet in one task, 1/4096 of the values."""
    side = lambda s: F.struct(F.lit(s).alias("side"), "no", "low", "high", "weight").alias("b")
    a = units.select("unit", "key_a").distinct().join(shape, F.col("key_a") == F.col("key")).select("unit", side(0))
    b = units.select("unit", "key_b").distinct().join(shape, F.col("key_b") == F.col("key")).select("unit", side(1))
    blocks = a.unionByName(b).select("unit", "b.*")
    wanted = units.groupBy("unit").agg(F.collect_set("k").alias("ks"))

    def bracket(key, table):
        ks = table.column("ks")[0].as_py()
        data = {n: table.column(n).to_numpy() for n in ("side", "no", "low", "high", "weight")}
        parts = []
        for s in (0, 1):
            use = np.flatnonzero(data["side"] == s)
            use = use[np.argsort(data["no"][use])]
            parts.append([data[n][use] for n in ("no", "low", "high", "weight")])
        (no_a, low_a, high_a, wa), (_, low_b, high_b, wb) = parts
        rows = []
        for k in ks:
            lo = select_difference(low_a, wa, high_b, wb, k)  # least differences of the block pairs
            hi = select_difference(high_a, wa, low_b, wb, k)
            begin = first_within(low_a, high_b, hi)  # pairs whose least difference is within the bracket
            end = first_within(high_a, low_b, lo, strict=True)  # pairs whose largest one reaches it
            s = after(wb)
            below = int((wa * s[end]).sum())
            rows += [(key[0].as_py(), k, lo, hi, below, int(n), int(x), int(y) - 1) for n, x, y in zip(no_a, begin, end) if x < y]
        names = ["unit", "k", "lo", "hi", "below", "no_a", "first", "last"]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    schema = "unit bigint, k bigint, lo double, hi double, below bigint, no_a bigint, first bigint, last bigint"
    return blocks.join(wanted, "unit").groupBy("unit").applyInArrow(bracket, schema)


def _points(pairs: DataFrame, most: int = 64, last: int = LAST) -> DataFrame:
    """(unit, k, d, w, whole): open differences of each block pair, all of them where the bracket is small, else some with weights."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(out):
            cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["unit", "k", "d", "w"])

        for batch in batches:
            out, held = [[], [], [], []], 0
            for unit, k, lo, hi, left, *sides in zip(*(batch.column(i) for i in range(9))):
                va, ca, vb, cb = map(_numbers, sides)
                start, stop = first_within(va, vb, hi.as_py()), first_within(va, vb, lo.as_py())
                s = after(cb)
                if left.as_py() <= last:
                    row = np.repeat(np.arange(len(va)), stop - start)
                    place = np.arange(len(row)) - np.repeat(np.cumsum(stop - start) - (stop - start), stop - start) + start[row]
                    w = ca[row] * cb[place]
                else:
                    rows = np.flatnonzero(start < stop)
                    weight = ca[rows] * (s[start[rows]] - s[stop[rows]])
                    if not len(rows):
                        continue
                    run = np.cumsum(weight)
                    spots = (np.arange(most) + 0.5) * run[-1] / most  # evenly over the rows, and within each row in turn
                    i = np.minimum(np.searchsorted(run, spots, "right"), len(rows) - 1)
                    row = rows[i]
                    share = np.modf((np.arange(most) + 0.5) * 0.6180339887498949)[0]
                    place = np.searchsorted(-s, -(s[start[row]] - share * (s[start[row]] - s[stop[row]])), "right") - 1
                    place = np.clip(place, start[row], stop[row] - 1)
                    w = np.full(most, max(1, int(run[-1]) // most), dtype=np.int64)
                for c, x in zip(out, (np.full(len(row), unit.as_py()), np.full(len(row), k.as_py()), va[row] - vb[place], w)):
                    c.append(x)
                held += len(row)
                if held >= last:
                    yield made(out)
                    out, held = [[], [], [], []], 0
            yield made(out)

    return pairs.select("unit", "k", "lo", "hi", "left", "va", "ca", "vb", "cb").mapInArrow(take, "unit bigint, k bigint, d double, w bigint")


def _counts(pairs: DataFrame, pivots: tuple[str, ...]) -> DataFrame:
    """(unit, k, <pivot>_lt, <pivot>_le): open differences, above lo, below and at most each pivot, added up over the block pairs."""
    names = [f"{p}_{s}" for p in pivots for s in ("lt", "le")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[] for _ in names]
            for lo, *rest in zip(*(batch.column(i) for i in range(2, 3 + len(pivots) + 4))):
                va, ca, vb, cb = map(_numbers, rest[len(pivots) :])
                s = after(cb)
                base = s[first_within(va, vb, lo.as_py())]
                for j, p in enumerate(rest[: len(pivots)]):
                    for i, strict in enumerate((True, False)):
                        out[2 * j + i].append(int((ca * np.maximum(s[first_within(va, vb, p.as_py(), strict)] - base, 0)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in out)], names=["unit", "k", *names])

    schema = "unit bigint, k bigint, " + ", ".join(f"{n} bigint" for n in names)
    rows = pairs.select("unit", "k", "lo", *pivots, "va", "ca", "vb", "cb").mapInArrow(count, schema)
    return rows.groupBy("unit", "k").agg(*(F.sum(n).alias(n) for n in names))


def _many_blocks(units: DataFrame, blocks: DataFrame, last: int = LAST) -> DataFrame:
    """(unit, k, value) of units (unit, k, key_a, key_b) with more than one block on a side."""
    shape = blocks.select("key", "no", "low", "high", "weight")
    rows = cut_lineage(_brackets(units, shape))
    band = rows.select("unit", "k", "no_a", F.explode(F.sequence("first", "last")).alias("no_b")).join(units, ["unit", "k"])
    half = lambda s: blocks.select(F.col("key").alias(f"key_{s}"), F.col("no").alias(f"no_{s}"), F.col("values").alias(f"v{s}"), F.col("counts").alias(f"c{s}"))
    pairs = cut_lineage(band.join(half("a"), ["key_a", "no_a"]).join(half("b"), ["key_b", "no_b"]).select("unit", "k", "va", "ca", "vb", "cb"))
    # The pairs left out below the band count in ``below``; differences equal to lo are still open, so the bracket begins just below it.
    state = rows.groupBy("unit", "k").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("below").alias("below"))
    state = cut_lineage(state.withColumn("lo", next_below("lo")))
    start = _counts(pairs.join(state, ["unit", "k"]).withColumn("bottom", F.col("lo")).withColumn("lo", F.lit(float("-inf"))), ("bottom", "hi"))
    state = cut_lineage(state.join(start, ["unit", "k"]).select(
        "unit", "k", "lo", "hi", (F.col("below") + F.col("bottom_le")).alias("below"), (F.col("hi_le") - F.col("bottom_le")).alias("left"), F.lit(None).cast("double").alias("value")))
    while not (open_ := state.where("value IS NULL")).isEmpty():
        points = _points(pairs.join(open_, ["unit", "k"]), last=last)

        def pivots(key, table):
            target, left = table.column("target")[0].as_py(), table.column("left")[0].as_py()
            d, w = table.column("d").to_numpy(), table.column("w").to_numpy()
            total = int(w.sum())
            if left <= last:
                p = [float(weighted_rank(d, w, target))] * 2
            else:
                slack = max(1, total // 16)
                at = target * total // left
                p = [float(weighted_rank(d, w, min(max(at + s, 1), total))) for s in (-slack, slack)]
            return pa.Table.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()]), *(pa.array([x]) for x in p)], names=["unit", "k", "p", "q"])

        told = points.join(open_.select("unit", "k", (F.col("k") - F.col("below")).alias("target"), "left"), ["unit", "k"])
        chosen = cut_lineage(told.groupBy("unit", "k").applyInArrow(pivots, "unit bigint, k bigint, p double, q double"))
        counted = _counts(pairs.join(open_.join(chosen, ["unit", "k"]), ["unit", "k"]), ("p", "q")).join(chosen, ["unit", "k"])
        t = F.col("k") - F.col("below")
        hit = lambda p: (F.col(f"{p}_lt") < t) & (F.col(f"{p}_le") >= t)
        step = state.join(counted, ["unit", "k"], "left").withColumn("p_under", next_below("p")).withColumn("q_under", next_below("q"))
        value = F.when(F.col("value").isNotNull(), F.col("value")).when(hit("p"), F.col("p")).when(hit("q"), F.col("q"))
        new = F.when(F.col("p_lt") >= t, F.struct(F.col("lo"), F.col("p_under").alias("hi"), F.col("below"), F.col("p_lt").alias("left")))
        new = new.when(F.col("q_lt") >= t, F.struct(F.col("p").alias("lo"), F.col("q_under").alias("hi"), (F.col("below") + F.col("p_le")).alias("below"), (F.col("q_lt") - F.col("p_le")).alias("left")))
        new = new.otherwise(F.struct(F.col("q").alias("lo"), F.col("hi"), (F.col("below") + F.col("q_le")).alias("below"), (F.col("left") - F.col("q_le")).alias("left")))
        state = cut_lineage(step.select("unit", "k", value.alias("value"), new.alias("s")).select("unit", "k", "s.*", "value"))
    return state.select("unit", "k", "value")


def median_difference(edges: DataFrame, groups: DataFrame, keys: list[str], value: str, block: int = BLOCK, last: int = LAST) -> DataFrame:
    """``edges`` (with struct columns a and b of ``keys``) and ``median``: the exact median of all a - b between the two groups.

    Values that are null or not finite are left out; edges with a side without values are left out."""
    with small_batches(edges.sparkSession):
        blocks = value_blocks(groups, keys, value, block).withColumn("key", F.struct(*keys)).drop(*keys)
        blocks = cut_lineage(blocks)
        sizes = blocks.groupBy("key").agg(F.sum("weight").alias("n"), F.max("blocks").alias("m"))
        side = lambda s: sizes.select(F.col("key").alias(f"key_{s}"), F.col("n").alias(f"n{s}"), F.col("m").alias(f"m{s}"))
        kept = cut_lineage(edges.withColumn("unit", F.monotonically_increasing_id()))
        n = F.col("na") * F.col("nb")
        ranks = F.array_distinct(F.array(F.call_function("div", n + 1, F.lit(2)), F.call_function("div", n, F.lit(2)) + 1))
        units = kept.select("unit", F.col("a").alias("key_a"), F.col("b").alias("key_b")).join(side("a"), "key_a").join(side("b"), "key_b")
        units = units.select("unit", "key_a", "key_b", F.explode(ranks).alias("k"), ((F.col("ma") > 1) | (F.col("mb") > 1)).alias("long"))
        half = lambda s: blocks.where("blocks = 1").select(F.col("key").alias(f"key_{s}"), F.col("values").alias(f"v{s}"), F.col("counts").alias(f"c{s}"))
        found = cut_lineage(_one_block(units.join(half("a"), "key_a").join(half("b"), "key_b")))
        long_ = cut_lineage(units.where("long").drop("long"))
        if not long_.isEmpty():
            found = found.unionByName(_many_blocks(long_, blocks, last))
    return kept.join(found.groupBy("unit").agg(F.avg("value").alias("median")), "unit").drop("unit")
