"""Exact ranks, running totals and quantiles that never sort one key in one task."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvida.session import cut_lineage

ALL = "_all"
GROUP_LIMIT = 1_000_000
BLOCK = 1 << 15  # ranks of a block of concordance


def bounded_groups(df: DataFrame, keys: Sequence[str], limit: int = GROUP_LIMIT) -> bool:
    """True when no key holds more than ``limit`` rows (one counting job).

    Callers check once and pass the answer on as ``bounded``: groups known to be small use
    plain windows and the built-in percentile, any larger one the split forms below.
    """
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).isEmpty()


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn(ALL, F.lit(0)), [ALL])


def _attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str], few: bool = False) -> DataFrame:
    """Join one row per key; without keys that is exactly one row, which is broadcast, as the rows of ``few`` keys are."""
    return df.join(F.broadcast(per_key) if few or list(keys) == [ALL] else per_key, list(keys))


def prefix_sums(
    df: DataFrame, keys: Sequence[str], order: str, measure: str,
    out: str = "before", buckets: int = 64, bounded: bool = False,
) -> DataFrame:
    """Sum of ``measure`` over strictly smaller ``order`` values of the same key.

    ``df`` must hold one row per (key, order). Each key is cut into value buckets at
    approximate quantiles; a window runs inside a bucket and the bucket totals are
    carried over, so the largest sort is 1/buckets of a key.
    """
    if bounded and keys:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(measure).over(w), F.lit(0)))
    d, k = _keyed(df, keys)
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = d.groupBy(*k).agg(
        F.percentile_approx(order, cuts, max(1000, 20 * buckets)).alias("_bounds")
    )
    d = _attach(d, bounds, k).withColumn(
        "_bucket", F.size(F.filter("_bounds", lambda b: b < F.col(order)))
    ).drop("_bounds")
    inner = Window.partitionBy(*k, "_bucket").orderBy(order)
    d = d.withColumn(
        "_in", F.coalesce(F.sum(measure).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    totals = d.groupBy(*k, "_bucket").agg(F.sum(measure).alias("_tot"))
    outer = Window.partitionBy(*k).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*k, "_bucket", F.coalesce(F.sum("_tot").over(outer), F.lit(0)).alias("_off"))
    d = d.join(totals, [*k, "_bucket"]).withColumn(out, F.col("_in") + F.col("_off"))
    return d.drop("_bucket", "_in", "_off", *([] if keys else [ALL]))


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, buckets: int = 64, bounded: bool = False) -> DataFrame:
    """(keys, value, ties, less, average_rank): one row per distinct value of a key."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("ties"))
    r = prefix_sums(counts, keys, value, "ties", "less", buckets, bounded)
    return r.withColumn("average_rank", F.col("less") + (F.col("ties") + 1) / 2.0)


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, buckets: int = 64, bounded: bool = False) -> DataFrame:
    """Attach the tie-averaged rank of ``value`` inside each key."""
    r = value_ranks(df, keys, value, buckets, bounded).select(*keys, value, F.col("average_rank").alias(out))
    return df.join(r, [*keys, value])


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "spearman", bounded: bool = False) -> DataFrame:
    """Rank correlation per key; null when a side is constant."""
    d, k = _keyed(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), keys)
    d = with_average_rank(with_average_rank(d, k, x, "_rx", bounded=bounded), k, y, "_ry", bounded=bounded)
    res = d.groupBy(*k).agg(F.count("*").alias("n"), safe_corr("_rx", "_ry").alias(out))
    return res if keys else res.drop(ALL)


def safe_corr(x, y) -> Column:
    """Pearson correlation; null (not NaN, not an error) when a side is constant."""
    c = F.corr(x, y)
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.nanvl(c, F.lit(None)))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value, probs: Mapping[str, float], accuracy: int = 10000,
    bounded: bool = False, few: bool = False,
) -> DataFrame:
    """Exact linear-interpolated quantiles, one column per entry of ``probs``.

    A sketch brackets each wanted rank; one more pass counts what lies below the
    bracket and keeps only the values inside it (about 8/accuracy of a key), so no
    key is ever sorted or held as a whole. Raise ``accuracy`` with the row count.
    ``few`` says that the keys are known to be few, such as column names: their brackets are
    broadcast, so that the rows of a key stay where they are instead of meeting in one task.
    """
    v = F.col(value) if isinstance(value, str) else value
    d, k = _keyed(df.select(*keys, v.cast("double").alias("_v")), keys)
    d = d.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    names, ps = list(probs), [float(probs[n]) for n in probs]
    if bounded and keys:
        return d.groupBy(*k).agg(*[F.percentile("_v", p).alias(n) for n, p in zip(names, ps)])
    eps = 4.0 / accuracy
    lo = [max(p - eps, 0.0) for p in ps]
    hi = [min(p + eps, 1.0) for p in ps]
    bounds = d.groupBy(*k).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", lo + hi, accuracy).alias("_b")
    )
    inf = float("inf")
    m = len(ps)
    parts = []
    for i, p in enumerate(ps):
        # A hair of slack keeps the bracket valid when an upstream sum is recomputed in another order.
        # Small keys (bracket under two ranks wide) are taken whole.
        a, b = F.element_at("_b", i + 1), F.element_at("_b", m + i + 1)
        whole = F.col("_n") * eps < 2
        low = F.lit(-inf) if lo[i] <= 0 else F.when(whole, F.lit(-inf)).otherwise(a - F.abs(a) * 1e-9)
        high = F.lit(inf) if hi[i] >= 1 else F.when(whole, F.lit(inf)).otherwise(b + F.abs(b) * 1e-9)
        parts.append(F.when(
            F.col("_v") <= high,
            F.struct(F.lit(i).alias("i"), F.when(F.col("_v") >= low, F.col("_v")).alias("v")),
        ))
    slices = (
        _attach(d, bounds, k, few)
        .select(*k, "_n", F.explode(F.array_compact(F.array(*parts))).alias("_s"))
        .groupBy(*k, "_n", F.col("_s.i").alias("_i"), F.col("_s.v").alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    w = Window.partitionBy(*k, "_i").orderBy(F.col("_v").asc_nulls_first())
    run = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    prob = F.element_at(F.array(*[F.lit(p) for p in ps]), F.col("_i") + 1)
    s = slices.withColumn("_end", run).withColumn("_h", prob * (F.col("_n") - 1))

    def at(rank):
        return F.max(F.when((rank >= F.col("_end") - F.col("_c")) & (rank < F.col("_end")), F.col("_v")))

    picked = s.groupBy(*k, "_i", "_h").agg(at(F.floor("_h")).alias("_f"), at(F.ceil("_h")).alias("_g"))
    val = F.col("_f") + (F.col("_h") - F.floor("_h")) * (F.col("_g") - F.col("_f"))
    res = picked.groupBy(*k).agg(
        *[F.max(F.when(F.col("_i") == i, val)).alias(n) for i, n in enumerate(names)]
    )
    return res if keys else res.drop(ALL)


def robust_sigma(df: DataFrame, keys: Sequence[str], value: str, out: str = "sigma", bounded: bool = False) -> DataFrame:
    """Per key: 1.4826*MAD, else population deviation, else IQR/1.349, else 1e-6."""
    d, k = _keyed(df.select(*keys, F.col(value).alias("_x")).where(F.col("_x").isNotNull()), keys)
    q = exact_quantiles(d, k, "_x", {"_med": 0.5, "_q1": 0.25, "_q3": 0.75}, bounded=bounded)
    dev = _attach(d, q, k).withColumn("_dev", F.abs(F.col("_x") - F.col("_med")))
    mad = exact_quantiles(dev, k, "_dev", {"_mad": 0.5}, bounded=bounded)
    pop = d.groupBy(*k).agg(F.stddev_pop("_x").alias("_sd"))
    tiny = 1e-12
    sig = (
        F.when(1.4826 * F.col("_mad") > tiny, 1.4826 * F.col("_mad"))
        .when(F.col("_sd") > tiny, F.col("_sd"))
        .when(F.col("_q3") - F.col("_q1") > tiny, (F.col("_q3") - F.col("_q1")) / 1.349)
        .otherwise(1e-6)
    )
    res = _attach(_attach(q, mad, k), pop, k).select(*k, F.col("_med").alias("median"), F.col("_mad").alias("mad"), sig.alias(out))
    return res if keys else res.drop(ALL)


def bias_corrected_moments(c) -> tuple[Column, Column]:
    """Bias-corrected skewness (n>=3) and excess kurtosis (n>=4) aggregates."""
    n = F.count(c).cast("double")
    spread = F.min(c) < F.max(c)
    g1, g2 = F.skewness(c), F.kurtosis(c)
    skew = F.when((n >= 3) & spread, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when((n >= 4) & spread, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return skew, kurt


def concordance(df: DataFrame, keys: Sequence[str], x: str, y: str, bounded: bool = False, block: int = BLOCK) -> DataFrame:
    """Per key: pairs with different x (``comparable``) and those ordered alike in y (``preserved``).

    The ranks of both values are cut into blocks of ``block``. A pair in different blocks on both sides is counted from the
    numbers of rows per cell of that grid; one in the same block of a side is counted inside the block, which a task holds
    as two columns. So a key of n rows sends 2 n rows, and no block grows with n.
    """
    d, k = _keyed(df.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")), keys)
    d = d.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    rx, ry = (value_ranks(d, k, c, bounded=bounded) for c in ("_x", "_y"))
    totals = rx.groupBy(*k).agg(
        F.sum("ties").alias("_n"), F.sum(F.col("ties") * (F.col("ties") - 1) / 2).alias("_tied")
    )
    totals = cut_lineage(totals.withColumn("_g", F.monotonically_increasing_id()))
    # A value with more ties than a block holds is a block of its own: it ends behind the block in which it starts.
    part = (F.floor(F.col("less") / block) * 2 + (F.col("ties") > block).cast("int")).cast("bigint")
    pts = d.join(rx.select(*k, "_x", F.col("less").alias("_u"), part.alias("_bu")), [*k, "_x"])
    pts = pts.join(ry.select(*k, "_y", F.col("less").alias("_v"), part.alias("_bv")), [*k, "_y"])
    pts = _attach(pts, totals.select(*k, "_n", "_g"), k).select("_g", "_n", "_u", "_v", "_bu", "_bv")
    cells = pts.where(F.col("_n") > block).groupBy("_g", "_n", "_bu", "_bv").agg(F.count("*").alias("_c"))
    good = _pairs_in_blocks(concordance_blocks(pts, block)).unionByName(_pairs_across_cells(cells, block))
    res = totals.join(good.groupBy("_g").agg(F.sum("preserved").alias("preserved")), "_g", "left").select(
        *k,
        (F.col("_n") * (F.col("_n") - 1) / 2 - F.col("_tied")).cast("bigint").alias("comparable"),
        F.coalesce("preserved", F.lit(0)).cast("bigint").alias("preserved"),
    )
    return res if keys else res.drop(ALL)


def concordance_blocks(pts: DataFrame, block: int) -> DataFrame:
    """_g, _b, _u, _v: each point in its block of x, and in its block of y with the block of x as _u; blocks of one value are left out."""
    in_x = F.when(F.col("_bu") % 2 == 0, F.struct((F.col("_bu")).alias("_b"), F.col("_u").alias("_u")))
    in_y = F.when((F.col("_n") > block) & (F.col("_bv") % 2 == 0), F.struct((F.col("_bv") + 1).alias("_b"), F.col("_bu").alias("_u")))
    return pts.select("_g", "_v", F.explode(F.array_compact(F.array(in_x, in_y))).alias("_s")).select("_g", "_s._b", "_s._u", "_v")


def concordant_pairs(starts: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Pairs with smaller u and smaller v in each group of rows from one of ``starts`` to the next; inside it ``v`` rises.

    Two points with different u first differ at exactly one bit; there they share a prefix (a node) and fall on different
    sides. From bit to bit the rows of a node part into its left and right ones, each side still by rising v."""
    sizes = np.diff(np.append(starts, len(u)))
    lo, hi = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
    out, i = np.zeros(len(starts), np.int64), np.arange(len(u))
    for bit in range(int(u.max(initial=0)).bit_length() - 1, -1, -1):
        right = (u >> bit & 1).astype(bool)
        left = np.concatenate(([0], np.cumsum(~right)))
        run = lo == i
        run[1:] |= v[1:] != v[:-1]
        before = left[lo]
        out += np.add.reduceat(np.where(right, left[np.maximum.accumulate(np.where(run, i, 0))] - before, 0), starts)
        mid = lo + left[hi] - before
        at = np.where(right, mid + i - lo - left[:-1] + before, lo + left[:-1] - before)
        parted = np.empty((4, len(u)), np.int64)
        parted[:, at] = u, v, np.where(right, mid, lo), np.where(right, hi, mid)
        u, v, lo, hi = parted
    return out


def _pairs_in_blocks(rows: DataFrame) -> DataFrame:
    """_g, preserved: the concordant pairs inside the blocks; a task reads its blocks one after the other."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(m: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate(([True], (m[:2, 1:] != m[:2, :-1]).any(axis=0))))
            sizes = np.diff(np.append(starts, m.shape[1]))
            u = m[2] - np.repeat(np.minimum.reduceat(m[2], starts), sizes)
            return pa.RecordBatch.from_arrays([pa.array(m[0, starts]), pa.array(concordant_pairs(starts, u, m[3]))], names=["_g", "preserved"])

        held = np.zeros((4, 0), np.int64)  # the last block, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.concatenate((held, np.stack([batch.column(c).to_numpy() for c in range(4)])), axis=1)
            last = int(np.flatnonzero(np.concatenate(([True], (m[:2, 1:] != m[:2, :-1]).any(axis=0))))[-1])
            if last:
                yield made(m[:, :last])
            held = m[:, last:]
        if held.shape[1]:
            yield made(held)

    ordered = rows.select("_g", "_b", "_u", "_v").repartition("_g", "_b").sortWithinPartitions("_g", "_b", "_v")
    return ordered.mapInArrow(count, "_g bigint, preserved bigint")


def _pairs_across_cells(cells: DataFrame, block: int) -> DataFrame:
    """_g, preserved: pairs of points in cells that differ on both sides, by counting left-side rows under every (prefix, bit) of _bu."""
    top = F.ceil(F.log2(F.col("_n") / block + 1)).cast("int") + 1
    bits = cells.select("_g", "_bv", "_c", "_bu", F.explode(F.sequence(F.lit(0), top)).alias("_bit"))
    side = F.expr("shiftright(_bu, _bit) & 1")
    node = ["_g", "_bit", "_prefix"]
    per_y = bits.withColumn("_prefix", F.expr("shiftright(_bu, _bit + 1)")).groupBy(*node, "_bv").agg(
        F.sum(F.when(side == 0, F.col("_c")).otherwise(0)).alias("_left"),
        F.sum(F.when(side == 1, F.col("_c")).otherwise(0)).alias("_right"),
    )
    return prefix_sums(per_y, node, "_bv", "_left", "_lb", bounded=True).select("_g", (F.col("_lb") * F.col("_right")).alias("preserved"))


def with_position(df: DataFrame, keys: Sequence[str], order: str, out: str = "pos", buckets: int = 64, bounded: bool = False) -> DataFrame:
    """0-based position inside each key; ``order`` is numeric and unique per key."""
    return prefix_sums(df.withColumn("_unit", F.lit(1)), keys, order, "_unit", out, buckets, bounded).drop("_unit")


def with_neighbours(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str], offsets: Sequence[int],
                    bounded: bool = False) -> DataFrame:
    """Attach each column of the rows ``offset`` positions away as ``<col>_m1`` / ``<col>_p1`` and so on.

    Every row is sent to the positions that want it, so a long series spreads over all tasks.
    """
    def tag(o):
        return f"m{-o}" if o < 0 else f"p{o}"

    if bounded:
        w = Window.partitionBy(*keys).orderBy(pos)
        return df.withColumns({f"{c}_{tag(o)}": F.lag(c, -o).over(w) for o in offsets for c in cols})
    sent = df.select(*keys, F.col(pos), F.struct(*cols).alias("_v"), F.explode(F.array(*[F.lit(o) for o in offsets])).alias("_o"))
    got = sent.select(*keys, (F.col(pos) - F.col("_o")).alias(pos), "_o", "_v").groupBy(*keys, pos).agg(
        *[F.max(F.when(F.col("_o") == o, F.col("_v"))).alias(f"_{tag(o)}") for o in offsets])
    res = df.join(got, [*keys, pos], "left")
    for o in offsets:
        res = res.withColumns({f"{c}_{tag(o)}": F.col(f"_{tag(o)}")[c] for c in cols}).drop(f"_{tag(o)}")
    return res
