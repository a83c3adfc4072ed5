"""Spectrum grids and the descriptors computed from them.

Interpolation works segment by segment on the long point table; from then on one spectrum is
one row holding its grid as an array, and every descriptor is an array expression.
"""

from __future__ import annotations

import math
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.functions.columns import nan_to_null, once, to_number
from corvida.functions.ranks import bounded_groups, with_neighbours, with_position


def clean_points(df: DataFrame, key: str, x: str, y: str, order: str) -> DataFrame:
    """Numeric points, first value wins on a repeated x."""
    kinds = dict(df.dtypes)
    number = lambda c: nan_to_null(c) if kinds.get(c) == "double" else to_number(c)  # noqa: E731  (the way through text gives a double back as it is)
    d = df.select(F.col(key), number(x).alias("x"), number(y).alias("y"), F.col(order).alias("_o")).where("x IS NOT NULL AND y IS NOT NULL")
    return d.groupBy(key, "x").agg(F.min_by("y", "_o").alias("y"))


def grid_values(lo: float, hi: float, step: float) -> list[float]:
    return [lo + i * step for i in range(int(ceil((hi + step - lo) / step - 1e-9)))]


def interpolate(points: DataFrame, key: str, lo: float, hi: float, step: float) -> DataFrame:
    """(key, g, v): linear interpolation at the grid points inside the measured range of each spectrum (2+ points)."""
    last = len(grid_values(lo, hi, step)) - 1
    small = bounded_groups(points, [key])
    p = with_neighbours(with_position(points, [key], "x", "pos", bounded=small), [key], "pos", ["x", "y"], [-1, 1], small)
    p = p.where("x_p1 IS NOT NULL OR x_m1 IS NOT NULL")
    end = F.col("x_p1").isNull()
    first = F.greatest(F.ceil((F.col("x") - lo) / step), F.lit(0))
    stop = F.least(F.when(end, F.floor((F.col("x") - lo) / step)).otherwise(F.ceil((F.col("x_p1") - lo) / step) - 1), F.lit(last))
    p = p.where(first <= stop).withColumn("g", F.explode(F.sequence(first, stop)))
    gx = F.lit(lo) + F.col("g") * step
    v = F.when(end, F.col("y")).otherwise(F.col("y") + (gx - F.col("x")) * (F.col("y_p1") - F.col("y")) / (F.col("x_p1") - F.col("x")))
    return p.select(key, F.col("g").cast("int").alias("g"), v.alias("v"))


def _sum(a, f=lambda v: v) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v))


def normalized_grid(covered: DataFrame, key: str, size: int, method: str = "min-max", invert: bool = False) -> DataFrame:
    """(key, grid): gaps filled with the spectrum's median, optional inversion, then min-max / sum / vector / none."""
    g = covered.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("g", "v"))).alias("m"))

    def filled(values: Column) -> Column:
        known = F.array_sort(F.array_compact(values))
        middle = lambda s: 0.5 * F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + 0.5 * F.get(s, F.floor(F.size(s) / 2).cast("int"))
        return once(once(known, middle), lambda med: F.transform(values, lambda v: F.coalesce(v, med)))

    cells = once(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.try_element_at("m", i)), filled)

    # Each grid and scalar is bound once: a column named inside a lambda is put in its place and computed for every element.
    def inverted(a: Column) -> Column:
        return once(F.array_max(a), lambda hi: F.transform(a, lambda v: hi - v))

    def scaled(a: Column) -> Column:
        if method == "min-max":
            return once(F.array_min(a), lambda lo: once(F.array_max(a) - lo, lambda d: F.transform(
                a, lambda v: F.when(d > 1e-12, (v - lo) / F.when(d > 1e-12, d)).otherwise(0.0))))
        norm = _sum(a, F.abs) if method == "sum" else F.sqrt(_sum(a, lambda v: v * v))
        return once(norm, lambda n: F.transform(a, lambda v: v / F.when(n > 1e-12, n).otherwise(1.0)))

    grid = once(cells, inverted) if invert else cells
    # The generator is a barrier: filters and sums on the grid would else move below it and make it again.
    return g.select(key, F.explode(F.array(grid if method == "none" else once(grid, scaled))).alias("grid"))


def windows(lo: float, hi: float, step: float, width: int) -> list[tuple[int, int, int, int]]:
    """(left, right, first index, count) of the value windows over a grid."""
    grid = grid_values(lo, hi, step)
    out, left = [], int(grid[0])
    while left < int(grid[-1]):
        idx = [i for i, x in enumerate(grid) if left <= x < left + width]
        out.append((left, left + width, idx[0] if idx else 0, len(idx)))
        left += width
    return out


def binary_fingerprint(df: DataFrame, grid: str, lo: float, hi: float, step: float, width: int = 20, threshold: float = 0.1, out: str = "bits") -> DataFrame:
    """Per window 1 when its maximum reaches ``threshold`` of the global maximum."""
    top = F.array_max(grid)
    top = F.when(top > 1e-12, top).otherwise(1.0)
    bits = [F.when(F.array_max(F.slice(grid, i + 1, n)) >= threshold * F.col("_top"), 1).otherwise(0) if n else F.lit(0) for _, _, i, n in windows(lo, hi, step, width)]
    return df.withColumn("_top", top).withColumn(out, F.when(F.col(grid).isNotNull(), F.array(*bits))).drop("_top")


def band_descriptors(df: DataFrame, grid: str, lo: float, hi: float, step: float, width: int = 100, out: str = "bands") -> DataFrame:
    """Array of (band, mean, max, area); area by trapezoids inside the band."""
    parts = []
    for left, _, i, n in windows(lo, hi, step, width):
        if not n:
            continue
        s = F.slice(grid, i + 1, n)
        ends = (F.element_at(grid, i + 1) + F.element_at(grid, i + n)) / 2
        area = (_sum(s) - ends) * float(step) if n >= 2 else F.lit(0.0)
        parts.append(F.struct(F.lit(left).alias("band"), (_sum(s) / float(n)).alias("mean"), F.array_max(s).alias("max"), area.alias("area")))
    return df.withColumn(out, F.when(F.col(grid).isNotNull(), F.array(*parts)))


def describe(points: DataFrame, key: str, lo: float, hi: float, step: float, method: str = "min-max", invert: bool = False, bit_width: int = 20, band_width: int = 100, threshold: float = 0.1) -> DataFrame:
    """Grid, fingerprint and bands of every spectrum; a spectrum that misses the grid keeps nulls."""
    ids = points.select(key).distinct()
    g = normalized_grid(interpolate(points, key, lo, hi, step), key, len(grid_values(lo, hi, step)), method, invert)
    d = ids.join(g, key, "left")
    return band_descriptors(binary_fingerprint(d, "grid", lo, hi, step, bit_width, threshold), "grid", lo, hi, step, band_width)


def build_dataset(best: DataFrame, cache: DataFrame, points: DataFrame, key: str, **settings) -> tuple[DataFrame, DataFrame]:
    """(descriptor rows, report): cached spectra are looked up, only the others are computed."""
    hit = best.join(cache, key)
    todo = best.join(cache.select(key), key, "left_anti")
    fresh = describe(points.join(todo.select(key).distinct(), key, "left_semi"), key, **settings)
    rows = hit.withColumn("from_cache", F.lit(True)).unionByName(todo.join(fresh, key, "left").withColumn("from_cache", F.lit(False)), allowMissingColumns=True)
    report = rows.agg(F.count("*").alias("selected"), F.count_if("from_cache").alias("cache_hits"), F.count_if(F.col("grid").isNotNull()).alias("with_descriptors"), F.count_if(F.col("grid").isNull()).alias("without_descriptors"))
    return rows, report


def symmetric_moments(a: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric 3x3 matrix (xx, xy, xz, yy, yz, zz), smallest first, in the closed trigonometric form."""
    q = (a["xx"] + a["yy"] + a["zz"]) / 3
    dx, dy, dz = a["xx"] - q, a["yy"] - q, a["zz"] - q
    off = a["xy"] * a["xy"] + a["xz"] * a["xz"] + a["yz"] * a["yz"]
    p = F.sqrt((dx * dx + dy * dy + dz * dz + 2 * off) / 6)
    det = dx * (dy * dz - a["yz"] * a["yz"]) - a["xy"] * (a["xy"] * dz - a["yz"] * a["xz"]) + a["xz"] * (a["xy"] * a["yz"] - dy * a["xz"])
    angle = F.when(p > 0, F.acos(F.greatest(F.least(det / (2 * p * p * p), F.lit(1.0)), F.lit(-1.0))) / 3).otherwise(F.when(p == 0, 0.0))
    large, small = q + 2 * p * F.cos(angle), q + 2 * p * F.cos(angle + 2 * math.pi / 3)
    return small, 3 * q - large - small, large


def geometry(df: DataFrame, key: str, x: str, y: str, z: str, heavy: str | None = None) -> DataFrame:
    """Centroid and pair distances, principal moments, asphericity and eccentricity of a small 3-D point set per key.

    The pairs of a key are formed inside its row, so a key must be a single object (a molecule's atoms). One point has no
    pair distances and no moments; ``heavy`` names a flag column of the points to count.
    """
    c = df.groupBy(key).agg(F.count("*").alias("n"), *[F.avg(v).alias(f"_m{v}") for v in (x, y, z)])
    d = df.join(c, key)
    dx, dy, dz = (F.col(v) - F.col(f"_m{v}") for v in (x, y, z))
    r = F.sqrt(dx * dx + dy * dy + dz * dz)
    named = dict(zip("xyz", (x, y, z)))
    entries = ("xx", "xy", "xz", "yy", "yz", "zz")
    point = F.struct(*[F.col(v).cast("double").alias(k) for k, v in named.items()])
    g = d.groupBy(key).agg(
        F.count("*").alias("n"), *([F.count_if(F.col(heavy)).alias("heavy_count")] if heavy else []), F.sqrt(F.avg(r * r)).alias("radius_gyration"), F.max(r).alias("max_centroid_distance"),
        F.avg(r).alias("mean_centroid_distance"), F.stddev_pop(r).alias("std_centroid_distance"), *[F.covar_samp(named[e[0]], named[e[1]]).alias(f"cov_{e}") for e in entries], F.collect_list(point).alias("_p"))

    def apart(a, b):
        return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]) + (a["z"] - b["z"]) * (a["z"] - b["z"]))

    pairs = F.flatten(F.transform("_p", lambda a, i: F.transform(F.slice("_p", i + 2, F.size("_p")), lambda b: apart(a, b))))
    g = g.withColumn("_d", pairs)
    n = F.size("_d")
    mean = F.when(n > 0, F.aggregate("_d", F.lit(0.0), lambda s, v: s + v) / n)
    g = g.withColumns({"pair_distance_min": F.array_min("_d"), "pair_distance_max": F.array_max("_d"), "pair_distance_mean": mean})
    spread = F.aggregate(F.transform("_d", lambda v: (v - F.col("pair_distance_mean")) * (v - F.col("pair_distance_mean"))), F.lit(0.0), lambda s, v: s + v)
    g = g.withColumn("pair_distance_std", F.when(n > 0, F.sqrt(spread / n))).drop("_p", "_d")
    small, middle, large = symmetric_moments({e: F.col(f"cov_{e}") for e in entries})
    g = g.withColumns({"moment_1": small, "moment_2": middle, "moment_3": large})
    bent = F.greatest(F.lit(0.0), 1 - F.col("moment_1") / F.col("moment_3"))
    return g.withColumns({"asphericity": F.col("moment_3") - (F.col("moment_1") + F.col("moment_2")) / 2,
                          "eccentricity": F.when(F.abs("moment_3") > 1e-12, F.sqrt(bent))})
