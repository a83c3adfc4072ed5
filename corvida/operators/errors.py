"""Error profiles by overlapping groups, clusters, ordered series and substitution effects.

Error here is calculated - experimental.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvida.functions.columns import POISSON_CUTS, portable_hash_block, ratio
from corvida.functions.frames import with_scalars
from corvida.functions.ranks import bounded_groups, concordance, exact_quantiles, prefix_sums, spearman

ADEQUATE = 10


def error_metrics(df: DataFrame, keys: Sequence[str], overall: DataFrame | None = None,
                  error: str = "error", multiplier: float = 2.0,
                  bounded: bool = False) -> DataFrame:
    """Per group: size, MAE, RMSE, bias, median and largest error, share of large errors, MAE against overall."""
    work = df.where(F.col(error).isNotNull() & ~F.isnan(error))
    if overall is None:
        overall = work
    base = overall.agg(F.avg(F.abs(error)).alias("_overall"))
    cut = F.greatest(F.lit(1e-12), F.lit(multiplier) * F.col("_overall"))
    work = with_scalars(work, base)
    out = work.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(F.col(error) * F.col(error))).alias("rmse"),
        F.avg(error).alias("bias"), F.max(F.abs(error)).alias("max_ae"),
        F.avg(F.when(F.abs(error) >= cut, 1.0).otherwise(0.0)).alias("large_error_fraction"),
        F.max("_overall").alias("_overall"),
    )
    out = out.withColumn("mae_vs_overall_percent",
                         F.when(F.col("_overall") > 1e-12, (F.col("mae") / F.col("_overall") - 1) * 100)).drop("_overall")
    med = exact_quantiles(work, keys, F.abs(error), {"median_ae": 0.5}, bounded=bounded)
    out = out.join(med, list(keys)) if keys else with_scalars(out, med)
    return out.withColumn("reliability", F.when(F.col("n") >= ADEQUATE, "adequate").otherwise("small_group"))


def group_members(df: DataFrame, flags: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per (row, group it belongs to), every row also under ``overall``."""
    names = F.array(F.lit("overall"), *[F.when(F.coalesce(F.col(f), F.lit(False)), F.lit(f)) for f in flags])
    return df.select(*keep, F.explode(F.array_compact(names)).alias("group_id"))


def group_summary(df: DataFrame, flags: Sequence[str], error: str = "error", min_size: int = 5) -> DataFrame:
    """Error metrics of every large enough overlapping group plus ``overall``."""
    members = group_members(df, flags, [error])
    out = error_metrics(members, ["group_id"], overall=df, error=error)
    return out.where((F.col("n") >= min_size) | (F.col("group_id") == "overall"))


def group_drilldown(df: DataFrame, group: str) -> DataFrame:
    """Rows of one overlapping group (``overall`` keeps all)."""
    return df if group == "overall" else df.where(F.coalesce(F.col(group), F.lit(False)))


def bootstrap_mae(df: DataFrame, keys: Sequence[str], ident: str, error: str = "error", replicates: int = 500, block: int = 4096) -> DataFrame:
    """2.5 / 97.5 percentiles of the resampled MAE; ``ident`` is a non-negative integer.

    Each (row, replicate) draws its resampling count from a hash, in blocks of ``block`` rows times all replicates; a
    partition sends one row of sums per group, and groups x replicates numbers are added up after that.
    """
    k = list(keys)
    work = df.where(F.col(error).isNotNull()).select(*k, F.abs(F.col(error).cast("double")).alias("_a"), F.col(ident).cast("bigint").alias("_id"))
    cuts, salts = np.array(POISSON_CUTS), np.arange(replicates)

    def add(batches):
        acc: dict = {}
        for pdf in batches:
            for name, g in pdf.groupby(k, sort=False, dropna=False):
                a, ids = g["_a"].to_numpy(float), g["_id"].to_numpy(np.int64)
                total = acc.setdefault(name, np.zeros((2, replicates)))
                for i in range(0, len(a), block):
                    w = np.searchsorted(cuts, portable_hash_block(ids[i:i + block], salts), side="right")
                    total += np.stack((w.sum(axis=0), a[i:i + block] @ w))
        if acc:
            yield pd.DataFrame({**{c: [n[i] for n in acc] for i, c in enumerate(k)}, "_w": [t[0].tolist() for t in acc.values()], "_s": [t[1].tolist() for t in acc.values()]})

    schema = "".join(f"`{c}` {work.schema[c].dataType.simpleString()}, " for c in k) + "_w array<double>, _s array<double>"
    parts = work.mapInPandas(add, schema).select(*k, F.posexplode(F.arrays_zip("_w", "_s")).alias("replicate", "_p"))
    rep = parts.groupBy(*k, "replicate").agg((F.sum("_p._s") / F.sum("_p._w")).alias("mae"), F.sum("_p._w").alias("_n")).where("_n > 0")
    # One value per replicate: the groups here hold `replicates` rows at most.
    return rep.groupBy(*k).agg(F.percentile("mae", 0.025).alias("mae_ci_low"), F.percentile("mae", 0.975).alias("mae_ci_high"))


def safe_slope(y: str, x: str, minimum: int = 3) -> Column:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    lo, hi = F.min(F.when(both, F.col(x))), F.max(F.when(both, F.col(x)))
    return F.when((F.count_if(both) >= minimum) & (lo < hi), F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")))


def monotonic_direction(df: DataFrame, key: str, size: str, value: str, out: str) -> DataFrame:
    """increasing / decreasing / non_monotonic / insufficient, from the per-size means of a key."""
    w = Window.partitionBy(key).orderBy(size)
    means = df.where(F.col(size).isNotNull() & F.col(value).isNotNull()).groupBy(key, size).agg(
        F.avg(value).alias("_m"), F.count("*").alias("_n"))
    step = means.withColumn("_d", F.col("_m") - F.lag("_m").over(w))
    return step.groupBy(key).agg(
        F.when((F.sum("_n") < 3) | (F.count("*") < 3), "insufficient")
        .when(F.min("_d") >= 0, "increasing").when(F.max("_d") <= 0, "decreasing").otherwise("non_monotonic").alias(out))


def trend_outliers(df: DataFrame, key: str, size: str, value: str, bounded: bool = False) -> DataFrame:
    """Rows with ``trend_outlier``: robust z of the line residual above 3.5 (4+ points, 3+ sizes)."""
    line = df.where(F.col(size).isNotNull() & F.col(value).isNotNull()).groupBy(key, size).agg(
        F.count("*").alias("c"), F.sum(value).alias("sv")).groupBy(key).agg(
        F.sum("c").alias("n"), F.count("*").alias("sizes"), F.sum(F.col("c") * F.col(size)).alias("sx"),
        F.sum("sv").alias("sy"), F.sum(F.col("c") * F.col(size) * F.col(size)).alias("sxx"),
        F.sum(F.col("sv") * F.col(size)).alias("sxy"))
    den = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    line = line.where("n >= 4 AND sizes >= 3").withColumn("slope", (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / den)
    line = line.select(key, "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"))
    res = df.join(line, key, "left").withColumn("_res", F.col(value) - (F.col("intercept") + F.col("slope") * F.col(size)))
    fitted = res.where("_res IS NOT NULL")
    med = exact_quantiles(fitted, [key], "_res", {"_med": 0.5}, bounded=bounded)
    dev = fitted.join(med, key).withColumn("_dev", F.abs(F.col("_res") - F.col("_med")))
    mad = exact_quantiles(dev, [key], "_dev", {"_mad": 0.5}, bounded=bounded)
    res = res.join(med, key, "left").join(mad, key, "left")
    z = F.abs(F.col("_res") - F.col("_med")) / F.when(F.col("_mad") > 1e-15, 1.4826 * F.col("_mad"))
    return res.withColumn("trend_outlier", F.coalesce(z > 3.5, F.lit(False))).drop("slope", "intercept", "_res", "_med", "_mad")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, salt_on: str, out: str = "rank") -> DataFrame:
    """First n rows of every key; a salted pass keeps one hot key from sorting in one task."""
    part = F.pmod(F.xxhash64(salt_on), F.lit(64))
    first = Window.partitionBy(*keys, "_part").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_part", part).withColumn(out, F.row_number().over(first)).where(F.col(out) <= n)
            .withColumn(out, F.row_number().over(final)).where(F.col(out) <= n).drop("_part"))


def series_summary(df: DataFrame, series: str = "series_id", size: str = "size", ident: str = "original_index",
                   min_series_size: int = 5) -> DataFrame:
    """Error metrics and trend diagnostics of every ordered series."""
    small = bounded_groups(df, [series])
    metric = error_metrics(df, [series], bounded=small).drop("reliability")
    agg = df.groupBy(series).agg(
        F.min(size).cast("double").alias("size_min"), F.max(size).cast("double").alias("size_max"),
        safe_slope("error", size).alias("error_size_slope"), safe_slope("absolute_error", size).alias("absolute_error_size_slope"))
    rho = spearman(df, [series], size, "experimental", "property_size_correlation", small)
    rho = rho.select(series, F.when(F.col("n") >= 3, F.col("property_size_correlation")).alias("property_size_correlation"))
    mono_e = monotonic_direction(df, series, size, "experimental", "experimental_monotonicity")
    mono_p = monotonic_direction(df, series, size, "predicted", "predicted_monotonicity")
    order = concordance(df, [series], "experimental", "predicted", small).select(
        series, ratio("preserved", "comparable").alias("order_preservation"))
    outl = trend_outliers(df, series, size, "experimental", small).groupBy(series).agg(F.count_if("trend_outlier").alias("trend_outlier_count"))
    top = top_per_key(df, [series], [F.col("absolute_error").desc(), F.col(ident)], 3, ident)
    top = top.groupBy(series).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", F.col(ident).cast("string").alias("v")))), lambda s: s["v"]), ";").alias("problem_ids"))
    out = metric.join(agg, series)
    for part in (rho, mono_e, mono_p, order, outl, top):
        out = out.join(part, series, "left")
    e, p = F.col("experimental_monotonicity"), F.col("predicted_monotonicity")
    return out.withColumns({
        "trend_direction_preserved": (e == p) & ~e.isin("insufficient", "non_monotonic"),
        "reliability": F.when(F.col("n") >= min_series_size, "adequate").otherwise("insufficient"),
    })


# Display order of branched-chain series; any other label follows.
SERIES_ORDER = (
    "n-alkanes", "2-methylalkanes", "3-methylalkanes", "4-methylalkanes", "methylalkanes", "2,2-dimethylalkanes",
    "2,3-dimethylalkanes", "2,4-dimethylalkanes", "3,3-dimethylalkanes", "dimethylalkanes", "ethyl-substituted alkanes",
    "ethyl-methyl alkanes", "trimethylalkanes", "tetramethylalkanes", "highly-branched alkanes", "branched alkanes",
)


def residual_by_series(df: DataFrame, label: str, size: str, ident: str, order: Sequence[str] = SERIES_ORDER) -> DataFrame:
    """Residual (experimental - calculated) summary per series label, with three examples by size."""
    r = F.col("experimental") - F.col("predicted")
    work = df.where(F.coalesce(F.trim(F.col(label)), F.lit("")) != "").withColumn("_r", r).where("_r IS NOT NULL")
    agg = work.groupBy(label).agg(
        F.count("*").alias("n"), F.avg("experimental").alias("mean_experimental"), F.avg("predicted").alias("mean_predicted"),
        F.avg("_r").alias("mean_residual"), F.avg(F.abs("_r")).alias("mae"), F.sqrt(F.avg(F.col("_r") * F.col("_r"))).alias("rmse"),
        F.min(size).alias("size_min"), F.max(size).alias("size_max"))
    ex = top_per_key(work, [label], [F.col(size), F.col(ident)], 3, ident).groupBy(label).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", F.col(ident).cast("string").alias("v")))), lambda s: s["v"]), "; ").alias("examples"))
    pos = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(label))
    return agg.join(ex, label).withColumn("display_order", F.when(pos > 0, pos - 1).otherwise(F.lit(100)).cast("bigint"))


def substitution_pairs(df: DataFrame, rules: Sequence[tuple[Column, Sequence[str], Column, str]],
                       carry: Sequence[str] = ()) -> DataFrame:
    """Pair every substituted row with the first matching reference row.

    ``rules`` lists (which substituted rows, key columns, which rows can be references,
    comparison-size column); the first rule that applies to a row decides. References are
    reduced to one row per key before the join.
    """
    taken = F.lit(False)
    out = None
    for when, keys, reference, size in rules:
        ref = df.where(reference).groupBy(*keys).agg(
            F.min_by(F.struct(F.col("original_index").alias("reference_index"), F.col("experimental").alias("_re"),
                              F.col("predicted").alias("_rp")), F.struct("original_index", "row_position")).alias("_ref"))
        subs = df.where((F.col("substituent_count") > 0) & when & ~taken)
        taken = taken | when
        pair = subs.join(ref, list(keys)).select(
            "series_id", *carry, F.col(size).cast("double").alias("comparison_size"), F.col("_ref.reference_index"),
            F.col("original_index").alias("substituted_index"),
            (F.col("experimental") - F.col("_ref._re")).alias("delta_experimental"),
            (F.col("predicted") - F.col("_ref._rp")).alias("delta_predicted"))
        out = pair if out is None else out.unionByName(pair)
    e, p = F.col("delta_experimental"), F.col("delta_predicted")
    return out.withColumns({
        "delta_error": p - e, "absolute_delta_error": F.abs(p - e),
        "direction_correct": ((F.abs(e) <= 1e-12) & (F.abs(p) <= 1e-12)) | (e * p > 0),
    })


def family_rules() -> list[tuple[Column, list[str], Column, str]]:
    """Reference rules per family: same size chain, same ring scaffold, or same reference scheme and size."""
    fam = F.col("family")
    bare = F.col("substitution_scheme") == "none"
    return [
        (fam == "alkane", ["family", "carbon_count"], bare & (fam == "alkane"), "carbon_count"),
        (fam.isin("aromatic", "heterocyclic", "carbocyclic"), ["family", "scaffold"], bare, "parent_size"),
        (F.lit(True), ["family", "reference_scheme", "carbon_count"], F.col("substituent_count") == 0, "carbon_count"),
    ]


def effect_summary(pairs: DataFrame, min_series_size: int = 3) -> DataFrame:
    """Accuracy of the substitution effect per series."""
    return pairs.groupBy("series_id").agg(
        F.count("*").alias("n"), F.avg("absolute_delta_error").alias("effect_mae"),
        F.sqrt(F.avg(F.col("delta_error") * F.col("delta_error"))).alias("effect_rmse"), F.avg("delta_error").alias("effect_bias"),
        F.avg(F.when(F.col("direction_correct"), 1.0).otherwise(0.0)).alias("direction_accuracy"),
        safe_slope("delta_experimental", "comparison_size").alias("experimental_effect_slope"),
        safe_slope("delta_predicted", "comparison_size").alias("predicted_effect_slope"),
        F.when(F.count("*") >= min_series_size, "adequate").otherwise("insufficient").alias("reliability"))


def problem_rows(df: DataFrame, ident: str, multiplier: float = 2.0, buckets: int = 64) -> DataFrame:
    """Large-error flag and the global 1-based rank of the absolute error (largest first, ties by id)."""
    ok = df.where(F.col("absolute_error").isNotNull() & ~F.isnan("absolute_error"))
    ok = with_scalars(ok, ok.agg(F.avg("absolute_error").alias("_mean")))
    ok = ok.withColumn("large_error", F.col("absolute_error") >= F.greatest(F.lit(1e-12), F.lit(multiplier) * F.col("_mean"))).drop("_mean")
    return with_global_rank(ok, F.col("absolute_error"), ident, "error_rank", buckets)


def with_global_rank(df: DataFrame, value: Column, ident: str, out: str, buckets: int = 64) -> DataFrame:
    """1-based position by (value desc, id asc) without a single-task sort: ranks of the distinct
    values come from running totals, ties are numbered inside their value."""
    work = df.withColumn("_neg", -value)
    counts = work.groupBy("_neg").agg(F.count("*").alias("_c"))
    before = prefix_sums(counts, [], "_neg", "_c", "_before", buckets).select("_neg", "_before")
    tie = prefix_sums(work.select("_neg", F.col(ident).alias("_tid"), F.lit(1).alias("_one")), ["_neg"], "_tid", "_one", "_in_tie", buckets)
    tie = tie.select(F.col("_neg").alias("_n2"), "_tid", "_in_tie")
    res = work.join(before, "_neg").join(tie, (F.col("_neg") == F.col("_n2")) & (F.col(ident) == F.col("_tid")))
    return res.withColumn(out, (F.col("_before") + F.col("_in_tie") + 1).cast("bigint")).drop("_neg", "_before", "_n2", "_tid", "_in_tie")


def error_outliers(df: DataFrame, k: float = 2.0) -> DataFrame:
    """Rows whose absolute error exceeds mean + k * sample deviation."""
    lim = df.agg((F.avg("absolute_error") + k * F.stddev_samp("absolute_error")).alias("_lim"))
    return with_scalars(df, lim).where(F.col("absolute_error") > F.col("_lim")).drop("_lim")
