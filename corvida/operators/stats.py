"""Regression metrics, target / descriptor / residual profiles and correlation tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corvida.functions.columns import blank_to_null, finite, ratio
from corvida.functions.frames import with_scalars
from corvida.functions.labels import correlation_strength
from corvida.functions.ranks import GROUP_LIMIT, bias_corrected_moments, exact_quantiles, safe_corr, spearman, with_average_rank
from corvida.operators.clean import long_values
from corvida.operators.gram import BLOCK, block_products


def metric_columns(y: str, p: str) -> dict[str, Column]:
    """One-pass regression metrics (error = y - p)."""
    e = F.col(y) - F.col(p)
    sse = F.sum(e * e)
    sst = F.var_pop(y) * F.count(y)
    return {
        "n": F.count(e), "r2": F.when(sst > 0, 1 - sse / F.when(sst > 0, sst)), "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(F.abs(e)), "me": F.avg(e), "sd": F.stddev_pop(e),
        "mape_percent": F.avg(F.when(F.col(y) != 0, F.abs(e / F.when(F.col(y) != 0, F.col(y))) * 100)),
    }


def regression_metrics(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "y_pred") -> DataFrame:
    """R2, MSE, RMSE, MAE, ME, SD (population), median error and MAPE per key."""
    out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in metric_columns(y, p).items()])
    med = exact_quantiles(df, keys, F.col(y) - F.col(p), {"median_error": 0.5})
    return out.join(med, list(keys)) if keys else with_scalars(out, med)


def target_statistics(df: DataFrame, target: str, ident: str | None = None) -> DataFrame:
    """One row: counts, location, spread, shape and Tukey outliers of the target."""
    t = finite(target) if dict(df.dtypes)[target] == "double" else F.col(target)
    work = df.withColumn("_t", t)
    skew, kurt = bias_corrected_moments("_t")
    base = work.agg(
        F.count("*").alias("rows"), F.count("_t").alias("valid"), F.count_if(F.col("_t").isNull()).alias("missing"),
        F.min("_t").alias("min"), F.max("_t").alias("max"), F.avg("_t").alias("mean"),
        F.stddev_samp("_t").alias("std"), skew.alias("skewness"), kurt.alias("kurtosis"),
    )
    q = exact_quantiles(work, [], "_t", {"q1": 0.25, "median": 0.5, "q3": 0.75}).withColumn("iqr", F.col("q3") - F.col("q1"))
    fence = 1.5 * F.col("iqr")
    out = with_scalars(work.select("_t"), q).agg(
        F.count_if((F.col("_t") < F.col("q1") - fence) | (F.col("_t") > F.col("q3") + fence)).alias("outliers"))
    res = with_scalars(with_scalars(base, q), out)
    if ident:
        dup = df.select(blank_to_null(ident).alias("k")).where("k is not null").groupBy("k").count().agg(
            F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_ids"))
        res = with_scalars(res, dup)
    return res


def descriptor_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per descriptor: mean, sample std, range, missing %, zero %, skewness and constancy flags."""
    d = long_values(df, cols).withColumn("_f", finite("value"))
    skew, _ = bias_corrected_moments("_f")
    sd = F.coalesce(F.stddev_pop("_f"), F.lit(0.0))
    return d.groupBy("name").agg(
        F.count("*").alias("rows"), F.avg("_f").alias("mean"), F.stddev_samp("_f").alias("std"),
        F.min("_f").alias("min"), F.max("_f").alias("max"),
        (F.avg(F.when(F.col("_f").isNull(), 1.0).otherwise(0.0)) * 100).alias("missing_percent"),
        (F.avg(F.when(F.col("_f") == 0, 1.0).otherwise(0.0)) * 100).alias("zero_percent"),
        skew.alias("skewness"),
        F.count_if(F.col("value").isNull() | F.isnan("value")).alias("nan_count"),
        F.count_if(F.abs("value") == float("inf")).alias("inf_count"),
        (sd <= 1e-12).alias("constant"), ((sd > 1e-12) & (sd <= 1e-6)).alias("near_constant"),
    )


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided t-test p-value of a correlation, by the incomplete beta continued fraction."""
    from math import exp, lgamma, log

    if r is None or n is None or n < 3 or abs(r) >= 1:
        return 0.0 if r is not None and n and n >= 3 else None
    dof = n - 2.0
    x = 1.0 - r * r
    a, b = dof / 2.0, 0.5

    def fraction(x, a, b):
        tiny = 1e-300
        c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
        d = 1.0 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 500):
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            step = d * c
            h *= step
            if abs(step - 1) < 1e-14:
                break
        return h

    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) if x < 1 else 0.0
    if x >= 1:
        return 1.0
    if x < (a + 1) / (a + b + 2):
        return front * fraction(x, a, b) / a
    return 1.0 - front * fraction(1 - x, b, a) / b


@F.pandas_udf(DoubleType())
def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """p-values of a per-descriptor result table (a few rows per descriptor)."""
    return pd.Series([correlation_p_value(None if pd.isna(a) else float(a), int(b)) for a, b in zip(r, n)])


def target_correlations(df: DataFrame, cols: Sequence[str], target: str, top: int | None = None) -> DataFrame:
    """Pearson and rank correlation of each descriptor with the target, strongest first."""
    base = df.select(*cols, F.col(target).cast("double").alias("_y")).where("_y IS NOT NULL")
    size = base.agg(F.count("*").alias("n"), *[F.count(c).alias(f"n_{c}") for c in cols]).first()
    small = size["n"] <= GROUP_LIMIT
    if all(size[f"n_{c}"] == size["n"] for c in cols):
        # No gaps: the target has the same ranks for every descriptor, so they are computed once.
        base = with_average_rank(base.withColumn("_g", F.lit(0)), ["_g"], "_y", "_ry", bounded=small)
        d = with_average_rank(long_values(base, cols, keep=["_y", "_ry"]), ["name"], "value", "_rx", bounded=small)
        rho = d.groupBy("name").agg(F.count("*").alias("n"), safe_corr("_rx", "_ry").alias("spearman"), safe_corr("value", "_y").alias("pearson"))
    else:
        d = long_values(base, cols, keep=["_y"]).where("value IS NOT NULL")
        pear = d.groupBy("name").agg(safe_corr("value", "_y").alias("pearson"))
        rho = spearman(d, ["name"], "value", "_y", bounded=small).join(pear, "name")
    res = rho.where("n >= 3 AND pearson IS NOT NULL")
    res = res.withColumns({
        "strength": correlation_strength("pearson"),
        "direction": F.when(F.col("pearson") > 0, "positive").when(F.col("pearson") < 0, "negative").otherwise("none"),
        "pearson_p": p_value("pearson", "n"),
        "spearman_p": p_value("spearman", "n"),  # the same t distribution over ranks
    })
    return res.orderBy(F.abs("pearson").desc(), "name").limit(top) if top else res


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(left, right, r) for every column pair left < right over the rows that hold both; null when a side is constant there.

    Block products of the columns, so any number of columns is one pass or a few; nothing reaches the driver."""
    names = list(cols)
    usable = [finite(F.col(f"`{c}`").cast("double")) for c in names]
    row = df.agg(F.array(*[F.avg(u) for u in usable]).alias("m"), F.array(*[F.max(u) - F.min(u) for u in usable]).alias("r")).first()
    shift = [0.0 if v is None else v for v in row["m"]]
    flat = np.array([not v for v in row["r"]])
    sums = block_products(df, [u - F.lit(m) for u, m in zip(usable, shift)], [], F.lit(1.0), pairwise=True)

    def ratio_rows(batches):
        for batch in batches:
            for i, j, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                i, j = i * BLOCK, j * BLOCK
                wide = (min(BLOCK, len(names) - i), min(BLOCK, len(names) - j))
                ab, a, b, aa, bb, n = v.values.to_numpy(zero_copy_only=False).reshape(6, *wide)
                with np.errstate(divide="ignore", invalid="ignore"):
                    va, vb = aa - a * a / n, bb - b * b / n
                    r = (ab - a * b / n) / np.sqrt(va * vb)
                dead = ~(va > 1e-13 * aa) | ~(vb > 1e-13 * bb) | (n < 2) | flat[i:i + wide[0], None] | flat[None, j:j + wide[1]]
                x, y = np.nonzero(np.arange(i, i + wide[0])[:, None] < np.arange(j, j + wide[1])[None, :])
                for c in range(0, len(x), 8192):
                    at = x[c:c + 8192], y[c:c + 8192]
                    yield pa.RecordBatch.from_arrays([pa.array([names[i + k] for k in at[0]]), pa.array([names[j + k] for k in at[1]]), pa.array(np.clip(r[at], -1, 1), mask=dead[at])], names=["left", "right", "r"])

    return sums.mapInArrow(ratio_rows, "left string, right string, r double")


def collinear_pairs(matrix: DataFrame, cuts: Sequence[float] = (0.90, 0.95, 0.99)) -> DataFrame:
    """Number of descriptor pairs whose absolute correlation exceeds each cut."""
    return matrix.agg(F.array(*[
        F.struct(F.lit(float(c)).alias("threshold"), F.count_if(F.abs("r") > c).alias("pairs")) for c in cuts
    ]).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def residual_statistics(df: DataFrame, y: str, p: str) -> DataFrame:
    """Residual (y - p) summary with a bias verdict at 5 % of the target deviation."""
    d = df.select(F.col(y).alias("_y"), (F.col(y) - F.col(p)).alias("_r"))
    skew, kurt = bias_corrected_moments("_r")
    base = d.agg(
        F.avg("_r").alias("mean_residual"), F.stddev_samp("_r").alias("std_residual"), F.avg(F.abs("_r")).alias("mae"),
        F.sqrt(F.avg(F.col("_r") * F.col("_r"))).alias("rmse"), F.max(F.abs("_r")).alias("max_abs_error"),
        skew.alias("skewness"), kurt.alias("kurtosis"), F.stddev_pop("_y").alias("_sy"),
    )
    q = exact_quantiles(d, [], "_r", {"residual_q1": 0.25, "median_residual": 0.5, "residual_q3": 0.75})
    tol = F.when(F.col("_sy") > 0, 0.05 * F.col("_sy")).otherwise(1e-9)
    bias = (F.when(F.abs("mean_residual") <= tol, "none").when(F.col("mean_residual") > 0, "underestimates")
            .otherwise("overestimates"))
    return with_scalars(base.withColumn("bias", bias).drop("_sy"), q)


def domain_statistics(df: DataFrame, leverage: str, threshold: str) -> DataFrame:
    """Inside / outside counts and leverage summary of a scored table."""
    out = F.col(leverage) > F.col(threshold)
    return df.agg(
        F.count_if(~out).alias("inside"), F.count_if(out).alias("outside"),
        ratio(F.count_if(out) * 100, F.count("*")).alias("outside_percent"),
        F.avg(leverage).alias("mean_leverage"), F.max(leverage).alias("max_leverage"),
        F.max(threshold).alias("threshold"),
    )


def residual_against(df: DataFrame, x: str, residual: str, keys: Sequence[str] = ()) -> DataFrame:
    """Line, Pearson and rank correlation of a residual against one descriptor (per class)."""
    d = df.where(F.col(x).isNotNull() & F.col(residual).isNotNull())
    keyed = d if keys else d.withColumn("_all", F.lit(0))
    k = list(keys) or ["_all"]
    line = keyed.groupBy(*k).agg(
        F.regr_slope(residual, x).alias("slope"), F.regr_intercept(residual, x).alias("intercept"),
        safe_corr(x, residual).alias("pearson"))
    res = spearman(keyed, k, x, residual).join(line, k)
    return res if keys else res.drop("_all")


def largest_residuals(df: DataFrame, residual: str, ident: str, n: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """The n largest absolute residuals (per class), ties by id."""
    if not keys:
        return df.orderBy(F.abs(residual).desc(), ident).limit(n)
    w = Window.partitionBy(*keys, "_part").orderBy(F.abs(residual).desc(), ident)
    part = df.withColumn("_part", F.pmod(F.xxhash64(ident), F.lit(64)))
    local = part.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n)
    g = Window.partitionBy(*keys).orderBy(F.abs(residual).desc(), ident)
    return local.withColumn("_rk", F.row_number().over(g)).where(F.col("_rk") <= n).drop("_rk", "_part")


def section(df: DataFrame, name: str) -> DataFrame:
    """One-row summary turned into (section, metric, value) rows with text values."""
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                      for c, t in df.dtypes if t not in ("string",)])
    return df.select(F.lit(name).alias("section"), F.explode(cells).alias("c")).select("section", "c.metric", "c.value")


def final_statistics(sections: dict[str, DataFrame]) -> DataFrame:
    """All one-row summaries as one long table."""
    out = None
    for name, df in sections.items():
        s = section(df, name)
        out = s if out is None else out.unionByName(s)
    return out


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON text, NaN and infinities written as null."""
    cols = [(finite(c) if t == "double" else F.col(c)).alias(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))
