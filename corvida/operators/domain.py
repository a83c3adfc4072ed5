"""Applicability domain: leverage, range, distance, similarity and sub-space checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.functions.frames import with_scalars
from corvida.functions.ranks import exact_quantiles
from corvida.operators.gram import Gram, grams, quadratic_form
from corvida.operators.knn import as_vector, nearest_neighbours, unit_vectors


def leverage(df: DataFrame, features: Sequence[str], stats: Gram, out: str = "leverage") -> DataFrame:
    """h against the training statistics (intercept included), threshold 3(p+1)/n and status."""
    centre, inv = stats.leverage_matrix()
    h = F.lit(1.0 / stats.n) + quadratic_form(features, centre, inv)
    limit = 3.0 * (stats.p + 1) / stats.n
    return df.withColumn(out, h).withColumns({f"{out}_threshold": F.lit(limit), f"{out}_inside": F.col(out) <= limit})


def fit(df: DataFrame, features: Sequence[str], target: str) -> Gram:
    return grams(df, features, target)[()]


def williams(df: DataFrame, y: str, y_pred: str, lev: str = "leverage", threshold: str = "leverage_threshold") -> DataFrame:
    """Residuals standardised by their sample deviation with outside / high / critical flags."""
    d = df.withColumn("residual", F.col(y) - F.col(y_pred))
    d = with_scalars(d, d.agg(F.stddev_samp("residual").alias("_sd")))
    d = d.withColumn("standardized_residual", F.col("residual") / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)).drop("_sd")
    out, high = F.col(lev) > F.col(threshold), F.abs("standardized_residual") > 3
    return d.withColumns({"outside_ad": out, "high_residual": high, "critical": out & high})


def williams_summary(w: DataFrame) -> DataFrame:
    return w.agg(F.count("*").alias("total"), *[F.count_if(c).alias(c) for c in ("outside_ad", "high_residual", "critical")])


def feature_ranges(train: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    r = train.agg(*[a for c in features for a in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    return {c: (r[f"lo_{c}"], r[f"hi_{c}"]) for c in features}


def range_domain(df: DataFrame, ranges: Mapping[str, tuple[float, float]], tolerance: float = 0.05, out: str = "range") -> DataFrame:
    """Count and share of descriptors outside the training range widened by ``tolerance`` of its span."""
    n = F.lit(0)
    for c, (lo, hi) in ranges.items():
        pad = (hi - lo) * tolerance if hi - lo > 1e-12 else 0.0
        n = n + F.when((F.col(c) < lo - pad) | (F.col(c) > hi + pad), 1).otherwise(0)
    return df.withColumns({f"{out}_outside_count": n, f"{out}_outside_fraction": n / F.lit(float(len(ranges))), f"{out}_inside": n == 0})


def distance_domain(queries: DataFrame, train: DataFrame, qid: str, tid: str, vector: str, quantile: float = 0.95) -> DataFrame:
    """Nearest training distance against the quantile of the training rows' own nearest distances."""
    own = nearest_neighbours(train, train, tid, tid, vector, 1, exclude_self=True)
    limit = exact_quantiles(own, [], "distance", {"threshold": quantile})
    near = nearest_neighbours(queries, train, qid, tid, vector, 1)
    res = with_scalars(near.select(F.col("qid").alias(qid), "distance"), limit)
    return res.withColumns({"ratio": F.col("distance") / F.when(F.col("threshold") > 1e-12, F.col("threshold")).otherwise(1.0),
                            "inside": F.col("distance") <= F.col("threshold")})


def cosine_domain(queries: DataFrame, train: DataFrame, qid: str, tid: str, vector: str, quantile: float = 0.05) -> DataFrame:
    """Largest cosine similarity against a low quantile of the training rows' own largest similarity.

    On unit vectors the nearest row is the most similar one: cos = 1 - d*d/2.
    """
    t, q = unit_vectors(train, vector), unit_vectors(queries, vector)
    cos = 1 - F.col("distance") * F.col("distance") / 2
    own = nearest_neighbours(t, t, tid, tid, "unit", 1, exclude_self=True).withColumn("similarity", cos)
    limit = exact_quantiles(own, [], "similarity", {"threshold": quantile})
    near = nearest_neighbours(q, t, qid, tid, "unit", 1).select(F.col("qid").alias(qid), cos.alias("similarity"))
    return with_scalars(near, limit).withColumn("inside", F.col("similarity") >= F.col("threshold"))


def similarity_domain(best: DataFrame, similarity: str, threshold: float = 0.5) -> DataFrame:
    """Inside when the largest set similarity to the training rows reaches the threshold."""
    return best.withColumns({"similarity_threshold": F.lit(threshold), "similarity_inside": F.coalesce(F.col(similarity) >= threshold, F.lit(False))})


def subspace_domain(queries: DataFrame, train: DataFrame, ident: str, groups: Mapping[str, Sequence[str]], cosine_groups: Sequence[str] = ()) -> DataFrame:
    """Per column group: leverage, distance, range (and cosine) combined, plus an interpretation code."""
    res = queries.select(ident)
    for name, cols in groups.items():
        g = fit(train.withColumn("_zero", F.lit(0.0)), cols, "_zero")
        part = leverage(queries, cols, g, "h")
        part = range_domain(part, feature_ranges(train, cols), 0.0, "r")
        q, t = as_vector(queries, cols), as_vector(train, cols)
        d = distance_domain(q, t, ident, ident, "vector").select(ident, "distance", F.col("inside").alias("d_in"))
        part = part.join(d, ident)
        ok = F.col("h_inside") & F.col("r_inside") & F.col("d_in")
        if name in cosine_groups:
            c = cosine_domain(q, t, ident, ident, "vector").select(ident, "similarity", F.col("inside").alias("c_in"))
            part, ok = part.join(c, ident), ok & F.col("c_in")
        else:
            part = part.withColumn("similarity", F.lit(None).cast("double"))
        res = res.join(part.select(ident, F.when(ok, "inside").otherwise("outside").alias(f"{name}_status"), F.col("h").alias(f"{name}_leverage"),
                                   F.col("distance").alias(f"{name}_distance"), F.col("similarity").alias(f"{name}_similarity")), ident)
    if {"molecular", "spectral", "combined"} <= set(groups):
        m, s, c = (F.col(f"{g}_status") for g in ("molecular", "spectral", "combined"))
        res = res.withColumn("interpretation", F.when((m == "inside") & (s == "inside") & (c == "inside"), "reliable")
                             .when((m == "inside") & (s == "outside"), "spectral_out").when((m == "outside") & (s == "inside"), "molecular_out")
                             .when(c == "outside", "combined_out").otherwise("not_calculated"))
    return res
