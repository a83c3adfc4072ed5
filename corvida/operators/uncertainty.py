"""Query bootstrap, weighted consensus, reliability score and the full uncertainty table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.functions.ranks import exact_quantiles
from corvida.operators import domain
from corvida.operators.gram import LinearModel, draws_poisson, grams, replicate_grams
from corvida.operators.knn import as_vector, local_error, nearest_neighbours
from corvida.operators.validation import conformal_radius, kfold


def bootstrap_models(train: DataFrame, features, target: str, ident: str, replicates: int = 100, alpha: float = 1.0, min_unique: float = 0.35) -> list[LinearModel]:
    """One refit per resample from weighted statistics; resamples with too few distinct rows are dropped."""
    n = train.count()
    (g,) = replicate_grams(train, features, target, ident, replicates, [draws_poisson])
    return [g[b][0].ridge(alpha) for b in sorted(g) if g[b][1] >= max(2, int(n * min_unique))]


def bootstrap_columns(df: DataFrame, models: Sequence[LinearModel]) -> DataFrame:
    """Mean, sample deviation, 5 % and 95 % of the refitted predictions of every row, inside one row expression."""
    rows = F.array(*[F.struct(F.lit(float(m.intercept)).alias("b"), F.array(*[F.lit(float(c)) for c in m.coef]).alias("w")) for m in models])
    x = F.array(*[F.col(f) for f in models[0].features])
    p = F.array_sort(F.transform(rows, lambda m: m["b"] + F.aggregate(F.zip_with(m["w"], x, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)))
    n = len(models)

    def at(q: float) -> Column:
        h = q * (n - 1)
        lo, hi = int(np.floor(h)), int(np.ceil(h))
        a, b = F.element_at("_p", lo + 1), F.element_at("_p", hi + 1)
        return a + (h - lo) * (b - a)

    d = df.withColumn("_p", p).withColumn("bootstrap_mean", F.aggregate("_p", F.lit(0.0), lambda a, b: a + b) / n)
    dev = F.aggregate(F.transform("_p", lambda v: (v - F.col("bootstrap_mean")) * (v - F.col("bootstrap_mean"))), F.lit(0.0), lambda a, b: a + b)
    return d.withColumns({"bootstrap_std": F.sqrt(dev / (n - 1)), "bootstrap_p05": at(0.05), "bootstrap_p95": at(0.95)}).drop("_p")


def weighted_consensus(predictions: DataFrame, row: str, weights: Mapping[str, float]) -> DataFrame:
    """Weighted mean, weighted population deviation, median and range per row of a long prediction table."""
    w = F.element_at(F.create_map(*[x for m, v in weights.items() for x in (F.lit(m), F.lit(float(v)))]), F.col("model"))
    p = predictions.withColumn("_w", F.coalesce(w, F.lit(0.0)))
    sw, m1 = F.sum("_w"), F.sum(F.col("_w") * F.col("y_pred"))
    # Shifting by the smallest prediction keeps the second moment accurate.
    base = p.groupBy(row).agg(sw.alias("_sw"), (m1 / sw).alias("consensus_mean"), F.count("*").alias("_n"), F.median("y_pred").alias("consensus_median"),
                              F.min("y_pred").alias("consensus_min"), F.max("y_pred").alias("consensus_max"))
    dev = p.join(base.select(row, "consensus_mean"), row).groupBy(row).agg(
        F.sqrt(F.sum(F.col("_w") * (F.col("y_pred") - F.col("consensus_mean")) * (F.col("y_pred") - F.col("consensus_mean"))) / F.sum("_w")).alias("_sd"))
    return base.join(dev, row).select(row, "consensus_mean", F.when(F.col("_n") > 1, F.col("_sd")).alias("consensus_std"),
                                      "consensus_median", "consensus_min", "consensus_max")


# Penalty and warning ratio per uncertainty source.
UNCERTAINTY_RULES = (("consensus", 15, 1.0), ("bootstrap", 15, 1.0), ("local", 15, 1.5), ("gpr", 10, 1.0))
# Penalty and reason per domain check.
DOMAIN_RULES = (("distance_inside", 30, "outside_distance_ad"), ("range_inside", 20, "outside_descriptor_range"),
                ("similarity_inside", 25, "low_structural_similarity"), ("leverage_inside", 30, "outside_leverage_ad"))


def reliability(df: DataFrame, scale: float, interval_ratio: float, uncertainty: Mapping[str, str], checks: Mapping[str, str]) -> DataFrame:
    """Score 0-100, band and reasons from the available uncertainty and domain columns."""
    terms: list[tuple[Column, int, str]] = []
    if interval_ratio > 2:
        terms.append((F.lit(True), 20, "wide_conformal_interval"))
    elif interval_ratio > 1:
        terms.append((F.lit(True), 10, "moderate_conformal_interval"))
    for name, penalty, reason in DOMAIN_RULES:
        if name in checks:
            terms.append((~F.col(checks[name]), penalty, reason))
    for name, penalty, ratio in UNCERTAINTY_RULES:
        if name in uncertainty:
            terms.append((F.coalesce(F.col(uncertainty[name]) / scale > ratio, F.lit(False)), penalty, f"high_{name}_uncertainty"))
    score = F.lit(100.0)
    for c, penalty, _ in terms:
        score = score - F.when(c, float(penalty)).otherwise(0.0)
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, _, r in terms])) if terms else F.array().cast("array<string>")
    d = df.withColumns({"reliability_score": F.greatest(score, F.lit(0.0)), "reliability_reasons":
                        F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise("no_major_warning")})
    s = F.col("reliability_score")
    return d.withColumn("reliability_status", F.when(s >= 75, "high").when(s >= 50, "medium").otherwise("low"))


def uncertainty_table(train: DataFrame, queries: DataFrame, features: Sequence[str], target: str, ident: str, *, alpha: float = 0.1, k: int = 5,
                      replicates: int = 100, neighbours: int = 5, ridge: float = 1.0, models: Mapping[str, LinearModel] | None = None,
                      weights: Mapping[str, float] | None = None) -> DataFrame:
    """Point prediction with interval, bootstrap, consensus, local error, domain checks and reliability."""
    g = grams(train, features, target)[()]
    model = g.ridge(ridge)
    oof, _ = kfold(train, features, target, ident, k, ridge)
    resid = F.col("y_pred") - F.col(target)
    radius = conformal_radius(oof, resid, alpha)
    rmse = oof.agg(F.sqrt(F.avg(resid * resid)).alias("r")).first()["r"]
    q = exact_quantiles(train, [], target, {"a": 0.25, "b": 0.75}).first()
    iqr = q["b"] - q["a"]
    scale = rmse if rmse > 1e-12 else max(iqr, 1.0)
    d = queries.withColumns({"prediction": model.column(), "conformal_lower": model.column() - radius, "conformal_upper": model.column() + radius})
    d = bootstrap_columns(d, bootstrap_models(train, features, target, ident, replicates, ridge))
    d = domain.leverage(d, features, g)
    d = domain.range_domain(d, domain.feature_ranges(train, features))
    sd = g.scales()
    z = [((F.col(c) - float(g.mean[i])) / float(sd[i])).alias(f"_z{i}") for i, c in enumerate(features)]
    zs = [f"_z{i}" for i in range(len(features))]
    tz = as_vector(oof.select(ident, resid.alias("_e"), *z), zs)
    qz = as_vector(queries.select(ident, *z), zs)
    near = nearest_neighbours(qz, tz, ident, ident, "vector", neighbours)
    d = d.join(local_error(near, tz, ident, "_e").withColumnRenamed("qid", ident), ident)
    dist = domain.distance_domain(qz, tz, ident, ident, "vector")
    d = d.join(dist.select(ident, F.col("distance").alias("distance_ad"), F.col("threshold").alias("distance_threshold"), F.col("inside").alias("distance_inside")), ident)
    sources = {"bootstrap": "bootstrap_std", "local": "local_mae"}
    if models:
        long = queries.select(ident, F.explode(F.array(*[F.struct(F.lit(n).alias("model"), m.column().alias("y_pred")) for n, m in models.items()])).alias("m")).select(ident, "m.*")
        d = d.join(weighted_consensus(long, ident, weights or {n: 1.0 for n in models}), ident)
        sources["consensus"] = "consensus_std"
    return reliability(d, scale, 2 * radius / max(iqr, scale, 1e-12), sources,
                       {"distance_inside": "distance_inside", "range_inside": "range_inside", "leverage_inside": "leverage_inside"})
