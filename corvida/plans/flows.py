"""End-to-end flows built from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.operators import clean, domain, errors, series, stats, uncertainty, validation
from corvida.operators.gram import LinearModel, grams


def train_and_profile(df: DataFrame, target: str, features: Sequence[str], ident: str, flags: Sequence[str] = (), k: int = 5, alpha: float = 1.0) -> dict:
    """Clean, cross-validate, score and profile the errors of a ridge model."""
    matrix, cols = clean.prepare_matrix(df, target, features)
    model = grams(matrix, cols, target)[()].ridge(alpha)
    oof, _ = validation.kfold(matrix, cols, target, ident, k, alpha)
    oof = oof.withColumn("error", F.col("y_pred") - F.col(target))
    return {"model": model, "out_of_fold": oof, "metrics": stats.regression_metrics(oof, [], target, "y_pred"), "groups": errors.group_summary(oof, flags)}


def save_package(model: LinearModel, train: DataFrame, features: Sequence[str], target: str, path: str, medians: dict[str, float] | None = None) -> None:
    """Model coefficients, fill values, ranges and training matrix as tables."""
    spark = train.sparkSession
    rg = domain.feature_ranges(train, features)
    med = medians or clean.column_medians(train, features)
    rows = [(f, float(c), float(med.get(f) or 0.0), float(rg[f][0]), float(rg[f][1])) for f, c in zip(model.features, model.coef)]
    t = spark.createDataFrame(rows, "descriptor string, coefficient double, median double, low double, high double").withColumn("intercept", F.lit(model.intercept))
    t.write.mode("overwrite").parquet(f"{path}/model")
    train.select(*features, target).write.mode("overwrite").parquet(f"{path}/train")


def load_package(spark, path: str) -> tuple[LinearModel, dict[str, float], DataFrame]:
    import numpy as np

    rows = spark.read.parquet(f"{path}/model").orderBy("descriptor").collect()
    m = LinearModel(tuple(r["descriptor"] for r in rows), np.array([r["coefficient"] for r in rows]), rows[0]["intercept"])
    return m, {r["descriptor"]: r["median"] for r in rows}, spark.read.parquet(f"{path}/train")


def score_rows(model: LinearModel, medians: dict[str, float], train: DataFrame, new: DataFrame) -> DataFrame:
    """Align, predict and add leverage and range checks: one pass over the new rows, streaming or batch."""
    feats = list(model.features)
    d, _ = clean.align_columns(new, feats, medians)
    g = grams(train.withColumn("_zero", F.lit(0.0)), feats, "_zero")[()]
    d = domain.leverage(d.withColumn("prediction", model.column()), feats, g)
    return domain.range_domain(d, domain.feature_ranges(train, feats), 0.0)


def consistency_analysis(fragments: DataFrame, min_points: int = 3) -> dict[str, DataFrame]:
    """Memberships to suspicion: own-series, reference and transformation checks of a fragment table."""
    m = series.discover_memberships(fragments, min_points)
    p = series.series_points(m)
    own, od, steps = series.own_series(p, min_points)
    hier, comp, rd = series.reference_hierarchy(p, own, min_points)
    rules, td = series.transformation_rules(series.transformation_pairs(m, min_points), min_points)
    hs = series.hierarchical_suspicion(m, od, rd, td)
    return {"memberships": m, "points": p, "own_summary": own, "own_details": od, "own_steps": steps, "hierarchy": hier, "comparisons": comp, "reference_details": rd,
            "transformation_rules": rules, "transformation_details": td, "suspicion": hs, "checkability": series.universal_checkability(m, m, hier)}


predict_with_uncertainty = uncertainty.uncertainty_table
