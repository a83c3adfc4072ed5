"""Descriptor importance: coefficients, permutation, correlated groups, unified table and linear attribution."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvida.functions.ranks import bounded_groups, with_average_rank, with_position
from corvida.operators.gram import LinearModel, complete_rows
from corvida.operators.stats import correlation_matrix
from corvida.operators.validation import meet_shuffled
from corvida.session import cut_lineage


def coefficient_table(spark: SparkSession, m: LinearModel) -> DataFrame:
    rows = [(f, float(c), abs(float(c)), "coefficient") for f, c in zip(m.features, m.coef)]
    return spark.createDataFrame(rows, "descriptor string, coefficient double, absolute_importance double, method string")


def native_table(spark: SparkSession, model, features: Sequence[str]) -> DataFrame:
    rows = [(f, float(v), abs(float(v)), "native_feature_importance") for f, v in zip(features, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "descriptor string, importance double, absolute_importance double, method string")


def permutation_importance(df: DataFrame, model: LinearModel, target: str, ident: str, repeats: int = 30, groups: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """RMSE increase when a descriptor (or a correlated group, moved together) comes from another row.

    A linear prediction changes only by the moved columns' share, so a row's shares travel once per repeat to the block of
    positions they meet; squared errors are summed there, so what is shuffled afterwards are repeats x descriptors sums per block.
    """
    groups = groups or {f: [f] for f in model.features}
    coef = dict(zip(model.features, model.coef))
    shares = [f"_s{i}" for i in range(len(groups))]
    share = [sum((F.lit(float(coef[c])) * F.col(c) for c in cols), F.lit(0.0)).alias(s) for s, cols in zip(shares, groups.values())]
    rows = with_position(df, [], ident, "_pos").select("_pos", (F.col(target) - model.column()).cast("double").alias("_res"), *share)

    def errors(own: pa.Table, met: Iterator[tuple[int, np.ndarray, pa.Table]]) -> Iterator[pa.RecordBatch]:
        have = own["_res"].is_valid().to_numpy()
        res, mine = own["_res"].to_numpy(), [own[s].to_numpy() for s in shares]
        for k, at, others in met:
            e, there = res[at], have[at]
            base, n = float((e[there] ** 2).sum()), int(there.sum())
            out = []
            for s, x in zip(shares, mine):
                both = there & others[s].is_valid().to_numpy()
                out.append((k, len(out), n, base, int(both.sum()), float(((e + x[at] - others[s].to_numpy())[both] ** 2).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), SUM_KINDS)], names=SUM_NAMES)

    return _rises(meet_shuffled(rows, repeats, shares, ["_res", *shares], errors, SUMS), list(groups))


SUMS = "repeat int, part int, n long, base double, moved_n long, sse double"
SUM_NAMES = ["repeat", "part", "n", "base", "moved_n", "sse"]
SUM_KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.float64())


def _rises(sums: DataFrame, names: list[str]) -> DataFrame:
    """Mean, deviation and positive share of the RMSE increase per descriptor, from the sums of :data:`SUMS`."""
    def rmse(total: str, n: str) -> Column:
        return F.sqrt(F.sum(total) / F.nullif(F.sum(n), F.lit(0)))

    rise = sums.groupBy("repeat", "part").agg((rmse("sse", "moved_n") - rmse("base", "n")).alias("d"))
    name = F.get(F.array(*[F.lit(g) for g in names]), F.col("part"))
    return rise.groupBy(name.alias("descriptor")).agg(F.avg("d").alias("importance_mean"), F.stddev_pop("d").alias("importance_std"),
                                                      F.avg(F.when(F.col("d") > 0, 1.0).otherwise(0.0)).alias("positive_repeats_fraction"))


def model_permutation_importance(df: DataFrame, predict: Callable[[np.ndarray], np.ndarray], features: Sequence[str], target: str, ident: str,
                                 repeats: int = 30, groups: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """The same for any model: ``predict`` maps a (rows, features) block to predictions and travels to the tasks.

    A row meets one whole feature vector of another row per repeat; a task puts the columns of each descriptor (or group) into its
    block in turn, scores it and adds up squared errors, so what is shuffled afterwards are repeats x descriptors sums per block.
    Rows with a NULL, NaN or infinite feature or target are left out; a table without complete rows gives no rows.
    """
    groups = groups or {f: [f] for f in features}
    place = {f: i for i, f in enumerate(features)}
    moved_columns = [[place[c] for c in cols] for cols in groups.values()]
    names = [f"_x{i}" for i in range(len(features))]
    rows = with_position(complete_rows(df, [*features, target]), [], ident, "_pos").select(
        "_pos", F.col(target).cast("double").alias("_y"), *[F.col(f).cast("double").alias(c) for f, c in zip(features, names)])

    def errors(own: pa.Table, met: Iterator[tuple[int, np.ndarray, pa.Table]]) -> Iterator[pa.RecordBatch]:
        y, x = own["_y"].to_numpy(), np.stack([own[c].to_numpy() for c in names], axis=1)
        squares = (y - predict(x.copy())) ** 2
        for k, at, others in met:
            z, other, want = x[at], [others[c].to_numpy() for c in names], y[at]
            base, out = float(squares[at].sum()), []
            for cols in moved_columns:
                kept = z[:, cols]
                for c in cols:
                    z[:, c] = other[c]
                out.append((k, len(out), len(at), base, len(at), float(((want - predict(z)) ** 2).sum())))
                z[:, cols] = kept
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), SUM_KINDS)], names=SUM_NAMES)

    return _rises(meet_shuffled(rows, repeats, names, ["_y", *names], errors, SUMS), list(groups))


def correlation_groups(df: DataFrame, features: Sequence[str], ident: str, threshold: float = 0.9) -> list[list[str]]:
    """Connected groups of descriptors with absolute rank correlation at or above the threshold.

    ``ident`` may repeat or be null: the cells of a row meet again under a number of its own, fixed by the checkpoint."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features)]))
    numbered = df.select(*features).withColumn("_id", F.monotonically_increasing_id())
    long = cut_lineage(numbered.select("_id", cells.alias("c")).select("_id", "c.*").where("v IS NOT NULL"))
    ranked = with_average_rank(long, ["k"], "v", "r", bounded=bounded_groups(long, ["k"]))  # all descriptors in one pass
    row = ranked.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "r"))).alias("m"))
    names = [f"_r_{f}" for f in features]
    ranked = row.select(*[F.col("m")[i].alias(n) for i, n in enumerate(names)])
    parent = {f: f for f in features}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for row in correlation_matrix(ranked, names).where(F.abs("r") >= threshold).toLocalIterator():
        a, b = find(row["left"][3:]), find(row["right"][3:])
        if a != b:
            parent[b] = a
    out: dict[str, list[str]] = {}
    for f in features:
        out.setdefault(find(f), []).append(f)
    return list(out.values())


def unified_table(coefficient: DataFrame | None = None, native: DataFrame | None = None, permutation: DataFrame | None = None, attribution: DataFrame | None = None) -> DataFrame:
    """Each method scaled by its largest value, outer-joined, averaged and ranked (ties share the smaller rank)."""
    def scaled(t: DataFrame, name: str, value: Column, **extra: Column) -> DataFrame:
        v = t.select("descriptor", value.alias("_v"), *[c.alias(k) for k, c in extra.items()])
        top = F.max("_v").over(Window.partitionBy(F.lit(0)))
        return v.withColumn(f"{name}_score", F.when(top > 0, F.col("_v") / top).otherwise(0.0)).drop("_v")

    parts = []
    if coefficient is not None:
        parts.append(scaled(coefficient, "coefficient", F.col("absolute_importance")))
    if native is not None:
        parts.append(scaled(native, "native", F.col("absolute_importance")))
    if permutation is not None:
        parts.append(scaled(permutation, "permutation", F.greatest("importance_mean", F.lit(0.0)), permutation_stability=F.col("positive_repeats_fraction")))
    if attribution is not None:
        parts.append(scaled(attribution, "shap", F.col("mean_abs_phi")))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "descriptor", "full")
    scores = [c for c in out.columns if c.endswith("_score")]
    have = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in scores), F.lit(0))
    out = out.withColumns({"methods_available": have, "combined_score": sum((F.coalesce(F.col(c), F.lit(0.0)) for c in scores), F.lit(0.0)) / have})
    s = F.col("permutation_stability") if "permutation_stability" in out.columns else F.lit(None).cast("double")
    # One row per descriptor, so the global rank runs over p rows.
    return out.withColumns({"combined_rank": F.rank().over(Window.orderBy(F.col("combined_score").desc())),
                            "stability_status": F.when(s.isNull(), "not_evaluated").when(s >= 0.8, "stable").when(s >= 0.6, "moderate").otherwise("unstable")})


def linear_attribution(df: DataFrame, m: LinearModel) -> DataFrame:
    """phi = coefficient * (x - mean): mean |phi|, mean phi and deviation per descriptor."""
    from corvida.operators.gram import column_means

    mean = column_means(df, m.features)
    cells = F.array(*[F.struct(F.lit(f).alias("descriptor"), (F.lit(float(c)) * (F.col(f) - float(mu))).alias("phi")) for f, c, mu in zip(m.features, m.coef, mean)])
    return df.select(F.explode(cells).alias("c")).select("c.*").groupBy("descriptor").agg(
        F.avg(F.abs("phi")).alias("mean_abs_phi"), F.avg("phi").alias("mean_phi"), F.stddev_samp("phi").alias("std_phi"))
