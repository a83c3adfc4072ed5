"""Model families beyond the plain Gram solve, descriptor selection and parameter search."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.util import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.functions.columns import dot, portable_hash_block
from corvida.operators import extra_trees
from corvida.operators.gram import Gram, LinearModel, complete_rows, grams, total
from corvida.operators.validation import fold_column, kfold
from corvida.session import cut_lineage


def model_table(spark: SparkSession, models: dict[str, LinearModel]) -> DataFrame:
    """One row per fitted model with its coefficients in named columns."""
    names = next(iter(models.values())).features
    rows = [(n, float(m.intercept), *[float(c) for c in m.coef]) for n, m in models.items()]
    return spark.createDataFrame(rows, "model string, intercept double, " + ", ".join(f"`{c}` double" for c in names))


def spline_basis(df: DataFrame, cols: Sequence[str], knots: int = 3, degree: int = 3) -> tuple[DataFrame, list[str]]:
    """Truncated-power spline columns at equally spaced interior knots of each column."""
    rng = df.agg(*[a for c in cols for a in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    new = {}
    for c in cols:
        lo, hi = rng[f"lo_{c}"], rng[f"hi_{c}"]
        span = (hi - lo) or 1.0
        u = (F.col(c) - lo) / span
        for d in range(1, degree + 1):
            new[f"{c}_p{d}"] = F.pow(u, F.lit(float(d)))
        for j in range(1, knots + 1):
            new[f"{c}_k{j}"] = F.pow(F.greatest(u - j / (knots + 1), F.lit(0.0)), F.lit(float(degree)))
    return df.withColumns(new), list(new)


def hinge_basis(df: DataFrame, cols: Sequence[str], knots: int = 3) -> tuple[DataFrame, list[str]]:
    """Pairs of hinge columns max(x-k, 0), max(k-x, 0) and the products of two columns."""
    rng = df.agg(*[a for c in cols for a in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    new = {}
    for c in cols:
        lo, hi = rng[f"lo_{c}"], rng[f"hi_{c}"]
        for j in range(1, knots + 1):
            k = lo + (hi - lo) * j / (knots + 1)
            new[f"{c}_h{j}"] = F.greatest(F.col(c) - k, F.lit(0.0))
            new[f"{c}_g{j}"] = F.greatest(F.lit(k) - F.col(c), F.lit(0.0))
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            new[f"{a}_x_{b}"] = F.col(a) * F.col(b)
    return df.withColumns(new), list(new)


ML_TREES = {"tree": DecisionTreeRegressor, "forest": RandomForestRegressor, "boosted": GBTRegressor}


def fit_tree(df: DataFrame, features: Sequence[str], target: str, kind: str = "forest", **params):
    """Tree model and its scorer: ``tree``, ``forest`` or ``boosted`` of Spark ML, or ``extra`` (:mod:`corvida.operators.extra_trees`)."""
    if kind == "extra":
        model = extra_trees.fit(df, features, target, **params)
        return model, model.score
    make = ML_TREES[kind](seed=42, **params)
    asm = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip")
    model = make.setFeaturesCol("_features").setLabelCol(target).setPredictionCol("y_pred").fit(asm.transform(df.drop("y_pred")))
    return model, lambda d: model.transform(asm.transform(d.drop("y_pred"))).drop("_features")


@dataclass
class NumericTrees:
    """A Spark ML tree model over numeric columns as arrays, for use inside tasks: node i of a tree goes left (to i + 1) up to its cut,
    else to ``right[i]``; feature -1 marks a leaf. The prediction is the weighted sum over the trees."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    weights: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for (feature, cut, right, value), w in zip(self.trees, self.weights):
            node = np.zeros(len(x), dtype=np.int64)
            live = np.flatnonzero(feature[node] >= 0)
            while len(live):
                at = node[live]
                node[live] = np.where(x[live, feature[at]] <= cut[at], at + 1, right[at])
                live = live[feature[node[live]] >= 0]
            out += w * value[node]
        return out


_LINE = re.compile(r"\s*(?:Tree \d+ \(weight (?P<w>\S+)\)|(?P<if>If) \(feature (?P<f>\d+) <= (?P<c>[^)]+)\)|(?P<else>Else) \(feature \d+ > |Predict: (?P<v>\S+))")


def numeric_trees(model) -> NumericTrees:
    """Read a fitted Spark ML tree, forest or boosted model from its printed form, which lists nodes in depth-first order."""
    trees, weights, open_nodes = [], [], []
    for line in model.toDebugString.splitlines()[1:]:
        m = _LINE.match(line)
        if m is None:
            if line.strip():
                raise ValueError(f"not a split on a numeric column: {line.strip()}")
            continue
        if m["w"] is not None or not trees:
            trees.append([])
            weights.append(float(m["w"] or 1.0))
            if m["w"] is not None:
                continue
        nodes = trees[-1]
        if m["if"]:
            open_nodes.append(len(nodes))
            nodes.append([int(m["f"]), float(m["c"]), -1, np.nan])
        elif m["else"]:
            nodes[open_nodes.pop()][2] = len(nodes)
        else:
            nodes.append([-1, np.nan, -1, float(m["v"])])
    if not hasattr(model, "evaluateEachIteration"):  # only boosted trees add up: a forest prints weight 1 for each tree and takes their mean
        weights = [w / sum(weights) for w in weights]
    arrays = [tuple(np.array(c, dtype=t) for c, t in zip(zip(*nodes), (np.int64, float, np.int64, float))) for nodes in trees]
    return NumericTrees(arrays, weights)


def vote(predictions: DataFrame, row: str, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of a long prediction table."""
    w = F.element_at(F.create_map(*[x for m, v in weights.items() for x in (F.lit(m), F.lit(float(v)))]), F.col("model"))
    return predictions.groupBy(row).agg((F.sum(w * F.col("y_pred")) / F.sum(w)).alias("y_pred"))


def stack(df: DataFrame, bases: dict[str, Sequence[str]], target: str, ident: str, k: int = 5, alpha: float = 1.0):
    """(final model over base predictions, scorer): ridge bases on their own columns, combined by ridge on out-of-fold predictions."""
    oof = df
    for name, cols in bases.items():
        oof = kfold(oof, cols, target, ident, k, alpha)[0].withColumnRenamed("y_pred", f"p_{name}").drop("fold")
    names = [f"p_{n}" for n in bases]
    final = grams(oof, names, target)[()].ridge(alpha)
    full = {n: grams(df, cols, target)[()].ridge(alpha) for n, cols in bases.items()}

    def score(d: DataFrame) -> DataFrame:
        return d.withColumns({f"p_{n}": m.column() for n, m in full.items()}).withColumn("y_pred", final.column())

    return final, score


def f_scores(g: Gram) -> np.ndarray:
    r = g.correlation()[:g.p, -1]
    r = np.nan_to_num(r)
    with np.errstate(divide="ignore"):
        return np.where(np.abs(r) < 1, r * r / np.maximum(1 - r * r, 1e-300) * (g.n - 2), np.inf)


def mutual_information(df: DataFrame, features: Sequence[str], target: str, bins: int = 10) -> dict[str, float]:
    """Mutual information with the target from quantile-bin contingency counts."""
    cuts = [i / bins for i in range(1, bins)]
    cols = [*features, target]
    edges = df.agg(*[F.percentile_approx(c, cuts, 10000).alias(f"e{i}") for i, c in enumerate(cols)]).first()

    def bin_of(c, e):
        e = sorted(set(e or []))
        return sum((F.when(F.col(c) > x, 1).otherwise(0) for x in e), F.lit(0))

    binned = df.select(*[bin_of(c, edges[i]).alias(f"b{i}") for i, c in enumerate(cols)])
    last = f"b{len(features)}"
    cells = F.array(*[F.struct(F.lit(f).alias("name"), F.col(f"b{i}").alias("x")) for i, f in enumerate(features)])
    rows = binned.select(F.explode(cells).alias("c"), F.col(last).alias("y")).groupBy("c.name", "c.x", "y").agg(F.count("*").alias("n")).collect()
    out = {}
    for f in features:
        t = np.zeros((bins + 1, bins + 1))
        for r in rows:
            if r["name"] == f:
                t[r["x"], r["y"]] = r["n"]
        p = t / max(t.sum(), 1)
        e = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
        nz = p > 0
        out[f] = float((p[nz] * np.log(p[nz] / e[nz])).sum())
    return out


def select_descriptors(df: DataFrame, features: Sequence[str], target: str, method: str = "f_regression", max_features: int = 50,
                       corr_threshold: float = 0.95, lasso_alpha: float = 0.01) -> tuple[list[str], list[dict]]:
    """(selected names, one status row per descriptor).

    Constant columns go first, then columns too correlated with a stronger one (in order of
    F-score), then the final method ranks the rest. Everything but mutual information and forest
    importance is decided on the p x p statistics.
    """
    features = list(features)
    g = grams(df, features, target)[()]
    sd = np.sqrt(np.clip(np.diag(g.centred)[:g.p], 0, None) / g.n)
    score = f_scores(g)
    corr = np.nan_to_num(g.correlation()[:g.p, :g.p])
    alive = [i for i in range(g.p) if sd[i] > 1e-12] or list(range(g.p))
    kept: list[int] = []
    removed: dict[int, str] = {}
    for i in sorted(alive, key=lambda j: -score[j]):
        clash = next((j for j in kept if abs(corr[i, j]) >= corr_threshold), None)
        if clash is None:
            kept.append(i)
        else:
            removed[i] = f"correlates with {features[clash]}, r={corr[i, clash]:.4f}"
    names = [features[i] for i in kept]
    sub = None if method in ("none", "f_regression", "fast") else grams(df, names, target)[()]
    if method == "lasso":
        w = np.abs(sub.elastic_net(lasso_alpha).coef * sub.scales())
        order = [i for i in np.argsort(-w, kind="stable") if w[i] > 1e-12] or list(range(len(names)))
    elif method == "mutual_info":
        mi = mutual_information(df, names, target)
        order = sorted(range(len(names)), key=lambda i: -mi[names[i]])
    elif method == "forest":
        w = fit_tree(df, names, target, "forest", numTrees=20)[0].featureImportances.toArray()
        order = list(np.argsort(-w, kind="stable"))
    elif method == "rfe_ridge":
        left = list(range(len(names)))
        a, b, _ = sub._standard()
        while len(left) > max_features:
            ix = np.ix_(left, left)
            w = np.abs(np.linalg.solve(a[ix] + np.eye(len(left)), b[left]))
            drop = min(max(1, int(0.2 * len(names))), len(left) - max_features)
            worst = set(np.argsort(w, kind="stable")[:drop])
            left = [x for j, x in enumerate(left) if j not in worst]
        order = left
    else:
        order = list(range(len(names)))
    chosen = [kept[i] for i in order[:max_features]]
    rows = []
    for i, n in enumerate(features):
        status = ("removed_constant" if i not in alive else "removed_correlated" if i in removed
                  else "selected" if i in chosen else "kept_not_selected")
        rows.append({"descriptor": n, "status": status, "selected": i in chosen, "f_score": float(score[i]), "reason": removed.get(i, "")})
    return [features[i] for i in chosen], rows


def grid_search(df: DataFrame, features: Sequence[str], target: str, ident: str, alphas: Sequence[float], l1_ratios: Sequence[float | None] = (None,), k: int = 5) -> list[dict]:
    """Cross-validated RMSE of every setting, all from one table of fold statistics."""
    g = grams(df.withColumn("fold", fold_column(ident, k)), features, target, ["fold"])
    tot = total(g.values())
    out = []
    for a in alphas:
        for l1 in l1_ratios:
            fit = (lambda t: t.ridge(a)) if l1 is None else (lambda t: t.elastic_net(a, l1))
            sse = sum(v.sse(fit(tot - v)) for v in g.values())
            out.append({"alpha": float(a), "l1_ratio": None if l1 is None else float(l1), "cv_rmse": float(np.sqrt(sse / tot.n)), "q2": float(1 - sse / tot.centred[-1, -1])})
    return sorted(out, key=lambda r: (r["cv_rmse"], r["alpha"]))


def tree_search(df: DataFrame, features: Sequence[str], target: str, ident: str, grid: Mapping[str, Sequence], kind: str = "forest", k: int = 5,
                draws: int | None = None, salt: int = 0, parallelism: int = 4):
    """(settings with ``cv_rmse`` from best to worst, scorer of the best one fitted on all rows).

    Every combination of ``grid``, or ``draws`` of them picked by a portable hash of their number. The folds are those of the other
    validation designs, and ``cv_rmse`` is the mean of the folds' RMSE. ``parallelism`` models are fitted at a time.
    Rows with a NULL, NaN or infinite feature or target take no part; ties go to the earlier setting.
    """
    settings = [dict(zip(grid, values)) for values in product(*grid.values())]
    if draws is not None and draws < len(settings):
        h = portable_hash_block(np.arange(len(settings)), np.array([salt]))[:, 0]
        settings = [settings[i] for i in sorted(np.argsort(h, kind="stable")[:draws])]
    rows = cut_lineage(complete_rows(df, [*features, target]).select(*[F.col(c).cast("double").alias(c) for c in [*features, target]], fold_column(ident, k).alias("fold")))
    if kind == "extra":
        def fold_rmse(setting: dict, f: int) -> float:
            scored = extra_trees.fit(rows.where(F.col("fold") != f), features, target, **setting).score(rows.where(F.col("fold") == f))
            e = F.col("y_pred") - F.col(target)
            return scored.agg(F.sqrt(F.avg(e * e))).first()[0]

        held = [r[0] for r in rows.select("fold").distinct().orderBy("fold").collect()]
        with ThreadPool(parallelism) as pool:
            each = pool.starmap(inheritable_thread_target(df.sparkSession)(fold_rmse), [(s, f) for s in settings for f in held])
        errors = np.array(each).reshape(len(settings), -1).mean(axis=1).tolist()
    else:
        assembled = VectorAssembler(inputCols=list(features), outputCol="_features").transform(rows)
        est = ML_TREES[kind](seed=42, featuresCol="_features", labelCol=target, predictionCol="y_pred")
        maps = [{est.getParam(name): v for name, v in s.items()} for s in settings]
        cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=RegressionEvaluator(predictionCol="y_pred", labelCol=target, metricName="rmse"),
                            numFolds=k, foldCol="fold", parallelism=parallelism)
        errors = [float(v) for v in cv.fit(assembled).avgMetrics]
    table = sorted(({**s, "cv_rmse": e} for s, e in zip(settings, errors)), key=lambda row: row["cv_rmse"])
    best = {name: v for name, v in table[0].items() if name != "cv_rmse"}
    return table, fit_tree(rows, features, target, kind, **best)[1]


def leaderboard(metrics: DataFrame, **extra: DataFrame) -> DataFrame:
    """Models ordered by rating, K-fold Q2, leave-one-out Q2 and hold-out R2, with their place; extra tables add columns."""
    from pyspark.sql import Window

    for t in extra.values():
        metrics = metrics.join(t, "model", "left")
    # One row per model: the table is as small as the model catalogue.
    w = Window.orderBy(F.col("rating").asc_nulls_last(), F.col("kfold_q2").desc_nulls_last(), F.col("loo_q2").desc_nulls_last(), F.col("holdout_r2").desc_nulls_last(), "model")
    return metrics.withColumn("place", F.row_number().over(w))


def principal_axes(df: DataFrame, features: Sequence[str], components: int = 2, centred: bool = True) -> tuple[np.ndarray, np.ndarray, Gram]:
    """(axes, explained share, statistics): eigenvectors of the p x p matrix; largest loading positive."""
    g = grams(df.withColumn("_zero", F.lit(0.0)), features, "_zero")[()]
    if centred:
        a = g.centred[:g.p, :g.p]
    else:
        s, m = g.s[:g.p], g.shift[:g.p]
        a = g.ss[:g.p, :g.p] + np.outer(s, m) + np.outer(m, s) + g.n * np.outer(m, m)
    val, vec = np.linalg.eigh(a)
    order = np.argsort(-val)[:components]
    axes = vec[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    share = val[order] / max(val.sum(), 1e-300)
    if not centred:
        c = g.centred[:g.p, :g.p]
        share = np.einsum("ij,ik,kj->j", axes, c, axes) / max(np.trace(c), 1e-300)
    return axes, share, g


def project(df: DataFrame, features: Sequence[str], axes: np.ndarray, centre: np.ndarray | None = None, prefix: str = "pc") -> DataFrame:
    out = {}
    for j in range(axes.shape[1]):
        e = dot(axes[:, j], features)
        out[f"{prefix}{j + 1}"] = e if centre is None else e - float(axes[:, j] @ centre)
    return df.withColumns(out)
