"""Validation designs solved from fold statistics; fold and resample draws are portable hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from corvida.functions.columns import HASH_PRIME, portable_hash, portable_hash_block, portable_text_hash
from corvida.functions.labels import quality_label
from corvida.functions.ranks import exact_quantiles, with_position
from corvida.operators.gram import Gram, draws_poisson, grams, indexed_prediction, replicate_grams, total
from corvida.operators.stats import regression_metrics
from corvida.session import cut_lineage, release


def fold_column(ident: str, k: int, salt: int | Column = 0) -> Column:
    return F.pmod(portable_hash(ident, salt), F.lit(k)).cast("int")


def in_test(ident, fraction: float, salt: int | Column = 0) -> Column:
    return portable_hash(ident, salt) < int(fraction * HASH_PRIME)


def holdout(df: DataFrame, features, target: str, ident: str, fraction: float = 0.2, alpha: float = 1.0, salt: int = 0,
            test_ids: DataFrame | None = None):
    """(model, scored table with ``split``): random fraction, or the rows whose id is listed."""
    if test_ids is None:
        d = df.withColumn("split", F.when(in_test(ident, fraction, salt), "test").otherwise("train"))
    else:
        marked = test_ids.select(ident).distinct().withColumn("_t", F.lit("test"))
        d = df.join(marked, ident, "left").withColumn("split", F.coalesce("_t", F.lit("train"))).drop("_t")
    model = grams(d, features, target, ["split"])["train"].ridge(alpha)
    return model, d.withColumn("y_pred", model.column())


def kfold(df: DataFrame, features, target: str, ident: str, k: int = 5, alpha: float = 1.0, salt: int = 0):
    """(table with out-of-fold ``y_pred``, fold models): train statistics are total minus the fold."""
    d = df.withColumn("fold", fold_column(ident, k, salt))
    g = grams(d, features, target, ["fold"])
    tot = total(g.values())
    models = [(tot - g[f]).ridge(alpha) if f in g else tot.ridge(alpha) for f in range(k)]
    return d.withColumn("y_pred", indexed_prediction(models, F.col("fold"))), models


def repeated_kfold(df: DataFrame, features, target: str, ident: str, k: int = 5, repeats: int = 5, alpha: float = 1.0) -> DataFrame:
    """(row columns, repeat, fold, y_pred) for every repeat."""
    g = replicate_grams(df, features, target, ident, repeats, [lambda h, f=f: h % k == f for f in range(k)])
    models = []
    for rep in range(repeats):
        tot = total(part[rep][0] for part in g if rep in part)
        models += [(tot - part[rep][0]).ridge(alpha) if rep in part else tot.ridge(alpha) for part in g]
    d = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    d = d.withColumn("fold", fold_column(ident, k, F.col("repeat")))
    return d.withColumn("y_pred", indexed_prediction(models, F.col("repeat") * k + F.col("fold")))


def split_metrics(scored: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    return regression_metrics(scored, keys, target, "y_pred")


def mean_prediction(scored: DataFrame, ident: str, target: str) -> DataFrame:
    """Mean prediction of every row over the repeats."""
    return scored.groupBy(ident).agg(F.first(target).alias(target), F.avg("y_pred").alias("y_pred"), F.count("*").alias("prediction_count"))


def metric_summary(splits: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, min and max of each metric over splits."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])
    return splits.select(F.explode(cells).alias("c")).select("c.*").groupBy("metric").agg(
        F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def leave_one_out(df: DataFrame, features, target: str, alpha: float = 1.0, keep: Sequence[str] = ()) -> DataFrame:
    """Out-of-sample prediction of every row from the statistics with that row taken out,
    scaling refitted each time; rows are solved in vectorised blocks."""
    g = grams(df, features, target)[()]
    cols, p = [*features, target], len(features)
    n1 = g.n - 1

    step = max(1, 2_000_000 // (p + 1) ** 2)  # rows whose p x p matrices are held at a time

    def solve(batches):
        for pdf in batches:
            for i in range(0, len(pdf), step):
                yield solve_rows(pdf.iloc[i:i + step])

    def solve_rows(pdf):
        z = pdf[cols].to_numpy(float) - g.shift
        s = g.s - z
        c = g.ss - z[:, :, None] * z[:, None, :] - s[:, :, None] * s[:, None, :] / n1
        sd = np.sqrt(np.clip(np.diagonal(c, axis1=1, axis2=2)[:, :p], 0, None) / n1)
        sd = np.where(sd > 0, sd, 1.0)
        a = c[:, :p, :p] / (sd[:, :, None] * sd[:, None, :]) + alpha * np.eye(p)
        beta = np.linalg.solve(a, (c[:, :p, p] / sd)[:, :, None])[:, :, 0] / sd
        mean = s / n1
        out = pdf[[*keep, target]].copy()
        out["y_pred"] = g.shift[p] + mean[:, p] + ((z[:, :p] - mean[:, :p]) * beta).sum(axis=1)
        return out

    d = df.select(*keep, *[F.col(c).cast("double") for c in cols])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*keep, target).schema.fields) + ", y_pred double"
    return d.mapInPandas(solve, schema)


def group_holdout(df: DataFrame, features, target: str, group_hash: Column, fraction: float = 0.2, alpha: float = 1.0):
    """(model, scored table): whole groups go to one side, decided by the hash of the group key (an error when none is left to train on)."""
    d = df.withColumn("split", F.when(group_hash < int(fraction * HASH_PRIME), "test").otherwise("train"))
    train = grams(d, features, target, ["split"]).get("train")
    if train is None:
        raise ValueError("no group on the training side")
    model = train.ridge(alpha)
    return model, d.withColumn("y_pred", model.column())


def scaffold_holdout(df: DataFrame, features, target: str, scaffold: str, ident: str, valid: Column | None = None, fraction: float = 0.2, alpha: float = 1.0):
    """(model, scored table with ``group``): rows of one scaffold stay together, rows without one go alone."""
    d = df.withColumn("group", scaffold_label(scaffold, ident, valid))
    return group_holdout(d, features, target, portable_text_hash("group"), fraction, alpha)


def scaffold_label(scaffold: str, ident: str, valid: Column | None = None) -> Column:
    """Group label; rows without a scaffold or with an invalid structure stand alone."""
    lab = F.coalesce(F.when(F.trim(F.col(scaffold)) != "", F.col(scaffold)), F.concat(F.lit("acyclic::"), F.col(ident).cast("string")))
    return lab if valid is None else F.when(valid, lab).otherwise(F.concat(F.lit("invalid::"), F.col(ident).cast("string")))


def leaking_groups(scored: DataFrame, group: str) -> DataFrame:
    """Groups present on both sides (empty when the split is sound)."""
    return scored.groupBy(group).agg(F.count_distinct("split").alias("sides")).where("sides > 1")


def learning_curve(df: DataFrame, features, target: str, ident: str, k: int = 5, sizes: int = 5, alpha: float = 1.0) -> pd.DataFrame:
    """Train and held-out RMSE / R2 at nested training sizes, all from one table of (fold, part) statistics."""
    part = F.floor(portable_hash(ident, 777).cast("double") / HASH_PRIME * sizes).cast("int")
    d = df.withColumns({"fold": fold_column(ident, k), "part": part})
    g = grams(d, features, target, ["fold", "part"])
    rows = []
    for size in range(1, sizes + 1):
        tr, te = [], []
        n = []
        for f in range(k):
            train = total(v for (a, b), v in g.items() if a != f and b < size)
            test = total(v for (a, _), v in g.items() if a == f)
            if train is None or test is None:
                continue
            m = train.ridge(alpha)
            tr.append(train.scores(m))
            te.append(test.scores(m))
            n.append(train.n)
        row = {"train_size": float(np.mean(n)), "part": size}
        for name, vals in (("train", tr), ("cv", te)):
            for metric in ("rmse", "r2"):
                v = [x[metric] for x in vals]
                row[f"{name}_{metric}_mean"], row[f"{name}_{metric}_std"] = float(np.mean(v)), float(np.std(v, ddof=1))
        rows.append(row)
    return pd.DataFrame(rows)


def curve_diagnosis(table: pd.DataFrame) -> str:
    last = table.iloc[-1]
    gap = last["cv_rmse_mean"] - last["train_rmse_mean"]
    if gap > max(0.25 * abs(last["train_rmse_mean"]), 1e-12):
        return "possible_overfitting"
    if len(table) >= 2 and table["cv_rmse_mean"].iloc[-2] - last["cv_rmse_mean"] > 1e-12:
        return "more_data_may_help"
    return "curve_plateau"


def repeated_holdout(df: DataFrame, features, target: str, ident: str, repeats: int = 10, fraction: float = 0.2, alpha: float = 1.0) -> list[dict]:
    """Test RMSE / R2 of every random split."""
    cut = int(fraction * HASH_PRIME)
    test, train = replicate_grams(df, features, target, ident, repeats, [lambda h: h < cut, lambda h: h >= cut])
    return [{"repeat": r, **test[r][0].scores(train[r][0].ridge(alpha))} for r in range(repeats) if r in test and r in train]


def bootstrap_oob(df: DataFrame, features, target: str, ident: str, replicates: int = 50, alpha: float = 1.0) -> list[dict]:
    """Out-of-bag RMSE / R2 per resample; resampling counts are unit-mean Poisson hash draws."""
    drawn, left = replicate_grams(df, features, target, ident, replicates, [draws_poisson, lambda h: draws_poisson(h) == 0])
    return [{"replicate": b, **left[b][0].scores(drawn[b][0].ridge(alpha))} for b in range(replicates) if b in left and b in drawn]


def validation_table(df: DataFrame, features, target: str, ident: str, alpha: float = 1.0, fraction: float = 0.2, k: int = 5, repeats: int = 5, replicates: int = 50) -> DataFrame:
    """(method, r2, rmse, mae, r2_std, quality): training, hold-out, K-fold, leave-one-out, and the means over repeated K-fold,
    repeated hold-out and bootstrap out-of-bag; the last two come from cross products, which hold no absolute errors."""
    spark = df.sparkSession
    fitted = df.withColumn("y_pred", grams(df, features, target)[()].ridge(alpha).column())
    single = {"training": fitted, "hold_out": holdout(df, features, target, ident, fraction, alpha)[1].where("split = 'test'"),
              "k_fold": kfold(df, features, target, ident, k, alpha)[0], "leave_one_out": leave_one_out(df, features, target, alpha)}
    out = None
    for name, scored in single.items():
        row = regression_metrics(scored, [], target, "y_pred").select(F.lit(name).alias("method"), "r2", "rmse", "mae", F.lit(None).cast("double").alias("r2_std"))
        out = row if out is None else out.unionByName(row)
    folds = split_metrics(repeated_kfold(df, features, target, ident, k, repeats, alpha), ["repeat", "fold"], target)
    out = out.unionByName(folds.agg(F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.stddev_samp("r2").alias("r2_std")).withColumn("method", F.lit("repeated_k_fold")))
    for name, runs in (("repeated_hold_out", repeated_holdout(df, features, target, ident, repeats, fraction, alpha)), ("bootstrap_oob", bootstrap_oob(df, features, target, ident, replicates, alpha))):
        r2, rmse = ([r[m] for r in runs] for m in ("r2", "rmse"))
        row = (name, float(np.mean(r2)), float(np.mean(rmse)), None, float(np.std(r2, ddof=1)) if len(r2) > 1 else None)
        out = out.unionByName(spark.createDataFrame([row], "method string, r2 double, rmse double, mae double, r2_std double"))
    return out.withColumn("quality", quality_label("r2"))


def meet_shuffled(rows: DataFrame, times: int, moved: Sequence[str], kept: Sequence[str], meet: Callable[[pa.Table, Iterator[tuple[int, np.ndarray, pa.Table]]], Iterator[pa.RecordBatch]],
                  schema: StructType | str, held: int = 1 << 22, first: int = 0, made: bool = False) -> DataFrame:
    """``times`` shuffles of ``rows`` beside the rows whose places they take, one block of positions at a time.

    ``rows`` has ``_pos``, gapless from 0. In shuffle k a row takes the place that the salted hash of its position has among
    all; the hash is one-to-one below its prime, so there are no ties there. The hashes of each shuffle are counted in cells of
    equal width, and the counts say which blocks of places a cell falls into. So a row's ``moved`` columns are sent once per
    shuffle, straight to the block (twice where a cell lies across two blocks), and what is broadcast are the counts, some
    8 per block and shuffle. ``meet(own, met)`` gets the rows of a block (``_pos`` and ``kept``) by position and, for each k, the
    positions there (counted from 0 in the block) with the rows that take them. A block holds about ``held`` values. The shuffles
    are those from number ``first`` on; ``made`` says that ``rows`` has been cut from its lineage already."""
    rows = rows.select("_pos", *dict.fromkeys([*kept, *moved]))
    rows = rows if made else cut_lineage(rows)
    n, spark = rows.count(), rows.sparkSession
    block = max(256, held // (times * (len(moved) + 2)))
    at_once = max(64, held // 2 // (times * (len(moved) + 2)))  # rows sent at a time
    cells = 8 * max(1, -(-n // block))
    salts = np.arange(first, first + times) + 5003
    row0 = np.arange(times) * cells

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(times * cells, np.int64)
        for batch in batches:
            counts += np.bincount((portable_hash_block(batch.column(0).to_numpy(), salts) * cells // HASH_PRIME + row0).ravel(), minlength=times * cells)
        cell = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(counts[cell])], names=["cell", "n"])

    ends = np.zeros(times * cells, np.int64)
    for r in rows.select("_pos").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        ends[r["cell"]] = r["n"]
    ends = np.cumsum(ends.reshape(times, cells), axis=1)
    sent = spark.sparkContext.broadcast(np.concatenate((np.zeros((times, 1), np.int64), ends), axis=1))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = sent.value
        first, last = before[:, :-1].ravel() // block, (before[:, 1:].ravel() - 1) // block
        for whole in batches:
            for a in range(0, whole.num_rows, at_once):
                batch = whole.slice(a, at_once)
                h = portable_hash_block(batch.column(0).to_numpy(), salts)
                cell = (h * cells // HASH_PRIME + row0).ravel()
                copies = last[cell] - first[cell] + 1
                item = np.repeat(np.arange(len(cell)), copies)
                to = first[cell[item]] + np.arange(len(item)) - np.repeat(np.cumsum(copies) - copies, copies)
                order = np.argsort(to, kind="stable")
                item, to = item[order], to[order]
                cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
                offsets = pa.array(np.append(cut, len(to)), pa.int32())
                taken = batch.take(pa.array(item // times))
                lists = [pa.array((item % times).astype(np.int32)), pa.array(h.ravel()[item]), *(taken.column(i + 1) for i in range(len(moved)))]
                yield pa.RecordBatch.from_arrays([pa.array(to[cut]), *(pa.ListArray.from_arrays(offsets, v) for v in lists)], names=["_block", "_k", "_h", *moved])

    def met(items: pa.Table, low: int, size: int) -> Iterator[tuple[int, np.ndarray, pa.Table]]:
        k, h = (pc.list_flatten(items[c]).to_numpy() for c in ("_k", "_h"))
        columns = pa.table({c: pc.list_flatten(items[c]) for c in moved})
        order = np.lexsort((h, k))
        cut = np.searchsorted(k[order], np.arange(times + 1))
        for i in range(times):
            mine = order[cut[i] : cut[i + 1]]
            if len(mine):
                place = sent.value[i, h[mine[0]] * cells // HASH_PRIME] + np.arange(len(mine)) - low
                inside = (place >= 0) & (place < size)
                yield i, place[inside], columns.take(pa.array(mine[inside]))

    def join(own: pa.Table, items: pa.Table) -> pa.Table:
        if not own.num_rows or not items.num_rows:
            return arrow.empty_table()
        own = own.sort_by("_pos")
        low = own["_pos"][0].as_py() // block * block
        parts = list(meet(own, met(items, low, own.num_rows)))
        return pa.Table.from_batches(parts).cast(arrow) if parts else arrow.empty_table()

    empty = spark.createDataFrame([], schema)
    if not n:
        return empty
    schema = StructType([StructField(f.name, f.dataType) for f in empty.schema])
    arrow = to_arrow_schema(schema)
    kinds = dict(rows.dtypes)
    items = rows.select("_pos", *moved).mapInArrow(send, "_block long, _k array<int>, _h array<long>, " + ", ".join(f"`{c}` array<{kinds[c]}>" for c in moved))
    own = rows.select("_pos", *kept, F.expr(f"_pos div {block}").alias("_block"))
    return own.groupBy("_block").cogroup(items.groupBy("_block")).applyInArrow(join, schema)


def shuffled_positions(rows: DataFrame, times: int, number: str) -> DataFrame:
    """Every row once per ``number`` (0 to times - 1), with ``_pos`` replaced by its place in that shuffle.

    ``_pos`` is gapless from 0; the place is the rank of its salted hash (:func:`meet_shuffled`).
    """
    moved = [c for c in rows.columns if c != "_pos"]
    out = rows.select(*moved, F.lit(0).alias(number), F.col("_pos").cast("long")).schema

    def place(own: pa.Table, met: Iterator[tuple[int, np.ndarray, pa.Table]]) -> Iterator[pa.RecordBatch]:
        pos = own["_pos"].to_numpy()
        for k, at, others in met:
            others = others.combine_chunks().append_column(number, pa.array(np.full(len(at), k, np.int32))).append_column("_pos", pa.array(pos[at]))
            yield from others.to_batches()

    return meet_shuffled(rows, times, moved, [], place, out)


def permuted_target(df: DataFrame, ident: str, target: str, permutations: int) -> DataFrame:
    """(permutation, row columns with the target of another row): each permutation orders the positions by a salted hash."""
    pos = with_position(df, [], ident, "_pos")
    y = shuffled_positions(pos.select("_pos", F.col(target).alias("_y")), permutations, "permutation")
    return pos.drop(target).join(y, "_pos").withColumnRenamed("_y", target).drop("_pos")


def permuted_grams(df: DataFrame, features, target: str, ident: str, permutations: int, k: int, shift: np.ndarray, at_once: int = 1 << 24) -> dict[tuple[int, int | None], Gram]:
    """{(permutation, fold): statistics} of the rows with the target of another row, in the order of :func:`permuted_target`.

    A row's target travels once per permutation to the rows it meets, where the products are summed, so that only sums leave the
    blocks; the permutations go in lots of about ``at_once`` targets, one after the other."""
    x = [f"_x{i}" for i in range(len(features))]
    rows = with_position(df, [], ident, "_pos").select("_pos", fold_column(ident, k).alias("_fold"), *[F.col(f).cast("double").alias(c) for f, c in zip(features, x)], F.col(target).cast("double").alias("_y"))
    rows = cut_lineage(rows)
    p1 = len(x) + 1

    def numbers(column: pa.ChunkedArray) -> np.ndarray:
        return column.fill_null(np.nan).to_numpy()

    def sums(own: pa.Table, met: Iterator[tuple[int, np.ndarray, pa.Table]]) -> Iterator[pa.RecordBatch]:
        fold = own["_fold"].fill_null(-1).to_numpy()
        z = np.stack([numbers(own[c]) for c in x], axis=1) - shift[:-1]
        whole = np.isfinite(z).all(axis=1)
        for j, at, others in met:
            y = numbers(others["_y"]) - shift[-1]
            kept = whole[at] & np.isfinite(y)
            m, f, out = np.column_stack((np.ones(kept.sum()), z[at[kept]], y[kept])), fold[at[kept]], []
            for v in np.unique(f):
                own_fold = m[f == v]
                out.append((j, int(v), (own_fold.T @ own_fold).ravel().tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 3, (pa.int32(), pa.int32(), pa.list_(pa.float64())))], names=["permutation", "fold", "q"])

    out: dict[tuple[int, int | None], np.ndarray] = {}
    lot = max(1, at_once // max(1, rows.count()))
    for first in range(0, permutations, lot):
        times = min(lot, permutations - first)
        parts = meet_shuffled(rows, times, ["_y"], ["_fold", *x], sums, "permutation int, fold int, q array<double>", first=first, made=True)
        for r in parts.select("permutation", "fold", F.posexplode("q").alias("i", "v")).groupBy("permutation", "fold", "i").agg(F.sum("v").alias("v")).toLocalIterator():
            out.setdefault((first + r["permutation"], None if r["fold"] < 0 else r["fold"]), np.zeros((p1 + 1) ** 2))[r["i"]] = r["v"]
        del parts
        release(df.sparkSession)
    return {key: Gram(tuple(features), shift, q[0], q[1:p1 + 1], q.reshape(p1 + 1, p1 + 1)[1:, 1:]) for key, q in out.items()}


def y_randomization(df: DataFrame, features, target: str, ident: str, permutations: int = 20, k: int = 5, alpha: float = 1.0) -> dict:
    """Cross-validated Q2 of the real and of permuted targets; p = (1 + #permuted >= real) / (1 + permutations)."""
    def q2(g: dict[int, Gram]) -> float:
        tot = total(g.values())
        sse = sum(v.sse((tot - v).ridge(alpha)) for v in g.values())
        return 1 - sse / float(tot.centred[-1, -1])

    own = grams(df.withColumn("fold", fold_column(ident, k)), features, target, ["fold"])
    real = q2(own)
    g = permuted_grams(df, features, target, ident, permutations, k, next(iter(own.values())).shift)
    vals = [q2({f: v for (j, f), v in g.items() if j == i}) for i in range(permutations)]
    return {"q2": real, "permuted": vals, "permuted_mean": float(np.mean(vals)), "permuted_max": float(np.max(vals)),
            "p_value": (1 + sum(v >= real for v in vals)) / (1 + permutations)}


def conformal_radius(df: DataFrame, residual: Column, alpha: float = 0.1) -> float:
    """'Higher' quantile of the absolute residuals at ceil((n+1)(1-alpha))/n."""
    from math import ceil

    d = df.select(F.abs(residual).alias("a")).where("a IS NOT NULL")
    n = d.count()
    if n < 2:
        return float(d.first()["a"]) if n else float("nan")
    level = min(1.0, ceil((n + 1) * (1 - alpha)) / n)
    rank = min(n - 1, ceil(round((n - 1) * level, 9)))
    return exact_quantiles(d, [], "a", {"q": rank / (n - 1)}).first()["q"]


def interval_coverage(df: DataFrame, features, target: str, ident: str, confidence: float = 0.9, fraction: float = 0.2, k: int = 5, alpha: float = 1.0):
    """(radius, scored test rows): intervals calibrated on out-of-fold residuals of the training rows."""
    model, scored = holdout(df, features, target, ident, fraction, alpha)
    train = scored.where("split = 'train'").drop("y_pred")
    oof, _ = kfold(train, features, target, ident, k, alpha, salt=1)
    radius = conformal_radius(oof, F.col("y_pred") - F.col(target), 1 - confidence)
    test = scored.where("split = 'test'").withColumns({"lower": F.col("y_pred") - radius, "upper": F.col("y_pred") + radius})
    return radius, test.withColumn("inside", F.col(target).between(F.col("lower"), F.col("upper")))


def consensus(predictions: DataFrame, row: str, leaderboard: DataFrame | None = None, top_n: int | None = None, min_r2: float | None = None) -> DataFrame:
    """Mean and sample deviation per row over the chosen models of a long prediction table."""
    p = predictions
    if leaderboard is not None:
        m = leaderboard if min_r2 is None else leaderboard.where(F.col("r2") >= min_r2)
        m = m.orderBy(F.col("r2").desc(), "model").limit(top_n) if top_n else m
        p = p.join(m.select("model"), "model", "left_semi")
    return p.groupBy(row).agg(F.count("*").alias("models"), F.avg("y_pred").alias("consensus_mean"), F.stddev_samp("y_pred").alias("consensus_std"))
