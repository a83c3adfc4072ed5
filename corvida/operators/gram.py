"""Additive sufficient statistics and the linear models solved from them.

One pass gives n, sums and cross products of the shifted columns per key. Keys are folds,
replicates or splits, so what reaches the driver is (number of splits) x (p+1)^2 numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.functions.columns import POISSON_CUTS, dot, portable_hash_block

EXPRESSION_LIMIT = 24
BLOCK = 256


@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    coef: np.ndarray
    intercept: float
    info: dict = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.intercept + x @ np.asarray(self.coef, dtype=float)

    def column(self) -> Column:
        return F.lit(float(self.intercept)) + dot(self.coef, self.features)


@dataclass
class Gram:
    """Weighted counts, sums and cross products of (features..., target) minus ``shift``."""

    features: tuple[str, ...]
    shift: np.ndarray
    n: float
    s: np.ndarray
    ss: np.ndarray

    def __add__(self, o: "Gram") -> "Gram":
        return Gram(self.features, self.shift, self.n + o.n, self.s + o.s, self.ss + o.ss)

    def __sub__(self, o: "Gram") -> "Gram":
        return Gram(self.features, self.shift, self.n - o.n, self.s - o.s, self.ss - o.ss)

    @property
    def mean(self) -> np.ndarray:
        return self.shift + self.s / self.n

    @property
    def centred(self) -> np.ndarray:
        return self.ss - np.outer(self.s, self.s) / self.n

    @property
    def p(self) -> int:
        return len(self.features)

    def covariance(self, ddof: int = 1) -> np.ndarray:
        return self.centred[:self.p, :self.p] / (self.n - ddof)

    def correlation(self) -> np.ndarray:
        c = self.centred
        d = np.sqrt(np.clip(np.diag(c), 0, None))
        d[d == 0] = np.inf
        return c / np.outer(d, d)

    def scales(self) -> np.ndarray:
        sd = np.sqrt(np.clip(np.diag(self.centred)[:self.p], 0, None) / self.n)
        return np.where(sd > 0, sd, 1.0)

    def _standard(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c, sd = self.centred, self.scales()
        return c[:self.p, :self.p] / np.outer(sd, sd), c[:self.p, -1] / sd, sd

    def _raw(self, beta: np.ndarray, sd: np.ndarray, **info) -> LinearModel:
        coef = beta / sd
        m = self.mean
        return LinearModel(self.features, coef, float(m[-1] - m[:self.p] @ coef), info)

    def ridge(self, alpha: float = 1.0) -> LinearModel:
        """Ridge on standardised columns; alpha 0 is least squares (minimum norm when singular)."""
        a, b, sd = self._standard()
        if alpha > 0:
            return self._raw(np.linalg.solve(a + alpha * np.eye(self.p), b), sd)
        return self._raw(np.linalg.pinv(a, hermitian=True) @ b, sd)

    def elastic_net(self, alpha: float, l1_ratio: float = 1.0, rounds: int = 5000, tol: float = 1e-10) -> LinearModel:
        """Coordinate descent on the standardised cross products (LASSO at l1_ratio 1)."""
        a, b, sd = self._standard()
        a, b = a / self.n, b / self.n
        beta = np.zeros(self.p)
        for _ in range(rounds):
            biggest = 0.0
            for j in range(self.p):
                if a[j, j] <= 0:
                    continue
                rho = b[j] - a[j] @ beta + a[j, j] * beta[j]
                new = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0.0) / (a[j, j] + alpha * (1 - l1_ratio))
                biggest = max(biggest, abs(new - beta[j]))
                beta[j] = new
            if biggest < tol * max(1.0, np.abs(beta).max()):
                break
        else:
            raise ArithmeticError(f"coordinate descent has not settled after {rounds} rounds: raise rounds or tol")
        return self._raw(beta, sd)

    def pls1(self, components: int) -> LinearModel:
        """Partial least squares with one target from the cross products alone."""
        a, b, sd = self._standard()
        k = int(max(1, min(components, self.p, self.n - 1)))
        b = b.copy()
        weights, loads, beta = [], [], np.zeros(self.p)
        for _ in range(k):
            norm = np.linalg.norm(b)
            if norm < 1e-12:
                break
            w = b / norm
            r = w.copy()
            for pj, rj in zip(loads, weights):
                r -= (pj @ w) * rj
            tt = r @ a @ r
            if tt < 1e-12:
                break
            load, q = a @ r / tt, r @ b / tt
            b = b - load * q * tt
            weights.append(r)
            loads.append(load)
            beta += q * r
        return self._raw(beta, sd, components=len(weights))

    def sse(self, m: LinearModel) -> float:
        """Squared error of a model on these rows, without touching the data again."""
        v = np.append(-np.asarray(m.coef), 1.0)
        const = float(v @ self.shift - m.intercept)
        return float(v @ self.ss @ v + 2 * const * (v @ self.s) + const * const * self.n)

    def scores(self, m: LinearModel) -> dict[str, float]:
        e = max(self.sse(m), 0.0)
        t = float(self.centred[-1, -1])
        return {"n": int(round(self.n)), "rmse": float(np.sqrt(e / self.n)), "r2": 1 - e / t if t > 0 else float("nan")}

    def leverage_matrix(self) -> tuple[np.ndarray, np.ndarray]:
        """(means, inverse) with h = 1/n + (x-m)' inverse (x-m)."""
        return self.mean[:self.p], np.linalg.pinv(self.centred[:self.p, :self.p], hermitian=True)


def column_means(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    row = df.agg(F.array(*[F.avg(F.col(c).cast("double")) for c in cols]).alias("m")).first()["m"]
    return np.array([0.0 if v is None else v for v in row], dtype=float)


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row rule for every size: a row with a NULL, NaN or infinity in any column is left out. Plain terms stay in generated code."""
    for a in range(0, len(cols), EXPRESSION_LIMIT):
        rule = F.lit(True)
        for c in cols[a:a + EXPRESSION_LIMIT]:
            rule = rule & (F.abs(F.col(c).cast("double")) < float("inf"))  # false for infinities and NaN, null for null
        df = df.where(rule)
    return df


def grams(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = (), weight: str | None = None,
          shift: np.ndarray | None = None) -> dict:
    """{key value(s): Gram}. Few columns are summed in generated code, more by block products; the driver gets p x p numbers per key."""
    cols = [*features, target]
    df = complete_rows(df, cols)
    shift = column_means(df, cols) if shift is None else shift
    p1 = len(cols)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    if p1 <= EXPRESSION_LIMIT:
        z = {f"_z{i}": (F.col(c) - F.lit(float(shift[i]))) for i, c in enumerate(cols)}
        d = df.select(*keys, w.alias("_w"), *[e.alias(n) for n, e in z.items()])
        aggs = [F.sum("_w").alias("n")]
        aggs += [F.sum(F.col("_w") * F.col(f"_z{i}")).alias(f"s{i}") for i in range(p1)]
        aggs += [F.sum(F.col("_w") * F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"q{i}_{j}") for i in range(p1) for j in range(i, p1)]
        out = {}
        for row in d.groupBy(*keys).agg(*aggs).collect():
            if not row["n"]:
                continue
            ss = np.zeros((p1, p1))
            for i in range(p1):
                for j in range(i, p1):
                    ss[i, j] = ss[j, i] = row[f"q{i}_{j}"]
            out[_key(row, keys)] = Gram(tuple(features), shift, row["n"], np.array([row[f"s{i}"] for i in range(p1)]), ss)
        return out
    out = {}
    parts = block_products(df, [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(cols, shift)], list(keys), w)
    for row in parts.toLocalIterator():
        name = _key(row, keys)
        if name not in out:
            out[name] = np.zeros((p1 + 1, p1 + 1))
        i, j, v = row["_i"] * BLOCK, row["_j"] * BLOCK, np.array(row["_v"])
        high, wide = min(BLOCK, p1 + 1 - i), min(BLOCK, p1 + 1 - j)
        out[name][i:i + high, j:j + wide] = v.reshape(high, wide)
        out[name][j:j + wide, i:i + high] = v.reshape(high, wide).T
    return {k: Gram(tuple(features), shift, m[p1, p1], m[p1, :p1], m[:p1, :p1]) for k, m in out.items() if m[p1, p1]}


def block_products(df: DataFrame, columns: Sequence[Column], keys: Sequence[str], weight: Column, pairwise: bool = False, numbers_at_once: int = 1 << 25) -> DataFrame:
    """(keys, _i, _j, _v): weighted products of all column pairs, column blocks ``_i <= _j`` of ``BLOCK`` columns each as one row.

    A last column of ones gives sums and counts. ``pairwise`` lets a null stand for a missing cell: then ``_v`` holds six
    products one after the other: a b, a over b's cells, b over a's, a a over b's, b b over a's, and the cells of both. A task keeps ``numbers_at_once`` sums at most: more column pairs than that go in several
    passes over the rows. As many tasks as cores add up rows, so that partial sums do not grow with the files; they are added up
    block by block in sorted streams."""
    p = len(columns) + (0 if pairwise else 1)
    blocks = -(-p // BLOCK)
    pairs = [(i, j) for i in range(blocks) for j in range(i, blocks)]
    k = list(keys)
    groups = df.select(*k).distinct().count() if k else 1
    layers = 6 if pairwise else 1
    per_pass = max(1, numbers_at_once // (groups * layers * min(BLOCK, p) ** 2))
    cells = F.array(*columns) if pairwise else F.array(*columns, F.lit(1.0))
    d = df.select(*[F.col(c) for c in k], weight.cast("double").alias("_w"), cells.alias("_x"))
    d = d.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))
    kinds = "".join(f"`{c}` {d.schema[c].dataType.simpleString()}, " for c in k)
    schema = kinds + "_i int, _j int, _v array<double>"
    n_keys = len(k)

    def products(x: np.ndarray, w: np.ndarray, chosen) -> dict:
        got = {}
        here = ~np.isnan(x) if pairwise else None
        z = np.where(here, x, 0.0) if pairwise else x
        cut = lambda m, b: m[:, b * BLOCK:(b + 1) * BLOCK]
        for i, j in chosen:
            if not pairwise:
                got[i, j] = (cut(z, i) * w[:, None]).T @ cut(z, j)
                continue
            a, b, on_a, on_b = cut(z, i), cut(z, j), cut(here, i).astype(float), cut(here, j).astype(float)
            got[i, j] = np.stack((a.T @ b, a.T @ on_b, on_a.T @ b, (a * a).T @ on_b, on_a.T @ (b * b), on_a.T @ on_b))
        return got

    def made(rows: list) -> pa.RecordBatch:
        kind = [pa.array([r[0][c] for r in rows]) for c in range(n_keys)]
        offsets = np.concatenate(([0], np.cumsum([r[2].size for r in rows])))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([r[2].ravel() for r in rows])))
        return pa.RecordBatch.from_arrays([*kind, pa.array([r[1][0] for r in rows], pa.int32()), pa.array([r[1][1] for r in rows], pa.int32()), lists], names=[*k, "_i", "_j", "_v"])

    out = None
    for low in range(0, len(pairs), per_pass):
        chosen = pairs[low:low + per_pass]

        def partial(batches, chosen=chosen):
            acc: dict = {}
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                x = batch.column(n_keys + 1).flatten().to_numpy(zero_copy_only=False).reshape(n, p)
                w = batch.column(n_keys).to_numpy(zero_copy_only=False)
                names = list(zip(*(batch.column(c).to_pylist() for c in range(n_keys)))) if n_keys else [()] * n
                code = {name: i for i, name in enumerate(dict.fromkeys(names))}
                which = np.fromiter((code[name] for name in names), dtype=np.int64, count=n)
                for name, i in code.items():
                    mine = which == i if len(code) > 1 else slice(None)
                    for pair, v in products(x[mine], w[mine], chosen).items():
                        acc[name, pair] = acc[name, pair] + v if (name, pair) in acc else v
            for (name, pair), v in acc.items():
                yield made([(name, pair, v)])

        part = d.mapInArrow(partial, schema)
        out = part if out is None else out.unionByName(part)
    order = [*k, "_i", "_j"]

    def add_up(batches):
        now, total = None, None
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in range(n_keys + 2))))
            for r, name in enumerate(names):
                v = batch.column(n_keys + 2)[r].values.to_numpy(zero_copy_only=False)
                if now == name:
                    total = total + v
                    continue
                if now is not None:
                    yield made([(now[:n_keys], now[n_keys:], total)])
                now, total = name, v
        if now is not None:
            yield made([(now[:n_keys], now[n_keys:], total)])

    return out.repartition(*order).sortWithinPartitions(*order).mapInArrow(add_up, schema)


def _key(row, keys):
    return () if not keys else row[keys[0]] if len(keys) == 1 else tuple(row[k] for k in keys)


def draws_poisson(h: np.ndarray) -> np.ndarray:
    """Resampling counts of a block of hashes, as :func:`corvida.functions.columns.poisson_weight` draws them."""
    return np.searchsorted(np.array(POISSON_CUTS), h, side="right")


def replicate_grams(df: DataFrame, features: Sequence[str], target: str, ident: str, replicates: int, weights: Sequence[Callable[[np.ndarray], np.ndarray]],
                    rows_at_once: int = 2048, numbers_at_once: int = 1 << 22) -> list[dict[int, tuple[Gram, int]]]:
    """Per weighting: {replicate: (Gram, rows with weight)} for resamples 0 to ``replicates`` - 1, without a copy of any row.

    A weighting turns a (rows, replicates) block of hashes of (id, replicate) into weights. The weighted sums of all
    replicates are one product of that block with the rows' packed outer products, so a batch costs one matrix product. A
    task keeps ``numbers_at_once`` sums at most: more replicates than that go in several passes. Rows without an id,
    or with a value that is not finite, are left out."""
    cols = [*features, target]
    df = complete_rows(df, cols).where(F.col(ident).isNotNull())
    shift = column_means(df, cols)
    p1 = len(cols)
    left, right = np.triu_indices(p1 + 1)
    size = len(left)
    d = df.select(F.col(ident).cast("bigint").alias("_id"), F.array(*[F.col(c).cast("double") for c in cols]).alias("_x"))
    per_pass = max(1, numbers_at_once // (size * len(weights)))
    out: list[dict[int, tuple[Gram, int]]] = [{} for _ in weights]
    for low in range(0, replicates, per_pass):
        salts = np.arange(low, min(replicates, low + per_pass))

        def add(batches, salts=salts):
            sums = np.zeros((len(weights), len(salts), size))
            rows = np.zeros((len(weights), len(salts)), dtype=np.int64)
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p1) - shift
                for a in range(0, len(ids), rows_at_once):
                    z = np.hstack((np.ones((len(ids[a:a + rows_at_once]), 1)), x[a:a + rows_at_once]))
                    packed = z[:, left] * z[:, right]
                    h = portable_hash_block(ids[a:a + rows_at_once], salts)
                    for i, weigh in enumerate(weights):
                        w = weigh(h)
                        rows[i] += (w != 0).sum(axis=0)
                        sums[i] += w.T.astype(float) @ packed
            if rows.any():
                which, rep = (v.ravel() for v in np.meshgrid(np.arange(len(weights)), salts, indexing="ij"))
                lists = pa.ListArray.from_arrays(np.arange(len(which) + 1, dtype=np.int32) * size, pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(rep.astype(np.int32)), pa.array(rows.ravel()), lists], names=["which", "replicate", "n", "v"])

        parts = d.mapInArrow(add, "which int, replicate int, n bigint, v array<double>")
        sums = parts.select("which", "replicate", "n", F.posexplode("v").alias("i", "x")).groupBy("which", "replicate", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        joined = sums.groupBy("which", "replicate").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
        for r in joined.collect():
            if r["n"]:
                full = np.zeros((p1 + 1, p1 + 1))
                full[left, right] = full[right, left] = r["v"]
                out[r["which"]][r["replicate"]] = (Gram(tuple(features), shift, full[0, 0], full[0, 1:], full[1:, 1:]), r["n"])
    return out


def total(parts) -> Gram:
    out = None
    for g in parts:
        out = g if out is None else out + g
    return out


def indexed_prediction(models: Sequence[LinearModel], index: Column) -> Column:
    """Prediction of model number ``index`` (0-based) as one expression."""
    pick = lambda vals: F.element_at(F.array(*[F.lit(float(v)) for v in vals]), index.cast("int") + 1)
    out = pick([m.intercept for m in models])
    for j, f in enumerate(models[0].features):
        out = out + pick([m.coef[j] for m in models]) * F.col(f)
    return out


def quadratic_form(cols: Sequence[str], centre: np.ndarray, matrix: np.ndarray) -> Column:
    """(x-c)' M (x-c); written out for few columns, as nested array folds for many."""
    z = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, centre)]
    if len(cols) <= EXPRESSION_LIMIT:
        out = F.lit(0.0)
        for i in range(len(cols)):
            out = out + F.lit(float(matrix[i, i])) * z[i] * z[i]
            for j in range(i + 1, len(cols)):
                out = out + F.lit(float(2 * matrix[i, j])) * z[i] * z[j]
        return out

    def block(x: pd.Series) -> pd.Series:
        a = np.vstack(x.to_numpy()) - centre
        return pd.Series(np.einsum("ij,jk,ik->i", a, matrix, a))

    return F.pandas_udf(block, "double")(F.array(*[F.col(c).cast("double") for c in cols]))
