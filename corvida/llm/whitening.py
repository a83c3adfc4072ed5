"""Embedding whitening from the exact characteristic polynomial of the integer scatter matrix.

Entries become whole numbers x = floor(256 c). Over the distinct vectors the matrix M = n * sum(x x') - S S' = n^2 * covariance is
exact: tasks sum blocks by exact floating-point products, Spark adds the partial sums as digits of base 2^30. The characteristic
polynomial of M is found modulo many 31-bit primes (Hessenberg reduction, a Spark job over the primes) and put together by
Chinese remaindering. All its roots are real, so the sign changes of the polynomial moved to ``a`` count the roots above ``a``
exactly; bisection with that count isolates the largest roots to ``FRACTION`` binary places. Components come from inverse
iteration on M - root in long decimal arithmetic; roots that agree in every place share an eigenspace and are orthogonalised.

Only numbers that depend on the dimension p reach the driver (p(p+1)/2 sums, p+1 residues per prime), never rows.

Defined cases
* null vector, or a null, NaN or infinite entry: the row is left out of fit and result. A null id stays null; repeated ids
  each give their own rows. An empty table gives no rows.
* the dimension is the most frequent length of the remaining vectors (the longest of equally frequent ones); other lengths
  are left out as well. Vectors without entries give no components and so no rows.
* values beyond the range of a long saturate, as a cast does. ``deviation`` is null where the exact number does not fit a
  long; ``deviation_exact`` then still holds its digits.
* a component without variance (fewer independent vectors than components) has a null ``whitened`` and explains 0; it is left
  out of ``identity_error``, which is null when no component has variance.
* other columns are dropped by :func:`whitened_rows` and kept by :func:`transform` unless named like a new one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
LIMB = 20  # exact products: limbs of 20 bits in blocks of 8192 rows stay below 2^53
BLOCK = 8192
DIGIT, DIGITS = 30, 6
FRACTION = 96  # binary places of an isolated root


def grid_vector(vector: str) -> Column:
    return F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE))


def usable(vector: str) -> Column:
    bad = F.exists(F.col(vector), lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def rows_to_matrix(col: pa.Array, p: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), p)


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as a sum of float64 limbs times 2^(20 k)."""
    out = []
    while True:
        low = x & ((1 << LIMB) - 1)
        high = x >> LIMB
        if not (high + (low >> (LIMB - 1))).any():  # what is left is a small signed number
            return [*out, x.astype(np.float64)]
        out.append(low.astype(np.float64))
        x = high


def exact_gram(x: np.ndarray) -> np.ndarray:
    """x' x of an int64 block of at most 8192 rows as exact Python integers."""
    parts = limbs(x)
    total = np.zeros((x.shape[1],) * 2, dtype=object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            total += (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    return total


def exact_sums(distinct: DataFrame, p: int) -> tuple[int, list[int], np.ndarray]:
    """Number of rows, sums per dimension and sums of products, exact, over the column ``x`` of ``distinct``."""
    rows, cols = np.triu_indices(p + 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = rows_to_matrix(batch.column(0), p)
            for a in range(0, len(x), BLOCK):
                one = np.ones((len(x[a : a + BLOCK]), 1), dtype=np.int64)  # the first row of the products is count and sums
                got = exact_gram(np.hstack([one, x[a : a + BLOCK]]))
                total = got if total is None else total + got
        if total is None:
            return
        left = total[rows, cols]
        digits = []
        for _ in range(DIGITS - 1):
            digits.append((left & ((1 << DIGIT) - 1)).astype(np.int64))
            left = left >> DIGIT
        digits.append(left.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(cols.astype(np.int32)), *map(pa.array, digits)], names=names)

    names = ["i", "j", *(f"d{k}" for k in range(DIGITS))]
    schema = ", ".join(f"{c} {'int' if c in 'ij' else 'bigint'}" for c in names)
    sums = distinct.select("x").mapInArrow(partial, schema).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in names[2:]))
    full = np.zeros((p + 1, p + 1), dtype=object)
    for r in sums.collect():
        v = sum(int(r[f"d{k}"]) << DIGIT * k for k in range(DIGITS))
        full[r["i"], r["j"]] = full[r["j"], r["i"]] = v
    return int(full[0, 0]), [int(v) for v in full[0, 1:]], full[1:, 1:]


def is_prime(m: int) -> bool:
    if m < 2 or any(m % q == 0 and m != q for q in (2, 3, 5, 7)):
        return False
    d, s = m - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for base in (2, 3, 5, 7):  # exact below 3.2e9
        v = pow(base, d, m)
        if base % m == 0 or v in (1, m - 1):
            continue
        for _ in range(s - 1):
            v = v * v % m
            if v == m - 1:
                break
        else:
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """31-bit primes whose product exceeds 2^bits, falling from 2^31, and one more as a test of the result."""
    out, m, have = [], 1 << 31, 0.0
    while have <= bits:
        m -= 1
        if is_prime(m):
            out.append(m)
            have += math.log2(m)
    m -= 1
    while not is_prime(m):
        m -= 1
    return [*out, m]


def charpoly_mod(h: np.ndarray, q: int) -> np.ndarray:
    """Coefficients, lowest first, of det(t - h) modulo the prime q; h holds residues as int64."""
    h = h.copy()
    p = len(h)
    for m in range(1, p - 1):  # similarity to upper Hessenberg form
        at = np.flatnonzero(h[m:, m - 1])
        if not len(at):
            continue
        r = m + int(at[0])
        if r != m:
            h[[r, m]] = h[[m, r]]
            h[:, [r, m]] = h[:, [m, r]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, q) % q
        if not u.any():
            continue
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m][None, :] % q) % q
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u[None, :] % q).sum(axis=1)) % q
    polys = np.zeros((p + 1, p + 1), dtype=np.int64)
    polys[0, 0] = 1
    for k in range(1, p + 1):
        new = np.roll(polys[k - 1], 1)
        new = (new - h[k - 1, k - 1] * polys[k - 1] % q) % q
        t, weights = 1, np.zeros(k - 1, dtype=np.int64)
        for i in range(k - 1, 0, -1):
            t = t * int(h[i, i - 1]) % q
            weights[i - 1] = t * int(h[i - 1, k - 1]) % q
        if k > 1:
            new = (new - (weights[:, None] * polys[: k - 1] % q).sum(axis=0)) % q
        polys[k] = new
    return polys[p]


def characteristic_polynomial(spark, matrix: np.ndarray) -> list[int]:
    """Exact integer coefficients, lowest first, of det(t - matrix) for a positive semidefinite integer matrix."""
    p = len(matrix)
    trace = max(1, int(sum(matrix[i, i] for i in range(p))))
    primes = primes_for(p * trace.bit_length() + p + 2)
    sent = spark.sparkContext.broadcast(matrix)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qs = batch.column(0).to_pylist()
            got = [charpoly_mod((sent.value % q).astype(np.int64), q).tolist() for q in qs]
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(got, pa.list_(pa.int64()))], names=["q", "residues"])

    parts = max(1, min(len(primes), 2 * spark.sparkContext.defaultParallelism))
    found = spark.createDataFrame([(q,) for q in primes], "q bigint").repartition(parts, "q").mapInArrow(residues, "q bigint, residues array<bigint>")
    by_prime = {r["q"]: r["residues"] for r in found.collect()}
    value, modulus = [0] * (p + 1), 1
    for q in primes[:-1]:
        inv = pow(modulus, -1, q)
        value = [v + modulus * ((r - v) * inv % q) for v, r in zip(value, by_prime[q])]
        modulus *= q
    value = [v - modulus if 2 * v > modulus else v for v in value]
    if [v % primes[-1] for v in value] != by_prime[primes[-1]]:
        raise ArithmeticError("the characteristic polynomial fails the test of the additional prime")
    return value


def scaled(poly: list[int], s: int) -> list[int]:
    """Polynomial whose roots are those of ``poly`` times 2^s."""
    p = len(poly) - 1
    return [c << s * (p - k) for k, c in enumerate(poly)]


def roots_above(poly: list[int], a: int) -> int:
    """Number of roots above ``a`` with multiplicity: sign changes after the move by a, exact when all roots are real."""
    c = list(poly)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += a * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign_at(poly: list[int], a: int) -> int:
    v = 0
    for c in reversed(poly):
        v = v * a + c
    return (v > 0) - (v < 0)


def largest_roots(poly: list[int], count: int) -> list[tuple[int, int]]:
    """The largest roots as (cell, multiplicity): root * 2^FRACTION lies in (cell, cell + 1], falling."""
    p = len(poly) - 1
    fine = scaled(poly, FRACTION)
    top = (max(1, abs(poly[p - 1])) << FRACTION) if p else 0  # the sum of the roots, none of them negative
    out: list[tuple[int, int]] = []
    spans = [(-1, top, 0, p)] if p else []  # (low, high, roots above high, roots above low)
    while spans and sum(m for _, m in out) < count:
        low, high, above, below = spans.pop()
        if below == above:
            continue
        if high - low == 1:
            out.append((low, below - above))
            continue
        if below - above == 1:  # one simple root: its sign change is enough
            up = sign_at(fine, high)
            if up == 0:
                out.append((high - 1, 1))
                continue
            while high - low > 1:
                mid = (low + high) // 2
                s = sign_at(fine, mid)
                if s == 0 or s == up:
                    high = mid
                    if s == 0:
                        low = mid - 1
                else:
                    low = mid
            out.append((low, 1))
            continue
        mid = (low + high) // 2
        at = roots_above(fine, mid)
        spans += [(low, mid, at, below), (mid, high, above, at)]
    return out


def solve_decimal(lu: np.ndarray, order: list[int], b: np.ndarray) -> np.ndarray:
    y = b[order].copy()
    p = len(y)
    for k in range(p):
        y[k + 1 :] = y[k + 1 :] - lu[k + 1 :, k] * y[k]
    for k in range(p - 1, -1, -1):
        y[k] = y[k] / lu[k, k]
        y[:k] = y[:k] - lu[:k, k] * y[k]
    return y


def factor_decimal(a: np.ndarray, tiny: Decimal) -> tuple[np.ndarray, list[int]]:
    a = a.copy()
    p = len(a)
    order = list(range(p))
    for k in range(p):
        r = k + max(range(p - k), key=lambda i: abs(a[k + i, k]))
        if r != k:
            a[[r, k]] = a[[k, r]]
            order[r], order[k] = order[k], order[r]
        if abs(a[k, k]) < tiny:
            a[k, k] = tiny
        a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
        a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - np.outer(a[k + 1 :, k], a[k, k + 1 :])
    return a, order


def null_vectors(matrix: np.ndarray, root: Decimal, multiplicity: int, size: Decimal, digits: int, found: list[np.ndarray]) -> list[np.ndarray]:
    """Orthonormal Decimal vectors of the null space of matrix - root, orthogonal to those found for the same cell."""
    p = len(matrix)
    shifted = np.array([[Decimal(int(v)) for v in row] for row in matrix], dtype=object)
    for i in range(p):
        shifted[i, i] -= root
    lu, order = factor_decimal(shifted, size * Decimal(10) ** (-digits + 8))
    out = []
    for m in range(multiplicity):
        y = np.array([Decimal((i * 7919 + m * 104729 + 31) * 2654435761 % 1000003 + 1) for i in range(p)], dtype=object)
        for _ in range(4):
            for u in [*found, *out]:
                y = y - u * sum(u * y)
            y = solve_decimal(lu, order, y / sum(y * y).sqrt())
            for u in [*found, *out]:
                y = y - u * sum(u * y)
        out.append(y / sum(y * y).sqrt())
    return out


@dataclass
class Whitening:
    """Fit of :func:`fit`: exact count and sums, falling eigenvalues of the covariance, unit components as columns."""

    n: int
    p: int
    sums: list[int]
    values: list[float] = field(default_factory=list)
    explained: list[float] = field(default_factory=list)
    components: np.ndarray | None = None
    identity_error: float | None = None
    scatter: np.ndarray | None = None


def dimension(rows: DataFrame, vector: str) -> int:
    sizes = rows.groupBy(F.size(vector).alias("p")).count()
    best = sizes.agg(F.max(F.struct("count", "p")).alias("best")).first()["best"]
    return 0 if best is None else best["p"]


def fit(embeddings: DataFrame, vector: str = "embedding", components: int = 4) -> Whitening:
    """Exact scatter of the distinct grid vectors, its largest eigenvalues and their components."""
    spark = embeddings.sparkSession
    rows = embeddings.where(usable(vector))
    p = dimension(rows, vector)
    if not p:
        return Whitening(0, 0, [])
    distinct = rows.where(F.size(vector) == p).select(grid_vector(vector).alias("x")).distinct()
    n, sums, products = exact_sums(distinct, p)
    scatter = np.array([[n * int(products[i, j]) - sums[i] * sums[j] for j in range(p)] for i in range(p)], dtype=object)
    poly = characteristic_polynomial(spark, scatter)
    trace = int(sum(scatter[i, i] for i in range(p)))
    k = min(components, p)
    with localcontext() as ctx:
        ctx.prec = digits = 60 + len(str(trace)) + FRACTION // 2
        vectors, values = [], []
        for cell, multiplicity in largest_roots(poly, k):
            zero = cell < 0
            root = Decimal(0) if zero else (Decimal(2 * cell + 1) / 2) / Decimal(1 << FRACTION)
            if not zero and sign_at(scaled(poly, FRACTION), cell + 1) == 0:  # an exact root on the grid
                root = Decimal(cell + 1) / Decimal(1 << FRACTION)
            take = min(multiplicity, k - len(values))
            if zero or root == 0:
                vectors += [None] * take
                values += [Decimal(0)] * take
            else:
                vectors += null_vectors(scatter, root, take, Decimal(max(1, trace)), digits, [])
                values += [root] * take
        units = np.zeros((p, k))
        for j, u in enumerate(vectors):
            if u is not None:
                units[:, j] = [float(v) for v in u]
        error = None
        exact = [[Decimal(float(v)) for v in units[:, j]] for j in range(k)]
        whole = np.array([[Decimal(int(v)) for v in row] for row in scatter], dtype=object)
        for i in range(k):
            for j in range(i, k):
                if values[i] and values[j]:
                    cov = sum(np.array(exact[i], dtype=object) * whole.dot(np.array(exact[j], dtype=object))) / (values[i] * values[j]).sqrt()
                    error = max(error or 0.0, float(abs(cov - (i == j))))
        square = Decimal(n * n)
        return Whitening(
            n, p, sums, [float(v / square) for v in values], [float(v / trace) if trace else 0.0 for v in values], units, error, scatter
        )


RESULT = "deviation bigint, deviation_exact string, whitened array<double>"


def transform(embeddings: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The usable rows with ``deviation``, ``deviation_exact`` and the array ``whitened``; columns of those names are replaced."""
    keep = [c for c in embeddings.columns if c not in ("deviation", "deviation_exact", "whitened")]
    quoted = [F.col(f"`{c}`") for c in keep]
    rows = embeddings.where(usable(vector) & (F.size(vector) == model.p)).select(*quoted, grid_vector(vector).alias("__x"))
    sent = embeddings.sparkSession.sparkContext.broadcast((model.n, model.p, model.sums, model.values, model.components))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), RESULT])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, p, sums, values, units = sent.value
        total = np.array(sums, dtype=object)
        divide = np.array([1 / math.sqrt(v) if v else np.nan for v in values])
        small = n < 1 << 31 and all(abs(s) < 1 << 61 for s in sums)
        for batch in batches:
            x = rows_to_matrix(batch.column(batch.num_columns - 1), p)
            if small and len(x) and max(-int(x.min()), int(x.max())) < (1 << 61) // max(1, n):
                centred = x * n - total.astype(np.int64)
                rough = (centred.astype(np.float64) ** 2).sum(axis=1)
                dev = (centred**2).sum(axis=1).astype(object)
                for r in np.flatnonzero(rough > 2.0**62):
                    dev[r] = sum(int(v) ** 2 for v in centred[r])
            else:
                centred = x.astype(object) * n - total
                dev = (centred**2).sum(axis=1) if len(x) else np.zeros(0, dtype=object)
            w = (centred.astype(np.float64) / n) @ units * divide
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1], pa.array(w.ravel(), mask=np.isnan(w.ravel())))
            new = [pa.array([int(d) if d < 1 << 63 else None for d in dev], pa.int64()), pa.array([str(d) for d in dev], pa.string()), lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*keep, "deviation", "deviation_exact", "whitened"])

    return rows.mapInArrow(score, schema)


def whitened_rows(embeddings: DataFrame, ident: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    narrow = embeddings.select(ident, vector)
    model = fit(narrow, vector, components)
    if not model.p:
        empty = f"{ident} {narrow.schema[ident].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact string"
        return embeddings.sparkSession.createDataFrame([], empty)
    explained = F.array(*(F.lit(v) for v in model.explained))
    return transform(narrow, model, vector).select(ident, "deviation", "deviation_exact", F.posexplode("whitened").alias("k", "whitened")).select(
        ident, (F.col("k") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("k") + 1).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"), "deviation_exact",
    )
