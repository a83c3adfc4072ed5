"""Reusable column expressions; everything here stays inside generated JVM code."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_PRIME = 2147483647
HASH_A, HASH_B, HASH_C = 48271, 69621, 12345

# Accepted spellings of a true flag.
TRUE_WORDS = ("true", "1", "yes", "y", "да")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


NUMBER_TEXT = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf(inity)?)\s*$"
NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def to_number(c) -> Column:
    """Number from text with a decimal point or comma; anything else is null.

    The pattern test comes first: a failing cast raises and catches per row, which is far slower.
    """
    t = F.translate(col(c).cast("string"), ",", ".")
    return F.when(t.rlike(NUMBER_TEXT), t.try_cast("double"))


def number_of(df, c: str) -> Column:
    """:func:`to_number` for text columns, a plain cast for columns that are numbers already."""
    if dict(df.dtypes).get(c) in NUMERIC_TYPES:
        return nan_to_null(F.col(c).cast("double"))
    return to_number(c)


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def finite(c) -> Column:
    """Null for NaN and both infinities."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def blank_to_null(c) -> Column:
    """Null for empty text and the literals nan / none / null."""
    t = F.trim(col(c).cast("string"))
    return F.when(~F.lower(t).isin("", "nan", "none", "null"), t)


def truthy(c, extra: Sequence[str] = ()) -> Column:
    return F.lower(F.trim(F.coalesce(col(c).cast("string"), F.lit("")))).isin(*TRUE_WORDS, *extra)


def ratio(num, den) -> Column:
    """num / den, null when the denominator is zero or null."""
    den = col(den).cast("double")
    return F.when(den != 0, col(num).cast("double") / den)


def once(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.transform(F.array(value), fn)[0]


def portable_hash(c, salt: int | Column = 0) -> Column:
    """Integer hash computed in BIGINT only, so any SQL engine repeats it.

    The salted number is raised to the fifth power modulo a prime, a one-to-one map that is not linear, so draws
    under different salts are not shifts of each other. Ids beyond the prime enter with their quotient.
    """
    p = F.lit(HASH_PRIME)
    s = salt if isinstance(salt, Column) else F.lit(salt)
    x = col(c).cast("bigint")
    folded = F.pmod(x, p) + F.pmod(F.call_function("div", x, p), p) * HASH_B
    start = F.pmod(F.pmod(folded, p) * HASH_A + F.pmod(s.cast("bigint"), p) * HASH_B + HASH_C, p)
    fifth = once(start, lambda v: F.pmod(F.pmod(F.pmod(v * v, p) * F.pmod(v * v, p), p) * v, p))
    return F.pmod(fifth * HASH_A + F.pmod(s.cast("bigint"), p) * HASH_C + 7919, p)


def portable_hash_block(x: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """(rows, salts) hashes of ids in NumPy, equal to :func:`portable_hash`."""
    p = np.int64(HASH_PRIME)
    x, s = x.astype(np.int64)[:, None], salts.astype(np.int64)[None, :] % p
    quotient = np.where(x < 0, -(-x // p), x // p)  # towards zero, as the column form divides
    v = ((x % p + quotient % p * HASH_B) % p * HASH_A + s * HASH_B + HASH_C) % p
    square = v * v % p
    return (square * square % p * v % p * HASH_A + s * HASH_C + 7919) % p


def portable_text_hash(c, salt: int | Column = 0) -> Column:
    """The same for text keys: over the first 32 bits of the MD5 sum of the UTF-8 bytes."""
    return portable_hash(F.conv(F.substring(F.md5(F.encode(col(c), "UTF-8")), 1, 8), 16, 10), salt)


def portable_hash_sql(expr: str, salt: str | int = 0) -> str:
    """The same hash as SQL text (non-negative ids)."""
    x, p = f"CAST({expr} AS BIGINT)", HASH_PRIME
    start = f"((({x} % {p} + (({x} // {p}) % {p}) * {HASH_B}) % {p}) * {HASH_A} + (CAST({salt} AS BIGINT) % {p}) * {HASH_B} + {HASH_C}) % {p}"
    square = f"((({start}) * ({start})) % {p})"
    fifth = f"((({square} * {square}) % {p}) * ({start}) % {p})"
    return f"(({fifth} * {HASH_A} + (CAST({salt} AS BIGINT) % {p}) * {HASH_C} + 7919) % {p})"


def portable_text_hash_sql(expr: str, salt: str | int = 0) -> str:
    return portable_hash_sql(f"('0x' || substr(md5({expr}), 1, 8))", salt)


# P(N <= k) of a unit-mean Poisson variable, scaled to the hash range, as far as the range can tell values apart.
POISSON_CUTS = tuple(int(math.fsum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * HASH_PRIME) for k in range(12))


def poisson_weight(h: Column) -> Column:
    """Resampling count of a row in a bootstrap replicate (unit-mean Poisson draw from a hash)."""
    w = F.lit(0)
    for cut in POISSON_CUTS:
        w = w + F.when(h >= cut, 1).otherwise(0)
    return w


def poisson_weight_sql(h: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {h} >= {c} THEN 1 ELSE 0 END" for c in POISSON_CUTS) + ")"


def case_map(c, mapping: Mapping, default=None) -> Column:
    """CASE over fixed key/value pairs."""
    c = col(c)
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(default) if default is not None else out


def dot(coef: Iterable[float], cols: Iterable[str]) -> Column:
    out = None
    for b, c in zip(coef, cols):
        term = F.lit(float(b)) * col(c)
        out = term if out is None else out + term
    return out if out is not None else F.lit(0.0)
