"""Block products and resampled cross products against NumPy and pandas; a table of 5,000 descriptors."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvida.functions.columns import poisson_weight, portable_hash, portable_hash_block
from corvida.operators import gram, importance, stats, uncertainty, validation


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(4)
    n = 400
    x = {f"x{i}": rng.normal(i, 1 + i % 3, n) for i in range(30)}
    d = pd.DataFrame({"id": np.arange(n) - 50, "g": np.arange(n) % 3, "w": np.arange(n) % 4 + 0.5, **x})
    d["x7"] = d["x6"] * 2 + rng.normal(0, 0.01, n)
    d["x9"] = 5.0
    d["y"] = d["x1"] - d["x2"] + rng.normal(0, 0.1, n)
    return d


def test_grouped_weighted_products(spark, table, monkeypatch):
    names = [f"x{i}" for i in range(30)]
    df = spark.createDataFrame(table).repartition(5)
    for block, numbers in ((256, 1 << 25), (8, 1 << 25), (8, 500)):
        monkeypatch.setattr(gram, "BLOCK", block)
        monkeypatch.setattr(gram.block_products, "__defaults__", (False, numbers))
        got = gram.grams(df, names, "y", ["g"], weight="w")
        assert sorted(got) == [0, 1, 2]
        for g, m in got.items():
            part = table[table.g == g]
            z = part[[*names, "y"]].to_numpy() - m.shift
            w = part.w.to_numpy()
            assert np.isclose(m.n, w.sum()) and np.allclose(m.s, w @ z) and np.allclose(m.ss, (z * w[:, None]).T @ z)


def test_rows_with_gaps_and_no_rows(spark, table):
    names = [f"x{i}" for i in range(30)]
    odd = table.copy()
    odd.loc[0, "x0"], odd.loc[1, "x1"], odd.loc[2, "y"] = np.nan, np.inf, np.nan
    m = gram.grams(spark.createDataFrame(odd), names, "y")[()]
    assert m.n == len(table) - 3
    assert gram.grams(spark.createDataFrame(odd).limit(0), names, "y") == {}


def test_correlations_over_the_cells_both_have(spark, table, monkeypatch):
    holes = table.drop(columns=["id", "g", "w"]).mask(np.random.default_rng(0).random((400, 31)) < 0.1)
    want = holes.corr()
    for block in (256, 7):
        monkeypatch.setattr(gram, "BLOCK", block)
        monkeypatch.setattr(stats, "BLOCK", block)
        rows = stats.correlation_matrix(spark.createDataFrame(holes), list(holes.columns)).collect()
        assert len(rows) == 31 * 30 // 2
        for r in rows:
            w = want.loc[r["left"], r["right"]]
            assert r["r"] is None if "x9" in (r["left"], r["right"]) else abs(r["r"] - w) < 1e-9


def test_correlation_groups_by_ranks(spark, table):
    names = [f"x{i}" for i in range(12)]
    got = importance.correlation_groups(spark.createDataFrame(table), names, "id")
    assert sorted(map(tuple, got)) == sorted([("x6", "x7"), *((n,) for n in names if n not in ("x6", "x7"))])


def test_five_thousand_descriptors(spark):
    """Plans and runs beyond any fixed column number."""
    p, n = 5000, 60
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, p))
    rows = [(i, x[i].tolist(), float(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y double").repartition(4)
    parts = gram.block_products(df, [F.col("v")[i] for i in range(p)], [], F.lit(1.0))
    blocks = {(r["_i"], r["_j"]): np.array(r["_v"]) for r in parts.where("_i = 0 AND _j = 16 OR _i = 19 AND _j = 19").collect()}
    assert np.allclose(blocks[0, 16].reshape(256, 256), x[:, :256].T @ x[:, 4096:4352])
    last = np.hstack((x[:, 4864:], np.ones((n, 1))))
    assert np.allclose(blocks[19, 19].reshape(137, 137), last.T @ last)


def test_hash_blocks_of_negative_ids(spark):
    ids = np.array([-(2**40), -7, -1, 0, 5, 2**31, 2**55])
    got = portable_hash_block(ids, np.arange(3))
    rows = spark.createDataFrame([(int(i),) for i in ids], "id long").select(*[portable_hash("id", s).alias(f"h{s}") for s in range(3)]).collect()
    assert got.tolist() == [[r[f"h{s}"] for s in range(3)] for r in rows]


def test_replicates_equal_copied_rows(spark, table):
    df = spark.createDataFrame(table[["id", "x1", "x2", "y"]])
    drawn, left = gram.replicate_grams(df, ["x1", "x2"], "y", "id", 7, [gram.draws_poisson, lambda h: gram.draws_poisson(h) == 0], rows_at_once=64, numbers_at_once=60)
    copies = df.crossJoin(spark.range(7).withColumnRenamed("id", "b")).withColumn("w", poisson_weight(portable_hash("id", F.col("b"))))
    slow = gram.grams(copies.where("w > 0"), ["x1", "x2"], "y", ["b"], weight="w", shift=drawn[0][0].shift)
    out = gram.grams(copies.where("w = 0"), ["x1", "x2"], "y", ["b"], shift=drawn[0][0].shift)
    for b in range(7):
        for fast, want in ((drawn[b][0], slow[b]), (left[b][0], out[b])):
            assert np.isclose(fast.n, want.n) and np.allclose(fast.s, want.s) and np.allclose(fast.ss, want.ss)
        assert drawn[b][1] + left[b][1] == len(table)
    assert len(uncertainty.bootstrap_models(df, ["x1", "x2"], "y", "id", 7)) == 7
    assert len(validation.repeated_holdout(df, ["x1", "x2"], "y", "id", 4)) == 4


def test_correlation_groups_with_ids_that_repeat_or_are_null(spark):
    rows = [(i // 3 if i % 5 else None, float(i), float(i * i), float((i * 7919) % 101)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    assert importance.correlation_groups(df, ["a", "b", "c"], "id") == [["a", "b"], ["c"]]
