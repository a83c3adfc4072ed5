"""Plans without cartesian products, independent resampling draws, one row rule for every matrix size."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corvida.functions.columns import portable_hash, portable_hash_block, portable_text_hash
from corvida.functions.ranks import concordance, exact_quantiles, robust_sigma, with_position
from corvida.operators.gram import grams
from corvida.operators.selection import farthest_first
from corvida.operators.validation import shuffled_positions

SF = "/root/testdata/sf0.001"


def nested_loops(df):
    """Condition-free joins of the plan that do not broadcast one row."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in plan.splitlines() if re.search(r"\bJoin (Inner|Cross|LeftOuter)\s*$", x)]


@pytest.mark.parametrize("name", ["agg9_target_statistics", "agg13_residual_statistics", "win11_error_rank", "unc2_conformal_interval"])
def test_no_cartesian_product(spark, name):
    df = entry.queries()[name](spark, SF)
    assert "CartesianProduct" not in df._jdf.queryExecution().toString()
    assert not nested_loops(df)


def test_keyless_ranks(spark):
    x = np.random.default_rng(1).normal(size=500)
    d = spark.createDataFrame([(i, float(v), float(v * v)) for i, v in enumerate(x)], "id long, x double, y double")
    for df in (exact_quantiles(d, [], "x", {"q": 0.3}), robust_sigma(d, [], "x"), concordance(d, [], "x", "y"), with_position(d, [], "id")):
        assert "CartesianProduct" not in df._jdf.queryExecution().toString() and not nested_loops(df)
    assert np.isclose(exact_quantiles(d, [], "x", {"q": 0.3}).first()["q"], np.quantile(x, 0.3))


def test_draws_are_independent(spark):
    d = spark.range(15_000).select("id", *[F.pmod(portable_hash("id", s), F.lit(5)).alias(f"f{s}") for s in range(4)]).toPandas()
    for a in range(4):
        for b in range(a):
            table = np.histogram2d(d[f"f{a}"], d[f"f{b}"], bins=5)[0] / len(d)
            assert abs(table - 1 / 25).max() < 0.006
    big = np.array([0, 1, 7, 2**31 - 1, 2**31, 2**40 + 5, 10**12])
    want = [[r[f"h{s}"] for s in (0, 3)] for r in spark.createDataFrame([(int(v),) for v in big], "v long").select(*[portable_hash("v", s).alias(f"h{s}") for s in (0, 3)]).collect()]
    assert (portable_hash_block(big, np.array([0, 3])) == np.array(want)).all()
    words = spark.createDataFrame([("a",), ("b",), ("c",)], "w string").select(portable_text_hash("w").alias("h")).distinct()
    assert words.count() == 3


def test_shuffles_are_permutations(spark):
    d = spark.range(400).select(F.col("id").alias("_pos"), F.col("id").alias("v"))
    s = shuffled_positions(d, 3, "k").toPandas()
    orders = [tuple(s[s.k == k].sort_values("_pos").v) for k in range(3)]
    assert all(sorted(o) == list(range(400)) for o in orders) and len(set(orders)) == 3
    assert all(abs(np.corrcoef(a, b)[0, 1]) < 0.2 for a in orders for b in orders if a is not b)


@pytest.mark.parametrize("columns", [22, 23, 24, 25])
def test_gram_row_rule(spark, columns):
    rng = np.random.default_rng(columns)
    x = rng.normal(size=(60, columns + 1))
    rows = [tuple(map(float, r)) for r in x]
    for i, bad in ((3, float("nan")), (7, float("inf")), (11, float("-inf")), (20, None)):
        rows[i] = (*rows[i][:1], bad, *rows[i][2:])
    names = [f"c{i}" for i in range(columns)] + ["y"]
    g = grams(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)), names[:-1], "y")[()]
    kept = np.delete(x, [3, 7, 11, 20], axis=0)
    assert g.n == len(kept)
    assert np.allclose(g.centred, (kept - kept.mean(0)).T @ (kept - kept.mean(0)))


def test_farthest_first_does_not_depend_on_partitions(spark):
    x = np.random.default_rng(2).normal(size=(500, 2))
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    picks = [{r["id"] for r in farthest_first(d.repartition(n), ["a", "b"], "id", 10, keep=4).collect()} for n in (1, 7)]
    assert picks[0] == picks[1] and len(picks[0]) == 10
