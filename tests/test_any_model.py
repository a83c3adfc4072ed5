"""Importance and search for tree models, against linear results, Spark's own scorers and plain loops."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvida.functions.columns import portable_hash_block
from corvida.operators import extra_trees, importance, models, validation
from corvida.operators.gram import grams

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = np.c_[rng.normal(size=400), rng.integers(0, 5, 400), rng.normal(size=400)]
    y = 3 * (x[:, 0] > 0) * x[:, 1] + 0.1 * rng.normal(size=400)
    pdf = pd.DataFrame({"id": np.arange(400) * 3, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "repeat": "clash", "n": 1})
    return spark.createDataFrame(pdf).repartition(5).cache(), x, y


def as_dict(df):
    return {r["descriptor"]: (r["importance_mean"], r["importance_std"], r["positive_repeats_fraction"]) for r in df.collect()}


def test_linear_model_gives_the_same(data):
    df = data[0].drop("repeat", "n")
    m = grams(df, COLS, "y")[()].ridge(1.0)
    for groups in (None, {"ab": ["a", "b"], "c": ["c"]}):
        plain = as_dict(importance.permutation_importance(df, m, "y", "id", 6, groups))
        blocks = as_dict(importance.model_permutation_importance(data[0], m.predict, COLS, "y", "id", 6, groups))
        assert plain.keys() == blocks.keys()
        for g in plain:
            assert np.allclose(plain[g], blocks[g], atol=1e-10)


def test_interacting_trees_against_a_loop(spark, data):
    df, x, y = data
    m = extra_trees.fit(df, COLS, "y", trees=9, depth=4)
    got = as_dict(importance.model_permutation_importance(df, m.predict, COLS, "y", "id", 5))
    place = validation.shuffled_positions(spark.range(400).withColumnRenamed("id", "_pos").withColumn("source", F.col("_pos")), 5, "repeat").toPandas()
    base = np.sqrt(np.mean((y - m.predict(x)) ** 2))
    for j, name in enumerate(COLS):
        rise = []
        for k in range(5):
            p = place[place["repeat"] == k].sort_values("_pos")["source"].to_numpy()
            z = x.copy()
            z[:, j] = x[p, j]
            rise.append(np.sqrt(np.mean((y - m.predict(z)) ** 2)) - base)
        assert np.allclose(got[name], (np.mean(rise), np.std(rise), np.mean(np.array(rise) > 0)), atol=1e-10)
    assert got["a"][0] > got["c"][0] and got["b"][0] > got["c"][0]


def test_a_row_is_sent_once_per_repeat(spark, data):
    """Each shuffle is one grouping by blocks of positions, whatever the number of repeats: no sketch, rank or join of all the repeats' rows."""
    df = data[0].drop("repeat", "n")
    m = grams(df, COLS, "y")[()].ridge(1.0)
    for out in (importance.permutation_importance(df, m, "y", "id", 6), importance.model_permutation_importance(df, m.predict, COLS, "y", "id", 6)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("held", [1 << 22, 5000])
def test_blocks_against_sorted_hashes(spark, held):
    """Many blocks and few give the same places, and every type of column comes through with its nulls."""
    n, times = 3000, 4
    rows = spark.range(n).select(F.col("id").alias("_pos"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("name"), F.expr("IF(id % 7 = 0, NULL, id / 2.0D)").alias("v")).repartition(6)

    def pairs(own, met):
        for k, at, others in met:
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.int32()), own["_pos"].combine_chunks().take(pa.array(at)), *(others[c].combine_chunks() for c in ("name", "v"))], names=["k", "spot", "name", "v"])

    got = validation.meet_shuffled(rows, times, ["name", "v"], [], pairs, "k int, spot long, name string, v double", held).toPandas()
    assert len(got) == n * times
    hashes = portable_hash_block(np.arange(n), np.arange(times) + 5003)
    for k in range(times):
        part, source = got[got["k"] == k].sort_values("spot"), np.argsort(hashes[:, k], kind="stable")
        assert part["spot"].tolist() == list(range(n))
        assert [x or None for x in part["name"]] == [str(i) if i % 3 else None for i in source]
        assert np.array_equal(part["v"].to_numpy(), np.where(source % 7 == 0, np.nan, source / 2.0), equal_nan=True)


def test_rows_with_nulls_keep_their_places(spark):
    """A null share is left out of its descriptor's mean only; a row without a residual is left out of all."""
    x = [(i, None if i % 5 == 0 else float(i % 7), float(i % 3), None if i % 11 == 0 else float(i % 13)) for i in range(200)]
    df = spark.createDataFrame(x, "id long, a double, b double, y double")
    m = grams(df.na.drop(), ["a", "b"], "y")[()].ridge(1.0)
    got = as_dict(importance.permutation_importance(df, m, "y", "id", 3))
    hashes = portable_hash_block(np.arange(200), np.arange(3) + 5003)
    a, b, y = (np.array([np.nan if r[i] is None else r[i] for r in x]) for i in (1, 2, 3))
    res, coef = y - m.predict(np.stack((a, b), axis=1)), dict(zip(m.features, m.coef))
    for name, v in (("a", a), ("b", b)):
        rise = []
        for k in range(3):
            o = v[np.argsort(hashes[:, k])]
            rise.append(np.sqrt(np.nanmean((res + coef[name] * (v - o)) ** 2)) - np.sqrt(np.nanmean(res ** 2)))
        assert np.allclose(got[name], (np.mean(rise), np.std(rise), np.mean(np.array(rise) > 0)))
    assert importance.permutation_importance(df.limit(0), m, "y", "id", 3).count() == 0


def test_incomplete_and_empty_rows(spark, data):
    df = data[0]
    m = extra_trees.fit(df, COLS, "y", trees=3, depth=2)
    bad = df.limit(3).withColumn("id", F.col("id") + 5000).withColumn("a", F.lit(None).cast("double")).unionByName(df.limit(2).withColumn("id", F.col("id") + 9000).withColumn("b", F.lit(float("nan"))))
    got, want = (as_dict(importance.model_permutation_importance(d, m.predict, COLS, "y", "id", 3)) for d in (df.unionByName(bad), df))
    assert got.keys() == want.keys() and all(np.allclose(got[g], want[g]) for g in want)
    assert importance.model_permutation_importance(df.limit(0), m.predict, COLS, "y", "id", 3).count() == 0


@pytest.mark.parametrize("kind, params", [("tree", {"maxDepth": 4}), ("forest", {"maxDepth": 4, "numTrees": 7}), ("boosted", {"maxDepth": 3, "maxIter": 4}), ("tree", {"maxDepth": 0})])
def test_trees_as_arrays_score_like_spark(data, kind, params):
    df, x, _ = data
    model, score = models.fit_tree(df, COLS, "y", kind, **params)
    scored = score(df).orderBy("id").toPandas()
    assert np.allclose(models.numeric_trees(model).predict(scored[COLS].to_numpy()), scored["y_pred"], atol=1e-9)


@pytest.mark.parametrize("kind, grid", [("tree", {"maxDepth": [1, 4], "minInstancesPerNode": [1, 200]}), ("extra", {"depth": [1, 4], "trees": [4]})])
def test_search_against_a_loop(data, kind, grid):
    df = data[0]
    table, score = models.tree_search(df, COLS, "y", "id", grid, kind, k=3)
    folds = df.withColumn("fold", validation.fold_column("id", 3))
    for row in table:
        setting = {k: v for k, v in row.items() if k != "cv_rmse"}
        want = []
        for f in range(3):
            scored = models.fit_tree(folds.where(F.col("fold") != f), COLS, "y", kind, **setting)[1](folds.where(F.col("fold") == f)).toPandas()
            want.append(np.sqrt(np.mean((scored["y"] - scored["y_pred"]) ** 2)))
        assert abs(row["cv_rmse"] - np.mean(want)) < (0.05 if kind == "tree" else 1e-9)  # bins of Spark ML trees follow a sample
    assert [r["cv_rmse"] for r in table] == sorted(r["cv_rmse"] for r in table) and score(df).count() == 400
    drawn = models.tree_search(df, COLS, "y", "id", grid, kind, k=3, draws=1)[0]
    assert len(drawn) == 1


def test_scaffold_holdout_keeps_groups_whole(spark, data):
    df = data[0].drop("repeat", "n").withColumn("scaffold", F.when(F.col("id") % 2 == 0, F.concat(F.lit("s"), (F.col("id") % 14).cast("string"))))
    _, scored = validation.scaffold_holdout(df, COLS, "y", "scaffold", "id", fraction=0.4)
    assert validation.leaking_groups(scored, "group").count() == 0 and validation.leaking_groups(scored.withColumn("all", F.lit(1)), "all").count() == 1
    with pytest.raises(ValueError):
        validation.scaffold_holdout(df, COLS, "y", "scaffold", "id", fraction=1.1)
