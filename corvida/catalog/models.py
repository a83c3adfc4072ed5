"""Model families, selection, importance, projections and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvida.catalog.banks import _scratch
from corvida.catalog.modelling import PRED, X, customer_matrix, embeddings, ridge_sql, score_sql
from corvida.catalog.registry import LINES_SQL, ORDERS_SQL, fold_sql, lines, order_matrix, query, r, rounded, table
from corvida.functions.columns import HASH_PRIME, poisson_weight_sql, portable_hash_sql
from corvida.operators import bank, extra_trees, importance, models, selection, stats, validation
from corvida.operators.gram import grams
from corvida.plans import flows

FEATS = ["x1", "x2", "x3", "x4", "x5"]


def _metrics(df, name):
    return stats.regression_metrics(df, [], "y", "y_pred").select(F.lit(name).alias("model"), "n", "rmse", "r2")


@query("mdl2_lasso_elastic_net")
def mdl2(spark, sf):
    g = grams(lines(spark, sf), FEATS, "y")[()]
    return models.model_table(spark, {"lasso": g.elastic_net(10.0), "elastic_net": g.elastic_net(10.0, 0.5)})


@query("mdl3_pls")
def mdl3(spark, sf):
    g = grams(lines(spark, sf), FEATS, "y")[()]
    return models.model_table(spark, {"pls2": g.pls1(2), "pls5": g.pls1(5)})


@query("mdl4_basis_ridge")
def mdl4(spark, sf):
    d = lines(spark, sf)
    s, cs = models.spline_basis(d, ["x1", "x5"])
    h, ch = models.hinge_basis(d, ["x1", "x5"])
    return _metrics(s.withColumn("y_pred", grams(s, cs, "y")[()].ridge(1.0).column()), "spline").unionByName(
        _metrics(h.withColumn("y_pred", grams(h, ch, "y")[()].ridge(1.0).column()), "hinge"))


@query("mdl5_tree_models")
def mdl5(spark, sf):
    d = lines(spark, sf)
    out = None
    for kind, params in (("tree", {"maxDepth": 5}), ("forest", {"numTrees": 10, "maxDepth": 5}), ("extra", {"trees": 100, "depth": 5}), ("boosted", {"maxIter": 5, "maxDepth": 3})):
        m = _metrics(models.fit_tree(d, FEATS, "y", kind, **params)[1](d), kind)
        out = m if out is None else out.unionByName(m)
    return out


STUMPS = 20
STUMP_CUTS = ", ".join(f"({j}, (SELECT min({c}) FROM lines), (SELECT max({c}) FROM lines))" for j, c in enumerate(FEATS))
STUMP_SUMS = " UNION ALL ".join(f"SELECT t, f, cut, count(*) FILTER (WHERE {c} <= cut) AS nl, sum(y) FILTER (WHERE {c} <= cut) AS sl, count(*) AS n, sum(y) AS s FROM lines, cuts WHERE f = {j} GROUP BY t, f, cut" for j, c in enumerate(FEATS))


@query("mdl5_extra_trees_depth_one", f"""WITH {LINES_SQL}, rg(f, lo, hi) AS (VALUES {STUMP_CUTS}), tr AS (SELECT unnest(range({STUMPS})) AS t),
cuts AS (SELECT t, f, lo + ({portable_hash_sql(f't * {extra_trees.TREE_STRIDE} + {extra_trees.NODE_STRIDE} + f')} + 0.5::DOUBLE) / {HASH_PRIME} * (hi - lo) AS cut FROM tr, rg), sums AS ({STUMP_SUMS}),
best AS (SELECT * FROM sums WHERE nl > 0 AND nl < n QUALIFY row_number() OVER (PARTITION BY t ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC, f) = 1)
SELECT CAST(t AS INTEGER) AS tree, 'x' || (f + 1) AS descriptor, {r('cut', 6, 'cut')}, {r('sl / nl', 4, 'left_mean')}, {r('(s - sl) / (n - nl)', 4, 'right_mean')} FROM best""")
def mdl5_stumps(spark, sf):
    m = models.fit_tree(lines(spark, sf), FEATS, "y", "extra", trees=STUMPS, depth=1)[0]
    rows = [(t, FEATS[m.feature[t, 1]], float(m.cut[t, 1]), float(m.value[t, 2]), float(m.value[t, 3])) for t in range(STUMPS)]
    return rounded(spark.createDataFrame(rows, "tree int, descriptor string, cut double, left_mean double, right_mean double"), 4, cut=6)


@query("mdl7_voting", f"""WITH {ORDERS_SQL}, {ridge_sql('m', 'om')}, p AS (SELECT row_id, {PRED} AS a, 250000.0 AS b FROM om, m) SELECT row_id, {r('(3 * a + b) / 4', 2, 'y_pred')} FROM p""")
def mdl7(spark, sf):
    d = order_matrix(spark, sf)
    m = grams(d, X, "y")[()].ridge(1.0)
    long = d.select("row_id", F.explode(F.array(F.struct(F.lit("a").alias("model"), m.column().alias("y_pred")), F.struct(F.lit("b").alias("model"), F.lit(250000.0).alias("y_pred")))).alias("s")).select("row_id", "s.*")
    return rounded(models.vote(long, "row_id", {"a": 3.0, "b": 1.0}), 2)


@query("mdl7_stacking")
def mdl7_stack(spark, sf):
    d = lines(spark, sf)
    _, score = models.stack(d, {"a": ["x1", "x2"], "b": ["x4", "x5"]}, "y", "row_id")
    return _metrics(score(d), "stack")


@query("mdl9_descriptor_selection", f"""WITH {LINES_SQL}, c AS (SELECT corr(x1, y) AS a, corr(x5, y) AS b, count(*) AS n FROM lines)
SELECT 'x1' AS descriptor, 'selected' AS status, true AS selected, {r('a * a / (1 - a * a) * (n - 2)', 4, 'f_score')} FROM c UNION ALL SELECT 'x5', 'kept_not_selected', false, {r('b * b / (1 - b * b) * (n - 2)', 4)} FROM c
UNION ALL SELECT 'copy', 'removed_correlated', false, {r('a * a / (1 - a * a) * (n - 2)', 4)} FROM c UNION ALL SELECT 'flat', 'removed_constant', false, 0.0 FROM c""")
def mdl9(spark, sf):
    d = lines(spark, sf).withColumns({"copy": F.col("x1") * 2 + 1, "flat": F.lit(1.0)})
    rows = models.select_descriptors(d, ["x1", "copy", "x5", "flat"], "y", max_features=1)[1]
    return rounded(spark.createDataFrame(rows, "descriptor string, f_score double, reason string, selected boolean, status string").select("descriptor", "status", "selected", "f_score"), 4)


@query("mdl9_other_methods")
def mdl9_methods(spark, sf):
    d = lines(spark, sf)
    rows = [(m, ", ".join(models.select_descriptors(d, FEATS, "y", m, 2)[0])) for m in ("none", "lasso", "mutual_info", "rfe_ridge", "forest")]
    return spark.createDataFrame(rows, "method string, selected string")


@query("mdl10_grid_search")
def mdl10(spark, sf):
    return spark.createDataFrame(models.grid_search(lines(spark, sf), FEATS, "y", "row_id", [0.1, 1.0, 10.0], [None, 0.5, 1.0]), "alpha double, l1_ratio double, cv_rmse double, q2 double")


ALPHAS = (0.1, 1.0, 10.0, 1000.0)
GRID_SQL = ", ".join(f"{ridge_sql(f'g{i}', 'kt', 'f', alpha=a)}" for i, a in enumerate(ALPHAS))
GRID_ROWS = " UNION ALL ".join(f"SELECT {a}::DOUBLE AS alpha, y, {PRED} AS p FROM kd JOIN g{i} ON f = fold" for i, a in enumerate(ALPHAS))


@query("mdl10_ridge_grid", f"""WITH {ORDERS_SQL}, kd AS (SELECT *, {fold_sql('row_id', 5)} AS fold FROM om), kt AS (SELECT f, kd.* FROM kd, range(5) q(f) WHERE fold <> f), {GRID_SQL}, al AS ({GRID_ROWS})
SELECT alpha, {r('rmse', 3, 'cv_rmse')}, {r('r2', 8, 'q2')} FROM ({score_sql('al', 'alpha')})""")
def mdl10_ridge(spark, sf):
    t = models.grid_search(order_matrix(spark, sf), X, "y", "row_id", ALPHAS)
    return rounded(spark.createDataFrame([(x["alpha"], x["cv_rmse"], x["q2"]) for x in t], "alpha double, cv_rmse double, q2 double"), 3, q2=8)


@query("mdl10_tree_search")
def mdl10_trees(spark, sf):
    """Four settings drawn from a grid of eight for a forest, all four of a grid for randomised trees; place 1 is the best point."""
    d = lines(spark, sf)
    forest = models.tree_search(d, FEATS, "y", "row_id", {"maxDepth": [3, 6], "numTrees": [5, 15], "minInstancesPerNode": [1, 50]}, k=3, draws=4)[0]
    extra = models.tree_search(d, FEATS, "y", "row_id", {"depth": [3, 6], "trees": [20], "min_leaf": [1, 50]}, "extra", k=3)[0]
    rows = [(kind, i, s.get("maxDepth") or s["depth"], s.get("numTrees") or s["trees"], s.get("minInstancesPerNode") or s["min_leaf"], s["cv_rmse"])
            for kind, t in (("forest", forest), ("extra", extra)) for i, s in enumerate(t, 1)]
    return spark.createDataFrame(rows, "model string, place int, depth int, trees int, min_leaf int, cv_rmse double")


FARTHEST = 30
CUSTOMERS_SQL = """cm AS (SELECT c_custkey AS row_id, c_acctbal::DOUBLE AS x1, x2, x3, y FROM customer JOIN
 (SELECT o_custkey, count(*)::DOUBLE AS x2, avg(o_totalprice) AS y, avg(month(o_orderdate)) AS x3 FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""


def farthest_sql(k: int) -> str:
    """CTE ``picked`` (row_id): the greedy walk as a recursion over the table of distances to the picked rows."""
    z = ", ".join(f"(x{i} - (SELECT avg(x{i}) FROM cm)) / (SELECT stddev_pop(x{i}) FROM cm) AS z{i}" for i in (1, 2, 3))
    centre = ", ".join(f"first_value(z{i}) OVER w AS c{i}" for i in (1, 2, 3))
    gap = " + ".join(f"(z{i} - c{i}) * (z{i} - c{i})" for i in (1, 2, 3))
    return f"""zs AS (SELECT row_id, {z} FROM cm), rec AS (SELECT 1 AS step, row_id, z1, z2, z3, 'inf'::DOUBLE AS d FROM zs UNION ALL
 SELECT step + 1, row_id, z1, z2, z3, least(d, {gap}) FROM (SELECT *, {centre} FROM rec WHERE step < {k} WINDOW w AS (ORDER BY d DESC, row_id))),
picked AS (SELECT row_id FROM rec WHERE d > 0 QUALIFY row_number() OVER (PARTITION BY step ORDER BY d DESC, row_id) = 1)"""


@query("val6_farthest_holdout")
def val6(spark, sf):
    d = customer_matrix(spark, sf)
    ids = selection.farthest_first(d, ["x1", "x2", "x3"], "row_id", FARTHEST)
    _, s = validation.holdout(d, ["x1", "x2", "x3"], "y", "row_id", test_ids=ids)
    return validation.split_metrics(s, ["split"], "y")


@query("val6_farthest_two_columns", f"""WITH RECURSIVE {CUSTOMERS_SQL}, {farthest_sql(FARTHEST)}, d AS (SELECT *, CASE WHEN row_id IN (SELECT row_id FROM picked) THEN 'test' ELSE 'train' END AS split FROM cm),
{ridge_sql('m', 'd', where="split = 'train'")}, s AS (SELECT d.*, {PRED} AS p FROM d, m) SELECT split, n, {r('rmse', 4, 'rmse')}, {r('r2', 6, 'r2')}, {r('mae', 4, 'mae')} FROM ({score_sql('s', 'split')})""")
def val6_two(spark, sf):
    d = customer_matrix(spark, sf)
    ids = selection.farthest_first(d, ["x1", "x2", "x3"], "row_id", FARTHEST)
    _, s = validation.holdout(d, X, "y", "row_id", test_ids=ids)
    return rounded(validation.split_metrics(s, ["split"], "y").select("split", "n", "rmse", "r2", "mae"), 4, r2=6)


@query("sim12_farthest_first", f"WITH RECURSIVE {CUSTOMERS_SQL}, {farthest_sql(FARTHEST)} SELECT row_id FROM picked")
def sim12(spark, sf):
    return selection.farthest_first(customer_matrix(spark, sf), ["x1", "x2", "x3"], "row_id", FARTHEST)


@query("sim11_mahalanobis", f"""WITH {ORDERS_SQL}, c AS (SELECT avg(x1) AS m1, avg(x2) AS m2, var_samp(x1) AS v1, var_samp(x2) AS v2, covar_samp(x1, x2) AS c FROM om)
SELECT row_id, {r('sqrt(((x1 - m1) * (x1 - m1) * v2 - 2 * (x1 - m1) * (x2 - m2) * c + (x2 - m2) * (x2 - m2) * v1) / (v1 * v2 - c * c))', 6, 'mahalanobis')} FROM om, c""")
def sim11(spark, sf):
    return rounded(selection.mahalanobis(order_matrix(spark, sf), X).select("row_id", "mahalanobis"))


def wide_embeddings(spark, sf):
    n = len(table(spark, sf, "embeddings").first()["embedding"])
    return embeddings(spark, sf).select("vec_id", "label", *[F.get("v", F.lit(i)).alias(f"e{i}") for i in range(n)]), [f"e{i}" for i in range(n)]


@query("sim8_pca_map")
def sim8(spark, sf):
    d, cols = wide_embeddings(spark, sf)
    axes, _, g = models.principal_axes(d, cols, 2)
    return models.project(d, cols, axes, g.mean[:g.p]).select("vec_id", "pc1", "pc2")


@query("spc6_truncated_svd")
def spc6(spark, sf):
    d, cols = wide_embeddings(spark, sf)
    axes, _, _ = models.principal_axes(d, cols, 3, centred=False)
    return models.project(d, cols, axes, prefix="svd").select("vec_id", "svd1", "svd2", "svd3")


@query("spc10_column_families", "SELECT 'SPEC' AS family, CAST(2 AS BIGINT) AS columns, count(*) AS n FROM part UNION ALL SELECT 'MOL', 1, count(*) FROM part")
def spc10(spark, sf):
    d = table(spark, sf, "part").selectExpr("p_size AS SPEC_a", "p_retailprice AS SPEC_b", "p_size AS MOL_a", "p_name AS MOL_text")
    rows = [(p, len(bank.numeric_descriptor_columns(d, f"{p}_"))) for p in ("SPEC", "MOL")]
    fam = spark.createDataFrame(rows, "family string, columns bigint")
    from corvida.functions.frames import with_scalars
    return with_scalars(fam, d.agg(F.count("*").alias("n")))


@query("prd4_numeric_columns", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total, 'SPEC_a' AS columns FROM part")
def prd4(spark, sf):
    d = table(spark, sf, "part").selectExpr("CAST(p_size AS STRING) AS SPEC_a", "p_name AS SPEC_t", "p_size")
    return d.agg(F.count("*").alias("n"), F.sum("p_size").alias("total")).withColumn("columns", F.lit(", ".join(bank.numeric_descriptor_columns(d, "SPEC_"))))


@query("prd1_score_rows", f"""WITH {ORDERS_SQL}, {ridge_sql('m', 'om', where='nation < 20')}, c AS (SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22, covar_pop(x1, x2) * count(*) AS s12, min(x1) AS a1, max(x1) AS b1x, min(x2) AS a2, max(x2) AS b2x FROM om WHERE nation < 20)
SELECT row_id, {r(PRED, 2, 'prediction')}, {r('1.0 / n + ((x1 - m1) * (x1 - m1) * s22 - 2 * (x1 - m1) * (x2 - m2) * s12 + (x2 - m2) * (x2 - m2) * s11) / (s11 * s22 - s12 * s12)', 8, 'leverage')}, x1 BETWEEN a1 AND b1x AND x2 BETWEEN a2 AND b2x AS range_inside FROM om, m, c WHERE nation >= 20""")
def prd1(spark, sf):
    d = order_matrix(spark, sf)
    train = d.where("nation < 20")
    s = flows.score_rows(grams(train, X, "y")[()].ridge(1.0), {}, train, d.where("nation >= 20"))
    return rounded(s.select("row_id", "prediction", "leverage", "range_inside"), 2, leverage=8)


@query("prd2_model_package", f"""WITH {ORDERS_SQL}, {ridge_sql('m', 'om')} SELECT 'x1' AS descriptor, {r('b1', 4, 'coefficient')}, {r('(SELECT quantile_cont(x1, 0.5) FROM om)', 4, 'median')} FROM m UNION ALL SELECT 'x2', {r('b2', 4)}, {r('(SELECT quantile_cont(x2, 0.5) FROM om)', 4)} FROM m""")
def prd2(spark, sf):
    path, d = _scratch(spark), order_matrix(spark, sf)
    flows.save_package(grams(d, X, "y")[()].ridge(1.0), d, X, "y", path)
    return rounded(spark.read.parquet(f"{path}/model").select("descriptor", "coefficient", "median"), 4)


# Shuffles order the positions by the salted hash; a group of descriptors moves together.
POSITIONS_SQL = "ps AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM om)"
MOVED_SQL = f"""sh AS (SELECT k, s1 AS o1, s2 AS o2, row_number() OVER (PARTITION BY k ORDER BY {portable_hash_sql('pos', 'k + 5003')}) - 1 AS spot FROM ev, range(30) t(k)),
ch AS (SELECT k, res, s1 - o1 AS d1, s2 - o2 AS d2 FROM ev JOIN sh ON pos = spot),
rs AS (SELECT k, sqrt(avg((res + d1) * (res + d1))) - sqrt(avg(res * res)) AS r1, sqrt(avg((res + d2) * (res + d2))) - sqrt(avg(res * res)) AS r2, sqrt(avg((res + d1 + d2) * (res + d1 + d2))) - sqrt(avg(res * res)) AS r12 FROM ch GROUP BY k)"""
SHUFFLE_SQL = f"{ORDERS_SQL}, {ridge_sql('m', 'om')}, {POSITIONS_SQL}, ev AS (SELECT pos, y - ({PRED}) AS res, b1 * x1 AS s1, b2 * x2 AS s2 FROM ps, m), {MOVED_SQL}"


def rise_sql(name: str, column: str) -> str:
    return f"""SELECT '{name}' AS descriptor, {r(f'avg({column})', 3, 'importance_mean')}, {r(f'stddev_pop({column})', 3, 'importance_std')}, {r(f'avg(CASE WHEN {column} > 0 THEN 1.0 ELSE 0.0 END)', 3, 'positive_repeats_fraction')} FROM rs"""


@query("imp2_permutation_importance", f"WITH {SHUFFLE_SQL} {rise_sql('x1', 'r1')} UNION ALL {rise_sql('x2', 'r2')}")
def imp2(spark, sf):
    d = order_matrix(spark, sf)
    return rounded(importance.permutation_importance(d, grams(d, X, "y")[()].ridge(1.0), "y", "row_id"), 3)


# Trees with one cut add up column by column, so moving a column moves its trees' share.
FEW_STUMPS = 12
ORDER_STUMPS_SQL = f"""rg(f, lo, hi) AS (VALUES (0, (SELECT min(x1) FROM om), (SELECT max(x1) FROM om)), (1, (SELECT min(x2) FROM om), (SELECT max(x2) FROM om))), tr AS (SELECT unnest(range({FEW_STUMPS})) AS t),
cuts AS (SELECT t, f, lo + ({portable_hash_sql(f't * {extra_trees.TREE_STRIDE} + {extra_trees.NODE_STRIDE} + f')} + 0.5::DOUBLE) / {HASH_PRIME} * (hi - lo) AS cut FROM tr, rg),
sums AS ({' UNION ALL '.join(f"SELECT t, f, cut, count(*) FILTER (WHERE {c} <= cut) AS nl, sum(y) FILTER (WHERE {c} <= cut) AS sl, count(*) AS n, sum(y) AS s FROM om, cuts WHERE f = {j} GROUP BY t, f, cut" for j, c in enumerate(X))}),
stumps AS (SELECT t, f, cut, sl / nl AS le, (s - sl) / (n - nl) AS ri FROM sums WHERE nl > 0 AND nl < n QUALIFY row_number() OVER (PARTITION BY t ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC, f) = 1)"""
STUMP_SHARES_SQL = f"""{ORDERS_SQL}, {ORDER_STUMPS_SQL}, {POSITIONS_SQL},
e0 AS (SELECT pos, any_value(y) AS y, coalesce(sum(CASE WHEN x1 <= cut THEN le ELSE ri END) FILTER (WHERE f = 0), 0) / {FEW_STUMPS} AS s1, coalesce(sum(CASE WHEN x2 <= cut THEN le ELSE ri END) FILTER (WHERE f = 1), 0) / {FEW_STUMPS} AS s2 FROM ps, stumps GROUP BY pos),
ev AS (SELECT pos, y - s1 - s2 AS res, s1, s2 FROM e0), {MOVED_SQL}"""


def stump_importance(spark, sf, groups):
    d = order_matrix(spark, sf)
    m = models.fit_tree(d, X, "y", "extra", trees=FEW_STUMPS, depth=1)[0]
    return rounded(importance.model_permutation_importance(d, m.predict, X, "y", "row_id", groups=groups), 3)


@query("imp2_tree_permutation", f"WITH {STUMP_SHARES_SQL} {rise_sql('x1', 'r1')} UNION ALL {rise_sql('x2', 'r2')}")
def imp2_trees(spark, sf):
    return stump_importance(spark, sf, None)


@query("imp4_tree_grouped_permutation", f"WITH {STUMP_SHARES_SQL} {rise_sql('both', 'r12')} UNION ALL {rise_sql('second', 'r2')}")
def imp4_trees(spark, sf):
    return stump_importance(spark, sf, {"both": X, "second": ["x2"]})


RANK_SQL = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {n}" for c, n in (("x1", "ra"), ("x1 * x1", "rb"), ("x5", "rc")))


@query("imp3_correlated_groups", f"""WITH {LINES_SQL}, rk AS (SELECT {RANK_SQL} FROM lines), co AS (SELECT abs(corr(ra, rb)) >= 0.9 AS ab, abs(corr(ra, rc)) >= 0.9 AS ac, abs(corr(rb, rc)) >= 0.9 AS bc FROM rk)
SELECT unnest(CASE WHEN (ab AND ac) OR (ab AND bc) OR (ac AND bc) THEN ['x1, x1b, x5'] WHEN ab THEN ['x1, x1b', 'x5'] WHEN ac THEN ['x1, x5', 'x1b'] WHEN bc THEN ['x1', 'x1b, x5'] ELSE ['x1', 'x1b', 'x5'] END) AS members FROM co""")
def imp3(spark, sf):
    d = lines(spark, sf).withColumn("x1b", F.col("x1") * F.col("x1"))
    return spark.createDataFrame([(", ".join(g),) for g in importance.correlation_groups(d, ["x1", "x5", "x1b"], "row_id")], "members string")


@query("imp4_grouped_permutation", f"WITH {SHUFFLE_SQL} {rise_sql('g1', 'r12')} UNION ALL {rise_sql('g2', 'r2')}")
def imp4(spark, sf):
    d = order_matrix(spark, sf)
    return rounded(importance.permutation_importance(d, grams(d, X, "y")[()].ridge(1.0), "y", "row_id", groups={"g1": ["x1", "x2"], "g2": ["x2"]}), 3)


IMP_SQL = f"""{ridge_sql('m', 'lines')}, co AS (SELECT unnest(['x1', 'x2']) AS descriptor, unnest([abs(b1), abs(b2)]) AS c FROM m), lin AS (SELECT 'x1' AS descriptor, avg(abs(b1 * (x1 - mu))) AS s FROM lines, m, (SELECT avg(x1) AS mu FROM lines) UNION ALL SELECT 'x2', avg(abs(b2 * (x2 - mu))) FROM lines, m, (SELECT avg(x2) AS mu FROM lines)),
sc AS (SELECT descriptor, c / (SELECT max(c) FROM co) AS cs, s / (SELECT max(s) FROM lin) AS ss FROM co FULL JOIN lin USING (descriptor))"""


@query("imp5_unified_table", f"WITH {LINES_SQL}, {IMP_SQL} SELECT descriptor, {r('cs', 6, 'coefficient_score')}, {r('ss', 6, 'shap_score')}, 2 AS methods_available, {r('(cs + ss) / 2', 6, 'combined_score')}, CAST(rank() OVER (ORDER BY (cs + ss) / 2 DESC) AS INTEGER) AS combined_rank, 'not_evaluated' AS stability_status FROM sc")
def imp5(spark, sf):
    d = lines(spark, sf)
    m = grams(d, X, "y")[()].ridge(1.0)
    return rounded(importance.unified_table(coefficient=importance.coefficient_table(spark, m), attribution=importance.linear_attribution(d, m)))


@query("imp6_linear_attribution", f"WITH {LINES_SQL}, {ridge_sql('m', 'lines')}, u AS (SELECT avg(x1) AS u1, avg(x2) AS u2 FROM lines) SELECT 'x1' AS descriptor, {r('avg(abs(b1 * (x1 - u1)))', 4, 'mean_abs_phi')}, {r('stddev_samp(b1 * (x1 - u1))', 4, 'std_phi')} FROM lines, m, u UNION ALL SELECT 'x2', {r('avg(abs(b2 * (x2 - u2)))', 4)}, {r('stddev_samp(b2 * (x2 - u2))', 4)} FROM lines, m, u")
def imp6(spark, sf):
    d = lines(spark, sf)
    return rounded(importance.linear_attribution(d, grams(d, X, "y")[()].ridge(1.0)).select("descriptor", "mean_abs_phi", "std_phi"), 4)


# Model leaderboard: one "model" per brand from its own part statistics.
LB = "SELECT p_brand AS model, CAST(ntile(5) OVER (ORDER BY count(*), p_brand) AS BIGINT) AS rating, CASE WHEN count(*) % 3 > 0 THEN avg(p_size) END AS kfold_q2, max(p_retailprice) AS loo_q2, min(p_retailprice) AS holdout_r2 FROM part GROUP BY 1"


@query("top5_leaderboard", f"WITH b AS ({LB}) SELECT model, CAST(row_number() OVER (ORDER BY rating, kfold_q2 DESC NULLS LAST, loo_q2 DESC, holdout_r2 DESC, model) AS INTEGER) AS place, CAST(CASE WHEN model < 'Brand#2' THEN rating END AS BIGINT) AS yrand FROM b")
def top5(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("corvida_part")
    b = spark.sql(LB.replace("FROM part", "FROM corvida_part"))
    return models.leaderboard(b, yrand=b.where("model < 'Brand#2'").select("model", F.col("rating").alias("yrand"))).select("model", "place", "yrand")


QUALITY = "CASE WHEN r2 >= 0.85 THEN 'excellent' WHEN r2 >= 0.70 THEN 'good' WHEN r2 >= 0.50 THEN 'acceptable' ELSE 'weak' END"
METHODS_SQL = f"""{ridge_sql('ma', 'om', alpha=0.0)}, hd AS (SELECT *, {portable_hash_sql('row_id')} < {int(0.2 * HASH_PRIME)} AS t FROM om), {ridge_sql('mb', 'hd', where='NOT t', alpha=0.0)},
kd AS (SELECT *, {fold_sql('row_id', 5)} AS fold FROM om), kt AS (SELECT f, kd.* FROM kd, range(5) q(f) WHERE fold <> f), {ridge_sql('mc', 'kt', 'f', alpha=0.0)},
lc AS (SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22, covar_pop(x1, x2) * count(*) AS s12 FROM om),
lo AS (SELECT y, y - ({PRED}) AS e, 1.0 / n + ((x1 - m1) * (x1 - m1) * s22 - 2 * (x1 - m1) * (x2 - m2) * s12 + (x2 - m2) * (x2 - m2) * s11) / (s11 * s22 - s12 * s12) AS h FROM om, ma, lc),
al AS (SELECT 'training' AS method, y, {PRED} AS p FROM om, ma UNION ALL SELECT 'hold_out', y, {PRED} FROM hd, mb WHERE t UNION ALL SELECT 'k_fold', y, {PRED} FROM kd JOIN mc ON f = fold UNION ALL SELECT 'leave_one_out', y, y - e / (1 - h) FROM lo),
sg AS ({score_sql('al', 'method')}),
rp AS (SELECT *, {fold_sql('row_id', 5, 'rep')} AS fold FROM om, range(5) t(rep)), rt AS (SELECT f, rp.* FROM rp, range(5) q(f) WHERE fold <> f), {ridge_sql('md', 'rt', 'rep, f', alpha=0.0)},
rk AS (SELECT rp.*, {PRED} AS p FROM rp JOIN md ON md.rep = rp.rep AND md.f = rp.fold), sk AS ({score_sql('rk', 'rep, fold')}),
rh AS (SELECT *, {portable_hash_sql('row_id', 'rep')} < {int(0.2 * HASH_PRIME)} AS t FROM om, range(5) q(rep)), {ridge_sql('me', 'rh', 'rep', 'NOT t', alpha=0.0)}, hp AS (SELECT rh.*, {PRED} AS p FROM rh JOIN me USING (rep) WHERE t), sh AS ({score_sql('hp', 'rep')}),
bw AS (SELECT om.*, b, {poisson_weight_sql(portable_hash_sql('row_id', 'b'))} AS w FROM om, range(50) q(b)), {ridge_sql('mf', 'bw', 'b', 'w > 0', w='w', alpha=0.0)}, bp AS (SELECT bw.*, {PRED} AS p FROM bw JOIN mf USING (b) WHERE w = 0), sb AS ({score_sql('bp', 'b')}),
mt AS (SELECT method, r2, rmse, mae, NULL::DOUBLE AS r2_std FROM sg UNION ALL SELECT 'repeated_k_fold', avg(r2), avg(rmse), avg(mae), stddev_samp(r2) FROM sk
 UNION ALL SELECT 'repeated_hold_out', avg(r2), avg(rmse), NULL, stddev_samp(r2) FROM sh UNION ALL SELECT 'bootstrap_oob', avg(r2), avg(rmse), NULL, stddev_samp(r2) FROM sb)"""


@query("agg34_validation_table", f"WITH {ORDERS_SQL}, {METHODS_SQL} SELECT method, {r('r2', 5, 'r2')}, {r('rmse', 2, 'rmse')}, {r('mae', 2, 'mae')}, {r('r2_std', 5, 'r2_std')}, {QUALITY} AS quality FROM mt")
def agg34(spark, sf):
    return rounded(validation.validation_table(order_matrix(spark, sf), X, "y", "row_id", alpha=0.0), 2, r2=5, r2_std=5)


@query("join19_importance_outer_merge", f"WITH {LINES_SQL}, {IMP_SQL} SELECT descriptor, {r('c / (SELECT max(c) FROM co)', 6, 'coefficient_score')}, CASE WHEN descriptor = 'x2' THEN 1.0::DOUBLE END AS shap_score, CASE WHEN descriptor = 'x2' THEN 2 ELSE 1 END AS methods_available FROM co")
def join19(spark, sf):
    d = lines(spark, sf)
    m = grams(d, X, "y")[()].ridge(1.0)
    t = importance.unified_table(coefficient=importance.coefficient_table(spark, m), attribution=importance.linear_attribution(d, m).where("descriptor = 'x2'"))
    return rounded(t.select("descriptor", "coefficient_score", "shap_score", "methods_available"))


@query("win12_combined_rank", f"WITH {LINES_SQL}, {IMP_SQL} SELECT descriptor, CAST(rank() OVER (ORDER BY (cs + ss) / 2 DESC) AS INTEGER) AS combined_rank FROM sc")
def win12(spark, sf):
    d = lines(spark, sf)
    m = grams(d, X, "y")[()].ridge(1.0)
    return importance.unified_table(coefficient=importance.coefficient_table(spark, m), attribution=importance.linear_attribution(d, m)).select("descriptor", "combined_rank")
