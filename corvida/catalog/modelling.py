"""Model, validation, domain and uncertainty queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvida.catalog.registry import LINES_SQL, ORDERS_SQL, fold_sql, lines, order_matrix, query, r, rounded, table
from corvida.functions.columns import HASH_PRIME, poisson_weight_sql, portable_hash, portable_hash_sql, portable_text_hash_sql
from corvida.operators import domain, errors, knn, stats, uncertainty, validation
from corvida.operators.gram import grams

X = ["x1", "x2"]


def ridge_sql(name: str, frm: str, keys: str = "", where: str = "TRUE", alpha: float = 1.0, w: str | None = None) -> str:
    """CTE with the coefficients (b0, b1, b2) of a two-column ridge on standardised columns, per key."""
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    if w is None:
        m = f"""SELECT {k} count(*)::DOUBLE AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM {frm} WHERE {where} {g}"""
    else:
        raw = f"SELECT {k} sum({w})::DOUBLE AS n, sum({w}*x1)/sum({w}) AS m1, sum({w}*x2)/sum({w}) AS m2, sum({w}*y)/sum({w}) AS my, sum({w}*x1*x1)/sum({w}) AS q1, sum({w}*x2*x2)/sum({w}) AS q2, sum({w}*x1*x2)/sum({w}) AS q12, sum({w}*x1*y)/sum({w}) AS p1, sum({w}*x2*y)/sum({w}) AS p2 FROM {frm} WHERE {where} {g}"
        m = f"SELECT {k} n, m1, m2, my, q1-m1*m1 AS v1, q2-m2*m2 AS v2, q12-m1*m2 AS c12, p1-m1*my AS c1, p2-m2*my AS c2 FROM ({raw})"
    kk = f"{keys}, " if keys else ""
    return f"""{name}0 AS ({m}), {name}1 AS (SELECT *, n + {alpha} AS aa, n * c12 / sqrt(v1 * v2) AS ab, n * c1 / sqrt(v1) AS z1, n * c2 / sqrt(v2) AS z2 FROM {name}0),
{name}2 AS (SELECT *, (z1 * aa - ab * z2) / (aa * aa - ab * ab) / sqrt(v1) AS b1, (aa * z2 - ab * z1) / (aa * aa - ab * ab) / sqrt(v2) AS b2 FROM {name}1),
{name} AS (SELECT {kk} b1, b2, my - m1 * b1 - m2 * b2 AS b0 FROM {name}2)"""


PRED = "b0 + b1 * x1 + b2 * x2"


def score_sql(frm, keys="", p="p"):
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"SELECT {k} count(*) AS n, sqrt(avg((y - {p}) * (y - {p}))) AS rmse, 1 - sum((y - {p}) * (y - {p})) / (var_pop(y) * count(*)) AS r2, avg(abs(y - {p})) AS mae FROM {frm} {g}"


FLAGSHIP_FLAGS = {"group_small_lot": "x1 < 10", "group_discounted": "x2 >= 0.05", "group_returned": "l_returnflag = 'R'", "group_open": "l_linestatus = 'O'"}
KF_SQL = f"""dd AS (SELECT *, {fold_sql('row_id', 5)} AS fold FROM {{t}}), ff AS (SELECT unnest(range(5)) AS f), tr AS (SELECT f, dd.* FROM ff JOIN dd ON fold <> f),
{ridge_sql('md', 'tr', 'f')}, oof AS (SELECT dd.*, {PRED} AS p FROM dd JOIN md ON f = fold)"""
MEM = "SELECT 'overall' AS group_id, e FROM er" + "".join(f" UNION ALL SELECT '{k}', e FROM er WHERE {v}" for k, v in FLAGSHIP_FLAGS.items())


@query("flagship_error_profile", f"""WITH {LINES_SQL}, {KF_SQL.format(t='lines')}, er AS (SELECT *, p - y AS e FROM oof), ov AS (SELECT avg(abs(e)) AS om FROM er), mem AS ({MEM})
SELECT group_id, count(*) AS n, {r('avg(abs(e))', 4, 'mae')}, {r('sqrt(avg(e*e))', 4, 'rmse')}, {r('avg(e)', 4, 'bias')}, {r('quantile_cont(abs(e), 0.5)', 4, 'median_ae')}, {r('max(abs(e))', 4, 'max_ae')},
 {r('avg(CASE WHEN abs(e) >= 2 * om THEN 1.0 ELSE 0.0 END)', 4, 'large_error_fraction')}, {r('(avg(abs(e)) / any_value(om) - 1) * 100', 4, 'mae_vs_overall_percent')}, CASE WHEN count(*) >= 10 THEN 'adequate' ELSE 'small_group' END AS reliability FROM mem, ov GROUP BY 1""")
def flagship(spark, sf):
    d, _ = validation.kfold(lines(spark, sf), X, "y", "row_id")
    d = d.withColumns({k: F.expr(v) for k, v in FLAGSHIP_FLAGS.items()}).withColumn("error", F.col("y_pred") - F.col("y"))
    return rounded(errors.group_summary(d, list(FLAGSHIP_FLAGS)), 4)


@query("mdl1_ridge_and_ols", f"""WITH {LINES_SQL}, {ridge_sql('a', 'lines')}, {ridge_sql('o', 'lines', alpha=0.0)} SELECT 'ridge' AS model, {r('b0', 4, 'intercept')}, {r('b1', 4, 'x1')}, {r('b2', 4, 'x2')} FROM a
UNION ALL SELECT 'ols', {r('b0', 4, 'intercept')}, {r('b1', 4, 'x1')}, {r('b2', 4, 'x2')} FROM o""")
def mdl1(spark, sf):
    from corvida.operators.models import model_table
    g = grams(lines(spark, sf), X, "y")[()]
    return rounded(model_table(spark, {"ridge": g.ridge(1.0), "ols": g.ridge(0.0)}), 4)


@query("imp1_coefficients", f"""WITH {LINES_SQL}, {ridge_sql('a', 'lines')} SELECT 'x1' AS descriptor, {r('b1', 4, 'coefficient')}, {r('abs(b1)', 4, 'absolute_importance')}, 'coefficient' AS method FROM a
UNION ALL SELECT 'x2', {r('b2', 4, 'coefficient')}, {r('abs(b2)', 4, 'absolute_importance')}, 'coefficient' FROM a""")
def imp1(spark, sf):
    from corvida.operators.importance import coefficient_table
    return rounded(coefficient_table(spark, grams(lines(spark, sf), X, "y")[()].ridge(1.0)), 4)


@query("val1_holdout", f"""WITH {LINES_SQL}, d AS (SELECT *, CASE WHEN {portable_hash_sql('row_id')} < {int(0.2 * HASH_PRIME)} THEN 'test' ELSE 'train' END AS split FROM lines), {ridge_sql('m', 'd', where="split = 'train'")},
s AS (SELECT d.*, {PRED} AS p FROM d, m) SELECT split, n, {r('rmse', 4, 'rmse')}, {r('r2', 6, 'r2')}, {r('mae', 4, 'mae')} FROM ({score_sql('s', 'split')})""")
def val1(spark, sf):
    _, s = validation.holdout(lines(spark, sf), X, "y", "row_id")
    return rounded(validation.split_metrics(s, ["split"], "y").select("split", "n", "rmse", "r2", "mae"), 4, r2=6)


@query("val1_holdout_listed", f"""WITH {ORDERS_SQL}, d AS (SELECT *, CASE WHEN row_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 45) THEN 'test' ELSE 'train' END AS split FROM om), {ridge_sql('m', 'd', where="split = 'train'")},
s AS (SELECT d.*, {PRED} AS p FROM d, m) SELECT split, n, {r('rmse', 4, 'rmse')}, {r('r2', 6, 'r2')}, {r('mae', 4, 'mae')} FROM ({score_sql('s', 'split')})""")
def val1_listed(spark, sf):
    ids = table(spark, sf, "lineitem").where("l_returnflag = 'N' AND l_quantity > 45").select(F.col("l_orderkey").alias("row_id"))
    _, s = validation.holdout(order_matrix(spark, sf), X, "y", "row_id", test_ids=ids)
    return rounded(validation.split_metrics(s, ["split"], "y").select("split", "n", "rmse", "r2", "mae"), 4, r2=6)


@query("val2_kfold", f"WITH {LINES_SQL}, {KF_SQL.format(t='lines')} SELECT fold, n, {r('rmse', 4, 'rmse')}, {r('r2', 6, 'r2')}, {r('mae', 4, 'mae')} FROM ({score_sql('oof', 'fold')})")
def val2(spark, sf):
    d, _ = validation.kfold(lines(spark, sf), X, "y", "row_id")
    return rounded(validation.split_metrics(d.withColumn("fold", F.col("fold").cast("bigint")), ["fold"], "y").select("fold", "n", "rmse", "r2", "mae"), 4, r2=6)


@query("unc1_oof_predictions", f"WITH {ORDERS_SQL}, {KF_SQL.format(t='om')} SELECT row_id, {r('p', 2, 'y_pred')} FROM oof")
def unc1(spark, sf):
    return rounded(validation.kfold(order_matrix(spark, sf), X, "y", "row_id")[0].select("row_id", "y_pred"), 2)


RK_SQL = f"""rp AS (SELECT *, {fold_sql('row_id', 5, 'rep')} AS fold FROM om, range(5) t(rep)), tr AS (SELECT f, rp.* FROM rp, range(5) q(f) WHERE fold <> f), {ridge_sql('md', 'tr', 'rep, f')},
sc AS (SELECT rp.*, {PRED} AS p FROM rp JOIN md ON md.rep = rp.rep AND md.f = rp.fold)"""


@query("val3_repeated_kfold", f"WITH {ORDERS_SQL}, {RK_SQL} SELECT CAST(rep AS INTEGER) AS repeat, CAST(fold AS INTEGER) AS fold, n, {r('rmse', 4, 'rmse')}, {r('r2', 6, 'r2')}, {r('mae', 4, 'mae')} FROM ({score_sql('sc', 'rep, fold')})")
def val3(spark, sf):
    d = validation.repeated_kfold(order_matrix(spark, sf), X, "y", "row_id")
    return rounded(validation.split_metrics(d, ["repeat", "fold"], "y").select("repeat", "fold", "n", "rmse", "r2", "mae"), 4, r2=6)


@query("agg31_validation_summary", f"""WITH {ORDERS_SQL}, {RK_SQL}, s AS ({score_sql('sc', 'rep, fold')}), u AS (SELECT unnest(['rmse', 'mae']) AS metric, unnest([rmse, mae]) AS v FROM s)
SELECT metric, {r('avg(v)', 4, 'mean')}, {r('stddev_samp(v)', 4, 'std')}, {r('min(v)', 4, 'min')}, {r('max(v)', 4, 'max')} FROM u GROUP BY 1""")
def agg31(spark, sf):
    d = validation.repeated_kfold(order_matrix(spark, sf), X, "y", "row_id")
    return rounded(validation.metric_summary(validation.split_metrics(d, ["repeat", "fold"], "y"), ["rmse", "mae"]), 4)


@query("val3_mean_predictions", f"WITH {ORDERS_SQL}, {RK_SQL} SELECT row_id, count(*) AS prediction_count, {r('avg(p)', 2, 'y_pred')} FROM sc GROUP BY 1")
def val3_mean(spark, sf):
    d = validation.repeated_kfold(order_matrix(spark, sf), X, "y", "row_id")
    return rounded(validation.mean_prediction(d, "row_id", "y").select("row_id", "prediction_count", "y_pred"), 2)


@query("val4_leave_one_out", f"""WITH {LINES_SQL}, c AS (SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22, covar_pop(x1, x2) * count(*) AS s12 FROM lines), {ridge_sql('o', 'lines', alpha=0.0)},
h AS (SELECT y, y - ({PRED}) AS e, 1.0 / n + ((x1 - m1) * (x1 - m1) * s22 - 2 * (x1 - m1) * (x2 - m2) * s12 + (x2 - m2) * (x2 - m2) * s11) / (s11 * s22 - s12 * s12) AS h FROM lines, o, c)
SELECT count(*) AS n, {r('sqrt(avg((e / (1 - h)) * (e / (1 - h))))', 3, 'rmse')}, {r('1 - sum((e / (1 - h)) * (e / (1 - h))) / (var_pop(y) * count(*))', 6, 'q2')} FROM h""")
def val4(spark, sf):
    d = validation.leave_one_out(lines(spark, sf), X, "y", alpha=0.0)
    return rounded(stats.regression_metrics(d, []).select("n", "rmse", F.col("r2").alias("q2")), 6, rmse=3)


@query("val5_group_holdout", f"""WITH {ORDERS_SQL}, d AS (SELECT *, CASE WHEN {portable_hash_sql('CAST(nation AS BIGINT)')} < {int(0.3 * HASH_PRIME)} THEN 'test' ELSE 'train' END AS split FROM om), {ridge_sql('m', 'd', where="split = 'train'")},
s AS (SELECT d.*, {PRED} AS p FROM d, m) SELECT split, n, {r('rmse', 4, 'rmse')}, {r('r2', 6, 'r2')}, {r('mae', 4, 'mae')} FROM ({score_sql('s', 'split')})""")
def val5(spark, sf):
    _, s = validation.group_holdout(order_matrix(spark, sf), X, "y", portable_hash("nation"), 0.3)
    return rounded(validation.split_metrics(s, ["split"], "y").select("split", "n", "rmse", "r2", "mae"), 4, r2=6)


LABEL_SQL = "CASE WHEN nation = 7 THEN 'invalid::' || row_id WHEN nation < 3 THEN 'acyclic::' || row_id ELSE segment || ' ' || nation END"
SCAFFOLD_SQL = f"""{ORDERS_SQL}, d0 AS (SELECT *, {LABEL_SQL} AS grp FROM om), d AS (SELECT *, CASE WHEN {portable_text_hash_sql('grp')} < {int(0.2 * HASH_PRIME)} THEN 'test' ELSE 'train' END AS split FROM d0)"""


def _scaffold_split(spark, sf):
    d = order_matrix(spark, sf).withColumn("scaffold", F.when(F.col("nation") < 3, " ").otherwise(F.concat_ws(" ", "segment", "nation")))
    return validation.scaffold_holdout(d, X, "y", "scaffold", "row_id", F.col("nation") != 7)[1]


@query("val5_scaffold_holdout", f"""WITH {SCAFFOLD_SQL}, {ridge_sql('m', 'd', where="split = 'train'")}, s AS (SELECT d.*, {PRED} AS p FROM d, m),
g AS (SELECT split, count(DISTINCT grp) AS groups FROM d GROUP BY 1) SELECT split, n, groups, {r('rmse', 4, 'rmse')}, {r('r2', 6, 'r2')}, {r('mae', 4, 'mae')} FROM ({score_sql('s', 'split')}) JOIN g USING (split)""")
def val5_scaffold(spark, sf):
    s = _scaffold_split(spark, sf)
    groups = s.groupBy("split").agg(F.count_distinct("group").alias("groups"))
    return rounded(validation.split_metrics(s, ["split"], "y").join(groups, "split").select("split", "n", "groups", "rmse", "r2", "mae"), 4, r2=6)


@query("val5_leaking_groups", f"""WITH {SCAFFOLD_SQL} SELECT segment, CAST(2 AS BIGINT) AS sides FROM d GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def val5_leaks(spark, sf):
    """Segments span several scaffolds, so they stand on both sides; scaffolds themselves do not (added here, none expected)."""
    s = _scaffold_split(spark, sf)
    return validation.leaking_groups(s, "segment").unionByName(validation.leaking_groups(s, "group").withColumnRenamed("group", "segment"))


@query("sim10_scaffold_label", """SELECT CASE WHEN p_size = 1 THEN 'invalid::' || p_partkey WHEN p_type = 'SMALL' THEN 'acyclic::' || p_partkey ELSE p_type END AS label, count(*) AS n FROM part GROUP BY 1""")
def sim10(spark, sf):
    d = table(spark, sf, "part").withColumn("scaffold", F.when(F.col("p_type") == "SMALL", " ").otherwise(F.col("p_type")))
    return d.groupBy(validation.scaffold_label("scaffold", "p_partkey", F.col("p_size") != 1).alias("label")).agg(F.count("*").alias("n"))


LC_SQL = f"""dd AS (SELECT *, {fold_sql('row_id', 5)} AS fold, CAST(floor({portable_hash_sql('row_id', 777)}::DOUBLE / {HASH_PRIME} * 5) AS INTEGER) AS part FROM om), tr AS (SELECT f, sz, dd.* FROM dd, range(5) a(f), range(1, 6) b(sz) WHERE fold <> f AND part < sz),
{ridge_sql('md', 'tr', 'f, sz')}, st AS ({score_sql('(SELECT tr.*, ' + PRED + ' AS p FROM tr JOIN md USING (f, sz))', 'f, sz')}), sv AS ({score_sql('(SELECT f, sz, dd.*, ' + PRED + ' AS p FROM dd JOIN md ON f = fold)', 'f, sz')})"""


@query("val7_learning_curve", f"""WITH {ORDERS_SQL}, {LC_SQL} SELECT sz AS part, {r('avg(st.n)', 4, 'train_size')}, {r('avg(st.rmse)', 3, 'train_rmse_mean')}, {r('stddev_samp(st.rmse)', 3, 'train_rmse_std')}, {r('avg(st.r2)', 6, 'train_r2_mean')}, {r('stddev_samp(st.r2)', 6, 'train_r2_std')},
 {r('avg(sv.rmse)', 3, 'cv_rmse_mean')}, {r('stddev_samp(sv.rmse)', 3, 'cv_rmse_std')}, {r('avg(sv.r2)', 6, 'cv_r2_mean')}, {r('stddev_samp(sv.r2)', 6, 'cv_r2_std')} FROM st JOIN sv USING (f, sz) GROUP BY sz""")
def val7(spark, sf):
    t = validation.learning_curve(order_matrix(spark, sf), X, "y", "row_id")
    return rounded(spark.createDataFrame(t), 6, train_size=4, train_rmse_mean=3, train_rmse_std=3, cv_rmse_mean=3, cv_rmse_std=3)


@query("val9_repeated_holdout", f"""WITH {ORDERS_SQL}, d AS (SELECT *, {portable_hash_sql('row_id', 'rep')} < {int(0.2 * HASH_PRIME)} AS t FROM om, range(10) q(rep)), {ridge_sql('m', 'd', 'rep', 'NOT t')},
s AS (SELECT d.*, {PRED} AS p FROM d JOIN m USING (rep) WHERE t) SELECT rep AS repeat, n, {r('rmse', 3, 'rmse')}, {r('r2', 6, 'r2')} FROM ({score_sql('s', 'rep')})""")
def val9(spark, sf):
    return rounded(spark.createDataFrame(validation.repeated_holdout(order_matrix(spark, sf), X, "y", "row_id")).select("repeat", "n", "rmse", "r2"), 6, rmse=3)


@query("val10_bootstrap_oob", f"""WITH {ORDERS_SQL}, d AS (SELECT om.*, b, {poisson_weight_sql(portable_hash_sql('row_id', 'b'))} AS w FROM om, range(50) q(b)), {ridge_sql('m', 'd', 'b', 'w > 0', w='w')},
s AS (SELECT d.*, {PRED} AS p FROM d JOIN m USING (b) WHERE w = 0) SELECT b AS replicate, n, {r('rmse', 3, 'rmse')}, {r('r2', 5, 'r2')} FROM ({score_sql('s', 'b')})""")
def val10(spark, sf):
    return rounded(spark.createDataFrame(validation.bootstrap_oob(order_matrix(spark, sf), X, "y", "row_id")).select("replicate", "n", "rmse", "r2"), 5, rmse=3)


@query("val11_y_randomization", f"""WITH {ORDERS_SQL}, ps AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM om),
sh AS (SELECT k, y AS yk, row_number() OVER (PARTITION BY k ORDER BY {portable_hash_sql('pos', 'k + 5003')}) - 1 AS spot FROM ps, range(20) t(k)),
dd AS (SELECT -1 AS k, row_id, x1, x2, y, {fold_sql('row_id', 5)} AS fold FROM ps UNION ALL SELECT k, row_id, x1, x2, yk, {fold_sql('row_id', 5)} FROM ps JOIN sh ON pos = spot),
tr AS (SELECT f, dd.* FROM dd, range(5) q(f) WHERE fold <> f), {ridge_sql('md', 'tr', 'k, f')},
oof AS (SELECT dd.k, y, {PRED} AS p FROM dd JOIN md ON md.k = dd.k AND md.f = dd.fold), sc AS (SELECT k, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS q FROM oof GROUP BY k),
re AS (SELECT q AS q2 FROM sc WHERE k = -1)
SELECT {r('any_value(q2)', 6, 'q2')}, {r('avg(q)', 6, 'permuted_mean')}, {r('max(q)', 6, 'permuted_max')}, {r('(1 + count(*) FILTER (WHERE q >= q2)) / 21.0', 6, 'p_value')} FROM sc, re WHERE k >= 0""")
def val11(spark, sf):
    res = validation.y_randomization(order_matrix(spark, sf), X, "y", "row_id", permutations=20)
    return rounded(spark.createDataFrame([(res["q2"], res["permuted_mean"], res["permuted_max"], res["p_value"])], "q2 double, permuted_mean double, permuted_max double, p_value double"))




@query("unc2_conformal_interval", f"""WITH {ORDERS_SQL}, {KF_SQL.format(t='om')}, rk AS (SELECT abs(p - y) AS a, row_number() OVER (ORDER BY abs(p - y)) - 1 AS i, count(*) OVER () AS n FROM oof), q AS (SELECT a AS radius FROM rk WHERE i = CAST(ceil(round((n - 1) * ceil((n + 1) * 0.9) / n, 9)) AS BIGINT))
SELECT fold, count(*) AS n, {r('any_value(radius)', 3, 'radius')}, count(*) FILTER (abs(p - y) <= radius) AS covered FROM oof, q GROUP BY 1""")
def unc2(spark, sf):
    oof, _ = validation.kfold(order_matrix(spark, sf), X, "y", "row_id")
    radius = validation.conformal_radius(oof, F.col("y_pred") - F.col("y"), 0.1)
    a = F.abs(F.col("y_pred") - F.col("y"))
    return rounded(oof.groupBy(F.col("fold").cast("bigint").alias("fold")).agg(F.count("*").alias("n"), F.lit(radius).alias("radius"), F.count_if(a <= radius + 1e-6).alias("covered")), 3)


@query("val8_interval_coverage", f"""WITH {ORDERS_SQL}, s0 AS (SELECT *, {portable_hash_sql('row_id')} < {int(0.2 * HASH_PRIME)} AS t FROM om), {ridge_sql('m', 's0', where='NOT t')}, te AS (SELECT s0.*, {PRED} AS p FROM s0, m WHERE t),
dd AS (SELECT *, {fold_sql('row_id', 5, 1)} AS fold FROM s0 WHERE NOT t), tr AS (SELECT f, dd.* FROM dd, range(5) q(f) WHERE fold <> f), {ridge_sql('md', 'tr', 'f')}, oof AS (SELECT dd.*, {PRED} AS p FROM dd JOIN md ON f = fold),
rk AS (SELECT abs(p - y) AS a, row_number() OVER (ORDER BY abs(p - y)) - 1 AS i, count(*) OVER () AS n FROM oof), q AS (SELECT a AS radius FROM rk WHERE i = CAST(ceil(round((n - 1) * ceil((n + 1) * 0.9) / n, 9)) AS BIGINT))
SELECT count(*) AS n, {r('any_value(radius)', 3, 'radius')}, {r('avg(CASE WHEN abs(p - y) <= radius THEN 1.0 ELSE 0.0 END)', 6, 'coverage')}, {r('avg(CASE WHEN abs(p - y) <= radius THEN 1.0 ELSE 0.0 END) - 0.9', 6, 'coverage_gap')} FROM te, q""")
def val8(spark, sf):
    radius, t = validation.interval_coverage(order_matrix(spark, sf), X, "y", "row_id")
    cov = F.avg(F.when(F.col("inside"), 1.0).otherwise(0.0))
    return rounded(t.agg(F.count("*").alias("n"), F.lit(radius).alias("radius"), cov.alias("coverage"), (cov - 0.9).alias("coverage_gap")), 6, radius=3)


LEV_SQL = f"""c AS (SELECT count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22, covar_pop(x1, x2) * count(*) AS s12 FROM om),
hh AS (SELECT om.*, 1.0 / n + ((x1 - m1) * (x1 - m1) * s22 - 2 * (x1 - m1) * (x2 - m2) * s12 + (x2 - m2) * (x2 - m2) * s11) / (s11 * s22 - s12 * s12) AS h, 9.0 / n AS lim FROM om, c)"""


def order_leverage(spark, sf):
    d = order_matrix(spark, sf)
    g = domain.fit(d, X, "y")
    return domain.leverage(d, X, g).withColumn("y_pred", g.ridge(1.0).column())


@query("ad1_leverage", f"WITH {ORDERS_SQL}, {LEV_SQL} SELECT row_id, {r('h', 9, 'leverage')}, {r('lim', 9, 'leverage_threshold')}, h <= lim AS leverage_inside FROM hh")
def ad1(spark, sf):
    return rounded(order_leverage(spark, sf).select("row_id", "leverage", "leverage_threshold", "leverage_inside"), 9)


WIL_SQL = f"{LEV_SQL}, {ridge_sql('m', 'om')}, w0 AS (SELECT hh.*, y - ({PRED}) AS e FROM hh, m), w AS (SELECT *, e / (SELECT stddev_samp(e) FROM w0) AS z FROM w0)"


@query("ad2_williams", f"WITH {ORDERS_SQL}, {WIL_SQL} SELECT row_id, {r('z', 6, 'standardized_residual')}, h > lim AS outside_ad, abs(z) > 3 AS high_residual, h > lim AND abs(z) > 3 AS critical FROM w")
def ad2(spark, sf):
    return rounded(domain.williams(order_leverage(spark, sf), "y", "y_pred").select("row_id", "standardized_residual", "outside_ad", "high_residual", "critical"))


@query("agg14_williams_summary", f"WITH {ORDERS_SQL}, {WIL_SQL} SELECT count(*) AS total, count(*) FILTER (h > lim) AS outside_ad, count(*) FILTER (abs(z) > 3) AS high_residual, count(*) FILTER (h > lim AND abs(z) > 3) AS critical FROM w")
def agg14(spark, sf):
    return domain.williams_summary(domain.williams(order_leverage(spark, sf), "y", "y_pred"))


@query("agg14_domain_statistics", f"WITH {ORDERS_SQL}, {LEV_SQL} SELECT count(*) FILTER (h <= lim) AS inside, count(*) FILTER (h > lim) AS outside, {r('100.0 * count(*) FILTER (h > lim) / count(*)', 6, 'outside_percent')}, {r('avg(h)', 9, 'mean_leverage')}, {r('max(h)', 9, 'max_leverage')}, {r('max(lim)', 9, 'threshold')} FROM hh")
def agg14_domain(spark, sf):
    return rounded(stats.domain_statistics(order_leverage(spark, sf), "leverage", "leverage_threshold"), 9, outside_percent=6)


@query("ad3_range_domain", f"""WITH {ORDERS_SQL}, g AS (SELECT min(x1) AS a1, max(x1) AS b1, min(x2) AS a2, max(x2) AS b2 FROM om WHERE nation < 5 AND x2 < 10), o AS (SELECT row_id, CASE WHEN x1 < a1 - 0.05 * (b1 - a1) OR x1 > b1 + 0.05 * (b1 - a1) THEN 1 ELSE 0 END + CASE WHEN x2 < a2 - 0.05 * (b2 - a2) OR x2 > b2 + 0.05 * (b2 - a2) THEN 1 ELSE 0 END AS c FROM om, g)
SELECT row_id, c AS range_outside_count, CAST(c / 2.0 AS DOUBLE) AS range_outside_fraction, c = 0 AS range_inside FROM o""")
def ad3(spark, sf):
    d = order_matrix(spark, sf)
    rg = domain.feature_ranges(d.where("nation < 5 AND x2 < 10"), X)
    return domain.range_domain(d, rg).select("row_id", "range_outside_count", "range_outside_fraction", "range_inside")


EMB_SQL = "em AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
NN_SQL = EMB_SQL + ", nn AS (SELECT a.vec_id AS qid, b.vec_id AS tid, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rk, a.label AS la, b.label AS lb FROM em a JOIN em b ON a.vec_id <> b.vec_id)"


def embeddings(spark, sf):
    return table(spark, sf, "embeddings").selectExpr("vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS v", "label")


@query("join14_nearest_neighbours", f"WITH {NN_SQL} SELECT qid, tid, CAST(rk AS INTEGER) AS rank, {r('d', 6, 'distance')} FROM nn WHERE rk <= 5")
def join14(spark, sf):
    e = embeddings(spark, sf)
    return rounded(knn.nearest_neighbours(e, e, "vec_id", "vec_id", "v", 5, exclude_self=True))


@query("mdl6_knn_regression", f"WITH {NN_SQL} SELECT qid, {r('sum(lb / d) / sum(1 / d)', 6, 'y_pred')} FROM nn WHERE rk <= 5 GROUP BY 1")
def mdl6(spark, sf):
    e = embeddings(spark, sf)
    return rounded(knn.knn_regression(knn.nearest_neighbours(e, e, "vec_id", "vec_id", "v", 5, exclude_self=True), e, "vec_id", "label", weighted=True))


@query("unc4_local_error", f"""WITH {NN_SQL} SELECT qid, {r('avg(abs(lb - 2.5))', 6, 'local_mae')}, {r('sqrt(avg((lb - 2.5) * (lb - 2.5)))', 6, 'local_rmse')}, {r('avg(lb - 2.5)', 6, 'local_bias')}, {r('min(d)', 6, 'nearest_distance')}, {r('avg(d)', 6, 'mean_neighbour_distance')},
 string_agg(tid, ';' ORDER BY rk) AS neighbour_ids FROM nn WHERE rk <= 5 GROUP BY 1""")
def unc4(spark, sf):
    e = embeddings(spark, sf).withColumn("e", F.col("label") - 2.5)
    return rounded(knn.local_error(knn.nearest_neighbours(e, e, "vec_id", "vec_id", "v", 5, exclude_self=True), e, "vec_id", "e"))


SPLIT_NN = EMB_SQL + """, tn AS (SELECT * FROM em WHERE label < 5), ow AS (SELECT a.vec_id, min({f}) AS d FROM tn a JOIN tn b ON a.vec_id <> b.vec_id GROUP BY 1), th AS (SELECT quantile_cont(d, {q}) AS t FROM ow),
qn AS (SELECT a.vec_id, min({f}) AS d FROM em a, tn b WHERE a.label >= 5 GROUP BY 1)"""


@query("ad4_distance_domain", f"WITH {SPLIT_NN.format(f='list_distance(a.v, b.v)', q=0.95)} SELECT vec_id, {r('d', 6, 'distance')}, {r('t', 6, 'threshold')}, {r('d / t', 6, 'ratio')}, d <= t AS inside FROM qn, th")
def ad4(spark, sf):
    e = embeddings(spark, sf)
    return rounded(domain.distance_domain(e.where("label >= 5"), e.where("label < 5"), "vec_id", "vec_id", "v"))


@query("ad6_cosine_domain", f"WITH {SPLIT_NN.format(f='1 - list_cosine_similarity(a.v, b.v)', q=0.95)} SELECT vec_id, {r('1 - d', 6, 'similarity')}, {r('1 - t', 6, 'threshold')}, d <= t AS inside FROM qn, th")
def ad6(spark, sf):
    e = embeddings(spark, sf)
    return rounded(domain.cosine_domain(e.where("label >= 5"), e.where("label < 5"), "vec_id", "vec_id", "v"))


@query("join16_max_cosine", f"WITH {SPLIT_NN.format(f='1 - list_cosine_similarity(a.v, b.v)', q=0.95)} SELECT vec_id, {r('1 - d', 6, 'similarity')} FROM qn")
def join16(spark, sf):
    e = embeddings(spark, sf)
    return rounded(domain.cosine_domain(e.where("label >= 5"), e.where("label < 5"), "vec_id", "vec_id", "v").select("vec_id", "similarity"))


def customer_matrix(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    a = o.groupBy("o_custkey").agg(F.count("*").cast("double").alias("x2"), F.avg("o_totalprice").alias("y"), F.avg(F.month("o_orderdate")).alias("x3"))
    return c.join(a, c.c_custkey == a.o_custkey).selectExpr("c_custkey AS row_id", "c_acctbal AS x1", "x2", "x3", "y", "c_nationkey AS nation")


@query("ad7_subspace_domain")
def ad7(spark, sf):
    d = customer_matrix(spark, sf)
    return domain.subspace_domain(d.where("nation = 3"), d.where("nation <> 3"), "row_id", {"molecular": ["x1", "x2"], "spectral": ["x2", "x3"], "combined": ["x1", "x2", "x3"]}, ["spectral"])


@query("unc3_query_bootstrap", f"""WITH {ORDERS_SQL}, d AS (SELECT om.*, b, {poisson_weight_sql(portable_hash_sql('row_id', 'b'))} AS w FROM om, range(100) q(b)), {ridge_sql('m', 'd', 'b', 'w > 0', w='w')}, pp AS (SELECT row_id, {PRED} AS p FROM om, m)
SELECT row_id, {r('avg(p)', 1, 'bootstrap_mean')}, {r('stddev_samp(p)', 1, 'bootstrap_std')}, {r('quantile_cont(p, 0.05)', 1, 'bootstrap_p05')}, {r('quantile_cont(p, 0.95)', 1, 'bootstrap_p95')} FROM pp GROUP BY 1""")
def unc3(spark, sf):
    d = order_matrix(spark, sf)
    return rounded(uncertainty.bootstrap_columns(d, uncertainty.bootstrap_models(d, X, "y", "row_id", 100)).select("row_id", "bootstrap_mean", "bootstrap_std", "bootstrap_p05", "bootstrap_p95"), 1)


CONS = "(SELECT l_orderkey AS row_id, 'a' AS model, sum(l_extendedprice) AS y_pred FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderkey, 'b', o_totalprice FROM orders UNION ALL SELECT o_orderkey, 'c', 250000.0 FROM orders)"


def consensus_predictions(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return (li.groupBy(F.col("l_orderkey").alias("row_id")).agg(F.sum("l_extendedprice").alias("y_pred")).select("row_id", F.lit("a").alias("model"), "y_pred")
            .unionByName(o.selectExpr("o_orderkey AS row_id", "'b' AS model", "o_totalprice AS y_pred"))
            .unionByName(o.selectExpr("o_orderkey AS row_id", "'c' AS model", "CAST(250000 AS DOUBLE) AS y_pred")))


@query("val12_consensus", f"SELECT row_id, count(*) AS models, {r('avg(y_pred)', 3, 'consensus_mean')}, {r('stddev_samp(y_pred)', 3, 'consensus_std')} FROM {CONS} WHERE model IN ('a', 'b') GROUP BY 1")
def val12(spark, sf):
    board = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.2)], "model string, r2 double")
    return rounded(validation.consensus(consensus_predictions(spark, sf), "row_id", board, top_n=2, min_r2=0.5), 3)


@query("unc5_weighted_consensus", f"""WITH p AS (SELECT row_id, y_pred, CASE model WHEN 'a' THEN 0.5 WHEN 'b' THEN 0.25 ELSE 0.125 END AS w FROM {CONS}), m AS (SELECT row_id, sum(w * y_pred) / sum(w) AS m FROM p GROUP BY 1)
SELECT row_id, {r('any_value(m)', 3, 'consensus_mean')}, {r('CASE WHEN count(*) > 1 THEN sqrt(sum(w * (y_pred - m) * (y_pred - m)) / sum(w)) END', 3, 'consensus_std')}, {r('median(y_pred)', 3, 'consensus_median')}, {r('min(y_pred)', 3, 'consensus_min')}, {r('max(y_pred)', 3, 'consensus_max')} FROM p JOIN m USING (row_id) GROUP BY 1""")
def unc5(spark, sf):
    return rounded(uncertainty.weighted_consensus(consensus_predictions(spark, sf), "row_id", {"a": 0.5, "b": 0.25, "c": 0.125}), 3)


@query("unc6_reliability", """WITH d AS (SELECT l_quantity > 40 AS o1, l_discount > 0.08 AS o2, l_tax > 0.06 AS o3, l_quantity / 20 > 1 AS u1, l_quantity / 20 > 1.5 AS u2 FROM lineitem),
s AS (SELECT greatest(0, 100.0 - 10 - CASE WHEN o1 THEN 30 ELSE 0 END - CASE WHEN o2 THEN 20 ELSE 0 END - CASE WHEN o3 THEN 30 ELSE 0 END - CASE WHEN u1 THEN 15 ELSE 0 END - CASE WHEN u2 THEN 15 ELSE 0 END)::DOUBLE AS reliability_score,
 concat_ws('; ', 'moderate_conformal_interval', CASE WHEN o1 THEN 'outside_distance_ad' END, CASE WHEN o2 THEN 'outside_descriptor_range' END, CASE WHEN o3 THEN 'outside_leverage_ad' END, CASE WHEN u1 THEN 'high_bootstrap_uncertainty' END, CASE WHEN u2 THEN 'high_local_uncertainty' END) AS reliability_reasons FROM d)
SELECT reliability_score, reliability_reasons, CASE WHEN reliability_score >= 75 THEN 'high' WHEN reliability_score >= 50 THEN 'medium' ELSE 'low' END AS reliability_status, count(*) AS n FROM s GROUP BY ALL""")
def unc6(spark, sf):
    d = table(spark, sf, "lineitem").selectExpr("l_quantity <= 40 AS a", "l_discount <= 0.08 AS b", "l_tax <= 0.06 AS c", "l_quantity AS q")
    s = uncertainty.reliability(d, 20.0, 1.5, {"bootstrap": "q", "local": "q"}, {"distance_inside": "a", "range_inside": "b", "leverage_inside": "c"})
    return s.groupBy("reliability_score", "reliability_reasons", "reliability_status").agg(F.count("*").alias("n"))


@query("unc7_uncertainty_table")
def unc7(spark, sf):
    d = customer_matrix(spark, sf)
    train = d.where("nation <> 3")
    g = grams(train, ["x1", "x2", "x3"], "y")[()]
    return uncertainty.uncertainty_table(train, d.where("nation = 3"), ["x1", "x2", "x3"], "y", "row_id", replicates=100, models={"ridge": g.ridge(1.0), "lasso": g.elastic_net(0.1)})
