"""Error-profile queries: groups over line items, ordered series over customer orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvida.catalog.registry import LINES_SQL, lines, query, r, rounded, table
from corvida.functions.columns import poisson_weight_sql, portable_hash_sql
from corvida.functions.ranks import bounded_groups, concordance
from corvida.operators import clean, errors

FLAGS = {
    "group_small_lot": "x1 < 10", "group_discounted": "x2 >= 0.05", "group_untaxed": "x3 = 0",
    "group_large_part": "x4 > 30", "group_returned": "l_returnflag = 'R'", "group_brand_1": "p_brand = 'Brand#1'",
}


def error_rows(spark, sf):
    d = lines(spark, sf).withColumns({k: F.expr(v) for k, v in FLAGS.items()})
    return clean.error_table(d, "y", "y_pred", ["row_id", "p_brand", "p_type", *FLAGS])


ERR_SQL = LINES_SQL + ", er AS (SELECT *, y_pred - y AS e FROM lines), ov AS (SELECT avg(abs(e)) AS om FROM er)"


def em_sql(keys, frm, rel=10):
    return f"""SELECT {keys}, count(*) AS n, {r('avg(abs(e))', 4, 'mae')}, {r('sqrt(avg(e*e))', 4, 'rmse')}, {r('avg(e)', 4, 'bias')},
  {r('quantile_cont(abs(e), 0.5)', 4, 'median_ae')}, {r('max(abs(e))', 4, 'max_ae')},
  {r('avg(CASE WHEN abs(e) >= greatest(1e-12, 2 * om) THEN 1.0 ELSE 0.0 END)', 4, 'large_error_fraction')},
  {r('(avg(abs(e)) / any_value(om) - 1) * 100', 4, 'mae_vs_overall_percent')},
  CASE WHEN count(*) >= {rel} THEN 'adequate' ELSE 'small_group' END AS reliability FROM {frm} GROUP BY {keys}"""


@query("agg2_error_metrics", f"WITH {ERR_SQL} {em_sql('p_type', 'er, ov')}")
def agg2(spark, sf):
    return rounded(errors.error_metrics(error_rows(spark, sf), ["p_type"]), 4)


@query("agg4_cluster_summary", f"WITH {ERR_SQL}, c AS (SELECT *, CAST(x4 AS INTEGER) % 17 AS cluster_id FROM er) {em_sql('cluster_id', 'c, ov')}")
def agg4(spark, sf):
    d = clean.error_table(lines(spark, sf), "y", "y_pred", ["x4"]).withColumn("cluster_id", F.col("x4").cast("int") % 17)
    return rounded(errors.error_metrics(d, ["cluster_id"]), 4)


MEMBERS_SQL = "mem AS (SELECT 'overall' AS group_id, e FROM er" + "".join(
    f" UNION ALL SELECT '{k}', e FROM er WHERE {v}" for k, v in FLAGS.items()) + ")"


@query("agg3_overlapping_groups", f"WITH {ERR_SQL}, {MEMBERS_SQL} {em_sql('group_id', 'mem, ov')} HAVING count(*) >= 5 OR group_id = 'overall'")
def agg3(spark, sf):
    return rounded(errors.group_summary(error_rows(spark, sf), list(FLAGS)), 4)


@query("prj26_group_drilldown", f"WITH {LINES_SQL} SELECT row_id, {r('y_pred - y', 4, 'error')} FROM lines WHERE l_returnflag = 'R'")
def prj26(spark, sf):
    return rounded(errors.group_drilldown(error_rows(spark, sf), "group_returned").select("row_id", "error"), 4)


REPS = 500
_H = portable_hash_sql("row_id", "b")


@query("agg5_bootstrap_ci", f"""WITH {ERR_SQL}, w AS (SELECT p_type, b, abs(e) AS a, {poisson_weight_sql(_H)} AS w FROM er, range({REPS}) t(b)),
m AS (SELECT p_type, b, sum(w * a) / sum(w) AS mae FROM w GROUP BY 1, 2)
SELECT p_type, {r('quantile_cont(mae, 0.025)', 4, 'mae_ci_low')}, {r('quantile_cont(mae, 0.975)', 4, 'mae_ci_high')} FROM m GROUP BY 1""")
def agg5(spark, sf):
    return rounded(errors.bootstrap_mae(error_rows(spark, sf), ["p_type"], "row_id", replicates=REPS), 4)


# Ordered series: customers' orders per (nation, segment), month number as the size.
SERIES_SQL = """sr AS (SELECT o_orderkey AS original_index, o_orderkey AS row_position, c_nationkey || '|' || c_mktsegment AS series_id,
  CAST((year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS INTEGER) AS size, CAST(o_totalprice AS DOUBLE) AS experimental,
  CAST(250000 + 5 * c_acctbal AS DOUBLE) + 500.0 * month(o_orderdate) AS predicted FROM orders JOIN customer ON o_custkey = c_custkey),
se AS (SELECT *, predicted - experimental AS e, abs(predicted - experimental) AS a FROM sr), ov AS (SELECT avg(a) AS om FROM se)"""


def series_rows(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    d = o.join(c, o.o_custkey == c.c_custkey).selectExpr(
        "o_orderkey AS original_index", "o_orderkey AS row_position", "c_nationkey || '|' || c_mktsegment AS series_id",
        "CAST((year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS INT) AS size", "CAST(o_totalprice AS DOUBLE) AS experimental",
        "CAST(250000 + 5 * c_acctbal AS DOUBLE) + CAST(500 AS DOUBLE) * month(o_orderdate) AS predicted",
        "c_mktsegment AS segment", "c_nationkey AS nation")
    e = F.col("predicted") - F.col("experimental")
    return d.withColumns({"error": e, "absolute_error": F.abs(e)})


MONO = """(SELECT series_id, CASE WHEN sum(n) < 3 OR count(*) < 3 THEN 'insufficient' WHEN min(d) >= 0 THEN 'increasing' WHEN max(d) <= 0 THEN 'decreasing' ELSE 'non_monotonic' END AS {out}
  FROM (SELECT series_id, n, m - lag(m) OVER (PARTITION BY series_id ORDER BY size) AS d FROM (SELECT series_id, size, count(*) AS n, avg({v}) AS m FROM se GROUP BY 1, 2)) GROUP BY 1)"""

OUTLIER_SQL = """ln AS (SELECT series_id, regr_slope(experimental, size) AS s, regr_intercept(experimental, size) AS i FROM se GROUP BY 1 HAVING count(*) >= 4 AND count(DISTINCT size) >= 3),
rs AS (SELECT se.series_id, se.original_index, se.experimental - (i + s * size) AS res FROM se JOIN ln USING (series_id)),
rm AS (SELECT series_id, quantile_cont(res, 0.5) AS med FROM rs GROUP BY 1),
rd AS (SELECT series_id, quantile_cont(abs(res - med), 0.5) AS mad FROM rs JOIN rm USING (series_id) GROUP BY 1),
ou AS (SELECT rs.series_id, rs.original_index, mad > 1e-15 AND abs(res - med) / (1.4826 * mad) > 3.5 AS o FROM rs JOIN rm USING (series_id) JOIN rd USING (series_id))"""

ORDER_SQL = """(SELECT a.series_id, count(*) AS comparable, count(*) FILTER ((b.experimental - a.experimental) * (b.predicted - a.predicted) > 0) AS preserved
  FROM se a JOIN se b ON a.series_id = b.series_id AND a.original_index < b.original_index AND a.experimental <> b.experimental GROUP BY 1)"""


@query("win3_monotonic_direction", f"WITH {SERIES_SQL} SELECT * FROM {MONO.format(out='direction', v='experimental')}")
def win3(spark, sf):
    return errors.monotonic_direction(series_rows(spark, sf), "series_id", "size", "experimental", "direction")


@query("win4_order_preservation", f"WITH {SERIES_SQL} SELECT * FROM {ORDER_SQL}")
def win4(spark, sf):
    d = series_rows(spark, sf)
    return concordance(d, ["series_id"], "experimental", "predicted", bounded_groups(d, ["series_id"]))


@query("win5_trend_outliers", f"WITH {SERIES_SQL}, {OUTLIER_SQL} SELECT se.original_index, se.series_id, coalesce(o, false) AS trend_outlier FROM se LEFT JOIN ou USING (original_index)")
def win5(spark, sf):
    return errors.trend_outliers(series_rows(spark, sf), "series_id", "size", "experimental").select("original_index", "series_id", "trend_outlier")


@query("agg6_series_summary", f"""WITH {SERIES_SQL}, {OUTLIER_SQL}, mt AS ({em_sql('series_id', 'se, ov')}),
sl AS (SELECT series_id, {r('min(size)', 4, 'size_min')}, {r('max(size)', 4, 'size_max')}, {r('regr_slope(e, size)', 4, 'error_size_slope')}, {r('regr_slope(a, size)', 4, 'absolute_error_size_slope')} FROM se GROUP BY 1),
rk AS (SELECT series_id, rank() OVER (PARTITION BY series_id ORDER BY size) + (count(*) OVER (PARTITION BY series_id, size) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY series_id ORDER BY experimental) + (count(*) OVER (PARTITION BY series_id, experimental) - 1) / 2.0 AS ry FROM se),
rh AS (SELECT series_id, {r('corr(rx, ry)', 4, 'property_size_correlation')} FROM rk GROUP BY 1),
oc AS (SELECT series_id, count(*) FILTER (o) AS trend_outlier_count FROM ou GROUP BY 1),
tp AS (SELECT series_id, string_agg(original_index, ';' ORDER BY k) AS problem_ids FROM (SELECT series_id, original_index, row_number() OVER (PARTITION BY series_id ORDER BY a DESC, original_index) AS k FROM se) WHERE k <= 3 GROUP BY 1)
SELECT mt.* EXCLUDE (reliability), sl.* EXCLUDE (series_id), property_size_correlation, experimental_monotonicity, predicted_monotonicity,
  {r('preserved / comparable', 4, 'order_preservation')}, trend_outlier_count, problem_ids,
  experimental_monotonicity = predicted_monotonicity AND experimental_monotonicity NOT IN ('insufficient', 'non_monotonic') AS trend_direction_preserved,
  CASE WHEN n >= 5 THEN 'adequate' ELSE 'insufficient' END AS reliability
FROM mt JOIN sl USING (series_id) JOIN rh USING (series_id) JOIN {MONO.format(out='experimental_monotonicity', v='experimental')} me USING (series_id)
JOIN {MONO.format(out='predicted_monotonicity', v='predicted')} mp USING (series_id) JOIN {ORDER_SQL} op USING (series_id) JOIN oc USING (series_id) JOIN tp USING (series_id)""")
def agg6(spark, sf):
    return rounded(errors.series_summary(series_rows(spark, sf)), 4)


@query("agg7_residual_by_series", f"""WITH {SERIES_SQL}, ex AS (SELECT series_id, string_agg(original_index, '; ' ORDER BY k) AS examples FROM
 (SELECT series_id, original_index, row_number() OVER (PARTITION BY series_id ORDER BY size, original_index) AS k FROM se) WHERE k <= 3 GROUP BY 1)
SELECT series_id, count(*) AS n, {r('avg(experimental)', 4, 'mean_experimental')}, {r('avg(predicted)', 4, 'mean_predicted')}, {r('avg(-e)', 4, 'mean_residual')},
 {r('avg(a)', 4, 'mae')}, {r('sqrt(avg(e * e))', 4, 'rmse')}, min(size) AS size_min, max(size) AS size_max, any_value(examples) AS examples,
 CAST(CASE series_id WHEN '3|BUILDING' THEN 0 WHEN '1|MACHINERY' THEN 1 ELSE 100 END AS BIGINT) AS display_order
FROM se JOIN ex USING (series_id) GROUP BY 1""")
def agg7(spark, sf):
    return rounded(errors.residual_by_series(series_rows(spark, sf), "series_id", "size", "original_index", ("3|BUILDING", "1|MACHINERY")), 4)


# Substitution effects: an order line 1 is the bare reference of its family.
SUBST_SQL = """sb AS (SELECT o_orderkey AS original_index, o_orderkey AS row_position, c_mktsegment || '|' || o_orderpriority AS series_id,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'alkane' WHEN 'MACHINERY' THEN 'aromatic' ELSE lower(c_mktsegment) END AS family,
  o_orderstatus AS scaffold, o_orderstatus AS reference_scheme, CASE WHEN o_orderpriority = '5-LOW' THEN 'none' ELSE o_orderpriority END AS substitution_scheme,
  CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END AS substituent_count, month(o_orderdate) AS carbon_count, c_nationkey AS parent_size,
  CAST(o_totalprice AS DOUBLE) AS experimental, CAST(250000 + 5 * c_acctbal AS DOUBLE) AS predicted FROM orders JOIN customer ON o_custkey = c_custkey)"""
PAIRS_SQL = SUBST_SQL + """, f1 AS (SELECT carbon_count, min_by(sb, original_index) AS q FROM sb WHERE family = 'alkane' AND substitution_scheme = 'none' GROUP BY 1),
f2 AS (SELECT family, scaffold, min_by(sb, original_index) AS q FROM sb WHERE substitution_scheme = 'none' GROUP BY 1, 2),
f3 AS (SELECT family, reference_scheme, carbon_count, min_by(sb, original_index) AS q FROM sb WHERE substituent_count = 0 GROUP BY 1, 2, 3),
pr AS (SELECT sb.*, q, CAST(sb.carbon_count AS DOUBLE) AS cs FROM sb JOIN f1 USING (carbon_count) WHERE family = 'alkane' AND substituent_count > 0
 UNION ALL SELECT sb.*, q, CAST(sb.parent_size AS DOUBLE) FROM sb JOIN f2 USING (family, scaffold) WHERE family IN ('aromatic', 'heterocyclic', 'carbocyclic') AND substituent_count > 0
 UNION ALL SELECT sb.*, q, CAST(sb.carbon_count AS DOUBLE) FROM sb JOIN f3 USING (family, reference_scheme, carbon_count) WHERE family NOT IN ('alkane', 'aromatic', 'heterocyclic', 'carbocyclic') AND substituent_count > 0),
pd AS (SELECT series_id, cs, q.original_index AS reference_index, original_index AS substituted_index, experimental - q.experimental AS de, predicted - q.predicted AS dp FROM pr),
pa AS (SELECT *, (abs(de) <= 1e-12 AND abs(dp) <= 1e-12) OR de * dp > 0 AS dc FROM pd)"""


def substituted_rows(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).selectExpr(
        "o_orderkey AS original_index", "o_orderkey AS row_position", "c_mktsegment || '|' || o_orderpriority AS series_id",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'alkane' WHEN 'MACHINERY' THEN 'aromatic' ELSE lower(c_mktsegment) END AS family",
        "o_orderstatus AS scaffold", "o_orderstatus AS reference_scheme",
        "CASE WHEN o_orderpriority = '5-LOW' THEN 'none' ELSE o_orderpriority END AS substitution_scheme",
        "CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END AS substituent_count", "month(o_orderdate) AS carbon_count",
        "c_nationkey AS parent_size", "CAST(o_totalprice AS DOUBLE) AS experimental", "CAST(250000 + 5 * c_acctbal AS DOUBLE) AS predicted")


@query("join9_substitution_pairs", f"""WITH {PAIRS_SQL} SELECT series_id, {r('cs', 4, 'comparison_size')}, reference_index, substituted_index, {r('de', 4, 'delta_experimental')},
 {r('dp', 4, 'delta_predicted')}, {r('dp - de', 4, 'delta_error')}, {r('abs(dp - de)', 4, 'absolute_delta_error')}, dc AS direction_correct FROM pa""")
def join9(spark, sf):
    return rounded(errors.substitution_pairs(substituted_rows(spark, sf), errors.family_rules()), 4)


@query("agg8_effect_summary", f"""WITH {PAIRS_SQL} SELECT series_id, count(*) AS n, {r('avg(abs(dp - de))', 4, 'effect_mae')}, {r('sqrt(avg((dp - de) * (dp - de)))', 4, 'effect_rmse')},
 {r('avg(dp - de)', 4, 'effect_bias')}, {r('avg(CASE WHEN dc THEN 1.0 ELSE 0.0 END)', 4, 'direction_accuracy')},
 {r('regr_slope(de, cs)', 4, 'experimental_effect_slope')}, {r('regr_slope(dp, cs)', 4, 'predicted_effect_slope')}, CASE WHEN count(*) >= 3 THEN 'adequate' ELSE 'insufficient' END AS reliability FROM pa GROUP BY 1""")
def agg8(spark, sf):
    return rounded(errors.effect_summary(errors.substitution_pairs(substituted_rows(spark, sf), errors.family_rules())), 4)


@query("win11_error_rank", f"""WITH {SERIES_SQL} SELECT original_index, row_number() OVER (ORDER BY a DESC, original_index) AS error_rank, a >= greatest(1e-12, 2 * om) AS large_error, {r('a', 4, 'absolute_error')} FROM se, ov""")
def win11(spark, sf):
    return rounded(errors.problem_rows(series_rows(spark, sf), "original_index").select("original_index", "error_rank", "large_error", "absolute_error"), 4)


@query("top4_series_top_errors", f"""WITH {SERIES_SQL} SELECT series_id, original_index, CAST(k AS INTEGER) AS rank, {r('a', 4, 'absolute_error')} FROM
 (SELECT series_id, original_index, a, row_number() OVER (PARTITION BY series_id ORDER BY a DESC, original_index) AS k FROM se) WHERE k <= 3""")
def top4(spark, sf):
    d = errors.top_per_key(series_rows(spark, sf), ["series_id"], [F.col("absolute_error").desc(), F.col("original_index")], 3, "original_index")
    return rounded(d.select("series_id", "original_index", "rank", "absolute_error"), 4)


@query("top4_error_outliers", f"WITH {SERIES_SQL} SELECT original_index, {r('a', 4, 'absolute_error')} FROM se WHERE a > (SELECT avg(a) + 2 * stddev_samp(a) FROM se)")
def top4_outliers(spark, sf):
    return rounded(errors.error_outliers(series_rows(spark, sf)).select("original_index", "absolute_error"), 4)


@query("join11_annotated_errors", f"""WITH {SERIES_SQL} SELECT CASE WHEN c_nationkey < 20 THEN c_name END AS annotation, count(*) AS n, {r('avg(a)', 7, 'mae')}
FROM orders JOIN se ON o_orderkey = original_index JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def join11(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("original_index"), "o_custkey")
    notes = table(spark, sf, "customer").where("c_nationkey < 20").selectExpr("c_custkey AS o_custkey", "c_name AS annotation")
    d = series_rows(spark, sf).join(o, "original_index").join(notes, "o_custkey", "left")
    return rounded(d.groupBy("annotation").agg(F.count("*").alias("n"), F.avg("absolute_error").alias("mae")), 7)
