"""Consistency queries: pattern edges over parts, ordered series and transformations over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvida.catalog.registry import query, r, rounded, table
from corvida.operators import series
from corvida.session import cut_lineage, stored

# ------------------------------------------------------------------ pattern edges over parts
PP_SQL = """pp AS (SELECT p_partkey AS id, p_size AS formula, (p_partkey % 3) || '-' || lower(p_type) AS pattern, lower(p_type) AS fam, CAST(p_retailprice AS DOUBLE) AS v FROM part),
pt AS (SELECT formula, pattern, any_value(fam) AS fam, count(*) AS n, sum(v) AS total, min(v) AS low, max(v) AS high FROM pp GROUP BY 1, 2),
ed AS (SELECT a.pattern || ' minus ' || b.pattern AS edge_label, formula, a.pattern AS pattern_a, b.pattern AS pattern_b, a.n AS n_a, b.n AS n_b, a.n * b.n AS n_pairs,
  a.total / a.n - b.total / b.n AS mean_delta, a.low - b.high AS min_delta, a.high - b.low AS max_delta, a.fam = b.fam AS same_family
  FROM pt a JOIN pt b USING (formula) WHERE a.pattern < b.pattern),
md AS (SELECT a.pattern || ' minus ' || b.pattern AS edge_label, formula, quantile_cont(a.v - b.v, 0.5) AS median_delta FROM pp a JOIN pp b USING (formula) WHERE a.pattern < b.pattern GROUP BY 1, 2)"""


def part_patterns(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS id", "p_size AS formula", "(p_partkey % 3) || '-' || lower(p_type) AS pattern", "CAST(p_retailprice AS DOUBLE) AS v")


@query("agg15_duplicate_flags", """SELECT p_partkey, count(*) OVER (PARTITION BY p_name, p_brand) > 1 AS duplicate_structure,
 count(*) OVER (PARTITION BY p_name, p_brand) > 1 AND max(p_retailprice) OVER (PARTITION BY p_name, p_brand) - min(p_retailprice) OVER (PARTITION BY p_name, p_brand) > 1e-9 AS duplicate_conflict FROM part""")
def agg15(spark, sf):
    d = table(spark, sf, "part").withColumn("canonical", F.concat_ws("|", "p_name", "p_brand"))
    return series.duplicate_flags(d, "canonical", "p_retailprice").select("p_partkey", "duplicate_structure", "duplicate_conflict")


@query("join7_pattern_pairs", f"""WITH {PP_SQL} SELECT edge_label, formula, pattern_a, pattern_b, n_a, n_b, n_pairs, {r('mean_delta', 6, 'mean_delta')}, {r('min_delta', 6, 'min_delta')},
 {r('max_delta', 6, 'max_delta')}, false AS is_base_edge, same_family FROM ed""")
def join7(spark, sf):
    return rounded(series.pattern_edges(series.pattern_points(part_patterns(spark, sf), "formula", "pattern", "v")))


@query("agg17_edges_by_formula", f"""WITH {PP_SQL} SELECT edge_label, formula, n_pairs, {r('median_delta', 6, 'median_delta')}, {r('mean_delta', 6, 'mean_delta')}, {r('max_delta - min_delta', 6, 'delta_spread')}, n_pairs > 1 AS ambiguous
FROM ed JOIN md USING (edge_label, formula)""")
def agg17(spark, sf):
    e = series.edge_table(part_patterns(spark, sf), "formula", "pattern", "v")
    return rounded(e.select("edge_label", "formula", "n_pairs", "median_delta", "mean_delta", "delta_spread", "ambiguous"))


SIGMA = "CASE WHEN 1.4826 * {mad} > 1e-12 THEN 1.4826 * {mad} WHEN {sd} > 1e-12 THEN {sd} WHEN {q3} - {q1} > 1e-12 THEN ({q3} - {q1}) / 1.349 ELSE 1e-6 END"


def sigma_sql(name, frm, key, v):
    """CTEs <name>q, <name>m and <name> (key, med, sigma)."""
    s = SIGMA.format(mad="mad", sd="sd", q3="q3", q1="q1")
    return f"""{name}q AS (SELECT {key}, quantile_cont({v}, 0.5) AS med, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.75) AS q3, stddev_pop({v}) AS sd FROM {frm} WHERE {v} IS NOT NULL GROUP BY ALL),
{name}m AS (SELECT {key}, quantile_cont(abs({v} - med), 0.5) AS mad FROM {frm} JOIN {name}q USING ({key}) WHERE {v} IS NOT NULL GROUP BY ALL),
{name} AS (SELECT {key}, med, {s} AS sigma FROM {name}q JOIN {name}m USING ({key}))"""


RULE_SQL = f"""{PP_SQL}, e0 AS (SELECT edge_label, formula, CAST(formula AS DOUBLE) AS x, pattern_a, pattern_b, median_delta AS y FROM ed JOIN md USING (edge_label, formula)),
e1 AS (SELECT * FROM e0 WHERE edge_label IN (SELECT edge_label FROM e0 GROUP BY 1 HAVING count(*) >= 3)),
ft AS (SELECT edge_label, count(*) AS n_points, avg(y) AS mean_delta, min(x) AS x_min, max(x) AS x_max, quantile_cont(y, 0.5) AS median_delta,
  CASE WHEN count(*) >= 5 THEN regr_slope(y, x) END AS sl, CASE WHEN count(*) >= 5 THEN regr_intercept(y, x) END AS ic FROM e1 GROUP BY 1),
d1 AS (SELECT e1.*, ft.* EXCLUDE (edge_label), coalesce(ic + sl * x, median_delta) AS pred, y - coalesce(ic + sl * x, median_delta) AS res,
  y - lag(y) OVER w AS ch, lag(y) OVER w AS prev, lag(e1.formula) OVER w AS prevf FROM e1 JOIN ft USING (edge_label) WINDOW w AS (PARTITION BY edge_label ORDER BY x)),
{sigma_sql('rs', 'd1', 'edge_label', 'res')}, {sigma_sql('cs', 'd1', 'edge_label', 'ch')},
d2 AS (SELECT d1.*, abs(res) / rs.sigma AS rsc, CASE WHEN ch IS NOT NULL THEN abs(ch - cs.med) / cs.sigma END AS csc, sign(median_delta) AS ms FROM d1 JOIN rs USING (edge_label) JOIN cs USING (edge_label)),
d3 AS (SELECT *, greatest(rsc, coalesce(csc, 0)) AS sc, ms <> 0 AND y <> 0 AND sign(y) <> ms AS sb FROM d2),
d4 AS (SELECT *, CASE WHEN sb AND sc >= 3 THEN 'breaks_sign_and_trend' WHEN sb THEN 'breaks_sign' WHEN sc >= 3 THEN 'breaks_smoothness' ELSE 'consistent' END AS st FROM d3)"""


def part_edges(spark, sf):
    return series.edge_table(part_patterns(spark, sf), "formula", "pattern", "v", min_formulas=3)


RULES_OUT = f"""SELECT *, rule_status IN ('stable_rule', 'preliminary_rule', 'rule_with_breaks') AS usable FROM (
 SELECT *, CASE WHEN sign_consistency < 0.7 THEN 'unstable_direction' WHEN break_count = 0 AND max_score < 2 THEN 'stable_rule' WHEN break_count = 0 AND max_score < 3 THEN 'preliminary_rule' WHEN break_count > 0 THEN 'rule_with_breaks' ELSE 'weak_rule' END AS rule_status FROM (
 SELECT edge_label, any_value(n_points) AS n_points, {r('any_value(mean_delta)', 6, 'mean_delta')}, {r('any_value(median_delta)', 6, 'median_delta')}, {r('any_value(sl)', 6, 'trend_slope')},
  CASE WHEN any_value(n_points) >= 5 THEN 'linear' ELSE 'median' END AS trend_method, {r('coalesce(avg(CASE WHEN y <> 0 AND ms <> 0 THEN CASE WHEN sign(y) = ms THEN 1.0 ELSE 0.0 END END), 0)', 6, 'sign_consistency')},
  {r('max(sc)', 5, 'max_score')}, count(*) FILTER (st <> 'consistent') AS break_count, count(*) FILTER (sb) AS sign_break_count,
  CASE WHEN any_value(ms) > 0 THEN 'above' WHEN any_value(ms) < 0 THEN 'below' ELSE 'near_zero' END AS direction FROM d4 GROUP BY 1))"""


@query("agg18_discover_rules", f"WITH {RULE_SQL} {RULES_OUT}")
def agg18(spark, sf):
    rules, _ = series.discover_rules(part_edges(spark, sf))
    return rounded(rules.select("edge_label", "n_points", "mean_delta", "median_delta", "trend_slope", "trend_method", "sign_consistency", "max_score",
                                "break_count", "sign_break_count", "direction", "rule_status", "usable"), 6, max_score=5)


@query("win1_change_to_previous", f"""WITH {RULE_SQL} SELECT edge_label, formula, {r('y', 6, 'delta')}, {r('ch', 6, 'delta_change')}, prevf AS previous_formula, {r('prev', 6, 'previous_delta')},
 CASE WHEN y > 0 THEN pattern_a || ' above ' || pattern_b WHEN y < 0 THEN pattern_b || ' above ' || pattern_a ELSE pattern_a || ' equals ' || pattern_b END AS observation FROM d4""")
def win1(spark, sf):
    d = series.change_wording(series.discover_rules(part_edges(spark, sf))[1])
    return rounded(d.select("edge_label", "formula", "delta", "delta_change", "previous_formula", "previous_delta", F.regexp_replace(F.substring_index("observation", ";", 1), " by [0-9.]+$", "").alias("observation")))


@query("prj25_broken_edges", f"WITH {RULE_SQL} SELECT edge_label, formula, st AS edge_status, {r('sc', 5, 'combined_score')} FROM d4 WHERE st <> 'consistent'")
def prj25(spark, sf):
    d = series.broken_edges(series.discover_rules(part_edges(spark, sf))[1])
    return rounded(d.select("edge_label", "formula", "edge_status", "combined_score"), 5)


@query("agg19_point_suspicion", f"""WITH {RULE_SQL}, tot AS (SELECT formula, pattern, count(*) OVER (PARTITION BY formula) - 1 AS edges_total FROM pt),
bd AS (SELECT formula, pattern, count(*) AS b, max(sc) AS m, string_agg(edge_label, '; ' ORDER BY edge_label) AS lb FROM (SELECT formula, edge_label, sc, unnest([pattern_a, pattern_b]) AS pattern FROM d4 WHERE st <> 'consistent') GROUP BY 1, 2),
j AS (SELECT formula, pattern, edges_total, coalesce(b, 0) AS b, coalesce(m, 0) AS m, coalesce(lb, '') AS broken_labels FROM tot LEFT JOIN bd USING (formula, pattern) WHERE edges_total > 0)
SELECT formula, pattern, edges_total, b AS edges_broken, {r('m', 5, 'max_score')}, broken_labels, {r('b / edges_total', 6, 'broken_fraction')},
 CASE WHEN edges_total < 2 THEN 'hardly_checkable' WHEN b = 0 THEN 'consistent' WHEN b >= 3 OR m >= 6 THEN 'critically_suspicious' WHEN b >= 2 OR m >= 4 THEN 'strongly_suspicious' ELSE 'needs_check' END AS status FROM j""")
def agg19(spark, sf):
    d = part_patterns(spark, sf)
    _, details = series.discover_rules(part_edges(spark, sf))
    return rounded(series.point_suspicion(series.pattern_points(d, "formula", "pattern", "v"), series.broken_edges(details)), 6, max_score=5)


@query("agg20_checkability", """WITH p AS (SELECT p_partkey AS id, CAST(p_size AS INTEGER) AS carbon, p_size % 10 || 'f' || p_brand AS formula, (p_partkey % 3) || '-' || lower(p_type) || p_brand AS pattern, lower(p_type) || p_brand AS fam FROM part),
c AS (SELECT id, carbon, formula, pattern, count(*) OVER (PARTITION BY pattern) AS s, count(*) OVER (PARTITION BY formula) AS f,
 EXISTS (SELECT 1 FROM p q WHERE q.pattern = p.pattern AND abs(q.carbon - p.carbon) = 1) AS n, EXISTS (SELECT 1 FROM p q WHERE q.formula = p.formula AND q.fam = p.fam AND q.pattern <> p.pattern) AS a FROM p),
k AS (SELECT *, CASE WHEN s >= 4 THEN 2 WHEN s >= 2 THEN 1 ELSE 0 END + CASE WHEN f >= 8 THEN 3 WHEN f >= 4 THEN 2 WHEN f >= 2 THEN 1 ELSE 0 END + CASE WHEN n THEN 1 ELSE 0 END + CASE WHEN a THEN 2 ELSE 0 END AS sc,
 CASE WHEN s >= 4 AND f >= 4 THEN 'well_checkable' WHEN s >= 4 THEN 'well_checkable_by_series' WHEN s = 1 AND f >= 4 THEN 'unique_but_checkable_by_formula' WHEN s = 1 AND f >= 2 THEN 'unique_partly_checkable_by_formula'
 WHEN s >= 2 AND f >= 2 THEN 'moderately_checkable' WHEN s = 1 AND f = 1 THEN 'hardly_checkable' ELSE 'weakly_checkable' END AS o FROM c)
SELECT id, s AS series_size, f AS formula_group_size, n AS has_same_pattern_neighbors, a AS has_positional_analogs, f >= 2 AS has_formula_isomers, CAST(sc AS INTEGER) AS checkability_score, o AS overall_checkability,
 CASE WHEN sc >= 7 THEN 'well_checkable' WHEN sc >= 5 THEN 'moderately_checkable' WHEN sc >= 3 THEN 'weakly_checkable' ELSE 'hardly_checkable' END AS checkability_level,
 CASE WHEN o IN ('well_checkable', 'well_checkable_by_series') THEN 'low' WHEN o IN ('moderately_checkable', 'unique_but_checkable_by_formula') THEN 'moderate' WHEN o IN ('unique_partly_checkable_by_formula', 'weakly_checkable') THEN 'raised' ELSE 'high' END AS noise_risk FROM k""")
def agg20(spark, sf):
    d = table(spark, sf, "part").selectExpr("p_partkey AS id", "p_size AS carbon", "p_size % 10 || 'f' || p_brand AS formula",
                                            "(p_partkey % 3) || '-' || lower(p_type) || p_brand AS pattern")
    c = series.checkability(d, "formula", "pattern", "carbon")
    return c.select("id", "series_size", "formula_group_size", "has_same_pattern_neighbors", "has_positional_analogs", "has_formula_isomers",
                    "checkability_score", "overall_checkability", "checkability_level", "noise_risk")


@query("agg27_pattern_hierarchy", f"""WITH p AS (SELECT CASE WHEN p_brand = 'Brand#3' THEN 'other / unclassified' ELSE p_brand END AS broad, p_brand || '/' || p_size AS exact, p_partkey || p_name AS label, p_retailprice AS v FROM part),
g AS (SELECT broad, exact, count(*) AS n, avg(v) AS m, array_to_string(list_sort(list(label))[1:5], '; ') AS ex, count(*) / sum(count(*)) OVER () AS fr FROM p GROUP BY 1, 2)
SELECT broad, exact, n AS group_size, {r('m', 6, 'mean_property')}, ex AS examples, round(CAST(fr AS DOUBLE), 4) AS dataset_fraction, n <= 3 AS rare_group, n <= 2 AS small_group, n = 1 AS singleton_group, broad = 'other / unclassified' AS unclassified_group,
 CASE WHEN broad = 'other / unclassified' THEN 'unclassified' WHEN n = 1 THEN 'singleton' WHEN n <= 2 THEN 'small' ELSE 'rare' END AS reason_flag FROM g WHERE n <= 3 OR broad = 'other / unclassified'""")
def agg27(spark, sf):
    d = table(spark, sf, "part").selectExpr("CASE WHEN p_brand = 'Brand#3' THEN 'other / unclassified' ELSE p_brand END AS broad", "p_brand || '/' || p_size AS exact",
                                            "p_partkey || p_name AS label", "CAST(p_retailprice AS DOUBLE) AS v")
    return rounded(series.pattern_hierarchy(d, "broad", "exact", "label", "v")[1])


# ------------------------------------------------------------------ ordered series over orders
MS_SQL = """ms0 AS (SELECT o_orderkey AS compound_id, 'n' || c_nationkey AS core, o_orderpriority || '/' || o_orderstatus AS variable, c_mktsegment AS variable_family, 'month' AS coordinate_type,
  CAST((year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS DOUBLE) AS coordinate, CAST(c_nationkey % 4 AS DOUBLE) AS complexity, CAST(o_totalprice AS DOUBLE) AS value FROM orders JOIN customer ON o_custkey = c_custkey),
ms AS (SELECT * FROM (SELECT *, 'scaffold::' || core || '::' || variable_family AS series_id, 'scaffold::' || core || '::month' AS series_domain, count(DISTINCT compound_id) OVER (PARTITION BY core, variable_family) AS series_size FROM ms0) WHERE series_size >= 3),
pn AS (SELECT series_id, series_domain, coordinate, max(value) - min(value) AS spread, count(*) AS replicates, avg(complexity) AS complexity, quantile_cont(value, 0.5) AS value FROM ms GROUP BY 1, 2, 3)"""


def memberships(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    f = o.join(c, o.o_custkey == c.c_custkey).selectExpr(
        "o_orderkey AS compound_id", "'n' || c_nationkey AS core", "o_orderpriority || '/' || o_orderstatus AS variable", "c_mktsegment AS variable_family", "'month' AS coordinate_type",
        "CAST((year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS DOUBLE) AS coordinate", "CAST(c_nationkey % 4 AS DOUBLE) AS complexity", "CAST(o_totalprice AS DOUBLE) AS value")
    return series.discover_memberships(f)


@query("agg23_series_memberships", f"WITH {MS_SQL} SELECT series_id, series_domain, 'automatic_scaffold' AS series_source, compound_id, variable, series_size FROM ms")
def agg23(spark, sf):
    return memberships(spark, sf).select("series_id", "series_domain", "series_source", "compound_id", "variable", "series_size")


@query("agg22_series_points", f"WITH {MS_SQL} SELECT series_id, series_domain, coordinate, {r('spread', 4, 'spread')}, replicates, complexity, {r('value', 4, 'value')} FROM pn")
def agg22(spark, sf):
    return rounded(series.series_points(memberships(spark, sf)), 4)


OWN_SQL = f"""{MS_SQL}, o1 AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY series_id) AS n, greatest((max(value) OVER (PARTITION BY series_id) - min(value) OVER (PARTITION BY series_id)) * 0.02, 1e-6) AS fl,
 lag(coordinate) OVER w AS xa, lag(value) OVER w AS ya, lead(coordinate) OVER w AS xb, lead(value) OVER w AS yb, lag(coordinate, 2) OVER w AS xaa, lag(value, 2) OVER w AS yaa, lead(coordinate, 2) OVER w AS xbb, lead(value, 2) OVER w AS ybb
 FROM pn WINDOW w AS (PARTITION BY series_id ORDER BY coordinate)),
o2 AS (SELECT *, (value - ya) / (coordinate - xa) AS step, (yb - value) / (xb - coordinate) AS nstep,
 CASE WHEN xa IS NULL THEN yb + (coordinate - xb) * (ybb - yb) / (xbb - xb) WHEN xb IS NULL THEN yaa + (coordinate - xaa) * (ya - yaa) / (xa - xaa) ELSE ya + (coordinate - xa) * (yb - ya) / (xb - xa) END AS ex FROM o1 WHERE n >= 3),
o3 AS (SELECT *, value - ex AS res FROM o2), {sigma_sql('ss', 'o3', 'series_id', 'step')}, {sigma_sql('rr', 'o3', 'series_id', 'res')},
o4 AS (SELECT o3.*, ss.med AS mstep, abs(step - ss.med) / greatest(ss.sigma, fl) AS sb, abs(nstep - ss.med) / greatest(ss.sigma, fl) AS sa, CASE WHEN xa IS NOT NULL AND xb IS NOT NULL THEN abs(res) / greatest(rr.sigma, fl) END AS rsc
 FROM o3 JOIN ss USING (series_id) JOIN rr USING (series_id)),
o5 AS (SELECT *, greatest(rsc, sb, sa) AS score, CASE WHEN coalesce(rsc >= 3, false) OR coalesce(sb >= 3 AND sa >= 3, false) THEN 'breaks_own_series' ELSE 'consistent' END AS st FROM o4),
ow AS (SELECT series_id, any_value(series_domain) AS series_domain, avg(complexity) AS complexity, any_value(n) AS n_points, min(coordinate) AS coordinate_min, max(coordinate) AS coordinate_max, any_value(mstep) AS median_step,
 coalesce(avg(CASE WHEN step <> 0 AND mstep <> 0 THEN CASE WHEN sign(step) = sign(mstep) THEN 1.0 ELSE 0.0 END END), 0) AS sign_consistency, count(*) FILTER (st <> 'consistent') AS broken_points, coalesce(max(score), 0) AS max_score FROM o5 GROUP BY 1)"""


def own(spark, sf):
    return series.own_series(series.series_points(memberships(spark, sf)))


@query("win6_own_series_summary", f"""WITH {OWN_SQL} SELECT series_id, series_domain, {r('complexity', 4, 'complexity')}, n_points, coordinate_min, coordinate_max, {r('median_step', 4, 'median_step')}, {r('sign_consistency', 4, 'sign_consistency')},
 broken_points, {r('max_score', 4, 'max_score')}, sign_consistency >= 0.75 AND broken_points = 0 AS internally_consistent FROM ow""")
def win6(spark, sf):
    return rounded(own(spark, sf)[0], 4)


@query("win6_own_series_details", f"""WITH {OWN_SQL} SELECT series_id, series_domain, coordinate, {r('value', 7, 'value')}, {r('ex', 7, 'expected')}, {r('res', 7, 'residual')}, CASE WHEN xa IS NULL OR xb IS NULL THEN 'extrapolation' ELSE 'interpolation' END AS method,
 xa IS NULL OR xb IS NULL AS is_endpoint, {r('score', 6, 'score')}, st AS status FROM o5""")
def win6_details(spark, sf):
    return rounded(own(spark, sf)[1], 7, score=6)


@query("win6_own_series_steps", f"""WITH {OWN_SQL} SELECT series_id, xa AS coordinate_from, coordinate AS coordinate_to, {r('value - ya', 4, 'delta')}, {r('step', 4, 'normalized_delta')}, {r('mstep', 4, 'expected_step')}, {r('sb', 4, 'delta_score')},
 CASE WHEN sb >= 3 THEN 'step_break' ELSE 'consistent' END AS edge_status FROM o5 WHERE step IS NOT NULL""")
def win6_steps(spark, sf):
    return rounded(own(spark, sf)[2], 4)


CMP_SQL = f"""{MS_SQL}, j AS (SELECT a.series_domain, a.series_id AS candidate, b.series_id AS reference, coordinate, a.value - b.value AS y FROM pn a JOIN pn b USING (series_domain, coordinate) WHERE a.series_id > b.series_id),
j1 AS (SELECT *, candidate || '#' || reference AS k FROM j WHERE (candidate, reference) IN (SELECT (candidate, reference) FROM j GROUP BY candidate, reference HAVING count(*) >= 3)),
jf AS (SELECT k, count(*) AS n, quantile_cont(y, 0.5) AS md, greatest((max(y) - min(y)) * 0.05, 1e-6) AS fl, CASE WHEN count(*) >= 5 THEN regr_slope(y, coordinate) END AS sl, CASE WHEN count(*) >= 5 THEN regr_intercept(y, coordinate) END AS ic FROM j1 GROUP BY 1),
j2 AS (SELECT j1.*, n, md, fl, y - coalesce(ic + sl * coordinate, md) AS res FROM j1 JOIN jf USING (k)), {sigma_sql('js', 'j2', 'k', 'res')},
j3 AS (SELECT j2.*, abs(res) / greatest(sigma, fl) AS sc FROM j2 JOIN js USING (k))"""


@query("join10_compare_series", f"""WITH {CMP_SQL} SELECT series_domain, candidate, reference, any_value(n) AS n_common, CASE WHEN any_value(n) >= 5 THEN 'linear' ELSE 'median' END AS trend_method, {r('any_value(md)', 4, 'median_delta')},
 {r('max(sc)', 4, 'max_score')}, count(*) FILTER (sc >= 3) AS broken_points, count(*) FILTER (sc >= 3) = 0 AS passed FROM j3 GROUP BY 1, 2, 3""")
def join10(spark, sf):
    p = series.series_points(memberships(spark, sf))
    return rounded(series.compare_series(p, p, 3, F.col("candidate") > F.col("reference"))[0], 4)


def hierarchy_inputs(spark, sf):
    """Points of the steadier series: one value per (segment, nation, year)."""
    m = memberships(spark, sf).withColumns({
        "coordinate": F.floor(F.col("coordinate") / 12).cast("double"), "value": F.col("value") + 2e6 * F.floor(F.col("coordinate") / 12),
        "series_id": F.concat("core", F.lit("::"), "variable_family"), "series_domain": F.col("variable_family")})
    return m, series.series_points(m)


@query("win7_reference_hierarchy")
def win7(spark, sf):
    _, p = hierarchy_inputs(spark, sf)
    return series.reference_hierarchy(p, series.own_series(p)[0])[0]


TR_SQL = f"""{MS_SQL}, tv AS (SELECT series_id, core, variable, quantile_cont(value, 0.5) AS v FROM ms GROUP BY 1, 2, 3),
tp AS (SELECT a.series_id, a.core, a.variable AS variable_a, b.variable AS variable_b, a.variable || '>>' || b.variable AS t, a.v AS va, b.v AS vb, a.v - b.v AS d FROM tv a JOIN tv b USING (series_id) WHERE a.variable < b.variable)"""


@query("join8_transformation_pairs", f"WITH {TR_SQL} SELECT series_id, core, variable_a, variable_b, t AS transformation_id, {r('va', 4, 'value_a')}, {r('vb', 4, 'value_b')}, {r('d', 4, 'delta')} FROM tp")
def join8(spark, sf):
    return rounded(series.transformation_pairs(memberships(spark, sf)), 4)


TR2_SQL = f"""{TR_SQL}, tg AS (SELECT t, count(DISTINCT core) AS nc, count(*) AS np, greatest((max(d) - min(d)) * 0.05, 1e-6) AS fl FROM tp GROUP BY 1 HAVING count(DISTINCT core) >= 3),
t1 AS (SELECT * FROM tp JOIN tg USING (t)), {sigma_sql('ts', 't1', 't', 'd')}, t2 AS (SELECT t1.*, med, abs(d - med) / greatest(sigma, fl) AS sc FROM t1 JOIN ts USING (t))"""


@query("agg24_transformation_rules", f"""WITH {TR2_SQL} SELECT t AS transformation_id, any_value(nc) AS n_contexts, any_value(np) AS n_pairs, {r('any_value(med)', 4, 'median_delta')}, {r('max(sc)', 4, 'max_score')}, count(*) FILTER (sc >= 3) AS broken_contexts FROM t2 GROUP BY 1""")
def agg24(spark, sf):
    return rounded(series.transformation_rules(series.transformation_pairs(memberships(spark, sf), 3))[0], 4)


SUS_SQL = f"""{OWN_SQL}, {TR2_SQL[len(MS_SQL) + 2:]}, {CMP_SQL[len(MS_SQL) + 2:]},
ev AS (SELECT DISTINCT compound_id, 'own' AS kind, score AS sc, 'own' || series_id || '@' || coordinate AS u, 'own series ' || series_id AS tx FROM o5 JOIN ms USING (series_id, coordinate) WHERE st <> 'consistent'
 UNION ALL SELECT DISTINCT compound_id, 'reference', sc, k || '@' || j3.coordinate, k FROM j3 JOIN ms ON ms.series_id = candidate AND ms.coordinate = j3.coordinate WHERE sc >= 3
 UNION ALL SELECT DISTINCT compound_id, 'transformation', sc, t || '@' || ms.series_id || ms.variable, t FROM t2 JOIN ms ON ms.series_id = t2.series_id AND ms.variable IN (variable_a, variable_b) WHERE sc >= 3),
hs AS (SELECT compound_id, count(*) FILTER (kind = 'own') AS own_breaks, count(*) FILTER (kind = 'reference') AS reference_breaks, count(*) FILTER (kind = 'transformation') AS transformation_breaks,
 max(sc) AS max_score, count(*) AS breaks_total, count(DISTINCT kind) AS evidence_types, count(DISTINCT tx) AS distinct_evidence FROM ev GROUP BY 1),
hz AS (SELECT *, CASE WHEN evidence_types >= 3 OR (own_breaks > 0 AND reference_breaks >= 2) THEN 'critically_suspicious' WHEN evidence_types >= 2 OR breaks_total >= 3 THEN 'strongly_suspicious' ELSE 'needs_check' END AS hierarchical_status FROM hs)"""


def suspicion_layers(spark, sf):
    # Every layer reads the memberships again, so they are made once.
    m = stored(memberships(spark, sf))
    p = cut_lineage(series.series_points(m))
    _, od, _ = series.own_series(p)
    _, rd = series.compare_series(p, p, 3, F.col("candidate") > F.col("reference"))
    _, td = series.transformation_rules(series.transformation_pairs(m, 3))
    return m, series.hierarchical_suspicion(m, od, rd, td)


@query("agg25_hierarchical_suspicion", f"WITH {SUS_SQL} SELECT * EXCLUDE (max_score), {r('max_score', 4, 'max_score')} FROM hz")
def agg25(spark, sf):
    return rounded(suspicion_layers(spark, sf)[1], 4)


REF_SQL = "SELECT 'scaffold::n' || n || '::BUILDING' AS series_id FROM (SELECT unnest([1, 2, 3]) AS n)"
UC_SQL = f"""{MS_SQL}, rf AS ({REF_SQL}), uc AS (SELECT compound_id, count(DISTINCT series_id) AS n_series, count(*) FILTER (series_id IN (FROM rf)) AS n_reference, max(series_size) AS series_size FROM ms GROUP BY 1),
uz AS (SELECT *, CASE WHEN n_reference >= 2 THEN 7 WHEN n_reference = 1 THEN 5 WHEN n_series >= 2 THEN 3 ELSE 1 END AS s FROM uc)"""


def fixed_hierarchy(spark, sf):
    """Reference verdicts derived from the nation keys of the customer table."""
    return table(spark, sf, "customer").where("c_nationkey IN (1, 2, 3) AND c_mktsegment = 'BUILDING'").selectExpr(
        "'scaffold::n' || c_nationkey || '::' || c_mktsegment AS series_id", "'base_reference' AS reference_status").distinct()


@query("agg21_universal_checkability", f"""WITH {UC_SQL} SELECT compound_id, n_series, n_reference, series_size, CAST(s AS INTEGER) AS checkability_score, CASE s WHEN 7 THEN 'well_checkable' WHEN 5 THEN 'moderately_checkable' WHEN 3 THEN 'weakly_checkable' ELSE 'hardly_checkable' END AS overall_checkability,
 CASE s WHEN 7 THEN 'low' WHEN 5 THEN 'moderate' WHEN 3 THEN 'raised' ELSE 'high' END AS noise_risk FROM uz""")
def agg21(spark, sf):
    m = memberships(spark, sf)
    return series.universal_checkability(m, m, fixed_hierarchy(spark, sf))


BASE_STATUS = "CASE o_orderkey % 5 WHEN 0 THEN 'needs_check' WHEN 1 THEN 'consistent' WHEN 2 THEN 'critically_suspicious' END"


@query("join18_merge_suspicion", f"""WITH {SUS_SQL}, {UC_SQL[len(MS_SQL) + 2:]}, bs AS (SELECT o_orderkey AS compound_id, {BASE_STATUS} AS status FROM orders),
rk AS (SELECT * FROM (VALUES ('consistent', 0), ('needs_check', 1), ('strongly_suspicious', 2), ('critically_suspicious', 3)) t(s, p))
SELECT compound_id, coalesce(CASE WHEN coalesce(a.p, -1) >= coalesce(b.p, -1) THEN status ELSE hierarchical_status END, CASE WHEN n_reference > 0 THEN 'consistent' ELSE 'hardly_checkable' END) AS final_status
FROM bs LEFT JOIN hz USING (compound_id) LEFT JOIN uz USING (compound_id) LEFT JOIN rk a ON a.s = status LEFT JOIN rk b ON b.s = hierarchical_status""")
def join18(spark, sf):
    m, hier = suspicion_layers(spark, sf)
    base = table(spark, sf, "orders").selectExpr("o_orderkey AS compound_id", f"{BASE_STATUS} AS status")
    check = series.universal_checkability(m, m, fixed_hierarchy(spark, sf))
    return series.merge_suspicion(base.select("compound_id"), base, hier, check).select("compound_id", "final_status")


@query("agg26_consistency_summary", f"""WITH {OWN_SQL} SELECT 'rows_total' AS indicator, count(*) AS value FROM orders UNION ALL SELECT 'rows_valid', count(*) FILTER (o_totalprice > 0) FROM orders
 UNION ALL SELECT 'series_found', count(DISTINCT series_id) FROM ms UNION ALL SELECT 'series_consistent', count(*) FILTER (sign_consistency >= 0.75 AND broken_points = 0) FROM ow UNION ALL SELECT 'own_breaks', CAST(sum(broken_points) AS BIGINT) FROM ow""")
def agg26(spark, sf):
    m = memberships(spark, sf)
    s = series.own_series(series.series_points(m))[0]
    return series.consistency_summary(
        rows=(table(spark, sf, "orders"), {"rows_total": F.count("*"), "rows_valid": F.count_if(F.col("o_totalprice") > 0)}),
        found=(m, {"series_found": F.count_distinct("series_id")}),
        own=(s, {"series_consistent": F.count_if("internally_consistent"), "own_breaks": F.sum("broken_points")}))
