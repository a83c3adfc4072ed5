"""Consistency of values across patterns, ordered series and repeated transformations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvida.functions.columns import blank_to_null, ratio
from corvida.functions.labels import consistency_level, pattern_family
from corvida.functions.ranks import bounded_groups, exact_quantiles, robust_sigma, with_neighbours, with_position
from corvida.operators.differences import BLOCK, median_difference
from corvida.session import cut_lineage

BREAK_SCORE = 3.0
# The three statuses that mark a broken edge.
BROKEN = ("breaks_sign_and_trend", "breaks_sign", "breaks_smoothness")


def duplicate_flags(df: DataFrame, canonical: str, value: str) -> DataFrame:
    """Mark rows whose canonical id repeats, and repeats that disagree by more than 1e-9."""
    key = df.withColumn("_k", blank_to_null(canonical))
    agg = key.where("_k IS NOT NULL").groupBy("_k").agg(
        F.count("*").alias("_n"), F.count(value).alias("_v"), (F.max(value) - F.min(value)).alias("_range"))
    return key.join(agg, "_k", "left").withColumns({
        "duplicate_structure": F.coalesce(F.col("_n") > 1, F.lit(False)),
        "duplicate_conflict": F.coalesce((F.col("_v") > 1) & (F.col("_range") > 1e-9), F.lit(False)),
    }).drop("_k", "_n", "_v", "_range")


# ---------------------------------------------------------------- pattern edges

def pattern_points(df: DataFrame, formula: str, pattern: str, value: str) -> DataFrame:
    """One row per (formula, pattern): the unit that edges connect."""
    ok = df.where(F.col(value).isNotNull() & (F.col(pattern) != "") & F.col(formula).isNotNull())
    return ok.groupBy(F.col(formula).alias("formula"), F.col(pattern).alias("pattern")).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))


def pattern_edges(points: DataFrame, base_pattern: str = "n-alkane", min_formulas: int = 1) -> DataFrame:
    """Edges a < b between the patterns of a formula, with the exact size, mean and range of the differences.

    The sums and ranges of the two points give these without listing member pairs. With
    ``min_formulas`` patterns seen in fewer formulas are left out first: no edge of theirs can
    reach that many formulas.
    """
    if min_formulas > 1:
        often = points.groupBy("pattern").agg(F.count("*").alias("k")).where(F.col("k") >= min_formulas).select("pattern")
        points = points.join(often, "pattern", "left_semi")
    a = points.select("formula", *[F.col(c).alias(f"{c}_a") for c in ("pattern", "n", "total", "low", "high")])
    b = points.select("formula", *[F.col(c).alias(f"{c}_b") for c in ("pattern", "n", "total", "low", "high")])
    e = a.join(b, "formula").where("pattern_a < pattern_b")
    fa, fb = pattern_family("pattern_a"), pattern_family("pattern_b")
    return e.select(
        F.concat("pattern_a", F.lit(" minus "), "pattern_b").alias("edge_label"), "formula", "pattern_a", "pattern_b",
        "n_a", "n_b", (F.col("n_a") * F.col("n_b")).alias("n_pairs"),
        (F.col("total_a") / F.col("n_a") - F.col("total_b") / F.col("n_b")).alias("mean_delta"),
        (F.col("low_a") - F.col("high_b")).alias("min_delta"), (F.col("high_a") - F.col("low_b")).alias("max_delta"),
        ((F.col("pattern_a") == base_pattern) | (F.col("pattern_b") == base_pattern)).alias("is_base_edge"),
        (fa == fb).alias("same_family"))


def edge_medians(edges: DataFrame, df: DataFrame, formula: str, pattern: str, value: str, block: int = BLOCK) -> DataFrame:
    """(edge_label, formula, median_delta): exact median of the member differences of every edge, in n_a + n_b values per edge
    and round instead of n_a * n_b (see :mod:`corvida.operators.differences`)."""
    side = lambda s: F.struct(F.col("formula"), F.col(f"pattern_{s}").alias("pattern")).alias(s)
    groups = df.select(F.col(formula).alias("formula"), F.col(pattern).alias("pattern"), F.col(value).alias("v")).where("formula IS NOT NULL AND pattern IS NOT NULL")
    med = median_difference(edges.select("edge_label", side("a"), side("b"), "n_pairs"), groups, ["formula", "pattern"], "v", block)
    return med.select("edge_label", "a.formula", F.col("median").alias("median_delta"))


def edge_table(df: DataFrame, formula: str, pattern: str, value: str, coordinate: str | None = None,
               min_formulas: int = 1) -> DataFrame:
    """One row per (edge, formula) with the median difference, its spread and an ambiguity flag."""
    edges = cut_lineage(pattern_edges(pattern_points(df, formula, pattern, value), min_formulas=min_formulas))
    med = edge_medians(edges, df, formula, pattern, value)
    out = edges.join(med, ["edge_label", "formula"]).withColumns({
        "delta_spread": F.col("max_delta") - F.col("min_delta"), "ambiguous": F.col("n_pairs") > 1})
    if coordinate and coordinate != formula:
        pos = df.groupBy(F.col(formula).alias("formula")).agg(F.first(coordinate).alias("coordinate"))
        return out.join(pos, "formula")
    return out.withColumn("coordinate", F.col("formula").cast("double"))


def _fit_trend(df: DataFrame, keys: Sequence[str], x: str, y: str, bounded: bool) -> DataFrame:
    """Per key: median below five points, least-squares line from five on."""
    line = df.groupBy(*keys).agg(
        F.count("*").alias("n_points"), F.avg(y).alias("mean_delta"), F.min(x).alias("x_min"), F.max(x).alias("x_max"),
        F.regr_slope(y, x).alias("_slope"), F.regr_intercept(y, x).alias("_icpt"))
    med = exact_quantiles(df, keys, y, {"median_delta": 0.5}, bounded=bounded)
    lin = (F.col("n_points") >= 5) & (F.col("x_min") < F.col("x_max"))
    return line.join(med, list(keys)).withColumns({
        "trend_method": F.when(lin, "linear").otherwise("median"), "trend_slope": F.when(lin, F.col("_slope"))})


def discover_rules(edges: DataFrame, min_points: int = 3) -> tuple[DataFrame, DataFrame]:
    """(rules, details): direction, sign stability, smoothness and breaks of every edge over its formulas."""
    key = ["edge_label"]
    e = edges.select("edge_label", "formula", "coordinate", "pattern_a", "pattern_b", F.col("median_delta").alias("y"))
    often = e.groupBy("edge_label").agg(F.count("*").alias("_k")).where(F.col("_k") >= min_points).select("edge_label")
    e = cut_lineage(e.join(often, key, "left_semi"))
    small = bounded_groups(e, key)
    fit = _fit_trend(e, key, "coordinate", "y", small)
    d = e.join(fit, key)
    pred = F.when(F.col("trend_method") == "linear", F.col("_icpt") + F.col("_slope") * F.col("coordinate")).otherwise(F.col("median_delta"))
    d = d.withColumn("expected_delta", pred).withColumn("delta_residual", F.col("y") - F.col("expected_delta"))
    d = cut_lineage(d.join(robust_sigma(d, key, "delta_residual", "_rs", small).select("edge_label", "_rs"), key))
    d = with_neighbours(with_position(d, key, "coordinate", "pos", bounded=small), key, "pos", ["y", "formula"], [-1], small)
    d = d.withColumn("delta_change", F.col("y") - F.col("y_m1")).withColumnRenamed("y_m1", "previous_delta").withColumnRenamed("formula_m1", "previous_formula")
    d = d.join(robust_sigma(d, key, "delta_change", "_cs", small).select("edge_label", F.col("median").alias("_cm"), "_cs"), key, "left")
    change = F.when(F.col("delta_change").isNotNull(),
                    F.when(F.col("_cs") > 1e-12, F.abs(F.col("delta_change") - F.col("_cm")) / F.col("_cs")).otherwise(0.0))
    main = F.signum("median_delta")
    d = d.withColumns({"residual_score": F.abs("delta_residual") / F.col("_rs"), "change_score": change, "main_sign": main})
    d = d.withColumn("combined_score", F.greatest("residual_score", F.coalesce("change_score", F.lit(0.0))))
    d = d.withColumn("sign_break", (F.col("main_sign") != 0) & (F.col("y") != 0) & (F.signum("y") != F.col("main_sign")))
    rough = F.col("combined_score") >= BREAK_SCORE
    d = d.withColumn("edge_status", F.when(F.col("sign_break") & rough, BROKEN[0]).when(F.col("sign_break"), BROKEN[1])
                     .when(rough, BROKEN[2]).otherwise("consistent")).withColumn("edge_level", consistency_level("combined_score"))
    nonzero = F.col("y") != 0
    rules = d.groupBy("edge_label").agg(
        *[F.first(c).alias(c) for c in ("pattern_a", "pattern_b", "n_points", "x_min", "x_max", "mean_delta", "median_delta", "trend_slope", "trend_method", "main_sign")],
        F.when((F.count_if(nonzero) > 0) & (F.first("main_sign") != 0),
               F.avg(F.when(nonzero, F.when(F.signum("y") == F.col("main_sign"), 1.0).otherwise(0.0)))).otherwise(0.0).alias("sign_consistency"),
        F.max("combined_score").alias("max_score"), F.count_if(F.col("edge_status") != "consistent").alias("break_count"),
        F.count_if("sign_break").alias("sign_break_count"))
    status = (F.when(F.col("sign_consistency") < 0.7, "unstable_direction")
              .when((F.col("break_count") == 0) & (F.col("max_score") < 2), "stable_rule")
              .when((F.col("break_count") == 0) & (F.col("max_score") < 3), "preliminary_rule")
              .when(F.col("break_count") > 0, "rule_with_breaks").otherwise("weak_rule"))
    rules = rules.withColumn("rule_status", status).withColumns({
        "usable": F.col("rule_status").isin("stable_rule", "preliminary_rule", "rule_with_breaks"),
        "direction": F.when(F.col("main_sign") > 0, "above").when(F.col("main_sign") < 0, "below").otherwise("near_zero")})
    details = d.select("edge_label", "formula", "coordinate", "pattern_a", "pattern_b", F.col("y").alias("delta"), "expected_delta",
                       "delta_residual", "delta_change", "residual_score", "change_score", "combined_score", "edge_level",
                       "sign_break", "edge_status", "previous_formula", "previous_delta")
    return rules, details


def broken_edges(details: DataFrame) -> DataFrame:
    """Only the broken edges, worst first."""
    return details.where(F.col("edge_status").isin(*BROKEN)).orderBy(F.col("combined_score").desc_nulls_last())


def change_wording(details: DataFrame) -> DataFrame:
    """Change to the previous point in words."""
    d, c = F.col("delta"), F.col("delta_change")
    num = lambda v: F.format_string("%.3f", F.abs(v))
    first = F.when(d > 0, F.concat("pattern_a", F.lit(" above "), "pattern_b", F.lit(" by "), num(d))).when(
        d < 0, F.concat("pattern_b", F.lit(" above "), "pattern_a", F.lit(" by "), num(d))).otherwise(
        F.concat("pattern_a", F.lit(" equals "), "pattern_b"))
    second = F.when(c.isNull(), "; first point").when(c > 0, F.concat(F.lit("; increased by "), num(c))).when(
        c < 0, F.concat(F.lit("; decreased by "), num(c))).otherwise("; unchanged")
    return details.withColumn("observation", F.concat(first, second))


def point_suspicion(points: DataFrame, broken: DataFrame) -> DataFrame:
    """Per (formula, pattern) point: edges, broken edges, worst score, broken labels and status.

    A point has one edge to every other pattern of its formula, so the total needs no edge list.
    """
    total = points.join(points.groupBy("formula").agg((F.count("*") - 1).alias("edges_total")), "formula").where("edges_total > 0")
    sides = F.explode(F.array("pattern_a", "pattern_b")).alias("pattern")
    bad = broken.select("formula", sides, "edge_label", "combined_score").groupBy("formula", "pattern").agg(
        F.count("*").alias("edges_broken"), F.max("combined_score").alias("max_score"),
        F.array_join(F.array_sort(F.collect_set("edge_label")), "; ").alias("broken_labels"))
    out = total.select("formula", "pattern", "edges_total").join(bad, ["formula", "pattern"], "left").na.fill(
        {"edges_broken": 0, "max_score": 0.0, "broken_labels": ""})
    b, m = F.col("edges_broken"), F.col("max_score")
    status = (F.when(F.col("edges_total") < 2, "hardly_checkable").when(b == 0, "consistent")
              .when((b >= 3) | (m >= 6), "critically_suspicious").when((b >= 2) | (m >= 4), "strongly_suspicious").otherwise("needs_check"))
    return out.withColumns({"broken_fraction": ratio(b, "edges_total"), "status": status})


def checkability(df: DataFrame, formula: str, pattern: str, carbon: str) -> DataFrame:
    """Row-level check support: own-series size, isomers, +-1 neighbours and positional analogues."""
    d = df.withColumn("_fam", pattern_family(pattern))
    by_pattern = d.groupBy(pattern).agg(F.count("*").alias("series_size"))
    by_formula = d.groupBy(formula).agg(F.count("*").alias("formula_group_size"))
    analog = d.groupBy(formula, "_fam").agg((F.count_distinct(pattern) > 1).alias("has_positional_analogs"))
    near = d.select(pattern, F.explode(F.array(F.col(carbon) - 1, F.col(carbon) + 1)).alias(carbon)).distinct().withColumn("_near", F.lit(True))
    d = d.join(by_pattern, pattern).join(by_formula, formula).join(analog, [formula, "_fam"]).join(near, [pattern, carbon], "left")
    s, f, n = F.col("series_size"), F.col("formula_group_size"), F.coalesce("_near", F.lit(False))
    score = (F.when(s >= 4, 2).when(s >= 2, 1).otherwise(0) + F.when(f >= 8, 3).when(f >= 4, 2).when(f >= 2, 1).otherwise(0)
             + F.when(n, 1).otherwise(0) + F.when(F.col("has_positional_analogs"), 2).otherwise(0))
    overall = (F.when((s >= 4) & (f >= 4), "well_checkable").when(s >= 4, "well_checkable_by_series")
               .when((s == 1) & (f >= 4), "unique_but_checkable_by_formula").when((s == 1) & (f >= 2), "unique_partly_checkable_by_formula")
               .when((s >= 2) & (f >= 2), "moderately_checkable").when((f == 1) & (s == 1), "hardly_checkable").otherwise("weakly_checkable"))
    d = d.withColumns({
        "has_same_pattern_neighbors": n, "has_formula_isomers": f >= 2,
        "series_checkability": F.when(s >= 4, "good_series").when((s >= 2) & n, "short_series_with_neighbors").when(s >= 2, "short_series").otherwise("unique_pattern"),
        "formula_checkability": F.when(f >= 8, "good_isomers").when(f >= 4, "some_isomers").when(f >= 2, "few_isomers").otherwise("no_isomers"),
        "overall_checkability": overall, "checkability_score": score,
    })
    o = F.col("overall_checkability")
    return d.withColumns({
        "checkability_level": F.when(score >= 7, "well_checkable").when(score >= 5, "moderately_checkable").when(score >= 3, "weakly_checkable").otherwise("hardly_checkable"),
        "noise_risk": F.when(o.isin("well_checkable", "well_checkable_by_series"), "low")
        .when(o.isin("moderately_checkable", "unique_but_checkable_by_formula"), "moderate")
        .when(o.isin("unique_partly_checkable_by_formula", "weakly_checkable"), "raised").otherwise("high"),
    }).drop("_fam", "_near")


# ---------------------------------------------------------------- ordered series

def discover_memberships(fragments: DataFrame, min_points: int = 3, profile: DataFrame | None = None) -> DataFrame:
    """Series memberships from (core, variable, variable_family, coordinate_type, coordinate, complexity, compound_id, value).

    A core needs ``min_points`` distinct compounds, and so does each resulting series.
    ``profile`` adds ready (series_id, series_domain, ...) rows from a structural profile.
    """
    f = fragments.dropDuplicates(["core", "variable", "compound_id"])
    cores = f.groupBy("core").agg(F.count_distinct("compound_id").alias("k")).where(F.col("k") >= min_points).select("core")
    m = f.join(cores, "core", "left_semi").withColumns({
        "series_source": F.lit("automatic_scaffold"),
        "series_id": F.concat(F.lit("scaffold::"), "core", F.lit("::"), "variable_family"),
        "series_domain": F.concat(F.lit("scaffold::"), "core", F.lit("::"), "coordinate_type")})
    if profile is not None:
        m = m.unionByName(profile.withColumn("series_source", F.lit("graph_profile")), allowMissingColumns=True)
    m = m.dropDuplicates(["series_id", "compound_id", "variable"])
    size = m.groupBy("series_id").agg(F.count_distinct("compound_id").alias("series_size"))
    return m.join(size.where(F.col("series_size") >= min_points), "series_id")


def series_points(memberships: DataFrame) -> DataFrame:
    """One point per (series, coordinate): median value, spread and replicate count."""
    key = ["series_id", "series_domain", "coordinate"]
    m = memberships.where("coordinate IS NOT NULL AND value IS NOT NULL")
    base = m.groupBy(*key).agg((F.max("value") - F.min("value")).alias("spread"), F.count("*").alias("replicates"),
                               F.avg("complexity").alias("complexity"))
    return base.join(exact_quantiles(m, key, "value", {"value": 0.5}, bounded=bounded_groups(m, key)), key)


def own_series(points: DataFrame, min_points: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, details, steps): steps against the median step, points against their local line."""
    key = ["series_id"]
    points = cut_lineage(points)
    small = bounded_groups(points, key)
    size = points.groupBy("series_id").agg(
        F.count("*").alias("n_points"), F.min("coordinate").alias("coordinate_min"), F.max("coordinate").alias("coordinate_max"),
        F.greatest((F.max("value") - F.min("value")) * 0.02, F.lit(1e-6)).alias("_floor"),
        F.first("series_domain").alias("series_domain"), F.avg("complexity").alias("complexity")).where(F.col("n_points") >= min_points)
    p = points.select("series_id", F.col("coordinate").alias("x"), F.col("value").alias("y")).join(size, key)
    p = cut_lineage(with_neighbours(with_position(p, key, "x", "pos", bounded=small), key, "pos", ["x", "y"], [-2, -1, 1, 2], small))
    p = p.withColumn("step", (F.col("y") - F.col("y_m1")) / (F.col("x") - F.col("x_m1")))
    steps = p.where("step IS NOT NULL")
    sg = robust_sigma(steps, key, "step", "_s", small).select("series_id", F.col("median").alias("median_step"), "_s")
    p = p.join(sg, key).withColumn("_ds", F.greatest("_s", "_floor"))
    first, last = F.col("y_m1").isNull(), F.col("y_p1").isNull()
    x0 = F.when(first, F.col("x_p1")).when(last, F.col("x_m2")).otherwise(F.col("x_m1"))
    y0 = F.when(first, F.col("y_p1")).when(last, F.col("y_m2")).otherwise(F.col("y_m1"))
    x1 = F.when(first, F.col("x_p2")).when(last, F.col("x_m1")).otherwise(F.col("x_p1"))
    y1 = F.when(first, F.col("y_p2")).when(last, F.col("y_m1")).otherwise(F.col("y_p1"))
    p = p.withColumns({"expected": y0 + (F.col("x") - x0) * (y1 - y0) / (x1 - x0), "is_endpoint": first | last})
    p = cut_lineage(p.withColumn("residual", F.col("y") - F.col("expected")))
    rs = robust_sigma(p, key, "residual", "_r", small).select("series_id", "_r")
    p = p.join(rs, key).withColumn("_rs", F.greatest("_r", "_floor"))
    next_step = (F.col("y_p1") - F.col("y")) / (F.col("x_p1") - F.col("x"))
    p = p.withColumns({
        "score_before": F.abs(F.col("step") - F.col("median_step")) / F.col("_ds"),
        "score_after": F.abs(next_step - F.col("median_step")) / F.col("_ds"),
        "residual_score": F.when(~F.col("is_endpoint"), F.abs("residual") / F.col("_rs"))})
    broken = (F.coalesce(F.col("residual_score") >= BREAK_SCORE, F.lit(False))
              | F.coalesce((F.col("score_before") >= BREAK_SCORE) & (F.col("score_after") >= BREAK_SCORE), F.lit(False)))
    p = p.withColumns({"score": F.greatest("residual_score", "score_before", "score_after"),
                       "status": F.when(broken, "breaks_own_series").otherwise("consistent")})
    sign = F.signum("step")
    summary = p.groupBy("series_id").agg(
        *[F.first(c).alias(c) for c in ("series_domain", "complexity", "n_points", "coordinate_min", "coordinate_max", "median_step")],
        F.coalesce(F.when(F.signum(F.first("median_step")) != 0,
                          F.avg(F.when(sign != 0, F.when(sign == F.signum("median_step"), 1.0).otherwise(0.0)))), F.lit(0.0)).alias("sign_consistency"),
        F.count_if(F.col("status") != "consistent").alias("broken_points"), F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"))
    summary = summary.withColumn("internally_consistent", (F.col("sign_consistency") >= 0.75) & (F.col("broken_points") == 0))
    details = p.select("series_id", "series_domain", F.col("x").alias("coordinate"), F.col("y").alias("value"), "expected", "residual",
                       F.when(F.col("is_endpoint"), "extrapolation").otherwise("interpolation").alias("method"), "is_endpoint", "score", "status")
    edges = p.where("step IS NOT NULL").select(
        "series_id", F.col("x_m1").alias("coordinate_from"), F.col("x").alias("coordinate_to"), (F.col("y") - F.col("y_m1")).alias("delta"),
        F.col("step").alias("normalized_delta"), F.col("median_step").alias("expected_step"), F.col("score_before").alias("delta_score"),
        F.when(F.col("score_before") >= BREAK_SCORE, "step_break").otherwise("consistent").alias("edge_status"))
    return summary, details, edges


def compare_series(candidates: DataFrame, references: DataFrame, min_points: int = 3, condition: Column | None = None
                   ) -> tuple[DataFrame, DataFrame]:
    """(summary, details) of candidate-minus-reference differences on common coordinates of a domain."""
    c = candidates.select("series_domain", "coordinate", F.col("series_id").alias("candidate"), F.col("value").alias("cv"),
                          *[F.col(x).alias(f"c_{x}") for x in candidates.columns if x.startswith("_")])
    b = references.select("series_domain", "coordinate", F.col("series_id").alias("reference"), F.col("value").alias("rv"),
                          *[F.col(x).alias(f"r_{x}") for x in references.columns if x.startswith("_")])
    j = c.join(b, ["series_domain", "coordinate"]).where(F.col("candidate") != F.col("reference"))
    if condition is not None:
        j = j.where(condition)
    key = ["series_domain", "candidate", "reference"]
    j = j.select(*key, "coordinate", "cv", "rv", (F.col("cv") - F.col("rv")).alias("y"))
    often = j.groupBy(*key).agg(F.count("*").alias("_k")).where(F.col("_k") >= min_points).select(*key)
    j = cut_lineage(j.join(often, key, "left_semi"))
    small = bounded_groups(j, key)
    fit = _fit_trend(j, key, "coordinate", "y", small)
    spread = j.groupBy(*key).agg(F.greatest((F.max("y") - F.min("y")) * 0.05, F.lit(1e-6)).alias("_floor"))
    d = j.join(fit, key).join(spread, key)
    d = d.withColumn("expected_delta", F.when(F.col("trend_method") == "linear", F.col("_icpt") + F.col("_slope") * F.col("coordinate"))
                     .otherwise(F.col("median_delta"))).withColumn("delta_residual", F.col("y") - F.col("expected_delta"))
    d = d.join(robust_sigma(d, key, "delta_residual", "_s", small).select(*key, "_s"), key)
    d = d.withColumn("score", F.abs("delta_residual") / F.greatest("_s", "_floor"))
    broken = F.col("score") >= BREAK_SCORE
    details = d.select(*key, "coordinate", F.col("cv").alias("candidate_value"), F.col("rv").alias("reference_value"), F.col("y").alias("delta"),
                       "expected_delta", "delta_residual", "score", F.when(broken, "breaks_reference").otherwise("consistent").alias("status"))
    summary = d.groupBy(*key).agg(F.first("n_points").alias("n_common"), F.first("trend_method").alias("trend_method"),
                                  F.first("median_delta").alias("median_delta"), F.max("score").alias("max_score"),
                                  F.count_if(broken).alias("broken_points")).withColumn("passed", F.col("broken_points") == 0)
    return summary, details


def reference_hierarchy(points: DataFrame, own: DataFrame, min_points: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hierarchy, comparisons, details): admit series as references in order of simplicity.

    A series joins when at least half of its tests against earlier references pass. Every round
    settles all series whose verdict no longer depends on undecided ones, so the number of
    rounds follows the dependency depth, and the first undecided series always settles.
    """
    ok = own.where("internally_consistent")
    order = F.struct(F.col("complexity").alias("a"), (-F.col("n_points")).alias("b"), F.col("series_id").alias("c"))
    ok = ok.select("series_domain", "series_id", order.alias("_o"))
    base = ok.groupBy("series_domain").agg(F.min("_o").alias("_first"))
    pts = points.select("series_domain", "series_id", "coordinate", "value").join(ok, ["series_domain", "series_id"])
    comp, det = compare_series(pts, pts, min_points, F.col("c__o") > F.col("r__o"))
    comp = cut_lineage(comp)
    state = cut_lineage(ok.join(base, "series_domain").select(
        "series_domain", "series_id", "_o", F.when(F.col("_o") == F.col("_first"), F.lit(True)).alias("admitted"), (F.col("_o") == F.col("_first")).alias("is_base")))
    verdict = state.select("series_domain", F.col("series_id").alias("reference"), F.col("admitted").alias("ref_in"))

    def tallies(verdict):
        t = comp.join(verdict, ["series_domain", "reference"])
        known, open_ = F.col("ref_in").isNotNull() & F.col("ref_in"), F.col("ref_in").isNull()
        return t.groupBy("series_domain", F.col("candidate").alias("series_id")).agg(
            F.count_if(known).alias("t0"), F.count_if(known & F.col("passed")).alias("p0"),
            F.count_if(open_ & F.col("passed")).alias("p1"), F.count_if(open_ & ~F.col("passed")).alias("f1"))

    while not state.where("admitted IS NULL").isEmpty():
        s = state.join(tallies(verdict), ["series_domain", "series_id"], "left").na.fill(0, ["t0", "p0", "p1", "f1"])
        need = lambda t: F.greatest(F.lit(1), F.ceil(t / 2))
        yes = F.col("p0") >= need(F.col("t0") + F.col("f1"))
        no = F.col("p0") + F.col("p1") < need(F.col("t0") + F.col("p1"))
        settled = F.when(F.col("admitted").isNotNull(), F.col("admitted")).when(yes, True).when(no, False)
        state = cut_lineage(s.select("series_domain", "series_id", "_o", settled.alias("admitted"), "is_base"))
        verdict = state.select("series_domain", F.col("series_id").alias("reference"), F.col("admitted").alias("ref_in"))
    t = tallies(verdict).select("series_domain", "series_id", F.col("t0").alias("tested"), F.col("p0").alias("passed"))
    used = comp.join(verdict.where("ref_in"), ["series_domain", "reference"], "left_semi")
    level = F.row_number().over(Window.partitionBy("series_domain").orderBy("_o"))
    lv = state.where("admitted").select("series_domain", "series_id", level.alias("reference_level"))
    h = state.join(t, ["series_domain", "series_id"], "left").join(lv, ["series_domain", "series_id"], "left").na.fill(0, ["tested", "passed"])
    status = (F.when(F.col("is_base"), "base_reference").when(F.col("admitted"), "confirmed_reference")
              .when(F.col("tested") == 0, "no_overlap").otherwise("not_confirmed"))
    h = h.select("series_domain", "series_id", "reference_level", status.alias("reference_status"), "tested", "passed")
    rejected = own.where(~F.col("internally_consistent")).select(
        "series_domain", "series_id", F.lit(None).cast("int").alias("reference_level"), F.lit("rejected_by_own_series").alias("reference_status"),
        F.lit(0).cast("bigint").alias("tested"), F.lit(0).cast("bigint").alias("passed"))
    return h.unionByName(rejected), used, det.join(used.select("series_domain", "candidate", "reference"), ["series_domain", "candidate", "reference"], "left_semi")


# ---------------------------------------------------------------- transformations

def transformation_pairs(memberships: DataFrame, min_contexts: int = 1) -> DataFrame:
    """va >> vb differences between the variables of a series (one value per series and variable).

    Variables present in fewer than ``min_contexts`` cores are left out first; no transformation
    of theirs can reach that many contexts.
    """
    m = memberships.where("value IS NOT NULL")
    if min_contexts > 1:
        often = m.groupBy("variable").agg(F.count_distinct("core").alias("k")).where(F.col("k") >= min_contexts).select("variable")
        m = m.join(often, "variable", "left_semi")
    unit = ["series_id", "core", "variable"]
    v = cut_lineage(exact_quantiles(m, unit, "value", {"value": 0.5}, bounded=bounded_groups(m, unit)))
    a = v.select("series_id", "core", F.col("variable").alias("variable_a"), F.col("value").alias("value_a"))
    b = v.select("series_id", F.col("variable").alias("variable_b"), F.col("value").alias("value_b"))
    return a.join(b, "series_id").where("variable_a < variable_b").withColumns({
        "transformation_id": F.concat("variable_a", F.lit(">>"), "variable_b"), "delta": F.col("value_a") - F.col("value_b")})


def transformation_rules(pairs: DataFrame, min_contexts: int = 3) -> tuple[DataFrame, DataFrame]:
    """(rules, details) of transformations repeated over enough distinct cores."""
    key = ["transformation_id"]
    g = pairs.groupBy(*key).agg(F.count_distinct("core").alias("n_contexts"), F.count("*").alias("n_pairs"),
                                F.greatest((F.max("delta") - F.min("delta")) * 0.05, F.lit(1e-6)).alias("_floor"))
    p = cut_lineage(pairs.join(g.where(F.col("n_contexts") >= min_contexts), key))
    p = p.join(robust_sigma(p, key, "delta", "_s", bounded_groups(p, key)).select("transformation_id", F.col("median").alias("median_delta"), "_s"), key)
    p = p.withColumn("score", F.abs(F.col("delta") - F.col("median_delta")) / F.greatest("_s", "_floor"))
    broken = F.col("score") >= BREAK_SCORE
    details = p.withColumn("status", F.when(broken, "breaks_transformation").otherwise("consistent")).drop("_s", "_floor")
    rules = p.groupBy(*key).agg(F.first("n_contexts").alias("n_contexts"), F.first("n_pairs").alias("n_pairs"), F.first("median_delta").alias("median_delta"),
                                F.max("score").alias("max_score"), F.count_if(broken).alias("broken_contexts"))
    return rules, details


# ---------------------------------------------------------------- suspicion

def hierarchical_suspicion(memberships: DataFrame, own_details: DataFrame, reference_details: DataFrame, transformation_details: DataFrame) -> DataFrame:
    """Per compound: broken evidence of the three kinds, independent kinds and a status."""
    member = memberships.select("series_id", "coordinate", "compound_id").distinct()
    var = memberships.select("series_id", "variable", "compound_id").distinct()
    own = own_details.where("status = 'breaks_own_series'").select("series_id", "coordinate", "score", F.concat(F.lit("own series "), "series_id").alias("text"))
    ref = reference_details.where("status = 'breaks_reference'").select(
        F.col("candidate").alias("series_id"), "coordinate", "score", F.concat("candidate", F.lit(" against "), "reference").alias("text"))
    tr = transformation_details.where("status = 'breaks_transformation'").select(
        "series_id", F.explode(F.array("variable_a", "variable_b")).alias("variable"), "score", F.concat(F.lit("transformation "), "transformation_id").alias("text"))
    pick = ["compound_id", "kind", "score", "text"]
    ev = (own.join(member, ["series_id", "coordinate"]).withColumn("kind", F.lit("own")).select(*pick)
          .unionByName(ref.join(member, ["series_id", "coordinate"]).withColumn("kind", F.lit("reference")).select(*pick))
          .unionByName(tr.join(var, ["series_id", "variable"]).withColumn("kind", F.lit("transformation")).select(*pick)))
    g = ev.groupBy("compound_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}_breaks") for k in ("own", "reference", "transformation")],
        F.max("score").alias("max_score"), F.count("*").alias("breaks_total"), F.count_distinct("kind").alias("evidence_types"),
        F.count_distinct("text").alias("distinct_evidence"))
    status = (F.when((F.col("evidence_types") >= 3) | ((F.col("own_breaks") > 0) & (F.col("reference_breaks") >= 2)), "critically_suspicious")
              .when((F.col("evidence_types") >= 2) | (F.col("breaks_total") >= 3), "strongly_suspicious").otherwise("needs_check"))
    return g.withColumn("hierarchical_status", status)


def universal_checkability(compounds: DataFrame, memberships: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Per compound: how many series and how many reference series support it."""
    refs = hierarchy.where(F.col("reference_status").isin("base_reference", "confirmed_reference")).select("series_id").distinct()
    m = memberships.join(refs.withColumn("_ref", F.lit(True)), "series_id", "left")
    g = m.groupBy("compound_id").agg(F.count_distinct("series_id").alias("n_series"), F.count("_ref").alias("n_reference"), F.max("series_size").alias("series_size"))
    out = compounds.select("compound_id").distinct().join(g, "compound_id", "left").na.fill(0)
    score = F.when(F.col("n_reference") >= 2, 7).when(F.col("n_reference") == 1, 5).when(F.col("n_series") >= 2, 3).otherwise(1)
    lvl = F.when(score == 7, "well_checkable").when(score == 5, "moderately_checkable").when(score == 3, "weakly_checkable").otherwise("hardly_checkable")
    risk = F.when(score == 7, "low").when(score == 5, "moderate").when(score == 3, "raised").otherwise("high")
    return out.withColumns({"checkability_score": score, "overall_checkability": lvl, "noise_risk": risk})


# Order of suspicion statuses.
PRIORITY = {"": -1, "consistent": 0, "hardly_checkable": 0, "needs_check": 1, "strongly_suspicious": 2, "critically_suspicious": 3}


def merge_suspicion(compounds: DataFrame, base: DataFrame, hierarchical: DataFrame, check: DataFrame) -> DataFrame:
    """Worst of the two layers; without any verdict, well or moderately checkable counts as consistent."""
    out = (compounds.join(base.select("compound_id", F.col("status").alias("base_status")), "compound_id", "left")
           .join(hierarchical.select("compound_id", "hierarchical_status"), "compound_id", "left")
           .join(check.select("compound_id", "overall_checkability", "n_reference"), "compound_id", "left"))

    def rank(c):
        v = F.coalesce(F.col(c), F.lit(""))
        x = F.lit(-1)
        for name, p in PRIORITY.items():
            x = F.when(v == name, p).otherwise(x)
        return x

    a, b = rank("base_status"), rank("hierarchical_status")
    chosen = F.when(a >= b, F.col("base_status")).otherwise(F.col("hierarchical_status"))
    fallback = F.when(F.col("overall_checkability").isin("well_checkable", "moderately_checkable") | (F.col("n_reference") > 0), "consistent").otherwise("hardly_checkable")
    return out.withColumn("final_status", F.coalesce(chosen, fallback))


def consistency_summary(**tables: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """(indicator, value) rows: each table contributes its named count aggregates."""
    out = None
    for df, indicators in tables.values():
        one = df.agg(*[c.cast("bigint").alias(n) for n, c in indicators.items()])
        long = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("indicator"), F.col(n).alias("value")) for n in indicators])).alias("x")).select("x.*")
        out = long if out is None else out.unionByName(long)
    return out


def pattern_hierarchy(df: DataFrame, broad: str, exact: str, label: str, value: str, rare: int = 3, small: int = 2) -> tuple[DataFrame, DataFrame]:
    """(groups, rare groups): size, share, rarity flags, examples and mean value per exact pattern."""
    total = df.agg(F.count("*").alias("_total"))
    g = df.groupBy(broad, exact).agg(F.count("*").alias("group_size"), F.avg(value).alias("mean_property"))
    part = F.pmod(F.xxhash64(label), F.lit(64))
    local = Window.partitionBy(broad, exact, "_part").orderBy(label)
    top = df.select(broad, exact, label).withColumn("_part", part).withColumn("_k", F.row_number().over(local)).where("_k <= 5")
    ex = top.groupBy(broad, exact).agg(F.array_join(F.slice(F.array_sort(F.collect_list(label)), 1, 5), "; ").alias("examples"))
    from corvida.functions.frames import with_scalars
    g = with_scalars(g.join(ex, [broad, exact]), total)
    n = F.col("group_size")
    un = (F.col(broad) == "other / unclassified") | (F.col(exact) == "unclassified")
    g = g.withColumns({"dataset_fraction": F.round(n / F.col("_total"), 4), "rare_group": n <= rare, "small_group": n <= small,
                       "singleton_group": n == 1, "unclassified_group": un}).drop("_total")
    reason = (F.when(F.col("unclassified_group"), "unclassified").when(F.col("singleton_group"), "singleton")
              .when(F.col("small_group"), "small").otherwise("rare"))
    return g, g.where(F.col("rare_group") | F.col("unclassified_group")).withColumn("reason_flag", reason)
