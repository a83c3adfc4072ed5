"""Cleaning, metrics and profile queries over line items and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvida.catalog.registry import LINES_SQL, lines, query, r, rounded, table
from corvida.functions import labels
from corvida.functions.columns import to_number
from corvida.operators import clean, stats

COMMA_SQL = """messy AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_linenumber = 7 THEN 'n/a' WHEN l_linenumber = 6 THEN NULL
              ELSE replace(CAST(l_discount AS VARCHAR), '.', ',') END AS d,
         CASE WHEN l_linenumber = 5 THEN NULL ELSE l_tax END AS t,
         CAST(l_quantity AS DOUBLE) AS q, 1.0::DOUBLE AS c, CAST(NULL AS DOUBLE) AS e,
         CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem)"""


def messy(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber",
        "CASE WHEN l_linenumber = 7 THEN 'n/a' WHEN l_linenumber = 6 THEN NULL "
        "ELSE replace(CAST(l_discount AS STRING), '.', ',') END AS d",
        "CASE WHEN l_linenumber = 5 THEN NULL ELSE l_tax END AS t",
        "CAST(l_quantity AS DOUBLE) AS q", "CAST(1 AS DOUBLE) AS c", "CAST(NULL AS DOUBLE) AS e",
        "CAST(l_extendedprice AS DOUBLE) AS y",
    )


@query("prj1_to_numeric", f"""WITH {COMMA_SQL}
SELECT l_linenumber, count(try_cast(replace(d, ',', '.') AS DOUBLE)) AS readable, count(*) AS n,
       {r("sum(try_cast(replace(d, ',', '.') AS DOUBLE))", 4, "total")} FROM messy GROUP BY 1""")
def prj1(spark, sf):
    d = messy(spark, sf).withColumn("v", to_number("d"))
    return rounded(d.groupBy("l_linenumber").agg(
        F.count("v").alias("readable"), F.count("*").alias("n"), F.sum("v").alias("total")), total=4)


NUM_SQL = f"""{COMMA_SQL}, num AS (SELECT l_orderkey, l_linenumber, try_cast(replace(d, ',', '.') AS DOUBLE) AS d, t, q, c, y FROM messy),
med AS (SELECT quantile_cont(d, 0.5) AS md, quantile_cont(t, 0.5) AS mt FROM num)"""


@query("prj2_clean_numeric", f"""WITH {NUM_SQL}
SELECT l_linenumber, count(*) AS n, {r('sum(coalesce(d, md))', 4, 'd')}, {r('sum(coalesce(t, mt))', 4, 't')}, {r('sum(q)', 4, 'q')}
FROM num, med GROUP BY 1""")
def prj2(spark, sf):
    df, keep = clean.clean_numeric(messy(spark, sf), ["d", "t", "q", "c", "e"])
    return rounded(df.groupBy("l_linenumber").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in keep]), 4)


@query("prj3_clean_keep_constant", f"""WITH {NUM_SQL}
SELECT l_linenumber, count(*) AS n, {r('sum(coalesce(d, md))', 4, 'd')}, {r('sum(coalesce(t, mt))', 4, 't')},
       {r('sum(q)', 4, 'q')}, {r('sum(c)', 4, 'c')} FROM num, med GROUP BY 1""")
def prj3(spark, sf):
    df, keep = clean.clean_numeric(messy(spark, sf), ["d", "t", "q", "c", "e"], keep_constant=True)
    return rounded(df.groupBy("l_linenumber").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in keep]), 4)


@query("prj4_prepare_matrix", f"""WITH {COMMA_SQL},
num AS (SELECT l_linenumber, try_cast(replace(d, ',', '.') AS DOUBLE) AS d, CASE WHEN l_linenumber = 7 THEN NULL ELSE t END AS t, y FROM messy),
ok AS (SELECT * FROM num WHERE y IS NOT NULL AND (d IS NOT NULL OR t IS NOT NULL)),
med AS (SELECT quantile_cont(d, 0.5) AS md, quantile_cont(t, 0.5) AS mt FROM ok)
SELECT l_linenumber, count(*) AS n, {r('sum(coalesce(d, md))', 4, 'd')}, {r('sum(coalesce(t, mt))', 4, 't')}, {r('avg(y)', 4, 'y')}
FROM ok, med GROUP BY 1""")
def prj4(spark, sf):
    src = messy(spark, sf).withColumn("t", F.when(F.col("l_linenumber") != 7, F.col("t")))
    df, _ = clean.prepare_matrix(src, "y", ["d", "t"])
    return rounded(df.groupBy("l_linenumber").agg(
        F.count("*").alias("n"), F.sum("d").alias("d"), F.sum("t").alias("t"), F.avg("y").alias("y")), 4)


@query("prj5_align_columns", f"""WITH {NUM_SQL}
SELECT l_linenumber, {r('sum(coalesce(t, mt))', 4, 't')}, {r('sum(q)', 4, 'q')}, {r('sum(0.0)', 4, 'absent')}, 'absent' AS missing_columns
FROM num, med GROUP BY 1""")
def prj5(spark, sf):
    df, missing = clean.align_columns(messy(spark, sf), ["t", "q", "absent"])
    return rounded(df.groupBy("l_linenumber").agg(*[F.sum(c).alias(c) for c in ("t", "q", "absent")])
                   .withColumn("missing_columns", F.lit(", ".join(missing))), 4)


@query("prj6_median_imputer", f"""WITH messy2 AS (SELECT l_linenumber, CASE WHEN l_linenumber = 5 THEN NULL ELSE l_tax END AS t FROM lineitem),
med AS (SELECT quantile_cont(t, 0.5) AS m FROM messy2 WHERE l_linenumber < 4)
SELECT l_linenumber, {r('sum(coalesce(t, m))', 4, 't')} FROM messy2, med WHERE l_linenumber >= 4 GROUP BY 1""")
def prj6(spark, sf):
    d = messy(spark, sf).select("l_linenumber", "t")
    model = clean.MedianImputer(["t"]).fit(d.where("l_linenumber < 4"))
    return rounded(model.transform(d.where("l_linenumber >= 4")).groupBy("l_linenumber").agg(F.sum("t").alias("t")), 4)


@query("prj7_standardize", f"""WITH {LINES_SQL}, m AS (SELECT avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x5) AS m5, stddev_pop(x5) AS s5 FROM lines)
SELECT p_brand, {r('avg((x1 - m1) / s1)', 6, 'x1')}, {r('max((x5 - m5) / s5)', 6, 'x5')} FROM lines, m GROUP BY 1""")
def prj7(spark, sf):
    d = lines(spark, sf)
    z = clean.Standardizer(["x1", "x5"]).fit(d).transform(d)
    return rounded(z.groupBy("p_brand").agg(F.avg("x1").alias("x1"), F.max("x5").alias("x5")))


@query("prj10_prediction_table", f"""WITH {LINES_SQL}
SELECT row_id, 'training' AS split, {r('y', 4, 'y_true')}, {r('y_pred', 4, 'y_pred')}, {r('y - y_pred', 4, 'error')} FROM lines""")
def prj10(spark, sf):
    return rounded(clean.prediction_table(lines(spark, sf), "y", "y_pred", ["row_id"], "training"), 4)


@query("prj11_error_table", f"""WITH {LINES_SQL}
SELECT row_id, {r('y', 4, 'experimental')}, {r('y_pred', 4, 'predicted')}, {r('y_pred - y', 4, 'error')},
       {r('abs(y_pred - y)', 4, 'absolute_error')}, {r('(y_pred - y) * (y_pred - y)', 2, 'squared_error')} FROM lines""")
def prj11(spark, sf):
    return rounded(clean.error_table(lines(spark, sf), "y", "y_pred", ["row_id"]), 4, squared_error=2)


PARTS_SQL = """pt AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS atoms, p_size, p_type,
  [p_brand, p_type] AS tags, length(p_name) % 4 AS hetero FROM part)"""


def parts(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey", "p_name", "split(p_name, ' ') AS atoms", "p_size", "p_type",
        "array(p_brand, p_type) AS tags", "length(p_name) % 4 AS hetero")


@query("prj12_structural_filter", f"""WITH {PARTS_SQL}
SELECT p_partkey, p_name, array_to_string(list_filter(['SMALL', 'ECONOMY', 'Brand#2'], lambda x: list_contains(tags, x)), '; ') AS matched_groups
FROM pt WHERE p_name IS NOT NULL AND list_has_any(atoms, ['red', 'blue']) AND list_has_any(tags, ['SMALL', 'ECONOMY', 'Brand#2'])
  AND p_size >= 5 AND p_size <= 40 AND hetero <= 2 AND contains(lower(p_name), 'l')""")
def prj12(spark, sf):
    kept, _ = clean.structural_filter(
        parts(spark, sf), valid=F.col("p_name").isNotNull(), atoms="atoms", elements=["red", "blue"],
        tags="tags", groups=["SMALL", "ECONOMY", "Brand#2"], carbon="p_size", carbon_min=5, carbon_max=40,
        hetero="hetero", hetero_max=2, text="p_name", contains=" L ")
    return kept.select("p_partkey", "p_name", "matched_groups")


@query("prj12_structural_filter_report", f"""WITH {PARTS_SQL}
SELECT count(*) AS total, count(p_name) AS valid, count(*) FILTER (p_name IS NOT NULL OR list_has_all(atoms, ['red', 'bolt']) OR p_size >= 49) AS kept,
       CAST(3 AS BIGINT) AS conditions, 'valid, elements, carbon_min' AS condition_list FROM pt""")
def prj12_report(spark, sf):
    return clean.structural_filter(
        parts(spark, sf), valid=F.col("p_name").isNotNull(), atoms="atoms", elements=["red", "bolt"],
        all_elements=True, carbon="p_size", carbon_min=49, match_any=True)[1]


ATOM_CASE = "CASE CAST(l_quantity AS INTEGER) % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'H' WHEN 2 THEN 'O' WHEN 3 THEN 'Si' ELSE 'Cl' END"


@query("prj13_formula", f"""WITH a AS (SELECT l_orderkey, {ATOM_CASE} AS atom FROM lineitem),
c AS (SELECT l_orderkey, atom, count(*) AS n,
      coalesce(nullif(list_position(['C','H','N','O','S','P','F','Cl','Br','I'], atom), 0), 99) AS o FROM a GROUP BY 1, 2)
SELECT l_orderkey, string_agg(atom || CASE WHEN n > 1 THEN CAST(n AS VARCHAR) ELSE '' END, '' ORDER BY o, atom) AS formula,
       CAST(sum(n) AS BIGINT) AS atom_count, CAST(sum(CASE WHEN atom = 'C' THEN n ELSE 0 END) AS BIGINT) AS carbon_count,
       CAST(sum(CASE WHEN atom NOT IN ('C','H') THEN n ELSE 0 END) AS BIGINT) AS hetero_count,
       sum(CASE WHEN atom NOT IN ('C','H') THEN n ELSE 0 END) = 0 AS only_ch
FROM c GROUP BY 1""")
def prj13(spark, sf):
    a = table(spark, sf, "lineitem").selectExpr("l_orderkey", f"{ATOM_CASE} AS atom")
    return clean.formula_table(a, "l_orderkey", "atom")


@query("prj14_property_groups", """SELECT p_type, count(*) AS n,
  count(*) FILTER (p_retailprice > 1000) AS group_high_molwt, count(*) FILTER (p_size > 30) AS group_high_logp,
  count(*) FILTER (length(p_name) > 10) AS group_high_tpsa, count(*) FILTER (p_size % 10 >= 5) AS group_flexible,
  count(*) FILTER (p_size % 7 >= 2) AS group_multiple_rings, count(*) FILTER (p_size % 7 > 0) AS group_cyclic,
  count(*) FILTER (p_size % 7 = 0) AS group_acyclic FROM part GROUP BY 1""")
def prj14(spark, sf):
    d = table(spark, sf, "part").selectExpr(
        "p_type", "p_retailprice AS molwt", "p_size AS logp", "length(p_name) AS tpsa",
        "p_size % 10 AS rotatable_bonds", "p_size % 7 AS ring_count")
    g = clean.property_groups(d, high_molwt=1000.0, high_logp=30.0, high_tpsa=10.0)
    flags = [c for c in g.columns if c.startswith("group_")]
    return g.groupBy("p_type").agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in flags])


RAW_PHASE = "CASE WHEN event_type = 'click' THEN ' Gas phase' WHEN event_type = 'view' THEN 'KBr pellet' WHEN event_type = 'error' THEN 'nan' ELSE 'Neat @ ' || event_type END"


@query("prj15_normalize_codes", f"""WITH e AS (SELECT event_type, {RAW_PHASE} AS ph, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, n, CASE WHEN lower(trim(ph)) = 'nan' THEN 'unknown' WHEN contains(lower(ph), 'gas') THEN 'gas'
       WHEN contains(lower(ph), 'kbr') THEN 'kbr'
       ELSE lower(trim(regexp_replace(trim(ph), '[^A-Za-z0-9_\\-]+', '_', 'g'), '_')) END AS phase,
  trim(regexp_replace(trim(event_type || ' / x..'), '[^A-Za-z0-9_\\-]+', '_', 'g'), '_') AS safe,
  CASE WHEN contains(event_type, 'user') THEN 'LOCAL' ELSE 'SRC' END AS code,
  CASE WHEN event_type = 'click' THEN 'IR' WHEN event_type = 'view' THEN 'Mass' ELSE event_type END AS spectrum_type
FROM e""")
def prj15(spark, sf):
    d = table(spark, sf, "events").selectExpr("event_type", f"{RAW_PHASE} AS ph").groupBy("event_type", "ph").agg(F.count("*").alias("n"))
    kind = F.when(F.col("event_type") == "click", " Infrared ").when(F.col("event_type") == "view", "MS").otherwise(F.col("event_type"))
    return d.select("event_type", "n", labels.phase("ph").alias("phase"),
                    labels.safe_part(F.concat("event_type", F.lit(" / x.."))).alias("safe"),
                    labels.source_code("event_type").alias("code"), labels.spectrum_type(kind).alias("spectrum_type"))


@query("prj16_priorities", """SELECT event_type, count(*) AS n,
  CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 50 WHEN 'error' THEN 90 ELSE 80 END AS phase_priority,
  CASE event_type WHEN 'error' THEN 90 ELSE 50 END AS confidence_priority,
  CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS quantitative_priority
FROM events GROUP BY 1""")
def prj16(spark, sf):
    d = table(spark, sf, "events").selectExpr("event_type", f"{RAW_PHASE} AS ph").groupBy("event_type", "ph").agg(F.count("*").alias("n"))
    return d.select("event_type", "n", labels.phase_priority("ph").alias("phase_priority"),
                    labels.confidence_priority("event_type").alias("confidence_priority"),
                    labels.quantitative_priority(F.col("event_type") == "click", True).alias("quantitative_priority"))


@query("prj17_key_table", """SELECT key_status, count(*) AS n, count(bank_key) AS keyed, count(DISTINCT bank_key) AS distinct_keys FROM (
  SELECT CASE WHEN can IS NULL AND k IS NULL THEN 'empty' WHEN p_size = 1 THEN 'invalid' ELSE 'ok' END AS key_status,
         CASE WHEN p_size <> 1 THEN coalesce(k, can) END AS bank_key
  FROM (SELECT p_size, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name END AS can, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS k FROM part))
GROUP BY 1""")
def prj17(spark, sf):
    d = table(spark, sf, "part").selectExpr(
        "p_size", "CASE WHEN p_size % 5 = 0 THEN ' ' ELSE p_name END AS can", "CASE WHEN p_size % 3 = 0 THEN 'NaN' ELSE p_brand END AS k")
    t = clean.key_table(d, "can", "k", F.col("p_size") != 1)
    return t.groupBy("key_status").agg(F.count("*").alias("n"), F.count("bank_key").alias("keyed"),
                                       F.countDistinct("bank_key").alias("distinct_keys"))


# Substituents of a part: none to six, of three kinds (mostly methyl), at positions made from its key.
SUBS = """transform(sequence(1, 6), i -> named_struct('position', CAST((p_partkey + i * p_size) % 4 + 1 AS INT), 'name',
 CASE WHEN p_size % 5 < 2 THEN 'methyl' WHEN (p_partkey + i) % 4 = 0 THEN 'ethyl' WHEN (p_size + i) % 6 = 0 THEN 'propyl' WHEN p_size % 5 = 2 THEN 'ethyl' ELSE 'methyl' END))"""
SUBS_SQL = """ps AS (SELECT p_partkey, p_size, p_partkey % 7 AS len, list_transform(range(1, p_partkey % 7 + 1), lambda i: {'position': CAST((p_partkey + i * p_size) % 4 + 1 AS INTEGER), 'name':
 CASE WHEN p_size % 5 < 2 THEN 'methyl' WHEN (p_partkey + i) % 4 = 0 THEN 'ethyl' WHEN (p_size + i) % 6 = 0 THEN 'propyl' WHEN p_size % 5 = 2 THEN 'ethyl' ELSE 'methyl' END}) AS subs FROM part)"""


def part_substituents(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", "p_size", F.expr(SUBS).alias("every"))
    return d.select("p_partkey", "p_size", F.expr("slice(every, 1, CAST(p_partkey % 7 AS INT))").alias("subs"))


PATTERN_SQL = f"""{SUBS_SQL}, pt AS (SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'n-alkane' WHEN p_size % 11 = 0 THEN 'cyclo' ELSE array_to_string(list_transform(subs, lambda s: s.position || '-' || s.name), '; ') END AS pattern FROM ps),
k AS (SELECT *, CASE WHEN pattern = '' THEN [] ELSE string_split(pattern, '; ') END AS items FROM pt),
n AS (SELECT *, list_transform(items, lambda p: regexp_replace(p, '^[^-]*-', '')) AS names, list_transform(list_filter(items, lambda p: contains(p, '-')), lambda p: regexp_replace(p, '^[^-]*-', '')) AS hy,
      array_to_string(list_transform(items, lambda p: string_split(p, '-')[1]), ',') AS places FROM k),
c AS (SELECT *, len(names) AS t, len(list_filter(names, lambda x: x = 'methyl')) AS m, len(list_filter(names, lambda x: x = 'ethyl')) AS e, len(list_filter(hy, lambda x: x = 'methyl')) AS hm, len(list_filter(hy, lambda x: x = 'ethyl')) AS he FROM n)"""


@query("prj20_pattern_labels", f"""WITH {PATTERN_SQL}
SELECT pattern, array_to_string(list_sort(list_transform(items, lambda p: regexp_replace(p, '^[0-9,]+-', ''))), '+') AS family,
 CASE WHEN pattern = '' THEN 'other / unclassified' WHEN pattern = 'n-alkane' THEN 'n-alkanes' WHEN m = t AND t = 1 THEN 'methylalkanes' WHEN m = t AND t = 2 THEN 'dimethylalkanes'
      WHEN m = t AND t = 3 THEN 'trimethylalkanes' WHEN m = t AND t = 4 THEN 'tetramethylalkanes' WHEN m = 0 AND e > 0 THEN 'ethyl-substituted alkanes'
      WHEN m + e > 0 THEN 'mixed-substituted alkanes' ELSE 'other / unclassified' END AS broad,
 CASE WHEN pattern = '' THEN 'unclassified' WHEN pattern = 'n-alkane' THEN 'n-alkanes'
      WHEN len(hy) > 0 AND hm = len(hy) THEN places || '-' || coalesce(['', 'di', 'tri', 'tetra', 'penta', 'hexa'][len(hy)], len(hy) || '-') || 'methylalkanes'
      WHEN len(hy) > 0 AND he = len(hy) THEN places || '-' || CASE WHEN len(hy) = 1 THEN '' ELSE len(hy) || '-' END || 'ethylalkanes'
      ELSE replace(pattern, '; ', ',') || '-substituted alkanes' END AS exact, count(*) AS n
FROM c GROUP BY ALL""")
def prj20(spark, sf):
    text = F.array_join(F.transform("subs", lambda s: F.concat(s["position"].cast("string"), F.lit("-"), s["name"])), "; ")
    p = part_substituents(spark, sf).select(F.when(F.col("p_size") % 9 == 0, "n-alkane").when(F.col("p_size") % 11 == 0, "cyclo").otherwise(text).alias("pattern"))
    return p.groupBy("pattern", labels.pattern_family("pattern").alias("family"), labels.broad_series("pattern").alias("broad"),
                     labels.exact_series("pattern").alias("exact")).agg(F.count("*").alias("n"))


@query("prj21_scheme_labels", f"""WITH {SUBS_SQL}, o AS (SELECT p_partkey, list_sort(subs) AS f, list_sort(list_transform(subs, lambda s: {{'position': 6 - s.position, 'name': s.name}})) AS v FROM ps),
q AS (SELECT p_partkey, CASE WHEN f <= v THEN f ELSE v END AS s FROM o),
u AS (SELECT p_partkey, s, unnest(list_sort(list_distinct(list_transform(s, lambda x: x.name)))) AS kind FROM q),
i AS (SELECT p_partkey, kind, list_transform(list_filter(s, lambda x: x.name = kind), lambda x: x.position) AS spot FROM u),
cl AS (SELECT p_partkey, string_agg(array_to_string(spot, ',') || '-' || CASE len(spot) WHEN 1 THEN '' WHEN 2 THEN 'di' WHEN 3 THEN 'tri' WHEN 4 THEN 'tetra' ELSE len(spot) || '-' END || kind, '-' ORDER BY kind) AS condensed FROM i GROUP BY 1),
g AS (SELECT p_partkey, s, len(s) AS t, len(list_filter(s, lambda x: x.name = 'methyl')) AS m, len(list_filter(s, lambda x: x.name = 'ethyl')) AS e, array_to_string(list_transform(s, lambda x: x.position), ',') AS spots FROM q)
SELECT p_partkey, CASE WHEN t = 0 THEN 'none' ELSE array_to_string(list_transform(s, lambda x: x.name || '@' || x.position), ';') END AS scheme, coalesce(condensed, '') AS condensed,
 CASE WHEN t = 0 THEN 'n-alkanes' ELSE condensed || 'alkanes' END AS series,
 CASE WHEN t = 0 THEN 'n-alkanes' WHEN e > 0 AND m > 0 THEN 'ethyl-methyl alkanes' WHEN e > 0 THEN 'ethyl-substituted alkanes'
      WHEN m = 1 AND t = 1 THEN CASE WHEN spots IN ('2', '3', '4') THEN spots || '-' ELSE '' END || 'methylalkanes'
      WHEN m = 2 AND t = 2 THEN CASE WHEN spots IN ('2,2', '2,3', '2,4', '3,3') THEN spots || '-' ELSE '' END || 'dimethylalkanes'
      WHEN m = 3 AND t = 3 THEN 'trimethylalkanes' WHEN m = 4 AND t = 4 THEN 'tetramethylalkanes' WHEN t >= 4 THEN 'highly-branched alkanes' ELSE 'branched alkanes' END AS family
FROM g LEFT JOIN cl USING (p_partkey)""")
def prj21(spark, sf):
    d = part_substituents(spark, sf).withColumn("subs", labels.oriented("subs", F.lit(5)))
    return d.select("p_partkey", labels.scheme_label("subs").alias("scheme"), labels.condensed_label("subs").alias("condensed"),
                    labels.series_label("subs").alias("series"), labels.series_family("subs").alias("family"))


@query("prj22_score_bands", """WITH s AS (SELECT l_discount * 80 AS score, l_discount * 10 AS share FROM lineitem)
SELECT CASE WHEN score < 2 THEN 'normal' WHEN score < 3 THEN 'weak_warning' WHEN score < 4 THEN 'possible_break'
            WHEN score < 6 THEN 'strong_break' ELSE 'critical_break' END AS level,
       CASE WHEN share >= .85 THEN 'Dense area' WHEN share >= .7 THEN 'Moderate area' WHEN share >= .5 THEN 'Sparse area' ELSE 'Singleton / outlier' END AS space,
       CASE WHEN share >= .7 THEN 'strong' WHEN share >= .4 THEN 'moderate' WHEN share >= .2 THEN 'weak' ELSE 'very_weak' END AS strength,
       CASE WHEN share >= .85 THEN 'excellent' WHEN share >= .7 THEN 'good' WHEN share >= .5 THEN 'acceptable' ELSE 'weak' END AS quality,
       CASE WHEN share >= .85 THEN 'excellent' WHEN share >= .7 THEN 'good' WHEN share >= .5 THEN 'moderate' ELSE 'poor' END AS model_quality,
       count(*) AS n FROM s GROUP BY ALL""")
def prj22(spark, sf):
    s = table(spark, sf, "lineitem").selectExpr("l_discount * 80 AS score", "l_discount * 10 AS share")
    return s.groupBy(labels.consistency_level("score").alias("level"), labels.space_class("share").alias("space"),
                     labels.correlation_strength("share").alias("strength"), labels.quality_label("share").alias("quality"),
                     labels.model_quality("share").alias("model_quality")).agg(F.count("*").alias("n"))


def metrics_sql(keys, y="y", p="y_pred", frm="lines", d=4):
    e = f"({y} - {p})"
    k = f"{keys}," if keys else ""
    return f"""SELECT {k} count(*) AS n, {r(f'1 - sum({e}*{e}) / (var_pop({y}) * count(*))', 6, 'r2')}, {r(f'avg({e}*{e})', 2, 'mse')},
      {r(f'sqrt(avg({e}*{e}))', d, 'rmse')}, {r(f'avg(abs{e})', d, 'mae')}, {r(f'avg({e})', d, 'me')},
      {r(f'stddev_pop({e})', d, 'sd')}, {r(f'avg(CASE WHEN {y} <> 0 THEN abs({e} / {y}) * 100 END)', d, 'mape_percent')},
      {r(f'quantile_cont({e}, 0.5)', d, 'median_error')} FROM {frm} {f'GROUP BY {keys}' if keys else ''}"""


@query("agg1_regression_metrics", f"WITH {LINES_SQL} {metrics_sql('l_returnflag')}")
def agg1(spark, sf):
    return rounded(stats.regression_metrics(lines(spark, sf), ["l_returnflag"]), 4, r2=6, mse=2)


@query("agg9_target_statistics", f"""WITH {LINES_SQL}, q AS (SELECT quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.75) AS q3 FROM lines),
o AS (SELECT count(*) FILTER (y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1)) AS outliers FROM lines, q)
SELECT count(*) AS rows, count(y) AS valid, count(*) - count(y) AS missing, {r('min(y)', 4, 'min')}, {r('max(y)', 4, 'max')}, {r('avg(y)', 4, 'mean')},
  {r('stddev_samp(y)', 4, 'std')}, {r('skewness(y)', 6, 'skewness')}, {r('kurtosis(y)', 6, 'kurtosis')},
  {r('any_value(q1)', 4, 'q1')}, {r('any_value(median)', 4, 'median')}, {r('any_value(q3)', 4, 'q3')}, {r('any_value(q3 - q1)', 4, 'iqr')},
  any_value(outliers) AS outliers, count(*) - count(DISTINCT l_orderkey) AS duplicate_ids
FROM lines, q, o""")
def agg9(spark, sf):
    return rounded(stats.target_statistics(lines(spark, sf), "y", "l_orderkey"), 4, skewness=6, kurtosis=6)


FEATS = ["x1", "x2", "x3", "x4", "x5"]


@query("agg10_descriptor_profile", f"WITH {LINES_SQL}, u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS v FROM lines" for c in FEATS) + f""")
SELECT name, count(*) AS rows, {r('avg(v)', 6, 'mean')}, {r('stddev_samp(v)', 6, 'std')}, {r('min(v)', 6, 'min')}, {r('max(v)', 6, 'max')},
  {r('0.0', 6, 'missing_percent')}, {r('avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END) * 100', 6, 'zero_percent')}, {r('skewness(v)', 6, 'skewness')},
  CAST(0 AS BIGINT) AS nan_count, CAST(0 AS BIGINT) AS inf_count, false AS constant, false AS near_constant FROM u GROUP BY 1""")
def agg10(spark, sf):
    return rounded(stats.descriptor_profile(lines(spark, sf), FEATS))


def ranks_sql(col, frm, keys="", out="rk"):
    part = f"PARTITION BY {keys} " if keys else ""
    both = f"PARTITION BY {keys + ', ' if keys else ''}{col}"
    return f"(rank() OVER ({part}ORDER BY {col}) + (count(*) OVER ({both}) - 1) / 2.0) AS {out}"


@query("agg11_target_correlations", f"WITH {LINES_SQL}, u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS v, y FROM lines" for c in FEATS) + f"""),
k AS (SELECT name, v, y, {ranks_sql('v', 'u', 'name', 'rv')}, {ranks_sql('y', 'u', 'name', 'ry')} FROM u),
c AS (SELECT name, count(*) AS n, corr(v, y) AS p, corr(rv, ry) AS s FROM k GROUP BY 1)
SELECT name, n, {r('p', 6, 'pearson')}, {r('s', 6, 'spearman')},
  CASE WHEN abs(p) >= .7 THEN 'strong' WHEN abs(p) >= .4 THEN 'moderate' WHEN abs(p) >= .2 THEN 'weak' ELSE 'very_weak' END AS strength,
  CASE WHEN p > 0 THEN 'positive' WHEN p < 0 THEN 'negative' ELSE 'none' END AS direction FROM c""")
def agg11(spark, sf):
    return rounded(stats.target_correlations(lines(spark, sf), FEATS, "y").drop("pearson_p", "spearman_p"))


@query("agg12_collinear_pairs", f"""WITH {LINES_SQL}, m AS (SELECT corr(x1, y) AS a, corr(x1, y_pred) AS b, corr(y, y_pred) AS c, corr(x1, x5) AS d, corr(x5, y) AS e, corr(x5, y_pred) AS f FROM lines),
u AS (SELECT unnest([a, b, c, d, e, f]) AS v FROM m)
SELECT t AS threshold, (SELECT count(*) FROM u WHERE abs(v) > t) AS pairs FROM (SELECT unnest([0.9::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS t)""")
def agg12_pairs(spark, sf):
    return stats.collinear_pairs(stats.correlation_matrix(lines(spark, sf), ["x1", "x5", "y", "y_pred"]))


@query("agg12_correlation_matrix", f"WITH {LINES_SQL}" + " UNION ALL ".join(
    f" SELECT '{a}' AS \"left\", '{b}' AS \"right\", {r(f'corr({a}, {b})', 6, 'r')} FROM lines"
    for i, a in enumerate(FEATS + ["y"]) for b in (FEATS + ["y"])[i + 1:]))
def agg12_matrix(spark, sf):
    return rounded(stats.correlation_matrix(lines(spark, sf), FEATS + ["y"]))


RESID_SQL = f"""SELECT {r('avg(e)', 4, 'mean_residual')}, {r('stddev_samp(e)', 4, 'std_residual')}, {r('avg(abs(e))', 4, 'mae')}, {r('sqrt(avg(e*e))', 4, 'rmse')},
  {r('max(abs(e))', 4, 'max_abs_error')}, {r('skewness(e)', 6, 'skewness')}, {r('kurtosis(e)', 6, 'kurtosis')},
  CASE WHEN abs(avg(e)) <= 0.05 * stddev_pop(y) THEN 'none' WHEN avg(e) > 0 THEN 'underestimates' ELSE 'overestimates' END AS bias,
  {r('quantile_cont(e, 0.25)', 4, 'residual_q1')}, {r('quantile_cont(e, 0.5)', 4, 'median_residual')}, {r('quantile_cont(e, 0.75)', 4, 'residual_q3')}
FROM (SELECT y, y - y_pred AS e FROM lines)"""


@query("agg13_residual_statistics", f"WITH {LINES_SQL} {RESID_SQL}")
def agg13(spark, sf):
    return rounded(stats.residual_statistics(lines(spark, sf), "y", "y_pred"), 4, skewness=6, kurtosis=6)


@query("agg33_residual_against_descriptor", f"""WITH {LINES_SQL}, d AS (SELECT l_returnflag, x1, y - y_pred AS e FROM lines),
k AS (SELECT *, {ranks_sql('x1', 'd', 'l_returnflag', 'rx')}, {ranks_sql('e', 'd', 'l_returnflag', 're')} FROM d)
SELECT l_returnflag, count(*) AS n, {r('regr_slope(e, x1)', 4, 'slope')}, {r('regr_intercept(e, x1)', 4, 'intercept')}, {r('corr(x1, e)', 6, 'pearson')}, {r('corr(rx, re)', 6, 'spearman')}
FROM k GROUP BY 1""")
def agg33(spark, sf):
    d = lines(spark, sf).withColumn("e", F.col("y") - F.col("y_pred"))
    return rounded(stats.residual_against(d, "x1", "e", ["l_returnflag"]), 6, slope=4, intercept=4)


@query("agg33_largest_residuals", f"""WITH {LINES_SQL}, d AS (SELECT p_brand, row_id, y - y_pred AS e FROM lines)
SELECT p_brand, row_id, {r('e', 4, 'e')} FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY abs(e) DESC, row_id) AS k FROM d) WHERE k <= 5""")
def agg33_top(spark, sf):
    d = lines(spark, sf).select("p_brand", "row_id", (F.col("y") - F.col("y_pred")).alias("e"))
    return rounded(stats.largest_residuals(d, "e", "row_id", 5, ["p_brand"]), 4)


SECTION_RES = ["mean_residual", "std_residual", "mae", "rmse", "max_abs_error", "skewness", "kurtosis", "residual_q1", "median_residual", "residual_q3"]


@query("agg32_final_statistics", f"""WITH {LINES_SQL}, m AS ({metrics_sql('')}), s AS ({RESID_SQL})
SELECT 'model' AS section, metric, {r('value', 2, 'value')} FROM (UNPIVOT (SELECT CAST(n AS DOUBLE) AS n, r2, rmse, mae, me, sd, mape_percent, median_error FROM m) ON COLUMNS(*) INTO NAME metric VALUE value)
UNION ALL SELECT 'residuals', metric, {r('value', 2, 'value')} FROM (UNPIVOT (SELECT * EXCLUDE (bias) FROM s) ON COLUMNS(*) INTO NAME metric VALUE value)""")
def agg32(spark, sf):
    d = lines(spark, sf)
    return rounded(stats.final_statistics({
        "model": stats.regression_metrics(d, []).drop("mse"), "residuals": stats.residual_statistics(d, "y", "y_pred")}), 2)


@query("src19_json_export", """SELECT CAST(json_object('p_partkey', p_partkey, 'v', CASE WHEN p_size > 25 THEN p_size / 2.0::DOUBLE ELSE NULL END) AS VARCHAR) AS json FROM part""")
def src19(spark, sf):
    d = table(spark, sf, "part").selectExpr(
        "p_partkey", "CASE WHEN p_size > 25 THEN p_size / CAST(2 AS DOUBLE) ELSE double('NaN') END AS v")
    return stats.json_rows(d)


@query("win2_spearman", f"""WITH {LINES_SQL}, k AS (SELECT p_brand, {ranks_sql('x1', 'lines', 'p_brand', 'a')}, {ranks_sql('y', 'lines', 'p_brand', 'b')} FROM lines)
SELECT p_brand, count(*) AS n, {r('corr(a, b)', 6, 'spearman')} FROM k GROUP BY 1""")
def win2(spark, sf):
    from corvida.functions.ranks import spearman
    return rounded(spearman(lines(spark, sf), ["p_brand"], "x1", "y"))


@query("agg16_robust_sigma", f"""WITH {LINES_SQL}, q AS (SELECT p_brand, quantile_cont(y, 0.5) AS m, quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b, stddev_pop(y) AS s FROM lines GROUP BY 1),
d AS (SELECT p_brand, quantile_cont(abs(y - m), 0.5) AS mad FROM lines JOIN q USING (p_brand) GROUP BY 1)
SELECT p_brand, {r('m', 4, 'median')}, {r('mad', 4, 'mad')}, {r('CASE WHEN 1.4826 * mad > 1e-12 THEN 1.4826 * mad WHEN s > 1e-12 THEN s WHEN b - a > 1e-12 THEN (b - a) / 1.349 ELSE 1e-6 END', 4, 'sigma')}
FROM q JOIN d USING (p_brand)""")
def agg16(spark, sf):
    from corvida.functions.ranks import robust_sigma
    return rounded(robust_sigma(lines(spark, sf), ["p_brand"], "y"), 4)
