"""Bank, journal, lookup and spectrum queries over events, parts, pages and conversations."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from corvida.catalog.registry import CHECKS, query, r, rounded, table
from corvida.operators import bank, spectra
from corvida.sources import ingest, parsers, tables
from corvida.streaming import flows

EV = "SELECT event_id, user_id, event_type, ts, CAST(value AS DOUBLE) AS value FROM events"


def events(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", "user_id", "event_type", "ts", "CAST(value AS DOUBLE) AS value")


@query("win9_keep_last_upsert", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def win9(spark, sf):
    e = events(spark, sf)
    return bank.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


LATEST = "b AS (SELECT user_id AS bank_key, max_by(value, (ts, event_id)) AS d FROM events WHERE event_type = 'click' GROUP BY 1)"
CACHE_SQL = f"{LATEST}, c AS (SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN c_custkey % 500 END AS bank_key FROM customer)"


def cache_inputs(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey", "CASE WHEN c_nationkey < 20 THEN c_custkey % 500 END AS bank_key")
    b = events(spark, sf).where("event_type = 'click'").selectExpr("user_id AS bank_key", "value AS d", "struct(ts, event_id) AS created_at")
    return c, b


@query("join1_cached_rows", f"WITH {CACHE_SQL} SELECT c_custkey, d FROM c JOIN b USING (bank_key)")
def join1(spark, sf):
    return bank.split_cached(*cache_inputs(spark, sf))[0].select("c_custkey", "d")


@query("join1_missing_rows", f"WITH {CACHE_SQL} SELECT c_custkey FROM c WHERE bank_key IS NULL OR bank_key NOT IN (SELECT bank_key FROM b)")
def join1_missing(spark, sf):
    return bank.split_cached(*cache_inputs(spark, sf))[1].select("c_custkey")


def _double(batches):
    for pdf in batches:
        yield pdf.assign(d=pdf["bank_key"] * 2.0)[["bank_key", "d"]]


@query("prd3_enrich_with_cache", f"WITH {CACHE_SQL} SELECT c_custkey, CASE WHEN c.bank_key IS NOT NULL THEN coalesce(d, c.bank_key * 2.0) END AS d FROM c LEFT JOIN b USING (bank_key)")
def prd3(spark, sf):
    c, b = cache_inputs(spark, sf)
    return bank.enrich(c, b, "bank_key", _double, "bank_key bigint, d double")[0].select("c_custkey", "d")


@query("join2_attach_target", "SELECT o_orderkey, c_acctbal FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 12) ON o_custkey = c_custkey")
def join2(spark, sf):
    t = table(spark, sf, "customer").where("c_nationkey < 12").selectExpr("c_custkey AS o_custkey", "c_acctbal")
    return bank.attach_target(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), t, "o_custkey").select("o_orderkey", "c_acctbal")


@query("join3_assemble_matrix", "SELECT p_partkey AS id, p_size AS MOL_p_size, p_retailprice AS MOL_p_retailprice, n AS SPEC_n, CAST(q AS DOUBLE) AS SPEC_q FROM part JOIN (SELECT l_partkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON p_partkey = l_partkey")
def join3(spark, sf):
    m = table(spark, sf, "part").selectExpr("p_partkey AS id", "p_size", "p_retailprice")
    s = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return bank.assemble({"MOL": m, "SPEC": s}, "id")


# A spectra index from events: identity by user, second identity by user block.
IX = "SELECT event_id AS spectrum_id, CASE WHEN user_id % 3 = 0 THEN '' ELSE 'K' || user_id END AS inchikey, 'C' || (user_id // 2) AS canonical, CASE WHEN event_type = 'click' THEN 'Mass' ELSE 'IR' END AS spectrum_type, event_type, value, ts, event_id FROM events"
CP = "SELECT c_custkey, 'K' || (c_custkey % 150) AS inchikey, 'C' || (c_custkey % 70) AS canonical FROM customer"


def spectra_index(spark, sf):
    return events(spark, sf).selectExpr(
        "event_id AS spectrum_id", "CASE WHEN user_id % 3 = 0 THEN '' ELSE 'K' || user_id END AS inchikey", "'C' || (user_id div 2) AS canonical", "CASE WHEN event_type = 'click' THEN 'mass spectrum' ELSE ' IR ' END AS spectrum_type",
        "CASE event_type WHEN 'view' THEN 'Gas' WHEN 'click' THEN 'gas' WHEN 'error' THEN 'nan' ELSE 'KBr disc' END AS phase", "event_type AS source", "CASE WHEN value > 30 THEN ' Absorbance' ELSE '' END AS intensity_type",
        "CASE WHEN event_id % 5 = 0 THEN 'no' ELSE 'Yes' END AS is_experimental", "CASE WHEN value > 20 THEN 'true' ELSE 'false' END AS is_quantitative", "CASE WHEN event_id % 3 = 0 THEN 'high' ELSE 'low' END AS confidence_level",
        "CASE WHEN event_id % 7 = 0 THEN 'false' ELSE 'active' END AS active", "event_id % 2 = 0 AS has_file", "event_id % 11 = 0 AS has_descriptor")


def compounds(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey", "'K' || (c_custkey % 150) AS inchikey", "'C' || (c_custkey % 70) AS canonical")


@query("join4_active_spectrum", f"""WITH ix AS ({IX}), a AS (SELECT * FROM ix WHERE spectrum_type = 'IR' AND event_id % 7 <> 0), cp AS ({CP}), k1 AS (SELECT inchikey, min(spectrum_id) AS s FROM a WHERE inchikey <> '' GROUP BY 1), k2 AS (SELECT canonical, min(spectrum_id) AS s FROM a GROUP BY 1)
SELECT c_custkey, coalesce(k1.s, k2.s) AS found_spectrum_id, CASE WHEN k1.s IS NOT NULL THEN 1 WHEN k2.s IS NOT NULL THEN 2 END AS tier FROM cp LEFT JOIN k1 USING (inchikey) LEFT JOIN k2 USING (canonical)""")
def join4(spark, sf):
    ix = spectra_index(spark, sf).where("trim(spectrum_type) = 'IR' AND active = 'active'").select("spectrum_id", "inchikey", "canonical")
    return bank.tiered_match(compounds(spark, sf), ix, "inchikey", "canonical", ["spectrum_id"], "c_custkey").select("c_custkey", "found_spectrum_id", "tier")


CAND = f"""ix AS ({IX}), cp AS ({CP}), cs AS (SELECT DISTINCT c_custkey, ix.* FROM cp JOIN ix USING (inchikey) WHERE cp.inchikey <> '' AND spectrum_type = 'IR' AND event_id % 7 <> 0
 UNION SELECT DISTINCT c_custkey, ix.* FROM cp JOIN ix USING (canonical) WHERE spectrum_type = 'IR' AND event_id % 7 <> 0),
cn AS (SELECT *, CASE event_type WHEN 'view' THEN 'gas' WHEN 'error' THEN 'unknown' ELSE 'kbr' END AS ph, CASE event_type WHEN 'view' THEN 0 WHEN 'error' THEN 90 ELSE 50 END AS pp, CASE WHEN value > 30 THEN 'absorbance' ELSE 'unknown' END AS it FROM cs)"""


def candidates(spark, sf):
    return bank.candidate_spectra(compounds(spark, sf), spectra_index(spark, sf), "IR", "c_custkey")


@query("join6_candidate_spectra", f"WITH {CAND} SELECT c_custkey, count(*) AS n, count(DISTINCT spectrum_id) AS spectra, CAST(sum(pp) AS BIGINT) AS priority_sum, count(*) FILTER (it = 'absorbance') AS absorbance FROM cn GROUP BY 1")
def join6(spark, sf):
    return candidates(spark, sf).groupBy("c_custkey").agg(F.count("*").alias("n"), F.count_distinct("spectrum_id").alias("spectra"), F.sum("phase_priority").alias("priority_sum"), F.count_if(F.col("intensity_norm") == "absorbance").alias("absorbance"))


@query("prj19_ready_filter", f"WITH {CAND} SELECT c_custkey, count(*) AS n FROM cn WHERE event_id % 5 <> 0 AND event_type IN ('view', 'error') AND it = 'unknown' AND ph IN ('gas') GROUP BY 1")
def prj19(spark, sf):
    return bank.ready_filter(candidates(spark, sf), "only_gas", sources=["view", "error"], intensities=["unknown"]).groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("win8_best_spectrum", f"""WITH {CAND}, rk AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1 END, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END, pp, CASE WHEN value > 20 THEN 0 ELSE 1 END, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 40 END, spectrum_id) AS k FROM cn WHERE event_id % 5 <> 0)
SELECT c_custkey, spectrum_id, ph AS phase_norm, CASE WHEN ph = 'gas' THEN 'selected_gas_by_priority' ELSE 'gas_not_available_selected_' || ph END AS selection_reason FROM rk WHERE k = 1""")
def win8(spark, sf):
    return bank.best_spectrum(bank.ready_filter(candidates(spark, sf)), "c_custkey", prefer_quantitative=True)


@query("prj18_settings_match", "SELECT event_type, count(*) AS n FROM events WHERE event_type = 'view' AND value > 20 AND user_id % 4 = 1 GROUP BY 1")
def prj18(spark, sf):
    d = events(spark, sf).selectExpr("' ' || event_type AS event_type", "CASE WHEN value > 20 THEN 'YES' ELSE 'no' END AS flag", "CAST(user_id % 4 AS STRING) AS step")
    return d.where(bank.matches_settings({"event_type": "view", "flag": True, "step": 1.0})).groupBy(F.trim("event_type").alias("event_type")).agg(F.count("*").alias("n"))


DUP = """nw AS (SELECT event_id AS id, user_id AS compound, event_type AS t, value AS lo, value + 10 AS hi, user_id % 5 AS n, CASE WHEN event_id % 4 = 0 THEN 'u' || (event_id % 40) ELSE '' END AS url, CASE WHEN event_id % 4 = 1 THEN 's' || (event_id % 90) || 'z' ELSE '' END AS sp FROM events WHERE event_id % 2 = 0 OR event_id % 4 = 1),
ol AS (SELECT event_id AS sid, user_id AS compound, event_type AS t, value + 4e-7 AS lo, value + 10 AS hi, user_id % 5 AS n, 'u' || (event_id % 40) AS url, 'c s' || (event_id % 90) || 'z' AS cm FROM events WHERE event_id % 4 = 3)"""


@query("join5_duplicate_spectrum", f"""WITH {DUP}, m AS (SELECT id, sid, CASE WHEN nw.url <> '' AND nw.url = ol.url THEN 1 WHEN sp <> '' AND contains(cm, sp) THEN 2 WHEN abs(nw.lo - ol.lo) <= 1e-6 AND abs(nw.hi - ol.hi) <= 1e-6 AND nw.n = ol.n THEN 3 END AS tier FROM nw JOIN ol USING (compound, t))
SELECT id, min_by(sid, (tier, sid)) AS duplicate_of, min(tier) AS tier FROM m WHERE tier IS NOT NULL GROUP BY 1""")
def join5(spark, sf):
    e = events(spark, sf)
    new = e.where("event_id % 2 = 0 OR event_id % 4 = 1").selectExpr("event_id AS id", "user_id AS compound", "event_type AS spectrum_type", "'db' AS source_database", "value AS x_min", "value + 10 AS x_max", "user_id % 5 AS n_points",
                                                                    "CASE WHEN event_id % 4 = 0 THEN 'u' || (event_id % 40) ELSE '' END AS source_url", "CASE WHEN event_id % 4 = 1 THEN 's' || (event_id % 90) || 'z' ELSE '' END AS splash")
    old = e.where("event_id % 4 = 3").selectExpr("event_id AS spectrum_id", "user_id AS compound", "event_type AS spectrum_type", "'db' AS source_database", "value + double('4e-7') AS x_min", "value + 10 AS x_max", "user_id % 5 AS n_points",
                                                 "'u' || (event_id % 40) AS source_url", "'c s' || (event_id % 90) || 'z' AS comment")
    return bank.duplicate_spectrum(new, old, "id")


STATUS = "CASE WHEN user_id % 4 = 0 AND event_type = 'click' THEN 'found_downloaded' WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'search_error' ELSE 'not_found' END"
JR = f"jr AS (SELECT user_id AS key, {STATUS} AS status, CASE WHEN user_id % 2 = 0 THEN 'nist|mona' ELSE 'nist' END AS sk, event_type AS source, event_id FROM events)"


def journal(spark, sf):
    return events(spark, sf).selectExpr("user_id AS key", "'IR' AS spectrum_type", f"{STATUS} AS status", "CASE WHEN user_id % 2 = 0 THEN 'nist|mona' ELSE 'nist' END AS sources_key", "event_type AS source", "event_id AS ts")


@query("win10_journal_decision", f"""WITH {JR}, g AS (SELECT key, max(CASE WHEN status = 'found_downloaded' THEN 1 ELSE 0 END) AS p, max(CASE WHEN status = 'search_error' THEN 1 ELSE 0 END) AS e, max(CASE WHEN status = 'not_found' AND sk = 'nist' THEN 1 ELSE 0 END) AS n FROM jr GROUP BY 1)
SELECT key, 'IR' AS spectrum_type, CASE WHEN p = 1 THEN 'use_positive' WHEN e = 1 THEN 'search_again' WHEN n = 1 THEN 'use_negative' ELSE 'search_again' END AS decision, CASE WHEN p = 1 THEN 'found_downloaded' WHEN e = 0 AND n = 1 THEN 'not_found' END AS status FROM g""")
def win10(spark, sf):
    return bank.journal_decision(journal(spark, sf), "nist")


def _as_stream(spark, rows, pieces: int = 3):
    """A file stream over rows written to a scratch folder, one file per batch."""
    path = _scratch(spark)
    rows.repartition(pieces).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(writer) -> None:
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


@query("win9_stream_upsert", CHECKS["win9_keep_last_upsert"])
def win9_stream(spark, sf):
    e = events(spark, sf)
    path = _scratch(spark)
    _run(flows.upsert_stream(_as_stream(spark, e), path, ["user_id", "event_type"], ["ts", "event_id"], f"{path}/progress", buckets=16))
    return flows.read_upserted(spark, path, e.schema).select("user_id", "event_type", "event_id", "value")


@query("win10_journal_stream", CHECKS["win10_journal_decision"])
def win10_stream(spark, sf):
    j = journal(spark, sf)
    path = _scratch(spark)
    _run(flows.journal_stream(_as_stream(spark, j), "nist", path, f"{path}/progress", buckets=16))
    schema = bank.journal_decision(j, "nist").withColumn("decided_in", F.lit(0).cast("long")).schema
    return flows.read_upserted(spark, path, schema).drop("decided_in")


# Requests carry two identities; the second one counts where the journal has no row for the first.
JR2 = f"jq AS (SELECT CASE WHEN user_id % 3 = 0 THEN '' ELSE 'K' || user_id END AS ik, 'S' || user_id % 50 AS cs, {STATUS} AS status, CASE WHEN event_id % 4 = 0 THEN '' WHEN user_id % 2 = 0 THEN 'nist|mona' ELSE 'nist' END AS sk0, CASE WHEN user_id % 2 = 0 THEN 'nist | mona' ELSE 'nist' END AS ss, event_id FROM events)"


def decided_sql(key: str) -> str:
    return f"SELECT {key} AS id, max(status = 'found_downloaded') AS p, max(status = 'search_error') AS e, max(status = 'not_found' AND sk = 'nist') AS n FROM jn WHERE {key} <> '' GROUP BY 1"


@query("win10_journal_two_identities", f"""WITH {JR2}, jn AS (SELECT *, CASE WHEN sk0 = '' THEN replace(ss, ' | ', '|') ELSE sk0 END AS sk FROM jq), d1 AS ({decided_sql('ik')}), d2 AS ({decided_sql('cs')}),
rq AS (SELECT c_custkey AS request, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'K' || c_custkey END AS ik, 'S' || c_custkey % 60 AS cs FROM customer),
j AS (SELECT request, CASE WHEN d1.id IS NOT NULL THEN 'first' WHEN d2.id IS NOT NULL THEN 'second' ELSE 'none' END AS matched_by, CASE WHEN d1.id IS NOT NULL THEN d1.p ELSE d2.p END AS p, CASE WHEN d1.id IS NOT NULL THEN d1.e ELSE d2.e END AS e, CASE WHEN d1.id IS NOT NULL THEN d1.n ELSE d2.n END AS n
 FROM rq LEFT JOIN d1 ON rq.ik = d1.id LEFT JOIN d2 ON rq.cs = d2.id)
SELECT request, matched_by, CASE WHEN p THEN 'use_positive' WHEN e THEN 'search_again' WHEN n THEN 'use_negative' ELSE 'search_again' END AS decision, CASE WHEN p THEN 'found_downloaded' WHEN NOT e AND n THEN 'not_found' END AS status FROM j""")
def win10_two(spark, sf):
    j = events(spark, sf).selectExpr("CASE WHEN user_id % 3 = 0 THEN '' ELSE 'K' || user_id END AS ik", "'S' || user_id % 50 AS cs", "'IR' AS spectrum_type", f"{STATUS} AS status",
                                     "CASE WHEN event_id % 4 = 0 THEN '' WHEN user_id % 2 = 0 THEN 'nist|mona' ELSE 'nist' END AS sources_key", "CASE WHEN user_id % 2 = 0 THEN 'nist | mona' ELSE 'nist' END AS selected_sources", "event_id AS ts")
    rq = table(spark, sf, "customer").selectExpr("c_custkey AS request", "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'K' || c_custkey END AS ik", "'S' || c_custkey % 60 AS cs", "'IR' AS spectrum_type")
    return bank.journal_lookup(rq, j, "nist", "ik", "cs").select("request", "matched_by", "decision", "status")


@query("agg29_not_found_table", f"""WITH {JR}, l AS (SELECT key, source, max_by(status, event_id) AS s FROM jr GROUP BY 1, 2) SELECT key, max(s) FILTER (source = 'click') AS click, max(s) FILTER (source = 'view') AS view, string_agg(source, '; ' ORDER BY source) AS checked_sources,
 count(*) FILTER (s = 'not_found') AS total_not_found, count(*) FILTER (s = 'search_error') AS total_errors, CAST(0 AS BIGINT) AS total_candidates FROM l GROUP BY 1""")
def agg29(spark, sf):
    return bank.not_found_table(journal(spark, sf), "key", "source", "status", ["click", "view"])


@query("set4_clear_journal", f"WITH {JR} SELECT count(*) AS before, count(*) FILTER (sk = 'nist' AND status = 'not_found') AS removed, count(*) FILTER (NOT (sk = 'nist' AND status = 'not_found')) AS after FROM jr")
def set4(spark, sf):
    return bank.clear_journal(journal(spark, sf), (F.col("sources_key") == "nist") & (F.col("status") == "not_found"))[1]


@query("agg30_status_report", f"WITH {JR} SELECT status, count(*) AS n FROM jr GROUP BY 1")
def agg30(spark, sf):
    return bank.descriptor_report(journal(spark, sf))


@query("set1_distinct_candidates", "SELECT user_id, event_type, value > 20 AS big, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3")
def set1(spark, sf):
    return bank.first_of_key(events(spark, sf).selectExpr("user_id", "event_type", "value > 20 AS big", "event_id AS o", "event_id"), ["user_id", "event_type", "big"], "o").select("user_id", "event_type", "big", "event_id")


@query("set2_union_missing_columns", "SELECT p_partkey AS id, p_brand, CAST(NULL AS DOUBLE) AS acctbal FROM part UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def set2(spark, sf):
    a = table(spark, sf, "part").selectExpr("p_partkey AS id", "p_brand")
    return a.unionByName(table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_acctbal AS acctbal"), allowMissingColumns=True)


CARDS = """m1|true|ECONOMY||red,blue,small,bolt|5|30|
m2|true||SMALL||||Brand#1
m3|false||||||
m4|true|LARGE,Brand#2|Brand#3|red,green,plate,nut,widget|10||SMALL,ECONOMY,Brand#3"""
CARD_COLUMNS = ["model_id", "has_scope", "excluded_tags", "required_tags", "allowed_atoms", "carbon_min", "carbon_max", "allowed_tags"]


def card_sql() -> str:
    def cell(i, v):
        if i in (2, 3, 4, 7):
            return "[" + ", ".join(f"'{x}'" for x in v.split(",") if x) + "]::VARCHAR[]"
        return f"'{v}'" if i == 0 else v or "NULL"
    return "(VALUES " + ", ".join("(" + ", ".join(cell(i, v) for i, v in enumerate(line.split("|"))) + ")" for line in CARDS.split("\n")) + f") t({', '.join(CARD_COLUMNS)})"


def card_table(spark):
    split = lambda c: F.filter(F.split(c, ","), lambda x: x != "").alias(c)
    lines = spark.createDataFrame([tuple(line.split("|")) for line in CARDS.split("\n")], ", ".join(f"{c} string" for c in CARD_COLUMNS))
    return lines.select("model_id", F.col("has_scope").cast("boolean").alias("has_scope"), split("excluded_tags"), split("required_tags"), split("allowed_atoms"),
                        *[F.nullif(c, F.lit("")).cast("int").alias(c) for c in ("carbon_min", "carbon_max")], split("allowed_tags"))


@query("join17_scope_match", f"""WITH p AS (SELECT p_partkey, [p_type, p_brand] AS tags, string_split(p_name, ' ') AS atoms, p_size AS c, p_partkey % 17 <> 0 AS valid FROM part),
x AS (SELECT *, list_sort(list_filter(excluded_tags, lambda e: list_contains(tags, e))) AS hit, list_sort(list_filter(required_tags, lambda e: NOT list_contains(tags, e))) AS miss,
 CASE WHEN len(allowed_atoms) > 0 THEN list_sort(list_filter(list_distinct(atoms), lambda a: a <> 'H' AND NOT list_contains(allowed_atoms, a))) ELSE [] END AS extra,
 coalesce(c < carbon_min, false) AS lo, coalesce(c > carbon_max, false) AS hi, len(allowed_tags) > 0 AND NOT list_has_any(tags, allowed_tags) AS off FROM p, {card_sql()}),
y AS (SELECT *, concat_ws('; ', CASE WHEN len(hit) > 0 THEN 'excluded: ' || array_to_string(hit, ', ') END, CASE WHEN len(miss) > 0 THEN 'missing: ' || array_to_string(miss, ', ') END,
 CASE WHEN len(extra) > 0 THEN 'atoms: ' || array_to_string(extra, ', ') END, CASE WHEN lo THEN 'carbon below range' END, CASE WHEN hi THEN 'carbon above range' END, CASE WHEN off THEN 'no allowed class' END) AS f FROM x)
SELECT p_partkey, model_id, CASE WHEN NOT valid THEN 'not_suitable' WHEN NOT has_scope THEN 'undefined' WHEN len(hit) + len(miss) + len(extra) > 0 THEN 'not_suitable' WHEN lo OR hi OR off THEN 'partial' ELSE 'suitable' END AS applicability,
 CASE WHEN NOT valid THEN 'invalid structure' WHEN NOT has_scope THEN 'no scope' WHEN f = '' THEN 'scope matches' ELSE f END AS reasons FROM y""")
def join17(spark, sf):
    d = table(spark, sf, "part").selectExpr("p_partkey", "array(p_type, p_brand) AS tags", "split(p_name, ' ') AS atoms", "p_size AS carbon_count", "p_partkey % 17 <> 0 AS valid")
    return bank.scope_match(d, card_table(spark), "p_partkey")


@query("top6_best_mass_candidate", """WITH s AS (SELECT user_id, 'A' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS accession, CAST(floor(value) AS INTEGER) AS pk, CASE WHEN event_type = 'click' THEN 1000 WHEN event_type = 'error' THEN -5000 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN -500 ELSE 300 END + CASE WHEN event_id % 2 = 0 THEN 150 ELSE -150 END + 200 + 150 + CASE WHEN event_id % 7 = 0 THEN 0 ELSE user_id % 10 * 100 + event_id % 5 END AS b FROM events),
z AS (SELECT *, b + CASE WHEN pk <= 0 THEN -10000 ELSE 0 END + least(pk, 200) * 0.5 AS score FROM s) SELECT user_id, max_by(accession, (score, pk, accession)) AS accession, CAST(max(score) AS DOUBLE) AS score FROM z GROUP BY 1""")
def top6(spark, sf):
    d = events(spark, sf).selectExpr("user_id", "'A' || lpad(CAST(event_id AS STRING), 9, '0') AS accession", "CAST(floor(value) AS INT) AS peak_count", "CASE event_type WHEN 'click' THEN 'exact_inchikey' WHEN 'error' THEN 'mismatch!' ELSE 'x' END AS confidence_level",
                                     "CASE WHEN event_id % 3 = 0 THEN 'MS2' ELSE 'ms1' END AS ms_level", "CASE WHEN event_id % 2 = 0 THEN 'positive' ELSE 'neg' END AS ionization_mode", "'EI-quad' AS instrument", "'MassBank' AS source_database", "'MoNA' AS source", "'' AS source_url")
    d = d.withColumn("instrument", F.lit("GC-EI"))
    d = d.withColumn("candidate_score", F.expr("CASE WHEN CAST(substr(accession, 2) AS BIGINT) % 7 = 0 THEN NULL ELSE user_id % 10 * 100 + CAST(substr(accession, 2) AS BIGINT) % 5 END"))
    return bank.best_mass_candidate(d, "user_id")


@query("src20_bank_inventory", "SELECT 'index' AS \"table\", event_type AS kind, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'compounds', c_mktsegment, count(*) FROM customer GROUP BY 2")
def src20(spark, sf):
    return tables.inventory({"index": (events(spark, sf), "event_type"), "compounds": (table(spark, sf, "customer"), "c_mktsegment")})


@query("src1_load_table", "SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total_size FROM part GROUP BY 1")
def src1(spark, sf):
    return tables.read_compounds(spark, f"{sf}/part.parquet").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("total_size"))


@query("src2_conform_index", "SELECT event_type AS spectrum_type, count(*) AS n, CAST(0 AS BIGINT) AS names, count(*) AS with_min, count(*) FILTER (event_id % 2 = 0) AS active FROM events GROUP BY 1")
def src2(spark, sf):
    d = tables.conform(events(spark, sf).selectExpr("event_id AS spectrum_id", "event_type AS spectrum_type", "CAST(value AS STRING) AS wavenumber_min", "event_id % 2 = 0 AS active"), tables.INDEX_SCHEMA)
    return d.groupBy("spectrum_type").agg(F.count("*").alias("n"), F.count("name").alias("names"), F.count("wavenumber_min").alias("with_min"), F.count_if("active").alias("active"))


@query("src5_shard_key", "SELECT shard, count(*) AS n FROM (SELECT CASE WHEN length(k) < 2 THEN '' ELSE substr(k, 1, 2) END AS shard FROM (SELECT regexp_replace(upper(p_name), '[^A-Z0-9]+', '', 'g') AS k FROM part)) GROUP BY 1")
def src5(spark, sf):
    return table(spark, sf, "part").groupBy(tables.shard_key("p_name").alias("shard")).agg(F.count("*").alias("n"))


@query("src5_needed_shards", "SELECT p_partkey AS k, p_name FROM part WHERE p_size < 10")
def src5_needed(spark, sf):
    p = table(spark, sf, "part").selectExpr("CAST(p_partkey + 1000000 AS STRING) AS k", "p_name", "p_size", "p_partkey")
    shards = p.where("p_partkey % 3 <> 0").withColumn("shard", tables.shard_key("k"))
    out = tables.shards_for(p.where("p_size < 10"), shards, p, "k")
    return out.select((F.col("k").cast("bigint") - 1000000).alias("k"), "p_name")


# ------------------------------------------------------------------ spectra from events
LO, HI, STEP = 0.0, 24.0, 1.0
PT_SQL = """pt AS (SELECT user_id || '|' || event_type AS sid, CAST(hour(ts) AS DOUBLE) + minute(ts) / 60.0 AS x, value AS y, event_id FROM events), pc AS (SELECT sid, x, min_by(y, event_id) AS y FROM pt GROUP BY 1, 2),
sg AS (SELECT sid, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1, count(*) OVER (PARTITION BY sid) AS n FROM pc WINDOW w AS (PARTITION BY sid ORDER BY x)), gr AS (SELECT CAST(g AS DOUBLE) AS gx, g FROM range(25) t(g)),
cv AS (SELECT sid, g, CASE WHEN x1 IS NULL THEN y ELSE y + (gx - x) * (y1 - y) / (x1 - x) END AS v FROM sg JOIN gr ON gx >= x AND (gx < x1 OR (x1 IS NULL AND gx = x)) WHERE n >= 2),
md AS (SELECT sid, quantile_cont(v, 0.5) AS m FROM cv GROUP BY 1), fl AS (SELECT md.sid, gr.g, coalesce(v, m) AS v FROM md JOIN gr ON TRUE LEFT JOIN cv ON cv.sid = md.sid AND cv.g = gr.g),
st AS (SELECT sid, min(v) AS a, max(v) AS b FROM fl GROUP BY 1), nz AS (SELECT sid, g, CASE WHEN b - a > 1e-12 THEN (v - a) / (b - a) ELSE 0 END AS v FROM fl JOIN st USING (sid))"""


def spectrum_points(spark, sf):
    d = events(spark, sf).selectExpr("user_id || '|' || event_type AS sid", "CAST(hour(ts) AS DOUBLE) + minute(ts) / CAST(60 AS DOUBLE) AS x", "value AS y", "event_id")
    return spectra.clean_points(d, "sid", "x", "y", "event_id")


def spectrum_grid(spark, sf, method="min-max", invert=False):
    return spectra.normalized_grid(spectra.interpolate(spectrum_points(spark, sf), "sid", LO, HI, STEP), "sid", 25, method, invert)


@query("src3_clean_spectrum", f"WITH {PT_SQL} SELECT sid, count(*) AS n, {r('sum(x)', 4, 'sx')}, {r('sum(y)', 4, 'sy')} FROM pc GROUP BY 1")
def src3(spark, sf):
    return rounded(spectrum_points(spark, sf).groupBy("sid").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy")), 4)


@query("spc1_interpolate", f"WITH {PT_SQL} SELECT sid, CAST(g AS INTEGER) AS g, {r('v', 6, 'v')} FROM cv")
def spc1(spark, sf):
    return rounded(spectra.interpolate(spectrum_points(spark, sf), "sid", LO, HI, STEP))


@query("spc2_normalize", f"WITH {PT_SQL}, iv AS (SELECT sid, g, b - v AS v FROM fl JOIN st USING (sid)) SELECT sid, {r('sqrt(sum(v * v) / nullif(sum(v * v), 0))', 6, 'norm')}, {r('max(v) / sqrt(sum(v * v))', 6, 'peak')} FROM iv GROUP BY 1 HAVING sum(v * v) > 0")
def spc2(spark, sf):
    g = spectrum_grid(spark, sf, "vector", True)
    d = g.select("sid", F.sqrt(F.aggregate("grid", F.lit(0.0), lambda s, v: s + v * v)).alias("norm"), F.array_max("grid").alias("peak")).where("norm > 0")
    return rounded(d)


@query("spc3_grid_descriptors", f"WITH {PT_SQL} SELECT sid, CAST(g AS INTEGER) AS g, {r('v', 6, 'v')} FROM nz")
def spc3(spark, sf):
    return rounded(spectrum_grid(spark, sf).select("sid", F.posexplode("grid").alias("g", "v")))


@query("spc4_binary_fingerprint", f"WITH {PT_SQL}, tp AS (SELECT sid, max(v) AS t FROM nz GROUP BY 1) SELECT sid, CAST(g // 2 AS INTEGER) AS w, CASE WHEN max(v) >= 0.5 * CASE WHEN any_value(t) > 1e-12 THEN any_value(t) ELSE 1 END THEN 1 ELSE 0 END AS bit FROM nz JOIN tp USING (sid) WHERE g < 24 GROUP BY 1, 2")
def spc4(spark, sf):
    d = spectra.binary_fingerprint(spectrum_grid(spark, sf), "grid", LO, HI, STEP, 2, 0.5)
    return d.select("sid", F.posexplode("bits").alias("w", "bit"))


@query("spc5_band_descriptors", f"""WITH {PT_SQL}, q AS (SELECT sid, g, (g // 6) * 6 AS band, v, lead(v) OVER (PARTITION BY sid, g // 6 ORDER BY g) AS nx FROM nz WHERE g < 24)
SELECT sid, CAST(band AS INTEGER) AS band, {r('avg(v)', 6, 'mean')}, {r('max(v)', 6, 'max')}, {r('sum((v + nx) / 2)', 6, 'area')} FROM q GROUP BY 1, 2""")
def spc5(spark, sf):
    d = spectra.band_descriptors(spectrum_grid(spark, sf), "grid", LO, HI, STEP, 6)
    return rounded(d.select("sid", F.explode("bands").alias("b")).select("sid", "b.*"))


def spectrum_cache(spark, sf):
    p = spectrum_points(spark, sf)
    return spectra.describe(p.where("sid LIKE '%|view'"), "sid", LO, HI, STEP, bit_width=2, band_width=6)


@query("spc7_build_dataset", f"WITH {PT_SQL}, s AS (SELECT DISTINCT sid FROM pc) SELECT count(*) AS selected, count(*) FILTER (sid LIKE '%|view') AS cache_hits, count(*) FILTER (sid IN (SELECT sid FROM cv)) AS with_descriptors, count(*) FILTER (sid NOT IN (SELECT sid FROM cv)) AS without_descriptors FROM s")
def spc7(spark, sf):
    p = spectrum_points(spark, sf)
    return spectra.build_dataset(p.select("sid").distinct(), spectrum_cache(spark, sf), p, "sid", lo=LO, hi=HI, step=STEP, bit_width=2, band_width=6)[1]


@query("spc8_ready_descriptors", f"WITH {PT_SQL} SELECT sid, count(*) AS n FROM fl WHERE sid LIKE '%|view' GROUP BY 1")
def spc8(spark, sf):
    c = spectrum_cache(spark, sf).withColumn("descriptor_step", F.lit(STEP))
    return c.where(bank.matches_settings({"descriptor_step": STEP}) & F.col("grid").isNotNull()).select("sid", F.size("grid").cast("bigint").alias("n"))


@query("spc9_bulk_cache", f"WITH {PT_SQL} SELECT DISTINCT sid FROM pc WHERE sid NOT LIKE '%|view'")
def spc9(spark, sf):
    p, c = spectrum_points(spark, sf), spectrum_cache(spark, sf)
    todo = p.join(c.select("sid"), "sid", "left_anti")
    return spectra.describe(todo, "sid", LO, HI, STEP, bit_width=2, band_width=6).select("sid")


MOMENT_SQL = """q3 AS (SELECT *, (cov_xx + cov_yy + cov_zz) / 3 AS q FROM gm), p3 AS (SELECT *, sqrt(((cov_xx - q) * (cov_xx - q) + (cov_yy - q) * (cov_yy - q) + (cov_zz - q) * (cov_zz - q)
 + 2 * (cov_xy * cov_xy + cov_xz * cov_xz + cov_yz * cov_yz)) / 6) AS p FROM q3),
a3 AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(least(((cov_xx - q) * ((cov_yy - q) * (cov_zz - q) - cov_yz * cov_yz) - cov_xy * (cov_xy * (cov_zz - q) - cov_yz * cov_xz)
 + cov_xz * (cov_xy * cov_yz - (cov_yy - q) * cov_xz)) / (2 * p * p * p), 1.0), -1.0)) / 3 WHEN p = 0 THEN 0.0 END AS angle FROM p3),
e3 AS (SELECT *, q + 2 * p * cos(angle) AS l3, q + 2 * p * cos(angle + 2 * pi() / 3) AS l1 FROM a3), m3 AS (SELECT *, 3 * q - l3 - l1 AS l2 FROM e3)"""


@query("prd5_geometry", f"""WITH p AS (SELECT l_orderkey AS k, l_linenumber AS i, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS o, CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount * 100 AS DOUBLE) AS y, CAST(l_tax * 100 AS DOUBLE) AS z FROM lineitem), c AS (SELECT k, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM p GROUP BY 1), d AS (SELECT p.*, sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) AS r FROM p JOIN c USING (k)),
pd AS (SELECT a.k, min(dd) AS dmin, max(dd) AS dmax, avg(dd) AS dmean, stddev_pop(dd) AS dstd FROM (SELECT a.k, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dd FROM p a JOIN p b ON a.k = b.k AND a.o < b.o) a GROUP BY 1),
gm AS (SELECT k, count(*) AS n, count(*) FILTER (i > 1) AS heavy_count, sqrt(avg(r * r)) AS rg, max(r) AS mr, avg(r) AS ar, stddev_pop(r) AS sr, covar_samp(x, x) AS cov_xx, covar_samp(x, y) AS cov_xy, covar_samp(x, z) AS cov_xz, covar_samp(y, y) AS cov_yy, covar_samp(y, z) AS cov_yz, covar_samp(z, z) AS cov_zz FROM d GROUP BY 1), {MOMENT_SQL}
SELECT k, n, heavy_count, {r('rg', 6, 'radius_gyration')}, {r('mr', 6, 'max_centroid_distance')}, {r('ar', 6, 'mean_centroid_distance')}, {r('sr', 6, 'std_centroid_distance')}, {", ".join(r(f'cov_{e}', 6, f'cov_{e}') for e in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))},
 {r('dmin', 6, 'pair_distance_min')}, {r('dmax', 6, 'pair_distance_max')}, {r('dmean', 6, 'pair_distance_mean')}, {r('dstd', 6, 'pair_distance_std')}, {r('l1', 3, 'moment_1')}, {r('l2', 3, 'moment_2')}, {r('l3', 3, 'moment_3')},
 {r('l3 - (l1 + l2) / 2', 3, 'asphericity')}, {r('CASE WHEN abs(l3) > 1e-12 THEN sqrt(greatest(0.0, 1 - l1 / l3)) END', 3, 'eccentricity')} FROM m3 LEFT JOIN pd USING (k)""")
def prd5(spark, sf):
    d = table(spark, sf, "lineitem").selectExpr("l_orderkey AS k", "CAST(l_quantity AS DOUBLE) AS x", "CAST(l_discount * 100 AS DOUBLE) AS y", "CAST(l_tax * 100 AS DOUBLE) AS z", "l_linenumber > 1 AS h")
    return rounded(spectra.geometry(d, "k", "x", "y", "z", "h"), moment_1=3, moment_2=3, moment_3=3, asphericity=3, eccentricity=3)


# ------------------------------------------------------------------ parsers on real text
@query("src13_sniff_format", """SELECT fmt, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(ltrim(h), '^[\\{\\[]') THEN 'MASSBANK_JSON' WHEN contains(upper(h), '##TITLE') OR contains(upper(h), '##XYDATA') OR contains(upper(h), '##PEAK TABLE') THEN 'JCAMP_DX' WHEN regexp_matches(h, '[,;\\t]') THEN 'NUMERIC_TABLE' ELSE 'UNKNOWN' END AS fmt
FROM (SELECT text AS h FROM conversations UNION ALL SELECT props FROM events)) GROUP BY 1""")
def src13(spark, sf):
    t = table(spark, sf, "conversations").select("text").unionByName(table(spark, sf, "events").select(F.col("props").alias("text")))
    return t.groupBy(parsers.sniff_format("text").alias("fmt")).agg(F.count("*").alias("n"))


@query("src16_page_links", """WITH h AS (SELECT page_id, trim(replace(unnest(regexp_extract_all(html, '(?i)href=[''"]([^''"]+)[''"]', 1)), '&amp;', '&')) AS h FROM pages),
u AS (SELECT page_id, CASE WHEN h LIKE 'http%' THEN h WHEN h LIKE '/%' THEN 'https://example.org' || h ELSE 'https://example.org/cgi/' || h END AS url FROM h WHERE h <> '')
SELECT DISTINCT page_id, url FROM u WHERE regexp_matches(lower(url), '[aeiou]$') OR regexp_matches(url, '(?i)[?&]JCAMP=[^&#]') OR (contains(lower(url), 'download') AND regexp_matches(lower(url), 'ir|jcamp|spectrum'))""")
def src16(spark, sf):
    return parsers.data_links(table(spark, sf, "pages"), "page_id", "html", "https://example.org/cgi/", r"[aeiou]$")


JC = "'##TITLE=' || p_name || chr(10) || '##STATE= ' || CASE WHEN p_size % 2 = 0 THEN 'Vapor' ELSE 'Neat X' END || chr(10) || '##XYDATA=(X++(Y..Y))' || chr(10) || p_size || ' 1.5 2.5' || chr(10) || (p_size + 1) || ' ' || p_partkey || chr(10) || '##END='"


@query("src6_jcamp_points", "SELECT p_partkey, x, y FROM (SELECT p_partkey, unnest([p_size, p_size + 1])::DOUBLE AS x, unnest([1.5, 2.5])::DOUBLE AS y FROM part)")
def src6(spark, sf):
    return parsers.jcamp_points(table(spark, sf, "part").selectExpr("p_partkey", f"{JC} AS t"), "p_partkey", "t")


@query("src7_header_phase", "SELECT CASE WHEN p_size % 2 = 0 THEN 'gas' ELSE 'neat_x' END AS phase, count(*) AS n FROM part GROUP BY 1")
def src7(spark, sf):
    return table(spark, sf, "part").selectExpr(f"{JC} AS t").groupBy(parsers.header_phase("t").alias("phase")).agg(F.count("*").alias("n"))


REC = """'{"id":"' || p_partkey || '","compound":[{"inchiKey":"' || upper(p_brand) || '","names":[{"name":"' || p_name || '"}],"metaData":[{"name":"CAS","value":"' || p_size || '"},{"name":"SMILES","value":"C"}]}],"spectrum":"' || p_size || ':1.5 14:3 14:4","library":{"library":"L' || p_size || '"}}'"""


@query("src8_json_record", "SELECT p_partkey, upper(p_brand) AS inchikey, p_name AS name, CAST(p_size AS VARCHAR) AS cas, 'C' AS smiles, 'L' || p_size AS source_database FROM part")
def src8(spark, sf):
    d = table(spark, sf, "part").selectExpr("p_partkey", f"{REC} AS j")
    c = parsers.record_columns("j")
    return d.select("p_partkey", *[c[k].alias(k) for k in ("inchikey", "name", "cas", "smiles", "source_database")])


@query("src9_response_records", "SELECT p_partkey, CAST(CASE p_size % 3 WHEN 2 THEN 1 ELSE 2 END AS BIGINT) AS n FROM part")
def src9(spark, sf):
    d = table(spark, sf, "part").selectExpr("p_partkey", f"CASE p_size % 3 WHEN 0 THEN '[' || {REC} || ',' || {REC} || ']' WHEN 1 THEN '{{\"results\":[' || {REC} || ',' || {REC} || ']}}' ELSE {REC} END AS j")
    return parsers.response_records(d, "p_partkey", "j").groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("src10_peak_strings", "SELECT DISTINCT p_partkey, mz, CASE WHEN mz = 14 THEN 4.0 ELSE 1.5 END::DOUBLE AS intensity FROM (SELECT p_partkey, unnest([p_size, 14])::DOUBLE AS mz FROM part)")
def src10(spark, sf):
    return parsers.peak_table(table(spark, sf, "part").selectExpr("p_partkey", "p_size || ':1.5 14:3 14:4' AS t"), "p_partkey", "t")


@query("src11_msp_peaks", "SELECT p_partkey, p_size::DOUBLE AS mz, 9.0::DOUBLE AS intensity FROM part UNION ALL SELECT p_partkey, p_size + 0.5::DOUBLE, 3.0::DOUBLE FROM part")
def src11(spark, sf):
    return parsers.msp_peaks(table(spark, sf, "part").selectExpr("p_partkey", "'Name: 7 8' || chr(10) || 'Num Peaks: 3' || chr(10) || p_size || ' 5' || chr(10) || p_size || ' 9' || chr(10) || (p_size + 0.5) || chr(9) || '3' AS t"), "p_partkey", "t")


@query("src12_two_columns", "SELECT p_partkey, p_size::DOUBLE AS x, p_partkey::DOUBLE AS y FROM part UNION ALL SELECT p_partkey, -1.5::DOUBLE, 200.0::DOUBLE FROM part")
def src12(spark, sf):
    return parsers.two_column_points(table(spark, sf, "part").selectExpr("p_partkey", "'# 1 2 head' || chr(10) || p_size || ';' || p_partkey || chr(10) || '-1.5, 2e2 # c' || chr(10) || p_size || ' 77' AS t"), "p_partkey", "t")


@query("src14_index_files", "SELECT CASE p_size % 4 WHEN 0 THEN CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'already_indexed' ELSE 'added' END WHEN 1 THEN 'no_identity' WHEN 2 THEN 'added' ELSE 'unknown_format' END AS status, count(*) AS n FROM part GROUP BY 1")
def src14(spark, sf):
    f = table(spark, sf, "part").selectExpr("'/d/' || CASE WHEN p_size % 4 = 2 THEN 'x_AAAQKTZKLRYKHR-UHFFFAOYSA-N.jdx' ELSE p_partkey || '.txt' END AS path", f"CASE p_size % 4 WHEN 0 THEN {REC} WHEN 3 THEN 'plain words' ELSE {JC} END AS text")
    known = table(spark, sf, "part").where("p_brand IN ('Brand#1', 'Brand#2')").selectExpr("upper(p_brand) AS inchikey")
    return parsers.index_files(f, known).groupBy("status").agg(F.count("*").alias("n"))


IMPORT_KEY = "translate(lpad(CAST(p_partkey AS {t}), 14, '0'), '0123456789', 'ABCDEFGHIJ') || '-UHFFFAOYSA-N'"


@query("src14_import_points", f"""WITH f AS (SELECT p_partkey, p_size, p_size % 5 AS k, {IMPORT_KEY.format(t='VARCHAR')} AS ik FROM part),
q AS (SELECT p_partkey, k, ik, unnest(CASE WHEN k = 2 THEN [10, 11, 12, 20] WHEN k IN (0, 1) THEN [1.5, 2] ELSE [] END::DOUBLE[]) AS x, unnest(CASE WHEN k = 2 THEN [p_size, 2, 30, -1] WHEN k IN (0, 1) THEN [p_size, 3] ELSE [] END::DOUBLE[]) AS y FROM f),
g AS (SELECT p_partkey, count(*) AS n, sum(y) AS sy, min(x) AS lo, max(x) AS hi FROM q GROUP BY 1)
SELECT p_partkey, CASE k WHEN 3 THEN 'unsupported_format' WHEN 4 THEN 'parse_error' WHEN 1 THEN 'unmatched_compound' WHEN 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'already_registered' ELSE 'imported_local' END ELSE 'imported_local' END AS status,
 CASE WHEN k = 2 OR (k = 0 AND p_partkey % 3 <> 0) THEN n END AS points, CASE WHEN k = 2 OR (k = 0 AND p_partkey % 3 <> 0) THEN sy END AS total, CASE WHEN k = 2 OR (k = 0 AND p_partkey % 3 <> 0) THEN lo END AS x_min,
 CASE WHEN k = 2 OR (k = 0 AND p_partkey % 3 <> 0) THEN hi END AS x_max, CASE WHEN k = 2 THEN 'gas' WHEN k = 0 AND p_partkey % 3 <> 0 THEN 'unknown' END AS phase FROM f LEFT JOIN g USING (p_partkey)""")
def src14_import(spark, sf):
    """Raw texts made of part rows: two columns with and without a key, JCAMP with packed and exponent numbers, words, JCAMP without points."""
    nl = "|| chr(10) ||"
    key = IMPORT_KEY.format(t="STRING")
    part = table(spark, sf, "part")
    files = part.selectExpr(f"'/raw/' || p_partkey || '/' || CASE WHEN p_size % 5 = 1 THEN 'x' ELSE {key} END || '.txt' AS path",
                            f"CASE p_size % 5 WHEN 2 THEN '##TITLE=a' {nl} '##STATE=Gas' {nl} '##XYDATA=(X++(Y..Y))' {nl} '10 ' || p_size || '+2+3e1' {nl} '20 -1' WHEN 3 THEN 'plain words' WHEN 4 THEN '##TITLE=a' {nl} '##XYDATA=1' {nl} '##END='"
                            f" ELSE '1.5;' || p_size {nl} '2;3 # c' {nl} '2;9' END AS text")
    index = part.where("p_size % 5 = 0 AND p_partkey % 3 = 0").selectExpr(f"{key} AS inchikey", "'IR' AS spectrum_type", "'Local' AS source_database", "'' AS source_url", "'' AS comment",
                                                                          "1.5D AS wavenumber_min", "2D AS wavenumber_max", "2 AS n_points_processed", "true AS active")
    status, points, rows = ingest.import_files(files, index)
    got = points.groupBy("spectrum_id").agg(F.count("*").alias("points"), F.sum("y").alias("total"))
    kept = rows.join(got, "spectrum_id").select("spectrum_id", "points", "total", F.col("wavenumber_min").alias("x_min"), F.col("wavenumber_max").alias("x_max"), "phase")
    return status.withColumn("p_partkey", F.split("path", "/")[2].cast("bigint")).join(kept, "spectrum_id", "left").select("p_partkey", "status", "points", "total", "x_min", "x_max", "phase")


@query("src15_key_from_name", "SELECT CASE p_size % 3 WHEN 0 THEN 'AAAQKTZKLRYKHR-UHFFFAOYSA-N' WHEN 1 THEN 'AAAQKTZKLRYKHR' ELSE '' END AS inchikey, CASE p_size % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'short' ELSE '' END AS key_kind, count(*) AS n FROM part GROUP BY ALL")
def src15(spark, sf):
    d = table(spark, sf, "part").selectExpr("'/raw/' || CASE p_size % 3 WHEN 0 THEN 'nist_aaaqktzklrykhr-uhfffaoysa-n_' WHEN 1 THEN 'q_AAAQKTZKLRYKHR-UH' ELSE 'p' END || p_partkey || '.jdx' AS p")
    k = parsers.key_from_name("p")
    return d.select(k["inchikey"].alias("inchikey"), k["key_kind"].alias("key_kind")).groupBy("inchikey", "key_kind").agg(F.count("*").alias("n"))


@query("src17_manifest_lookup", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'ir/' || p_partkey || '.csv' WHEN p_size % 3 = 0 THEN 'mass/' || p_partkey || '.csv' END AS manifest_path FROM part")
def src17(spark, sf):
    p = table(spark, sf, "part")
    d = p.selectExpr("p_partkey", "CASE WHEN p_size % 2 = 0 THEN 'C:\\\\x\\\\spectra_bank\\\\ir\\\\' || p_partkey || '.csv' ELSE './old/' || p_partkey || '.csv' END AS path")
    m = p.where("p_size % 2 = 0 OR p_size % 3 = 0").selectExpr("CASE WHEN p_size % 2 = 0 THEN 'spectra_bank/ir/' ELSE '/home/spectra_bank/mass/' END || p_partkey || '.csv' AS path")
    return parsers.manifest_lookup(d, m, "path").select("p_partkey", "manifest_path")


def _scratch(spark) -> str:
    """Folder for written tables: beside the shared checkpoint folder, a temporary one only for a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        import uuid
        return f"{shared}/tables-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return tempfile.mkdtemp(prefix="corvida-tables-")


@query("src4_partitioned_bank", "SELECT event_id, value FROM events WHERE event_type = 'click' AND user_id % 3 = 1")
def src4(spark, sf):
    path = _scratch(spark)
    tables.write_partitioned(events(spark, sf).selectExpr("event_id", "value", "event_type AS descriptor_source", "'p' || (user_id % 3) AS descriptor_profile"), path, ["descriptor_source", "descriptor_profile"])
    return tables.read_bank(spark, path, "click", "p1").select("event_id", "value")


@query("src18_write_csv", "SELECT p_partkey, p_name, CAST(p_retailprice AS DOUBLE) AS price FROM part")
def src18(spark, sf):
    path = _scratch(spark)
    tables.write_partitioned(table(spark, sf, "part").selectExpr("p_partkey", "p_name", "p_retailprice AS price"), path, [], fmt="csv")
    from pyspark.sql import types as T
    return tables.read_csv(spark, path, T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()), T.StructField("price", T.DoubleType())]))
