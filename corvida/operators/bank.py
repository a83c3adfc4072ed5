"""Keyed banks, spectrum lookup and selection, search journal and scope matching."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.functions.columns import TRUE_WORDS, blank_to_null, truthy
from corvida.functions.labels import confidence_priority, phase, phase_priority, quantitative_priority, source_name, spectrum_type

# Journal statuses by class.
POSITIVE = ("found_downloaded", "already_in_bank")
SOFT = ("candidate_link_found", "candidate_found")
ERROR = ("search_error", "download_error", "parse_error", "no_numeric_spectrum", "search_timeout")
NEGATIVE = ("not_found_in_all_sources", "not_found", "invalid_structure")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key as an aggregate: copies of a hot key collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return g.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def upsert(bank: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Bank after adding rows: latest row per key; rows without a key are all kept."""
    both = bank.unionByName(new, allowMissingColumns=True)
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & blank_to_null(k).isNotNull()
    return keep_last(both.where(keyed), keys, order).unionByName(both.where(~keyed))


def split_cached(keys: DataFrame, bank: DataFrame, key: str = "bank_key", order: Sequence[str] = ("created_at",)) -> tuple[DataFrame, DataFrame]:
    """(cached rows joined to the input, input rows to compute); a null key is always missing."""
    latest = keep_last(bank.where(F.col(key).isNotNull()), [key], order)
    return keys.join(latest, key), keys.join(latest.select(key), key, "left_anti")


def attach_target(df: DataFrame, targets: DataFrame, ident: str) -> DataFrame:
    return df.join(targets, ident, "left")


def enrich(df: DataFrame, bank: DataFrame, key: str, compute: Callable, schema: str, order: Sequence[str] = ("created_at",)) -> tuple[DataFrame, DataFrame]:
    """(all rows with descriptors, new bank rows): cached rows are looked up, each missing distinct key is
    computed once by the user's batch function (iterator of pandas frames), failed rows stay null."""
    latest = keep_last(bank.where(F.col(key).isNotNull()), [key], order)
    missing = df.where(F.col(key).isNotNull()).select(key).distinct().join(latest.select(key), key, "left_anti")
    new = missing.mapInPandas(compute, schema)
    ready = latest.select(*new.columns).unionByName(new)
    return df.join(ready, key, "left"), new


def descriptor_report(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows per status with the total repeated."""
    return df.groupBy(status).agg(F.count("*").alias("n"))


def numeric_descriptor_columns(df: DataFrame, prefix: str) -> list[str]:
    """Columns with the prefix that hold at least one number."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    if not cols:
        return []
    row = df.agg(*[F.count(F.col(c).cast("string").try_cast("double")).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] > 0]


def assemble(sources: Mapping[str, DataFrame], ident: str) -> DataFrame:
    """Inner join of descriptor tables on the row id, each column prefixed by its source."""
    out = None
    for prefix, df in sources.items():
        d = df.select(ident, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != ident])
        out = d if out is None else out.join(d, ident)
    return out


def tiered_match(compounds: DataFrame, index: DataFrame, first: str, second: str, order: Sequence[str], ident: str) -> DataFrame:
    """One index row per compound: match on the first key, else on the second; smallest ``order`` wins.

    The index is reduced to one row per key before either join.
    """
    body = [c for c in index.columns]

    def best(key):
        return index.where(blank_to_null(key).isNotNull()).groupBy(F.col(key).alias(f"_{key}")).agg(F.min_by(F.struct(*body), F.struct(*order)).alias(f"_m_{key}"))

    a, b = best(first), best(second)
    j = compounds.join(a, F.col(first) == F.col(f"_{first}"), "left").join(b, F.col(second) == F.col(f"_{second}"), "left")
    m = F.coalesce(f"_m_{first}", f"_m_{second}")
    tier = F.when(F.col(f"_m_{first}").isNotNull(), 1).when(F.col(f"_m_{second}").isNotNull(), 2)
    return j.select(*compounds.columns, m.alias("match"), tier.alias("tier")).select(*[F.col(c) for c in compounds.columns], "tier", *[F.col(f"match.{c}").alias(f"found_{c}") for c in body if c not in (first, second)])


def candidate_spectra(compounds: DataFrame, index: DataFrame, kind: str, ident: str) -> DataFrame:
    """All active spectra of a compound by full key or canonical id (two equi joins, no OR), normalised."""
    act = index.where((spectrum_type("spectrum_type") == kind) & (truthy("active", ("active", "")) | F.col("active").isNull()))
    a = compounds.where(blank_to_null("inchikey").isNotNull()).select(ident, "inchikey").join(act, "inchikey")
    b = compounds.where(blank_to_null("canonical").isNotNull()).select(ident, "canonical").join(act, "canonical")
    cols = [ident, *[c for c in index.columns]]
    u = a.select(*cols).unionByName(b.select(*cols)).dropDuplicates([ident, "spectrum_id"])
    return u.withColumns({"phase_norm": phase("phase"), "phase_priority": phase_priority("phase"), "source_norm": source_name("source"),
                          "intensity_norm": F.coalesce(F.lower(blank_to_null("intensity_type")), F.lit("unknown"))})


def ready_filter(df: DataFrame, phase_mode: str = "prefer_gas", phases: Sequence[str] = (), sources: Sequence[str] | None = None,
                 intensities: Sequence[str] | None = None, experimental_only: bool = True) -> DataFrame:
    """Experimental-only, source, intensity and phase filters on normalised candidates."""
    out = df
    if experimental_only:
        out = out.where(truthy("is_experimental", ("experimental", "")))
    if sources is not None:
        out = out.where(F.col("source_norm").isin(*sources))
    if intensities is not None:
        out = out.where(F.col("intensity_norm").isin(*intensities))
    if phase_mode == "only_gas":
        out = out.where("phase_norm = 'gas'")
    elif phase_mode == "manual":
        out = out.where(F.col("phase_norm").isin(*phases)) if phases else out.limit(0)
    return out


def best_spectrum(candidates: DataFrame, ident: str, prefer_quantitative: bool = False, phase_mode: str = "prefer_gas") -> DataFrame:
    """The preferred spectrum of every compound with the reason it was chosen."""
    quant = quantitative_priority(truthy("is_quantitative"), prefer_quantitative)
    order = F.struct(F.when(F.col("has_descriptor"), 0).otherwise(1), F.when(F.col("has_file"), 0).otherwise(1), F.col("phase_priority"), quant,
                     confidence_priority("confidence_level"), F.col("spectrum_id"))
    g = candidates.groupBy(ident).agg(F.min_by(F.struct("spectrum_id", "phase_norm"), order).alias("b"))
    p = F.col("b.phase_norm")
    reason = {"prefer_gas": F.when(p == "gas", F.lit("selected_gas_by_priority")).otherwise(F.concat(F.lit("gas_not_available_selected_"), p)), "only_gas": F.lit("selected_only_gas"),
              "manual": F.concat(F.lit("selected_from_manual_phases_"), p), "any": F.concat(F.lit("selected_any_active_"), p)}[phase_mode]
    return g.select(ident, "b.spectrum_id", "b.phase_norm", reason.alias("selection_reason"))


def matches_settings(settings: Mapping[str, object]) -> Column:
    """Row predicate: flags by synonym, numbers within 1e-9, text trimmed."""
    out = F.lit(True)
    for c, want in settings.items():
        if isinstance(want, bool):
            t = F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
            out = out & (t.isin(*TRUE_WORDS[:4]) if want else t.isin("false", "0", "no", "n", ""))
        elif isinstance(want, (int, float)):
            out = out & F.coalesce(F.abs(F.col(c).cast("string").try_cast("double") - float(want)) <= 1e-9, F.lit(False))
        else:
            out = out & (F.trim(F.col(c).cast("string")) == str(want).strip())
    return out


def duplicate_spectrum(new: DataFrame, index: DataFrame, ident: str) -> DataFrame:
    """(id, duplicate_of, tier) for new spectra already in the index: same compound, type and database, then
    url, then splash inside the comment, then axis range within 1e-6 and the same point count.

    The range test joins on rounded bounds and their neighbours, so it stays an equi join.
    """
    key = ["compound", "spectrum_type", "source_database"]
    ix = index.select(*key, F.col("spectrum_id").alias("_sid"), F.col("source_url").alias("_url"), F.col("comment").alias("_c"), F.col("x_min").alias("_lo"), F.col("x_max").alias("_hi"), F.col("n_points").alias("_n"))
    url = new.join(ix, key).where((F.col("source_url") != "") & (F.col("source_url") == F.col("_url"))).select(ident, "_sid", F.lit(1).alias("tier"))
    spl = new.where("splash <> ''").join(ix.where("_c <> ''"), key).where(F.contains("_c", "splash")).select(ident, "_sid", F.lit(2).alias("tier"))
    grid = 1e-6
    cell = lambda c: F.floor(F.col(c) / grid)
    a = new.withColumns({"_a": F.explode(F.array(cell("x_min") - 1, cell("x_min"), cell("x_min") + 1))}).withColumn("_b", F.explode(F.array(cell("x_max") - 1, cell("x_max"), cell("x_max") + 1)))
    b = ix.withColumns({"_a": cell("_lo"), "_b": cell("_hi")})
    num = a.join(b, [*key, "_a", "_b"]).where((F.abs(F.col("x_min") - F.col("_lo")) <= grid) & (F.abs(F.col("x_max") - F.col("_hi")) <= grid) & (F.col("n_points") == F.col("_n"))).select(ident, "_sid", F.lit(3).alias("tier"))
    g = url.unionByName(spl).unionByName(num).groupBy(ident).agg(F.min(F.struct("tier", "_sid")).alias("m"))
    return g.select(ident, F.col("m._sid").alias("duplicate_of"), "m.tier")


def journal_decision(journal: DataFrame, sources_key: str, keys: Sequence[str] = ("key", "spectrum_type"), order: str = "ts") -> DataFrame:
    """Per key: reuse the latest positive result; any candidate or error means search again; reuse a
    negative result only when it was found with the same sources."""
    s = F.lower(F.trim("status"))
    pos, again = s.isin(*POSITIVE), s.isin(*SOFT, *ERROR)
    neg = s.isin(*NEGATIVE) & (F.col("sources_key") == sources_key)
    g = journal.groupBy(*keys).agg(F.max_by(F.when(pos, s), F.when(pos, F.col(order))).alias("_p"), F.count_if(again).alias("_again"), F.max_by(F.when(neg, s), F.when(neg, F.col(order))).alias("_n"))
    decision = F.when(F.col("_p").isNotNull(), "use_positive").when(F.col("_again") > 0, "search_again").when(F.col("_n").isNotNull(), "use_negative").otherwise("search_again")
    return g.select(*keys, decision.alias("decision"), F.when(F.col("_p").isNotNull(), F.col("_p")).when(F.col("_again") == 0, F.col("_n")).alias("status"))


def journal_lookup(requests: DataFrame, journal: DataFrame, sources_key: str, first: str, second: str, kind: str = "spectrum_type", order: str = "ts") -> DataFrame:
    """Decision per request by its first identity, by the second one where the journal has no row for the first.

    Old journal rows without a sources key get it from their list of sources (``a | b`` becomes ``a|b``).
    """
    key = F.trim(F.coalesce("sources_key", F.lit("")))
    if "selected_sources" in journal.columns:
        key = F.when(key == "", F.trim(F.replace(F.coalesce("selected_sources", F.lit("")), F.lit(" | "), F.lit("|")))).otherwise(key)
    j = journal.withColumn("sources_key", key)
    out = requests
    for i, c in enumerate((first, second), 1):
        d = journal_decision(j.withColumn(c, F.trim(c)).where(F.col(c) != ""), sources_key, (c, kind), order)
        out = out.join(d.select(F.col(c).alias(f"_k{i}"), F.col(kind).alias(f"_t{i}"), F.struct("decision", "status").alias(f"_d{i}")), (F.trim(out[c]) == F.col(f"_k{i}")) & (out[kind] == F.col(f"_t{i}")), "left")
    by = F.when(F.col("_d1").isNotNull(), "first").when(F.col("_d2").isNotNull(), "second").otherwise("none")
    best = F.coalesce("_d1", "_d2")
    return out.withColumns({"matched_by": by, "decision": F.coalesce(best["decision"], F.lit("search_again")), "status": best["status"]}).drop("_k1", "_k2", "_t1", "_t2", "_d1", "_d2")


def not_found_table(journal: DataFrame, key: str, source: str, status: str, sources: Sequence[str], order: str = "ts") -> DataFrame:
    """One row per key: latest status per source, checked sources and totals by status class."""
    last = journal.groupBy(key, source).agg(F.max_by(status, order).alias("_s"))
    wide = last.groupBy(key).agg(*[F.max(F.when(F.col(source) == s, F.col("_s"))).alias(s) for s in sources], F.array_join(F.array_sort(F.collect_set(source)), "; ").alias("checked_sources"),
                                 F.count_if(F.col("_s").isin(*NEGATIVE)).alias("total_not_found"), F.count_if(F.col("_s").isin(*ERROR)).alias("total_errors"), F.count_if(F.col("_s").isin(*SOFT)).alias("total_candidates"))
    return wide


def clear_journal(journal: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(rows kept, counts)."""
    drop = F.coalesce(condition, F.lit(False))
    return journal.where(~drop), journal.agg(F.count("*").alias("before"), F.count_if(drop).alias("removed"), F.count_if(~drop).alias("after"))


def scope_match(compounds: DataFrame, cards: DataFrame, ident: str, block: int = 256, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """(id, model_id, applicability, reasons): every compound against every model card, any number of cards.

    ``compounds`` has tags, atoms, carbon_count and valid; ``cards`` has model_id, has_scope, excluded_tags, required_tags,
    allowed_atoms, carbon_min, carbon_max and allowed_tags. Cards are dealt into blocks of about ``block``; a compound meets one
    block per joined row. The card table is broadcast only while its counted size is below ``broadcast_bytes``, so that
    compounds are not shuffled; above that both sides meet by block, and skewed blocks are split."""
    none = F.array().cast("array<string>")
    texts = ("excluded_tags", "required_tags", "allowed_atoms", "allowed_tags")
    cards = cards.select("model_id", F.coalesce("has_scope", F.lit(False)).alias("has_scope"), "carbon_min", "carbon_max", *[F.coalesce(c, none).alias(c) for c in texts])
    bytes_ = sum((F.coalesce(F.octet_length(F.array_join(c, " ")), F.lit(0)) + 16 * F.size(c) for c in texts), F.octet_length("model_id") + 64)
    size = cards.agg(F.count("*").alias("n"), F.coalesce(F.sum(bytes_), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size["n"] // block))
    cards = cards.withColumn("_block", F.pmod(F.xxhash64("model_id"), F.lit(blocks)).cast("int"))
    rows = compounds.select(ident, F.coalesce("tags", none).alias("tags"), F.coalesce("atoms", none).alias("atoms"), "carbon_count", F.coalesce("valid", F.lit(False)).alias("valid"),
                            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    d = rows.join(F.broadcast(cards) if size["b"] <= broadcast_bytes else cards, "_block")
    hit, miss = F.array_sort(F.array_intersect("tags", "excluded_tags")), F.array_sort(F.array_except("required_tags", "tags"))
    extra = F.when(F.size("allowed_atoms") > 0, F.array_sort(F.array_except("atoms", F.array_append("allowed_atoms", F.lit("H"))))).otherwise(none)
    d = d.withColumns({"_hit": hit, "_miss": miss, "_extra": extra, "_low": F.coalesce(F.col("carbon_count") < F.col("carbon_min"), F.lit(False)),
                       "_high": F.coalesce(F.col("carbon_count") > F.col("carbon_max"), F.lit(False)),
                       "_off": (F.size("allowed_tags") > 0) & (F.size(F.array_intersect("tags", "allowed_tags")) == 0)})
    hard = (F.size("_hit") > 0) | (F.size("_miss") > 0) | (F.size("_extra") > 0)
    verdict = (F.when(~F.col("valid"), "not_suitable").when(~F.col("has_scope"), "undefined").when(hard, "not_suitable")
               .when(F.col("_low") | F.col("_high") | F.col("_off"), "partial").otherwise("suitable"))
    listed = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.array_join(c, ", ")))
    found = F.concat_ws("; ", listed("excluded", "_hit"), listed("missing", "_miss"), listed("atoms", "_extra"), F.when(F.col("_low"), "carbon below range"),
                        F.when(F.col("_high"), "carbon above range"), F.when(F.col("_off"), "no allowed class"))
    reasons = F.when(~F.col("valid"), "invalid structure").when(~F.col("has_scope"), "no scope").when(found == "", "scope matches").otherwise(found)
    return d.select(ident, "model_id", verdict.alias("applicability"), reasons.alias("reasons"))


def first_of_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Distinct candidates: first row of each composite key."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return g.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


# Additive score of a mass-spectrum candidate.
IDENTITY_SCORE = {"exact_inchikey": 1000, "same_connectivity_inchikey": 700, "query_match_no_record_inchikey": 300}


def mass_candidate_score() -> Column:
    """Identity, MS level, polarity, instrument, database and peak-count points."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    conf, level, mode, inst = low("confidence_level"), low("ms_level"), low("ionization_mode"), low("instrument")
    origin = F.concat_ws(" ", low("source_database"), low("source"), low("source_url"))
    has = lambda c, w: F.contains(c, F.lit(w))
    n = F.coalesce(F.col("peak_count"), F.lit(0))
    ident = F.lit(0)
    for k, v in IDENTITY_SCORE.items():
        ident = F.when(conf == k, v).otherwise(ident)
    ident = F.when(has(conf, "mismatch") | has(conf, "rejected"), -5000).otherwise(ident)
    return (ident + F.when(level.isin("ms1", "ms", ""), 300).when(has(level, "ms2") | has(level, "ms/ms") | has(level, "msn"), -500).otherwise(0)
            + F.when(mode.isin("positive", "pos", "+", ""), 150).when(mode.isin("negative", "neg", "-"), -150).otherwise(0)
            + F.when(has(inst, "ei-b"), 250).when(has(inst, "ei"), 200).when(has(inst, "ci"), -50).otherwise(0)
            + F.when(has(origin, "massbank"), 100).otherwise(0) + F.when(has(origin, "mona"), 50).otherwise(0)
            + F.when(n <= 0, -10000).otherwise(0) + F.least(n, F.lit(200)) * 0.5)


def best_mass_candidate(df: DataFrame, key: str) -> DataFrame:
    """Best candidate per key: its own ``candidate_score`` (where given) plus the points above, then peaks, then accession."""
    base = F.coalesce(F.col("candidate_score").cast("double"), F.lit(0.0)) if "candidate_score" in df.columns else F.lit(0.0)
    s = df.withColumn("score", base + mass_candidate_score())
    g = s.groupBy(key).agg(F.max(F.struct("score", F.coalesce("peak_count", F.lit(0)).alias("peaks"), "accession")).alias("b"))
    return g.select(key, "b.accession", F.col("b.score").cast("double").alias("score"))
