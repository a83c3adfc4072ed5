"""Normalised codes, priorities, band labels and positional-pattern labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvida.functions.columns import blank_to_null, case_map, col

# Phase words in the order they are looked for, and their normal form.
PHASE_WORDS = (("gas", "gas"), ("vapor", "gas"), ("vapour", "gas"), ("liquid", "liquid"), ("solution", "solution"),
               ("film", "film"), ("kbr", "kbr"), ("nujol", "nujol"), ("solid", "solid"))
# Selection priority per phase (smaller is better); any other phase counts 80.
PHASE_PRIORITY = {"gas": 0, "liquid": 10, "film": 20, "solution": 30, "solid": 40, "kbr": 50, "nujol": 60, "unknown": 90}
OTHER_PHASE = 80
# Confidence priorities; any other level counts 50.
CONFIDENCE_PRIORITY = {"high": 0, "spectral_page_found": 10, "medium": 20, "low": 40, "error": 90}
OTHER_CONFIDENCE = 50


def safe_part(c) -> Column:
    """Letters, digits, dash and single underscores; ``unknown`` when nothing is left."""
    t = F.regexp_replace(F.trim(col(c).cast("string")), r"[^A-Za-z0-9_\-]+", "_")
    t = F.regexp_replace(F.regexp_replace(t, r"_+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.when((t != "") & blank_to_null(c).isNotNull(), t), F.lit("unknown"))


def phase(c) -> Column:
    x = F.lower(F.trim(col(c).cast("string")))
    out = F.when(blank_to_null(c).isNull(), "unknown")
    for word, name in PHASE_WORDS:
        out = out.when(F.contains(x, F.lit(word)), name)
    return out.otherwise(F.lower(safe_part(c)))


def phase_priority(c) -> Column:
    return case_map(phase(c), PHASE_PRIORITY, OTHER_PHASE)


def confidence_priority(c) -> Column:
    return F.coalesce(case_map(F.lower(F.trim(col(c))), CONFIDENCE_PRIORITY, OTHER_CONFIDENCE), F.lit(OTHER_CONFIDENCE))


def quantitative_priority(flag: Column, prefer: bool) -> Column:
    good, other = (0, 1) if prefer else (1, 0)
    return F.when(flag, good).otherwise(other)


def source_name(c) -> Column:
    t = F.trim(col(c).cast("string"))
    return F.coalesce(F.when(~F.lower(t).isin("", "nan", "none"), t), F.lit("unknown"))


def source_code(c) -> Column:
    x = F.lower(F.coalesce(col(c).cast("string"), F.lit("")))
    has = lambda w: F.contains(x, F.lit(w))
    return (F.when(has("nist"), "NIST").when(has("massbank"), "MASSBANK")
            .when(has("user") | has("local"), "LOCAL").otherwise("SRC"))


# Accepted spellings of the two spectrum types.
IR_WORDS = ("ir", "infrared", "infrared spectrum", "ик", "ик-спектр")
MASS_WORDS = ("mass", "ms", "mass spectrum", "mass_spectrum", "масс", "масс-спектр")


def spectrum_type(c) -> Column:
    t = F.trim(col(c).cast("string"))
    return F.when(F.lower(t).isin(*IR_WORDS), "IR").when(F.lower(t).isin(*MASS_WORDS), "Mass").otherwise(t)


def _bands(c, cuts: Sequence[tuple[float, str]], top: str, missing: str, below: bool) -> Column:
    c = col(c)
    out = F.when(c.isNull() | F.isnan(c), missing)
    for cut, name in cuts:
        out = out.when(c < cut if below else c >= cut, name)
    return out.otherwise(top)


def consistency_level(score) -> Column:
    """Score bands below 2, 3, 4, 6 and above."""
    return _bands(score, ((2, "normal"), (3, "weak_warning"), (4, "possible_break"), (6, "strong_break")),
                  "critical_break", "not_assessed", True)


def space_class(sim) -> Column:
    """Density class from the nearest-neighbour similarity."""
    return _bands(sim, ((0.85, "Dense area"), (0.70, "Moderate area"), (0.50, "Sparse area")),
                  "Singleton / outlier", "Singleton / outlier", False)


def correlation_strength(rho) -> Column:
    return _bands(F.abs(col(rho)), ((0.7, "strong"), (0.4, "moderate"), (0.2, "weak")), "very_weak", "undefined", False)


def quality_label(r2) -> Column:
    return _bands(r2, ((0.85, "excellent"), (0.70, "good"), (0.50, "acceptable")), "weak", "undefined", False)


def model_quality(r2, rmse=None, mape=None, n=None, r2_cv=None, outside_ad=None) -> Column:
    """Combined rule: error limits, then over-fit, small-sample and limited-domain overrides."""
    r2 = col(r2)

    def within(c, limit):
        return F.lit(True) if c is None else (col(c).isNull() | (col(c) < limit))

    level = (F.when((r2 >= 0.85) & within(rmse, 5) & within(mape, 10), "excellent")
             .when((r2 >= 0.70) & within(rmse, 10) & within(mape, 20), "good")
             .when((r2 >= 0.50) & within(rmse, 20) & within(mape, 40), "moderate").otherwise("poor"))
    out = F.when(r2.isNull(), "default")
    if r2_cv is not None:
        out = out.when(r2 - col(r2_cv) > 0.2, "overfitted")
    if n is not None:
        out = out.when((col(n) < 30) & level.isin("excellent", "good"), "small_sample")
    if outside_ad is not None:
        out = out.when(col(outside_ad) > 0.2, "limited_ad")
    return out.otherwise(level)


def pattern_items(pattern) -> Column:
    """Trimmed, non-empty items of ``2-methyl; 3-methyl``."""
    return F.filter(F.transform(F.split(col(pattern), ";"), lambda p: F.trim(p)), lambda p: p != "")


def pattern_family(pattern) -> Column:
    """Pattern without positions: ``2-methyl; 3-methyl`` -> ``methyl+methyl``."""
    names = F.transform(pattern_items(pattern), lambda p: F.regexp_replace(p, r"^[0-9,]+-", ""))
    return F.array_join(F.array_sort(names), "+")


# Multiplying prefixes in condensed labels and in exact methyl labels, and the series names by number of methyl groups.
MULTIPLIERS = {2: "di", 3: "tri", 4: "tetra"}
METHYL_MULTIPLIERS = {1: "", 2: "di", 3: "tri", 4: "tetra", 5: "penta", 6: "hexa"}
METHYL_SERIES = {1: "methylalkanes", 2: "dimethylalkanes", 3: "trimethylalkanes", 4: "tetramethylalkanes"}
# Position lists that have a series of their own.
OWN_SERIES = ("2-methylalkanes", "3-methylalkanes", "4-methylalkanes", "2,2-dimethylalkanes", "2,3-dimethylalkanes", "2,4-dimethylalkanes", "3,3-dimethylalkanes")


def _split_items(pattern) -> tuple[Column, Column]:
    """(positions, names) of the items; an item without a hyphen is a name for the broad series and a position for the exact one."""
    items = pattern_items(pattern)
    at = F.filter(F.transform(items, lambda p: F.trim(F.substring_index(p, "-", 1))), lambda p: p != "")
    names = F.transform(items, lambda p: F.when(F.contains(p, F.lit("-")), F.trim(F.regexp_replace(p, r"^[^-]*-", ""))).otherwise(p))
    return at, names


def broad_series(pattern) -> Column:
    """Series by the kinds of substituents, whatever their positions."""
    text = F.coalesce(F.trim(col(pattern)), F.lit(""))
    _, names = _split_items(text)
    total = F.size(names)
    methyl, ethyl = F.size(F.filter(names, lambda n: n == "methyl")), F.size(F.filter(names, lambda n: n == "ethyl"))
    mixed = F.lit("mixed-substituted alkanes")
    return (F.when(text == "", "other / unclassified").when(text == "n-alkane", "n-alkanes")
            .when(methyl == total, F.coalesce(case_map(total, METHYL_SERIES), mixed))
            .when((ethyl > 0) & (methyl == 0), "ethyl-substituted alkanes").when(ethyl + methyl > 0, mixed).otherwise("other / unclassified"))


def exact_series(pattern) -> Column:
    """Series by kinds and positions: ``2,3-dimethylalkanes``, ``3-ethylalkanes``, or the pattern itself."""
    text = F.coalesce(F.trim(col(pattern)), F.lit(""))
    at, _ = _split_items(text)
    named = F.filter(pattern_items(text), lambda p: p.rlike("-.*[^ ]"))
    names = F.transform(named, lambda p: F.trim(F.regexp_replace(p, r"^[^-]*-", "")))
    n, places = F.size(names), F.concat(F.array_join(at, ","), F.lit("-"))

    def only(word):
        return (n > 0) & F.forall(names, lambda x: x == word)

    plain_count = F.concat(n.cast("string"), F.lit("-"))
    return (F.when(text == "", "unclassified").when(text == "n-alkane", "n-alkanes")
            .when(only("methyl"), F.concat(places, F.coalesce(case_map(n, METHYL_MULTIPLIERS), plain_count), F.lit("methylalkanes")))
            .when(only("ethyl"), F.concat(places, F.when(n == 1, "").otherwise(plain_count), F.lit("ethylalkanes")))
            .otherwise(F.concat(F.replace(text, F.lit("; "), F.lit(",")), F.lit("-substituted alkanes"))))


def series_family(subs) -> Column:
    """Series name of a substituted chain as used for ordering: common methyl positions by name, others by kind and number."""
    s = _ordered(col(subs))
    total = F.size(s)
    methyl, ethyl = F.filter(s, lambda x: x["name"] == "methyl"), F.filter(s, lambda x: x["name"] == "ethyl")
    some_methyl, some_ethyl = F.size(methyl) > 0, F.size(ethyl) > 0
    by_number = case_map(F.when(F.size(methyl) == total, total), METHYL_SERIES)
    placed = F.concat(F.array_join(F.transform(methyl, lambda x: x["position"].cast("string")), ","), F.lit("-"), by_number)
    return (F.when(total == 0, "n-alkanes").when(some_ethyl & some_methyl, "ethyl-methyl alkanes").when(some_ethyl, "ethyl-substituted alkanes")
            .when(placed.isin(*OWN_SERIES), placed).when(by_number.isNotNull(), by_number)
            .when(total >= 4, "highly-branched alkanes").otherwise("branched alkanes"))


def _ordered(subs: Column) -> Column:
    return F.array_sort(F.transform(subs, lambda s: F.struct(s["position"].alias("position"), s["name"].alias("name"))))


def oriented(subs, length) -> Column:
    """Substituents ordered from the chain end that gives the smaller position list."""
    subs, n = col(subs), col(length)
    fwd = _ordered(subs)
    rev = _ordered(F.transform(subs, lambda s: F.struct((n + 1 - s["position"]).alias("position"), s["name"].alias("name"))))
    return F.when(fwd <= rev, fwd).otherwise(rev)


def scheme_label(subs) -> Column:
    """``methyl@2;methyl@3`` or ``none``."""
    parts = F.transform(_ordered(col(subs)), lambda s: F.concat(s["name"], F.lit("@"), s["position"].cast("string")))
    return F.when(F.size(col(subs)) == 0, "none").otherwise(F.array_join(parts, ";"))


def condensed_label(subs) -> Column:
    """``2,3-dimethyl``: one item per substituent name, names in alphabetical order."""
    s = _ordered(col(subs))
    names = F.array_sort(F.array_distinct(F.transform(s, lambda x: x["name"])))

    def item(name):
        pos = F.transform(F.filter(s, lambda x: x["name"] == name), lambda x: x["position"].cast("string"))
        count = F.size(pos)
        prefix = F.when(count == 1, "").otherwise(F.coalesce(case_map(count, MULTIPLIERS), F.concat(count.cast("string"), F.lit("-"))))
        return F.concat(F.array_join(pos, ","), F.lit("-"), prefix, name)

    return F.array_join(F.transform(names, item), "-")


def series_label(subs, stem: str = "alkanes", plain: str = "n-") -> Column:
    """``2-methylalkanes``, ``2,2-dimethylalkanes`` or ``n-alkanes``."""
    return F.when(F.size(col(subs)) == 0, plain + stem).otherwise(F.concat(condensed_label(subs), F.lit(stem)))
