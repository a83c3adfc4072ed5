"""Numeric cleaning, matrix preparation, filters and key tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.functions.columns import blank_to_null, finite, number_of
from corvida.functions.ranks import exact_quantiles


def numeric_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace each listed column by its numeric reading (null where unreadable)."""
    return df.withColumns({c: number_of(df, c) for c in cols})


def long_values(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., name, value): one row per cell of the listed columns."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.name", "_c.value")


def column_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact medians of the listed columns; one small row per column reaches the driver."""
    rows = exact_quantiles(long_values(df, cols), ["name"], "value", {"m": 0.5}, few=True).collect()
    return {r["name"]: r["m"] for r in rows}


def clean_numeric(df: DataFrame, cols: Sequence[str], keep_constant: bool = False) -> tuple[DataFrame, list[str]]:
    """Coerce, drop empty columns, fill gaps with the median and drop constant columns.

    Returns the cleaned frame and the surviving column names.
    """
    work = numeric_columns(df, cols).withColumns({c: finite(c) for c in cols})
    stats = work.agg(*[
        a for c in cols
        for a in (F.count(c).alias(f"n_{c}"), F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), )
    ], F.count("*").alias("_rows")).first()
    filled = [c for c in cols if stats[f"n_{c}"] > 0]
    gaps = [c for c in filled if stats[f"n_{c}"] < stats["_rows"]]
    med = column_medians(work, gaps) if gaps else {}

    def constant(c):
        lo, hi = stats[f"lo_{c}"], stats[f"hi_{c}"]
        if lo != hi:
            return False
        return c not in med or med[c] == lo

    keep = filled if keep_constant else [c for c in filled if not constant(c)]
    work = work.withColumns({c: F.coalesce(F.col(c), F.lit(med[c])) for c in keep if c in med})
    return work.drop(*[c for c in cols if c not in keep]), keep


def prepare_matrix(df: DataFrame, target: str, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Rows with a readable target and at least one readable descriptor, then cleaned."""
    work = numeric_columns(df, [target, *cols])
    work = work.where(F.col(target).isNotNull() & F.coalesce(*[F.col(c) for c in cols]).isNotNull())
    return clean_numeric(work, cols)


def align_columns(df: DataFrame, required: Sequence[str], medians: dict[str, float] | None = None
                  ) -> tuple[DataFrame, list[str]]:
    """Shape a batch to a model's columns: absent ones become 0, gaps the (batch) median."""
    missing = [c for c in required if c not in df.columns]
    have = [c for c in required if c in df.columns]
    work = df.withColumns({**{c: F.lit(0.0) for c in missing}, **{c: finite(number_of(df, c)) for c in have}})
    med = medians if medians is not None else (column_medians(work, have) if have else {})
    fill = {c: F.coalesce(F.col(c), F.lit(med.get(c) if med.get(c) is not None else 0.0)) for c in have}
    return (work.withColumns(fill) if fill else work), missing


class MedianImputer(Estimator):
    """Fit exact medians (0 for an empty column) and fill gaps with them."""

    def __init__(self, cols: Sequence[str]):
        super().__init__()
        self.cols = list(cols)

    def _fit(self, df: DataFrame) -> "MedianImputerModel":
        work = df.withColumns({c: finite(c) for c in self.cols})
        med = column_medians(work, self.cols)
        return MedianImputerModel({c: med.get(c, 0.0) for c in self.cols})


class MedianImputerModel(Model):
    def __init__(self, medians: dict[str, float]):
        super().__init__()
        self.medians = medians

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(finite(c), F.lit(float(m))) for c, m in self.medians.items()})


class Standardizer(Estimator):
    """Centre and divide by the population deviation (a zero deviation counts as 1)."""

    def __init__(self, cols: Sequence[str], prefix: str = ""):
        super().__init__()
        self.cols, self.prefix = list(cols), prefix

    def _fit(self, df: DataFrame) -> "StandardizerModel":
        row = df.agg(*[a for c in self.cols
                       for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
        return StandardizerModel({c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in self.cols}, self.prefix)


class StandardizerModel(Model):
    def __init__(self, moments: dict[str, tuple[float, float]], prefix: str = ""):
        super().__init__()
        self.moments, self.prefix = moments, prefix

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            f"{self.prefix}{c}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.moments.items()
        })


def prediction_table(df: DataFrame, y: str, y_pred: str, keep: Sequence[str] = (), label: str | None = None) -> DataFrame:
    """Experimental, calculated and error = experimental - calculated."""
    out = [*keep, F.col(y).alias("y_true"), F.col(y_pred).alias("y_pred"), (F.col(y) - F.col(y_pred)).alias("error")]
    if label is not None:
        out.append(F.lit(label).alias("split"))
    return df.select(*out)


def error_table(df: DataFrame, y: str, y_pred: str, keep: Sequence[str] = ()) -> DataFrame:
    """Error = calculated - experimental, with its absolute value and square."""
    e = F.col(y_pred) - F.col(y)
    return df.select(*keep, F.col(y).alias("experimental"), F.col(y_pred).alias("predicted"),
                     e.alias("error"), F.abs(e).alias("absolute_error"), (e * e).alias("squared_error"))


def key_table(df: DataFrame, canonical: str, inchikey: str, valid: Column | None = None) -> DataFrame:
    """Lookup key (full key first, canonical id second) and a status per row."""
    can, key = blank_to_null(canonical), blank_to_null(inchikey)
    ok = valid if valid is not None else F.lit(True)
    status = F.when(can.isNull() & key.isNull(), "empty").when(~ok, "invalid").otherwise("ok")
    return df.withColumns({"bank_key": F.when(ok, F.coalesce(key, can)), "key_status": status})


def structural_filter(
    df: DataFrame, *, valid: Column, atoms: str | None = None,
    elements: Sequence[str] = (), all_elements: bool = False,
    tags: str | None = None, groups: Sequence[str] = (), all_groups: bool = False,
    patterns: str | None = None, wanted_patterns: Sequence[str] = (), all_patterns: bool = False,
    aromatic: bool | None = None, aromatic_count: str | None = None, only_ch: str | None = None,
    carbon: str | None = None, carbon_min: int | None = None, carbon_max: int | None = None,
    hetero: str | None = None, hetero_min: int | None = None, hetero_max: int | None = None,
    text: str | None = None, contains: str = "", match_any: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Keep rows meeting all (or any) of the given conditions; second frame is the report."""
    conds: list[tuple[str, Column]] = [("valid", valid)]

    def set_condition(column, wanted, every):
        w = F.array(*[F.lit(x) for x in wanted])
        return F.size(F.array_except(w, F.col(column))) == 0 if every else F.arrays_overlap(F.col(column), w)

    extra = {}
    if elements:
        conds.append(("elements", set_condition(atoms, elements, all_elements)))
    if groups:
        conds.append(("groups", set_condition(tags, groups, all_groups)))
        extra["matched_groups"] = F.array_join(F.array_intersect(F.array(*[F.lit(x) for x in groups]), F.col(tags)), "; ")
    if wanted_patterns:
        conds.append(("patterns", set_condition(patterns, wanted_patterns, all_patterns)))
        extra["matched_patterns"] = F.array_join(
            F.array_intersect(F.array(*[F.lit(x) for x in wanted_patterns]), F.col(patterns)), "; ")
    if aromatic is not None:
        conds.append(("aromatic", F.col(aromatic_count) > 0 if aromatic else F.col(aromatic_count) == 0))
    if only_ch:
        conds.append(("only_ch", F.col(only_ch)))
    for name, column, low, high in (("carbon", carbon, carbon_min, carbon_max), ("hetero", hetero, hetero_min, hetero_max)):
        if low is not None:
            conds.append((f"{name}_min", F.col(column) >= low))
        if high is not None:
            conds.append((f"{name}_max", F.col(column) <= high))
    if text and contains.strip():
        conds.append(("text", F.contains(F.lower(F.col(text)), F.lit(contains.strip().lower()))))
    mask = None
    for _, c in conds:
        c = F.coalesce(c, F.lit(False))
        mask = c if mask is None else (mask | c if match_any else mask & c)
    work = df.withColumns({**extra, "_keep": mask})
    report = work.agg(
        F.count("*").alias("total"), F.count_if(F.coalesce(valid, F.lit(False))).alias("valid"),
        F.count_if("_keep").alias("kept"), F.lit(len(conds)).cast("bigint").alias("conditions"),
        F.lit(", ".join(n for n, _ in conds)).alias("condition_list"),
    )
    return work.where("_keep").drop("_keep"), report


# Element order of a written formula; other elements follow alphabetically.
FORMULA_ORDER = ("C", "H", "N", "O", "S", "P", "F", "Cl", "Br", "I")


def formula_table(df: DataFrame, key: str, atom: str) -> DataFrame:
    """Formula text and atom counts from (key, atom) rows."""
    counts = df.groupBy(key, atom).agg(F.count("*").alias("n"))
    order = F.array_position(F.array(*[F.lit(a) for a in FORMULA_ORDER]), F.col(atom))
    part = F.struct(
        F.when(order == 0, F.lit(99)).otherwise(order.cast("int")).alias("o"), F.col(atom).alias("a"),
        F.concat(F.col(atom), F.when(F.col("n") > 1, F.col("n").cast("string")).otherwise("")).alias("t"),
    )
    carbon = F.sum(F.when(F.col(atom) == "C", F.col("n")).otherwise(0))
    hetero = F.sum(F.when(~F.col(atom).isin("C", "H"), F.col("n")).otherwise(0))
    return counts.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), "").alias("formula"),
        F.sum("n").alias("atom_count"), carbon.alias("carbon_count"), hetero.alias("hetero_count"),
        (hetero == 0).alias("only_ch"),
    )


def property_groups(df: DataFrame, molwt="molwt", logp="logp", tpsa="tpsa", rotatable="rotatable_bonds",
                    rings="ring_count", charge="formal_charge", hetero_rings="heterocycle_count",
                    high_molwt=300.0, high_logp=3.0, high_tpsa=90.0) -> DataFrame:
    """Overlapping group flags from property columns (absent columns give no flag)."""
    rules = {
        "group_high_molwt": (molwt, lambda c: c > high_molwt), "group_high_logp": (logp, lambda c: c > high_logp),
        "group_high_tpsa": (tpsa, lambda c: c > high_tpsa), "group_flexible": (rotatable, lambda c: c >= 5),
        "group_multiple_rings": (rings, lambda c: c >= 2), "group_cyclic": (rings, lambda c: c > 0),
        "group_acyclic": (rings, lambda c: c == 0), "group_charged": (charge, lambda c: c != 0),
        "group_heterocyclic": (hetero_rings, lambda c: c > 0),
    }
    return df.withColumns({g: rule(F.col(c)) for g, (c, rule) in rules.items() if c in df.columns})
