"""Text formats as DataFrame expressions: whole files in, long point tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvida.functions.columns import case_map, col
from corvida.functions.labels import safe_part

NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
JCAMP_NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"  # in packed lines a sign starts the next number


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): trimmed, non-empty lines of each text."""
    d = df.select(key, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line_no", "line"))
    return d.withColumn("line", F.trim("line")).where("line <> ''")


def sniff_format(text) -> Column:
    """Format by content of the whole text (extensions are not trusted)."""
    head = col(text)
    up = F.upper(head)
    has = lambda w: F.contains(up, F.lit(w))
    return (F.when(F.ltrim(head).rlike(r"^[\{\[]"), "MASSBANK_JSON").when(has("##TITLE") | has("##XYDATA") | has("##PEAK TABLE"), "JCAMP_DX")
            .when(head.rlike(r"[,;\t]"), "NUMERIC_TABLE").otherwise("UNKNOWN"))


def header_map(text) -> Column:
    """``##KEY=value`` lines as a map with upper-case keys (last one wins)."""
    rows = F.filter(F.transform(F.split(col(text), r"\r\n|\r|\n"), lambda l: F.trim(l)), lambda l: l.rlike(r"^##[^=]+="))
    entries = F.transform(rows, lambda l: F.struct(F.upper(F.trim(F.regexp_extract(l, r"^##([^=]+)=", 1))).alias("k"), F.trim(F.regexp_extract(l, r"^##[^=]+=(.*)$", 1)).alias("v")))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["k"]), F.create_map(e["k"], e["v"])))


# Header phase words.
HEADER_PHASE = {"gas": "gas", "vapor": "gas", "vapour": "gas", "liquid": "liquid", "solid": "solid", "solution": "solution", "film": "film", "nujol": "nujol", "kbr": "kbr"}


def header_phase(text) -> Column:
    """Phase from the first non-empty STATE or PHASE header."""
    v = F.lower(F.trim(F.regexp_extract(col(text), r"(?im)^\s*##(?:STATE|PHASE)=[ \t]*(\S[^\r\n]*)", 1)))
    return F.when(v == "", "unknown").otherwise(F.coalesce(case_map(v, HEADER_PHASE), F.lower(safe_part(v))))


def _numbers(line, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), lambda n: n.cast("double"))


def jcamp_points(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, x, y) of the lines after the first XYDATA / PEAK TABLE header; ``x y1 y2 ...`` steps x by one."""
    d = df.select(key, F.regexp_extract(text, r"(?is)##(?:XYDATA|PEAK TABLE)=[^\r\n]*[\r\n]+(.*)$", 1).alias("_body"))
    ln = lines_of(d, key, "_body").where(~F.col("line").startswith("##")).withColumn("n", _numbers(F.col("line"), JCAMP_NUMBER)).where(F.size("n") >= 2)
    pts = ln.select(key, "line_no", "n", F.explode(F.sequence(F.lit(1), F.size("n") - 1)).alias("i"))
    pts = pts.select(key, (F.get("n", F.lit(0)) + F.col("i") - 1).alias("x"), F.get("n", F.col("i")).alias("y"), F.struct("line_no", "i").alias("_o"))
    return pts.groupBy(key, "x").agg(F.min_by("y", "_o").alias("y"))


def two_column_points(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, x, y): first two numbers of every line, ``#`` comments cut, first x wins."""
    ln = lines_of(df.withColumn("_t", F.regexp_replace(text, r"#[^\r\n]*", "")), key, "_t").withColumn("n", _numbers(F.col("line"), NUMBER)).where(F.size("n") >= 2)
    return ln.groupBy(key, F.get("n", F.lit(0)).alias("x")).agg(F.min_by(F.get("n", F.lit(1)), "line_no").alias("y"))


def peak_pairs(text) -> Column:
    """array<struct<mz,intensity>> of ``mz:intensity`` pairs, or of the first two numbers per line."""
    t = col(text)
    pair = F.transform(F.regexp_extract_all(t, F.lit(rf"{NUMBER}\s*[:;,]\s*{NUMBER}"), F.lit(0)), lambda p: _numbers(p, NUMBER))
    rows = F.filter(F.transform(F.split(F.regexp_replace(t, ";", "\n"), r"\r\n|\r|\n"), lambda l: _numbers(l, NUMBER)), lambda n: F.size(n) >= 2)
    pick = F.when(F.size(pair) > 0, pair).otherwise(rows)
    return F.transform(pick, lambda n: F.struct(F.get(n, F.lit(0)).alias("mz"), F.get(n, F.lit(1)).alias("intensity")))


def peak_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, mz, intensity): last pair of an mz wins."""
    d = df.select(key, F.posexplode(peak_pairs(text)).alias("i", "p"))
    return d.groupBy(key, F.col("p.mz").alias("mz")).agg(F.max_by("p.intensity", "i").alias("intensity"))


def msp_peaks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, mz, intensity) after ``Num Peaks`` (all lines when absent); the larger intensity wins."""
    body = F.coalesce(F.nullif(F.regexp_extract(text, r"(?is)(?:^|[\r\n])\s*num\s*peaks[^\r\n]*[\r\n]+(.*)$", 1), F.lit("")), F.col(text))
    ln = lines_of(df.select(key, body.alias("_b")), key, "_b").withColumn("n", _numbers(F.col("line"), NUMBER)).where(F.size("n") >= 2)
    return ln.groupBy(key, F.get("n", F.lit(0)).alias("mz")).agg(F.max(F.get("n", F.lit(1))).alias("intensity"))


META = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))
COMPOUND = T.StructType([T.StructField(n, T.StringType()) for n in ("inchiKey", "inchi")] + [
    T.StructField("names", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))), T.StructField("metaData", META)])
RECORD = T.StructType([T.StructField("id", T.StringType()), T.StructField("compound", T.ArrayType(COMPOUND)), T.StructField("spectrum", T.StringType()),
                       T.StructField("splash", T.StructType([T.StructField("splash", T.StringType())])),
                       T.StructField("library", T.StructType([T.StructField("library", T.StringType()), T.StructField("link", T.StringType())]))])


def record_columns(json) -> dict[str, Column]:
    """Identity, metadata and peak text of one stored spectrum record."""
    rec = F.from_json(col(json), RECORD)
    c = F.get(rec["compound"], F.lit(0))
    meta = lambda name: F.get(F.filter(c["metaData"], lambda m: F.lower(F.trim(m["name"])) == name), F.lit(0))["value"]
    return {"inchikey": F.coalesce(c["inchiKey"], meta("inchikey")), "inchi": F.coalesce(c["inchi"], meta("inchi")), "name": F.get(c["names"], F.lit(0))["name"], "cas": meta("cas"),
            "smiles": meta("smiles"), "formula": meta("molecular formula"), "splash": rec["splash"]["splash"], "source_url": rec["library"]["link"],
            "source_database": F.coalesce(F.nullif(rec["library"]["library"], F.lit("")), F.lit("MassBank/MoNA")), "peaks": rec["spectrum"]}


# Keys under which a search response may wrap its records.
WRAPPERS = ("content", "results", "spectra", "data", "items")


def response_records(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, record): JSON records of a bare list, a wrapped list or a single record."""
    as_list = lambda c: F.from_json(c, T.ArrayType(T.StringType()))
    wrapped = F.coalesce(*[as_list(F.get_json_object(json, f"$.{w}")) for w in WRAPPERS])
    single = F.when(F.coalesce(*[F.get_json_object(json, f"$.{k}") for k in ("spectrum", "compound", "id")]).isNotNull(), F.array(F.col(json)))
    recs = F.when(F.ltrim(json).startswith("["), as_list(F.col(json))).otherwise(F.coalesce(wrapped, single))
    return df.select(key, F.explode(recs).alias("record"))


def key_from_name(path) -> dict[str, Column]:
    """Full identity key in a file name, else its short first block."""
    base = F.upper(F.element_at(F.split(col(path), "/"), -1))
    full, short = F.regexp_extract(base, r"[A-Z]{14}-[A-Z]{10}-[A-Z]", 0), F.regexp_extract(base, r"[A-Z]{14}", 0)
    return {"inchikey": F.when(full != "", full).otherwise(short), "key_kind": F.when(full != "", "full").when(short != "", "short").otherwise("")}


def data_links(df: DataFrame, key: str, html: str, base_url: str, ending: str = r"\.(jdx|dx|jcamp)$") -> DataFrame:
    """(key, url): distinct absolute links to data files (by their ending) in stored pages."""
    href = F.explode(F.regexp_extract_all(html, F.lit(r"""(?i)href=['"]([^'"]+)['"]"""), F.lit(1)))
    d = df.select(key, href.alias("h")).select(key, F.trim(F.regexp_replace("h", "&amp;", "&")).alias("h")).where("h <> ''")
    origin = base_url.split("/", 3)[0] + "//" + base_url.split("/", 3)[2]
    d = d.withColumn("url", F.when(F.col("h").startswith("http"), F.col("h")).when(F.col("h").startswith("/"), F.concat(F.lit(origin), "h")).otherwise(F.concat(F.lit(base_url), "h")))
    low = F.lower("url")
    param = lambda n: F.regexp_extract("url", rf"(?i)[?&]{n}=([^&#]*)", 1)
    spec = F.contains(F.upper("url"), F.lit("IR-SPEC")) & (param("ID") != "")
    rewritten = F.concat(F.lit(base_url + "cbook.cgi?JCAMP="), param("ID"), F.lit("&Index="), F.when(param("Index") == "", "0").otherwise(param("Index")), F.lit("&Type=IR"))
    keep = low.rlike(ending) | (param("JCAMP") != "") | (F.contains(low, F.lit("download")) & low.rlike("ir|jcamp|spectrum"))
    return d.select(key, F.when(keep, F.col("url")).when(spec, rewritten).alias("url")).where("url IS NOT NULL").distinct()


def relative_path(path) -> Column:
    """Forward slashes, no leading ``./`` and nothing before the bank folder."""
    p = F.regexp_replace(F.trim(col(path)), r"\\", "/")
    return F.regexp_replace(F.regexp_replace(p, r"^(\./|/)+", ""), r"^.*?spectra_bank/", "")


def manifest_lookup(df: DataFrame, manifest: DataFrame, path: str) -> DataFrame:
    """Attach the manifest row by relative path, else by base name (first by path)."""
    rel = df.withColumns({"_rel": relative_path(path), "_base": F.element_at(F.split(relative_path(path), "/"), -1)})
    m = manifest.withColumns({"_mp": relative_path("path")})
    by_base = m.groupBy(F.element_at(F.split("_mp", "/"), -1).alias("_base")).agg(F.min("_mp").alias("_bp"))
    exact = m.select(F.col("_mp").alias("_rel"), F.col("_mp").alias("_ep")).distinct()
    return rel.join(exact, "_rel", "left").join(by_base, "_base", "left").withColumn("manifest_path", F.coalesce("_ep", "_bp")).drop("_rel", "_base", "_ep", "_bp")


def index_files(files: DataFrame, known: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One status row per raw file: format, identity and whether it is new, known, unreadable or unidentified."""
    rec = record_columns(text)
    name = key_from_name(path)
    d = files.withColumns({"format": sniff_format(text), "_jk": rec["inchikey"], "_fk": F.when(name["key_kind"] == "full", name["inchikey"])})
    d = d.withColumn("inchikey", F.coalesce(F.when(F.col("format") == "MASSBANK_JSON", F.col("_jk")), F.col("_fk"))).drop("_jk", "_fk")
    k = known.select("inchikey").distinct().withColumn("_known", F.lit(True))
    d = d.join(k, "inchikey", "left")
    status = (F.when(F.col("format") == "UNKNOWN", "unknown_format").when(F.col("inchikey").isNull(), "no_identity").when(F.col("_known"), "already_indexed").otherwise("added"))
    return d.select(path, "format", "inchikey", status.alias("status"))
