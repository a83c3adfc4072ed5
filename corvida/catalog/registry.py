"""Query registry and the table bindings shared by the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.functions.columns import portable_hash_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column (money-sized ones to fewer digits through ``special``)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "double":
            c = F.round(c, special.get(f.name, digits))
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


ROW_ID = "(l_orderkey * 1000003 + l_partkey * 8191 + l_suppkey * 131 + l_linenumber)"

# One row per line item: features, target and a deterministic baseline prediction.
LINES_SQL = f"""lines AS (
  SELECT {ROW_ID} AS row_id, l_orderkey, l_returnflag, l_linestatus, p_brand, p_type,
         CAST(l_quantity AS DOUBLE) AS x1, CAST(l_discount AS DOUBLE) AS x2, CAST(l_tax AS DOUBLE) AS x3,
         CAST(p_size AS DOUBLE) AS x4, CAST(p_retailprice AS DOUBLE) AS x5,
         CAST(l_extendedprice AS DOUBLE) AS y, 2000.0 * l_quantity + 500.0 * p_size AS y_pred
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

# One row per order: unique id.
ORDERS_SQL = """om AS (
  SELECT o_orderkey AS row_id, CAST(c_acctbal AS DOUBLE) AS x1,
         CAST(month(o_orderdate) AS DOUBLE) AS x2, CAST(c_nationkey AS DOUBLE) AS x3,
         CAST(o_totalprice AS DOUBLE) AS y, c_mktsegment AS segment, c_nationkey AS nation
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    li, pa = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return li.join(pa, li.l_partkey == pa.p_partkey).selectExpr(
        f"{ROW_ID} AS row_id", "l_orderkey", "l_returnflag", "l_linestatus", "p_brand", "p_type",
        "CAST(l_quantity AS DOUBLE) AS x1", "CAST(l_discount AS DOUBLE) AS x2",
        "CAST(l_tax AS DOUBLE) AS x3", "CAST(p_size AS DOUBLE) AS x4",
        "CAST(p_retailprice AS DOUBLE) AS x5", "CAST(l_extendedprice AS DOUBLE) AS y",
        "CAST(2000 AS DOUBLE) * l_quantity + CAST(500 AS DOUBLE) * p_size AS y_pred",
    )


def order_matrix(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).selectExpr(
        "o_orderkey AS row_id", "CAST(c_acctbal AS DOUBLE) AS x1",
        "CAST(month(o_orderdate) AS DOUBLE) AS x2", "CAST(c_nationkey AS DOUBLE) AS x3",
        "CAST(o_totalprice AS DOUBLE) AS y", "c_mktsegment AS segment", "c_nationkey AS nation",
    )


def fold_sql(expr: str, k: int, salt: int | str = 0) -> str:
    return f"({portable_hash_sql(expr, salt)} % {k})"


def r(expr: str, digits: int = 6, alias: str | None = None) -> str:
    """SQL rounding that mirrors :func:`rounded`."""
    e = f"(CASE WHEN round({expr}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round(CAST({expr} AS DOUBLE), {digits}) END)"
    return f"{e} AS {alias}" if alias else e
