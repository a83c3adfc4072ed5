"""Row selection in descriptor space: farthest-first test sets and Mahalanobis outliers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.operators.gram import grams, quadratic_form
from corvida.session import cut_lineage


def mahalanobis(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Distance of every row from the centre under the inverse sample covariance."""
    g = grams(df.withColumn("_zero", F.lit(0.0)), features, "_zero")[()]
    inv = np.linalg.pinv(g.covariance(1), hermitian=True)
    return df.withColumn("mahalanobis", F.sqrt(F.greatest(quadratic_form(features, g.mean[:g.p], inv), F.lit(0.0))))


def farthest_first(df: DataFrame, features: Sequence[str], ident: str, k: int, keep: int = 16) -> DataFrame:
    """The k rows of the greedy k-centre walk in standardised space: the smallest id first, then always the row farthest from
    all picked ones, ties by the smaller id. Ends early when every row equals a picked one. Rows without an id or with a cell
    that is NULL, NaN or infinite do not take part; an empty table gives no rows.

    Every pick is one aggregate over the rows with their distance to the picked set so far, combined within partitions; no group
    of rows is ever held in a task. After ``keep`` picks the distances are written, so a pass reads old distances and adds at most
    ``keep`` new ones. The picks (k rows) pass through the driver.
    """
    found = grams(df.withColumn("_zero", F.lit(0.0)), features, "_zero")
    if not found:
        return df.sparkSession.createDataFrame([], df.select(ident).schema)
    g = found[()]
    z = F.array(*[(F.col(c).cast("double") - float(g.mean[i])) / float(g.scales()[i]) for i, c in enumerate(features)])
    whole = F.forall("z", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = cut_lineage(df.select(F.col(ident).alias("id"), z.alias("z")).where(F.col("id").isNotNull() & whole).withColumn("d", F.lit(float("inf"))))
    schema = f"`{ident}` {rows.schema['id'].dataType.simpleString()}"
    picked = []
    near = rows
    while len(picked) < k:
        best = near.agg(F.min(F.struct((-F.col("d")).alias("below"), "id", "z")).alias("m")).first()["m"]
        if best is None or best["below"] >= 0:
            break
        picked.append((best["id"],))
        centre = F.array(*[F.lit(float(x)) for x in best["z"]])
        gap = F.aggregate(F.zip_with("z", centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        near = near.withColumn("d", F.least("d", gap))
        if len(picked) % keep == 0 and len(picked) < k:
            near = cut_lineage(near)
    return df.sparkSession.createDataFrame(picked, schema)
