"""Exact medians of differences against brute force: ties, one and many blocks, one hot group, large groups."""

import random
import statistics

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvida.operators import differences, series


def test_selection_in_one_block():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 5), (200, 150), (300, 1)):
        a, b = np.unique(rng.integers(-40, 40, n) * 0.1), np.unique(rng.normal(0, 9, m).round(1))
        wa, wb = rng.integers(1, 5, len(a)), rng.integers(1, 5, len(b))
        every = np.sort(np.repeat(np.subtract.outer(a, b).ravel(), np.multiply.outer(wa, wb).ravel()))
        for k in {1, 2, len(every) // 2 + 1, len(every)} & set(range(1, len(every) + 1)):
            assert differences.select_difference(a, wa, b, wb, k) == every[k - 1]


def test_places_follow_rounded_differences():
    a, b = np.array([0.3, 0.1 + 0.2, 1e16]), np.array([0.1, 0.2, 1.0])
    for p in (0.1, 0.2, 0.3 - 0.2, 1e16, -0.7):
        for strict in (False, True):
            want = [next((j for j, y in enumerate(b) if (x - y < p if strict else x - y <= p)), 3) for x in a]
            assert differences.first_within(a, b, p, strict).tolist() == want


@pytest.mark.parametrize("block,last", [(4096, 1 << 18), (3, 10), (1, 2), (16, 40)])
def test_edge_medians(spark, block, last, monkeypatch):
    rng = random.Random(7)
    rows = []
    for f in ("f1", "f2"):
        for p, n in (("p1", 60), ("p2", 1), ("p3", 45), ("p4", 7)):
            rows += [(f, p, rng.choice([rng.randint(0, 12) * 0.1, rng.gauss(0, 1), 5.0])) for _ in range(n)]
    rows += [("f1", "p1", None), ("f1", "p3", float("nan")), ("f2", "p5", None), (None, "p1", 1.0), ("f2", None, 1.0)]
    rows += [("f1", "p1", 5.0)] * 300  # a hot value
    df = spark.createDataFrame(rows, "f string, p string, v double").repartition(4)
    e = series.pattern_edges(series.pattern_points(df.where("NOT isnan(v)"), "f", "p", "v"))
    monkeypatch.setattr(differences.median_difference, "__defaults__", (4096, last))
    got = {(r["formula"], r["edge_label"]): r["median_delta"] for r in series.edge_medians(e, df, "f", "p", "v", block).collect()}
    want = {}
    for f in ("f1", "f2"):
        vals = {p: [v for g, q, v in rows if (g, q) == (f, p) and v is not None and v == v] for p in ("p1", "p2", "p3", "p4")}
        for p in vals:
            for q in vals:
                if p < q:
                    want[(f, f"{p} minus {q}")] = statistics.median(x - y for x in vals[p] for y in vals[q])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_hundred_thousand_by_hundred_thousand(spark):
    n = 100_000
    df = spark.range(2 * n).selectExpr("'f' f", "if(id < 100000, 'a', 'b') p", "cast(pmod(hash(id), 1000003) as double) / 7 + if(id % 5 = 0, 0, 0.001 * id) v")
    pdf = df.toPandas()
    a, b = (np.sort(pdf[pdf.p == p].v.to_numpy()) for p in "ab")

    def at_most(t):
        return int((n - differences.first_within(a, b, t)).sum())

    want = []
    for k in (n * n // 2, n * n // 2 + 1):
        lo, hi = a[0] - b[-1], a[-1] - b[0]
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if at_most(mid) >= k else (mid, hi)
        rows = np.flatnonzero(differences.first_within(a, b, hi) < n)
        want.append(max(a[rows] - b[differences.first_within(a, b, hi)[rows]]))  # the largest difference within hi
    e = series.pattern_edges(series.pattern_points(df, "f", "p", "v"))
    got = series.edge_medians(e, df, "f", "p", "v").collect()
    assert len(got) == 1 and got[0]["median_delta"] == sum(want) / 2


def test_rows_with_blocks_travel_in_small_batches(spark):
    before = spark.conf.get(differences.BATCH_LIMIT, None)
    rows = spark.range(0, 1200, 1, 1).select(F.array_repeat(F.col("id").cast("double"), differences.BLOCK).alias("v"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    with differences.small_batches(spark):
        got = [r["n"] for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 1200 and max(got) * differences.BLOCK * 8 < 2 * differences.BATCH_BYTES
    assert spark.conf.get(differences.BATCH_LIMIT, None) == before
