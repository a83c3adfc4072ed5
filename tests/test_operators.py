"""Small fixtures with known answers and brute-force cross-checks, skewed inputs included."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvida.functions import labels, ranks
from corvida.operators import bank, errors, gram, knn, selection, series, similarity, spectra, validation


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, values repeat heavily."""
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 else f"k{i % 5}", float(rng.integers(0, 40)) / 4, float(rng.normal())) for i in range(1200)]
    pdf = pd.DataFrame(rows, columns=["k", "x", "y"])
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("bounded", [False, True])
def test_exact_quantiles(skewed, bounded):
    df, pdf = skewed
    got = ranks.exact_quantiles(df, ["k"], "y", {"a": 0.1, "m": 0.5, "z": 0.95}, accuracy=200, bounded=bounded).toPandas().set_index("k")
    for name, p in (("a", 0.1), ("m", 0.5), ("z", 0.95)):
        want = pdf.groupby("k")["y"].quantile(p)
        assert np.allclose(got[name].sort_index(), want.sort_index())


@pytest.mark.parametrize("bounded", [False, True])
def test_ranks_and_spearman(skewed, bounded):
    df, pdf = skewed
    got = ranks.spearman(df, ["k"], "x", "y", bounded=bounded).toPandas().set_index("k")["spearman"]
    for k, g in pdf.groupby("k"):
        assert got[k] == pytest.approx(g["x"].rank().corr(g["y"].rank()))


@pytest.mark.parametrize("bounded", [False, True])
def test_concordance(skewed, bounded):
    df, pdf = skewed
    got = ranks.concordance(df, ["k"], "x", "y", bounded).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        dx, dy = np.subtract.outer(g.x.values, g.x.values), np.subtract.outer(g.y.values, g.y.values)
        upper = np.triu_indices(len(g), 1)
        assert got.loc[k, "comparable"] == (dx[upper] != 0).sum()
        assert got.loc[k, "preserved"] == (dx[upper] * dy[upper] > 0).sum()


def test_neighbours_agree(skewed):
    df, _ = skewed
    d = df.groupBy("k", "x").agg(F.sum("y").alias("y"))
    a = ranks.with_neighbours(ranks.with_position(d, ["k"], "x"), ["k"], "pos", ["y"], [-2, 1])
    b = ranks.with_neighbours(ranks.with_position(d, ["k"], "x", bounded=True), ["k"], "pos", ["y"], [-2, 1], True)
    cols = ["k", "x", "pos", "y_m2", "y_p1"]
    pa, pb = (t.select(*cols).toPandas().sort_values(["k", "x"]).reset_index(drop=True) for t in (a, b))
    pd.testing.assert_frame_equal(pa, pb, check_dtype=False)


def test_series_errors_golden(spark):
    rows = [("CCCCC", 36, 35, "n-alkanes", "none", 5, 0), ("CC(C)CC", 28, 30, "2-methylalkanes", "methyl@2", 5, 1), ("CCCCCC", 69, 68, "n-alkanes", "none", 6, 0),
            ("CC(C)CCC", 60, 63, "2-methylalkanes", "methyl@2", 6, 1), ("CCCCCCC", 98, 97, "n-alkanes", "none", 7, 0), ("CC(C)CCCC", 90, 94, "2-methylalkanes", "methyl@2", 7, 1)]
    pdf = pd.DataFrame(rows, columns=["structure", "experimental", "predicted", "series_id", "substitution_scheme", "carbon_count", "substituent_count"]).astype({"experimental": float, "predicted": float})
    pdf["original_index"] = pdf["row_position"] = range(6)
    pdf["family"], pdf["scaffold"], pdf["reference_scheme"], pdf["parent_size"], pdf["size"] = "alkane", "", "none", 0, pdf["carbon_count"]
    pdf["error"] = pdf["predicted"] - pdf["experimental"]
    pdf["absolute_error"] = pdf["error"].abs()
    df = spark.createDataFrame(pdf)
    s = errors.series_summary(df, min_series_size=3).toPandas().set_index("series_id")
    assert s.loc["n-alkanes", "mae"] == 1 and s.loc["2-methylalkanes", "mae"] == 3 and (s["n"] == 3).all() and (s["reliability"] == "adequate").all()
    p = errors.substitution_pairs(df, errors.family_rules()).toPandas().sort_values("comparison_size")
    assert p["comparison_size"].tolist() == [5, 6, 7] and p["delta_error"].tolist() == [3, 4, 5]
    e = errors.effect_summary(errors.substitution_pairs(df, errors.family_rules())).toPandas()
    assert e["reliability"].tolist() == ["adequate"] and e["n"].tolist() == [3]
    ci = errors.bootstrap_mae(df, ["series_id"], "row_position", replicates=50).toPandas()
    assert np.isfinite(ci[["mae_ci_low", "mae_ci_high"]].to_numpy()).all()


def test_labels(spark):
    sub = "array<struct<position:int,name:string>>"
    cases = [([], "none", "n-alkanes"), ([(2, "methyl")], "methyl@2", "2-methylalkanes"), ([(2, "methyl"), (2, "methyl")], "methyl@2;methyl@2", "2,2-dimethylalkanes"),
             ([(3, "methyl"), (2, "methyl")], "methyl@2;methyl@3", "2,3-dimethylalkanes")]
    for subs, scheme, name in cases:
        r = frame(spark, [(subs,)], f"s {sub}").select(labels.scheme_label("s"), labels.series_label("s")).first()
        assert (r[0], r[1]) == (scheme, name)
    a, b = (frame(spark, [([(p, "methyl")],)], f"s {sub}").select(labels.scheme_label(labels.oriented("s", F.lit(5)))).first()[0] for p in (2, 4))
    assert a == b == "methyl@2"


@pytest.mark.parametrize("block", [1, 4, 16, 1000])
def test_concordance_in_blocks(spark, block):
    rng = np.random.default_rng(9)
    rows = [(k, float(x), float(y)) for k, n, m in (("a", 150, 400), ("b", 90, 6), ("c", 1, 2), ("d", 60, 1)) for x, y in rng.integers(0, m, (n, 2))]
    rows += [("a", 7.0, float(i)) for i in range(60)] + [("b", float(i), 3.0) for i in range(40)] + [("a", None, 1.0), ("b", float("nan"), 2.0), (None, 1.0, 2.0)]
    got = {r["k"]: (r["comparable"], r["preserved"]) for r in ranks.concordance(frame(spark, rows, "k string, x double, y double"), ["k"], "x", "y", True, block).collect()}
    for k in "abcd":
        pts = [(np.inf if x != x else x, y) for q, x, y in rows if q == k and x is not None]
        pairs = [(p, q) for p, q in itertools.combinations(pts, 2) if p[0] != q[0]]
        assert got[k] == (len(pairs), sum((p[0] < q[0]) == (p[1] < q[1]) and p[1] != q[1] for p, q in pairs))


def test_concordance_sends_each_point_twice(spark):
    pts = spark.range(4000).select(F.lit(0).alias("_g"), F.lit(4000).alias("_n"), F.col("id").alias("_u"), ((F.col("id") * 7) % 4000).alias("_v"))
    pts = pts.withColumns({"_bu": F.floor(F.col("_u") / 256) * 2, "_bv": F.floor(F.col("_v") / 256) * 2})
    sizes = ranks.concordance_blocks(pts, 256).groupBy("_g", "_b").count().agg(F.sum("count"), F.max("count")).first()
    assert tuple(sizes) == (8000, 256)


def test_token_set_makes_its_tokens_once(spark):
    d = frame(spark, [(1, "a b"), (2, " "), (3, None), (4, "b a b")], "id bigint, s string").select("id", F.filter(F.split("s", " "), lambda w: w != "").alias("t"))
    sets = similarity.token_set(d, "t")
    assert str(sets._jdf.queryExecution().optimizedPlan()).count("split(") == 1
    got = {r["id"]: r["set"] for r in sets.collect()}
    assert set(got) == {1, 4} and got[1] == got[4] == sorted(got[1]) and len(got[1]) == 2


def test_similar_pairs_with_hot_token_and_copies(spark):
    rng = np.random.default_rng(5)
    sets = [sorted(set(rng.integers(0, 30, 8).tolist()) | {1000}) for _ in range(60)] + [[1, 2, 3, 1000]] * 25
    df = frame(spark, list(enumerate(sets)), "id bigint, t array<int>")
    nodes, members = similarity.collapse_copies(similarity.token_set(df, "t"))
    assert nodes.agg(F.sum("copies")).first()[0] == 85 and members.count() == 85
    distinct = {}
    for i, s in enumerate(sets):
        distinct.setdefault(tuple(s), i)
    want = set()
    for (a, i), (b, j) in itertools.combinations(distinct.items(), 2):
        inter = len(set(a) & set(b))
        if inter / (len(a) + len(b) - inter) >= 0.4:
            want.add((min(i, j), max(i, j)))
    for hot in (3, 10_000):
        got = {(r["a"], r["b"]) for r in similarity.similar_pairs(nodes, 0.4, hot_token=hot).collect()}
        assert got == want
    pairs = similarity.similar_pairs(nodes, 0.4)
    # Sequential leader pass over fixed, copy-weighted neighbour counts.
    copies = {r["node"]: r["copies"] for r in nodes.collect()}
    adj = {n: set() for n in copies}
    for a, b in want:
        adj[a].add(b)
        adj[b].add(a)
    order = sorted(copies, key=lambda n: (-(sum(copies[m] for m in adj[n]) + copies[n] - 1), n))
    leader = {}
    for n in order:
        if n not in leader:
            leader[n] = n
            for m in adj[n]:
                leader.setdefault(m, n)
    got = {r["node"]: r["leader"] for r in similarity.leader_clusters(nodes, pairs).collect()}
    assert got == leader
    best = {r["id"]: r["similarity"] for r in similarity.best_match(similarity.token_set(df, "t"), similarity.token_set(df.where("id < 20"), "t"), hot_token=4).collect()}
    for i, s in enumerate(sets):
        assert best[i] == pytest.approx(max(len(set(s) & set(t)) / len(set(s) | set(t)) for t in sets[:20]))


def _sets_with_a_family(n=240):
    """Variants of a few texts, a token that all have, copies, and sets of all sizes."""
    rng = np.random.default_rng(11)
    base = [set(rng.integers(0, 4000, 60).tolist()) for _ in range(4)]
    sets = []
    for i in range(n):
        s = set(base[i % 4]) if i % 3 else set(rng.integers(0, 400, int(rng.integers(1, 40))).tolist())
        for t in list(s)[: int(rng.integers(0, 20))]:
            s.discard(t)
        sets.append(sorted(s | {9999} | set(rng.integers(5000, 9000, int(rng.integers(0, 6))).tolist())))
    return sets + sets[:9]


def test_similar_sets_meet_in_buckets(spark):
    sets = _sets_with_a_family()
    df = frame(spark, list(enumerate(sets)), "id bigint, t array<int>")
    nodes, _ = similarity.collapse_copies(similarity.token_set(df, "t"))
    ids = sorted(r["node"] for r in nodes.collect())
    for threshold in (0.5, 0.85):
        want = {}
        for a, b in itertools.combinations(ids, 2):
            n = len(set(sets[a]) & set(sets[b]))
            if n / (len(sets[a]) + len(sets[b]) - n) >= threshold:
                want[a, b] = n
        for hot, bucket in ((20_000, 1 << 18), (7, 200)):
            got = [(r["a"], r["b"], r["inter"]) for r in similarity.similar_pairs(nodes, threshold, hot, bucket).collect()]
            assert len(got) == len(want) > 50 and {(a, b): n for a, b, n in got} == want


def test_pairs_and_matches_are_not_shuffled(spark):
    """Sets travel to buckets and blocks; what is sent does not follow the number of pairs that share a token."""
    sets = [[i, 70_000 + i // 2, *range(100_000, 100_030)] for i in range(600)]
    df = frame(spark, list(enumerate(sets)), "id bigint, t array<int>")
    both = similarity.token_set(df, "t")
    nodes, _ = similarity.collapse_copies(both)
    for made in (similarity.similar_pairs(nodes, 0.5), similarity.best_match(both.where("id % 2 = 0"), both.where("id % 2 = 1"))):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "array_intersect" not in plan and " token#" not in plan and "[token#" not in plan
    assert similarity.similar_pairs(nodes, 0.5).count() == 600 * 599 // 2


def test_best_match_in_blocks(spark):
    sets = _sets_with_a_family()
    sets[5], sets[7] = [123_456], [123_457, 9999]
    df = frame(spark, list(enumerate(sets)), "id bigint, t array<int>")
    q, t = (similarity.token_set(df.where(w), "t") for w in ("id % 2 = 1", "id % 2 = 0"))
    for block in (1 << 20, 300):
        got = {r["id"]: (r["best"], r["similarity"]) for r in similarity.best_match(q, t, block_tokens=block).collect()}
        for i in range(1, len(sets), 2):
            s = set(sets[i])
            sims = [(len(s & set(sets[j])) / len(s | set(sets[j])), -j) for j in range(0, len(sets), 2)]
            top = max(sims)
            assert got[i] == ((-top[1], pytest.approx(top[0])) if top[0] else (None, None))


def test_components_hub_and_chain(spark):
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(300, 340)] + [(500, 501)]
    nodes = [(i,) for i in sorted({x for e in edges for x in e} | {999})]
    got = {r["node"]: r["component"] for r in similarity.connected_components(frame(spark, nodes, "node bigint"), frame(spark, edges, "a bigint, b bigint")).collect()}
    assert got[150] == 0 and got[340] == 300 and got[501] == 500 and got[999] == 999 and len(set(got.values())) == 4


def test_knn_exact_with_copies(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    x[:100] = x[0]
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    got = knn.nearest_neighbours(df, df, "id", "id", "v", 3, exclude_self=True, pivots=8, block_rows=16).toPandas().sort_values(["qid", "rank"])
    for i, g in got.groupby("qid"):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        want = sorted(range(300), key=lambda j: (d[j], j))[:3]
        assert g["tid"].tolist() == want


@pytest.mark.parametrize("shape", ["spread", "one distance", "copies", "few"])
def test_knn_rounds_match_brute_force(spark, shape):
    """Other queries than training rows, string ids, rings of one distance that are cut by hash, copies, fewer rows than k."""
    rng = np.random.default_rng(2)
    t = rng.normal(size=(400, 3)) + 100
    if shape == "one distance":
        t = rng.normal(size=(400, 3))
        t[1:] /= np.linalg.norm(t[1:], axis=1)[:, None]
        t[0] = 0
    if shape == "copies":
        t[:260] = t[0]
    if shape == "few":
        t = t[:2]
    q = np.vstack([t[:5], rng.normal(size=(120, 3)) + (100 if shape != "one distance" else 0)])
    q[5:90] = q[5]
    train = frame(spark, [(f"t{i:03d}", v.tolist()) for i, v in enumerate(t)] + [(None, [0.0, 0.0, 0.0]), ("bad", [float("nan"), 0.0, 0.0]), ("none", None)], "id string, v array<double>")
    queries = frame(spark, [(f"q{i:03d}", v.tolist()) for i, v in enumerate(q)], "id string, v array<double>")
    for pivots in (1, 6):
        got = knn.nearest_neighbours(queries, train, "id", "id", "v", 4, pivots=pivots, block_rows=16).toPandas().sort_values(["qid", "rank"])
        assert got["qid"].nunique() == len(q)
        for i, g in got.groupby("qid"):
            d = np.sqrt(((t - q[int(i[1:])]) ** 2).sum(1))
            want = sorted(range(len(t)), key=lambda j: (d[j], j))[:4]
            assert g["tid"].tolist() == [f"t{j:03d}" for j in want]


def test_knn_sends_little(spark):
    """Far clusters: a query meets its own block and few others, so routed rows stay near the rows themselves."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 2)) * 0.1 + rng.integers(0, 40, size=(3000, 2)) * 10
    table = knn.training_blocks(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "tid bigint, v array<double>"), 4, 64, 32)[1]
    tree = np.sqrt(((x[:300, None] - x[None]) ** 2).sum(2))
    bound = np.sort(tree, axis=1)[:, 3]
    reached = (table.reach(x[:300], bound) * table.parts[None, :]).sum(1)
    assert reached.mean() < 0.1 * table.parts.sum()
    assert knn.nearest_neighbours(frame(spark, [], "i bigint, v array<double>"), frame(spark, [(1, [0.0])], "i bigint, v array<double>"), "i", "i", "v").count() == 0
    assert knn.nearest_neighbours(frame(spark, [(1, [0.0])], "i bigint, v array<double>"), frame(spark, [], "i bigint, v array<double>"), "i", "i", "v").count() == 0



def test_knn_tasks_hold_little(monkeypatch):
    """A query that reaches every block goes out in bounded frames; distances are taken for a bounded part of a block at a time."""
    import tracemalloc

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16))
    table = knn.Blocks(x[:20], np.arange(20), np.zeros(20), np.zeros(20), np.full(20, 1e9), np.full(20, 2))
    pdf = pd.DataFrame({"qid": np.arange(400), "v": list(x), "block": np.arange(400) % 40, "bound": 1e9})
    monkeypatch.setattr(knn, "AT_ONCE", 1600)
    frames = list(knn._routed_frames(pdf, table))
    assert max(map(len, frames)) <= 100
    assert {(q, b) for f in frames for q, b in zip(f["qid"], f["block"])} == {(q, b) for q in range(400) for b in range(40) if b != q % 40}
    monkeypatch.undo()
    a, b = rng.normal(size=(2048, 8)), rng.normal(size=(4096, 8))
    tracemalloc.start()
    found = list(knn._pick(np.arange(2048), np.arange(4096), a, b, 3, np.full(2048, np.inf), True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6
    for i in range(0, 2048, 97):
        d = np.sqrt(((b - a[i]) ** 2).sum(1))
        d[i] = np.inf
        assert found[i][0].tolist() == np.argsort(d)[:3].tolist()


def test_reference_hierarchy_matches_sequential(spark):
    rng = np.random.default_rng(4)
    pts = [("d", f"s{i}", float(c), 10.0 * c * (1 + 0.02 * i) + (rng.normal() * (0 if i % 3 else 12)), 1.0) for i in range(9) for c in range(6)]
    points = frame(spark, pts, "series_domain string, series_id string, coordinate double, value double, complexity double")
    own = series.own_series(points)[0].withColumn("internally_consistent", F.lit(True))
    h, _, _ = series.reference_hierarchy(points, own)
    comp, _ = series.compare_series(points.drop("complexity"), points.drop("complexity"), 3)
    ok = {(r["candidate"], r["reference"]): r["passed"] for r in comp.collect()}
    refs = []
    for s in sorted(f"s{i}" for i in range(9)):
        if not refs:
            refs.append(s)
            continue
        tests = [ok[(s, x)] for x in refs if (s, x) in ok]
        if tests and sum(tests) >= max(1, -(-len(tests) // 2)):
            refs.append(s)
    got = {r["series_id"] for r in h.where("reference_level IS NOT NULL").collect()}
    assert got == set(refs)


def test_gram_models_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 4)) * [1, 10, 0.1, 5] + [100, 0, 3, -7]
    y = x @ [1.0, -0.5, 8.0, 0.2] + rng.normal(size=120)
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([np.arange(120), x, y]), columns=["id", "a", "b", "c", "d", "y"])).withColumn("id", F.col("id").cast("bigint"))
    f = ["a", "b", "c", "d"]
    g = gram.grams(df, f, "y")[()]
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + 2 * np.eye(4), z.T @ (y - y.mean()))
    m = g.ridge(2.0)
    pred = np.array([r[0] for r in df.orderBy("id").select(m.column()).collect()])
    assert np.allclose(pred, y.mean() + z @ beta)
    assert g.sse(m) == pytest.approx(((y - pred) ** 2).sum())
    assert np.allclose(g.pls1(4).coef, g.ridge(0.0).coef)
    old = gram.EXPRESSION_LIMIT
    gram.EXPRESSION_LIMIT = 2
    try:
        block = gram.grams(df, f, "y")[()]
    finally:
        gram.EXPRESSION_LIMIT = old
    assert np.allclose(block.ss, g.ss) and np.allclose(block.s, g.s)
    loo = validation.leave_one_out(df, f, "y", 2.0, ["id"]).toPandas().set_index("id")["y_pred"]
    for i in (0, 57):
        t = np.arange(120) != i
        mu, sd = x[t].mean(0), x[t].std(0)
        zt = (x[t] - mu) / sd
        b = np.linalg.solve(zt.T @ zt + 2 * np.eye(4), zt.T @ (y[t] - y[t].mean()))
        assert loo[i] == pytest.approx(y[t].mean() + (x[i] - mu) / sd @ b)


def test_validation_designs(spark):
    x0 = np.linspace(0, 1, 12)
    pdf = pd.DataFrame({"row_index": range(100, 112), "x0": x0, "x1": x0 + 1, "x2": x0 * (x0 + 1), "y": 1.5 + 2 * x0 - 0.4 * (x0 + 1) + 0.1 * np.arange(12), "grp": list("aaaabbbbcccc")})
    df = spark.createDataFrame(pdf)
    f = ["x0", "x1", "x2"]
    rep = validation.repeated_kfold(df, f, "y", "row_index", k=3, repeats=2)
    assert validation.mean_prediction(rep, "row_index", "y").count() == 12 and rep.count() == 24
    _, s = validation.group_holdout(df, f, "y", F.when(F.col("grp") == "a", 0).otherwise(2 * 10**9), 0.34)
    assert validation.leaking_groups(s, "grp").isEmpty() and s.where("split = 'test'").count() == 4
    curve = validation.learning_curve(df, f, "y", "row_index", k=3, sizes=2)
    assert len(curve) == 2 and np.isfinite(curve["cv_rmse_mean"]).all()
    assert len(set(r["y"] for r in validation.permuted_target(df, "row_index", "y", 1).collect())) == 12


def test_farthest_first_spreads(spark):
    pdf = pd.DataFrame({"id": range(60), "a": np.r_[np.zeros(50), np.linspace(5, 50, 10)], "b": 0.0})
    got = {r["id"] for r in selection.farthest_first(spark.createDataFrame(pdf), ["a", "b"], "id", 4).collect()}
    assert len(got) == 4 and 59 in got


def test_farthest_first_matches_the_sequential_walk(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 2)).round(1)  # ties and copies
    pdf = pd.DataFrame({"id": np.arange(90), "a": x[:, 0], "b": x[:, 1]})
    df = spark.createDataFrame(pdf).unionByName(frame(spark, [(None, 50.0, 50.0), (500, None, 9.0), (501, float("nan"), 9.0)], "id long, a double, b double"))
    kept = np.vstack([x, [[50.0, 50.0]]])  # the row without an id counts for the scale alone
    z = (x - kept.mean(0)) / kept.std(0)
    want, d = [0], np.full(90, np.inf)
    while len(want) < 20:
        d = np.minimum(d, ((z - z[want[-1]]) ** 2).sum(1))
        want.append(int(np.flatnonzero(d >= d.max() * (1 - 1e-12))[0]))
    assert {r["id"] for r in selection.farthest_first(df, ["a", "b"], "id", 20, keep=7).collect()} == set(want)
    same = frame(spark, [(i, 1.0, 2.0) for i in range(9)], "id long, a double, b double")
    assert [r["id"] for r in selection.farthest_first(same, ["a", "b"], "id", 3).collect()] == [0]
    assert selection.farthest_first(same.limit(0), ["a", "b"], "id", 3).count() == 0


def test_spectrum_edges(spark):
    pts = frame(spark, [("s", 0.0, 0.0), ("s", 4.0, 8.0), ("far", 90.0, 1.0), ("far", 95.0, 2.0), ("one", 1.0, 1.0)], "id string, x double, y double")
    d = spectra.describe(pts, "id", 0.0, 5.0, 1.0, "none", bit_width=2, band_width=3).toPandas().set_index("id")
    assert list(d.loc["s", "grid"]) == [0, 2, 4, 6, 8, 4] and list(d.loc["s", "bits"]) == [1, 1, 1]
    assert [(b["mean"], b["max"], b["area"]) for b in d.loc["s", "bands"]] == [(2, 4, 4), (6, 8, 13)]
    assert d.loc["far", "grid"] is None and d.loc["one", "grid"] is None


def test_neighbours_in_lots_of_queries(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(400, 12)), 1)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for at_once in (1 << 26, 30_000):
        out = knn.nearest_neighbours(df, df, "id", "id", "v", 3, exclude_self=True, block_rows=32, routed_at_once=at_once)
        got = {(r["qid"], r["rank"]): (r["tid"], r["distance"]) for r in out.collect()}
        assert len(got) == out.count() == 1200 and all(np.allclose([got[i, r][1] for r in (1, 2, 3)], np.sort(d[i])[:3]) for i in range(400))


def test_permuted_products_are_summed_where_the_targets_land(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(rng.normal()), None if i % 17 == 0 else float(rng.normal()), float("nan") if i % 23 == 0 else float(rng.normal()), None if i % 29 == 0 else 100.0 + float(rng.normal())) for i in range(300)]
    df = frame(spark, rows + rows[:5], "row_id bigint, a double, b double, c double, y double")
    feats, shift = ["a", "b", "c"], np.array([0.1, 0.0, -0.2, 100.0])
    perm = validation.permuted_target(df, "row_id", "y", 5).withColumn("fold", validation.fold_column("row_id", 3))
    want = gram.grams(perm, feats, "y", ["permutation", "fold"], shift=shift)
    for at_once in (1 << 24, 600):
        got = validation.permuted_grams(df, feats, "y", "row_id", 5, 3, shift, at_once)
        assert set(got) == set(want)
        for key, g in got.items():
            assert g.n == want[key].n and np.allclose(g.s, want[key].s) and np.allclose(g.ss, want[key].ss)


def test_suspicion_reads_memberships_made_once(spark, tmp_path):
    from corvida.catalog import consistency

    rng = np.random.default_rng(4)
    orders = pd.DataFrame({"o_orderkey": range(900), "o_custkey": rng.integers(0, 60, 900), "o_orderstatus": rng.choice(list("OFP"), 900), "o_totalprice": rng.lognormal(10, 1, 900).round(2),
                           "o_orderdate": pd.to_datetime("1994-01-01") + pd.to_timedelta(rng.integers(0, 700, 900), "D"), "o_orderpriority": rng.choice(["1-URGENT", "5-LOW"], 900)})
    customer = pd.DataFrame({"c_custkey": range(60), "c_nationkey": rng.integers(0, 4, 60), "c_mktsegment": rng.choice(["BUILDING", "FURNITURE"], 60)})
    for name, t in (("orders", orders), ("customer", customer)):
        spark.createDataFrame(t).write.parquet(f"{tmp_path}/{name}.parquet")
    m, got = consistency.suspicion_layers(spark, str(tmp_path))
    assert not any(x in m._jdf.queryExecution().optimizedPlan().toString() for x in ("Join", "Aggregate"))
    w = consistency.memberships(spark, str(tmp_path))
    p = series.series_points(w)
    want = series.hierarchical_suspicion(w, series.own_series(p)[1], series.compare_series(p, p, 3, F.col("candidate") > F.col("reference"))[1], series.transformation_rules(series.transformation_pairs(w, 3))[1])
    key = lambda d: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in d.collect())
    assert key(got) == key(want) and got.count() > 20


def test_grid_scalars_are_computed_once(spark):
    rng = np.random.default_rng(3)
    cells = {"a": {g: float(rng.normal()) for g in range(0, 40, 2)}, "b": {3: 1.5, 7: -2.0}}
    df = frame(spark, [(k, g, v) for k, c in cells.items() for g, v in c.items()], "id string, g int, v double")
    want = {k: np.array([c.get(g, np.median(list(c.values()))) for g in range(40)]) for k, c in cells.items()}
    want = {k: v.max() - v for k, v in want.items()}
    how = {"min-max": lambda v: (v - v.min()) / np.ptp(v), "sum": lambda v: v / np.abs(v).sum(), "vector": lambda v: v / np.sqrt((v * v).sum()), "none": lambda v: v}
    for method, f in how.items():
        g = spectra.normalized_grid(df, "id", 40, method, invert=True)
        twice = g.where(F.array_max("grid") >= 0).select("id", "grid", F.array_max("grid").alias("top"))
        for r in twice.collect():
            assert np.allclose(r["grid"], f(want[r["id"]])) and r["top"] == max(r["grid"])
        # A scalar named inside a lambda stands for the whole grid again, once per cell, in each of the nested steps.
        assert twice._jdf.queryExecution().optimizedPlan().toString().count("element_at(") == 1


def test_bank_split_and_upsert(spark):
    b = frame(spark, [("k1", 1, 1.0), ("k1", 2, 2.0), (None, 1, 9.0), ("k2", 1, 3.0)], "bank_key string, created_at int, d double")
    keys = frame(spark, [(1, "k1"), (2, None), (3, "k9")], "id int, bank_key string")
    hit, miss = bank.split_cached(keys, b)
    assert [(r["id"], r["d"]) for r in hit.collect()] == [(1, 2.0)] and {r["id"] for r in miss.collect()} == {2, 3}
    assert bank.upsert(b, b.limit(0), ["bank_key"], ["created_at"]).count() == 3


def test_empty_and_repartitioned(spark, skewed):
    df, _ = skewed
    e = df.withColumn("error", F.col("y"))
    a = errors.error_metrics(e, ["k"]).toPandas().sort_values("k").reset_index(drop=True)
    b = errors.error_metrics(e.repartition(7), ["k"]).toPandas().sort_values("k").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)
    assert errors.error_metrics(e.limit(0), ["k"]).count() == 0


def test_quantiles_of_few_keys_leave_the_rows_where_they_are(spark):
    """Column medians: the brackets travel to the rows, so the cells of one column do not meet in one task."""
    df = spark.range(6000).selectExpr("if(id < 5500, 'a', 'b') AS name", "cast(id * 7919 % 6007 AS double) AS value")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ranks.exact_quantiles(df, ["name"], "value", {"m": 0.5}, accuracy=200, few=True)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        want = df.toPandas().groupby("name")["value"].median().to_dict()
        assert {r["name"]: r["m"] for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
