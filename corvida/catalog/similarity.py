"""Set-similarity queries: word-triple sets of whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvida.catalog.registry import query, r, rounded, table
from corvida.functions.columns import HASH_PRIME, portable_hash_sql
from corvida.functions.frames import spread
from corvida.operators import similarity as sim
from corvida.session import cut_lineage, release

T, EPS = 0.5, 0.6

# Word triples of the whole text; shorter texts give one token.
DOC_SQL = f"""wd AS (SELECT doc_id, source, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM documents),
st0 AS (SELECT doc_id, source, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [array_to_string(w, ' ')] END)) AS s FROM wd WHERE len(w) > 0),
mb AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY s) AS node, count(*) OVER (PARTITION BY s) AS copies FROM st0),
nd AS (SELECT node, copies, len(s) AS size, s FROM mb JOIN st0 ON doc_id = node WHERE id = node),
tk AS (SELECT node, size, unnest(s) AS t FROM nd),
pr AS (SELECT a, b, i AS inter, i / (sa + sb - i) AS sm FROM (SELECT x.node AS a, y.node AS b, any_value(x.size) AS sa, any_value(y.size) AS sb, count(*) AS i FROM tk x JOIN tk y ON x.t = y.t AND x.node < y.node GROUP BY 1, 2) WHERE i / (sa + sb - i) >= {T} - 1e-12)"""
BOTH = "bw AS (SELECT a AS node, b AS other, sm FROM pr UNION ALL SELECT b, a, sm FROM pr)"
COMP = """rc AS (SELECT node, min(reach) AS component FROM (
 WITH RECURSIVE g(node, reach) AS (SELECT node, node FROM nd UNION SELECT g.node, bw.other FROM g JOIN bw ON bw.node = g.reach {cond}) SELECT * FROM g) GROUP BY 1)"""


def document_sets(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "source", "text")).where(F.lower("text").rlike(r"[\p{L}\p{N}]"))
    d = d.select("doc_id", "source", F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("w"))
    d = d.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    n = F.greatest(F.size("h") - 2, F.lit(0))
    both = lambda x, y: F.xxhash64(x, y)
    tri = F.zip_with(F.zip_with(F.slice("h", F.lit(1), n), F.slice("h", F.lit(2), n), both), F.slice("h", F.lit(3), n), both)
    return d.withColumn("tokens", F.when(F.size("h") >= 3, tri).otherwise(F.array(F.xxhash64(F.array_join("w", " ")))))


def document_graph(spark, sf):
    nodes, members = sim.collapse_copies(cut_lineage(sim.token_set(document_sets(spark, sf), "tokens", "doc_id")))
    counts, members = cut_lineage(nodes.drop("set")), cut_lineage(members)
    return counts, members, cut_lineage(sim.similar_pairs(nodes, T))


@query("join12_exact_duplicates", f"WITH {DOC_SQL.split(', pr AS')[0].split(chr(10) + 'tk AS')[0].rstrip(',')} SELECT node, copies, CAST(copies * (copies - 1) / 2 AS BIGINT) AS pairs FROM nd WHERE copies > 1")
def join12(spark, sf):
    return sim.copy_groups(sim.collapse_copies(cut_lineage(sim.token_set(document_sets(spark, sf), "tokens", "doc_id")))[0])


@query("join13_similarity_join", f"WITH {DOC_SQL} SELECT a, b, inter, {r('sm', 6, 'similarity')} FROM pr")
def join13(spark, sf):
    p = document_graph(spark, sf)[2]
    return rounded(p.select("a", "b", F.col("inter").cast("bigint").alias("inter"), "similarity"))


@query("sim1_pairwise_nearest", f"WITH {DOC_SQL}, {BOTH}, m AS (SELECT node, max(sm) AS ms, min_by(other, (-sm, other)) AS o FROM bw GROUP BY 1) SELECT nd.node, {r('CASE WHEN copies > 1 THEN 1.0 ELSE coalesce(ms, 0) END', 6, 'similarity')}, CASE WHEN copies > 1 THEN nd.node ELSE o END AS nearest FROM nd LEFT JOIN m USING (node)")
def sim1(spark, sf):
    n, _, p = document_graph(spark, sf)
    return rounded(sim.max_similarity(n, p))


@query("sim2_duplicate_detail", f"WITH {DOC_SQL} SELECT node AS a, id AS b, 1.0::DOUBLE AS similarity, 'exact duplicate' AS kind FROM mb WHERE id <> node UNION ALL SELECT a, b, {r('sm', 6)}, CASE WHEN sm >= 0.9 THEN 'near duplicate' ELSE 'strong analogue' END FROM pr WHERE sm >= 0.6")
def sim2(spark, sf):
    _, m, p = document_graph(spark, sf)
    return rounded(sim.duplicate_detail(m, p, 0.9, 0.6))


@query("top1_most_similar_pairs", f"WITH {DOC_SQL} SELECT a, b, {r('sm', 6, 'similarity')} FROM pr ORDER BY sm DESC, a, b LIMIT 50")
def top1(spark, sf):
    return rounded(document_graph(spark, sf)[2].orderBy(F.col("similarity").desc(), "a", "b").limit(50).select("a", "b", "similarity"))


@query("top2_edges_per_node", f"WITH {DOC_SQL}, {BOTH} SELECT DISTINCT least(node, other) AS a, greatest(node, other) AS b, {r('sm', 6, 'similarity')} FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY sm DESC, other DESC) AS k FROM bw) WHERE k <= 2")
def top2(spark, sf):
    return rounded(sim.top_edges(document_graph(spark, sf)[2], 2))


@query("top3_least_similar", f"WITH {DOC_SQL}, {BOTH}, m AS (SELECT node, max(sm) AS ms FROM bw GROUP BY 1) SELECT node, {r('CASE WHEN copies > 1 THEN 1.0 ELSE coalesce(ms, 0) END', 6, 'similarity')} FROM nd LEFT JOIN m USING (node) ORDER BY 2, 1 LIMIT 25")
def top3(spark, sf):
    n, _, p = document_graph(spark, sf)
    return rounded(sim.max_similarity(n, p).orderBy("similarity", "node").limit(25).select("node", "similarity"))


@query("agg28_similarity_summary", f"""WITH {DOC_SQL}, w AS (SELECT x.copies * y.copies AS w, sm FROM pr JOIN nd x ON x.node = a JOIN nd y ON y.node = b)
SELECT (SELECT CAST(sum(copies) AS BIGINT) FROM nd) AS rows, (SELECT count(*) FROM nd) AS distinct_sets, (SELECT CAST(sum(copies * (copies - 1) / 2) AS BIGINT) FROM nd) AS copy_pairs, CAST(coalesce(sum(w), 0) AS BIGINT) AS near_pairs,
 {r('sum(w * sm) / sum(w)', 6, 'mean_similarity')}, {r('max(sm)', 6, 'max_similarity')}, CAST(coalesce(sum(w) FILTER (sm > 0.85), 0) AS BIGINT) AS pairs_gt_85, CAST(coalesce(sum(w) FILTER (sm > 0.95), 0) AS BIGINT) AS pairs_gt_95 FROM w""")
def agg28(spark, sf):
    n, _, p = document_graph(spark, sf)
    return rounded(sim.similarity_summary(n, p))


PAIR_STATS_SQL = f"""ps AS (SELECT doc_id, s, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM st0), nn AS (SELECT count(*) AS n, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS every FROM st0),
d0 AS (SELECT t, CASE WHEN every <= 200000 THEN t ELSE ({portable_hash_sql('t', 11)} * {HASH_PRIME} + {portable_hash_sql('t', 12)}) % every END AS num, every FROM nn, range(200000) q(t) WHERE t < every),
d1 AS (SELECT num, every, CAST(floor((1 + sqrt(1 + 8::DOUBLE * num)) / 2) AS BIGINT) AS r FROM d0),
d2 AS (SELECT num, every, CASE WHEN r * (r - 1) // 2 > num THEN r - 1 WHEN (r + 1) * r // 2 <= num THEN r + 1 ELSE r END AS i FROM d1),
d3 AS (SELECT i, num - i * (i - 1) // 2 AS j, every FROM d2), d4 AS (SELECT every, len(list_intersect(x.s, y.s)) AS c, len(x.s) + len(y.s) AS z FROM d3 JOIN ps x ON x.pos = i JOIN ps y ON y.pos = j),
d5 AS (SELECT every <= 200000 AS whole, c / (z - c) AS s FROM d4),
sx AS (SELECT CASE WHEN any_value(whole) THEN 'full' ELSE 'sampled' END AS mode, count(*) AS pairs_used, avg(s) AS mean_similarity, quantile_cont(s, 0.5) AS median_similarity, min(s) AS min_similarity, max(s) AS max_similarity, CASE WHEN any_value(whole) THEN 0 ELSE stddev_samp(s) / sqrt(count(*)) END AS mean_error,
 CASE WHEN any_value(whole) THEN quantile_cont(s, 0.5) ELSE quantile_cont(s, {0.5 - 0.98 / 200000 ** 0.5}) END AS median_low, CASE WHEN any_value(whole) THEN quantile_cont(s, 0.5) ELSE quantile_cont(s, {0.5 + 0.98 / 200000 ** 0.5}) END AS median_high FROM d5)"""
PAIR_STATS = ["mean_similarity", "median_similarity", "min_similarity", "max_similarity", "mean_error", "median_low", "median_high"]
PAIR_STATS_OUT = ", ".join(r(c, 6, c) for c in PAIR_STATS)


@query("agg28_pair_statistics", f"WITH {DOC_SQL.split('mb AS')[0].rstrip().rstrip(',')}, {PAIR_STATS_SQL} SELECT mode, pairs_used, {PAIR_STATS_OUT} FROM sx")
def agg28_pairs(spark, sf):
    return rounded(sim.pair_statistics(cut_lineage(sim.token_set(document_sets(spark, sf), "tokens", "doc_id"))))


@query("agg28_diversity_status", f"""WITH {DOC_SQL}, {BOTH}, {COMP.format(cond='')}, {PAIR_STATS_SQL}, cz AS (SELECT component, sum(copies) AS n FROM rc JOIN nd USING (node) GROUP BY 1),
g AS (SELECT count(*) AS clusters, count(*) FILTER (n = 1) AS singleton_clusters, CAST(max(n) AS BIGINT) AS largest_cluster FROM cz), v AS (SELECT CAST(sum(copies) AS BIGINT) AS valid_rows, count(*) AS unique_sets, CAST(sum(copies * (copies - 1) / 2) AS BIGINT) AS same FROM nd),
nr AS (SELECT CAST(coalesce(sum(x.copies * y.copies), 0) AS BIGINT) AS near FROM pr JOIN nd x ON x.node = a JOIN nd y ON y.node = b WHERE sm > 0.95), z AS (SELECT *, largest_cluster * 100.0::DOUBLE / valid_rows AS pc, same + near AS vc, mean_similarity AS m FROM v, g, nr, sx),
y AS (SELECT *, m > 0.7 AND clusters <= greatest(3, floor(valid_rows * 0.1)) AS lo, m < 0.4 AND clusters >= greatest(4, floor(valid_rows * 0.1)) AS hi, pc >= 45 AND singleton_clusters >= greatest(3, floor(clusters * 0.25)) AS mixed FROM z)
SELECT valid_rows, unique_sets, (SELECT count(*) FROM documents) - valid_rows AS invalid_rows, clusters, singleton_clusters, largest_cluster, {r('pc', 6, 'largest_cluster_percent')}, vc AS very_close_pairs, mode, pairs_used, {PAIR_STATS_OUT},
 CASE WHEN valid_rows < 3 THEN 'insufficient_data' WHEN mixed THEN 'heterogeneous' WHEN lo THEN 'low_diversity' WHEN hi THEN 'high_diversity' ELSE 'moderate_diversity' END AS status,
 CASE WHEN valid_rows < 3 THEN 'fewer_than_three' ELSE concat_ws('; ', CASE WHEN lo THEN 'high_mean_similarity' WHEN hi THEN 'low_mean_many_clusters' ELSE 'several_regions' END, CASE WHEN mixed THEN 'large_cluster_and_singletons' WHEN vc > 0 THEN 'very_close_pairs' END) END AS reasons FROM y""")
def agg28_status(spark, sf):
    n, _, p = document_graph(spark, sf)
    clusters = sim.connected_components(n, p).select("node", F.col("component").alias("cluster"))
    sets = cut_lineage(sim.token_set(document_sets(spark, sf), "tokens", "doc_id"))
    return rounded(sim.diversity_status(table(spark, sf, "documents").count(), n, clusters, p, sim.pair_statistics(sets)))


@query("agg28_similarity_histogram", f"""WITH {DOC_SQL}, w AS (SELECT x.copies * y.copies AS w, CAST(least(floor(sm * 20 + 1e-9), 19) AS INTEGER) AS bin FROM pr JOIN nd x ON x.node = a JOIN nd y ON y.node = b)
SELECT bin, CAST(sum(w) AS BIGINT) AS count, {r('bin / 20.0', 6, 'similarity_from')} FROM w GROUP BY 1""")
def agg28_hist(spark, sf):
    n, _, p = document_graph(spark, sf)
    return rounded(sim.similarity_histogram(p, n))


@query("sim3_connected_components", f"WITH {DOC_SQL}, {BOTH}, {COMP.format(cond='')} SELECT node, component FROM rc")
def sim3(spark, sf):
    n, _, p = document_graph(spark, sf)
    return sim.connected_components(n, p)


@query("sim4_space_map", f"""WITH {DOC_SQL}, {BOTH}, {COMP.format(cond=f'WHERE bw.sm >= {EPS}')},
e AS (SELECT bw.node, other, sm, x.copies AS c, y.copies AS oc FROM bw JOIN nd x ON x.node = bw.node JOIN nd y ON y.node = other),
u AS (SELECT node, sm FROM e, range(5) q(i) WHERE i < oc UNION ALL SELECT node, 1.0 FROM nd, range(5) q(i) WHERE i < copies - 1),
dn AS (SELECT node, avg(sm) AS d FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY sm DESC) AS k FROM u) WHERE k <= 5 GROUP BY 1),
mx AS (SELECT node, max(sm) AS ms, min_by(other, (-sm, other)) AS o FROM bw GROUP BY 1), cl AS (SELECT node, sum(oc) AS n FROM e WHERE sm >= {EPS} GROUP BY 1),
z AS (SELECT nd.node, CASE WHEN copies > 1 THEN nd.node ELSE o END AS nearest, CASE WHEN copies > 1 THEN 1.0 ELSE coalesce(ms, 0) END AS ns, CAST(coalesce(n, 0) + copies - 1 AS BIGINT) AS cc, d, component FROM nd LEFT JOIN mx USING (node) LEFT JOIN cl USING (node) LEFT JOIN dn USING (node) JOIN rc USING (node))
SELECT id, node, nearest, {r('ns', 6, 'nearest_similarity')}, cc AS close_analog_count, {r('d', 6, 'local_density')}, component,
 CASE WHEN ns >= .85 THEN 'Dense area' WHEN ns >= .7 THEN 'Moderate area' WHEN ns >= .5 THEN 'Sparse area' ELSE 'Singleton / outlier' END AS space_class, cc = 0 AS is_singleton, ns < .5 AS is_outlier FROM mb JOIN z USING (node)""")
def sim4(spark, sf):
    n, m, p = document_graph(spark, sf)
    return rounded(sim.space_map(n, m, p, EPS))


@query("sim5_leader_clusters")
def sim5(spark, sf):
    n, _, p = document_graph(spark, sf)
    return sim.cluster_table(sim.leader_clusters(n, p), n)


DB = f"""dg AS (SELECT nd.node, copies + coalesce(sum(oc), 0) AS d FROM nd LEFT JOIN (SELECT bw.node, y.copies AS oc FROM bw JOIN nd y ON y.node = other) USING (node) GROUP BY nd.node, copies), co AS (SELECT node FROM dg WHERE d >= 3),
cr AS (SELECT node, min(reach) AS component FROM (WITH RECURSIVE g(node, reach) AS (SELECT node, node FROM co UNION SELECT g.node, bw.other FROM g JOIN bw ON bw.node = g.reach WHERE bw.other IN (FROM co)) SELECT * FROM g) GROUP BY 1),
bd AS (SELECT bw.node, min(component) AS cluster FROM bw JOIN cr ON cr.node = other GROUP BY 1)"""


@query("sim6_dbscan", f"WITH {DOC_SQL}, {BOTH}, {DB} SELECT nd.node, coalesce(component, cluster, -(nd.node + 1)) AS cluster, coalesce(component, cluster) IS NULL AS is_noise FROM nd LEFT JOIN cr USING (node) LEFT JOIN bd USING (node)")
def sim6(spark, sf):
    n, _, p = document_graph(spark, sf)
    return sim.dbscan(n, p, 3)


CN = f"""lb AS (SELECT node, component AS group_id, copies, coalesce(dg, 0) AS degree, sum(copies) OVER (PARTITION BY component) AS gs FROM nd JOIN rc USING (node) LEFT JOIN (SELECT node, count(*) AS dg FROM bw GROUP BY 1) USING (node)),
ln AS (SELECT *, (degree = 0 AND copies = 1) OR gs = 1 AS sg FROM lb)"""


def communities(spark, sf):
    n, _, p = document_graph(spark, sf)
    lab = sim.connected_components(n, p).select("node", F.col("component").alias("group_id"), F.lit(False).alias("is_noise"))
    return cut_lineage(sim.community_nodes(n, lab, p)), p


@query("sim7_community_nodes", f"WITH {DOC_SQL}, {BOTH}, {COMP.format(cond='')}, {CN} SELECT node, group_id, degree, CAST(gs AS BIGINT) AS group_size, gs <= 3 AS small_group, sg AS is_singleton FROM ln")
def sim7(spark, sf):
    return communities(spark, sf)[0].select("node", "group_id", "degree", "group_size", "small_group", "is_singleton")


@query("sim7_community_groups", f"""WITH {DOC_SQL}, {BOTH}, {COMP.format(cond='')}, {CN}, si AS (SELECT x.group_id, avg(sm) AS s FROM pr JOIN ln x ON x.node = a JOIN ln y ON y.node = b AND x.group_id = y.group_id GROUP BY 1)
SELECT group_id, CAST(any_value(gs) AS BIGINT) AS group_size, min_by(node, (-degree, node)) AS representative, {r('any_value(s)', 6, 'internal_similarity')}, count(*) FILTER (sg) AS singletons, any_value(gs) <= 3 AS is_small FROM ln LEFT JOIN si USING (group_id) GROUP BY 1""")
def sim7_groups(spark, sf):
    return rounded(sim.community_groups(*communities(spark, sf)))


@query("sim7_community_summary", f"""WITH {DOC_SQL}, {BOTH}, {COMP.format(cond='')}, {CN} SELECT CAST(sum(copies) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN sg THEN copies ELSE 0 END) AS BIGINT) AS n_singletons, CAST(0 AS BIGINT) AS noise_points, {r('avg(degree)', 6, 'mean_degree')},
 count(DISTINCT group_id) AS n_groups, CAST(max(gs) AS BIGINT) AS largest_group_size, count(DISTINCT CASE WHEN gs > 1 AND gs <= 3 THEN group_id END) AS n_small_groups FROM ln""")
def sim7_summary(spark, sf):
    return rounded(sim.community_summary(communities(spark, sf)[0]))


BM = f"""{DOC_SQL.split(chr(10) + 'mb AS')[0].rstrip(',')}, tq AS (SELECT doc_id, len(s) AS z, unnest(s) AS t FROM st0 WHERE doc_id % 7 = 0), tt AS (SELECT doc_id, len(s) AS z, unnest(s) AS t FROM st0 WHERE doc_id % 7 <> 0),
bm AS (SELECT q.doc_id AS id, max(i / (q.z + zt - i)) AS s FROM (SELECT q.doc_id, any_value(q.z) AS z, tt.doc_id AS d, any_value(tt.z) AS zt, count(*) AS i FROM tq q JOIN tt USING (t) GROUP BY 1, 3) q GROUP BY 1)"""


def query_train(spark, sf):
    """Sources split the corpus into query and training texts."""
    d = document_sets(spark, sf)
    last = "int(regexp_extract(source, '([0-9]+)', 1)) % 2 = 0"
    return cut_lineage(sim.token_set(d.where(last), "tokens", "doc_id")), cut_lineage(sim.token_set(d.where(f"NOT ({last})"), "tokens", "doc_id"))


def best_of_train(spark, sf):
    best = sim.best_match(*query_train(spark, sf))
    release(spark, 0)  # the sets are not needed for the blocks to meet
    return best


BM = BM.replace("doc_id % 7 = 0", "CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 2 = 0").replace("doc_id % 7 <> 0", "CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 2 <> 0")


@query("join15_max_similarity", f"WITH {BM} SELECT DISTINCT tq.doc_id AS id, {r('s', 6, 'similarity')} FROM tq LEFT JOIN bm ON id = tq.doc_id")
def join15(spark, sf):
    return rounded(best_of_train(spark, sf).select("id", "similarity"))


@query("ad5_similarity_domain", f"WITH {BM} SELECT DISTINCT tq.doc_id AS id, {r('s', 6, 'similarity')}, 0.5::DOUBLE AS similarity_threshold, coalesce(s >= 0.5, false) AS similarity_inside FROM tq LEFT JOIN bm ON id = tq.doc_id")
def ad5(spark, sf):
    from corvida.operators.domain import similarity_domain
    return rounded(similarity_domain(best_of_train(spark, sf), "similarity").select("id", "similarity", "similarity_threshold", "similarity_inside"))
