"""Registered queries: vectors, graphs and clusterings (V)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import stash
from ..operators import cluster, descent, graph, hierarchy, linkage, mixture, scoring, vectors
from .registry import Tables, register

#: The given vectors have no pair above 0.6, so graphs here start at 0.2.
LEAST, K = 0.2, 10
UNIT = "un AS (SELECT vec_id AS id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS e FROM embeddings)"
NEAR = f"{UNIT}, nn AS (SELECT a.id AS src, b.id AS dst, sqrt(greatest(0, 2 - 2 * list_inner_product(a.e, b.e))) AS distance FROM un a JOIN un b ON a.id <> b.id), kn AS (SELECT src, dst, distance, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM nn QUALIFY rank <= {K})"
EDGES = f"{NEAR}, ed AS (SELECT src, dst, 1 - distance * distance / 2 AS weight FROM kn WHERE src < dst AND 1 - distance * distance / 2 >= {LEAST})"

REACH = "re(node, root) AS (SELECT id, id FROM un UNION SELECT sy.dst, re.root FROM re JOIN sy ON sy.src = re.node), co AS (SELECT node, min(root) AS c FROM re GROUP BY 1)"


def _density(size: int, samples: int, epsilon: float, k: int = 20, where: str = "true", apart: str = "true") -> str:
    """Common tables up to sz(node, label, c, n): the component of each vector and its size."""
    near = NEAR.replace("FROM embeddings)", f"FROM embeddings WHERE {where})").replace("a.id <> b.id", f"a.id <> b.id AND {apart}").replace(f"rank <= {K}", f"rank <= {max(k, samples)}")
    return f"""WITH RECURSIVE {near}, cr AS (SELECT src AS node, distance AS core FROM kn WHERE rank = {samples}),
 de AS (SELECT kn.src, kn.dst FROM kn JOIN cr a ON a.node = kn.src JOIN cr b ON b.node = kn.dst WHERE greatest(a.core, b.core, distance) <= {epsilon}),
 sy AS (SELECT src, dst FROM de UNION SELECT dst, src FROM de), {REACH}, sz AS (SELECT node, label, c, count(*) OVER (PARTITION BY c) AS n FROM co JOIN un ON un.id = node)"""


def _near(t: Tables, k: int = K) -> DataFrame:
    return vectors.knn(t.vectors, k)


def _edges(t: Tables) -> DataFrame:
    return stash(graph.knn_edges(_near(t), LEAST), "edges")


def _nodes(t: Tables) -> DataFrame:
    return t.vectors.select(F.col("phrase_id").alias("node"))


@register("v1_normalise", f", {UNIT} SELECT id AS phrase_id, round(e[1], 4) AS first, round(e[64], 4) AS last FROM un")
def v1(t: Tables) -> DataFrame:
    n = vectors.normalised(t.vectors)
    return n.select("phrase_id", F.round(F.col("embedding")[0].cast("double"), 4).alias("first"), F.round(F.col("embedding")[63].cast("double"), 4).alias("last"))


def _cache(t: Tables) -> DataFrame:
    p = t.kw.where("phrase_id % 3 <> 0").select(F.md5("phrase").alias("text_md5")).distinct()
    return p.select("text_md5", F.lit("m").alias("model"), F.lit("1").alias("version"), F.lit(2).alias("dim"), F.array(F.lit(1.0).cast("float"), F.length("text_md5").cast("float")).alias("embedding"))


@register("v2_missing_texts", "SELECT DISTINCT md5(phrase) AS text_md5, phrase FROM kw WHERE phrase NOT IN (SELECT phrase FROM kw WHERE phrase_id % 3 <> 0)", "kw")
def v2(t: Tables) -> DataFrame:
    return vectors.missing_texts(t.kw, _cache(t), "m", "1", 2)


@register("v3_aligned", "SELECT phrase_id FROM kw WHERE phrase IN (SELECT phrase FROM kw WHERE phrase_id % 3 <> 0)", "kw")
def v3(t: Tables) -> DataFrame:
    return vectors.aligned(t.kw, _cache(t)).select("phrase_id")


@register("v4_knn_graph", f", {EDGES} SELECT src, dst, round(weight, 5) AS weight FROM ed")
def v4(t: Tables) -> DataFrame:
    return graph.knn_edges(_near(t), LEAST).select("src", "dst", F.round("weight", 5).alias("weight"))


@register("v4_descent")
def v4_descent(t: Tables) -> DataFrame:
    return descent.descend(t.vectors, K)


@register("v5_graph_statistics", f"""WITH RECURSIVE {EDGES}, sy AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), {REACH},
 x AS (SELECT (SELECT count(*) FROM un) AS v, (SELECT count(*) FROM ed) AS e, (SELECT count(DISTINCT c) FROM co) AS n_components)
 SELECT v AS n_nodes, e AS n_edges, v * {K} AS potential_edges, round(1 - e / (v * {K})::DOUBLE, 6) AS filter_rate, round(2 * e / v::DOUBLE, 6) AS mean_degree, round(2 * e / (v * (v - 1))::DOUBLE, 6) AS density, n_components FROM x""")
def v5(t: Tables) -> DataFrame:
    return graph.statistics(_nodes(t), _edges(t), K)


@register("v6_communities")
def v6(t: Tables) -> DataFrame:
    return graph.communities(_nodes(t), _edges(t))


@register("v6_louvain")
def v6_louvain(t: Tables) -> DataFrame:
    return graph.louvain(_nodes(t), _edges(t))


@register("v7_modularity", f", {EDGES}, x AS (SELECT ed.*, a.label AS ca, b.label AS cb FROM ed JOIN un a ON a.id = src JOIN un b ON b.id = dst), m AS (SELECT sum(weight) AS m FROM ed), d AS (SELECT c, sum(weight) AS deg FROM (SELECT ca AS c, weight FROM x UNION ALL SELECT cb, weight FROM x) GROUP BY 1), i AS (SELECT ca AS c, sum(weight) FILTER (ca = cb) AS w FROM x GROUP BY 1) SELECT round(sum(coalesce(w, 0) / m - pow(deg / (2 * m), 2)), 5) AS modularity FROM d LEFT JOIN i USING (c) CROSS JOIN m")
def v7(t: Tables) -> DataFrame:
    labels = t.vectors.select(F.col("phrase_id").alias("node"), F.col("cluster_id").alias("community"))
    return graph.modularity(_edges(t), labels).select(F.round("modularity", 5).alias("modularity"))


@register("v8_prune", "SELECT phrase_id AS node, CAST(CASE WHEN n < 10 THEN -1 ELSE dense_rank() OVER (PARTITION BY n < 10 ORDER BY cluster_id_B) - 1 END AS INT) AS community FROM (SELECT phrase_id, cluster_id_B, CASE WHEN cluster_id_B = -1 THEN 0 ELSE count(*) OVER (PARTITION BY cluster_id_B) END AS n FROM doc)", "doc")
def v8(t: Tables) -> DataFrame:
    return graph.prune(t.doc.select(F.col("phrase_id").alias("node"), F.col("cluster_id_B").alias("community")))


@register("v9_density_clusters", f"{_density(5, 3, 1.15)} SELECT node AS phrase_id, CAST(CASE WHEN n < 5 THEN -1 ELSE dense_rank() OVER (PARTITION BY n < 5 ORDER BY c) - 1 END AS INT) AS cluster_id FROM sz")
def v9(t: Tables) -> DataFrame:
    return cluster.density_clusters(t.vectors, 5, 3, 1.15)


@register("v10_sub_clusters", f"""{_density(5, 2, 1.15, where="label <> -1", apart="a.label = b.label")}
 SELECT node AS phrase_id, CAST(CASE WHEN n < 5 THEN -1 ELSE label * 10000 + dense_rank() OVER (PARTITION BY n < 5, label ORDER BY c) - 1 END AS INT) AS cluster_id FROM sz UNION ALL SELECT vec_id, -1 FROM embeddings WHERE label = -1""")
def v10(t: Tables) -> DataFrame:
    return cluster.sub_clusters(t.vectors.withColumnRenamed("cluster_id", "parent"), 5, 2, 1.15)


@register("v11_resplit", f"""{_density(3, 1, 1.2, where="label = 3")}
 SELECT node AS phrase_id, CAST(CASE WHEN n < 3 THEN -1 ELSE 1000 + dense_rank() OVER (PARTITION BY n < 3 ORDER BY c) END AS INT) AS cluster_id FROM sz UNION ALL SELECT vec_id, label FROM embeddings WHERE label <> 3""")
def v11(t: Tables) -> DataFrame:
    return cluster.resplit(t.vectors, t.vectors.select("phrase_id", "cluster_id"), 3, min_size=3, min_samples=1, epsilon=1.2)


@register("v9_spanning_tree")
def v9_tree(t: Tables) -> DataFrame:
    return hierarchy.spanning_tree(t.vectors, 3)


@register("v9_condensed_clusters")
def v9_condensed(t: Tables) -> DataFrame:
    return hierarchy.hierarchy_clusters(t.vectors, 5, 3)


@register("v10_condensed_sub_clusters")
def v10_condensed(t: Tables) -> DataFrame:
    return hierarchy.sub_hierarchy(t.vectors.withColumnRenamed("cluster_id", "parent"), 5, 2)


@register("v11_leaf_resplit")
def v11_leaf(t: Tables) -> DataFrame:
    return hierarchy.resplit_hierarchy(t.vectors, t.vectors.select("phrase_id", "cluster_id"), 3, min_size=3, min_samples=1)


@register("v12_kmeans")
def v12(t: Tables) -> DataFrame:
    return cluster.kmeans(t.vectors, 10).select("phrase_id", "cluster_id")


@register("v13_search_k")
def v13(t: Tables) -> DataFrame:
    return cluster.search_k(t.vectors, [60, 70, 80, 90, 100])


@register("v14_bisecting")
def v14(t: Tables) -> DataFrame:
    return cluster.bisecting(t.vectors, 10).select("phrase_id", "cluster_id")


@register("v14_ward")
def v14_ward(t: Tables) -> DataFrame:
    return linkage.agglomerative(t.vectors, [10, 20, 40], "ward").select("phrase_id", "cluster_id")


@register("v15_split_inconsistent")
def v15(t: Tables) -> DataFrame:
    labels = t.vectors.select("phrase_id", "cluster_id")
    verdicts = labels.select("cluster_id").distinct().select("cluster_id", (F.col("cluster_id") % 3 != 0).alias("consistent"), F.lit(0.9).alias("score"), F.lit(None).cast("int").alias("n_parts"))
    return cluster.split_inconsistent(t.vectors.drop("cluster_id"), labels, verdicts)


@register("v16_validity", """WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label <> -1), l AS (SELECT id, label, generate_subscripts(e, 1) AS d, unnest(e) AS x FROM v),
 c AS (SELECT label, d, avg(x) AS c, count(*) AS n FROM l GROUP BY 1, 2), g AS (SELECT d, avg(x) AS g FROM l GROUP BY 1), ds AS (SELECT id, label, sum((x - c) * (x - c)) AS d2 FROM l JOIN c USING (label, d) GROUP BY 1, 2),
 w AS (SELECT label, avg(sqrt(d2)) AS s, sum(d2) AS inside, count(*) AS n FROM ds GROUP BY 1), m AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS m FROM c a JOIN c b ON a.d = b.d AND a.label <> b.label GROUP BY 1, 2),
 db AS (SELECT avg(r) AS davies_bouldin FROM (SELECT i, max((x.s + y.s) / m) AS r FROM m JOIN w x ON x.label = i JOIN w y ON y.label = j GROUP BY 1)), be AS (SELECT sum(n * (c - g) * (c - g)) AS b FROM c JOIN g USING (d)),
 ch AS (SELECT b * (sum(n) - count(*)) / (sum(inside) * (count(*) - 1)) AS calinski_harabasz FROM w, be GROUP BY b), s AS (SELECT * FROM v ORDER BY md5('42|' || id), id LIMIT 500),
 pr AS (SELECT a.id, a.label AS own, b.label AS other, avg(list_distance(a.e, b.e)) AS d FROM s a JOIN s b ON a.id <> b.id GROUP BY 1, 2, 3), sl AS (SELECT id, max(d) FILTER (other = own) AS a, min(d) FILTER (other <> own) AS b FROM pr GROUP BY 1)
 SELECT round(davies_bouldin, 6) AS davies_bouldin, round(calinski_harabasz, 6) AS calinski_harabasz, (SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) FROM sl) AS silhouette FROM db, ch""")
def v16(t: Tables) -> DataFrame:
    return cluster.validity(t.vectors).select(*[F.round(c, 6).alias(c) for c in ("davies_bouldin", "calinski_harabasz", "silhouette")])


@register("v16_whole_silhouette", """WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label <> -1),
 pr AS (SELECT a.id, a.label AS own, b.label AS other, avg(list_distance(a.e, b.e)) AS d FROM v a JOIN v b ON a.id <> b.id GROUP BY 1, 2, 3), sl AS (SELECT id, max(d) FILTER (other = own) AS a, min(d) FILTER (other <> own) AS b FROM pr GROUP BY 1)
 SELECT count(*) AS n, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM (SELECT v.id, a, b FROM v LEFT JOIN sl ON sl.id = v.id)""")
def v16_whole(t: Tables) -> DataFrame:
    return cluster.whole_silhouette(t.vectors).select("n", F.round("silhouette", 6).alias("silhouette"))


@register("v17_mixtures")
def v17(t: Tables) -> DataFrame:
    return cluster.mixtures(t.vectors, [2, 4])


@register("v17_diagonal_mixtures")
def v17_diagonal(t: Tables) -> DataFrame:
    return mixture.diagonal_mixtures(t.vectors, [50, 75, 100])


@register("v17_comparison")
def v17_comparison(t: Tables) -> DataFrame:
    return mixture.compare(t.vectors, [50, 100], [50])


def _sweep(size: int, samples: int) -> str:
    return f"""SELECT * FROM ({_density(size, samples, 1.15)}, g AS (SELECT c, count(*) AS n FROM sz GROUP BY 1)
 SELECT {size} AS min_size, {samples} AS min_samples, count(*) FILTER (n >= {size}) AS n_clusters, coalesce(sum(n) FILTER (n < {size}), 0) / sum(n)::DOUBLE AS noise, min(n) FILTER (n >= {size}) AS least, max(n) FILTER (n >= {size}) AS most FROM g)"""


@register("v18_density_sweep", f"{_sweep(5, 2)} UNION ALL {_sweep(10, 3)}")
def v18(t: Tables) -> DataFrame:
    return cluster.density_sweep(t.vectors, [(5, 2), (10, 3)], 1.15)


@register("v18_condensed_sweep")
def v18_condensed(t: Tables) -> DataFrame:
    return hierarchy.hierarchy_sweep(t.vectors, [(5, 2), (10, 2), (10, 3)])


@register("v19_dimension_profile", "SELECT CAST(i AS INT) AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS low, round(max(x), 6) AS high FROM (SELECT generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")
def v19(t: Tables) -> DataFrame:
    return vectors.dimension_profile(t.vectors)


@register("v20_distance_profile", """WITH s AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings ORDER BY md5('42|' || vec_id), vec_id LIMIT 500), d AS (SELECT list_distance(a.e, b.e) AS d FROM s a JOIN s b ON a.id < b.id)
 SELECT round(avg(d), 6) AS mean, round(var_pop(d), 6) AS var, round(min(d), 6) AS low, round(max(d), 6) AS high, round(quantile_cont(d, 0.01), 6) AS p1, round(quantile_cont(d, 0.25), 6) AS p25, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.75), 6) AS p75, round(quantile_cont(d, 0.99), 6) AS p99,
 CASE WHEN avg(d) > 1.2 THEN 'scattered' WHEN avg(d) > 1.0 THEN 'fairly scattered' ELSE 'compact' END AS diagnosis FROM d""")
def v20(t: Tables) -> DataFrame:
    p = vectors.distance_profile(t.vectors)
    return p.select(*[F.round(c, 6).alias(c) for c in ("mean", "var", "low", "high")], *[F.round(F.col("percentiles")[i], 6).alias(f"p{n}") for i, n in enumerate((1, 25, 50, 75, 99))], "diagnosis")


@register("v21_neighbour_profile", f", {NEAR} SELECT src, round(avg(distance) FILTER (rank <= 5), 6) AS mean_5, round(max(distance) FILTER (rank <= 5), 6) AS max_5, round(avg(distance), 6) AS mean_10, round(max(distance), 6) AS max_10 FROM kn GROUP BY 1")
def v21(t: Tables) -> DataFrame:
    return vectors.neighbour_profile(_near(t), (5, 10))


@register("v22_local_density", f", {NEAR} SELECT src, round(1 / (avg(distance) + 1e-10), 4) AS density FROM kn GROUP BY 1")
def v22(t: Tables) -> DataFrame:
    return vectors.local_density(_near(t), K).select("src", F.round("density", 4).alias("density"))


@register("v22_density_bands", f", {NEAR}, de AS (SELECT src, 1 / (avg(distance) + 1e-10) AS x FROM kn GROUP BY 1), p AS (SELECT quantile_cont(x, 0.1) AS lo, quantile_cont(x, 0.9) AS hi FROM de) SELECT count(*) AS n, count(*) FILTER (x > hi) AS dense, count(*) FILTER (x < lo) AS sparse, round(min(lo), 6) AS p10, round(min(hi), 6) AS p90 FROM de, p")
def v22_bands(t: Tables) -> DataFrame:
    return vectors.density_bands(vectors.local_density(_near(t), K))


@register("v23_explained_variance")
def v23(t: Tables) -> DataFrame:
    return vectors.explained_variance(t.vectors, 20)


@register("v24_cosine_pairs", f", {NEAR} SELECT src, dst, round(1 - distance * distance / 2, 5) AS cosine FROM kn")
def v24(t: Tables) -> DataFrame:
    return vectors.cosine_pairs(_near(t)).select("src", "dst", F.round("cosine", 5).alias("cosine"))


@register("v25_assign", f""", {NEAR.split(", nn AS")[0]}, nn AS (SELECT a.id AS src, b.id AS dst, b.label, sqrt(greatest(0, 2 - 2 * list_inner_product(a.e, b.e))) AS distance FROM un a JOIN un b ON a.id % 5 = 0 AND b.id % 5 <> 0),
 kn AS (SELECT * FROM nn QUALIFY row_number() OVER (PARTITION BY src ORDER BY distance, dst) <= 5), vo AS (SELECT src, label, count(*) AS n, min(distance) AS d FROM kn WHERE distance * distance / 2 <= 0.8 AND label <> -1 GROUP BY 1, 2),
 be AS (SELECT src, label FROM vo QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, d, label) = 1) SELECT id AS phrase_id, coalesce(be.label, -1) AS cluster_id FROM un LEFT JOIN be ON src = id WHERE id % 5 = 0""")
def v25(t: Tables) -> DataFrame:
    return vectors.assign(t.vectors.where("phrase_id % 5 = 0"), t.vectors.where("phrase_id % 5 <> 0"), 5, 0.8)


@register("v27_greedy_groups")
def v27(t: Tables) -> DataFrame:
    p = t.kw.select("phrase_id", "phrase")
    distinct = p.groupBy("phrase").agg(F.min("phrase_id").alias("phrase_id"))
    return cluster.greedy_groups(distinct, scoring.similar_pairs(distinct, 0.85))
