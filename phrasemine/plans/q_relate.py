"""Registered queries: joins, windows and set operations (J, W, O)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import relate
from ..operators.tokens import segment, top_k
from .q_tokens import sg
from .registry import Tables, register


def _phrase_links(t: Tables) -> DataFrame:
    """Demands linked to phrases: orders to the parts of their lines."""
    return t.links.select("demand_id", F.col("product_id").alias("phrase_id"), F.col("fit_score").alias("relevance_score"))


@register("j1_demand_phrases", "SELECT l.demand_id, k.phrase_id, k.phrase, l.fit_score AS relevance_score FROM links l JOIN kw k ON l.product_id = k.phrase_id", "links", "kw")
def j1(t: Tables) -> DataFrame:
    return relate.provenance_links(_phrase_links(t), t.kw, "phrase_id").select("demand_id", "phrase_id", "phrase", "relevance_score")


@register("j2_demand_products", "SELECT l.demand_id, l.product_id, p.product_name, l.fit_score FROM links l JOIN products p USING (product_id)", "links", "products")
def j2(t: Tables) -> DataFrame:
    return relate.provenance_links(t.links, t.products, "product_id").select("demand_id", "product_id", "product_name", "fit_score")


@register("j3_demand_tokens", "SELECT demand_id, n_nationkey AS token_id, n_name AS token_text FROM demands JOIN nation ON demand_id % 25 = n_nationkey", "demands")
def j3(t: Tables) -> DataFrame:
    links = t.demands.select("demand_id", (F.col("demand_id") % 25).alias("token_id"))
    return relate.provenance_links(links, t.raw("nation").selectExpr("cast(n_nationkey as bigint) as token_id", "n_name as token_text"), "token_id").select("demand_id", "token_id", "token_text")


@register("j4_provenance_documents", """SELECT d.demand_id, d.title, coalesce(p.n, 0) AS n_phrases, p.ids AS phrase_ids, coalesce(e.n, 0) AS n_events, e.ids AS event_ids FROM demands d
 LEFT JOIN (SELECT demand_id, count(*) AS n, string_agg(product_id, ',' ORDER BY product_id) AS ids FROM links GROUP BY 1) p USING (demand_id)
 LEFT JOIN (SELECT demand_id, count(*) AS n, string_agg(provenance_id, ',' ORDER BY created_at, provenance_id) AS ids FROM events_ GROUP BY 1) e USING (demand_id)""", "demands", "links", "events_")
def j4(t: Tables) -> DataFrame:
    tokens = t.demands.select("demand_id", (F.col("demand_id") % 25).alias("token_id"), F.lit("core").alias("token_role"))
    d = relate.provenance_documents(t.demands, _phrase_links(t), t.links, tokens, t.events)
    ids = lambda c, f: F.array_join(F.transform(c, lambda x: x[f].cast("string")), ",")
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return d.select("demand_id", "title", n("phrases").alias("n_phrases"), ids("phrases", "phrase_id").alias("phrase_ids"), n("events").alias("n_events"), ids("events", "provenance_id").alias("event_ids"))


@register("j5_cluster_tree", "SELECT a.cluster_id, a.size, b.cluster_id AS child_id, b.size AS child_size FROM meta a JOIN meta b ON a.cluster_level = 'A' AND b.cluster_level = 'B' AND b.parent_cluster_id = a.cluster_id", "meta")
def j5(t: Tables) -> DataFrame:
    return relate.cluster_tree(t.meta)


@register("j6_open_clusters", """, ch AS (SELECT *, cluster_id IN (SELECT parent_cluster_id FROM meta WHERE cluster_level = 'B' AND parent_cluster_id % 3 = 0) AS done FROM meta WHERE cluster_level = 'A' AND is_selected)
 SELECT cluster_id, size FROM ch WHERE NOT done OR (SELECT count(*) FROM ch WHERE NOT done) = 0 ORDER BY size DESC, cluster_id LIMIT 10""", "meta")
def j6(t: Tables) -> DataFrame:
    return relate.open_clusters(t.meta.where("cluster_level = 'A' or parent_cluster_id % 3 = 0"), 10)


@register("j7_seed_status", f", {sg('doc')} SELECT word, coalesce(n, 0) AS phrase_count, n IS NOT NULL AS is_seed FROM (SELECT DISTINCT unnest(w) AS word FROM sg) LEFT JOIN (SELECT seed_word AS word, count(*) AS n FROM doc GROUP BY 1) USING (word)", "doc")
def j7(t: Tables) -> DataFrame:
    return relate.seed_status(segment(t.doc).select("word"), t.doc)


@register("j8_seeds_of_demand", "SELECT DISTINCT seed_word FROM kw WHERE phrase_id % 7 = 3 OR phrase_id % 5 = 3 OR phrase_id % 11 = 3", "kw")
def j8(t: Tables) -> DataFrame:
    s = t.kw.select("seed_word", (F.col("phrase_id") % 7).alias("primary_demand_id"), F.to_json(F.array(F.col("phrase_id") % 5, F.col("phrase_id") % 11)).alias("related_demand_ids"))
    return relate.seeds_of(s, 3).select("seed_word")


@register("j9_unregistered_seeds", "SELECT DISTINCT seed_word FROM doc WHERE seed_word <> '' AND seed_word NOT IN (SELECT seed_word FROM doc WHERE first_seen_round = 1)", "doc")
def j9(t: Tables) -> DataFrame:
    return relate.unregistered_seeds(t.doc, t.doc.where("first_seen_round = 1").select("seed_word").distinct())


@register("j10_new_products", "SELECT product_id, url FROM products WHERE product_id > 300 AND url NOT IN (SELECT url FROM products WHERE product_id <= 300) QUALIFY row_number() OVER (PARTITION BY url ORDER BY product_id) = 1", "products")
def j10(t: Tables) -> DataFrame:
    return relate.new_by_key(t.products.where("product_id > 300"), t.products.where("product_id <= 300"), "url", ["product_id"]).select("product_id", "url")


@register("j11_members", "SELECT cluster_id, phrase_id, phrase FROM kw JOIN meta ON cluster_id_A = cluster_id AND cluster_level = 'A' WHERE size >= 70 AND cluster_id_A <> -1", "kw", "meta")
def j11(t: Tables) -> DataFrame:
    return relate.members(t.meta, t.kw, 70)


@register("j13_translations", "SELECT s.seed_word, coalesce(t.n, '-') AS translation FROM (SELECT DISTINCT seed_word FROM kw) s LEFT JOIN (SELECT seed_word, upper(seed_word) AS n FROM kw WHERE phrase_id % 2 = 0 AND length(seed_word) > 4 GROUP BY 1) t USING (seed_word)", "kw")
def j13(t: Tables) -> DataFrame:
    words = t.kw.where("phrase_id % 2 = 0 and length(seed_word) > 4").select("seed_word", F.upper("seed_word").alias("n")).distinct()
    return relate.distinct_seeds(t.kw).join(words, "seed_word", "left").select("seed_word", F.coalesce("n", F.lit("-")).alias("translation"))


@register("w1_top_per_group", "SELECT source_type, phrase_id, frequency FROM doc QUALIFY row_number() OVER (PARTITION BY source_type ORDER BY frequency DESC, phrase_id) <= 5", "doc")
def w1(t: Tables) -> DataFrame:
    return top_k(t.doc.select("source_type", "phrase_id", "frequency"), ["source_type"], [F.desc("frequency"), F.col("phrase_id")], 5)


@register("w2_first_per_group", "SELECT cluster_id_A, phrase_id FROM doc QUALIFY row_number() OVER (PARTITION BY cluster_id_A ORDER BY phrase_id) <= 50", "doc")
def w2(t: Tables) -> DataFrame:
    return top_k(t.doc.select("cluster_id_A", "phrase_id"), ["cluster_id_A"], [F.col("phrase_id")], 50)


@register("w3_global_top", "SELECT phrase_id, volume FROM doc ORDER BY volume DESC, phrase_id LIMIT 100", "doc")
def w3(t: Tables) -> DataFrame:
    return t.doc.select("phrase_id", "volume").orderBy(F.desc("volume"), "phrase_id").limit(100)


@register("w4_renumber", "SELECT phrase_id, CAST(CASE WHEN cluster_id_A = -1 THEN -1 ELSE dense_rank() OVER (PARTITION BY cluster_id_A = -1 ORDER BY cluster_id_A) + 999 END AS INT) AS cluster_id_A FROM doc", "doc")
def w4(t: Tables) -> DataFrame:
    return relate.renumbered(t.doc.select("phrase_id", "cluster_id_A"), "cluster_id_A", 1000).select("phrase_id", "cluster_id_A")


@register("w5_share_cumulative", "SELECT source_type, n, round(100.0 * n / sum(n) OVER (), 6) AS share, CAST(sum(n) OVER (ORDER BY source_type) AS BIGINT) AS running FROM (SELECT source_type, count(*) AS n FROM doc GROUP BY 1)", "doc")
def w5(t: Tables) -> DataFrame:
    c = relate.with_share(t.doc.groupBy("source_type").agg(F.count("*").alias("n")), "n")
    return c.withColumn("running", F.sum("n").over(Window.orderBy("source_type").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


@register("w6_latest_rows", "SELECT demand_id, max(created_at) AS created_at, arg_max(provenance_id, (created_at, provenance_id)) AS provenance_id FROM events_ GROUP BY 1", "events_")
def w6(t: Tables) -> DataFrame:
    return t.events.groupBy("demand_id").agg(F.max("created_at").alias("created_at"), F.max_by("provenance_id", F.struct("created_at", "provenance_id")).alias("provenance_id"))


@register("w7_confidence_trail", "SELECT provenance_id, new_score, lag(new_score) OVER (PARTITION BY demand_id ORDER BY created_at, provenance_id) AS old_score FROM events_", "events_")
def w7(t: Tables) -> DataFrame:
    return relate.confidence_trail(t.events).select("provenance_id", "new_score", "old_score")


@register("w8_seeded_sample", "SELECT phrase_id, phrase FROM doc ORDER BY md5('42|' || phrase_id), phrase_id LIMIT 1000", "doc")
def w8(t: Tables) -> DataFrame:
    return relate.sample(t.doc.select("phrase_id", "phrase"), 1000, 42, "phrase_id")


@register("w9_candidate_seeds", f", {sg('doc')} SELECT word, count(*) AS frequency FROM (SELECT unnest(w) AS word FROM sg) GROUP BY 1 HAVING count(*) >= 5 ORDER BY frequency DESC, word LIMIT 50", "doc")
def w9(t: Tables) -> DataFrame:
    return segment(t.doc).where("frequency >= 5 and length(word) >= 2").orderBy(F.desc("frequency"), "word").limit(50)


@register("o1_union", "SELECT phrase_id, phrase, 'doc' AS origin FROM doc UNION ALL SELECT phrase_id, phrase, NULL FROM kw", "doc", "kw")
def o1(t: Tables) -> DataFrame:
    return t.doc.select("phrase_id", "phrase", F.lit("doc").alias("origin")).unionByName(t.kw.select("phrase_id", "phrase"), allowMissingColumns=True)


@register("o2_distinct_seeds", "SELECT DISTINCT seed_word FROM doc WHERE seed_word IS NOT NULL AND seed_word <> ''", "doc")
def o2(t: Tables) -> DataFrame:
    return relate.distinct_seeds(t.doc)


@register("o3_difference", "SELECT DISTINCT cluster_id_A AS cluster_id FROM kw WHERE cluster_id_A NOT IN (SELECT cluster_id FROM meta WHERE is_selected)", "kw", "meta")
def o3(t: Tables) -> DataFrame:
    return t.kw.select(F.col("cluster_id_A").alias("cluster_id")).subtract(t.meta.where("is_selected").select("cluster_id"))


@register("o4_inverted", "SELECT DISTINCT seed_word FROM doc WHERE seed_word NOT IN (SELECT seed_word FROM doc WHERE frequency = 3)", "doc")
def o4(t: Tables) -> DataFrame:
    return relate.inverted(t.doc, t.doc.where("frequency = 3").select("seed_word").distinct(), "seed_word")


@register("o5_word_overlap", "SELECT phrase_id, len(list_intersect(a, b)) AS n_both, len(list_distinct(list_concat(a, b))) AS n_any FROM (SELECT phrase_id, string_split(phrase, ' ') AS a, string_split(lag(phrase, 1, '') OVER (PARTITION BY seed_word ORDER BY phrase_id), ' ') AS b FROM kw)", "kw")
def o5(t: Tables) -> DataFrame:
    before = F.lag("phrase", 1, "").over(Window.partitionBy("seed_word").orderBy("phrase_id"))
    p = t.kw.select("phrase_id", F.split("phrase", " ").alias("a"), F.split(before, " ").alias("b"))
    return p.select("phrase_id", F.size(F.array_intersect("a", "b")).cast("long").alias("n_both"), F.size(F.array_union("a", "b")).cast("long").alias("n_any"))
