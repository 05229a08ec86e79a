"""Registered queries: upserts, state tables and the event log (E)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import state
from .registry import Tables, register

def _now() -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def _words(t: Tables, cond: str) -> DataFrame:
    return t.doc.where(cond).groupBy(F.col("seed_word").alias("word")).agg(F.count("*").alias("frequency"), F.max(F.when(F.col("frequency") > 4, "NN")).alias("pos_tag"))


@register("e1_upsert_words", """, o AS (SELECT seed_word AS word, count(*) AS f, max(CASE WHEN frequency > 4 THEN 'NN' END) AS p FROM doc WHERE first_seen_round <= 2 GROUP BY 1), n AS (SELECT seed_word AS word, count(*) AS f, max(CASE WHEN frequency > 4 THEN 'NN' END) AS p FROM doc WHERE first_seen_round = 3 GROUP BY 1)
 SELECT word, coalesce(o.f, 0) + coalesce(n.f, 0) AS frequency, coalesce(n.p, o.p) AS pos_tag, o.f IS NULL AS is_new FROM o FULL JOIN n USING (word)""", "doc")
def e1(t: Tables) -> DataFrame:
    return state.upsert_words(_words(t, "first_seen_round <= 2"), _words(t, "first_seen_round = 3")).drop("word_count")


@register("e2_load_words", "SELECT seed_word AS word, count(*) AS frequency, false AS is_ngram FROM doc GROUP BY 1 HAVING count(*) >= 4", "doc")
def e2(t: Tables) -> DataFrame:
    return state.load_words(_words(t, "true").withColumn("word_count", F.size(F.split("word", " "))), 4).select("word", "frequency", "is_ngram")


@register("e3_mark_roots", "SELECT word, CASE WHEN length(word) % 5 = 0 THEN true WHEN length(word) % 5 = 1 THEN false ELSE length(word) % 9 = 0 END AS is_root, CASE WHEN length(word) % 5 = 0 THEN 7 WHEN length(word) % 5 = 1 THEN NULL WHEN length(word) % 9 = 0 THEN 1 END AS root_round FROM (SELECT DISTINCT seed_word AS word FROM doc)", "doc")
def e3(t: Tables) -> DataFrame:
    n = F.length("word")
    w = t.doc.select(F.col("seed_word").alias("word")).distinct()
    words = w.select("word", (n % 9 == 0).alias("is_root"), F.when(n % 9 == 0, 1).alias("root_round"), F.lit(None).cast("string").alias("root_source"))
    changes = w.where(n % 5 <= 1).select("word", (n % 5 == 0).alias("is_root"), F.lit(7).alias("root_round"), F.lit("user").alias("root_source"))
    return state.mark_roots(words, changes).select("word", "is_root", "root_round")


@register("e4_batch_view", "SELECT demand_id AS batch_id, arg_max(event_type, (created_at, event_type)) AS status, min(created_at) AS started, max(created_at) AS ended FROM events_ GROUP BY 1", "events_")
def e4(t: Tables) -> DataFrame:
    return state.batch_view(t.events.selectExpr("demand_id as batch_id", "created_at as at", "event_type as status", "new_score as n")).select("batch_id", "status", "started", "ended")


@register("e5_upsert_tokens", """, o AS (SELECT seed_word AS w, count(*) AS f FROM doc WHERE first_seen_round = 1 GROUP BY 1), n AS (SELECT seed_word AS w, count(*) AS f FROM doc WHERE first_seen_round = 2 GROUP BY 1)
 SELECT w AS token_text, CASE WHEN o.f IS NOT NULL THEN 'old' ELSE 'new' END AS token_type, greatest(o.f, n.f) AS in_phrase_count, CASE WHEN n.f IS NOT NULL THEN 'seen' END AS notes FROM o FULL JOIN n USING (w)""", "doc")
def e5(t: Tables) -> DataFrame:
    def count(r: int, kind: str, notes: str | None) -> DataFrame:
        return t.doc.where(F.col("first_seen_round") == r).groupBy(F.col("seed_word").alias("token_text")).agg(F.count("*").alias("in_phrase_count")).withColumns({"token_type": F.lit(kind), "notes": F.lit(notes).cast("string")})

    return state.upsert_tokens(count(1, "old", None), count(2, "new", "seen"))


@register("e6_upsert_seeds", "SELECT seed_word, coalesce(max(CASE WHEN phrase_id % 2 = 0 AND length(seed_word) > 4 THEN 'high' END), 'low') AS priority, count(*) FILTER (phrase_id % 2 = 1) > 0 AS was_there FROM kw GROUP BY 1", "kw")
def e6(t: Tables) -> DataFrame:
    old = t.kw.where("phrase_id % 2 = 1").select("seed_word").distinct().withColumns({"priority": F.lit("low"), "was_there": F.lit(True)})
    new = t.kw.where("phrase_id % 2 = 0").select("seed_word").distinct().withColumn("priority", F.when(F.length("seed_word") > 4, "high"))
    return state.upsert(old, new, ["seed_word"]).select("seed_word", F.coalesce("priority", F.lit("low")).alias("priority"), F.coalesce("was_there", F.lit(False)).alias("was_there"))


@register("e7_upsert_meta", "SELECT cluster_id, cluster_level, CASE WHEN cluster_id % 2 = 0 THEN size * 2 ELSE size END AS size, is_selected FROM meta", "meta")
def e7(t: Tables) -> DataFrame:
    changes = t.meta.where("cluster_id % 2 = 0").select("cluster_id", "cluster_level", (F.col("size") * 2).alias("size"), F.lit(False).alias("is_selected"))
    return state.upsert(t.meta, changes, ["cluster_id", "cluster_level"], ["is_selected"]).select("cluster_id", "cluster_level", "size", "is_selected")


@register("e8_assign_clusters", "SELECT phrase_id, CASE WHEN phrase_id % 4 = 0 THEN -1 WHEN phrase_id % 4 = 1 THEN 5 ELSE cluster_id_A END AS cluster_id_A, cluster_id_B, CASE WHEN phrase_id % 4 <= 1 THEN 'assigned' ELSE processed_status END AS processed_status FROM kw", "kw")
def e8(t: Tables) -> DataFrame:
    labels = t.kw.where("phrase_id % 4 <= 1").select("phrase_id", F.when(F.col("phrase_id") % 4 == 0, -1).otherwise(5).alias("a"), F.lit(None).cast("int").alias("b"))
    return state.assign_clusters(t.kw, labels).select("phrase_id", "cluster_id_A", "cluster_id_B", "processed_status")


@register("e9_reset", "SELECT phrase_id, -1 AS cluster_id_A, 'unseen' AS processed_status, (SELECT count(*) FROM meta WHERE cluster_level <> 'A') AS n_meta FROM kw", "kw", "meta")
def e9(t: Tables) -> DataFrame:
    p, m = state.reset(t.kw, t.meta)
    return p.join(F.broadcast(m.agg(F.count("*").alias("n_meta")))).select("phrase_id", "cluster_id_A", "processed_status", "n_meta")


def _new_demands(t: Tables) -> DataFrame:
    return t.products.select(F.col("product_name").alias("title"), F.lit(0.5).alias("confidence"), F.array("product_id").alias("source_ids"), F.col("product_id").alias("change_id"))


@register("e10_create_demands", "SELECT title, confidence, count(*) AS n, count(DISTINCT demand_id) AS n_ids FROM (SELECT product_name AS title, 0.5::DOUBLE AS confidence, product_id AS demand_id FROM products) GROUP BY ALL", "products")
def e10(t: Tables) -> DataFrame:
    d, _ = state.create_demands(t.demands.select("demand_id"), _new_demands(t), _now())
    return d.groupBy("title", F.col("confidence_score").alias("confidence")).agg(F.count("*").alias("n"), F.count_distinct("demand_id").alias("n_ids"))


def _links(t: Tables) -> tuple[DataFrame, DataFrame]:
    old = t.links.where("product_id % 3 <> 0")
    new = t.links.where("product_id % 3 <> 1").select("demand_id", "product_id", (F.col("fit_score") / 2).alias("fit_score"), (F.col("demand_id") * 100000 + F.col("product_id")).alias("change_id"))
    return old, new


@register("e11_link", "SELECT demand_id, product_id, CASE WHEN product_id % 3 = 1 THEN fit_score ELSE fit_score / 2 END AS fit_score FROM links", "links")
def e11(t: Tables) -> DataFrame:
    return state.link(*_links(t), "product_id", "fit_score", False)[0]


@register("e11_link_events", "SELECT demand_id, CASE WHEN product_id % 3 = 0 THEN 'linked_product' ELSE 'updated' END AS event_type, demand_id * 100000 + product_id AS change_id FROM links WHERE product_id % 3 <> 1", "links")
def e11_events(t: Tables) -> DataFrame:
    return state.link(*_links(t), "product_id", "fit_score", True)[1].select("demand_id", "event_type", "change_id")


def _scores(t: Tables) -> DataFrame:
    return t.events.select("demand_id", F.round(F.abs(F.sin("new_score")), 4).alias("score"), F.col("event_type").alias("reason"), F.col("provenance_id").alias("change_id"))


@register("e12_change_confidence", """, c AS (SELECT demand_id, arg_max(round(abs(sin(new_score)), 4), provenance_id) AS s, count(*) AS n FROM events_ WHERE new_score IS NOT NULL GROUP BY 1)
 SELECT d.demand_id, coalesce(c.s, d.confidence_score) AS confidence_score, 1 + coalesce(n, 0) AS n_history FROM demands d LEFT JOIN c USING (demand_id)""", "demands", "events_")
def e12(t: Tables) -> DataFrame:
    d = t.demands.withColumn("confidence_history", F.array(F.struct(F.col("confidence_score").alias("score"), _now().alias("timestamp"), F.lit("created").alias("reason"))))
    return state.change_confidence(d, _scores(t), _now())[0].select("demand_id", "confidence_score", F.size("confidence_history").cast("long").alias("n_history"))


@register("e12_confidence_events", "SELECT e.demand_id, provenance_id AS change_id, 'confidence_changed' AS event_type FROM events_ e JOIN demands d USING (demand_id)", "demands", "events_")
def e12_events(t: Tables) -> DataFrame:
    d = t.demands.withColumn("confidence_history", F.array(F.struct(F.col("confidence_score").alias("score"), _now().alias("timestamp"), F.lit("created").alias("reason"))))
    return state.change_confidence(d, _scores(t), _now())[1].select("demand_id", "change_id", "event_type")


@register("e13_validate", """, c AS (SELECT demand_id, count(*) AS n FROM events_ WHERE provenance_id % 3 = 0 GROUP BY 1)
 SELECT d.demand_id, is_validated OR n IS NOT NULL AS is_validated, coalesce(n, 0) AS validation_count, CASE WHEN n IS NULL THEN confidence_score ELSE round(least(1.0, confidence_score + 0.2 * n), 6) END AS confidence_score FROM demands d LEFT JOIN c USING (demand_id)""", "demands", "events_")
def e13(t: Tables) -> DataFrame:
    d = t.demands.withColumns({"validation_count": F.lit(0).cast("long"), "validated_by": F.lit(None).cast("string")})
    changes = t.events.where("provenance_id % 3 = 0").select("demand_id", F.col("event_type").alias("by"), F.col("provenance_id").alias("change_id"))
    return state.validate(d, changes)[0].select("demand_id", "is_validated", "validation_count", "confidence_score")


@register("e14_demands_from_products", "SELECT tag AS title, CASE WHEN product_id % 3 = 0 THEN 0.75 WHEN product_id % 3 = 1 THEN 0.6 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN product_id % 3 = 0 THEN 0.9 WHEN product_id % 3 = 1 THEN 0.7 ELSE 0.5 END::DOUBLE AS fit_score, product_id AS change_id FROM products WHERE product_id % 7 <> 0", "products")
def e14(t: Tables) -> DataFrame:
    fit = F.expr("element_at(array('high', 'medium', 'low'), cast(product_id % 3 as int) + 1)")
    p = t.products.select("product_id", F.when(F.col("product_id") % 7 == 0, " ").otherwise(F.col("tag")).alias("core_need"), fit.alias("virtual_product_fit"))
    return state.demands_from_products(p).drop("source_ids")


@register("e15_backfill", "SELECT demand_id, coalesce(source_phase, 'phase4') AS source_phase, CASE WHEN source_phase IS NULL THEN 'keyword_clustering' ELSE source_method END AS source_method FROM demands", "demands")
def e15(t: Tables) -> DataFrame:
    return state.backfill(t.demands).select("demand_id", "source_phase", "source_method")


@register("e16_migration_check", "SELECT count(*) AS n, count(source_phase) AS with_source_phase, count(confidence_score) AS with_confidence_score FROM demands", "demands")
def e16(t: Tables) -> DataFrame:
    return state.migration_check(t.demands, ["source_phase", "confidence_score"])


@register("e17_demand_reviews", "SELECT demand_id, CASE WHEN demand_id % 6 = 0 THEN 'archived' ELSE status END AS status, CASE WHEN demand_id % 6 = 2 THEN 'high' ELSE business_value END AS business_value, demand_id % 6 IN (0, 2) AS updated FROM demands", "demands")
def e17(t: Tables) -> DataFrame:
    k = F.col("demand_id") % 6
    sheet = t.demands.where("demand_id % 6 in (0, 2, 4)").select("demand_id", F.when(k == 0, "archived").otherwise("nonsense").alias("status"), F.when(k == 2, "high").alias("business_value"))
    return state.import_demand_reviews(t.demands, sheet).select("demand_id", "status", "business_value", "updated")


@register("e18_token_reviews", """, w AS (SELECT seed_word AS t, length(seed_word) AS n, bool_or(first_seen_round = 1) AS had FROM doc GROUP BY 1)
 SELECT t AS token_text, CASE WHEN n % 3 = 0 THEN 'intent' WHEN had THEN 'other' END AS token_type, CASE WHEN n % 2 = 0 THEN n % 4 = 0 WHEN had THEN false END AS verified, CASE WHEN NOT had THEN 'created' WHEN n % 2 = 0 OR n % 3 = 0 THEN 'updated' ELSE 'kept' END AS outcome FROM w WHERE had OR n % 3 = 0""", "doc")
def e18(t: Tables) -> DataFrame:
    w = t.doc.groupBy(F.col("seed_word").alias("token_text")).agg(F.max(F.col("first_seen_round") == 1).alias("had"))
    n = F.length("token_text")
    sheet = w.where((n % 2 == 0) | (n % 3 == 0)).select("token_text", F.when(n % 3 == 0, "intent").otherwise("nonsense").alias("token_type"), F.when(n % 2 == 0, F.when(n % 4 == 0, " Yes").otherwise("no")).alias("verified"))
    return state.import_token_reviews(w.where("had").select("token_text", F.lit("other").alias("token_type"), F.lit(False).alias("verified")), sheet, ["intent", "action", "object", "other"])


@register("e19_link_seed_demands", "SELECT seed_word, string_agg(DISTINCT phrase_id % 50, ',' ORDER BY phrase_id % 50) AS related, max(phrase_id % 50) FILTER (phrase_id % 7 = 0) AS primary_demand_id FROM kw GROUP BY 1", "kw")
def e19(t: Tables) -> DataFrame:
    seeds = t.kw.select("seed_word").distinct().select("seed_word", F.array().cast("array<long>").alias("related_demand_ids"), F.lit(None).cast("long").alias("primary_demand_id"))
    links = t.kw.select("seed_word", (F.col("phrase_id") % 50).alias("demand_id"), (F.col("phrase_id") % 7 == 0).alias("is_primary"))
    return state.link_seed_demands(seeds, links).select("seed_word", F.array_join(F.transform("related_demand_ids", lambda x: x.cast("string")), ",").alias("related"), "primary_demand_id")


@register("e20_bulk_update", "SELECT subreddit_id, CASE WHEN subreddit_id % 2 = 0 THEN 'completed' ELSE ai_analysis_status END AS ai_analysis_status, importance_score FROM communities", "communities")
def e20(t: Tables) -> DataFrame:
    changes = t.communities.where("subreddit_id % 2 = 0").select("subreddit_id", F.lit("completed").alias("ai_analysis_status"), F.lit(None).cast("int").alias("importance_score"))
    return state.upsert(t.communities, changes, ["subreddit_id"]).select("subreddit_id", "ai_analysis_status", "importance_score")


@register("e21_import_log", "SELECT shop_name, count(*) AS total_rows, count(*) FILTER (price < 920) AS imported_rows, count(*) - count(*) FILTER (price < 920) AS skipped_rows, 'completed' AS import_status FROM products GROUP BY 1", "products")
def e21(t: Tables) -> DataFrame:
    return state.import_log(t.products, t.products.where("price < 920"), "shop_name")


@register("e22_set_default", "SELECT subreddit_id AS config_id, import_batch_id AS config_type, CASE WHEN import_batch_id = 'batch1' THEN subreddit_id = 5 ELSE importance_score = 1 END AS is_default FROM communities", "communities")
def e22(t: Tables) -> DataFrame:
    c = t.communities.selectExpr("subreddit_id as config_id", "import_batch_id as config_type", "importance_score = 1 as is_default")
    return state.set_default(c, "batch1", 5)


@register("e23_add_fields", "SELECT 'f' || n_nationkey AS field_key, CASE WHEN n_nationkey < 10 THEN n_nationkey ELSE 9 + row_number() OVER (PARTITION BY n_nationkey < 10 ORDER BY 'f' || n_nationkey) END AS field_order FROM nation")
def e23(t: Tables) -> DataFrame:
    n = t.raw("nation").selectExpr("concat('f', n_nationkey) as field_key", "'text' as field_type", "cast(n_nationkey as int) as field_order", "true as is_system_field", "n_nationkey")
    return state.add_fields(n.where("n_nationkey < 10").drop("n_nationkey"), n.where("n_nationkey >= 5").select("field_key", "field_type")).select("field_key", "field_order")


@register("e23_custom_columns", "SELECT product_id, CASE WHEN product_id % 3 <> 0 THEN CAST(review_count AS DOUBLE) END AS stock, tag AS colour FROM products", "products")
def e23_columns(t: Tables) -> DataFrame:
    stock = F.when(F.col("product_id") % 3 == 0, "many").otherwise(F.col("review_count").cast("string"))
    p = t.products.select("product_id", F.create_map(F.lit("stock"), stock, F.lit("colour"), F.col("tag")).alias("custom_fields"))
    return state.custom_columns(p, [("stock", "number"), ("colour", "text")])


@register("e24_archive", "SELECT phrase_id, CASE WHEN d.status = 'validated' OR (cluster_id_A = -1 AND frequency < 10) THEN 'archived' ELSE processed_status END AS processed_status FROM doc LEFT JOIN demands d ON phrase_id % 5000 = d.demand_id", "doc", "demands")
def e24(t: Tables) -> DataFrame:
    return state.archive(t.doc.withColumn("mapped_demand_id", F.col("phrase_id") % 5000), t.demands).select("phrase_id", "processed_status")
