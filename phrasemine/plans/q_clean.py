"""Registered queries: cleaning, validation and filters (F)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import clean
from .registry import Tables, register

CLEAN = r"""clean AS (SELECT *, trim(regexp_replace(lower(trim(phrase)), '\s+', ' ', 'g')) AS cp FROM doc),
 good AS (SELECT * FROM clean WHERE length(cp) BETWEEN 1 AND 255 AND NOT regexp_full_match(cp, '\d+') AND length(regexp_replace(cp, '[a-z0-9\s-]', '', 'g')) / length(cp) <= 0.5)"""


@register("f1_clean_phrase", f", {CLEAN} SELECT phrase_id, cp AS phrase FROM good", "doc")
def f1(t: Tables) -> DataFrame:
    return clean.where_clean(t.doc.select("phrase_id", "phrase"))


@register("f2_clean_seed", "SELECT phrase_id, CASE WHEN seed_word IS NULL OR trim(seed_word) = '' OR length(trim(seed_word)) > 100 THEN 'unknown' ELSE lower(trim(seed_word)) END AS seed_word FROM doc", "doc")
def f2(t: Tables) -> DataFrame:
    return t.doc.select("phrase_id", X.clean_seed(F.col("seed_word")).alias("seed_word"))


@register("f3_coerce_numbers", "SELECT event_id, CAST(trunc(coalesce(TRY_CAST(props AS DOUBLE), 1)) AS BIGINT) AS frequency, CAST(trunc(coalesce(value, 0)) AS BIGINT) AS volume FROM events")
def f3(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", X.to_long(F.col("props"), 1).alias("frequency"), X.to_long(F.col("value"), 0).alias("volume"))


@register("f4_select_sources", "SELECT phrase_id, source_type FROM doc WHERE source_type IN ('semrush', 'related_search')", "doc")
def f4(t: Tables) -> DataFrame:
    return clean.select_sources(t.doc, ["semrush", "related"]).select("phrase_id", "source_type")


@register("f5_record_defaults", "SELECT phrase_id, CAST(NULL AS INT) AS cluster_id_A, CAST(NULL AS INT) AS mapped_demand_id, 'unseen' AS processed_status FROM kw", "kw")
def f5(t: Tables) -> DataFrame:
    return clean.with_defaults(t.kw).select("phrase_id", "cluster_id_A", "mapped_demand_id", "processed_status")


@register("f6_first_spellings", "SELECT arg_min(k, (customer_id)) AS keyword FROM (SELECT c_custkey AS customer_id, trim(upper(c_mktsegment[1:1]) || c_mktsegment[2:] || CASE WHEN c_custkey % 2 = 0 THEN ' A' ELSE ' a' END || (c_custkey % 50)) AS k FROM customer) WHERE regexp_matches(k, '[a-zA-Z]') GROUP BY lower(k)")
def f6(t: Tables) -> DataFrame:
    k = t.raw("customer").selectExpr("c_custkey", "concat(upper(substring(c_mktsegment, 1, 1)), substring(c_mktsegment, 2), if(c_custkey % 2 = 0, ' A', ' a'), c_custkey % 50) as keyword")
    return clean.first_spellings(k, "keyword", ["c_custkey"])


@register("f7_valid_products", "SELECT product_id, CASE WHEN product_id % 9 = 0 THEN 'https://placeholder.com/product/' || substr(md5(product_name), 1, 8) ELSE url END AS url FROM products WHERE price BETWEEN 0 AND 999999 AND rating BETWEEN 0 AND 5", "products")
def f7(t: Tables) -> DataFrame:
    p = t.products.withColumn("url", F.when(F.col("product_id") % 9 != 0, F.col("url")))
    return clean.valid_products(p).select("product_id", "url")


@register("f8_clean_communities", """SELECT name, subscribers, CASE WHEN description IS NULL OR trim(description) IN ('', 'None') THEN 'skipped' ELSE 'pending' END AS ai_analysis_status, 'b1' AS import_batch_id
 FROM communities WHERE name IS NOT NULL AND subscribers >= 0 QUALIFY row_number() OVER (PARTITION BY name ORDER BY subscribers DESC, subreddit_id) = 1""", "communities")
def f8(t: Tables) -> DataFrame:
    return clean.clean_communities(t.communities, "b1").select("name", "subscribers", "ai_analysis_status", "import_batch_id")


@register("f9_paged_scan", "SELECT phrase_id, phrase, (SELECT count(*) FROM doc WHERE source_type = 'dropdown' AND first_seen_round = 2) AS total FROM doc WHERE source_type = 'dropdown' AND first_seen_round = 2 ORDER BY phrase_id LIMIT 20 OFFSET 40", "doc")
def f9(t: Tables) -> DataFrame:
    rows, total = clean.page(t.doc, {"source_type": "dropdown", "first_seen_round": 2, "cluster_id_A": None}, ["phrase_id"], 3, 20)
    return rows.join(F.broadcast(total)).select("phrase_id", "phrase", "total")


@register("f10_lookups", "SELECT phrase_id, first_seen_round FROM doc WHERE first_seen_round IN (1, 3) AND cluster_id_A = 6 AND processed_status = 'unseen'", "doc")
def f10(t: Tables) -> DataFrame:
    return clean.where_equal(t.doc, {"first_seen_round": [1, 3], "cluster_id_A": 6, "processed_status": "unseen"}).select("phrase_id", "first_seen_round")


@register("f11_newest_round", "SELECT phrase_id, first_seen_round FROM doc WHERE first_seen_round = (SELECT max(first_seen_round) FROM doc)", "doc")
def f11(t: Tables) -> DataFrame:
    return clean.newest_round(t.doc).select("phrase_id", "first_seen_round")


@register("f12_product_search", "SELECT product_id, price, (SELECT count(*) FROM products WHERE (product_name LIKE '%red%' OR description LIKE '%red%') AND price BETWEEN 900 AND 1500 AND rating >= 2 AND review_count >= 10 AND platform = 'etsy') AS total FROM products WHERE (product_name LIKE '%red%' OR description LIKE '%red%') AND price BETWEEN 900 AND 1500 AND rating >= 2 AND review_count >= 10 AND platform = 'etsy' ORDER BY product_id LIMIT 50", "products")
def f12(t: Tables) -> DataFrame:
    found = clean.search(t.products, clean.text_has("red", "product_name", "description"), F.col("price").between(900, 1500), F.col("rating") >= 2, F.col("review_count") >= 10, F.col("platform") == "etsy", None)
    return found.orderBy("product_id").limit(50).join(F.broadcast(found.agg(F.count("*").alias("total")))).select("product_id", "price", "total")


@register("f13_product_listing", "SELECT product_id, price FROM products WHERE ai_analysis_status = 'pending' ORDER BY price DESC, product_id LIMIT 100", "products")
def f13(t: Tables) -> DataFrame:
    return clean.where_equal(t.products, {"ai_analysis_status": "pending", "platform": None}).orderBy(F.desc("price"), "product_id").limit(100).select("product_id", "price")


@register("f14_community_query", "SELECT subreddit_id, subscribers, count(*) OVER () AS total, count(*) OVER () > 5 + 10 AS has_more FROM communities WHERE ai_analysis_status IN ('pending', 'failed') AND (tag1 IN ('tag3', 'even') OR tag2 IN ('tag3', 'even') OR tag3 IN ('tag3', 'even')) AND importance_score BETWEEN 1 AND 4 ORDER BY subscribers DESC, subreddit_id LIMIT 10 OFFSET 5", "communities")
def f14(t: Tables) -> DataFrame:
    found = clean.search(clean.where_equal(t.communities, {"ai_analysis_status": ["pending", "failed"]}), clean.any_tag(["tag1", "tag2", "tag3"], ["tag3", "even"]), F.col("importance_score").between(1, 4))
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(F.desc("subscribers"), "subreddit_id").offset(5).limit(10).join(F.broadcast(total)).select("subreddit_id", "subscribers", "total", (F.col("total") > 15).alias("has_more"))


@register("f15_communities_by_tags", "SELECT subreddit_id FROM communities WHERE tag1 IN ('tag1', 'tag4') OR tag2 IN ('tag1', 'tag4') OR tag3 IN ('tag1', 'tag4')", "communities")
def f15(t: Tables) -> DataFrame:
    return clean.search(t.communities, clean.any_tag(["tag1", "tag2", "tag3"], ["tag1", "tag4"])).select("subreddit_id")


@register("f16_demand_list", "SELECT demand_id, confidence_score, status FROM demands WHERE source_phase = 'phase4' AND is_validated AND confidence_score >= 0.3 AND demand_type IN ('tool', 'service') ORDER BY demand_id DESC LIMIT 100", "demands")
def f16(t: Tables) -> DataFrame:
    found = clean.search(clean.where_equal(t.demands, {"source_phase": "phase4", "demand_type": ["tool", "service"]}), F.col("is_validated"), F.col("confidence_score") >= 0.3)
    return found.orderBy(F.desc("demand_id")).limit(100).select("demand_id", "confidence_score", "status")


@register("f16_demand_kpis", "SELECT count(*) AS n, count(*) FILTER (is_validated) AS validated, round(avg(confidence_score), 6) AS avg_confidence FROM demands", "demands")
def f16_kpis(t: Tables) -> DataFrame:
    return t.demands.agg(F.count("*").alias("n"), F.count_if("is_validated").alias("validated"), F.round(F.avg("confidence_score"), 6).alias("avg_confidence"))


@register("f18_seed_list", "SELECT seed_word, count(*) AS expansion_count FROM doc WHERE length(seed_word) % 4 = 1 GROUP BY 1", "doc")
def f18(t: Tables) -> DataFrame:
    types = F.expr("array(element_at(array('intent', 'action', 'object', 'other'), length(seed_word) % 4 + 1))")
    seeds = t.doc.groupBy("seed_word").agg(F.count("*").alias("expansion_count")).withColumn("token_types", F.to_json(types))
    return seeds.where(F.array_contains(F.from_json("token_types", "array<string>"), "action")).select("seed_word", "expansion_count")


@register("f19_cluster_dashboard", "SELECT cluster_id, size, quality_score, CASE WHEN size > 100 THEN 'large' WHEN size >= 50 THEN 'medium' ELSE 'small' END AS size_class FROM meta WHERE cluster_level = 'A' AND quality_score >= 40 AND intent_no <> 2", "meta")
def f19(t: Tables) -> DataFrame:
    size = F.when(F.col("size") > 100, "large").when(F.col("size") >= 50, "medium").otherwise("small")
    found = clean.search(t.meta, F.col("cluster_level") == "A", F.col("quality_score") >= 40, F.col("intent_no") != 2)
    return found.orderBy(F.coalesce("quality_score", F.lit(-1)).desc(), "cluster_id").select("cluster_id", "size", "quality_score", size.alias("size_class"))


@register("f20_template_match_filter", "SELECT phrase_id, volume FROM kw WHERE contains(phrase, 'how to fix') AND volume >= 950", "kw")
def f20(t: Tables) -> DataFrame:
    return clean.search(t.kw, clean.text_has("how to fix", "phrase"), F.col("volume") >= 950).select("phrase_id", "volume")


@register("f21_word_table_filter", "SELECT seed_word AS word, count(*) AS frequency FROM doc GROUP BY 1 HAVING count(*) BETWEEN 3 AND 500 AND length(seed_word) % 3 <> 0", "doc")
def f21(t: Tables) -> DataFrame:
    words = t.doc.groupBy(F.col("seed_word").alias("word")).agg(F.count("*").alias("frequency"))
    return clean.search(words, F.col("frequency").between(3, 500), F.length("word") % 3 != 0)


@register("f22_sanitize_html", """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped_md5,
 html IS NULL OR length(html) > 3000 OR (contains(html, '<') AND contains(html, '>')) AS rejected FROM pages""")
def f22(t: Tables) -> DataFrame:
    h = F.col("html")
    bad = h.isNull() | (F.length(h) > 3000) | (F.contains(h, F.lit("<")) & F.contains(h, F.lit(">")))
    return t.raw("pages").select("page_id", F.md5(X.escape_html(h)).alias("escaped_md5"), bad.alias("rejected"))


@register("f23_unclustered", "SELECT phrase_id, CASE WHEN cluster_id_A IS NULL OR cluster_id_A = 0 THEN 'unassigned' ELSE CAST(cluster_id_A AS VARCHAR) END AS shown FROM doc WHERE cluster_id_A <= 0", "doc")
def f23(t: Tables) -> DataFrame:
    return t.doc.where("cluster_id_A <= 0").select("phrase_id", F.coalesce(F.nullif("cluster_id_A", F.lit(0)).cast("string"), F.lit("unassigned")).alias("shown"))


@register("f24_cluster_listings", "SELECT cluster_id, size FROM meta WHERE cluster_level = 'A' AND is_selected", "meta")
def f24(t: Tables) -> DataFrame:
    return clean.where_equal(t.meta, {"cluster_level": "A", "is_selected": True}).orderBy(F.desc("size"), "cluster_id").select("cluster_id", "size")


@register("f25_demand_listings", "SELECT demand_id FROM demands WHERE status = 'validated' AND source_cluster_A = 21", "demands")
def f25(t: Tables) -> DataFrame:
    return clean.where_equal(t.demands, {"status": "validated", "source_cluster_A": 21}).select("demand_id")


@register("s9_check_table", "SELECT count(*) AS n_rows, '' AS missing, count(*) BETWEEN 1 AND 1000000 AS valid FROM doc", "doc")
def s9(t: Tables) -> DataFrame:
    return clean.check_table(t.doc, ["phrase", "seed_word"])


@register("a1_merge_sources", f""", {CLEAN} SELECT cp AS phrase, arg_min(lower(trim(seed_word)), r) AS seed_word, arg_min(source_type, r) AS source_type, CAST(sum(frequency) AS BIGINT) AS frequency, max(volume) AS volume, 1 AS first_seen_round
 FROM (SELECT *, CASE source_type WHEN 'semrush' THEN 1 WHEN 'dropdown' THEN 2 ELSE 3 END * 1000000000000 + phrase_id AS r FROM good) GROUP BY cp""", "doc")
def a1(t: Tables) -> DataFrame:
    return clean.merge_sources(t.doc, 1, ["phrase_id"])
