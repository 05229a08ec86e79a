"""Registered queries: annotation requests and replies (L).  Replies are made from the tables: good, broken, fenced and missing ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import annotate, relate, stats
from ..operators.scoring import cluster_framework
from .q_tokens import TYPES, _types, tk
from .q_stats import SUMMARY
from .registry import Tables, register


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _mixed(good: Column, key: Column) -> Column:
    """Good, fenced and broken replies in turn."""
    return F.when(key % 3 == 0, good).when(key % 3 == 1, F.concat(F.lit("Sure!\n```json\n"), good, F.lit("\n```"))).otherwise("no json here")


CL = f"cl AS ({SUMMARY.format(label='cluster_id_A', more='')})"


@register("l1_theme_requests", f", {CL} SELECT cluster_id, replace(example_phrases, '; ', chr(10)) AS prompt FROM cl", "doc")
def l1(t: Tables) -> DataFrame:
    return annotate.theme_requests(stats.cluster_summary(t.doc, "cluster_id_A"))


@register("l1_parse_themes", "SELECT cluster_id, CASE WHEN cluster_id % 3 = 2 THEN 'no json here' ELSE 'theme ' || cluster_id END AS theme, CASE WHEN cluster_id % 3 = 2 THEN 'medium' ELSE 'high' END AS confidence FROM meta WHERE cluster_level = 'A'", "meta")
def l1_parse(t: Tables) -> DataFrame:
    good = _json(theme=F.concat(F.lit("theme "), F.col("cluster_id").cast("string")), confidence=F.lit("high"))
    return annotate.parse_themes(t.meta.where("cluster_level = 'A'").select("cluster_id", _mixed(good, F.col("cluster_id")).alias("reply")))


@register("l2_card_requests", f""", {tk('kw')}, {TYPES}, fr AS (SELECT * FROM (SELECT cluster_id_A, token_type, token, count(*) AS n FROM (SELECT cluster_id_A, unnest(tk.w) AS token FROM kw JOIN tk USING (phrase_id)) JOIN ty USING (token) GROUP BY 1, 2, 3)
 QUALIFY row_number() OVER (PARTITION BY cluster_id_A, token_type ORDER BY n DESC, token) <= 5), ts AS (SELECT cluster_id_A, string_agg(token, ', ' ORDER BY token) AS tokens FROM (SELECT DISTINCT cluster_id_A, token FROM fr) GROUP BY 1),
 ps AS (SELECT cluster_id_A, string_agg(phrase, chr(10) ORDER BY phrase_id) AS phrases FROM (SELECT * FROM kw QUALIFY row_number() OVER (PARTITION BY cluster_id_A ORDER BY phrase_id) <= 30) GROUP BY 1)
 SELECT cluster_id_A AS cluster_id, concat_ws(chr(10) || '---' || chr(10), phrases, tokens) AS prompt FROM ps LEFT JOIN ts USING (cluster_id_A)""", "kw")
def l2(t: Tables) -> DataFrame:
    m = relate.members(t.meta, t.kw, 1)
    f = cluster_framework(t.kw, _types(t).select("token", "token_type"), "cluster_id_A", 5).withColumnRenamed("cluster_id_A", "cluster_id")
    return annotate.card_requests(m, f)


@register("l2_parse_cards", "SELECT cluster_id, CASE WHEN cluster_id % 3 = 2 THEN 'Cluster ' || cluster_id ELSE 'title' END AS title, CASE WHEN cluster_id % 3 = 2 THEN 'other' WHEN cluster_id % 2 = 0 THEN 'tool' ELSE 'other' END AS demand_type, CASE WHEN cluster_id % 3 = 2 THEN 'unknown' ELSE 'high' END AS business_value, cluster_id % 3 <> 2 AS parsed FROM meta", "meta")
def l2_parse(t: Tables) -> DataFrame:
    good = _json(title=F.lit("title"), description=F.lit("d"), demand_type=F.when(F.col("cluster_id") % 2 == 0, "tool").otherwise("nonsense"), priority=F.lit("high"))
    return annotate.parse_cards(t.meta.select("cluster_id", _mixed(good, F.col("cluster_id")).alias("reply"))).drop("description")


@register("l3_batch_requests", "SELECT CAST(b AS BIGINT) AS batch, string_agg((i - b * 50 + 1) || '. ' || word, chr(10) ORDER BY i) AS prompt FROM (SELECT word, row_number() OVER (ORDER BY word) - 1 AS i, (row_number() OVER (ORDER BY word) - 1) // 50 AS b FROM (SELECT DISTINCT seed_word AS word FROM doc)) GROUP BY b", "doc")
def l3(t: Tables) -> DataFrame:
    return annotate.batch_requests(t.doc.select(F.col("seed_word").alias("word")).distinct(), "word", 50).drop("n")


@register("l3_token_types", """, b AS (SELECT word, (row_number() OVER (ORDER BY word) - 1) // 50 AS batch FROM (SELECT DISTINCT seed_word AS word FROM doc))
 SELECT word AS token, CASE WHEN batch % 3 < 2 AND length(word) % 2 = 0 THEN 'intent' ELSE 'other' END AS token_type, CASE WHEN batch % 3 < 2 AND length(word) % 2 = 0 THEN 'high' ELSE 'low' END AS confidence FROM b""", "doc")
def l3_types(t: Tables) -> DataFrame:
    w = annotate.numbered_batches(t.doc.select(F.col("seed_word").alias("token")).distinct(), "token", 50).select("token", "batch")
    item = F.when(F.length("token") % 2 == 0, F.struct("token", F.lit("intent").alias("token_type"), F.lit("high").alias("confidence")))
    replies = w.groupBy("batch").agg(F.to_json(F.collect_list(item)).alias("good")).select("batch", _mixed(F.col("good"), F.col("batch")).alias("reply"))
    return annotate.parse_token_types(w, replies)


@register("l4_translations", "SELECT word, CASE WHEN length(word) % 2 = 0 THEN upper(word) ELSE '[' || word || ']' END AS translation FROM (SELECT DISTINCT seed_word AS word FROM kw)", "kw")
def l4(t: Tables) -> DataFrame:
    words = relate.distinct_seeds(t.kw).withColumnRenamed("seed_word", "word")
    entry = F.struct(F.col("word").alias("key"), F.upper("word").alias("value"))
    replies = words.where("length(word) % 2 = 0").groupBy(F.length("word").alias("batch")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("reply"))
    return annotate.parse_translations(words, replies)


@register("l5_validate_labels", "SELECT cluster_id, CASE WHEN cluster_id % 3 <> 2 THEN repeat('x', 100) END AS label, CASE WHEN cluster_id % 3 <> 2 AND cluster_id % 2 = 0 THEN 'tool' ELSE 'other' END AS primary_demand_type, CASE WHEN cluster_id % 3 <> 2 THEN 'content,other' END AS secondary_demand_types, CAST(CASE WHEN cluster_id % 3 = 2 THEN 50 ELSE 100 END AS INT) AS confidence, cluster_id % 3 = 2 AS failed FROM meta", "meta")
def l5(t: Tables) -> DataFrame:
    good = _json(label=F.repeat(F.lit("x"), F.lit(120)), summary=F.lit("s"), primary_demand_type=F.when(F.col("cluster_id") % 2 == 0, "tool").otherwise("?"), secondary_demand_types=F.array(F.lit("content"), F.lit("?")), confidence=F.lit("140"))
    return annotate.validate_labels(t.meta.select("cluster_id", _mixed(good, F.col("cluster_id")).alias("reply"))).drop("summary")


@register("l6_assessments", "SELECT cluster_id, CASE WHEN cluster_id % 2 = 0 THEN 'good one' ELSE '价值: x' END AS summary, cluster_id % 2 = 0 AS recommended, CASE WHEN cluster_id % 2 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM meta", "meta")
def l6(t: Tables) -> DataFrame:
    reply = F.when(F.col("cluster_id") % 2 == 0, "摘要：good one\n价值: y\n推荐：是\n置信度: 0.9").otherwise("价值: x")
    return annotate.parse_assessments(t.meta.select("cluster_id", reply.alias("reply"))).drop("value")


@register("l7_product_requests", "SELECT product_id, product_name || chr(10) || description[1:500] AS prompt FROM products WHERE ai_analysis_status IN ('pending', 'failed')", "products")
def l7(t: Tables) -> DataFrame:
    return annotate.product_requests(t.products, ["pending", "failed"])


@register("l7_parse_products", "SELECT product_id, CASE WHEN product_id % 3 = 2 OR product_id % 5 = 0 THEN '' ELSE 'a,b,' || tag END AS tags, CASE WHEN product_id % 3 = 2 OR product_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS ai_analysis_status FROM products WHERE ai_analysis_status = 'pending'", "products")
def l7_parse(t: Tables) -> DataFrame:
    good = _json(tags=F.array(F.lit("a"), F.lit("b"), F.col("tag"), F.lit("d")), core_need=F.lit("n"), virtual_product_fit=F.lit("high"))
    replies = t.products.where("product_id % 5 <> 0").select("product_id", _mixed(good, F.col("product_id")).alias("reply"))
    return annotate.parse_products(annotate.product_requests(t.products, ["pending"]), replies).select("product_id", "tags", "ai_analysis_status")


@register("l8_community_requests", "SELECT subreddit_id, name || ' (' || subscribers || '): ' || coalesce(description, '') AS prompt FROM communities", "communities")
def l8(t: Tables) -> DataFrame:
    return annotate.community_requests(t.communities, "{name} ({subscribers}): {description}")


@register("l8_parse_communities", "SELECT subreddit_id, CASE WHEN subreddit_id % 3 <> 2 THEN tag1 END AS tag1, CASE WHEN subreddit_id % 3 <> 2 THEN 5 END AS importance_score, CASE WHEN subreddit_id % 3 <> 2 THEN 'completed' ELSE 'failed' END AS ai_analysis_status FROM communities", "communities")
def l8_parse(t: Tables) -> DataFrame:
    good = _json(tag1=F.col("tag1"), tag2=F.lit("b"), tag3=F.lit("c"), importance_score=F.lit(9), confidence=F.lit(80))
    replies = t.communities.select("subreddit_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"), F.col("tag1")).withColumn("reply", F.when(F.col("attempt") == 1, "broken {").otherwise(_mixed(good, F.col("subreddit_id"))))
    return annotate.parse_communities(t.communities, replies).select("subreddit_id", "tag1", "importance_score", "ai_analysis_status")


@register("l9_consistency", "SELECT cluster_id, cluster_id % 3 = 2 AS consistent, CASE WHEN cluster_id % 3 = 2 THEN 0.5 ELSE 0.4 END::DOUBLE AS score, CASE WHEN cluster_id % 3 <> 2 THEN 3 END AS n_parts FROM meta", "meta")
def l9(t: Tables) -> DataFrame:
    good = _json(is_consistent=F.lit(False), consistency_score=F.lit(0.4), suggested_splits=F.lit(3))
    return annotate.parse_consistency(t.meta.select("cluster_id", _mixed(good, F.col("cluster_id")).alias("reply")))


@register("l10_identified", "SELECT DISTINCT seed_word AS variable_text, length(seed_word) % 2 = 0 AS is_product FROM kw WHERE length(seed_word) % 3 <> 2", "kw")
def l10(t: Tables) -> DataFrame:
    item = F.struct(F.col("seed_word").alias("variable_text"), (F.length("seed_word") % 2 == 0).alias("is_product"), F.lit(50).alias("commercial_value"), F.lit("c").alias("category"))
    replies = relate.distinct_seeds(t.kw).groupBy(F.length("seed_word").alias("batch")).agg(F.to_json(F.collect_list(item)).alias("good")).select("batch", _mixed(F.col("good"), F.col("batch")).alias("reply"))
    return annotate.parse_identified(replies).select("variable_text", "is_product")
