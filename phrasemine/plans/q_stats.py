"""Registered queries: aggregations and reports (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import QUESTION_WORDS
from ..operators import relate, stats
from .registry import Tables, register

Q = "(" + ", ".join(f"'{w}'" for w in QUESTION_WORDS) + ")"


@register("a2_phrase_statistics", """SELECT 'source' AS kind, source_type AS value, count(*) AS n FROM doc GROUP BY 2 UNION ALL SELECT 'status', processed_status, count(*) FROM doc GROUP BY 2
 UNION ALL SELECT 'round', CAST(first_seen_round AS VARCHAR), count(*) FROM doc GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*) FROM doc UNION ALL SELECT 'clustered', 'A', count(cluster_id_A) FROM doc UNION ALL SELECT 'clustered', 'B', count(cluster_id_B) FROM doc""", "doc")
def a2(t: Tables) -> DataFrame:
    return stats.phrase_statistics(t.doc)


@register("a3_import_overview", "SELECT source_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM doc), 6) AS share FROM doc GROUP BY 1", "doc")
def a3(t: Tables) -> DataFrame:
    return relate.with_share(t.doc.groupBy("source_type").agg(F.count("*").alias("n")), "n")


@register("a3_top_phrases", "SELECT phrase_id, phrase, frequency FROM doc ORDER BY frequency DESC, phrase_id LIMIT 20", "doc")
def a3_top(t: Tables) -> DataFrame:
    return t.doc.select("phrase_id", "phrase", "frequency").orderBy(F.desc("frequency"), "phrase_id").limit(20)


@register("a4_seed_expansion", """, c AS (SELECT seed_word, first_seen_round AS r, source_type AS s, count(*) AS n FROM doc GROUP BY ALL)
 SELECT seed_word, CAST(sum(n) AS BIGINT) AS total, (SELECT string_agg('R' || r || ':' || n, ', ' ORDER BY r) FROM (SELECT r, CAST(sum(n) AS BIGINT) AS n FROM c x WHERE x.seed_word = c.seed_word GROUP BY r)) AS by_round,
 (SELECT string_agg(s || ':' || n, ', ' ORDER BY s) FROM (SELECT s, CAST(sum(n) AS BIGINT) AS n FROM c x WHERE x.seed_word = c.seed_word GROUP BY s)) AS by_source FROM c GROUP BY seed_word""", "doc")
def a4(t: Tables) -> DataFrame:
    return stats.seed_expansion(t.doc)


@register("a5_seed_refresh", "SELECT s.seed_word, count(d.phrase_id) AS expansion_count, CAST(coalesce(sum(d.volume), 0) AS BIGINT) AS total_volume, CAST(coalesce(floor(avg(d.frequency)), 0) AS BIGINT) AS avg_frequency FROM (SELECT DISTINCT seed_word FROM doc) s LEFT JOIN (SELECT * FROM doc WHERE first_seen_round = 2) d USING (seed_word) GROUP BY 1", "doc")
def a5(t: Tables) -> DataFrame:
    return stats.seed_refresh(t.doc.select("seed_word").distinct(), t.doc.where("first_seen_round = 2"))


@register("a6_seed_statistics", "SELECT ty AS primary_token_type, count(seed_word) AS n FROM (SELECT unnest(['intent', 'action', 'object', 'other', 'none']) AS ty) LEFT JOIN (SELECT DISTINCT seed_word, CASE length(seed_word) % 4 WHEN 0 THEN 'intent' WHEN 1 THEN 'action' WHEN 2 THEN 'object' ELSE 'other' END AS pt FROM doc) ON ty = pt GROUP BY 1", "doc")
def a6(t: Tables) -> DataFrame:
    seeds = t.doc.select("seed_word").distinct().withColumn("primary_token_type", F.expr("element_at(array('intent', 'action', 'object', 'other'), length(seed_word) % 4 + 1)"))
    return stats.counts_with_zeros(seeds, "primary_token_type", ["intent", "action", "object", "other", "none"])


@register("a7_word_statistics", "SELECT count(*) AS n_words, CAST(sum(n) AS BIGINT) AS frequency, count(*) FILTER (length(seed_word) % 9 = 0) AS n_roots FROM (SELECT seed_word, count(*) AS n FROM doc GROUP BY 1)", "doc")
def a7(t: Tables) -> DataFrame:
    return t.doc.groupBy("seed_word").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_words"), F.sum("n").alias("frequency"), F.count_if(F.length("seed_word") % 9 == 0).alias("n_roots"))


@register("a8_product_statistics", "SELECT platform, ai_analysis_status, count(*) AS n FROM products GROUP BY GROUPING SETS ((platform), (ai_analysis_status), ())", "products")
def a8(t: Tables) -> DataFrame:
    return t.products.groupingSets([["platform"], ["ai_analysis_status"], []], "platform", "ai_analysis_status").agg(F.count("*").alias("n"))


@register("a9_community_statistics", "SELECT ai_analysis_status, count(*) AS n FROM communities GROUP BY 1", "communities")
def a9(t: Tables) -> DataFrame:
    return stats.counts_by(t.communities, "ai_analysis_status")


@register("a10_tag_statistics", "SELECT tag, count(*) AS n FROM (SELECT unnest([tag1, tag2, tag3]) AS tag FROM communities) WHERE tag IS NOT NULL GROUP BY 1", "communities")
def a10(t: Tables) -> DataFrame:
    return stats.tag_statistics(t.communities)


@register("a11_demand_sources", """, x AS (SELECT 'phase' AS kind, coalesce(source_phase, 'unknown') AS value, confidence_score FROM demands UNION ALL SELECT 'method', coalesce(source_method, 'unknown'), confidence_score FROM demands UNION ALL SELECT 'validated', CAST(is_validated AS VARCHAR), confidence_score FROM demands)
 SELECT kind, value, count(*) AS n, round(avg(confidence_score), 6) AS avg_confidence FROM x GROUP BY 1, 2""", "demands")
def a11(t: Tables) -> DataFrame:
    return stats.demand_sources(t.demands)


SUMMARY = "SELECT {label} AS cluster_id, count(*) AS size, CAST(sum(frequency) AS BIGINT) AS total_frequency, CAST(sum(volume) AS BIGINT) AS total_volume, array_to_string(list_slice(list(phrase ORDER BY frequency DESC, phrase_id), 1, 10), '; ') AS example_phrases FROM doc WHERE {label} <> -1 {more} GROUP BY 1"


@register("a12_cluster_summary", SUMMARY.format(label="cluster_id_A", more=""), "doc")
def a12(t: Tables) -> DataFrame:
    return stats.cluster_summary(t.doc, "cluster_id_A")


GOLDEN = f"count(*) AS cluster_size, CAST(sum(frequency) AS BIGINT) AS total_frequency, round(avg(frequency), 6) AS avg_frequency, array_to_string(list_sort(list_distinct(list(seed_word))), ', ') AS seed_words_in_cluster, CAST(sum(volume) AS BIGINT) AS total_search_volume, round(avg(volume), 6) AS avg_search_volume, round(avg(len(regexp_split_to_array(trim(phrase), '\\s+'))), 6) AS avg_word_count, round(avg(CASE WHEN regexp_split_to_array(phrase, '\\s+')[1] IN {Q} THEN 1 ELSE 0 END), 6) AS question_ratio"


@register("a13_golden_summary", f"SELECT cluster_id_A, {GOLDEN}, cluster_id_A = -1 AS noise_flag FROM doc GROUP BY 1", "doc")
def a13(t: Tables) -> DataFrame:
    return stats.golden_summary(t.doc, "cluster_id_A")


@register("a13_golden_sub_summary", f"SELECT seed_word, cluster_id_B, {GOLDEN}, cluster_id_B = -1 AS noise_flag FROM kw GROUP BY 1, 2", "kw")
def a13_b(t: Tables) -> DataFrame:
    return stats.golden_summary(t.kw, "seed_word", "cluster_id_B")


@register("a14_size_report", """, s AS (SELECT cluster_id_B AS c, count(*) AS n FROM doc GROUP BY 1), q AS (SELECT list_sort(list(n)) AS l FROM s WHERE c <> -1)
 SELECT count(*) FILTER (c <> -1) AS n_clusters, min(n) FILTER (c <> -1) AS min_size, max(n) FILTER (c <> -1) AS max_size, round(avg(n) FILTER (c <> -1), 6) AS mean_size, (SELECT l[CAST(floor(len(l) / 2) AS INT) + 1] FROM q) AS median_size,
 round(100.0 * coalesce(sum(n) FILTER (c = -1), 0) / sum(n), 6) AS noise_share FROM s""", "doc")
def a14(t: Tables) -> DataFrame:
    return stats.size_report(t.doc, "cluster_id_B")


@register("a15_parent_rollup", "SELECT CAST(floor(cluster_id / 10000) AS BIGINT) AS parent_id, count(*) AS n_children, CAST(sum(size) AS BIGINT) AS size FROM meta WHERE cluster_level = 'B' GROUP BY 1", "meta")
def a15(t: Tables) -> DataFrame:
    return stats.parent_rollup(t.meta)


@register("a16_missing_meta", f"SELECT *, 'restored' AS main_theme FROM ({SUMMARY.format(label='cluster_id_A', more='AND cluster_id_A % 3 <> 0')})", "doc")
def a16(t: Tables) -> DataFrame:
    have = t.doc.where("cluster_id_A % 3 = 0").select(F.col("cluster_id_A").alias("cluster_id"), F.lit("A").alias("cluster_level")).distinct()
    return stats.missing_meta(t.doc, have)


@register("a17_confidence_report", "SELECT demand_type, count(*) AS n, min(confidence_score) AS low, max(confidence_score) AS high, round(avg(confidence_score), 6) AS mean, round(median(confidence_score), 6) AS median, round(100.0 * count(*) / (SELECT count(*) FROM demands), 6) AS share FROM demands GROUP BY 1", "demands")
def a17(t: Tables) -> DataFrame:
    return stats.confidence_report(t.demands, "demand_type", "confidence_score")


@register("a18_selection_summary", """SELECT count(*) AS n_clusters, count(selection_score) AS n_scored, count(*) FILTER (is_selected) AS n_selected, CAST(sum(size) FILTER (is_selected) AS BIGINT) AS selected_phrases, CAST(sum(total_frequency) FILTER (is_selected) AS BIGINT) AS selected_frequency,
 round(sum(size) FILTER (is_selected) / count(*) FILTER (is_selected), 6) AS avg_selected_size, count(*) FILTER (selection_score = 1) AS score_1, count(*) FILTER (selection_score = 2) AS score_2, count(*) FILTER (selection_score = 3) AS score_3, count(*) FILTER (selection_score = 4) AS score_4, count(*) FILTER (selection_score = 5) AS score_5 FROM meta WHERE cluster_level = 'A'""", "meta")
def a18(t: Tables) -> DataFrame:
    return stats.selection_summary(t.meta)


@register("a19_demands_per_parent", "SELECT source_cluster_A, count(*) AS n FROM demands GROUP BY 1", "demands")
def a19(t: Tables) -> DataFrame:
    return t.demands.groupBy("source_cluster_A").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_cluster_A")


@register("a20_row_counts", "SELECT 'phrases' AS name, count(*) AS n FROM doc UNION ALL SELECT 'clusters_a', count(*) FROM meta WHERE cluster_level = 'A' UNION ALL SELECT 'clusters_b', count(*) FROM meta WHERE cluster_level = 'B' UNION ALL SELECT 'selected', count(*) FROM meta WHERE is_selected UNION ALL SELECT 'demands', count(*) FROM demands", "doc", "meta", "demands")
def a20(t: Tables) -> DataFrame:
    m = t.meta
    return stats.row_counts({"phrases": t.doc, "clusters_a": m.where("cluster_level = 'A'"), "clusters_b": m.where("cluster_level = 'B'"), "selected": m.where("is_selected"), "demands": t.demands})


@register("a21_demand_phrase_counts", "SELECT d.demand_id, count(l.product_id) AS n FROM demands d LEFT JOIN links l USING (demand_id) GROUP BY 1", "demands", "links")
def a21(t: Tables) -> DataFrame:
    return stats.with_counts(t.demands.select("demand_id"), t.links, "demand_id")


@register("a22_seed_phrase_counts", "SELECT s.seed_word, count(k.phrase_id) AS n FROM (SELECT DISTINCT seed_word FROM kw) s LEFT JOIN kw k USING (seed_word) GROUP BY 1", "kw")
def a22(t: Tables) -> DataFrame:
    return stats.with_counts(relate.distinct_seeds(t.kw), t.kw, "seed_word")


@register("a23_intent_counts", "SELECT intent_no, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM meta WHERE cluster_level = 'A'), 6) AS share FROM meta WHERE cluster_level = 'A' GROUP BY 1", "meta")
def a23(t: Tables) -> DataFrame:
    return relate.with_share(t.meta.where("cluster_level = 'A'").groupBy("intent_no").agg(F.count("*").alias("n")), "n")


@register("a24_score_sizes", "SELECT CASE WHEN quality_score >= 85 THEN '85+' WHEN quality_score >= 75 THEN '75+' WHEN quality_score >= 65 THEN '65+' WHEN quality_score >= 60 THEN '60+' ELSE '<60' END AS score_range, CASE WHEN size < 15 THEN 'small' WHEN size <= 150 THEN 'medium' ELSE 'large' END AS size_class, count(*) AS n, round(avg(quality_score), 6) AS mean_score FROM meta GROUP BY 1, 2", "meta")
def a24(t: Tables) -> DataFrame:
    return stats.score_sizes(t.meta)


@register("a25_review_time", "SELECT n, good, round(381.0 * good / n, 6) AS good_minutes, round(381.0 * least(20, n) / n, 6) AS top_minutes, round(100 * (1 - least(20, n) / n), 6) AS saving FROM (SELECT count(*) AS n, count(*) FILTER (quality_score >= 60) AS good FROM meta WHERE cluster_level = 'A')", "meta")
def a25(t: Tables) -> DataFrame:
    return stats.review_time(t.meta)


@register("a26_demand_status", "SELECT status, count(*) AS n FROM demands GROUP BY 1", "demands")
def a26(t: Tables) -> DataFrame:
    return stats.counts_by(t.demands, "status")
