"""Registered queries: functions on plain values over whole tables (X)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from .registry import Tables, register


@register("x1_string", """SELECT phrase_id, upper(trim(phrase)) AS up, array_to_string((regexp_split_to_array(trim(phrase), '\\s+'))[1:3], ' ') AS first, replace(phrase, 'e', 'é') AS replaced, CAST(length(phrase) AS INT) AS n,
 phrase[3:6] AS part, contains(phrase, 'tool') AS has, starts_with(phrase, 'best ') AS starts, phrase_id || ':' || seed_word AS joined FROM kw""", "kw")
def x1(t: Tables) -> DataFrame:
    p = F.col("phrase")
    return t.kw.select(
        "phrase_id", F.upper(F.trim(p)).alias("up"), V.first_words(p, 3).alias("first"), F.replace(p, F.lit("e"), F.lit("é")).alias("replaced"), F.length(p).alias("n"),
        F.substring(p, 3, 4).alias("part"), F.contains(p, F.lit("tool")).alias("has"), F.startswith(p, F.lit("best ")).alias("starts"), F.concat(F.col("phrase_id").cast("string"), F.lit(":"), "seed_word").alias("joined"),
    )


@register("x2_regex", """SELECT phrase_id, regexp_matches(phrase, '(?i)\\bHOW\\s+to\\b') AS asks, regexp_extract(phrase, '(\\w+) vs (.+)', 2) AS other, array_to_string(regexp_extract_all(phrase, '(?i)\\b[aeiou]\\w*'), ',') AS vowels,
 regexp_replace(phrase, '[aeiou]+', '*', 'g') AS masked, len(regexp_split_to_array(phrase, '[\\s-]+')) AS parts FROM kw""", "kw")
def x2(t: Tables) -> DataFrame:
    p = F.col("phrase")
    return t.kw.select(
        "phrase_id", p.rlike(r"(?i)\bHOW\s+to\b").alias("asks"), F.regexp_extract(p, r"(\w+) vs (.+)", 2).alias("other"), F.array_join(V.find_all(p, r"\b[aeiou]\w*"), ",").alias("vowels"),
        F.regexp_replace(p, "[aeiou]+", "*").alias("masked"), F.size(F.split(p, r"[\s-]+")).cast("long").alias("parts"),
    )


@register("x3_hash", "SELECT phrase_id, md5(phrase) AS digest, substr(md5(phrase), 1, 8) AS short FROM doc", "doc")
def x3(t: Tables) -> DataFrame:
    return t.doc.select("phrase_id", F.md5("phrase").alias("digest"), V.short_md5(F.col("phrase")).alias("short"))


@register("x4_math", """SELECT provenance_id, greatest(10.0, least(60.0, new_score)) AS clamped, CAST(trunc(new_score) AS BIGINT) AS whole, provenance_id // 7 AS sevenths, round(sqrt(abs(new_score)), 6) AS root, round(exp(-(new_score / 100) * (new_score / 100)), 6) AS weight,
 round(new_score * new_score, 4) AS square, CASE WHEN new_score <> 0 THEN round(1 / new_score, 6) END AS reciprocal FROM events_""", "events_")
def x4(t: Tables) -> DataFrame:
    s = F.col("new_score")
    return t.events.select(
        "provenance_id", V.clamp(s, 10.0, 60.0).alias("clamped"), s.cast("long").alias("whole"), F.expr("provenance_id div 7").alias("sevenths"), F.round(F.sqrt(F.abs(s)), 6).alias("root"),
        F.round(V.edge_weight(s / 100), 6).alias("weight"), F.round(s * s, 4).alias("square"), F.round(F.try_divide(F.lit(1.0), s), 6).alias("reciprocal"),
    )


@register("x5_time", """SELECT provenance_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS iso, 'batch_' || strftime(created_at, '%Y%m%d_%H%M%S') AS batch, CAST(floor((epoch_us(created_at) - epoch_us(first)) / 1000000) AS BIGINT) AS seconds
 FROM (SELECT *, min(created_at) OVER (PARTITION BY demand_id) AS first FROM events_)""", "events_")
def x5(t: Tables) -> DataFrame:
    first = t.events.groupBy("demand_id").agg(F.min("created_at").alias("first"))
    at = F.col("created_at")
    return t.events.join(first, "demand_id").select("provenance_id", V.iso_text(at).alias("iso"), V.batch_id(at).alias("batch"), V.elapsed_seconds(F.col("first"), at).alias("seconds"))


@register("x6_array", """, w AS (SELECT phrase_id, string_split(phrase, ' ') AS w FROM kw), d AS (SELECT *, list_filter(w, lambda x, i: list_position(w, x) = i) AS u FROM w)
 SELECT phrase_id, array_to_string(list_sort(w), ' ') AS sorted, array_to_string(u, ' ') AS distinct_, array_to_string(w[2:3], ' ') AS part, CAST(len(w) AS BIGINT) AS n, CAST(coalesce(list_position(w, 'tool'), 0) AS BIGINT) AS place,
 array_to_string(list_filter(u, lambda x: x IN ('best', 'tool', 'better')), ' ') AS common, CAST(len(list_distinct(list_concat(w, ['best', 'tool', 'better']))) AS BIGINT) AS united FROM d""", "kw")
def x6(t: Tables) -> DataFrame:
    w, some = F.split("phrase", " "), F.array(F.lit("best"), F.lit("tool"), F.lit("better"))
    join = lambda c: F.array_join(c, " ")
    return t.kw.select(
        "phrase_id", join(F.array_sort(w)).alias("sorted"), join(V.in_order(w)).alias("distinct_"), join(F.slice(w, 2, 2)).alias("part"), F.size(w).cast("long").alias("n"), F.array_position(w, "tool").alias("place"),
        join(F.array_intersect(w, some)).alias("common"), F.size(F.array_union(w, some)).cast("long").alias("united"),
    )


@register("x7_map", """, a AS (SELECT seed_word, count(*) FILTER (source_type = 'semrush') AS s, count(*) FILTER (source_type = 'dropdown') AS d, count(*) AS n FROM kw GROUP BY 1)
 SELECT seed_word, s + 1 AS semrush, d AS dropdown, CAST(-1 AS BIGINT) AS absent, CASE WHEN s + 1 >= d AND s + 1 >= n THEN CASE WHEN s + 1 = n AND d = n THEN 'all' WHEN s + 1 = n THEN 'all' WHEN s + 1 = d THEN 'dropdown' ELSE 'semrush' END WHEN n >= d THEN 'all' ELSE 'dropdown' END AS top FROM a""", "kw")
def x7(t: Tables) -> DataFrame:
    count = lambda s: F.count_if(F.col("source_type") == s)
    a = t.kw.groupBy("seed_word").agg(count("semrush").alias("s"), count("dropdown").alias("d"), F.count("*").alias("n"))
    m = V.merged(F.create_map(F.lit("semrush"), F.col("s"), F.lit("dropdown"), F.col("d"), F.lit("all"), F.col("n")), F.create_map(F.lit("semrush"), F.col("s") + 1))
    get = lambda k: V.get_or(F.col("m"), F.lit(k), F.lit(-1).cast("long"))
    return a.withColumn("m", m).select("seed_word", get("semrush").alias("semrush"), get("dropdown").alias("dropdown"), get("other").alias("absent"), V.keys_by_value(F.col("m"))[0].alias("top"))


@register("x8_json", """SELECT product_id, CASE WHEN product_id % 3 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(2 AS BIGINT) END AS n, product_id % 3 <> 0 AND product_id % 2 = 0 AS listed,
 CASE WHEN product_id % 3 = 0 THEN '[7]' WHEN product_id % 5 = 2 OR product_id % 2 = 7 THEN '[' || product_id % 2 || ',' || product_id % 5 || ',7]' ELSE '[' || product_id % 2 || ',' || product_id % 5 || ',7]' END AS appended, '{"name":"' || product_name || '","rating":' || product_id % 5 || '}' AS text FROM products""", "products")
def x8(t: Tables) -> DataFrame:
    p = F.col("product_id")
    text = F.when(p % 3 == 0, "no list").otherwise(F.concat(F.lit("["), (p % 2).cast("string"), F.lit(", "), (p % 5).cast("string"), F.lit("]")))
    d = t.products.withColumn("ids", text)
    items = V.json_list(F.col("ids"))
    return d.select("product_id", F.size(items).cast("long").alias("n"), (F.get(items, F.lit(0)) == 0).alias("listed_"), V.json_append(F.col("ids"), F.lit(7).cast("long")).alias("appended"), F.to_json(F.struct(F.col("product_name").alias("name"), (p % 5).alias("rating"))).alias("text")).withColumn("listed", F.coalesce("listed_", F.lit(False))).drop("listed_")


@register("x9_conditional", """SELECT subreddit_id, CASE WHEN description IS NULL OR description = '' THEN 'none' ELSE description END AS description, coalesce(tag2, tag3, tag1) AS tag, nullif(tag1, 'tag3') AS other,
 CASE ai_analysis_status WHEN 'pending' THEN 'waiting' WHEN 'completed' THEN 'done' ELSE 'check' END AS state, CASE WHEN subscribers IS NULL OR subscribers = 0 THEN CAST(-1 AS BIGINT) ELSE subscribers END AS subscribers FROM communities""", "communities")
def x9(t: Tables) -> DataFrame:
    status = F.col("ai_analysis_status")
    return t.communities.select(
        "subreddit_id", V.or_else(F.col("description"), F.lit("none")).alias("description"), F.coalesce("tag2", "tag3", "tag1").alias("tag"), F.nullif(F.col("tag1"), F.lit("tag3")).alias("other"),
        F.when(status == "pending", "waiting").when(status == "completed", "done").otherwise("check").alias("state"), V.or_else(F.col("subscribers"), F.lit(-1).cast("long"), "number").alias("subscribers"),
    )
