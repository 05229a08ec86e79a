"""Registered queries: scoring and intents (C, V26, U1, U4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import stash
from ..operators import cluster, intent, scoring
from .q_tokens import TYPES, _types, tk
from .registry import Tables, register

SIZE = "CASE WHEN size < 5 THEN 0.0 WHEN size < 15 THEN (size - 5) / 10.0::DOUBLE * 0.5 WHEN size <= 150 THEN 1.0 WHEN size <= 500 THEN greatest(0.3, 1 - (size - 150) / 350.0::DOUBLE * 0.7) ELSE 0.3 END"
CURVE = "CASE WHEN u < 0.3 THEN u / 0.3 * 0.5 WHEN u <= 0.7 THEN 0.5 + (u - 0.3) / 0.4 * 0.5 ELSE greatest(0.7, 1 - (u - 0.7) * 0.5) END"
UNIQUE = "un AS (SELECT {key}, CAST(count(DISTINCT w) AS DOUBLE) / count(*) AS u FROM (SELECT {key}, unnest(list_filter(regexp_split_to_array(lower(phrase), '\\s+'), lambda x: x <> '')) AS w FROM {t}) GROUP BY 1)"


def _intent_sql(table: str) -> str:
    scores = []
    for name, (w, words, pre, end) in intent.INTENTS.items():
        terms = [f"CASE WHEN regexp_matches(p, '{r}') THEN {v}::DOUBLE ELSE 0.0 END" for rs, v in ((words, w), (pre, w * intent.PREFIX), (end, w * intent.ENDING)) for r in rs]
        scores.append(f"({' + '.join(terms)}) AS {name}")
    best = " ".join(f"WHEN {n} = top THEN '{n}'" for n in intent.INTENTS)
    return f"""sc0 AS (SELECT *, lower(phrase) AS p FROM {table}), sc AS (SELECT *, {', '.join(scores)} FROM sc0), tp AS (SELECT *, greatest({', '.join(intent.INTENTS)}) AS top, {' + '.join(intent.INTENTS)} AS total FROM sc),
 ci AS (SELECT *, CASE WHEN total = 0 THEN 'other' {best} END AS primary_intent, round(CASE WHEN total = 0 THEN 1.0 ELSE top / total END, 6) AS confidence FROM tp)"""


def _substring_sql() -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(phrase), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in intent.SUBSTRINGS.items()) + " ELSE 'other' END"


@register("c1_size_score", f"SELECT cluster_id, cluster_level, round({SIZE}, 6) AS size_score FROM meta", "meta")
def c1(t: Tables) -> DataFrame:
    return t.meta.select("cluster_id", "cluster_level", F.round(scoring.size_score(F.col("size")), 6).alias("size_score"))


@register("c2_diversity", f", {UNIQUE.format(key='cluster_id_B', t='kw')} SELECT cluster_id_B, round(u, 6) AS unique_ratio, round({CURVE}, 6) AS diversity FROM un", "kw")
def c2(t: Tables) -> DataFrame:
    return scoring.diversity(t.kw, "cluster_id_B").select("cluster_id_B", F.round("unique_ratio", 6).alias("unique_ratio"), F.round("diversity", 6).alias("diversity"))


@register("c3_consistency")
def c3(t: Tables) -> DataFrame:
    return scoring.consistency(t.kw, "cluster_id_B")


@register("c4_cluster_quality", f""", {UNIQUE.format(key='cluster_id_B', t='kw')}, sz AS (SELECT cluster_id_B, count(*) AS size FROM kw GROUP BY 1), q AS (SELECT cluster_id_B, round(100 * (0.4 * {SIZE} + 0.3 * {CURVE} + 0.3 * 0.5), 2) AS score FROM sz JOIN un USING (cluster_id_B))
 SELECT cluster_id_B, CAST(trunc(score) AS INT) AS quality_score, CASE WHEN score >= 75 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'poor' END AS quality_level FROM q""", "kw")
def c4(t: Tables) -> DataFrame:
    n = t.kw.groupBy("cluster_id_B").agg(F.count("*").alias("size")).join(scoring.diversity(t.kw, "cluster_id_B"), "cluster_id_B")
    q = scoring.quality(F.col("size"), F.col("diversity"), F.lit(0.5))
    return n.select("cluster_id_B", q.cast("int").alias("quality_score"), scoring.quality_level(q).alias("quality_level"))


@register("u4_score_clusters")
def u4(t: Tables) -> DataFrame:
    return scoring.score_clusters(t.kw, "cluster_id_A")


@register("c5_pick_clusters", f""", f AS (SELECT * FROM kw QUALIFY row_number() OVER (PARTITION BY cluster_id_B ORDER BY phrase_id) <= 50), {UNIQUE.format(key='cluster_id_B', t='f')}, sz AS (SELECT cluster_id_B, count(*) AS size FROM kw GROUP BY 1),
 s AS (SELECT cluster_id_B, size, round(0.6 * CASE WHEN size < 15 THEN size / 15.0::DOUBLE * 0.5 WHEN size <= 150 THEN 1.0 ELSE greatest(0.3, 1 - (size - 150) / 500.0::DOUBLE) END + 0.4 * u, 6) AS score FROM sz JOIN un USING (cluster_id_B))
 SELECT * FROM s QUALIFY row_number() OVER (ORDER BY score DESC, cluster_id_B) <= least(12, greatest(10, (SELECT count(*) FROM s) // 8))""", "kw")
def c5(t: Tables) -> DataFrame:
    return scoring.pick_clusters(t.kw, "cluster_id_B")


@register("c6_phrase_intent", f", {_intent_sql('kw')} SELECT phrase_id, primary_intent, confidence FROM ci", "kw")
def c6(t: Tables) -> DataFrame:
    return intent.classify(t.kw).select("phrase_id", "primary_intent", F.round("confidence", 6).alias("confidence"))


@register("c6_phrase_intent_doc", f", {_intent_sql('doc')} SELECT primary_intent, count(*) AS n, round(sum(confidence), 3) AS confidence FROM ci GROUP BY 1", "doc")
def c6_doc(t: Tables) -> DataFrame:
    return intent.classify(t.doc).groupBy("primary_intent").agg(F.count("*").alias("n"), F.round(F.sum(F.round("confidence", 6)), 3).alias("confidence"))


@register("c7_cluster_intent", f""", {_intent_sql('(SELECT * FROM kw QUALIFY row_number() OVER (PARTITION BY cluster_id_A ORDER BY phrase_id) <= 50)')}, n AS (SELECT cluster_id_A, primary_intent, count(*) AS n, list_position(['find_tool', 'learn_how', 'solve_problem', 'find_free', 'compare', 'other'], primary_intent) AS o FROM ci GROUP BY ALL)
 SELECT cluster_id_A, arg_max(primary_intent, n * 10 - o) AS dominant_intent, CAST(trunc(max(n) / CAST(sum(n) AS DOUBLE) * 100) AS INT) AS dominant_intent_confidence, max(n) / CAST(sum(n) AS DOUBLE) < 0.6 AS is_intent_balanced FROM n GROUP BY 1""", "kw")
def c7(t: Tables) -> DataFrame:
    return intent.cluster_intent(t.kw, "cluster_id_A").drop("intent_distribution")


@register("c8_intent_labels", f", {_intent_sql('kw')} SELECT phrase_id, CASE primary_intent " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in intent.LABELS.items()) + " END AS intent_label FROM ci", "kw")
def c8(t: Tables) -> DataFrame:
    return intent.with_labels(intent.classify(t.kw), "primary_intent").select("phrase_id", "intent_label")


@register("c9_substring_intent", f"SELECT phrase_id, {_substring_sql()} AS intent FROM doc", "doc")
def c9(t: Tables) -> DataFrame:
    return t.doc.select("phrase_id", intent.substring_intent(F.col("phrase")).alias("intent"))


@register("c10_intent_distribution", f", c AS (SELECT {_substring_sql()} AS intent, count(*) AS n FROM kw GROUP BY 1) SELECT x.intent, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT CAST(count(*) AS DOUBLE) FROM kw), 6) AS share FROM (SELECT unnest(['find_tool', 'find_free', 'learn_how', 'solve_problem', 'compare', 'other']) AS intent) x LEFT JOIN c USING (intent)", "kw")
def c10(t: Tables) -> DataFrame:
    return intent.distribution(t.kw).drop("verdict")


@register("c11_token_coverage", f", {tk('kw')}, {TYPES} SELECT phrase_id, EXISTS (SELECT 1 FROM ty WHERE contains(doc.phrase, token)) AS covered FROM doc", "kw", "doc")
def c11(t: Tables) -> DataFrame:
    return scoring.coverage(t.doc, _types(t)).select("phrase_id", "covered")


@register("c11_token_usage", f", {tk('kw')}, {TYPES} SELECT token, count(*) AS n_phrases FROM ty JOIN doc ON contains(phrase, token) GROUP BY 1", "kw", "doc")
def c11_usage(t: Tables) -> DataFrame:
    return scoring.token_usage(t.doc, _types(t))


@register("c11_uncovered_words", f", {tk('kw')}, {TYPES} SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(phrase), '\\s+')) AS word FROM doc WHERE NOT EXISTS (SELECT 1 FROM ty WHERE contains(doc.phrase, token))) WHERE length(word) > 2 AND word NOT IN ({', '.join(repr(w) for w in scoring.BASIC_STOP_WORDS)}) GROUP BY 1 ORDER BY n DESC, word LIMIT 50", "kw", "doc")
def c11_words(t: Tables) -> DataFrame:
    return scoring.uncovered_words(scoring.coverage(t.doc, _types(t)))


@register("c12_redundancy")
def c12(t: Tables) -> DataFrame:
    s = stash(scoring.hash_sample(t.doc.where("length(phrase) > 10").select("phrase_id", "phrase"), 1000), "sample")
    return scoring.redundancy(cluster.greedy_groups(s, scoring.similar_pairs(s, 0.85)), 1000)


@register("c13_recommendations", "SELECT demand_id AS experiment, status AS verdict, 'low' AS priority FROM demands WHERE status <> 'archived' UNION ALL SELECT demand_id, 'too low', 'high' FROM demands WHERE status = 'archived'", "demands")
def c13(t: Tables) -> DataFrame:
    v = t.demands.select(F.col("demand_id").alias("experiment"), F.when(F.col("status") == "archived", "too low").otherwise(F.col("status")).alias("verdict"))
    return scoring.recommendations(v)


@register("c14_import_selection", "SELECT cluster_id, CAST(1 + cluster_id % 7 AS INT) AS selection_score, 1 + cluster_id % 7 >= 4 AS is_selected FROM meta WHERE cluster_level = 'A' AND 1 + cluster_id % 7 <= 5 AND cluster_id % 4 <> 0", "meta")
def c14(t: Tables) -> DataFrame:
    score = F.when(F.col("cluster_id") % 4 == 0, "x").otherwise((1 + F.col("cluster_id") % 7).cast("string"))
    return scoring.import_selection(t.meta.where("cluster_level = 'A'").select("cluster_id", score.alias("selection_score")), t.meta)


@register("c15_cluster_framework", f", {tk('kw')}, {TYPES} SELECT * FROM (SELECT cluster_id_A, token_type, token, count(*) AS n FROM (SELECT cluster_id_A, unnest(tk.w) AS token FROM kw JOIN tk USING (phrase_id)) JOIN ty USING (token) GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY cluster_id_A, token_type ORDER BY n DESC, token) <= 10", "kw")
def c15(t: Tables) -> DataFrame:
    return scoring.cluster_framework(t.kw, _types(t).select("token", "token_type"), "cluster_id_A")


@register("v26_similarity")
def v26(t: Tables) -> DataFrame:
    p = t.kw.withColumn("before", F.lag("phrase").over(Window.partitionBy("seed_word").orderBy("phrase_id"))).where("before is not null")
    return p.select("phrase_id", F.round(scoring.similarity(F.col("phrase"), F.col("before")), 6).alias("similarity"))


@register("u1_sequence_ratio")
def u1(t: Tables) -> DataFrame:
    return t.kw.select("phrase_id", scoring.sequence_ratio(F.col("phrase"), F.col("seed_word")).alias("ratio"))
