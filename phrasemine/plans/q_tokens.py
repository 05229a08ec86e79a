"""Registered queries: tokens and n-grams (T, U3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import clean, tokens
from .registry import Tables, register


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


#: Tokens of T3 of a table: (phrase_id, phrase, seed_word, w list).
TOKENS = """tk AS (SELECT phrase_id, phrase, seed_word, list_filter(flatten(list_transform(string_split(trim(regexp_replace(regexp_replace(lower(phrase), '[^\\w\\s\\x{{80}}-\\x{{10FFFF}}-]', '', 'g'), '\\s+', ' ', 'g')), ' '),
  lambda w: CASE WHEN contains(w, '-') THEN list_concat([w], string_split(w, '-')) ELSE [w] END)),
  lambda w: length(w) BETWEEN 2 AND 30 AND w NOT IN {stop} AND NOT regexp_full_match(w, '\\d+') AND regexp_matches(w, '\\pL')) AS w FROM {table})"""
SEG = "sg AS (SELECT phrase_id, phrase, seed_word, first_seen_round, list_filter(regexp_split_to_array(lower(phrase), '[\\s\\-_]+'), lambda w: length(w) >= 2 AND regexp_full_match(w, '[a-z]+') AND w NOT IN {stop}) AS w FROM {table})"
RAW = "rw AS (SELECT phrase_id, list_filter(regexp_split_to_array(lower(phrase), '\\s+'), lambda x: x <> '') AS w FROM {table})"


def tk(table: str) -> str:
    return TOKENS.format(stop=_in(X.TOKEN_STOP_WORDS), table=table)


def sg(table: str) -> str:
    return SEG.format(stop=_in(X.SEGMENT_STOP_WORDS), table=table)


def grams(source: str, low: int, high: int, extra: str = "") -> str:
    """A common table g(n, gram, pos) of the n-grams of source.w."""
    return (
        f"g AS (SELECT {extra} n, array_to_string(w[i + 1 : i + n], ' ') AS gram, i AS pos FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS i FROM (SELECT *, unnest(range({low}, {high + 1})) AS n FROM {source}) WHERE len(w) >= n))"
    )


@register("t1_clean_token", "SELECT page_id, trim(regexp_replace(regexp_replace(lower(url), '[^\\w\\s-]', '', 'g'), '\\s+', ' ', 'g')) AS token FROM pages")
def t1(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", X.clean_token(F.col("url")).alias("token"))


@register("t2_valid_tokens", f"SELECT seed_word, count(*) AS n FROM kw WHERE length(seed_word) BETWEEN 2 AND 30 AND seed_word NOT IN {_in(X.TOKEN_STOP_WORDS)} AND regexp_matches(seed_word, '[a-z]') GROUP BY 1", "kw")
def t2(t: Tables) -> DataFrame:
    return t.kw.where(X.is_valid_token(F.col("seed_word"))).groupBy("seed_word").agg(F.count("*").alias("n"))


@register("t3_tokenise", f", {tk('kw')} SELECT phrase_id, array_to_string(w, '|') AS tokens FROM tk", "kw")
def t3(t: Tables) -> DataFrame:
    return t.kw.select("phrase_id", F.array_join(X.tokens(F.col("phrase")), "|").alias("tokens"))


@register("t4_token_frequency", f", {tk('kw')} SELECT token, count(*) AS frequency FROM (SELECT unnest(w) AS token FROM tk) GROUP BY 1 HAVING count(*) >= 8", "kw")
def t4(t: Tables) -> DataFrame:
    return tokens.token_frequency(t.kw)


@register("t5_suggest_threshold", f""", {tk('kw')}, c AS (SELECT token, count(*) AS f FROM (SELECT unnest(w) AS token FROM tk) GROUP BY 1),
 p AS (SELECT CAST(t AS INT) AS threshold, (SELECT count(*) FROM c WHERE f >= t) AS n_tokens FROM (SELECT unnest([3, 5, 8, 10, 15, 20, 30, 50]) AS t))
 SELECT threshold, n_tokens, CAST(coalesce((SELECT min(threshold) FROM p WHERE n_tokens <= 40), 8) AS INT) AS suggested FROM p""", "kw")
def t5(t: Tables) -> DataFrame:
    return tokens.suggest_threshold(tokens.token_frequency(t.kw, 1), 40)


@register("t6_bigrams", f", {tk('kw')}, {grams('tk', 2, 2)} SELECT gram, count(*) AS frequency FROM g GROUP BY 1 HAVING count(*) >= 3", "kw")
def t6(t: Tables) -> DataFrame:
    return tokens.bigrams(t.kw)


@register("t7_prioritised_ngrams", f""", {tk('kw')}, {grams('tk', 1, 4)}, c AS (SELECT CAST(n AS INT) AS n, gram, count(*) AS frequency FROM g GROUP BY ALL), k AS (SELECT *, 1 AS priority FROM c WHERE n >= 2 AND frequency >= 5 * (1 + (n - 2) * 0.5))
 SELECT * FROM k UNION ALL SELECT n, gram, frequency, 2 FROM c WHERE n = 1 AND frequency >= CASE WHEN gram IN (SELECT unnest(string_split(gram, ' ')) FROM k) THEN 10 ELSE 5 END""", "kw")
def t7(t: Tables) -> DataFrame:
    return tokens.prioritised_ngrams(t.kw).select("n", "gram", "frequency", "priority")


def _types(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("intent", "action", "object", "other")]), F.pmod(F.length("token"), F.lit(4)) + 1)
    return tokens.token_frequency(t.kw, 20).select("token", "frequency", kind.alias("token_type"))


TYPES = "ty AS (SELECT token, count(*) AS frequency, CASE length(token) % 4 WHEN 0 THEN 'intent' WHEN 1 THEN 'action' WHEN 2 THEN 'object' ELSE 'other' END AS token_type FROM (SELECT unnest(w) AS token FROM tk) GROUP BY 1 HAVING count(*) >= 20)"


@register("t8_demand_patterns", f""", {tk('kw')}, {TYPES}, x AS (SELECT phrase_id, phrase, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM tk),
 p AS (SELECT k.phrase_id, k.phrase, coalesce(string_agg('[' || coalesce(token_type, 'other') || ']', ' ' ORDER BY pos) FILTER (x.token IS NOT NULL), '') AS pattern FROM tk k LEFT JOIN x ON k.phrase_id = x.phrase_id LEFT JOIN ty ON x.token = ty.token GROUP BY 1, 2)
 SELECT pattern, count(*) AS n_phrases, array_to_string(list_slice(list(phrase ORDER BY phrase_id), 1, 3), '|') AS examples FROM p GROUP BY 1 HAVING count(*) >= 5""", "kw")
def t8(t: Tables) -> DataFrame:
    return tokens.demand_patterns(t.kw, _types(t).select("token", "token_type")).withColumn("examples", F.array_join("examples", "|"))


@register("t9_framework", f", {tk('kw')}, {TYPES} SELECT token_type, count(*) AS n_tokens, CAST(sum(frequency) AS BIGINT) AS total_frequency, array_to_string(list_slice(list(token ORDER BY frequency DESC, token), 1, 10), '|') AS top_tokens FROM ty GROUP BY 1", "kw")
def t9(t: Tables) -> DataFrame:
    return tokens.framework(_types(t)).withColumn("top_tokens", F.array_join("top_tokens", "|"))


@register("f17_token_list", f", {tk('kw')}, {TYPES} SELECT token, token_type, frequency FROM ty WHERE token_type IN ('object', 'action') AND frequency >= 50", "kw")
def f17(t: Tables) -> DataFrame:
    return clean.search(clean.where_equal(_types(t), {"token_type": ["object", "action"]}), F.col("frequency") >= 50).orderBy(F.desc("frequency"), "token").select("token", "token_type", "frequency")


@register("t10_prefix_groups", f", {tk('kw')}, c AS (SELECT token, count(*) AS f FROM (SELECT unnest(w) AS token FROM tk) GROUP BY 1) SELECT token[1:3] AS prefix, count(*) AS n_tokens, CAST(sum(f) AS BIGINT) AS frequency FROM c GROUP BY 1 ORDER BY n_tokens DESC, prefix LIMIT 100", "kw")
def t10(t: Tables) -> DataFrame:
    return tokens.prefix_groups(tokens.token_frequency(t.kw, 1))


@register("t11_segment", f", {sg('doc')} SELECT word, count(*) AS frequency FROM (SELECT unnest(w) AS word FROM sg) GROUP BY 1", "doc")
def t11(t: Tables) -> DataFrame:
    return tokens.segment(t.doc)


UNIFIED = "un AS (SELECT gram AS word, CAST(n AS INT) AS word_count, count(*) AS frequency, array_to_string(list_sort(list_distinct(list(seed_word))), ',') AS seeds FROM g GROUP BY 1, 2 HAVING count(*) >= 2)"


@register("t12_segment_unified", f", {sg('kw')}, {grams('sg', 1, 6, 'seed_word, ')}, {UNIFIED} SELECT * FROM un", "kw")
def t12(t: Tables) -> DataFrame:
    return tokens.segment_unified(t.kw).withColumn("seeds", F.array_join("seeds", ","))


@register("token_frequency", f", {sg('doc')}, {grams('sg', 1, 1, 'seed_word, ')} SELECT gram AS word, count(*) AS frequency, count(DISTINCT seed_word) AS n_seeds FROM g GROUP BY 1 HAVING count(*) >= 2 ORDER BY frequency DESC, word LIMIT 200", "doc")
def flagship(t: Tables) -> DataFrame:
    w = tokens.segment_unified(t.doc, least=2, most=1)
    return w.select("word", "frequency", F.size("seeds").cast("long").alias("n_seeds")).orderBy(F.desc("frequency"), "word").limit(200)


@register("t13_split_by_count", f", {sg('kw')}, {grams('sg', 1, 6, 'seed_word, ')}, {UNIFIED} SELECT word, frequency, word_count > 1 AS is_ngram FROM un", "kw")
def t13(t: Tables) -> DataFrame:
    u = tokens.segment_unified(t.kw)
    return u.where("word_count = 1").select("word", "frequency", F.lit(False).alias("is_ngram")).union(u.where("word_count > 1").select("word", "frequency", F.lit(True)))


@register("t14_merge_counts", f", {sg('kw')}, {grams('sg', 1, 6, 'seed_word, first_seen_round, ')}, a AS (SELECT gram, n, seed_word, first_seen_round <= 2 AS early, count(*) OVER (PARTITION BY gram, n, first_seen_round <= 2) AS c FROM g) SELECT gram AS word, CAST(n AS INT) AS word_count, count(*) AS frequency, array_to_string(list_sort(list_distinct(list(seed_word))), ',') AS seeds FROM a WHERE c >= 2 GROUP BY 1, 2", "kw")
def t14(t: Tables) -> DataFrame:
    a, b = (tokens.segment_unified(t.kw.where(c)) for c in ("first_seen_round <= 2", "first_seen_round > 2"))
    return tokens.merge_counts(a, b).withColumn("seeds", F.array_join("seeds", ","))


@register("t15_segment_rounds", f", {sg('kw')}, {grams('sg', 1, 6, 'seed_word, first_seen_round, ')}, a AS (SELECT gram, n, first_seen_round = 4 AS late, count(*) AS c FROM g WHERE first_seen_round IN (1, 4) GROUP BY ALL HAVING count(*) >= 2) SELECT gram AS word, CAST(sum(c) AS BIGINT) AS frequency FROM a GROUP BY gram, n", "kw")
def t15(t: Tables) -> DataFrame:
    return tokens.segment_rounds(t.kw, [4], tokens.segment_unified(t.kw.where("first_seen_round = 1"))).select("word", "frequency")


@register("t16_resegment", f""", {sg('kw')}, {grams('sg', 1, 6, 'first_seen_round, ')}, n AS (SELECT gram, n, count(*) AS f FROM g WHERE first_seen_round >= 2 GROUP BY ALL HAVING count(*) >= 2), o AS (SELECT gram, n, count(*) AS f FROM g WHERE first_seen_round <= 2 GROUP BY ALL HAVING count(*) >= 2)
 SELECT coalesce(n.gram, o.gram) AS word, coalesce(n.f, o.f) AS frequency, CASE WHEN o.f IS NULL THEN 'new' WHEN n.f IS NULL THEN 'gone' ELSE 'kept' END AS status FROM n FULL JOIN o ON n.gram = o.gram""", "kw")
def t16(t: Tables) -> DataFrame:
    stored = tokens.segment_unified(t.kw.where("first_seen_round <= 2")).withColumn("pos_category", F.lit("Noun"))
    return tokens.resegment(t.kw.where("first_seen_round >= 2"), stored).select("word", "frequency", "status")


@register("t17_sorted_words", f", {sg('doc')} SELECT word, count(*) AS frequency FROM (SELECT unnest(w) AS word FROM sg) GROUP BY 1 HAVING count(*) >= 5 ORDER BY length(word) DESC, word LIMIT 100", "doc")
def t17(t: Tables) -> DataFrame:
    return tokens.segment(t.doc).where("frequency >= 5").orderBy(F.length("word").desc(), "word").limit(100)


@register("t18_word_combinations", f", {RAW.format(table='kw')}, {grams('rw', 2, 3)} SELECT gram, count(*) AS frequency FROM g GROUP BY 1", "kw")
def t18(t: Tables) -> DataFrame:
    return tokens.raw_ngrams(t.kw, 2, 3).select("gram", "frequency")


@register("t19_word_statistics", f", {sg('doc')}, c AS (SELECT word, count(*) AS f FROM (SELECT unnest(w) AS word FROM sg) GROUP BY 1) SELECT count(*) AS unique_words, CAST(sum(f) AS BIGINT) AS total, round(avg(f), 2) AS mean FROM c", "doc")
def t19(t: Tables) -> DataFrame:
    return tokens.word_statistics(tokens.segment(t.doc))


@register("t20_raw_ngrams", f", {RAW.format(table='kw')}, {grams('rw', 2, 4)} SELECT CAST(n AS INT) AS n, gram, count(*) AS frequency FROM g GROUP BY n, gram HAVING count(*) >= CASE WHEN n < 4 THEN 5 ELSE 4 END", "kw")
def t20(t: Tables) -> DataFrame:
    return tokens.raw_ngrams(t.kw, 2, 4).where("frequency >= if(n < 4, 5, 4)")


@register("t21_word_count", "SELECT phrase_id, len(regexp_split_to_array(trim(phrase), '\\s+')) AS word_count FROM doc", "doc")
def t21(t: Tables) -> DataFrame:
    return t.doc.select("phrase_id", F.size(F.split(F.trim("phrase"), r"\s+")).cast("long").alias("word_count"))


@register("t22_stop_words", f", {sg('kw')} SELECT DISTINCT word FROM (SELECT unnest(w) AS word FROM sg UNION ALL SELECT seed_word FROM kw) WHERE word NOT IN (SELECT trim(lower(phrase[1:4])) FROM kw)", "kw")
def t22(t: Tables) -> DataFrame:
    words = tokens.segment(t.kw).select("word")
    return tokens.maintain_stop_words(words, t.kw.select(F.col("seed_word").alias("word")), t.kw.select(F.substring("phrase", 1, 4).alias("word")))


@register("t23_pos_rollup", f", {sg('kw')}, c AS (SELECT word, count(*) AS f, CASE length(word) % 4 WHEN 0 THEN 'NN' WHEN 1 THEN 'VB' WHEN 2 THEN 'JJ' ELSE 'XX' END AS tag FROM (SELECT unnest(w) AS word FROM sg) GROUP BY 1) SELECT CASE tag WHEN 'NN' THEN 'Noun' WHEN 'VB' THEN 'Verb' WHEN 'JJ' THEN 'Adjective' ELSE 'Other' END AS pos_category, count(*) AS n_words, CAST(sum(f) AS BIGINT) AS frequency FROM c GROUP BY 1", "kw")
def t23(t: Tables) -> DataFrame:
    tag = F.element_at(F.array(*[F.lit(x) for x in ("NN", "VB", "JJ", "XX")]), F.pmod(F.length("word"), F.lit(4)) + 1)
    cats = t.spark.createDataFrame([("NN", "Noun"), ("NNS", "Noun"), ("VB", "Verb"), ("VBD", "Verb"), ("JJ", "Adjective"), ("JJR", "Adjective")], "pos_tag string, pos_category string")
    return tokens.pos_rollup(tokens.segment(t.kw).withColumn("pos_tag", tag), cats)


@register("t24_attach", f", {sg('doc')}, c AS (SELECT word, count(*) AS frequency FROM (SELECT unnest(w) AS word FROM sg) GROUP BY 1) SELECT word, frequency, CASE WHEN word IN (SELECT seed_word FROM doc) THEN 'seed' END AS note FROM c", "doc")
def t24(t: Tables) -> DataFrame:
    notes = t.doc.select(F.col("seed_word").alias("word")).distinct().withColumn("note", F.lit("seed"))
    return tokens.attach(tokens.segment(t.doc), notes)


@register("u3_ngram_rows", f", {RAW.format(table='kw')}, {grams('rw', 1, 2, 'phrase_id, ')} SELECT phrase_id, CAST(n AS INT) AS n, gram, CAST(pos AS INT) AS pos FROM g", "kw")
def u3(t: Tables) -> DataFrame:
    w = t.kw.select("phrase_id", F.filter(F.split(F.lower("phrase"), r"\s+"), lambda x: x != "").alias("w"))
    return w.select("phrase_id", F.inline(X.ngrams("w", 1, 2)))
