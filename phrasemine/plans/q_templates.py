"""Registered queries: templates, variables and product entities (M, U2, J12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relate, templates
from .q_tokens import RAW, grams
from .registry import Tables, register

G = f"{RAW.format(table='kw')}, {grams('rw', 3, 4)}"
ANCHORS = f"{G}, an AS (SELECT gram AS anchor, count(*) AS frequency, n FROM g GROUP BY gram, n HAVING count(*) >= 10 ORDER BY frequency DESC, n, gram LIMIT 100)"
MATCHES = f"{ANCHORS}, mt AS (SELECT anchor, phrase_id, phrase, volume FROM kw JOIN an ON contains(phrase, anchor))"
PATTERNS = f"""{MATCHES}, lc0 AS (SELECT anchor, phrase_id, string_split(phrase, ' ') AS w, string_split(anchor, ' ') AS a FROM (SELECT * FROM mt QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY phrase_id) <= 20)),
 lc1 AS (SELECT *, list_position(list_transform(range(0, len(w) - len(a) + 1), lambda i: w[i + 1 : i + len(a)] = a), true) - 1 AS start FROM lc0 WHERE len(w) >= len(a)),
 lc AS (SELECT anchor, phrase_id, start, nullif(array_to_string(w[1 : start], ' '), '') AS prefix, nullif(array_to_string(w[start + len(a) + 1 : len(w)], ' '), '') AS suffix FROM lc1 WHERE start >= 0),
 st AS (SELECT anchor, start FROM lc GROUP BY anchor, start QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY count(*) DESC, min(phrase_id)) = 1),
 en AS (SELECT anchor, count(DISTINCT prefix) AS np, min(prefix) AS prefix, count(DISTINCT suffix) AS ns, min(suffix) AS suffix FROM lc GROUP BY 1),
 pt0 AS (SELECT anchor, CASE WHEN start = 0 THEN anchor || ' ' || CASE WHEN ns = 1 THEN suffix ELSE '{{X}}' END WHEN np = 1 THEN concat_ws(' ', prefix, anchor, CASE WHEN ns <> 1 THEN '{{X}}' END)
   ELSE concat_ws(' ', '{{X}}', anchor, CASE WHEN ns = 1 THEN suffix WHEN ns > 1 THEN '{{Y}}' END) END AS p FROM st JOIN en USING (anchor)),
 pt AS (SELECT anchor, CASE WHEN regexp_matches(p, '\\{{[XY]\\}}') THEN p END AS template_pattern FROM pt0)""".replace("{{", "{").replace("}}", "}")
QUALITY = f"{PATTERNS}, tp0 AS (SELECT anchor, template_pattern, count(*) AS match_count FROM mt JOIN pt USING (anchor) GROUP BY ALL HAVING template_pattern IS NOT NULL), tp AS (SELECT * FROM tp0 WHERE match_count >= (SELECT quantile_cont(match_count, 0.75) FROM tp0))"
APPLIED = rf"""{QUALITY}, rx AS (SELECT *, '^(?s:.*?)' AS lead, regexp_extract_all(template_pattern, '\{{([XYZ])\}}', 1) AS slots,
   regexp_replace(regexp_replace(regexp_replace('(?:' || template_pattern || ')', '\{{[XYZ]\}}\)$', '(.+))'), CASE WHEN len(regexp_extract_all(template_pattern, '\{{([XYZ])\}}')) > 1 THEN '\{{[XYZ]\}}' ELSE '\{{([XYZ])\}}' END, CASE WHEN template_pattern LIKE '%}}' THEN '(.+?)' ELSE '(.+)' END), '\{{[XYZ]\}}', '(.+)') AS re FROM tp),
 ap AS (SELECT template_pattern, anchor, phrase_id, phrase, volume, slots, trim(regexp_extract(phrase, re, 1)) AS v1, CASE WHEN len(slots) >= 2 THEN trim(regexp_extract(phrase, re, 2)) END AS v2, re FROM kw JOIN rx ON contains(phrase, anchor) AND regexp_matches(phrase, re))""".replace("{{", "{").replace("}}", "}")
SPANS = APPLIED + r""", s0 AS (SELECT phrase_id, template_pattern, phrase, slots, regexp_split_to_array(template_pattern, '\{[XYZ]\}') AS fx, regexp_extract(phrase, re, 0) AS hit, regexp_extract(phrase, re, 1) AS g1, CASE WHEN len(slots) >= 2 THEN regexp_extract(phrase, re, 2) ELSE '' END AS g2 FROM ap),
 sp AS (SELECT *, strpos(phrase, hit) - 1 AS st, strpos(phrase, hit) - 1 + length(fx[1]) AS s1, strpos(phrase, hit) - 1 + length(fx[1]) + length(g1) AS e1, strpos(phrase, hit) - 1 + length(fx[1]) + length(g1) + length(fx[2]) AS s2 FROM s0)"""
VARS = f"{APPLIED}, va AS (SELECT lower(v) AS variable_text, count(*) AS frequency, count(DISTINCT anchor) AS template_match_count, CAST(sum(volume) AS BIGINT) AS total_volume, count(*) * count(DISTINCT anchor) AS cross_validation_score FROM (SELECT anchor, volume, v1 AS v FROM ap UNION ALL SELECT anchor, volume, v2 FROM ap WHERE v2 IS NOT NULL) WHERE length(v) >= 2 GROUP BY 1)"


@register("m1_anchors", f", {ANCHORS} SELECT anchor, frequency FROM an", "kw")
def m1(t: Tables) -> DataFrame:
    return templates.anchors(t.kw)


@register("m2_anchor_matches", f", {MATCHES} SELECT anchor, count(*) AS match_count, array_to_string(list_slice(list(phrase ORDER BY phrase_id), 1, 5), '|') AS example_phrases FROM mt GROUP BY 1 HAVING count(*) >= 10", "kw")
def m2(t: Tables) -> DataFrame:
    return templates.anchor_matches(templates.anchors(t.kw), t.kw).withColumn("example_phrases", F.array_join("example_phrases", "|"))


@register("m3_infer_patterns", f", {PATTERNS} SELECT * FROM pt", "kw")
def m3(t: Tables) -> DataFrame:
    return templates.infer_patterns(templates.anchors(t.kw), t.kw)


def _templates(t: Tables) -> DataFrame:
    a = templates.anchors(t.kw)
    found = templates.anchor_matches(a, t.kw).join(templates.infer_patterns(a, t.kw).where("template_pattern is not null"), "anchor")
    return templates.quality_templates(found.select("anchor", "template_pattern", "match_count"), 75)


@register("m4_quality_templates", f", {QUALITY} SELECT * FROM tp", "kw")
def m4(t: Tables) -> DataFrame:
    return _templates(t)


@register("m5_template_regex", f", {QUALITY} SELECT anchor, len(regexp_extract_all(template_pattern, '\\{{[XYZ]\\}}')) AS n_slots FROM tp", "kw")
def m5(t: Tables) -> DataFrame:
    re_ = templates.to_regex(F.col("template_pattern"))
    return _templates(t).select("anchor", F.regexp_count(re_, F.lit(r"\(\.\+\??\)")).cast("long").alias("n_slots"))


@register("m6_apply_templates", f", {APPLIED} SELECT template_pattern, phrase_id, volume, v1, v2 FROM ap", "kw")
def m6(t: Tables) -> DataFrame:
    m = templates.apply_templates(_templates(t), t.kw)
    values = F.map_values("variables")
    return m.select("template_pattern", "phrase_id", "volume", F.get(values, F.lit(0)).alias("v1"), F.get(values, F.lit(1)).alias("v2"))


@register("m7_decompose", f""", {SPANS} SELECT template_pattern, phrase_id, phrase[1:st] AS prefix, phrase[st + length(hit) + 1:] AS suffix, '[]' AS middle_parts,
 '[{{"start":' || s1 || ',"end":' || e1 || ',"name":"' || slots[1] || '"}}' || CASE WHEN len(slots) >= 2 THEN ',{{"start":' || s2 || ',"end":' || (s2 + length(g2)) || ',"name":"' || slots[2] || '"}}' ELSE '' END || ']' AS variable_positions FROM sp""", "kw")
def m7(t: Tables) -> DataFrame:
    m = templates.decompose(templates.apply_templates(_templates(t), t.kw))
    return m.select("template_pattern", "phrase_id", "prefix", "suffix", F.to_json("middle_parts").alias("middle_parts"), F.to_json("variable_positions").alias("variable_positions"))


def _variables(t: Tables) -> DataFrame:
    return templates.variable_statistics(templates.apply_templates(_templates(t), t.kw))


@register("m8_variable_statistics", f", {VARS} SELECT * FROM va", "kw")
def m8(t: Tables) -> DataFrame:
    return _variables(t)


@register("m8_score_percentiles", f", {VARS} SELECT quantile_cont(cross_validation_score, 0.25) AS p25, quantile_cont(cross_validation_score, 0.5) AS p50, quantile_cont(cross_validation_score, 0.75) AS p75, quantile_cont(cross_validation_score, 0.9) AS p90, max(cross_validation_score) AS most FROM va", "kw")
def m8_percentiles(t: Tables) -> DataFrame:
    return templates.score_percentiles(_variables(t))


@register("m9_quality_variables", f", {VARS} SELECT variable_text, cross_validation_score FROM va WHERE frequency >= 3 AND template_match_count >= 2", "kw")
def m9(t: Tables) -> DataFrame:
    return templates.quality_variables(_variables(t)).orderBy(F.desc("cross_validation_score"), "variable_text").select("variable_text", "cross_validation_score")


SEEDT = "sd AS (SELECT DISTINCT seed_word AS s FROM kw), sm AS (SELECT phrase_id, phrase, s, replace(phrase, s, '{X}') AS template_pattern FROM kw JOIN sd ON contains(phrase, s)), se AS (SELECT template_pattern, count(*) AS match_count, list_sort(list_distinct(list(s))) AS seeds FROM sm GROUP BY 1 HAVING count(*) >= 5)"


@register("m10_seed_templates", f", {SEEDT} SELECT template_pattern, match_count, array_to_string(seeds, ',') AS seeds, (SELECT array_to_string(list_slice(list(phrase ORDER BY phrase_id, s), 1, 5), '|') FROM sm WHERE sm.template_pattern = se.template_pattern) AS examples FROM se", "kw")
def m10(t: Tables) -> DataFrame:
    found = templates.seed_templates(relate.distinct_seeds(t.kw), t.kw)
    return found.select("template_pattern", "match_count", F.array_join("seeds", ",").alias("seeds"), F.array_join("examples", "|").alias("examples"))


def _template_variables(t: Tables) -> DataFrame:
    pats = t.spark.createDataFrame([("how to fix {X}",), ("learn {X} tutorial",), ("which {X} is better",)], "template_pattern string")
    return templates.template_variables(pats, t.kw)


TVARS = """tv AS (SELECT 'how to fix {X}' AS template_pattern, 'how to fix (.+)' AS re UNION ALL SELECT 'learn {X} tutorial', 'learn (.+) tutorial' UNION ALL SELECT 'which {X} is better', 'which (.+) is better'),
 vt AS (SELECT variable_text, count(*) AS frequency, array_to_string(list_sort(list_distinct(list(template_pattern))), ',') AS templates FROM (SELECT template_pattern, trim(regexp_extract(phrase, re, 1)) AS variable_text FROM kw JOIN tv ON regexp_matches(phrase, re)) WHERE length(variable_text) >= 2 GROUP BY 1 HAVING count(*) >= 3)"""


@register("m11_template_variables", f", {TVARS} SELECT * FROM vt", "kw")
def m11(t: Tables) -> DataFrame:
    return _template_variables(t).withColumn("templates", F.array_join("templates", ","))


@register("m11_end_characters", f", {TVARS}, ch AS (SELECT 'first' AS side, variable_text[1] AS char, frequency FROM vt UNION ALL SELECT 'last', variable_text[-1], frequency FROM vt) SELECT side, char, CAST(sum(frequency) AS BIGINT) AS n FROM ch GROUP BY 1, 2", "kw")
def m11_ends(t: Tables) -> DataFrame:
    return templates.end_characters(_template_variables(t))


@register("m12_noise_stop_words", f", {TVARS}, ch AS (SELECT variable_text[1] AS char, frequency FROM vt UNION ALL SELECT variable_text[-1], frequency FROM vt) SELECT char FROM ch WHERE char IN ('r', 's', 'e') GROUP BY 1 HAVING sum(frequency) > 50", "kw")
def m12(t: Tables) -> DataFrame:
    ends = templates.end_characters(_template_variables(t)).groupBy("char").agg(F.sum("n").alias("n"))
    return templates.noise_stop_words(ends, ["r", "s", "e"])


#: The same over the templates that seeds give, but for slots alone.
MINED = f"{SEEDT}, tp AS (SELECT template_pattern, '' AS anchor, match_count FROM se WHERE regexp_matches(template_pattern, '[^{{}}XYZ ]')){APPLIED[len(QUALITY):]}, vt AS (SELECT variable_text, count(*) AS frequency, array_to_string(list_sort(list_distinct(list(template_pattern))), ',') AS templates FROM (SELECT template_pattern, v1 AS variable_text FROM ap) WHERE length(variable_text) >= 2 GROUP BY 1 HAVING count(*) >= 3)"


def _mined_variables(t: Tables) -> DataFrame:
    found = templates.seed_templates(relate.distinct_seeds(t.kw), t.kw).select("template_pattern")
    return templates.template_variables(found, t.kw)


@register("m11_mined_variables", f", {MINED} SELECT * FROM vt", "kw")
def m11_mined(t: Tables) -> DataFrame:
    return _mined_variables(t).withColumn("templates", F.array_join("templates", ","))


@register("m12_mined_noise", f", {MINED}, ch AS (SELECT variable_text[1] AS char, frequency FROM vt UNION ALL SELECT variable_text[-1], frequency FROM vt) SELECT char FROM ch WHERE char IN ('r', 's', 'e') GROUP BY 1 HAVING sum(frequency) > 50", "kw")
def m12_mined(t: Tables) -> DataFrame:
    ends = templates.end_characters(_mined_variables(t)).groupBy("char").agg(F.sum("n").alias("n"))
    return templates.noise_stop_words(ends, ["r", "s", "e"])


@register("m13_frequency_bins", f", {VARS} SELECT CASE WHEN frequency <= 10 THEN '1-10' WHEN frequency <= 50 THEN '11-50' WHEN frequency <= 100 THEN '51-100' ELSE '100+' END AS bin, count(*) AS n_variables, CAST(sum(frequency) AS BIGINT) AS frequency FROM va GROUP BY 1", "kw")
def m13(t: Tables) -> DataFrame:
    return templates.frequency_bins(_variables(t))


def _entities(t: Tables) -> DataFrame:
    v = _variables(t)
    verdicts = v.select(
        "variable_text", (F.length("variable_text") % 3 != 0).alias("is_product"), F.pmod(F.length("variable_text") * 7, F.lit(101)).alias("commercial_value"),
        F.when(F.length("variable_text") > 12, "long").otherwise("short").alias("category"), F.lit(1).alias("batch"),
    )
    return templates.product_entities(v, verdicts)


ENTITIES = f"{VARS}, pe AS (SELECT variable_text, frequency, (length(variable_text) * 7) % 101 AS commercial_value, CASE WHEN length(variable_text) > 12 THEN 'long' ELSE 'short' END AS category FROM va WHERE length(variable_text) % 3 <> 0)"


@register("m14_product_entities", f", {ENTITIES} SELECT variable_text, frequency, CAST(commercial_value AS INT) AS commercial_value, category FROM pe", "kw")
def m14(t: Tables) -> DataFrame:
    return _entities(t).select("variable_text", "frequency", "commercial_value", "category")


@register("m15_product_summary", f", {ENTITIES} SELECT category, count(*) AS n_products, round(avg(commercial_value), 6) AS avg_value, count(*) FILTER (commercial_value >= 70) AS n_valuable FROM pe GROUP BY 1", "kw")
def m15(t: Tables) -> DataFrame:
    return templates.product_summary(_entities(t))


@register("j12_contains_join", "SELECT k.phrase_id, s.s AS pattern FROM kw k JOIN (SELECT DISTINCT seed_word AS s FROM kw) s ON contains(k.phrase, s.s)", "kw")
def j12(t: Tables) -> DataFrame:
    pats = relate.distinct_seeds(t.kw).withColumnRenamed("seed_word", "pattern")
    return relate.contains_join(t.kw, pats, "phrase", "pattern").select("phrase_id", "pattern")


@register("u2_match_spans", f""", {SPANS} SELECT phrase_id, template_pattern, CAST(s1 AS INT) AS start, CAST(e1 AS INT) AS "end", slots[1] AS name FROM sp UNION ALL SELECT phrase_id, template_pattern, CAST(s2 AS INT), CAST(s2 + length(g2) AS INT), slots[2] FROM sp WHERE len(slots) >= 2""", "kw")
def u2(t: Tables) -> DataFrame:
    m = templates.decompose(templates.apply_templates(_templates(t), t.kw))
    return m.select("phrase_id", "template_pattern", F.explode("variable_positions").alias("s")).select("phrase_id", "template_pattern", "s.*")
