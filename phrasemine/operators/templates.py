"""Templates, their variables and product entities mined from phrases."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.scratch import stash
from .order import percentiles
from .relate import contains_join
from .tokens import raw_ngrams, top_k

#: Characters that mean little at the ends of a variable.
NOISE_CHARS = ["的", "了", "在", "和", "与", "或", "上", "下", "中", "是", "有"]
SLOT = r"\{[XYZ]\}"


def anchors(phrases: DataFrame, least: int = 10, most: int = 100) -> DataFrame:
    """M1: the most frequent three- and four-word runs."""
    n = raw_ngrams(phrases, 3, 4).where(F.col("frequency") >= least)
    return n.orderBy(F.desc("frequency"), "n", "gram").limit(most).select(F.col("gram").alias("anchor"), "frequency")


def anchor_matches(anchors: DataFrame, phrases: DataFrame, least: int = 10, examples: int = 5) -> DataFrame:
    """M2: phrases that contain each anchor anywhere; counts and first examples."""
    m = contains_join(phrases, anchors.select("anchor"), "phrase", "anchor").select("anchor", "phrase_id", "phrase")
    n = m.groupBy("anchor").agg(F.count("*").alias("match_count")).where(F.col("match_count") >= least)
    first = top_k(m, ["anchor"], [F.col("phrase_id")], examples).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("phrase_id", "phrase"))).alias("e"))
    return n.join(first, "anchor").select("anchor", "match_count", F.transform("e", lambda x: x["phrase"]).alias("example_phrases"))


def infer_patterns(anchors: DataFrame, phrases: DataFrame, looked_at: int = 20) -> DataFrame:
    """M3: the pattern of each anchor from the first matches that hold it as whole words; null without a slot.

    The most common start wins, the earliest phrase on a tie.  An anchor at the start is followed by a slot, or by the
    one suffix that all share; elsewhere the prefix is a slot or the one that all share, and a second slot or suffix follows.
    """
    m = top_k(contains_join(phrases, anchors.select("anchor"), "phrase", "anchor").select("anchor", "phrase_id", "phrase"), ["anchor"], [F.col("phrase_id")], looked_at)
    words, a = F.filter(F.split("phrase", r"\s+"), lambda w: w != ""), F.split("anchor", " ")
    at = m.withColumn("w", words).withColumn("a", a).withColumn(
        "start", F.expr("array_position(transform(sequence(0, greatest(size(w) - size(a), 0)), i -> slice(w, i + 1, size(a)) = a), true) - 1")
    ).where("start >= 0")
    at = at.select(
        "anchor", "phrase_id", "start", F.nullif(F.expr("array_join(slice(w, 1, int(start)), ' ')"), F.lit("")).alias("prefix"),
        F.nullif(F.expr("array_join(slice(w, int(start) + size(a) + 1, greatest(size(w), 1)), ' ')"), F.lit("")).alias("suffix"),
    )
    start = at.groupBy("anchor", "start").agg(F.count("*").alias("n"), F.min("phrase_id").alias("first")).groupBy("anchor").agg(F.min_by("start", F.struct(-F.col("n"), "first")).alias("start"))
    ends = at.groupBy("anchor").agg(
        F.count_distinct("prefix").alias("prefixes"), F.min("prefix").alias("prefix"), F.count_distinct("suffix").alias("suffixes"), F.min("suffix").alias("suffix")
    )
    one_suffix, one_prefix = F.col("suffixes") == 1, F.col("prefixes") == 1
    pattern = F.when(F.col("start") == 0, F.concat_ws(" ", "anchor", F.when(one_suffix, F.col("suffix")).otherwise("{X}"))).when(
        one_prefix, F.concat_ws(" ", "prefix", "anchor", F.when(~one_suffix, F.lit("{X}")))
    ).otherwise(F.concat_ws(" ", F.lit("{X}"), "anchor", F.when(one_suffix, F.col("suffix")).when(F.col("suffixes") > 1, F.lit("{Y}"))))
    return start.join(ends, "anchor").select("anchor", F.when(pattern.rlike(r"\{[XY]\}"), pattern).alias("template_pattern"))


def quality_templates(templates: DataFrame, percentile: float = 50) -> DataFrame:
    """M4: templates (anchor, template_pattern, match_count) at or above a percentile of match counts, two words or more, with a slot."""
    templates = stash(templates, "templates")  # read for the percentile and for the result
    cut = percentiles(templates, "match_count", [percentile / 100])[0]
    ok = (F.size(F.split("template_pattern", r"\s+")) >= 2) & F.col("template_pattern").rlike(SLOT)
    return templates.where((F.col("match_count") >= F.lit(cut)) & ok)


def to_regex(pattern: Column) -> Column:
    """M5: the regular expression of a template: fixed text quoted, slots lazy but the last."""
    quoted = F.concat(F.lit(r"\Q"), pattern, F.lit(r"\E"))
    last = F.regexp_replace(quoted, r"\{[XYZ]\}(?!.*\{[XYZ]\})", r"\\E(.+)\\Q")
    return F.regexp_replace(last, SLOT, r"\\E(.+?)\\Q")


def apply_templates(templates: DataFrame, phrases: DataFrame) -> DataFrame:
    """M6: (template_pattern, anchor, phrase_id, phrase, volume, variables): phrases that a template matches, with the values of its slots."""
    t = templates.select("anchor", "template_pattern", to_regex(F.col("template_pattern")).alias("_re"), F.regexp_extract_all("template_pattern", F.lit(r"\{([XYZ])\}"), F.lit(1)).alias("_slots"))
    m = contains_join(phrases, t, "phrase", "anchor").where("phrase rlike _re")
    value = lambda k: F.when(F.size("_slots") >= k, F.trim(F.expr(f"regexp_extract(phrase, _re, if(size(_slots) >= {k}, {k}, 0))")))
    values = F.slice(F.array(*map(value, (1, 2, 3))), F.lit(1), F.size("_slots"))
    return m.select("template_pattern", "anchor", "phrase_id", "phrase", "volume", F.map_from_arrays("_slots", values).alias("variables"))


_SPANS = StructType([
    StructField("prefix", StringType()), StructField("suffix", StringType()), StructField("middle_parts", ArrayType(StringType())),
    StructField("variable_positions", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("name", StringType())]))),
])


@F.pandas_udf(_SPANS)
def match_spans(phrase: pd.Series, pattern: pd.Series) -> pd.DataFrame:
    """Spans of a template's slots in a phrase, and what lies outside and between; built-ins give no group offsets."""
    compiled: dict[str, tuple[re.Pattern, list[str], list[str]]] = {}
    rows = []
    for p, t in zip(phrase, pattern):
        if t not in compiled:
            fixed, names = re.split(SLOT, t), re.findall(r"\{([XYZ])\}", t)
            slots = ["(.+?)"] * (len(names) - 1) + ["(.+)"] * bool(names)
            compiled[t] = re.compile("".join(re.escape(f) + s for f, s in zip(fixed, [*slots, ""]))), names, [f.strip() for f in fixed if f.strip()]
        regex, names, fixed = compiled[t]
        m = regex.search(p)
        rows.append((None, None, [], []) if m is None else (p[: m.start()], p[m.end() :], fixed[1:-1] if len(fixed) > 2 else [], [(m.start(k + 1), m.end(k + 1), n) for k, n in enumerate(names)]))
    return pd.DataFrame(rows, columns=[f.name for f in _SPANS.fields])


def decompose(matches: DataFrame) -> DataFrame:
    """M7: matches with prefix, suffix, middle parts and slot spans."""
    return matches.select("*", match_spans("phrase", "template_pattern").alias("_s")).select(*matches.columns, "_s.*")


def variable_statistics(matches: DataFrame) -> DataFrame:
    """M8: each slot value with how often, in how many templates and with what volume it occurs."""
    v = matches.select("anchor", "volume", F.explode(F.map_values("variables")).alias("v")).withColumn("variable_text", F.lower(F.trim("v"))).where("length(variable_text) >= 2")
    pairs = v.groupBy("variable_text", "anchor").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))
    return (
        pairs.groupBy("variable_text").agg(F.sum("n").alias("frequency"), F.count("*").alias("template_match_count"), F.sum("volume").alias("total_volume"))
        .withColumn("cross_validation_score", F.col("frequency") * F.col("template_match_count"))
    )


def score_percentiles(stats: DataFrame) -> DataFrame:
    scores = stash(stats.select("cross_validation_score"), "scores")
    p = percentiles(scores, "cross_validation_score", [0.25, 0.5, 0.75, 0.9])
    return scores.agg(F.max("cross_validation_score").alias("most")).select(*[F.lit(x).cast("double").alias(n) for n, x in zip(("p25", "p50", "p75", "p90"), p)], "most")


def quality_variables(stats: DataFrame, least: int = 3, templates: int = 2) -> DataFrame:
    """M9."""
    return stats.where((F.col("frequency") >= least) & (F.col("template_match_count") >= templates))


def seed_templates(seeds: DataFrame, phrases: DataFrame, least: int = 5, examples: int = 5) -> DataFrame:
    """Phrases with each seed replaced by a slot, counted."""
    m = contains_join(phrases.drop("seed_word"), seeds, "phrase", "seed_word").select("phrase_id", "phrase", "seed_word", F.replace("phrase", F.col("seed_word"), F.lit("{X}")).alias("template_pattern"))
    per = m.groupBy("template_pattern", "seed_word").agg(F.count("*").alias("n")).groupBy("template_pattern").agg(F.sum("n").alias("match_count"), F.sort_array(F.collect_set("seed_word")).alias("seeds"))
    first = top_k(m, ["template_pattern"], [F.col("phrase_id"), F.col("seed_word")], examples).groupBy("template_pattern").agg(F.array_sort(F.collect_list(F.struct("phrase_id", "phrase"))).alias("e"))
    return per.where(F.col("match_count") >= least).join(first, "template_pattern").select("template_pattern", "match_count", "seeds", F.transform("e", lambda x: x["phrase"]).alias("examples"))


def template_variables(templates: DataFrame, phrases: DataFrame, least: int = 3, stop_words: list[str] = []) -> DataFrame:
    """Values of the first slot of templates, counted, with the templates that hold them.

    Phrases are found by the longest text of a template between its slots; a template of slots alone fixes nothing and has no variables.
    """
    pieces = F.transform(F.split("template_pattern", SLOT), lambda x: F.trim(x))
    longest = F.aggregate(pieces, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    t = templates.select("template_pattern", to_regex(F.col("template_pattern")).alias("_re"), longest.alias("_fixed"))
    m = contains_join(phrases, t, "phrase", "_fixed").where("phrase rlike _re").select("template_pattern", F.trim(F.expr("regexp_extract(phrase, _re, 1)")).alias("variable_text"))
    m = m.where((F.length("variable_text") >= 2) & ~F.col("variable_text").isin("", *stop_words))
    pairs = m.groupBy("variable_text", "template_pattern").agg(F.count("*").alias("n"))
    return pairs.groupBy("variable_text").agg(F.sum("n").alias("frequency"), F.sort_array(F.collect_set("template_pattern")).alias("templates")).where(F.col("frequency") >= least)


def end_characters(variables: DataFrame, most: int = 50) -> DataFrame:
    """First and last characters of variables (variable_text, frequency), the most frequent of each."""
    v = variables.select(F.inline(F.array(F.struct(F.lit("first").alias("side"), F.substring("variable_text", 1, 1).alias("char"), "frequency"), F.struct(F.lit("last").alias("side"), F.expr("substring(variable_text, -1, 1)").alias("char"), "frequency"))))
    return top_k(v.groupBy("side", "char").agg(F.sum("frequency").alias("n")), ["side"], [F.desc("n"), F.col("char")], most)


def noise_stop_words(ends: DataFrame, chars: list[str] = NOISE_CHARS, more_than: int = 50) -> DataFrame:
    """End characters of a fixed set that are frequent."""
    return ends.where(F.col("char").isin(*chars) & (F.col("n") > more_than)).select("char").distinct()


def frequency_bins(stats: DataFrame) -> DataFrame:
    """Variables by frequency: 1-10, 11-50, 51-100, 100+."""
    bin_ = F.when(F.col("frequency") <= 10, "1-10").when(F.col("frequency") <= 50, "11-50").when(F.col("frequency") <= 100, "51-100").otherwise("100+")
    return stats.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n_variables"), F.sum("frequency").alias("frequency"))


def product_entities(variables: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Variables that a verdict (variable_text, is_product, commercial_value, category, batch) calls products, by their first verdict."""
    first = verdicts.where("is_product").groupBy("variable_text").agg(F.min_by(F.struct("commercial_value", "category"), "batch").alias("v"))
    return variables.join(first, "variable_text").select(*variables.columns, "v.commercial_value", "v.category")


def product_summary(entities: DataFrame) -> DataFrame:
    """M15."""
    return entities.groupBy("category").agg(F.count("*").alias("n_products"), F.round(F.avg("commercial_value"), 6).alias("avg_value"), F.count_if(F.col("commercial_value") >= 70).alias("n_valuable"))
