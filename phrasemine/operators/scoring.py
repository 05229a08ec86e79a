"""Quality of clusters, similarity of phrases, and experiments on samples."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as X
from ..functions.scratch import stash
from .alike import common_letters, near_strings
from .relate import contains_join, sample
from .tokens import top_k

#: Words left out of the list of uncovered words.
BASIC_STOP_WORDS = "a an the and or but in on at to for of with by from is are was were".split()


def size_score(n: Column) -> Column:
    """C1."""
    return (
        F.when(n < 5, 0.0).when(n < 15, (n - 5) / 10 * 0.5).when(n <= 150, 1.0).when(n <= 500, F.greatest(F.lit(0.3), 1 - (n - 150) / 350 * 0.7)).otherwise(0.3)
    )


def spread_score(u: Column) -> Column:
    """The curve of C2 and C3: best at 0.7."""
    return F.when(u < 0.3, u / 0.3 * 0.5).when(u <= 0.7, 0.5 + (u - 0.3) / 0.4 * 0.5).otherwise(F.greatest(F.lit(0.7), 1 - (u - 0.7) * 0.5))


def diversity(phrases: DataFrame, key: str) -> DataFrame:
    """The share of distinct words in all words of a cluster, on the curve; 0 without words."""
    w = phrases.select(key, F.explode(F.filter(F.split(F.lower("phrase"), r"\s+"), lambda x: x != "")).alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))
    u = w.groupBy(key).agg((F.count("*") / F.sum("n")).alias("unique_ratio"))
    keys = phrases.select(key).distinct()
    return keys.join(u, key, "left").select(key, F.coalesce("unique_ratio", F.lit(0.0)).alias("unique_ratio"), F.coalesce(spread_score(F.col("unique_ratio")), F.lit(0.0)).alias("diversity"))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings."""
    return pd.Series([0.0 if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def ratio_from(least: float):
    """U1 where only ratios of `least` or more matter: 0 where the letters that two strings share in order cannot reach it."""

    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            need = least * (len(x) + len(y)) / 2
            near = min(len(x), len(y)) >= need and common_letters(x, y) >= need
            out.append(SequenceMatcher(None, x, y).ratio() if near else 0.0)
        return pd.Series(out, dtype=float)

    return F.pandas_udf(ratio, DoubleType())


def similarity(a: Column, b: Column, sorted_words: bool = False, least: float = 0.0) -> Column:
    """The larger of the Jaccard similarity of word sets and the sequence ratio, of sorted words if asked for; below `least` any smaller number."""
    wa, wb = (F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda x: x != "") for c in (a, b))
    both = F.size(F.array_union(wa, wb))
    jaccard = F.when(both > 0, F.size(F.array_intersect(wa, wb)) / both).otherwise(0.0)
    sa, sb = (F.array_join(F.array_sort(w), " ") for w in (wa, wb)) if sorted_words else (F.lower(a), F.lower(b))
    return F.greatest(jaccard, (ratio_from(least) if least else sequence_ratio)(sa, sb))


def consistency(phrases: DataFrame, key: str, size: int = 20, ahead: int = 5) -> DataFrame:
    """A sample of each cluster, in hash order, each phrase compared with the next few: the mean, on the curve.

    Clusters of one phrase score 0.
    """
    s = top_k(phrases.select(key, "phrase_id", "phrase"), [key], [F.xxhash64("phrase"), F.col("phrase_id")], size)
    lists = s.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("phrase").alias("h"), "phrase_id", "phrase"))).alias("s"))
    pairs = lists.select(key, F.expr(
        f"explode(flatten(transform(sequence(0, size(s) - 1), i -> transform(filter(sequence(1, {ahead}), d -> i + d < size(s)), d -> struct(s[i].phrase as a, s[i + d].phrase as b)))))"
    ).alias("p")).select(key, "p.a", "p.b")
    mean = pairs.select(key, similarity(F.col("a"), F.col("b")).alias("x")).groupBy(key).agg(F.avg("x").alias("m"))
    return lists.join(mean, key, "left").select(key, F.when(F.size("s") < 2, 0.0).otherwise(F.coalesce(spread_score(F.col("m")), F.lit(0.5))).alias("consistency"))


def quality(size: Column, diversity_: Column, consistency_: Column) -> Column:
    """C4: 0 to 100."""
    return F.round(100 * (0.4 * size_score(size) + 0.3 * diversity_ + 0.3 * consistency_), 2)


def quality_level(score: Column) -> Column:
    return F.when(score >= 75, "excellent").when(score >= 60, "good").when(score >= 40, "fair").otherwise("poor")


def score_clusters(phrases: DataFrame, key: str) -> DataFrame:
    """C4, U4: size, diversity, consistency, quality and level of each cluster."""
    n = phrases.groupBy(key).agg(F.count("*").alias("size"))
    q = n.join(diversity(phrases, key), key).join(consistency(phrases, key), key)
    return q.withColumn("quality_score", quality(F.col("size"), F.col("diversity"), F.col("consistency"))).withColumn("quality_level", quality_level(F.col("quality_score")))


def pick_clusters(phrases: DataFrame, key: str) -> DataFrame:
    """The best clusters by size and by distinct words in their first 50 phrases; a tenth to an eighth of them."""
    n = phrases.groupBy(key).agg(F.count("*").alias("size"))
    w = top_k(phrases.select(key, "phrase_id", "phrase"), [key], [F.col("phrase_id")], 50).select(key, F.explode(F.filter(F.split(F.lower("phrase"), r"\s+"), lambda x: x != "")).alias("w"))
    u = w.groupBy(key).agg((F.count_distinct("w") / F.count("*")).alias("u"))
    s = F.when(F.col("size") < 15, F.col("size") / 15 * 0.5).when(F.col("size") <= 150, 1.0).otherwise(F.greatest(F.lit(0.3), 1 - (F.col("size") - 150) / 500))
    scored = n.join(u, key).withColumn("score", F.round(0.6 * s + 0.4 * F.col("u"), 6))
    many = scored.agg(F.least(F.lit(12), F.greatest(F.lit(10), F.floor(F.count("*") / 8))).alias("k")).first().k  # the size of the answer
    return scored.orderBy(F.desc("score"), key).limit(int(many)).select(key, "size", "score")


def coverage(phrases: DataFrame, tokens: DataFrame) -> DataFrame:
    """C11: phrases with whether they contain any token, anywhere."""
    hit = contains_join(phrases.select("phrase_id", "phrase"), tokens.select("token"), "phrase", "token").select("phrase_id").distinct().withColumn("covered", F.lit(True))
    return phrases.join(hit, "phrase_id", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def token_usage(phrases: DataFrame, tokens: DataFrame) -> DataFrame:
    return contains_join(phrases.select("phrase_id", "phrase"), tokens.select("token"), "phrase", "token").groupBy("token").agg(F.count("*").alias("n_phrases"))


def coverage_report(covered: DataFrame) -> DataFrame:
    r = covered.agg(F.count("*").alias("n"), F.count_if("covered").alias("n_covered")).withColumn("coverage", F.round(F.col("n_covered") / F.col("n"), 6))
    return r.withColumn("verdict", F.when(F.col("coverage") >= 0.8, "enough").when(F.col("coverage") <= 0.6, "too low").otherwise("fair"))


def uncovered_words(covered: DataFrame, k: int = 50) -> DataFrame:
    w = covered.where("not covered").select(F.explode(F.split(F.lower("phrase"), r"\s+")).alias("word"))
    return w.where((F.length("word") > 2) & ~F.col("word").isin(*BASIC_STOP_WORDS)).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def similar_pairs(phrases: DataFrame, least: float, sorted_words: bool = True) -> DataFrame:
    """All pairs (a < b) of phrases (phrase_id, phrase) whose similarity is at least `least`.

    A pair that reaches it by its words shares one of the rarest of either's, by prefix filtering; one that reaches it by its letters shares a
    segment (`alike.near_strings`).  Both meet in equality joins, by id; texts are joined to what is left.  Null ids and phrases have no pairs.
    """
    p = stash(phrases.select("phrase_id", "phrase").where("phrase_id is not null and phrase is not null"), "phrases")
    words = F.filter(F.split(F.lower(F.trim("phrase")), r"\s+"), lambda x: x != "")
    strings = p.select(F.col("phrase_id").alias("id"), (F.array_join(F.array_sort(words), " ") if sorted_words else F.lower("phrase")).alias("s"))
    w = p.select("phrase_id", F.explode(F.array_distinct(words)).alias("x"))
    freq = w.groupBy("x").agg(F.count("*").alias("f"))
    ranked = w.join(freq, "x").groupBy("phrase_id").agg(F.array_sort(F.collect_list(F.struct("f", "x"))).alias("r")).withColumn("j", F.size("r"))
    rare = ranked.select("phrase_id", "j", F.explode(F.expr(f"slice(transform(r, t -> t.x), 1, j - cast(ceil({least} * j - 1e-9) as int) + 1)")).alias("x"))
    a, b = rare.alias("a"), rare.alias("b")
    sizes = F.least("a.j", "b.j") >= F.lit(least) * F.greatest("a.j", "b.j") - 1e-9
    by_words = a.join(b, (F.col("a.x") == F.col("b.x")) & (F.col("a.phrase_id") < F.col("b.phrase_id")) & sizes).select(F.col("a.phrase_id").alias("a"), F.col("b.phrase_id").alias("b"))
    pairs = by_words.union(near_strings(strings, least)).distinct()
    texts = pairs.join(p.select(F.col("phrase_id").alias("a"), F.col("phrase").alias("pa")), "a").join(p.select(F.col("phrase_id").alias("b"), F.col("phrase").alias("pb")), "b")
    return texts.withColumn("similarity", similarity(F.col("pa"), F.col("pb"), sorted_words, least)).where(F.col("similarity") >= least).select("a", "b", "similarity")


def redundancy(groups: DataFrame, n_sample: int) -> DataFrame:
    """The share of a sample that grouping similar phrases would save; groups: (leader, member)."""
    g = groups.groupBy("leader").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_phrases"))
    r = g.withColumn("redundancy", F.round((F.col("n_phrases") - F.col("n_groups")) / n_sample, 6))
    return r.withColumn("verdict", F.when(F.col("redundancy") < 0.1, "low").when(F.col("redundancy") > 0.2, "high").otherwise("medium"))


def recommendations(verdicts: DataFrame) -> DataFrame:
    """(experiment, verdict) with the priority that follows."""
    v = F.col("verdict")
    return verdicts.withColumn("priority", F.when(v.isin("too low", "high"), "high").when(v.isin("fair", "medium"), "medium").otherwise("low"))


def import_selection(sheet: DataFrame, meta: DataFrame) -> DataFrame:
    """C14: review rows (cluster_id, selection_score as text) with a whole score of 1 to 5 and a cluster of level A."""
    s = sheet.withColumn("selection_score", F.col("selection_score").try_cast("int")).where("selection_score between 1 and 5")
    return s.withColumn("is_selected", F.col("selection_score") >= 4).join(meta.where("cluster_level = 'A'").select("cluster_id"), "cluster_id")


def cluster_framework(phrases: DataFrame, types: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The most frequent tokens of each cluster and type, for intent, action, object and other."""
    t = phrases.select(key, F.explode(X.tokens(F.col("phrase"))).alias("token")).join(types, "token").where(F.col("token_type").isin("intent", "action", "object", "other"))
    return top_k(t.groupBy(key, "token_type", "token").agg(F.count("*").alias("n")), [key, "token_type"], [F.desc("n"), F.col("token")], k)


def hash_sample(phrases: DataFrame, n: int) -> DataFrame:
    return sample(phrases, n, 42, "phrase_id")
