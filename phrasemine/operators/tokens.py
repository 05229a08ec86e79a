"""Tokens and n-grams of phrases, with counts and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

THRESHOLDS = [3, 5, 8, 10, 15, 20, 30, 50]


def token_frequency(phrases: DataFrame, least: int = 8) -> DataFrame:
    """T4: occurrences of valid tokens."""
    # words are tested after the explode, where the tests are compiled
    return phrases.select(F.explode(X.token_candidates(F.col("phrase"))).alias("token")).where(X.is_valid_token(F.col("token"))).groupBy("token").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)


def suggest_threshold(counts: DataFrame, target: int = 1000) -> DataFrame:
    """T5: tokens that survive each threshold, and the first threshold that leaves at most target (8 if none does)."""
    per = counts.agg(*[F.count_if(F.col("frequency") >= t).alias(f"t{t}") for t in THRESHOLDS])
    rows = per.select(F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("n_tokens")) for t in THRESHOLDS])))
    fits = per.select(F.coalesce(*[F.when(F.col(f"t{t}") <= target, t) for t in THRESHOLDS], F.lit(8)).alias("suggested"))
    return rows.join(F.broadcast(fits))  # one row


def bigrams(phrases: DataFrame, least: int = 3) -> DataFrame:
    """Adjacent pairs of valid tokens."""
    w = phrases.select(X.tokens(F.col("phrase")).alias("w"))
    return w.select(F.explode(X.ngrams("w", 2, 2)).alias("g")).groupBy(F.col("g.gram").alias("gram")).agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)


def prioritised_ngrams(phrases: DataFrame, most: int = 4, least: int = 5, priority: bool = True) -> DataFrame:
    """N-grams of 1 to `most` tokens; longer ones need more occurrences, and words inside kept n-grams twice as many."""
    w = phrases.select(X.tokens(F.col("phrase")).alias("w"))
    counts = w.select(F.explode(X.ngrams("w", 1, most)).alias("g")).groupBy(F.col("g.n").alias("n"), F.col("g.gram").alias("gram")).agg(F.count("*").alias("frequency"))
    if not priority:
        return counts.where(F.col("frequency") >= least).withColumn("priority", F.lit(1))
    kept = counts.where((F.col("n") >= 2) & (F.col("frequency") >= least * (1 + (F.col("n") - 2) * 0.5))).withColumn("priority", F.lit(1))
    inside = kept.select(F.explode(F.split("gram", " ")).alias("gram")).distinct().withColumn("inside", F.lit(True))
    words = (
        counts.where("n = 1").join(inside, "gram", "left")
        .where(F.col("frequency") >= F.when(F.col("inside"), 2 * least).otherwise(least)).drop("inside").withColumn("priority", F.lit(2))
    )
    return kept.unionByName(words)


def demand_patterns(phrases: DataFrame, types: DataFrame, least: int = 5, examples: int = 3) -> DataFrame:
    """Phrases as sequences of token types; counted, with the first phrases as examples.

    types: (token, token_type), any size; unknown tokens are "other".  A phrase without tokens has the empty pattern.
    """
    t = phrases.select("phrase_id", "phrase", F.posexplode_outer(X.tokens(F.col("phrase"))).alias("pos", "token")).join(types, "token", "left")
    kind = F.when(F.col("token").isNull(), "").otherwise(F.concat(F.lit("["), F.coalesce("token_type", F.lit("other")), F.lit("]")))
    per = t.groupBy("phrase_id").agg(F.min("phrase").alias("phrase"), F.array_sort(F.collect_list(F.struct("pos", kind.alias("k")))).alias("s"))
    per = per.select("phrase_id", "phrase", F.array_join(F.transform("s", lambda x: x["k"]), " ").alias("pattern"))
    counts = per.groupBy("pattern").agg(F.count("*").alias("n_phrases")).where(F.col("n_phrases") >= least)
    first = top_k(per, ["pattern"], [F.col("phrase_id")], examples).groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("phrase_id", "phrase"))).alias("e"))
    return counts.join(first, "pattern").select("pattern", "n_phrases", F.transform("e", lambda x: x["phrase"]).alias("examples"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """K rows of each key; hot keys are thinned to k rows in each of 16 parts first."""
    part = F.pmod(F.xxhash64(*df.columns), F.lit(16))
    thin = df.withColumn("_p", part).withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order))).where(F.col("_n") <= k)
    return thin.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_p", "_n")


def framework(tokens: DataFrame, k: int = 10) -> DataFrame:
    """Tokens (token, token_type, frequency) by type: count, total and the most frequent."""
    top = top_k(tokens, ["token_type"], [F.desc("frequency"), F.col("token")], k).groupBy("token_type").agg(F.array_sort(F.collect_list(F.struct((-F.col("frequency")).alias("f"), "token"))).alias("t"))
    return tokens.groupBy("token_type").agg(F.count("*").alias("n_tokens"), F.sum("frequency").alias("total_frequency")).join(top, "token_type").select(
        "token_type", "n_tokens", "total_frequency", F.transform("t", lambda x: x["token"]).alias("top_tokens")
    )


def prefix_groups(tokens: DataFrame, most: int = 100) -> DataFrame:
    """Tokens by their first three letters; the largest groups."""
    return tokens.groupBy(F.substring("token", 1, 3).alias("prefix")).agg(F.count("*").alias("n_tokens"), F.sum("frequency").alias("frequency")).orderBy(F.desc("n_tokens"), "prefix").limit(most)


def segment(phrases: DataFrame) -> DataFrame:
    """Words of phrases with counts."""
    return phrases.select(F.explode(X.segment_candidates(F.col("phrase"))).alias("word")).where(X.is_segment_word(F.col("word"))).groupBy("word").agg(F.count("*").alias("frequency"))


def segment_unified(phrases: DataFrame, least: int = 2, most: int = 6) -> DataFrame:
    """N-grams of 1 to `most` segmented words, with counts, word count and the set of seeds."""
    w = phrases.select("seed_word", X.segment_words(F.col("phrase")).alias("w"))
    grams = w.select("seed_word", F.explode(X.ngrams("w", 1, most)).alias("g"))
    pairs = grams.groupBy(F.col("g.gram").alias("word"), F.col("g.n").alias("word_count"), "seed_word").agg(F.count("*").alias("n"))
    return (
        pairs.groupBy("word", "word_count").agg(F.sum("n").alias("frequency"), F.sort_array(F.collect_set("seed_word")).alias("seeds"))
        .where(F.col("frequency") >= least).select("word", "word_count", "frequency", "seeds")
    )


def merge_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts (word, word_count, frequency, seeds) of two tables in one."""
    both = old.select("word", "word_count", "frequency", "seeds").unionByName(new.select("word", "word_count", "frequency", "seeds"))
    return both.groupBy("word", "word_count").agg(F.sum("frequency").alias("frequency"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("seeds")))).alias("seeds"))


def segment_rounds(phrases: DataFrame, rounds: list[int], stored: DataFrame, least: int = 2) -> DataFrame:
    """Counts of the given rounds, cut at least, merged onto stored counts."""
    return merge_counts(stored, segment_unified(phrases.where(F.col("first_seen_round").isin(*rounds)), least))


def resegment(phrases: DataFrame, stored: DataFrame, least: int = 2) -> DataFrame:
    """All phrases counted anew over stored words; status new, kept or gone, annotations stay."""
    new = segment_unified(phrases, least).select("word", F.col("word_count").alias("n_new"), F.col("frequency").alias("f_new"))
    out = stored.join(new, "word", "full_outer")
    status = F.when(F.col("frequency").isNull(), "new").when(F.col("f_new").isNull(), "gone").otherwise("kept")
    return out.select("word", F.coalesce("n_new", "word_count").alias("word_count"), F.coalesce("f_new", "frequency").alias("frequency"), status.alias("status"), "pos_category")


def word_statistics(counts: DataFrame) -> DataFrame:
    """Unique words, total, mean."""
    return counts.agg(F.count("*").alias("unique_words"), F.sum("frequency").alias("total"), F.round(F.avg("frequency"), 2).alias("mean"))


def raw_ngrams(phrases: DataFrame, low: int, high: int) -> DataFrame:
    """N-grams of all words between white space, with counts."""
    w = phrases.select(F.filter(F.split(F.lower("phrase"), r"\s+"), lambda x: x != "").alias("w"))
    return w.select(F.explode(X.ngrams("w", low, high)).alias("g")).groupBy(F.col("g.n").alias("n"), F.col("g.gram").alias("gram")).agg(F.count("*").alias("frequency"))


def maintain_stop_words(words: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """A one-column table of stop words after additions and removals."""
    clean = lambda d: d.select(F.lower(F.trim("word")).alias("word")).where("word <> ''")
    return clean(words).union(clean(add)).distinct().join(clean(remove).distinct(), "word", "left_anti")


def pos_rollup(words: DataFrame, categories: DataFrame) -> DataFrame:
    """Words and summed frequency by category; tags without one are Other."""
    return words.join(categories, "pos_tag", "left").groupBy(F.coalesce("pos_category", F.lit("Other")).alias("pos_category")).agg(F.count("*").alias("n_words"), F.sum("frequency").alias("frequency"))


def attach(words: DataFrame, dictionary: DataFrame, missing_only: bool = False) -> DataFrame:
    """Words with their stored annotation, or those without one."""
    return words.join(dictionary, "word", "left_anti") if missing_only else words.join(dictionary, "word", "left")
