"""Aggregations and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import stash
from ..functions.text import QUESTION_WORDS
from .order import order_statistics
from .relate import with_share
from .tokens import top_k


def phrase_statistics(phrases: DataFrame) -> DataFrame:
    """A2: total, counts by source, status and round, and how many have each id: (kind, value, n)."""
    sets = phrases.selectExpr("*", "cast(first_seen_round as string) as round_").groupingSets(
        [["source_type"], ["processed_status"], ["round_"], []], "source_type", "processed_status", "round_"
    ).agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count("cluster_id_A").alias("a"), F.count("cluster_id_B").alias("b"))
    kind = F.when(F.col("g") == 3, "source").when(F.col("g") == 5, "status").when(F.col("g") == 6, "round").otherwise("total")
    rows = sets.select(kind.alias("kind"), F.coalesce("source_type", "processed_status", "round_").alias("value"), "n")
    ids = sets.where("g = 7").select(F.inline(F.array(F.struct(F.lit("clustered").alias("kind"), F.lit("A").alias("value"), F.col("a").alias("n")), F.struct(F.lit("clustered").alias("kind"), F.lit("B").alias("value"), F.col("b").alias("n")))))
    return rows.unionByName(ids)


def seed_expansion(phrases: DataFrame) -> DataFrame:
    """A4: phrases of each seed by round (R1:12, R2:3) and source (null: unknown)."""
    c = phrases.groupBy("seed_word", "first_seen_round", F.coalesce("source_type", F.lit("unknown")).alias("source_type")).agg(F.count("*").alias("n"))
    r = c.groupBy("seed_word", "first_seen_round").agg(F.sum("n").alias("n")).groupBy("seed_word").agg(F.array_sort(F.collect_list(F.struct("first_seen_round", "n"))).alias("r"), F.sum("n").alias("total"))
    s = c.groupBy("seed_word", "source_type").agg(F.sum("n").alias("n")).groupBy("seed_word").agg(F.array_sort(F.collect_list(F.struct("source_type", "n"))).alias("s"))
    pair = lambda a, b, p="": lambda x: F.concat(F.lit(p), x[a].cast("string"), F.lit(":"), x[b].cast("string"))
    return r.join(s, "seed_word").select(
        "seed_word", "total", F.array_join(F.transform("r", pair("first_seen_round", "n", "R")), ", ").alias("by_round"), F.array_join(F.transform("s", pair("source_type", "n")), ", ").alias("by_source")
    )


def seed_refresh(seeds: DataFrame, phrases: DataFrame) -> DataFrame:
    """A5: seeds with the number, volume and mean frequency of their phrases, zero without any."""
    p = phrases.groupBy("seed_word").agg(F.count("*").alias("expansion_count"), F.sum("volume").alias("total_volume"), F.floor(F.avg("frequency")).alias("avg_frequency"))
    return seeds.join(p, "seed_word", "left").fillna(0, ["expansion_count", "total_volume", "avg_frequency"])


def counts_with_zeros(df: DataFrame, key: str, domain: list) -> DataFrame:
    """Counts for each value of a fixed list, zeros kept."""
    d = df.sparkSession.createDataFrame([(x,) for x in domain], f"{key} string")
    return d.join(df.groupBy(F.col(key).cast("string").alias(key)).agg(F.count("*").alias("n")), key, "left").fillna(0, ["n"])


def counts_by(df: DataFrame, key: str, missing: str = "unknown") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit(missing)).alias(key)).agg(F.count("*").alias("n"))


def tag_statistics(communities: DataFrame) -> DataFrame:
    """A10: the three tag columns as one, counted."""
    return communities.select(F.explode(F.array("tag1", "tag2", "tag3")).alias("tag")).where("tag is not null").groupBy("tag").agg(F.count("*").alias("n"))


def demand_sources(demands: DataFrame) -> DataFrame:
    """Demands by phase, method and validation: (kind, value, n, avg_confidence)."""
    rows = demands.select(F.inline(F.array(
        F.struct(F.lit("phase").alias("kind"), F.coalesce("source_phase", F.lit("unknown")).alias("value"), "confidence_score"),
        F.struct(F.lit("method").alias("kind"), F.coalesce("source_method", F.lit("unknown")).alias("value"), "confidence_score"),
        F.struct(F.lit("validated").alias("kind"), F.col("is_validated").cast("string").alias("value"), "confidence_score"),
    )))
    return rows.groupBy("kind", "value").agg(F.count("*").alias("n"), F.round(F.avg("confidence_score"), 6).alias("avg_confidence"))


def cluster_summary(phrases: DataFrame, label: str, k: int = 10) -> DataFrame:
    """Clusters other than -1: size, frequency (missing: 1), volume and their k most frequent phrases."""
    p = phrases.where(F.col(label).isNotNull() & (F.col(label) != -1)).select(F.col(label).alias("cluster_id"), "phrase_id", "phrase", F.coalesce("frequency", F.lit(1)).alias("frequency"), "volume")
    top = top_k(p.select("cluster_id", "phrase_id", "phrase", "frequency"), ["cluster_id"], [F.desc("frequency"), F.col("phrase_id")], k)
    examples = top.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("frequency")).alias("f"), "phrase_id", "phrase"))).alias("e"))
    return p.groupBy("cluster_id").agg(F.count("*").alias("size"), F.sum("frequency").alias("total_frequency"), F.sum("volume").alias("total_volume")).join(examples, "cluster_id").select(
        "cluster_id", "size", "total_frequency", "total_volume", F.array_join(F.transform("e", lambda x: x["phrase"]), "; ").alias("example_phrases")
    )


def golden_summary(phrases: DataFrame, *keys: str) -> DataFrame:
    """Clusters, noise among them, with seeds, means, words a phrase and the share of questions."""
    words = F.size(F.split(F.trim("phrase"), r"\s+"))
    question = F.split("phrase", r"\s+")[0].isin(*QUESTION_WORDS)
    return phrases.groupBy(*keys).agg(
        F.count("*").alias("cluster_size"), F.sum("frequency").alias("total_frequency"), F.round(F.avg("frequency"), 6).alias("avg_frequency"),
        F.array_join(F.sort_array(F.collect_set("seed_word")), ", ").alias("seed_words_in_cluster"), F.sum("volume").alias("total_search_volume"), F.round(F.avg("volume"), 6).alias("avg_search_volume"),
        F.round(F.avg(words), 6).alias("avg_word_count"), F.round(F.avg(question.cast("int")), 6).alias("question_ratio"),
    ).withColumn("noise_flag", F.col(keys[-1]) == -1)


def size_report(phrases: DataFrame, label: str) -> DataFrame:
    """Clusters, sizes (upper median) and the share of noise, in one row."""
    sizes = stash(phrases.groupBy(F.col(label).alias("c")).agg(F.count("*").alias("n")), "sizes")
    real = sizes.where("c <> -1")
    n = real.count()
    median = int(order_statistics(real, "n", [n // 2])[0]) if n else None
    return sizes.agg(
        F.count_if(F.col("c") != -1).alias("n_clusters"), F.min(F.when(F.col("c") != -1, F.col("n"))).alias("min_size"), F.max(F.when(F.col("c") != -1, F.col("n"))).alias("max_size"),
        F.round(F.avg(F.when(F.col("c") != -1, F.col("n"))), 6).alias("mean_size"), F.lit(median).cast("long").alias("median_size"),
        F.round(100 * F.coalesce(F.sum(F.when(F.col("c") == -1, F.col("n"))), F.lit(0)) / F.sum("n"), 6).alias("noise_share"),
    )


def parent_rollup(meta: DataFrame, factor: int = 10_000) -> DataFrame:
    """A15."""
    return meta.where("cluster_level = 'B'").groupBy(F.floor(F.col("cluster_id") / factor).alias("parent_id")).agg(F.count("*").alias("n_children"), F.sum("size").alias("size"))


def missing_meta(phrases: DataFrame, meta: DataFrame) -> DataFrame:
    """Summaries of clusters that phrases have and the meta table lacks; ids from 1001 come from a re-split."""
    have = meta.where("cluster_level = 'A'").select("cluster_id")
    return cluster_summary(phrases, "cluster_id_A").join(have, "cluster_id", "left_anti").withColumn("main_theme", F.when(F.col("cluster_id") >= 1001, "re-split").otherwise("restored"))


def confidence_report(labelled: DataFrame, group: str, confidence: str) -> DataFrame:
    """A17."""
    c = labelled.groupBy(group).agg(F.count("*").alias("n"), F.min(confidence).alias("low"), F.max(confidence).alias("high"), F.round(F.avg(confidence), 6).alias("mean"), F.round(F.median(confidence), 6).alias("median"))
    return with_share(c, "n")


def selection_summary(meta: DataFrame) -> DataFrame:
    """A18."""
    a = meta.where("cluster_level = 'A'")
    chosen = lambda c: F.sum(F.when(F.col("is_selected"), F.col(c)))
    return a.agg(
        F.count("*").alias("n_clusters"), F.count("selection_score").alias("n_scored"), F.count_if("is_selected").alias("n_selected"), chosen("size").alias("selected_phrases"), chosen("total_frequency").alias("selected_frequency"),
        F.round(chosen("size") / F.count_if("is_selected"), 6).alias("avg_selected_size"), *[F.count_if(F.col("selection_score") == k).alias(f"score_{k}") for k in range(1, 6)],
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A20."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def score_sizes(meta: DataFrame) -> DataFrame:
    """Clusters by score range and their mean score by size class."""
    size = F.when(F.col("size") < 15, "small").when(F.col("size") <= 150, "medium").otherwise("large")
    s = F.when(F.col("quality_score") >= 85, "85+").when(F.col("quality_score") >= 75, "75+").when(F.col("quality_score") >= 65, "65+").when(F.col("quality_score") >= 60, "60+").otherwise("<60")
    return meta.groupBy(s.alias("score_range"), size.alias("size_class")).agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 6).alias("mean_score"))


def review_time(meta: DataFrame, minutes: float = 381.0, top: int = 20) -> DataFrame:
    """Minutes to review all clusters, those good or better, and the top ones, and what the last saves."""
    a = meta.where("cluster_level = 'A'").agg(F.count("*").alias("n"), F.count_if(F.col("quality_score") >= 60).alias("good"))
    return a.select("n", "good", F.round(minutes * F.col("good") / F.col("n"), 6).alias("good_minutes"), F.round(minutes * F.least(F.lit(top), F.col("n")) / F.col("n"), 6).alias("top_minutes"), F.round(100 * (1 - F.least(F.lit(top), F.col("n")) / F.col("n")), 6).alias("saving"))


def with_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left with how many rows of right share their key."""
    return left.join(right.groupBy(key).agg(F.count("*").alias("n")), key, "left").fillna(0, ["n"])
