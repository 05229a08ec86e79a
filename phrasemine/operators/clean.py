"""Cleaning, validation and filters over the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Rank of sources when they are merged.
SOURCES = ["semrush", "dropdown", "related_search"]


def where_clean(df: DataFrame, phrase: str = "phrase") -> DataFrame:
    """rows with the phrase folded, without those whose phrase does not pass.

    The test is a generated column: a filter on it cannot be pushed below the folding, where it would fold again for each part of the test.
    """
    return df.withColumn(phrase, X.folded(F.col(phrase))).withColumn("_ok", F.explode(F.array(X.valid_phrase(F.col(phrase))))).where("_ok").drop("_ok")


def clean_phrases(df: DataFrame) -> DataFrame:
    """Clean phrase, seed and numbers; rows whose phrase does not pass are dropped."""
    return (
        where_clean(df)
        .withColumn("seed_word", X.clean_seed(F.col("seed_word")))
        .withColumn("frequency", X.to_long(F.col("frequency"), 1)).withColumn("volume", X.to_long(F.col("volume"), 0))
    )


def select_sources(df: DataFrame, names: list[str]) -> DataFrame:
    return df.where(F.col("source_type").isin(*[{"related": "related_search"}.get(n, n) for n in names]))


def with_defaults(df: DataFrame) -> DataFrame:
    none = F.lit(None).cast("int")
    return df.withColumns({"cluster_id_A": none, "cluster_id_B": none, "mapped_demand_id": none, "processed_status": F.lit("unseen")})


def merge_sources(df: DataFrame, round_id: int, order: list[str]) -> DataFrame:
    """A1: one row for each clean phrase: first seed and source in order of sources then `order`; frequencies summed, largest volume."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source_type"))
    place = F.struct(rank, *order)
    first = F.min(F.struct(place.alias("place"), "seed_word", "source_type"))
    return (
        clean_phrases(df).groupBy("phrase").agg(first.alias("f"), F.sum("frequency").alias("frequency"), F.max("volume").alias("volume"))
        .select("phrase", "f.seed_word", "f.source_type", "frequency", "volume", F.lit(round_id).alias("first_seen_round"))
    )


def first_spellings(df: DataFrame, keyword: str, order: list[str]) -> DataFrame:
    """keywords with a Latin letter, without case-insensitive repeats, in their first spelling."""
    k = F.trim(F.col(keyword))
    w = df.withColumn(keyword, k).where(k.rlike("[a-zA-Z]")).withColumn("_k", F.lower(keyword))
    return w.groupBy("_k").agg(F.min_by(keyword, F.struct(*order)).alias(keyword)).drop("_k")


def valid_products(df: DataFrame) -> DataFrame:
    """products with a name, a price in 0..999999 and a rating in 0..5; a missing URL is made from the name."""
    ok = F.col("product_name").isNotNull() & (F.trim("product_name") != "") & F.coalesce(F.col("price").between(0, 999999), F.lit(True)) & F.coalesce(F.col("rating").between(0, 5), F.lit(True))
    made = F.concat(F.lit("https://placeholder.com/product/"), F.substring(F.md5("product_name"), 1, 8))
    return df.where(ok).withColumn("url", F.when(F.coalesce(F.trim("url"), F.lit("")) == "", made).otherwise(F.col("url")))


def clean_communities(df: DataFrame, batch: str) -> DataFrame:
    """F8: named, not negative, the row with most subscribers for each name."""
    c = df.where("name is not null").withColumn("subscribers", X.to_long(F.col("subscribers"), 0)).where("subscribers >= 0")
    blank = F.col("description").isNull() | F.trim("description").isin("", "None")
    w = Window.partitionBy("name").orderBy(F.desc("subscribers"), "subreddit_id")
    return (
        c.withColumn("ai_analysis_status", F.when(blank, "skipped").otherwise("pending")).withColumn("import_batch_id", F.lit(batch))
        .withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    )


def where_equal(df: DataFrame, filters: dict) -> DataFrame:
    for name, value in filters.items():
        if value is not None:
            df = df.where(F.col(name).isin(*value) if isinstance(value, (list, tuple)) else F.col(name) == F.lit(value))
    return df


def page(df: DataFrame, filters: dict, order: list, number: int, size: int) -> tuple[DataFrame, DataFrame]:
    """one page of the rows, and the number of all rows that pass."""
    rows = where_equal(df, filters)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size), rows.agg(F.count("*").alias("total"))


def newest_round(df: DataFrame) -> DataFrame:
    top = df.agg(F.max("first_seen_round").alias("_top"))  # one row
    return df.join(F.broadcast(top), F.col("first_seen_round") == F.col("_top")).drop("_top")


def search(df: DataFrame, *tests: Column | None) -> DataFrame:
    """Rows that pass all tests given; tests that are None count as not asked for."""
    for t in tests:
        if t is not None:
            df = df.where(t)
    return df


def text_has(word: str, *cols: str) -> Column:
    test = F.lit(False)
    for c in cols:
        test = test | F.coalesce(F.contains(F.lower(c), F.lit(word.lower())), F.lit(False))
    return test


def any_tag(cols: list[str], tags: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.filter(F.array(*cols), lambda x: x.isNotNull()), F.array(*[F.lit(t) for t in tags])), F.lit(False))


def check_table(df: DataFrame, required: list[str], most_rows: int = 1_000_000) -> DataFrame:
    """One row that tells whether a data set has the required columns, some rows and not too many."""
    missing = sorted(set(required) - set(df.columns))
    n = df.agg(F.count("*").alias("n_rows"))
    return n.select(
        "n_rows", F.lit(",".join(missing)).alias("missing"),
        (F.lit(not missing) & (F.col("n_rows") > 0) & (F.col("n_rows") <= most_rows)).alias("valid"),
    )
