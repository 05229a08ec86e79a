"""Readers and writers of keyword, product and community files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_seed, to_long

RAW = ["phrase", "seed_word", "source_type", "frequency", "volume"]
#: Rows of CSV exports.
MOST_PRODUCTS, MOST_COMMUNITIES = 100_000, 10_000


def read_csv(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8", header: bool = True, **options) -> DataFrame:
    """Text columns, an encoding that the caller states, no sniffing; a byte-order mark before the first header is dropped."""
    df = spark.read.options(header=header, encoding=encoding, inferSchema=False, multiLine=False, escape='"', **options).csv(paths)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns]) if header else df


def keywords(df: DataFrame, source: str) -> DataFrame:
    """The columns that a source has; volume is the frequency where semrush has none, and 0 in the other sources."""
    out = {c: F.col(c) if c in df.columns else F.lit(None).cast("string") for c in RAW}
    out["source_type"] = F.lit(source)
    if source != "semrush":
        out["volume"] = F.lit("0")
    elif "volume" not in df.columns:
        out["volume"] = out["frequency"]
    return df.select(*[v.cast("string").alias(c) for c, v in out.items()])


def read_keywords(spark: SparkSession, folder: str, source: str, encoding: str = "UTF-8") -> DataFrame:
    """A source's files under folder: *_converted.csv if there are any, else *_processed.csv, else *source* in the root."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for at in (f"{folder}/{source}/*_converted.csv", f"{folder}/{source}/*_processed.csv", f"{folder}/*{source.split('_')[0]}*.csv"):
        if fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(at)):
            return keywords(read_csv(spark, at, encoding), source)
    raise FileNotFoundError(f"no files of {source} under {folder}")


def normalise_export(df: DataFrame, columns: dict[str, str], source: str, file_name: Column | None = None) -> DataFrame:
    """Vendor columns as the phrase schema; the seed is the file's name up to the first underscore; "nan" phrases go."""
    name = F.col("_metadata.file_name") if file_name is None else file_name
    pick = {new: F.col(old) for old, new in columns.items() if old in df.columns}
    phrase = F.lower(F.trim(pick["phrase"]))
    return df.select(
        phrase.alias("phrase"), clean_seed(F.substring_index(F.regexp_replace(name, r"\.[^.]*$", ""), "_", 1)).alias("seed_word"), F.lit(source).alias("source_type"),
        to_long(pick.get("frequency", F.lit("1")), 1).alias("frequency"), to_long(pick.get("volume", F.lit("0")), 0).alias("volume"),
    ).where("phrase is not null and phrase <> 'nan' and phrase <> ''")


def positional(df: DataFrame, mapping: dict[str, str], platform: str, source_file: str) -> DataFrame:
    """A header-free product file by position ({"col_0": "product_name", ...}); money signs stripped, bad numbers 0 or null."""
    at = {name: F.trim(F.col(df.columns[int(pos.rsplit("_", 1)[1])]).cast("string")) for pos, name in mapping.items()}
    num = lambda c: F.regexp_replace(c, r"[$,]", "").try_cast("double")
    for name, f in (("price", lambda c: F.round(num(c), 2)), ("sales", lambda c: F.coalesce(num(c), F.lit(0.0)).cast("int")), ("review_count", lambda c: F.coalesce(num(c), F.lit(0.0)).cast("int")), ("rating", num)):
        if name in at:
            at[name] = f(at[name])
    return df.select(*[c.alias(n) for n, c in at.items()], F.lit(platform).alias("platform"), F.lit(source_file).alias("source_file"))


def read_communities(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Name, description, subscribers by position."""
    return spark.read.schema("name string, description string, subscribers string").option("header", False).csv(paths)


def write_round(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A round's phrases, partitioned by round."""
    df.write.mode("overwrite").partitionBy("first_seen_round").format(fmt).save(path)


def write_json(df: DataFrame, path: str, order: list, limit: int) -> None:
    """The first rows in an order, as JSON."""
    df.orderBy(*order).limit(limit).write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str, columns: list[str], order: list, limit: int = MOST_PRODUCTS) -> None:
    """Chosen columns of at most `limit` rows, with a header."""
    df.orderBy(*order).limit(limit).select(*columns).write.mode("overwrite").option("header", True).csv(path)


def shortened(c: Column, most: int = 150) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def selection_sheet(clusters: DataFrame) -> DataFrame:
    """Clusters for review: shortened examples and an empty score."""
    return clusters.select("cluster_id", "size", "total_frequency", shortened(F.col("example_phrases")).alias("example_phrases"), F.lit("").alias("selection_score"))
