"""Registered queries: sources and sinks (S).  Files are written from the tables, read back and compared with them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import shared_dir
from ..operators import clean, relate, stats
from ..sources import files
from .q_stats import SUMMARY
from .registry import Tables, register


def _at(t: Tables) -> str:
    return f"{shared_dir(t.spark)}/phrasemine-files-{uuid.uuid4().hex}"


def _written(t: Tables, source: str, name: str, columns: list[str]) -> str:
    at = _at(t)
    t.kw.where(F.col("source_type") == source).select(*columns).write.option("header", True).option("escape", '"').csv(f"{at}/{source}/{name}.csv")
    return at


@register("s1_semrush_scan", "SELECT phrase, seed_word, 'semrush' AS source_type, CAST(frequency AS VARCHAR) AS frequency, CAST(frequency AS VARCHAR) AS volume FROM kw WHERE source_type = 'semrush'", "kw")
def s1(t: Tables) -> DataFrame:
    return files.read_keywords(t.spark, _written(t, "semrush", "a_processed", ["phrase", "seed_word", "frequency"]), "semrush")


@register("s2_dropdown_scan", "SELECT phrase, seed_word, 'dropdown' AS source_type, CAST(frequency AS VARCHAR) AS frequency, '0' AS volume FROM kw WHERE source_type = 'dropdown'", "kw")
def s2(t: Tables) -> DataFrame:
    return files.read_keywords(t.spark, _written(t, "dropdown", "a_processed", ["phrase", "seed_word", "frequency", "volume"]), "dropdown")


@register("s3_related_scan", "SELECT phrase, seed_word, 'related_search' AS source_type, CAST(frequency AS VARCHAR) AS frequency, '0' AS volume FROM kw WHERE source_type = 'related_search'", "kw")
def s3(t: Tables) -> DataFrame:
    return files.read_keywords(t.spark, _written(t, "related_search", "a_converted", ["phrase", "seed_word", "frequency"]), "related_search")


@register("s4_preferred_files", "SELECT phrase FROM kw WHERE source_type = 'semrush' AND phrase_id % 2 = 0", "kw")
def s4(t: Tables) -> DataFrame:
    at, semrush = _at(t), t.kw.where("source_type = 'semrush'").select("phrase_id", "phrase")
    semrush.select("phrase").write.option("header", True).csv(f"{at}/semrush/x_processed.csv")
    semrush.where("phrase_id % 2 = 0").select("phrase").write.option("header", True).csv(f"{at}/semrush/x_converted.csv")
    return files.read_keywords(t.spark, at, "semrush").select("phrase")


@register("s5_encodings", "SELECT phrase FROM doc WHERE regexp_full_match(phrase, '[\\x{20}-\\x{7E}\\x{A0}-\\x{FF}]+')", "doc")
def s5(t: Tables) -> DataFrame:
    at = _at(t)
    t.doc.where(r"phrase rlike '^[\\x20-\\x7E\\xA0-\\xFF]+$'").select("phrase").write.option("header", True).option("encoding", "ISO-8859-1").option("escape", "\"").csv(at)
    return files.read_csv(t.spark, at, "ISO-8859-1")


@register("s6_normalise_export", "SELECT lower(trim(p_name)) AS phrase, 'brand' AS seed_word, 'semrush' AS source_type, CAST(p_size AS BIGINT) AS frequency, CAST(trunc(p_retailprice) AS BIGINT) AS volume FROM part")
def s6(t: Tables) -> DataFrame:
    return files.normalise_export(t.raw("part"), {"p_name": "phrase", "p_size": "frequency", "p_retailprice": "volume"}, "semrush", F.lit("Brand_export.csv"))


@register("s7_positional_products", "SELECT p_name AS product_name, round(p_retailprice, 2) AS price, CAST(p_size AS INT) AS sales, CAST(p_size AS DOUBLE) / 10 AS rating, 'etsy' AS platform, 'x.csv' AS source_file FROM part")
def s7(t: Tables) -> DataFrame:
    at = _at(t)
    t.raw("part").selectExpr("concat(' ', p_name)", "concat('$', format_number(p_retailprice, 2))", "cast(p_size as string)", "p_size / 10").write.csv(at)
    return files.positional(files.read_csv(t.spark, at, header=False), {"col_0": "product_name", "col_1": "price", "col_2": "sales", "col_3": "rating"}, "etsy", "x.csv")


@register("s8_community_scan", "SELECT name, description, CAST(subscribers AS VARCHAR) AS subscribers FROM communities WHERE description IS NULL OR description <> ' '", "communities")
def s8(t: Tables) -> DataFrame:
    at = _at(t)
    t.communities.where("description is null or description <> ' '").select("name", "description", "subscribers").write.csv(at)
    return files.read_communities(t.spark, at)


@register("s10_round_sink", "SELECT phrase_id, first_seen_round FROM kw WHERE first_seen_round = 2", "kw")
def s10(t: Tables) -> DataFrame:
    at = _at(t)
    files.write_round(t.kw, at)
    return t.spark.read.parquet(at).where("first_seen_round = 2").select("phrase_id", "first_seen_round")


@register("s11_json_sink", "SELECT phrase, volume FROM kw ORDER BY volume DESC, phrase_id LIMIT 100", "kw")
def s11(t: Tables) -> DataFrame:
    at = _at(t)
    files.write_json(t.kw, at, [F.desc("volume"), "phrase_id"], 100)
    return t.spark.read.schema("phrase string, volume long").json(at)


@register("s12_csv_export", "SELECT CAST(product_id AS VARCHAR) AS product_id, product_name FROM products WHERE platform = 'etsy' ORDER BY product_id LIMIT 100000", "products")
def s12(t: Tables) -> DataFrame:
    at = _at(t)
    files.export_csv(clean.where_equal(t.products, {"platform": "etsy"}), at, ["product_id", "product_name"], [F.col("product_id").cast("string")])  # in the order of its text, as exported
    return files.read_csv(t.spark, at)


@register("s13_review_sheet", f"SELECT cluster_id, size, total_frequency, CASE WHEN length(example_phrases) > 150 THEN example_phrases[1:147] || '...' ELSE example_phrases END AS example_phrases, '' AS selection_score FROM ({SUMMARY.format(label='cluster_id_A', more='')})", "doc")
def s13(t: Tables) -> DataFrame:
    return files.selection_sheet(stats.cluster_summary(t.doc, "cluster_id_A"))


@register("s14_idempotent_append", "SELECT phrase, min(phrase_id) AS phrase_id FROM kw GROUP BY 1", "kw")
def s14(t: Tables) -> DataFrame:
    first = relate.new_by_key(t.kw.where("phrase_id <= 100"), t.kw.limit(0), "phrase", ["phrase_id"])
    more = relate.new_by_key(t.kw.where("phrase_id > 60"), first, "phrase", ["phrase_id"])
    return first.unionByName(more).select("phrase", "phrase_id")


@register("s15_golden_schema", "SELECT cluster_id_A, count(*) AS cluster_size, cluster_id_A = -1 AS noise_flag FROM doc GROUP BY 1", "doc")
def s15(t: Tables) -> DataFrame:
    return stats.golden_summary(t.doc, "cluster_id_A").select("cluster_id_A", "cluster_size", "noise_flag")
