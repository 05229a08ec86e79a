"""The driver's tables in the roles of the engine's inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The same adapters as SQL text.
SQL: dict[str, str] = {
    "doc": r"""SELECT doc_id * 100000 + pos AS phrase_id, phrase, CASE WHEN phrase = '' THEN 'unknown' ELSE split_part(phrase, ' ', 1) END AS seed_word,
        CASE doc_id % 3 WHEN 0 THEN 'semrush' WHEN 1 THEN 'dropdown' ELSE 'related_search' END AS source_type,
        1 + doc_id % 7 AS frequency, n_chars AS volume, CAST(1 + doc_id % 4 AS INT) AS first_seen_round,
        CASE WHEN doc_id % 11 = 0 THEN -1 ELSE CAST(replace(source, 'src', '') AS INT) END AS cluster_id_A,
        CASE WHEN doc_id % 11 = 0 THEN -1 ELSE CAST(CAST(replace(source, 'src', '') AS INT) * 10000 + doc_id % 5 AS INT) END AS cluster_id_B,
        CASE WHEN doc_id % 5 = 0 THEN 'assigned' ELSE 'unseen' END AS processed_status
      FROM (SELECT doc_id, n_chars, source, generate_subscripts(a, 1) - 1 AS pos, regexp_replace(lower(trim(unnest(a))), '\s+', ' ', 'g') AS phrase
        FROM (SELECT doc_id, n_chars, source, regexp_split_to_array(text, '[.!?|\n]+') AS a FROM documents))""",
    "kw": r"""SELECT p_partkey AS phrase_id,
        CASE p_partkey % 8 WHEN 0 THEN 'best ' || p_name || ' for ' || t WHEN 1 THEN 'how to fix ' || p_name WHEN 2 THEN 'free ' || noun || ' tool ' || t
          WHEN 3 THEN adj || ' ' || noun || ' vs ' || t || ' ' || noun WHEN 4 THEN p_name || ' not working ' || t WHEN 5 THEN 'learn ' || noun || ' ' || t || ' tutorial'
          WHEN 6 THEN 'which ' || p_name || ' is better' ELSE p_name || ' ' || t END AS phrase,
        noun AS seed_word, CASE p_partkey % 3 WHEN 0 THEN 'semrush' WHEN 1 THEN 'dropdown' ELSE 'related_search' END AS source_type,
        CAST(p_size AS BIGINT) AS frequency, CAST(trunc(p_retailprice) AS BIGINT) AS volume, CAST(1 + p_partkey % 4 AS INT) AS first_seen_round,
        CAST(replace(p_brand, 'Brand#', '') AS INT) AS cluster_id_A, CAST(CAST(replace(p_brand, 'Brand#', '') AS INT) * 10000 + p_partkey % 3 AS INT) AS cluster_id_B,
        CASE WHEN p_partkey % 5 = 0 THEN 'assigned' ELSE 'unseen' END AS processed_status
      FROM (SELECT *, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun, lower(p_type) AS t FROM part)""",
    "products": r"""SELECT p_partkey AS product_id, p_name AS product_name, p_name || ' ' || lower(p_type) AS description, p_retailprice AS price, p_brand AS shop_name,
        p_size / 10.0::DOUBLE AS rating, CAST(p_partkey % 97 AS INT) AS review_count, CASE WHEN p_partkey % 2 = 0 THEN 'etsy' ELSE 'gumroad' END AS platform,
        'https://shop.example/' || CAST(p_partkey % 1500 AS VARCHAR) AS url,
        CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'failed' END AS ai_analysis_status,
        lower(p_type) AS tag FROM part""",
    "communities": r"""SELECT s_suppkey AS subreddit_id, s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN ' ' ELSE s_name || ' talk' END AS description,
        CAST(floor(s_acctbal) AS BIGINT) AS subscribers, 'tag' || CAST(s_nationkey AS VARCHAR) AS tag1, CASE WHEN s_nationkey % 2 = 0 THEN 'tag' || CAST(s_nationkey % 5 AS VARCHAR) END AS tag2,
        CASE WHEN s_nationkey % 3 = 0 THEN 'even' END AS tag3, CAST(1 + s_suppkey % 5 AS INT) AS importance_score,
        CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN 'pending' WHEN 1 THEN 'completed' ELSE 'failed' END AS ai_analysis_status, 'batch' || CAST(s_suppkey % 2 AS VARCHAR) AS import_batch_id FROM supplier""",
    "demands": r"""SELECT o_orderkey AS demand_id, 'demand ' || CAST(o_orderkey AS VARCHAR) AS title, CASE o_orderstatus WHEN 'O' THEN 'phase1' WHEN 'F' THEN 'phase4' END AS source_phase,
        o_orderpriority AS source_method, CAST(round(o_totalprice / max(o_totalprice) OVER (), 2) AS DOUBLE) AS confidence_score, o_orderkey % 3 = 0 AS is_validated,
        CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'idea' WHEN 1 THEN 'validated' WHEN 2 THEN 'in_progress' ELSE 'archived' END AS status,
        CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'tool' WHEN 1 THEN 'content' WHEN 2 THEN 'service' WHEN 3 THEN 'education' ELSE 'other' END AS demand_type,
        CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'unknown' END AS business_value,
        CAST(11 + o_orderkey % 45 AS INT) AS source_cluster_A, CAST((11 + o_orderkey % 45) * 10000 + o_orderkey % 3 AS INT) AS source_cluster_B FROM orders""",
    "links": r"""SELECT l_orderkey AS demand_id, l_partkey AS product_id, max(round(l_discount * 10, 2)) AS fit_score FROM lineitem GROUP BY 1, 2""",
    "events_": r"""SELECT event_id AS provenance_id, user_id AS demand_id, ts AS created_at, event_type, value AS new_score FROM events""",
    "meta": r"""SELECT cluster_id_A AS cluster_id, 'A' AS cluster_level, CAST(NULL AS INT) AS parent_cluster_id, count(*) AS size, CAST(sum(frequency) AS BIGINT) AS total_frequency,
        (cluster_id_A * 37) % 101 AS quality_score, cluster_id_A % 6 AS intent_no, 30 + (cluster_id_A * 13) % 70 AS dominant_intent_confidence, 1 + cluster_id_A % 5 AS selection_score,
        1 + cluster_id_A % 5 >= 4 AS is_selected FROM kw GROUP BY cluster_id_A
      UNION ALL SELECT cluster_id_B, 'B', CAST(floor(cluster_id_B / 10000) AS INT), count(*), CAST(sum(frequency) AS BIGINT), (cluster_id_B * 37) % 101, cluster_id_B % 6, 30 + (cluster_id_B * 13) % 70,
        1 + cluster_id_B % 5, 1 + cluster_id_B % 5 >= 4 FROM kw GROUP BY cluster_id_B""",
}
_USES = {"meta": ("kw",)}


def closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        for x in (*_USES.get(n, ()), n):
            if x not in out:
                out.append(x)
    return out


_PHRASE_COLUMNS = "phrase_id, phrase, seed_word, source_type, frequency, volume, first_seen_round, cluster_id_A, cluster_id_B, processed_status".split(", ")


def phrases_doc(documents: DataFrame) -> DataFrame:
    """Phrases from the sentences of documents."""
    d = documents.select("doc_id", "n_chars", "source", F.posexplode(F.split("text", r"[.!?|\n]+")).alias("pos", "raw"))
    cluster = F.regexp_replace("source", "src", "").cast("int")
    noise = F.col("doc_id") % 11 == 0
    return d.withColumn("phrase", F.regexp_replace(F.lower(F.trim("raw")), r"\s+", " ")).select(
        (F.col("doc_id") * 100000 + F.col("pos")).alias("phrase_id"), "phrase",
        F.when(F.col("phrase") == "", "unknown").otherwise(F.split_part("phrase", F.lit(" "), F.lit(1))).alias("seed_word"),
        F.expr("case doc_id % 3 when 0 then 'semrush' when 1 then 'dropdown' else 'related_search' end").alias("source_type"),
        (1 + F.col("doc_id") % 7).alias("frequency"), F.col("n_chars").alias("volume"), (1 + F.col("doc_id") % 4).cast("int").alias("first_seen_round"),
        F.when(noise, -1).otherwise(cluster).alias("cluster_id_A"), F.when(noise, -1).otherwise((cluster * 10000 + F.col("doc_id") % 5).cast("int")).alias("cluster_id_B"),
        F.when(F.col("doc_id") % 5 == 0, "assigned").otherwise("unseen").alias("processed_status"),
    )


def phrases_kw(part: DataFrame) -> DataFrame:
    """Search-like phrases from part names and types."""
    p = part.selectExpr("*", "split_part(p_name, ' ', 1) as adj", "split_part(p_name, ' ', 2) as noun", "lower(p_type) as t", "cast(replace(p_brand, 'Brand#', '') as int) as brand")
    return p.selectExpr(
        "p_partkey as phrase_id",
        "case p_partkey % 8 when 0 then concat('best ', p_name, ' for ', t) when 1 then concat('how to fix ', p_name) when 2 then concat('free ', noun, ' tool ', t)"
        " when 3 then concat(adj, ' ', noun, ' vs ', t, ' ', noun) when 4 then concat(p_name, ' not working ', t) when 5 then concat('learn ', noun, ' ', t, ' tutorial')"
        " when 6 then concat('which ', p_name, ' is better') else concat(p_name, ' ', t) end as phrase",
        "noun as seed_word", "case p_partkey % 3 when 0 then 'semrush' when 1 then 'dropdown' else 'related_search' end as source_type",
        "cast(p_size as bigint) as frequency", "cast(p_retailprice as bigint) as volume", "cast(1 + p_partkey % 4 as int) as first_seen_round",
        "brand as cluster_id_A", "cast(brand * 10000 + p_partkey % 3 as int) as cluster_id_B", "case when p_partkey % 5 = 0 then 'assigned' else 'unseen' end as processed_status",
    )


def products(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        "p_partkey as product_id", "p_name as product_name", "concat(p_name, ' ', lower(p_type)) as description", "p_retailprice as price", "p_brand as shop_name", "p_size / 10.0D as rating",
        "cast(p_partkey % 97 as int) as review_count", "case when p_partkey % 2 = 0 then 'etsy' else 'gumroad' end as platform", "concat('https://shop.example/', p_partkey % 1500) as url",
        "element_at(array('pending', 'processing', 'completed', 'failed'), cast(p_partkey % 4 as int) + 1) as ai_analysis_status", "lower(p_type) as tag",
    )


def communities(supplier: DataFrame) -> DataFrame:
    return supplier.selectExpr(
        "s_suppkey as subreddit_id", "s_name as name", "case when s_suppkey % 5 = 0 then null when s_suppkey % 7 = 0 then ' ' else concat(s_name, ' talk') end as description",
        "cast(floor(s_acctbal) as bigint) as subscribers", "concat('tag', s_nationkey) as tag1", "case when s_nationkey % 2 = 0 then concat('tag', s_nationkey % 5) end as tag2",
        "case when s_nationkey % 3 = 0 then 'even' end as tag3", "cast(1 + s_suppkey % 5 as int) as importance_score",
        "element_at(array('pending', 'completed', 'failed'), cast(s_suppkey % 3 as int) + 1) as ai_analysis_status", "concat('batch', s_suppkey % 2) as import_batch_id",
    )


def demands(orders: DataFrame) -> DataFrame:
    top = orders.agg(F.max("o_totalprice").alias("top"))  # one row
    return orders.join(F.broadcast(top)).selectExpr(
        "o_orderkey as demand_id", "concat('demand ', o_orderkey) as title", "case o_orderstatus when 'O' then 'phase1' when 'F' then 'phase4' end as source_phase", "o_orderpriority as source_method",
        "round(o_totalprice / top, 2) as confidence_score", "o_orderkey % 3 = 0 as is_validated",
        "element_at(array('idea', 'validated', 'in_progress', 'archived'), cast(o_orderkey % 4 as int) + 1) as status",
        "element_at(array('tool', 'content', 'service', 'education', 'other'), cast(o_orderkey % 5 as int) + 1) as demand_type",
        "element_at(array('high', 'medium', 'low', 'unknown'), cast(o_custkey % 4 as int) + 1) as business_value",
        "cast(11 + o_orderkey % 45 as int) as source_cluster_A", "cast((11 + o_orderkey % 45) * 10000 + o_orderkey % 3 as int) as source_cluster_B",
    )


def demand_product(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy(F.col("l_orderkey").alias("demand_id"), F.col("l_partkey").alias("product_id")).agg(F.max(F.round(F.col("l_discount") * 10, 2)).alias("fit_score"))


def demand_events(events: DataFrame) -> DataFrame:
    return events.selectExpr("event_id as provenance_id", "user_id as demand_id", "cast(ts as timestamp) as created_at", "event_type", "value as new_score")


def vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.selectExpr("vec_id as phrase_id", "embedding", "label as cluster_id")


def cluster_meta(phrases: DataFrame) -> DataFrame:
    def level(col: str, name: str, parent: str) -> DataFrame:
        return phrases.groupBy(F.col(col).alias("cluster_id")).agg(F.count("*").alias("size"), F.sum("frequency").alias("total_frequency")).selectExpr(
            "cluster_id", f"'{name}' as cluster_level", f"cast({parent} as int) as parent_cluster_id", "size", "total_frequency", "(cluster_id * 37) % 101 as quality_score",
            "cluster_id % 6 as intent_no", "30 + (cluster_id * 13) % 70 as dominant_intent_confidence", "1 + cluster_id % 5 as selection_score", "1 + cluster_id % 5 >= 4 as is_selected",
        )

    return level("cluster_id_A", "A", "null").unionByName(level("cluster_id_B", "B", "floor(cluster_id / 10000)"))
