"""Request tables for annotation by an outside model, and response tables parsed and validated.  No call is made here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relate import numbered

from .tokens import top_k

DEMAND_TYPES = ["tool", "content", "service", "education", "other"]


def numbered_batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows with batch and place in it, in order of the key."""
    return numbered(df, [key]).withColumn("batch", F.floor((F.col("number") - 1) / size)).withColumn("place", F.col("number") - 1 - F.col("batch") * size).drop("number")


def batch_requests(df: DataFrame, key: str, size: int) -> DataFrame:
    """One prompt line list for each batch."""
    b = numbered_batches(df, key, size)
    return b.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("place", key))).alias("x")).select("batch", F.array_join(F.transform("x", lambda r: F.concat((r["place"] + 1).cast("string"), F.lit(". "), r[key])), "\n").alias("prompt"), F.size("x").alias("n"))


def theme_requests(clusters: DataFrame, k: int = 10) -> DataFrame:
    """L1: the first examples of each cluster as a prompt."""
    return clusters.select("cluster_id", F.array_join(F.slice(F.split("example_phrases", "; "), 1, k), "\n").alias("prompt"))


def json_of(text: Column) -> Column:
    """The JSON object or array in a reply, without code fences and words around it."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    return F.coalesce(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1), F.lit("")), bare)


def parse_themes(replies: DataFrame) -> DataFrame:
    """L1: (cluster_id, reply) -> theme, confidence; text that is no JSON is the theme itself, medium."""
    p = replies.withColumn("j", F.from_json(json_of(F.col("reply")), "theme string, confidence string"))
    return p.select("cluster_id", F.coalesce("j.theme", F.trim("reply")).alias("theme"), F.when(F.col("j.theme").isNull(), "medium").otherwise(F.coalesce("j.confidence", F.lit("medium"))).alias("confidence"))


def fallback_themes(clusters: DataFrame) -> DataFrame:
    return clusters.select("cluster_id", F.array_join(F.slice(F.split("example_phrases", "; "), 1, 3), ", ").alias("theme"))


def card_requests(members: DataFrame, framework: DataFrame, phrases: int = 30) -> DataFrame:
    """L2: prompts of up to `phrases` phrases and the given tokens of each cluster."""


    p = top_k(members.select("cluster_id", "phrase_id", "phrase"), ["cluster_id"], [F.col("phrase_id")], phrases).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("phrase_id", "phrase"))).alias("p"))
    f = framework.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_set("token")), ", ").alias("tokens"))
    return p.join(f, "cluster_id", "left").select("cluster_id", F.concat_ws("\n---\n", F.array_join(F.transform("p", lambda x: x["phrase"]), "\n"), "tokens").alias("prompt"))


def parse_cards(replies: DataFrame) -> DataFrame:
    """L2: demand cards; priority becomes business value; a reply that is no JSON gives the default card."""
    c = F.from_json(json_of(F.col("reply")), "title string, description string, demand_type string, priority string")
    p = replies.withColumn("c", c)
    ok = F.col("c.title").isNotNull()
    return p.select(
        "cluster_id", F.coalesce("c.title", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))).alias("title"), F.coalesce("c.description", F.lit("")).alias("description"),
        F.when(F.col("c.demand_type").isin(*DEMAND_TYPES), F.col("c.demand_type")).otherwise("other").alias("demand_type"),
        F.when(F.col("c.priority").isin("high", "medium", "low"), F.col("c.priority")).otherwise("unknown").alias("business_value"), ok.alias("parsed"),
    )


def parse_token_types(tokens: DataFrame, replies: DataFrame) -> DataFrame:
    """L3: (token, batch) with the type and confidence of its batch's reply; other and low where it says nothing."""
    items = replies.select("batch", F.explode(F.from_json(json_of(F.col("reply")), "array<struct<token:string,token_type:string,confidence:string>>")).alias("x")).select("batch", "x.*")
    first = items.where("token is not null").groupBy("batch", "token").agg(F.min(F.struct("token_type", "confidence")).alias("x"))
    return tokens.join(first, ["batch", "token"], "left").select("token", F.coalesce("x.token_type", F.lit("other")).alias("token_type"), F.coalesce("x.confidence", F.lit("low")).alias("confidence"))


def parse_translations(words: DataFrame, replies: DataFrame) -> DataFrame:
    """L4: words with their translation; [word] where there is none; words that were not asked for are dropped."""
    t = replies.select(F.explode(F.from_json(json_of(F.col("reply")), "map<string,string>"))).groupBy(F.col("key").alias("word")).agg(F.min("value").alias("t"))
    return words.join(t, "word", "left").select("word", F.coalesce(F.nullif(F.trim("t"), F.lit("")), F.concat(F.lit("["), F.col("word"), F.lit("]"))).alias("translation"))


def validate_labels(replies: DataFrame) -> DataFrame:
    """Label up to 100 and summary up to 500 characters, known types, confidence 0 to 100 (50 without); failed rows flagged."""
    j = F.from_json(json_of(F.col("reply")), "label string, summary string, primary_demand_type string, secondary_demand_types array<string>, confidence string")
    r = replies.withColumn("j", j)
    known = lambda c: F.when(c.isin(*DEMAND_TYPES), c).otherwise("other")
    return r.select(
        "cluster_id", F.substring("j.label", 1, 100).alias("label"), F.substring("j.summary", 1, 500).alias("summary"), known(F.col("j.primary_demand_type")).alias("primary_demand_type"),
        F.array_join(F.transform("j.secondary_demand_types", known), ",").alias("secondary_demand_types"),
        F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.col("j.confidence").try_cast("double"), F.lit(50.0)).cast("int"))).alias("confidence"), F.col("j.label").isNull().alias("failed"),
    )


def parse_assessments(replies: DataFrame) -> DataFrame:
    """Fields named at the start of a line, with either colon; a reply without summary gives its first 200 characters."""
    field = lambda name: F.trim(F.regexp_extract("reply", rf"(?m)^{name}[：:](.*)$", 1))
    return replies.select(
        "cluster_id", F.coalesce(F.nullif(field("摘要"), F.lit("")), F.substring("reply", 1, 200)).alias("summary"), field("价值").alias("value"),
        F.lower(field("推荐")).isin("是", "yes", "true", "推荐").alias("recommended"), F.coalesce(field("置信度").try_cast("double"), F.lit(0.5)).alias("confidence"),
    )


def product_requests(products: DataFrame, statuses: list[str]) -> DataFrame:
    """Products to annotate, with up to 500 characters of description."""
    return products.where(F.col("ai_analysis_status").isin(*statuses)).select("product_id", F.concat_ws("\n", "product_name", F.substring("description", 1, 500)).alias("prompt"))


def parse_products(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Three tags and a fit from each reply, from the object that holds "tags" if there is more around it; failed without one."""
    held = F.regexp_extract("reply", r'(?s)(\{[^{}]*"tags"[^{}]*\})', 1)
    j = F.from_json(F.coalesce(F.nullif(held, F.lit("")), json_of(F.col("reply"))), "tags array<string>, core_need string, virtual_product_fit string")
    r = requests.select("product_id").join(replies, "product_id", "left").withColumn("j", j)
    ok = F.col("j.tags").isNotNull()
    return r.select(
        "product_id", F.array_join(F.slice(F.coalesce("j.tags", F.array().cast("array<string>")), 1, 3), ",").alias("tags"), F.coalesce("j.core_need", F.lit("")).alias("core_need"),
        F.coalesce("j.virtual_product_fit", F.lit("low")).alias("virtual_product_fit"), F.when(ok, "completed").otherwise("failed").alias("ai_analysis_status"),
    )


def community_requests(communities: DataFrame, template: str) -> DataFrame:
    """A prompt template filled with name, description and subscribers."""
    out = F.lit(template)
    for c in ("name", "description", "subscribers"):
        out = F.replace(out, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return communities.select("subreddit_id", out.alias("prompt"))


def parse_communities(requests: DataFrame, replies: DataFrame, tries: int = 3) -> DataFrame:
    """The first good reply of each community, of up to `tries`; failed without one."""
    j = F.from_json(json_of(F.col("reply")), "tag1 string, tag2 string, tag3 string, importance_score int, confidence int")
    good = replies.where(F.col("attempt") <= tries).withColumn("j", j).where("j.tag1 is not null").groupBy("subreddit_id").agg(F.min_by("j", "attempt").alias("j"))
    r = requests.select("subreddit_id").join(good, "subreddit_id", "left")
    return r.select("subreddit_id", "j.tag1", "j.tag2", "j.tag3", F.when(F.col("j.importance_score").isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), F.col("j.importance_score")))).alias("importance_score"), F.when(F.col("j").isNull(), "failed").otherwise("completed").alias("ai_analysis_status"))


def parse_consistency(replies: DataFrame) -> DataFrame:
    """Verdicts on clusters; a reply that cannot be read is consistent, 0.5."""
    j = F.from_json(json_of(F.col("reply")), "is_consistent boolean, consistency_score double, suggested_splits int")
    r = replies.withColumn("j", j)
    return r.select("cluster_id", F.coalesce("j.is_consistent", F.lit(True)).alias("consistent"), F.coalesce("j.consistency_score", F.lit(0.5)).alias("score"), F.col("j.suggested_splits").alias("n_parts"))


def parse_identified(replies: DataFrame) -> DataFrame:
    """Verdicts on variables by batch, code fences aside."""
    x = F.explode(F.from_json(json_of(F.col("reply")), "array<struct<variable_text:string,is_product:boolean,commercial_value:int,category:string>>"))
    return replies.select("batch", x.alias("x")).select("batch", "x.*").where("variable_text is not null")
