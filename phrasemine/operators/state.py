"""State tables: each upsert is a function (current, changes) -> new table, plus events where the operation logs some.

Event rows: demand_id, event_type, old_value, new_value, change_id.  Applying the same changes twice changes nothing but events,
and those carry the change's id, so that a log can drop them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIT_CONFIDENCE = {"high": 0.75, "medium": 0.6, "low": 0.5}
FIT_SCORE = {"high": 0.9, "medium": 0.7, "low": 0.5}
DEMAND_STATUS = ["idea", "validated", "in_progress", "archived"]
BUSINESS_VALUES = ["high", "medium", "low", "unknown"]


def _both(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join, columns of changes prefixed with new_."""
    c = changes.select(*keys, *[F.col(x).alias(f"new_{x}") for x in changes.columns if x not in keys], F.lit(True).alias("_in"))
    return current.withColumn("_had", F.lit(True)).join(c, keys, "full_outer")


def upsert_words(current: DataFrame, delta: DataFrame) -> DataFrame:
    """Frequencies of the delta added, annotations overwritten where the delta has one, new words inserted."""
    b = _both(current.select("word", "frequency", "pos_tag"), delta.select("word", "frequency", "pos_tag"), ["word"])
    return b.select(
        "word", (F.coalesce("frequency", F.lit(0)) + F.coalesce("new_frequency", F.lit(0))).alias("frequency"), F.coalesce("new_pos_tag", "pos_tag").alias("pos_tag"),
        F.size(F.split("word", " ")).alias("word_count"), F.col("_had").isNull().alias("is_new"),
    )


def load_words(words: DataFrame, least: int) -> DataFrame:
    """E2."""
    return words.where(F.col("frequency") >= least).withColumn("is_ngram", F.col("word_count") > 1)


def mark_roots(words: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes (word, is_root, root_round, root_source) set or clear the mark."""
    b = words.join(changes.select("word", *[F.col(c).alias(f"new_{c}") for c in ("is_root", "root_round", "root_source")]), "word", "left")
    hit = F.col("new_is_root").isNotNull()
    set_ = lambda c: F.when(hit, F.when(F.col("new_is_root"), F.col(f"new_{c}"))).otherwise(F.col(c)).alias(c)
    return b.select("word", F.coalesce("new_is_root", "is_root").alias("is_root"), set_("root_round"), set_("root_source"))


def batch_view(events: DataFrame) -> DataFrame:
    """The latest status of each batch from its log (batch_id, at, status, n)."""
    return events.groupBy("batch_id").agg(F.max_by(F.struct("status", "n"), F.struct("at", "status")).alias("x"), F.min("at").alias("started"), F.max("at").alias("ended")).select("batch_id", "x.status", "x.n", "started", "ended")


def upsert_tokens(current: DataFrame, changes: DataFrame) -> DataFrame:
    """E5: larger count, notes if given, type unchanged; new tokens inserted."""
    b = _both(current, changes, ["token_text"])
    return b.select("token_text", F.coalesce("token_type", "new_token_type").alias("token_type"), F.greatest("in_phrase_count", "new_in_phrase_count").alias("in_phrase_count"), F.coalesce("new_notes", "notes").alias("notes"))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], keep: list[str] = []) -> DataFrame:
    """Given values overwrite, null means not given; columns in keep are only set on insert."""
    b = _both(current, changes, keys)
    out = []
    for c in current.columns:
        if c in keys:
            out.append(F.col(c))
        elif c not in changes.columns:
            out.append(F.col(c))
        else:
            out.append((F.when(F.col("_had"), F.col(c)).otherwise(F.col(f"new_{c}")) if c in keep else F.coalesce(f"new_{c}", c)).alias(c))
    return b.select(*out)


def assign_clusters(phrases: DataFrame, labels: DataFrame) -> DataFrame:
    """Given ids set, and status assigned, noise too; labels: (phrase_id, a, b)."""
    p = phrases.join(labels.select("phrase_id", F.col("a").alias("_a"), F.col("b").alias("_b")), "phrase_id", "left")
    got = F.col("_a").isNotNull() | F.col("_b").isNotNull()
    return p.withColumns({"cluster_id_A": F.coalesce("_a", "cluster_id_A"), "cluster_id_B": F.coalesce("_b", "cluster_id_B"), "processed_status": F.when(got, "assigned").otherwise(F.col("processed_status"))}).drop("_a", "_b")


def reset(phrases: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E9."""
    return phrases.withColumns({"cluster_id_A": F.lit(-1), "processed_status": F.lit("unseen")}), meta.where("cluster_level <> 'A'")


def _event(df: DataFrame, kind: Column | str, old: Column | None = None, new: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select("demand_id", (F.lit(kind) if isinstance(kind, str) else kind).alias("event_type"), (none if old is None else old).alias("old_value"), (none if new is None else new).alias("new_value"), "change_id")


def create_demands(current: DataFrame, new: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Demands (title, confidence, source_ids, change_id) with ids after the largest, a history of one item, and an event created.

    Ids are dealt by prefix sums over hash parts of the change ids, so no task numbers all rows.
    """
    part = F.pmod(F.xxhash64("change_id"), F.lit(64))
    parts = new.groupBy(part.alias("_p")).agg(F.count("*").alias("n"))
    start = parts.withColumn("_s", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_s")
    top = current.agg(F.coalesce(F.max("demand_id"), F.lit(0)).alias("_top"))
    d = new.withColumn("_p", part).join(F.broadcast(start), "_p").join(F.broadcast(top)).withColumn("demand_id", F.col("_top") + F.col("_s") + F.row_number().over(Window.partitionBy("_p").orderBy("change_id")))
    history = F.array(F.struct(F.col("confidence").alias("score"), now.alias("timestamp"), F.lit("created").alias("reason")))
    demands = d.select("demand_id", "title", F.col("confidence").alias("confidence_score"), "source_ids", history.alias("confidence_history"), "change_id")
    return demands.drop("change_id"), _event(demands, "created", None, F.to_json(F.struct("title", "confidence_score")))


def link(current: DataFrame, changes: DataFrame, item: str, score: str, log_updates: bool) -> tuple[DataFrame, DataFrame]:
    """Links by (demand_id, item): scores of existing ones updated, new ones inserted; events linked_*, and updated where asked for."""
    name = item.removesuffix("_id")
    b = _both(current.select("demand_id", item, score), changes.select("demand_id", item, score, "change_id"), ["demand_id", item])
    links = b.select("demand_id", item, F.coalesce(f"new_{score}", score).alias(score))
    e = b.where("_in").withColumnRenamed("new_change_id", "change_id").withColumn("kind", F.when(F.col("_had").isNull(), f"linked_{name}").otherwise("updated"))
    e = e if log_updates else e.where("kind <> 'updated'")
    return links, _event(e, F.col("kind"), F.to_json(F.struct(F.col(score).alias("score"))), F.to_json(F.struct(F.col(item), F.col(f"new_{score}").alias("score"))))


def change_confidence(demands: DataFrame, changes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The last of each demand's changes (demand_id, score, reason, change_id) is its score; all are appended to its history and logged."""
    w = Window.partitionBy("demand_id").orderBy("change_id")
    steps = changes.join(demands.select("demand_id", "confidence_score"), "demand_id").withColumn("old", F.coalesce(F.lag("score").over(w), "confidence_score"))
    fold = steps.groupBy("demand_id").agg(F.max_by("score", "change_id").alias("_score"), F.array_sort(F.collect_list(F.struct("change_id", "score", "reason"))).alias("_h"))
    added = F.transform("_h", lambda x: F.struct(x["score"].alias("score"), now.alias("timestamp"), x["reason"].alias("reason")))
    out = demands.join(fold, "demand_id", "left").withColumns({
        "confidence_score": F.coalesce("_score", "confidence_score"),
        "confidence_history": F.when(F.col("_h").isNotNull(), F.concat("confidence_history", added)).otherwise(F.col("confidence_history")),
    }).drop("_score", "_h")
    return out, _event(steps, "confidence_changed", F.to_json(F.struct(F.col("old").alias("score"))), F.to_json(F.struct("score", "reason")))


def validate(demands: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each validation (demand_id, by, change_id) counts and adds 0.2 to the confidence, up to 1."""
    n = changes.groupBy("demand_id").agg(F.count("*").alias("_n"), F.max_by("by", "change_id").alias("_by"))
    hit = F.col("_n").isNotNull()
    raised = F.expr("round(aggregate(sequence(1, cast(coalesce(_n, 1) as int)), confidence_score, (c, _) -> least(1D, c + 0.2D)), 6)")
    out = demands.join(n, "demand_id", "left").withColumns({
        "is_validated": hit | F.coalesce("is_validated", F.lit(False)), "validation_count": F.coalesce("validation_count", F.lit(0)) + F.coalesce("_n", F.lit(0)),
        "confidence_score": F.when(hit, raised).otherwise(F.col("confidence_score")), "validated_by": F.coalesce("_by", "validated_by"),
    }).drop("_n", "_by")
    return out, _event(changes.join(demands.select("demand_id"), "demand_id", "left_semi"), "validated", None, F.to_json(F.struct("by")))


def demands_from_products(products: DataFrame) -> DataFrame:
    """Products with a core need as new demands, confidence and fit score by fit level."""
    level = F.coalesce("virtual_product_fit", F.lit("low"))
    pick = lambda m: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), level), F.lit(0.5))
    return products.where("trim(coalesce(core_need, '')) <> ''").select(F.trim("core_need").alias("title"), pick(FIT_CONFIDENCE).alias("confidence"), pick(FIT_SCORE).alias("fit_score"), F.array("product_id").alias("source_ids"), F.col("product_id").alias("change_id"))


def backfill(demands: DataFrame) -> DataFrame:
    """Phase and method of demands without one."""
    bare = F.col("source_phase").isNull()
    clustered = F.col("source_cluster_A").isNotNull()
    return demands.withColumns({
        "source_method": F.when(bare, F.when(clustered, "keyword_clustering").otherwise("manual")).otherwise(F.col("source_method")),
        "source_phase": F.when(bare, F.when(clustered, "phase4").otherwise("manual")).otherwise(F.col("source_phase")),
        "confidence_score": F.coalesce("confidence_score", F.lit(0.5)),
    })


def migration_check(demands: DataFrame, columns: list[str]) -> DataFrame:
    """E16."""
    return demands.agg(F.count("*").alias("n"), *[F.count(c).alias(f"with_{c}") for c in columns])


def import_demand_reviews(demands: DataFrame, sheet: DataFrame) -> DataFrame:
    """Valid statuses and values and given notes of a sheet (demand_id, status, business_value)."""
    s = sheet.select("demand_id", F.when(F.col("status").isin(*DEMAND_STATUS), F.col("status")).alias("_s"), F.when(F.col("business_value").isin(*BUSINESS_VALUES), F.col("business_value")).alias("_v"))
    out = demands.join(s, "demand_id", "left")
    return out.withColumns({"updated": F.col("_s").isNotNull() | F.col("_v").isNotNull(), "status": F.coalesce("_s", "status"), "business_value": F.coalesce("_v", "business_value")}).drop("_s", "_v")


def truthy(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "y", "是", "✓")


def import_token_reviews(tokens: DataFrame, sheet: DataFrame, types: list[str]) -> DataFrame:
    """A sheet (token_text, token_type, verified as text): valid types and flags set, new tokens with a type created."""
    s = sheet.withColumn("token_type", F.when(F.col("token_type").isin(*types), F.col("token_type"))).withColumn("verified", F.when(F.col("verified").isNotNull(), truthy(F.col("verified"))))
    b = _both(tokens.select("token_text", "token_type", "verified"), s.select("token_text", "token_type", "verified"), ["token_text"]).where("_had or new_token_type is not null")
    status = F.when(F.col("_had").isNull(), "created").when(F.col("_in"), "updated").otherwise("kept")
    return b.select("token_text", F.coalesce("new_token_type", "token_type").alias("token_type"), F.coalesce("new_verified", "verified").alias("verified"), status.alias("outcome"))


def link_seed_demands(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """Demands added to each seed's set; links: (seed_word, demand_id, is_primary)."""
    g = links.groupBy("seed_word").agg(F.collect_set("demand_id").alias("_d"), F.max(F.when(F.col("is_primary"), F.col("demand_id"))).alias("_p"))
    none = F.array().cast("array<long>")
    return seeds.join(g, "seed_word", "left").withColumns({
        "related_demand_ids": F.array_sort(F.array_union(F.coalesce("related_demand_ids", none), F.coalesce("_d", none))), "primary_demand_id": F.coalesce("_p", "primary_demand_id"),
    }).drop("_d", "_p")


def import_log(rows: DataFrame, kept: DataFrame, by: str) -> DataFrame:
    """For each import: rows read, kept and skipped."""
    k = kept.groupBy(by).agg(F.count("*").alias("imported_rows"))
    t = rows.groupBy(by).agg(F.count("*").alias("total_rows")).join(k, by, "left").fillna(0, ["imported_rows"])
    return t.withColumn("skipped_rows", F.col("total_rows") - F.col("imported_rows")).withColumn("import_status", F.lit("completed"))


def set_default(configs: DataFrame, config_type: str, config_id: int) -> DataFrame:
    """One default of a type; others of the type lose it."""
    return configs.withColumn("is_default", F.when(F.col("config_type") == config_type, F.col("config_id") == config_id).otherwise(F.col("is_default")))


def add_fields(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Fields (field_key, field_type) whose key is new, in order after the last; the registry is a small table."""
    fresh = new.join(registry, "field_key", "left_anti")
    top = registry.agg(F.coalesce(F.max("field_order"), F.lit(0)).alias("_top"))
    added = fresh.join(F.broadcast(top)).withColumn("field_order", F.col("_top") + F.row_number().over(Window.orderBy("field_key"))).drop("_top").withColumn("is_system_field", F.lit(False))
    return registry.unionByName(added.select(*registry.columns))


def custom_columns(products: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """Typed columns of the map custom_fields."""
    kinds = {"number": "double", "date": "date"}
    return products.select("*", *[F.try_element_at("custom_fields", F.lit(k)).try_cast(kinds.get(t, "string")).alias(k) for k, t in fields]).drop("custom_fields")


def archive(phrases: DataFrame, demands: DataFrame, least: int = 10) -> DataFrame:
    """Phrases of stable demands and rare noise are archived; assigned and reviewed ones stay as they are."""
    stable = demands.where("status = 'validated'").select(F.col("demand_id").alias("mapped_demand_id")).withColumn("_s", F.lit(True))
    p = phrases.join(stable, "mapped_demand_id", "left")
    rare = (F.col("cluster_id_A") == -1) & (F.col("frequency") < least)
    return p.withColumn("processed_status", F.when(F.col("_s") | rare, "archived").otherwise(F.col("processed_status"))).drop("_s")
