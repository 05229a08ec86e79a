"""Joins, set operations, ranks and samples over the engine's tables."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Code points of the patterns that go into one automaton, and of all patterns that automata are made of.
AUTOMATON, MOST_CHARS = 2_000_000, 32_000_000


def contains_join(texts: DataFrame, patterns: DataFrame, text: str, pattern: str, most: int = MOST_CHARS, each: int = AUTOMATON) -> DataFrame:
    """Pairs of a text and a pattern that it contains, anywhere; an empty or null pattern matches nothing.

    The code points of the distinct patterns are counted.  Up to `most` they go to all tasks, in automata of about `each` code points that read
    the texts where they stand, once for each automaton, and find all their patterns at the same time; no text is shuffled.  Beyond `most`, patterns meet texts in equi joins.
    """
    p = patterns.where(F.col(pattern) != "")
    distinct = p.select(F.col(pattern).alias("_p")).distinct()
    chars = distinct.agg(F.coalesce(F.sum(F.length("_p")), F.lit(0))).first()[0]
    if chars > most:
        return _contains_by_runs(texts, p, text, pattern)
    parts = max(1, -(-chars // each))
    found = None
    for part in range(parts):
        own = distinct if parts == 1 else distinct.where(F.pmod(F.xxhash64("_p"), F.lit(parts)) == part)
        hits = _matched(texts, [r[0] for r in own.collect()], text)  # of counted size
        found = hits if found is None else found.unionAll(hits)
    return found.join(p, F.col("_p") == F.col(pattern)).drop("_p")


def _matched(texts: DataFrame, patterns: list[str], text: str) -> DataFrame:
    """Rows of texts with _p: each pattern that their text contains, once."""
    schema = StructType([*texts.schema.fields, StructField("_p", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for i, word in enumerate(patterns):
            automaton.add_word(word, i)
        automaton.make_automaton()
        names = pa.array(patterns, pa.string())
        for b in batches:
            rows, ids = [], []
            for row, value in enumerate(b.column(text).to_pylist() if patterns else []):
                if value:
                    for i in {i for _, i in automaton.iter(value)}:
                        rows.append(row)
                        ids.append(i)
            take = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*take.columns, names.take(pa.array(ids, pa.int64()))], names=[*b.schema.names, "_p"])

    return texts.mapInArrow(run, schema)


def _contains_by_runs(texts: DataFrame, p: DataFrame, text: str, pattern: str) -> DataFrame:
    """Patterns of three words or more hold a whole inner word: texts are exploded into distinct words and met with the patterns by their second word, then verified.

    Shorter ones may be parts of words: they meet texts by a three-letter run, or by any run if shorter still.
    """
    p = p.withColumn("_w", F.split(pattern, " ")).withColumn("_inner", F.get("_w", F.lit(1)))
    words = texts.withColumn("_word", F.explode(F.array_distinct(F.split(text, " "))))
    a = words.join(p.where("size(_w) >= 3").drop("_w"), F.col("_word") == F.col("_inner")).where(F.contains(F.col(text), F.col(pattern))).drop("_word", "_inner")
    parts = p.where("size(_w) < 3").drop("_w", "_inner")
    runs = lambda c: F.expr(f"array_distinct(transform(sequence(1, greatest(length({c}) - 2, 1)), i -> substring({c}, i, 3)))")
    long = parts.where(F.length(pattern) >= 3).withColumn("_run", F.substring(pattern, 1, 3))
    b = texts.withColumn("_t", F.explode(runs(text))).join(long, F.col("_t") == F.col("_run")).where(F.contains(F.col(text), F.col(pattern))).drop("_t", "_run")
    short = parts.where(F.length(pattern) < 3).withColumn("_run", F.col(pattern))
    pieces = F.expr(f"array_distinct(flatten(transform(sequence(1, 2), n -> transform(sequence(1, greatest(length({text}) - n + 1, 1)), i -> substring({text}, i, n)))))")
    b = b.unionByName(texts.withColumn("_t", F.explode(pieces)).join(short, F.col("_t") == F.col("_run")).where(F.contains(F.col(text), F.col(pattern))).drop("_t", "_run"))
    return a.unionByName(b)


def provenance_links(mappings: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Links of demands with the rows that they point to."""
    return mappings.join(items, key)


def provenance_documents(demands: DataFrame, phrases: DataFrame, products: DataFrame, tokens: DataFrame, events: DataFrame) -> DataFrame:
    """One nested row for each demand: its links (demand_id, ...) and its events in order of time."""
    def nested(df: DataFrame, name: str, order: list[str]) -> DataFrame:
        rest = [c for c in df.columns if c not in ("demand_id", *order)]
        return df.groupBy("demand_id").agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))

    out = demands
    for df, name, order in ((phrases, "phrases", ["phrase_id"]), (products, "products", ["product_id"]), (tokens, "tokens", ["token_id"]), (events, "events", ["created_at", "provenance_id"])):
        out = out.join(nested(df, name, order), "demand_id", "left")
    return out


def cluster_tree(meta: DataFrame) -> DataFrame:
    """Clusters of level A with their children of level B."""
    a = meta.where("cluster_level = 'A'").select("cluster_id", "size")
    b = meta.where("cluster_level = 'B'").select(F.col("parent_cluster_id").alias("cluster_id"), F.col("cluster_id").alias("child_id"), F.col("size").alias("child_size"))
    return a.join(b, "cluster_id")


def open_clusters(meta: DataFrame, limit: int | None = None) -> DataFrame:
    """Selected clusters of level A without children, all selected ones if none is left, by size."""
    chosen = meta.where("cluster_level = 'A' and is_selected")
    parents = meta.where("cluster_level = 'B'").select(F.col("parent_cluster_id").alias("cluster_id")).distinct()
    flagged = chosen.join(parents.withColumn("_done", F.lit(True)), "cluster_id", "left")
    left = chosen.join(parents, "cluster_id", "left_anti").agg(F.count("*").alias("_left"))  # one row
    out = flagged.join(F.broadcast(left)).where("_left = 0 or _done is null").orderBy(F.desc("size"), "cluster_id")
    return (out.limit(limit) if limit else out).select("cluster_id", "size")


def seed_status(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """Words with the number of phrases that have them as a seed."""
    n = phrases.groupBy(F.col("seed_word").alias("word")).agg(F.count("*").alias("n"))
    return words.join(n, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("phrase_count"), F.col("n").isNotNull().alias("is_seed"))


def seeds_of(seeds: DataFrame, demand_id: int) -> DataFrame:
    """Seeds with a demand as the primary one or in the JSON list of related ones."""
    listed = F.array_contains(F.from_json("related_demand_ids", "array<long>"), F.lit(demand_id).cast("long"))
    return seeds.where((F.col("primary_demand_id") == demand_id) | F.coalesce(listed, F.lit(False))).dropDuplicates(["seed_word"])


def unregistered_seeds(phrases: DataFrame, seeds: DataFrame) -> DataFrame:
    """J9."""
    return distinct_seeds(phrases).join(seeds, "seed_word", "left_anti")


def new_by_key(incoming: DataFrame, existing: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows whose key is not there yet, the first of each key; rows without a key all stay."""
    w = Window.partitionBy(key).orderBy(*order)
    fresh = incoming.where(F.col(key).isNotNull()).join(existing.select(key).distinct(), key, "left_anti")
    return fresh.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").unionByName(incoming.where(F.col(key).isNull()))


def members(meta: DataFrame, phrases: DataFrame, least: int) -> DataFrame:
    """Clusters of level A of at least so many phrases, with their phrases; noise and null excluded."""
    a = meta.where((F.col("cluster_level") == "A") & (F.col("size") >= least)).select("cluster_id")
    return phrases.where("cluster_id_A is not null and cluster_id_A <> -1").join(a, F.col("cluster_id_A") == F.col("cluster_id")).select("cluster_id", "phrase_id", "phrase")


def distinct_seeds(phrases: DataFrame) -> DataFrame:
    """O2."""
    return phrases.where("seed_word is not null and seed_word <> ''").select("seed_word").distinct()


def inverted(all_: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """O4."""
    return all_.select(key).distinct().join(selected.select(key), key, "left_anti")


def with_share(df: DataFrame, value: str) -> DataFrame:
    """Share of the total."""
    return df.join(F.broadcast(df.agg(F.sum(value).alias("_all")))).withColumn("share", F.round(100 * F.col(value) / F.col("_all"), 6)).drop("_all")


def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with number: 1, 2, ... in order of the keys.  Numbers come from counts of range partitions and places within them, so no task numbers all rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    r = r.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m") - F.shiftleft("_p", 33))
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    start = r.groupBy("_p").agg(F.count("*").alias("n")).withColumn("_s", F.coalesce(F.sum("n").over(upto), F.lit(0))).select("_p", "_s")
    return r.join(F.broadcast(start), "_p").withColumn("number", F.col("_s") + F.col("_i") + 1).drop("_m", "_p", "_i", "_s")


def renumbered(labels: DataFrame, label: str, start: int = 0) -> DataFrame:
    """Labels other than -1 as start, start + 1, ... in their order; ranks are made on the table of distinct labels."""
    order = numbered(labels.where(f"{label} <> -1").select(label).distinct(), [label]).select(label, (F.col("number") - 1 + start).alias("_new"))
    return labels.join(order, label, "left").withColumn(label, F.coalesce("_new", F.lit(-1)).cast("int")).drop("_new")


def sample(df: DataFrame, n: int, seed: int, *cols: str) -> DataFrame:
    """N rows in the order of a seeded hash: the same for the same rows."""
    return df.orderBy(seeded(seed, *cols), *cols).limit(n)


def seeded(seed: int, *cols: str) -> Column:
    """A key that puts rows in a random order, the same for the same seed, in Spark as in SQL."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def confidence_trail(events: DataFrame) -> DataFrame:
    """Each change of a score with the one before."""
    w = Window.partitionBy("demand_id").orderBy("created_at", "provenance_id")
    return events.withColumn("old_score", F.lag("new_score").over(w))
