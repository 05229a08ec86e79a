"""Exact de-duplication by deterministic block naming (DataFrame functions only).

A normalised text is cut into fixed-size blocks of bytes.  Equal blocks get one integer name: the distinct blocks are
put in sorted order by a range shuffle and numbered in that order.  Then adjacent names are paired, the distinct pairs
are sorted and numbered in turn, and so on until each text has a single name.  Names stand for blocks one to one, so
texts with equal (level, name) are identical; no hash decides equality.

Skew: many texts may share a block, and one row may be repeated very often.  A block's occurrences are first dealt over SALTS
groups, each sends one representative on, and only integers take part in the joins that follow, which AQE can split.  Repeated
rows are counted before the names of a text are collected, and are given back in pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, row_key, stash

#: Bytes in a block, groups that the occurrences of one block are dealt over, and repeated rows that are given back at once.
BLOCK, SALTS, PIECE = 4096, 64, 4096


def _numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add `name`: an integer for each row of distinct keys, ascending with the keys."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _first_names(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text_sha256, idx, name): one row for each block of each text."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    blocks = (
        docs.select("doc_id", norm.alias("norm"), F.monotonically_increasing_id().alias("row"))
        .select("doc_id", "row", F.sha2("norm", 256).alias("text_sha256"), F.col("norm").cast("binary").alias("b"))
        .select(
            "doc_id", "row", "text_sha256",
            F.posexplode(F.expr(
                f"transform(sequence(0, greatest(cast((octet_length(b) - 1) div {BLOCK} as int), 0)), i -> substring(b, i * {BLOCK} + 1, {BLOCK}))"
            )).alias("idx", "block"),
        )
        .select("block", F.struct("doc_id", "text_sha256", "idx").alias("at"), F.pmod(F.xxhash64("text_sha256", "row", "idx"), F.lit(SALTS)).alias("salt"))
    )
    # The only shuffle of all text; both branches below need the same columns of it, so they share it.
    # `local`, the least place of a block within its salt, names it there.
    by_place = Window.partitionBy("block", "salt").orderBy("at")
    local = blocks.withColumn("local", F.first("at").over(by_place)).withColumn("nth", F.row_number().over(by_place))
    heads = local.where("nth = 1").select("block", "local")
    # The second one: one row for each distinct block and salt, range-partitioned by block, so the group needs no more.
    mapping = _sorted_groups(heads, parts).select(F.explode("locals").alias("local"), "name")
    l, m = local.select("at", "local").alias("l"), mapping.alias("m")
    same = F.col("l.local").eqNullSafe(F.col("m.local"))
    return l.join(m, same).select(
        row_key(F.col("at.doc_id"), F.col("at.text_sha256")).alias("key"), "at.doc_id", "at.text_sha256", "at.idx", "name"
    )


def _sorted_groups(heads: DataFrame, parts: int) -> DataFrame:
    """(name, locals) of the distinct blocks, sorted by (h, block).

    The hash h only comes first in the order, so that the range bounds are numbers and not sampled text on the driver, and
    blocks with a common beginning spread over partitions; blocks are told apart by their bytes.
    """
    ordered = heads.withColumn("h", F.xxhash64("block")).repartitionByRange(parts, "h")
    grouped = ordered.groupBy("h", "block").agg(F.collect_set("local").alias("locals"))  # at most SALTS each
    return grouped.sortWithinPartitions("h", "block").select(F.monotonically_increasing_id().alias("name"), "locals")


def block_names(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text_sha256, copies, level, name): one row for each distinct (doc_id, normalised text).

    copies counts the rows that share doc_id and normalised text.  Two rows have equal texts exactly when their
    (level, name) are equal.
    """
    first = (
        _first_names(docs)
        .groupBy("key", "doc_id", "text_sha256", "idx", "name").agg(F.count("*").alias("copies"))
        .groupBy("key", "doc_id", "text_sha256")
        .agg(F.max("copies").alias("copies"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda x: x["name"]).alias("names"))
    )
    at = stash(first, "names")
    done, level, older = [], 0, []
    while True:
        done.append(
            at.where("size(names) = 1").select("key", "doc_id", "text_sha256", "copies", F.lit(level).alias("level"), F.col("names")[0].alias("name"))
        )
        open_ = at.where("size(names) > 1")
        if open_.isEmpty():
            break
        pairs = open_.select(
            "key", "doc_id", "text_sha256", "copies",
            F.posexplode(F.expr(
                "transform(sequence(0, cast((size(names) - 1) div 2 as int)), i -> named_struct('a', names[2 * i], 'b', coalesce(get(names, 2 * i + 1), -1L)))"
            )).alias("idx", "pair"),
        ).select("key", "doc_id", "text_sha256", "copies", "idx", "pair.a", "pair.b")
        names = _numbered(pairs.select("a", "b").distinct(), ["a", "b"])
        nxt = (
            pairs.join(names, ["a", "b"])
            .groupBy("key", "doc_id", "text_sha256", "copies")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda x: x["name"]).alias("names"))
        )
        at, level = stash(nxt, "names"), level + 1
        older.append(at)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _identities(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text_sha256, copies, keep_id, group_size): one row for each distinct (doc_id, normalised text)."""
    names = stash(block_names(docs), "identities")
    # a table of its own, so that both sides of the join are plain shuffles and AQE can split a large group
    groups = stash(names.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    return names.join(groups, ["level", "name"]).select("key", "doc_id", "text_sha256", "copies", "keep_id", "group_size")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256, one row for each row of docs.

    Texts are equal when identical after lower-casing A-Z only; a null text is the empty text.  The row with the
    largest doc_id stays; a null doc_id counts below all others.  Of rows that repeat both doc_id and text one stays.
    An empty table gives no rows; further columns of docs are ignored; texts of any length are read whole.
    """
    every = stash(_identities(docs).select("doc_id", "keep_id", "group_size", "text_sha256", "copies"), "identities")
    often = every.where(F.col("copies") > PIECE).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {PIECE}"))))
    # pieces of one row are dealt out
    often = often.repartition("text_sha256", "doc_id", "piece").withColumn("nth", F.explode(F.sequence(F.col("piece") * PIECE, F.least(F.col("copies"), (F.col("piece") + 1) * PIECE) - 1)))
    few = every.where(F.col("copies") <= PIECE).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return few.unionByName(often.drop("piece")).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 0)).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Of rows that repeat doc_id and text one stays, whatever their further columns hold: the least by a hash of these.  Repeated rows,
    however many, are thinned in a map-side combined aggregation; all others are not sorted again.
    """
    key = fresh(docs, "_key")
    kept = stash(_identities(docs).where("doc_id <=> keep_id").select(F.col("key").alias(key), "copies"), "kept")
    repeated = stash(kept.where("copies > 1").select(key), "repeated")
    sha = F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256)
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), sha))
    every = [F.col(f"`{c}`") for c in docs.columns]
    place = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])))
    first = keyed.join(repeated, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*every), place).alias(key + "r")).select(f"{key}r.*")
    return keyed.join(kept.where("copies = 1").select(key), key, "left_semi").drop(key).unionByName(first)
