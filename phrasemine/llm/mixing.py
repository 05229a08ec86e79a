"""Mixing sources to target weights by systematic sampling (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, word_count

WEIGHTS = (5, 2, 1)
CAP = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Targets of sources (is_null, source, source_size): shares by weight, none above cap times its own size.

    Sources stand in code-point order, null last, and take the weights in turn.  Resharing an excess until none is
    above ends at a level L with target = min(cap * size, L * weight); sorted by cap * size / weight, L follows from
    running sums.  The table has one row for each source, so these windows are over source rows, never documents.
    """
    by_name = Window.orderBy("is_null", "source")
    total = Window.partitionBy()
    ratio = Window.orderBy("ratio", "is_null", "source")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = (
        sizes.withColumn("weight", w)
        .withColumn("ceiling", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("ceiling") / F.col("weight"))
        .withColumn("all_size", F.sum("source_size").over(total))
        .withColumn("all_weight", F.sum("weight").over(total))
        .withColumn("capped", F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)))
        .withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("place", F.row_number().over(ratio))
        .withColumn("level", (F.col("all_size") - F.col("capped")) / (F.col("all_weight") - F.col("used")))
    )
    # the first source, in this order, whose ratio the level of the rest does not pass
    fits = F.col("level") <= F.col("ratio")
    level = F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("place"))).over(total)
    return t.withColumn("l", level).select(
        "is_null", "source", "source_size", F.least("ceiling", F.coalesce(F.col("l") * F.col("weight"), F.col("ceiling"))).alias("target")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """Systematic sampling of documents towards their source's target.

    Rows: doc_id, source, size, source_size, target, copies, taken (= copies * size, the words that the mix takes).
    Each document of a source expects target / source_size copies.  Documents of a source stand in order of (bit
    length of size, doc_id modulo the number of chunks, size, doc_id), which spreads long and short ones evenly; their
    expected copies are summed up along it, one random offset is added, and a document is taken once for each
    integer boundary that its share crosses.  No document exceeds `cap` copies, and reruns agree.

    A source may hold any share of the rows: prefix sums are taken within chunks of about sqrt(n) rows first, then
    over chunks.  Null texts have size 0 and so does a text without words; a null source is a source of its own;
    repeated rows count each; an empty table gives no rows.
    """
    # texts are read once, to count their words
    rows = stash(docs.select(
        "doc_id", F.col("source").isNull().alias("is_null"), F.coalesce(F.col("source"), F.lit("")).alias("source"), word_count(F.col("text")).alias("size")
    ), "sizes")
    counts = rows.groupBy("is_null", "source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    most = counts.agg(F.max("n")).first()[0] or 1
    chunks = max(1, int(math.sqrt(most) / 8))
    rows = rows.withColumn("class", F.length(F.bin("size"))).withColumn("bucket", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(chunks)))
    chunk = ["is_null", "source", "class", "bucket"]
    per_source = source_targets(counts.select("is_null", "source", "source_size"), weights, cap)
    start = Window.partitionBy("is_null", "source").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*chunk).agg(F.count("*").alias("n"))
        .withColumn("start", F.coalesce(F.sum("n").over(start), F.lit(0)))
        .join(per_source, ["is_null", "source"])
        .select(*chunk, "start", "source_size", "target")
    )
    # 20 random bits: exact in a double beside any rank below 2**33
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.when(F.col("is_null"), F.lit("\x00")).otherwise(F.col("source")))), 1, 5), 16, 10).cast("double") / F.lit(2.0**20)
    place = Window.partitionBy(*chunk).orderBy("size", "doc_id")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        rows.withColumn("place", F.row_number().over(place))
        .join(offsets, chunk)
        .withColumn("rank", F.col("start") + F.col("place"))
        .withColumn("rate", rate)
        .withColumn("u", u)
        .withColumn("copies", (F.floor(F.col("rank") * F.col("rate") + F.col("u")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("u"))).cast("long"))
        .select(
            "doc_id", F.when(~F.col("is_null"), F.col("source")).alias("source"), "size", "source_size", "target",
            F.least("copies", F.lit(cap)).cast("long").alias("copies"),
        )
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


MIX_SQL = """
WITH r AS (SELECT doc_id, source IS NULL AS is_null, coalesce(source, '') AS source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {docs}),
s AS (SELECT is_null, source, count(*) AS n, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY ALL),
b AS (SELECT greatest(1, CAST(floor(sqrt(max(n)) / 8) AS BIGINT)) AS chunks FROM s),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY is_null, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS ceiling FROM s),
q AS (SELECT *, ceiling / weight AS ratio, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight FROM w),
l AS (SELECT *, (all_size - coalesce(sum(ceiling) OVER o, 0)) / (all_weight - coalesce(sum(weight) OVER o, 0)) AS lvl, row_number() OVER (ORDER BY ratio, is_null, source) AS place FROM q
    WINDOW o AS (ORDER BY ratio, is_null, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT is_null, source, source_size, least(ceiling, coalesce(arg_min(lvl, place) FILTER (lvl <= ratio) OVER () * weight, ceiling)) AS target FROM l),
k AS (SELECT r.*, source_size, target, row_number() OVER (PARTITION BY r.is_null, r.source
    ORDER BY length(bin(size)), coalesce(doc_id, 0) % chunks, size, doc_id NULLS FIRST) AS rank,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix' || CASE WHEN r.is_null THEN chr(0) ELSE r.source END), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u
    FROM r JOIN t ON r.is_null = t.is_null AND r.source = t.source CROSS JOIN b)
SELECT doc_id, size, source_size, target,
    CAST(least(floor(rank * rate + u) - floor((rank - 1) * rate + u), 3) * size AS BIGINT) AS taken FROM k
"""
