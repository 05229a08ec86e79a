"""The operators as registered queries, with production parameters over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontaminate, exact_dedup, html_extract, mixing, secrets, simhash, spans, toxicity, vptree, warc, whitening
from .common import table

DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)
"""


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null and empty html give empty text, repeated rows a row each, an empty table none."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; texts without words have fingerprint zero and are linked, a null doc_id takes the least of its component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold; null and empty texts match nothing, rows that repeat doc_id and text count once, null ids are ids like others."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, a row for every document; a null text is the empty text, of rows that repeat doc_id and text one is kept."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; null texts have size 0, a null source is a source, repeated rows count each."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; null and empty texts have none, repeated rows a row each."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back; a null html is the empty payload, a null page_id is below all others, repeated rows are alike."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation and of the probe; a null text is empty, rows of one turn stand by role and text, null turns first."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.as_messages(rows.unionByName(chat.probe(spark))))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; null and empty texts score like texts without hits, a null doc_id is not held out, repeated rows a row each."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated sentences; null and short texts stay, rows that repeat doc_id and text count as one document."""
    return spans.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between both tokenizers' tokens of every document; texts without tokens have zeros, repeated rows count each, a null doc_id stays null."""
    return alignment.alignment(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on its 32 components of largest variance; vectors that are null or hold null or non-finite entries go, components without variance are none, a null vec_id stays null."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    w = whitening.fit(rows)
    white = whitening.transform(rows, w).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    share, error = F.array(*[F.lit(x) for x in w.explained]), whitening.identity_error(rows, w)
    return white.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("k")).cast("double").alias("explained"), F.lit(error).alias("identity_error")
    )


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest other vectors of every vector whose id is divisible by 100; null, zero and non-finite vectors take no part, nor do null ids, repeated rows count once."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vptree.nearest(rows, rows.where("vec_id % 100 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extract, op2_simhash, op3_decontaminate, op4_exact_dedup, op5_mixing,
        op6_secrets, op7_warc, op8_chat, op9_toxicity, op10_substring_dedup,
        op11_alignment, op12_whitening, op13_nearest,
    )
}
WARC_SQL = """
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest,
    CASE WHEN octet_length(b) >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY b) THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN octet_length(b) >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY b) THEN max(page_id) OVER (PARTITION BY b) END AS refers_to
FROM (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages)
"""
ORACLE: dict[str, str] = {
    "op4_exact_dedup": DEDUP_SQL,
    "op5_mixing": mixing.MIX_SQL.format(docs="documents"),
    "op7_warc": WARC_SQL,
    "op8_chat": chat.CHAT_SQL,
}
