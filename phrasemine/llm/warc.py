"""Content-addressed WARC archive.

Two tables make an archive.  `payloads` stores the bytes of each distinct payload once, under its SHA-256 and length,
both verified against the bytes when they are read.  `headers` stores each record's exact header block and the digest of its payload.  Joining them
gives back each record byte for byte: header block, payload, two line ends.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, shared_dir, stash

#: Payloads of fewer bytes are stored as responses always.
LEAST_REVISIT = 1000
#: Rows (of two numbers each) up to which the list of copies goes to all tasks.
MOST_SENT = 500_000
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"


@dataclass
class Archive:
    headers: str
    payloads: str


def _payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def _described(pages: DataFrame) -> DataFrame:
    p = pages.select("page_id", "url", _payload(F.col("html")).alias("payload"))
    return p.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"), "payload")


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def header_block(row: DataFrame) -> Column:
    """The header block of a record, up to and with the blank line that ends it."""
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    revisit = F.col("refers_to").isNotNull()
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Target-URI", url),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _record_id(F.col("refers_to"))), _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        _line("X-Payload-Length", F.col("bytes").cast("string")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, "0").otherwise(F.col("bytes").cast("string"))),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str | None = None) -> Archive:
    """Write pages (page_id, url, html) as an archive.

    Of payloads that are equal and have at least LEAST_REVISIT bytes, the record with the largest page_id is the
    response and the others revisit it; all shorter ones are responses.  A null html is the empty payload; a null
    page_id is below all others.  Rows that repeat page_id and payload are responses or revisits alike.
    """
    path = path or f"{shared_dir(pages.sparkSession)}/phrasemine-warc-{uuid.uuid4().hex}"
    meta = stash(_described(pages).drop("payload"), "meta")
    # one page of each distinct payload brings the bytes
    top = meta.groupBy("sha256", "bytes").agg(F.max("page_id").alias("keep"), F.count("*").alias("n"))
    shared = stash(top.where("n > 1"), "shared")
    headers = (
        meta.join(shared.select("sha256", "bytes", "keep"), ["sha256", "bytes"], "left")
        .withColumn("refers_to", F.when((F.col("bytes") >= LEAST_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")))
    )
    headers.select("page_id", "sha256", "bytes", F.encode(header_block(headers), "UTF-8").alias("header"), F.col("refers_to").isNull().alias("has_block")).write.option("compression", "zstd").parquet(f"{path}/headers")
    copies = stash(meta.select("page_id", "sha256").join(shared, "sha256").select(row_key(F.col("page_id"), F.col("sha256")).alias("k"), "sha256", "bytes"), "copies")
    rows = _described(pages).select("page_id", "sha256", "bytes", "payload").withColumn("k", row_key(F.col("page_id"), F.col("sha256")))
    sent = copies.select("k").distinct()
    few = copies.count() <= MOST_SENT
    alone = rows.join(F.broadcast(sent) if few else sent, "k", "left_anti").select("sha256", "bytes", "payload")
    many = rows.join(F.broadcast(sent) if few else sent, "k", "left_semi").select("sha256", "bytes", "payload")
    # map-side combined; only payloads that several pages share are shuffled here
    many = many.groupBy("sha256", "bytes").agg(F.max("payload").alias("payload"))
    alone.write.option("compression", "zstd").parquet(f"{path}/payloads")
    many.write.mode("append").option("compression", "zstd").parquet(f"{path}/payloads")
    return Archive(f"{path}/headers", f"{path}/payloads")


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """(record): the exact bytes of each record.  Fails on a payload whose digest or length is not its address."""
    headers = spark.read.parquet(archive.headers)
    p = spark.read.parquet(archive.payloads)
    good = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("bytes"))
    p = p.select("sha256", F.when(good, F.col("payload")).otherwise(F.raise_error("a stored payload does not match its digest").cast("binary")).alias("payload"))
    end = F.encode(F.lit(CRLF + CRLF), "UTF-8")
    full = headers.where("has_block").join(p, "sha256").select(F.concat("header", "payload", end).alias("record"))
    return full.union(headers.where("not has_block").select(F.concat("header", end).alias("record")))


def parse(records: DataFrame) -> DataFrame:
    """Parse records: page_id, payload_bytes, payload_digest, record_type, refers_to, and payload (null for revisits).

    Fails on a record whose block is not as long as its header says or does not match its digest.
    """
    blank = F.instr(F.decode("record", "ISO-8859-1"), CRLF + CRLF)
    head = F.decode(F.expr("substring(record, 1, blank + 1)"), "UTF-8")
    field = lambda name: F.regexp_extract("head", rf"\n{name}: ([^\r\n]*)\r\n", 1)
    r = records.withColumn("blank", blank).withColumn("head", head)
    r = r.select(
        field("WARC-Type").alias("record_type"),
        F.expr("try_cast(regexp_extract(head, 'WARC-Record-ID: <urn:page:([^>]*)>', 1) as bigint)").alias("page_id"),
        F.expr("try_cast(nullif(regexp_extract(head, 'WARC-Refers-To: <urn:page:([^>]*)>', 1), '') as bigint)").alias("refers_to"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        field("X-Payload-Length").cast("long").alias("payload_bytes"),
        field("Content-Length").cast("int").alias("n"),
        F.expr("substring(record, blank + 4, octet_length(record) - blank - 7)").alias("block"),
    )
    is_response = F.col("record_type") == "response"
    good = (F.octet_length("block") == F.col("n")) & (~is_response | (F.sha1("block") == F.col("payload_digest")))
    return r.select(
        "page_id", "payload_bytes", F.when(good, F.col("payload_digest")).otherwise(F.raise_error("a record does not match its header").cast("string")).alias("payload_digest"),
        "record_type", "refers_to", F.when(is_response, F.col("block")).alias("payload"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as an archive, read it back and parse it: one row for each page."""
    archive = write_archive(pages)
    return parse(read_records(pages.sparkSession, archive)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
