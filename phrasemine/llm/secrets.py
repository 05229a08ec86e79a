"""Secret scan with multipart credential linking (DataFrame functions only).

Base spans come from three patterns.  Weaker parts (account identifiers, short or vaguely named secrets, endpoints)
mean little alone; they are reported only where complementary parts stand close together in one scope.  A scope is a
stretch of text between blank lines.  An interval join links secrets to identifiers in the same scope that start
within WINDOW code points; endpoints count when such a linked secret is near.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, stash

WINDOW = 200
#: In the order in which kinds are listed.  (name, pattern, group whose length counts, least length)
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
WEAK = [
    ("weak_id", r"""(?i:user_?name|user|login|client_?id|account_?id|key_?id|tenant_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""", 0, 0),
    ("weak_key", r"""(?i:\b(?:pass|pwd|passphrase|auth|private_?key|credential)["']?\x20*[:=]\x20*["']?[^\x20\x09-\x0D"']{4,})|(?<![0-9A-Za-z])[0-9a-f]{16,23}(?![0-9A-Za-z])""", 0, 0),
    ("endpoint", r"""(?i:(?:https?|ftp|ssh|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[^\x20\x09-\x0D"'<>]+|\bhost(?:name)?["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,})""", 0, 0),
]
BREAK = ("break", r"\n[\x20\x09\r]*\n", 0, 0)
KINDS = [k for k, *_ in [*BASE, *WEAK]]
_PART = "array<struct<kind:int,pos:int,skip:int,len:int,ok:boolean>>"


def _parts(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Matches of a pattern in order, each as the code points skipped since the last one and its own length."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    return F.transform(
        F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(matches)).alias("before"), matches.alias("m"), kept.alias("g")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), F.length(x["before"]).alias("skip"), F.length(x["m"]).alias("len"), (F.length(x["g"]) >= least).alias("ok")),
    )


def _found(text: Column, kinds: list[tuple]) -> Column:
    none = F.array().cast(_PART)
    return F.concat(*[F.when(text.rlike(p), _parts(text, k, p, g, least)).otherwise(none) for k, (_, p, g, least) in kinds])


def _near(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left that have a row of right in their scope, starting within WINDOW: an interval join by bins."""
    bins = right.select("key", "scope", F.col("start").alias("other"), F.explode(F.expr(f"transform(array(-1, 0, 1), d -> start div {WINDOW} + d)")).alias("bin"))
    l, r = left.withColumn("bin", F.expr(f"start div {WINDOW}")).alias("l"), bins.alias("r")
    same = (F.col("l.key") == F.col("r.key")) & (F.col("l.scope") == F.col("r.scope")) & (F.col("l.bin") == F.col("r.bin"))
    return l.join(r, same & (F.abs(F.col("l.start") - F.col("r.other")) <= WINDOW), "left_semi").drop("bin")


def _key(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("key", row_key(F.col("doc_id"), F.xxhash64("text"), F.length("text")))


def secret_spans(docs: DataFrame) -> DataFrame:
    """(key, kind, start, end): base spans, and weak ones where complementary parts co-occur.

    Positions are code points, end exclusive.  Rows that repeat doc_id and text share a key and count once here.
    """
    text = F.col("text")
    kinds = list(enumerate([*BASE, *WEAK, BREAK]))
    base, keys, rest = kinds[:3], kinds[3:5], [kinds[5], kinds[6]]
    none = F.array().cast(_PART)
    # look for endpoints and breaks only where a weak part or an access key beside another base span makes them matter
    base_link = F.exists("b", lambda x: (x["kind"] == 1) & x["ok"]) & F.exists("b", lambda x: (x["kind"] != 1) & x["ok"])
    parts = (
        _key(docs)
        .withColumn("b", _found(text, base))
        .withColumn("w", _found(text, keys))
        .withColumn("r", F.when((F.size("w") > 0) | base_link, _found(text, rest)).otherwise(none))
        .select("key", F.concat("b", "w", "r").alias("parts"))
        .where("size(parts) > 0")
        .dropDuplicates(["key"])
        .select("key", F.inline("parts"))
    )
    order = Window.partitionBy("key", "kind").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = (
        parts.withColumn("end", F.sum(F.col("skip") + F.col("len")).over(upto))
        .withColumn("start", F.col("end") - F.col("len"))
        .where("ok")
        .withColumn("scope", F.sum(F.when(F.col("kind") == 6, 1).otherwise(0)).over(Window.partitionBy("key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .select("key", "kind", "scope", "start", "end")
        .where("kind <> 6")
    )
    at = stash(at, "spans")
    secrets, ids, ends = at.where("kind in (0, 1, 2, 4)"), at.where("kind in (1, 3)"), at.where("kind = 5")
    # an access key is an identifier and a base span at once; it does not support itself
    linked = stash(_near(secrets.where("kind <> 1"), ids), "linked")
    extra = linked.where("kind = 4").unionByName(_near(ids.where("kind = 3"), secrets.where("kind <> 1"))).unionByName(_near(ends, linked))
    return at.where("kind < 3").unionByName(extra).select("key", "kind", "start", "end")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row for each row of docs.

    spans lists kind:start:end of all spans by start, then kind in the order of KINDS, comma-joined; base_sha256 is
    the digest of the same list of base spans only.  A null or empty text has no spans.
    """
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")

    grouped = secret_spans(docs).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("all"))
    grouped = grouped.select(
        "key",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(listed(F.filter("all", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        listed(F.col("all")).alias("spans"),
    )
    zero = F.lit(0).cast("long")
    return _key(docs).select("doc_id", "key").join(grouped, "key", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS[:3]],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
