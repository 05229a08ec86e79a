"""Chat formatting with typed content parts (DataFrame functions only).

A turn is <|turn|>role<|text|>content<|end|>.  Its content is a list of parts: a visitor turns text parts into escaped
text and image, audio and document parts into numbered placeholders, and records what each placeholder stands for.
Escaping puts one backslash after the first character of whatever reads as a control string, on top of those it has
already; unescaping takes one away.  So no text can produce a control string, and every text comes back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this template and of common others: <|, <s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>>.
_REST = r"(\||/?s>|/?INST\]|</?SYS>>)"
ESCAPE, UNESCAPE = rf"(<|\[)(\\*){_REST}", rf"(<|\[)\\(\\*){_REST}"
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
#: Side of an image patch, audio tokens a second, tokens a document page: what a placeholder expands to.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25.0, 512
CHUNK = 64


def escape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPE, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, UNESCAPE, "$1$2$3")


def text_part(text: Column) -> Column:
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[none.alias(n) for n in ("ref", "width", "height", "seconds", "pages")])).cast(PARTS)


def _tokens(p: Column) -> Column:
    """Tokens that an attachment expands to."""
    return (
        F.when(p["type"] == "image", F.ceil(F.coalesce(p["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(p["height"], F.lit(0)) / PATCH))
        .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(0)) * PAGE_TOKENS)
        .otherwise(0).cast("long")
    )


def visit(messages: DataFrame) -> DataFrame:
    """Flatten the parts of each message (conv_id, turn, role, parts): adds content and attachments.

    Text parts become escaped text; others become <|image|>, <|audio|>, <|document|> or <|attachment|> (an unknown type)
    placeholders in order.  Text parts with no placeholder between them are joined before they are escaped, so that none of them can
    finish a control string that another began.  attachments: array of (type, ref, part, tokens); part counts all parts from 0.
    """
    kind = lambda p: F.when(p["type"].isin("image", "audio", "document"), p["type"]).otherwise("attachment")
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    parts = F.coalesce("parts", F.array().cast(PARTS))
    numbered = F.transform(parts, lambda p, i: F.struct(is_text(p).alias("is_text"), i.alias("i")))
    # runs of text end where an attachment stands, and at the end
    ends = F.concat(F.transform(F.filter(numbered, lambda x: ~x["is_text"]), lambda x: x["i"]), F.array(F.size(parts)))
    runs = F.transform(ends, lambda end, j: F.struct(F.when(j == 0, 0).otherwise(F.get(ends, j - 1) + 1).alias("start"), end.alias("end")))
    said = lambda r: F.array_join(F.transform(F.slice(parts, r["start"] + 1, r["end"] - r["start"]), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    shown = F.transform(runs, lambda r: F.concat(escape(said(r)), F.when(r["end"] < F.size(parts), F.concat(F.lit("<|"), kind(F.get(parts, r["end"])), F.lit("|>"))).otherwise("")))
    placed = F.transform(parts, lambda p, i: F.struct(kind(p).alias("type"), p["ref"].alias("ref"), i.alias("part"), _tokens(p).alias("tokens"), is_text(p).alias("is_text")))
    attached = F.transform(F.filter(placed, lambda p: ~p["is_text"]), lambda p: F.struct(p["type"], p["ref"], p["part"], p["tokens"]))
    return messages.withColumn("content", F.array_join(shown, "")).withColumn("attachments", attached)


def format_conversations(messages: DataFrame, train_role: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_runs, attachments, attachment_tokens.

    messages: conv_id, turn, role, parts.  Turns stand by turn number (null first), then by role and content, so ties
    and repeated rows have one order.  An empty table gives no rows; texts of any length are kept whole; further columns of
    messages are not read, whatever their names.  loss_runs holds for each turn how many code points the loss mask skips, covers
    and skips again; it covers the content of train_role.  Null roles are empty.  Long conversations are joined in
    chunks of CHUNK turn numbers first; only the finished chunks of a conversation meet in one group.
    """
    header = F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit(""))), F.lit(TEXT))
    m = visit(messages).select(
        "conv_id", "turn", F.expr(f"turn div {CHUNK}").alias("chunk"), "role", "content",
        F.concat(header, "content", F.lit(END)).alias("line"),
        F.struct(
            F.length(header).alias("skip"),
            F.when(F.col("role") == train_role, F.length("content")).otherwise(0).alias("take"),
            (F.when(F.col("role") == train_role, 0).otherwise(F.length("content")) + len(END)).alias("tail"),
        ).alias("run"),
        "attachments",
    )
    chunk = m.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content", "line", "run", "attachments"))).alias("t")).select(
        "conv_id", "chunk", F.array_join(F.transform("t", lambda x: x["line"]), "").alias("line"),
        F.transform("t", lambda x: x["run"]).alias("runs"), F.flatten(F.transform("t", lambda x: x["attachments"])).alias("attachments"),
    )
    whole = chunk.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "line", "runs", "attachments"))).alias("c"))
    return whole.select(
        "conv_id", F.array_join(F.transform("c", lambda x: x["line"]), "").alias("formatted"),
        F.flatten(F.transform("c", lambda x: x["runs"])).alias("loss_runs"),
        F.flatten(F.transform("c", lambda x: x["attachments"])).alias("attachments"),
    ).withColumn("attachment_tokens", F.expr("aggregate(attachments, 0L, (a, x) -> a + x.tokens)"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations: adds turns (role, text) and loss, the unescaped texts under the mask."""
    pieces = F.split("formatted", r"<\|end\|>", -1)
    lines = F.slice(pieces, 1, F.size(pieces) - 1)
    turns = F.transform("lines", lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(TURN) + 1, 2**31 - 1 - 64), TEXT, 1)).alias("role"),
        unescape(F.substring_index(p, TEXT, -1)).alias("text"),
    ))
    covered = F.transform(F.arrays_zip("lines", "loss_runs"), lambda x: unescape(F.substr(x["lines"], x["loss_runs"]["skip"] + 1, x["loss_runs"]["take"])))
    return formatted.withColumn("lines", lines).withColumn("turns", turns).withColumn("loss", F.array_join(covered, "")).drop("lines")


def digests(messages: DataFrame) -> DataFrame:
    """The contract's columns, all derived from the formatted output: a row for each conversation, a null conv_id being one; none for an empty table.

    Further columns are not read; a conversation's turns, however long, are read back in one row.
    """
    back = read_back(format_conversations(messages))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def as_messages(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7: a user, then an assistant, both saying what reads as a change of turn elsewhere."""
    return spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )


CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(role, '(<|\[)(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')) + length(regexp_replace(text, '(<|\[)(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(n + 23) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
