"""Substring de-duplication over sliding runs of sentences.

A text is cut into units that tile it: sentences, each with its terminator (., !, ?, those of other scripts, a line break) and the
white space after it.  A sentence of more than LONG words is cut further, before words whose hash is even, into pieces of LEAST to LONG
words: the cuts depend on the words at hand and come back into step inside a shared passage, whatever stands before it.  In scripts
without spaces each letter counts as a word.  Every run of RUN consecutive units is hashed to 128 bits (case and white space aside), and
the hashes of all documents meet in one shuffle.  The first place of a run, by (doc_id, unit), is the original; units covered by a run
that has an earlier place are removed.

RUN and LONG are chosen by measurement (README): with whole sentences alone a passage of 50 words often has too few of them to be seen,
and with shorter runs chance repeats of one-word sentences go too.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import forget, fresh, stash

RUN, LEAST, LONG = 5, 3, 12
#: Runs that hold one in HOT places of a sample, PROOF places at least, are dealt over DEALS tasks.
HOT, PROOF, DEALS, SAMPLE = 10_000, 16, 256, 1 / 64
#: Letters of scripts without spaces (Thai and Lao, Myanmar, Khmer, Han and kana), and their and other scripts' terminators.
_DENSE = "\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u2FDF\u3003-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\U00020000-\U0003FFFF"
_STOPS = r"\n\u0085\u0589\u061F\u06D4\u0964\u0965\u1362\u2026\u2028\u2029\u203C\u2047-\u2049\u3002\uFF01\uFF0E\uFF1F\uFF61"
_END = re.compile(rf"[.!?]+[\"'”’»)\]]*(?=\s|\Z)\s*|[{_STOPS}]+\s*")
_HAS_DENSE = re.compile(f"[{_DENSE}]")
_WORD = re.compile(rf"[{_DENSE}]|[^\s{_DENSE}]+")
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Even(dict):
    """Word -> whether a long sentence may be cut before it; remembered for the words of late."""

    def __missing__(self, word: str) -> bool:
        if len(self) > 300_000:
            self.clear()
        self[word] = even = zlib.crc32(word.encode("utf-8", "surrogatepass")) % 2 == 0
        return even


_even = _Even()


def _pieces(words: list[str]) -> list[int]:
    """Where the pieces of a sentence start, as places in its lower-case words."""
    if len(words) <= LONG:
        return [0]
    starts = [0]
    for k, even in enumerate(map(_even.__getitem__, words)):
        if (size := k - starts[-1]) >= LEAST and even or size >= LONG:
            starts.append(k)
    return starts


def _sentences(text: str) -> Iterator[tuple[int, str]]:
    """(start, sentence with what follows it); they tile the text."""
    at = 0
    for m in _END.finditer(text):
        yield at, text[at : m.end()]
        at = m.end()
    if at < len(text):
        yield at, text[at:]


def units(text: str | None) -> list[str]:
    """The units of a text in order, in lower case, words joined by one space; stretches without words are none."""
    out = []
    for _, s in _sentences(text or ""):
        low = s.lower()
        words = low.split() if low.isascii() or not _HAS_DENSE.search(low) else _WORD.findall(low)
        if len(words) <= LONG:
            if words:
                out.append(" ".join(words))
        else:
            starts = _pieces(words)
            out += [" ".join(words[a:b]) for a, b in zip(starts, [*starts[1:], len(words)])]
    return out


def bounds(text: str) -> list[int]:
    """Where each unit of units(text) begins, and the end: text[b[k]:b[k + 1]] is unit k with the white space about it."""
    out = []
    for at, s in _sentences(text):
        low = s.lower()
        found = list(_WORD.finditer(low if len(low) == len(s) else s))  # some letters grow when lowered
        if len(found) > LONG:
            out += [at + found[k].start() for k in _pieces([m[0].lower() for m in found])]
        elif found:
            out.append(at + found[0].start())
    return [0, *out[1:], len(text)] if out else [0]


def run_hashes(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run of RUN units."""
    if len(found) < RUN:
        none = np.empty(0, dtype=np.int64)
        return none, none
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, found)), dtype=np.uint64).reshape(-1, 2)
    n = len(found) - RUN + 1
    a, b = h[:n, 0].copy(), h[:n, 1].copy()
    for k in range(1, RUN):
        a, b = a * _P + h[k : n + k, 0], b * _Q + h[k : n + k, 1]
    return a.view(np.int64), b.view(np.int64)


_RUNS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("deal", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("i", pa.int32())])


def _runs(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    """(doc_id, th, deal, a, b, i): the runs of each text; deal: 0, but for hot runs 1 to DEALS.

    The columns stand so that what changes from row to row is one stretch of 17 bytes, which is what a shuffle's compression leaves.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [[], []]
            sizes = np.zeros(batch.num_rows, dtype=np.int64)
            for k, text in enumerate(batch.column("text")):
                a, b = run_hashes(units(text.as_py()))
                sizes[k] = len(a)
                cols[0].append(a)
                cols[1].append(b)
            rows = np.repeat(np.arange(batch.num_rows), sizes)
            if not len(rows):
                continue
            places = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            a, b = np.concatenate(cols[0]), np.concatenate(cols[1])
            deal = np.where(np.isin(a, hot), rows % DEALS + 1, 0)
            take = pa.array(rows)
            own = [batch.column("doc_id").take(take), batch.column("th").take(take)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(deal, pa.int32()), pa.array(a), pa.array(b), pa.array(places, pa.int32())], schema=_RUNS)

    return texts.mapInArrow(runs, "doc_id long, th long, deal int, a long, b long, i int")


def _hot(texts: DataFrame) -> np.ndarray:
    """First hashes of runs so common in a sample of the rows that one task should not get all their places; HOT at most."""
    some = stash(_runs(texts.sample(SAMPLE, 7), np.empty(0, dtype=np.int64)).select("a"), "sample")
    least = max(PROOF, some.count() / HOT)
    hot = [r.a for r in some.groupBy("a").count().where(F.col("count") >= least).collect()]
    forget(some)
    return np.array(hot, dtype=np.int64)


def _hash(text: Column) -> Column:
    """With doc_id this tells documents apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def repeated_units(docs: DataFrame) -> DataFrame:
    """(doc_id, th, drop, first_doc_ids): documents with units to remove; drop: their places, ascending.

    The runs are shuffled once, without text, and only those with an earlier place are kept.  The places of a hot run are dealt over
    many tasks, which pass all of them on; their first places, a row for each hot run, are taken by partial minima.
    """
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long"), _hash(F.col("text")).alias("th"), "text")
    runs = _runs(texts, _hot(texts))
    places = Window.partitionBy("a", "b", "deal").orderBy("doc_id", "th", "i")
    ranked = runs.select("*", F.rank().over(places).alias("rank"), F.first("doc_id").over(places).alias("first_doc_id"))
    is_hot = F.col("deal") > 0
    kept = stash(
        ranked.where((F.col("rank") > 1) | is_hot)
        .select("doc_id", "th", "i", "first_doc_id", is_hot.alias("hot"), *[F.when(is_hot, F.col(c)).alias(c) for c in ("a", "b")]),
        "runs",
    )
    place = F.struct("doc_id", "th", "i")
    firsts = kept.where("hot").groupBy("a", "b").agg(F.min(place).alias("first"))
    again = (
        kept.join(F.broadcast(firsts), ["a", "b"], "left").where(~F.col("hot") | ~place.eqNullSafe(F.col("first")))
        .select("doc_id", "th", "i", F.when(F.col("hot"), F.col("first.doc_id")).otherwise(F.col("first_doc_id")).alias("first_doc_id"))
    )
    out = stash(
        again.groupBy("doc_id", "th").agg(F.collect_set("i").alias("at"), F.array_sort(F.collect_set("first_doc_id")).alias("first_doc_ids"))
        .select("doc_id", "th", F.expr(f"array_sort(array_distinct(flatten(transform(at, i -> sequence(i, i + {RUN - 1})))))").alias("drop"), "first_doc_ids"),
        "repeats",
    )
    forget(kept)
    return out


@F.pandas_udf(StringType())
def _without(texts: pd.Series, drops: pd.Series) -> pd.Series:
    out = []
    for text, drop in zip(texts, drops):
        if text is None or drop is None:
            out.append(text)
            continue
        b, gone = bounds(text), set(map(int, drop))
        out.append("".join(text[b[k] : b[k + 1]] for k in range(len(b) - 1) if k not in gone))
    return pd.Series(out, dtype=object)


def remove_repeats(docs: DataFrame, changed_only: bool = False) -> DataFrame:
    """docs with text cleaned of repeated units; adds n_removed (units) and first_doc_ids.

    first_doc_ids: documents that hold the first places of what was removed.  A null text stays null, an empty one empty; texts of
    fewer than RUN units are left as they are.  Rows that repeat doc_id and text count as one document and get the same text.  A null
    doc_id comes first.  Columns of docs named like the added ones are replaced, all others kept, whatever their names.  An empty
    table gives no rows.  changed_only: documents that lose something.
    """
    flagged = repeated_units(docs).withColumnRenamed("doc_id", "_id")
    th = fresh(docs, "_th")
    d = docs.withColumn(th, _hash(F.col("text")))
    out = d.join(flagged, (d[th] == flagged["th"]) & d["doc_id"].eqNullSafe(flagged["_id"]), "inner" if changed_only else "left")
    drop = flagged["drop"]
    cleaned = F.when(drop.isNotNull(), _without(F.when(drop.isNotNull(), d["text"]), drop)).otherwise(d["text"])
    return out.select(
        *[cleaned.alias("text") if c == "text" else d[f"`{c}`"] for c in docs.columns if c.lower() not in ("n_removed", "first_doc_ids")],
        F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_removed"), flagged["first_doc_ids"],
    )
