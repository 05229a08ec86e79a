"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and underscores in lower case.  Every SEED consecutive words of a benchmark item are a
seed, all its words if it has fewer; documents that share seeds with an item are its candidates, found by equality of seed hashes.  Each
candidate pair is tiled: the longest common runs of unmarked words, found with Karp-Rabin hashes of all windows of one
length, are marked from the longest down, then the length is lowered, to LEAST words at the end.  A document holds an item if its tiles
cover COVER of the item's words, in whatever order they stand.

Seeds that more than COMMON items share (a stock phrase) would pair very many documents with all those items.  Tiles of SEED words or
more that cover COVER of an item hold a certain number of its seeds, so that many, less one, may be left out: of each item
the commonest are.  Items of fewer than SHORTEST words are no passages and match nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import forget, fresh, stash

SEED, LEAST, COVER, COMMON, SHORTEST = 5, 3, 0.8, 8, 2
#: Bytes of distinct benchmark texts, counted first, up to which they go to all tasks, which then tile documents where they stand; beyond
#: it seeds, items and documents meet in joins.
MOST_SENT = 16 << 20
_WORD = re.compile(r"\w+")
_P = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """Word -> 64-bit hash, remembered for the words of late."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_ids = _Ids()


def word_ids(text: str | None) -> np.ndarray:
    words = _WORD.findall((text or "").lower())
    return np.array(list(map(_ids.__getitem__, words)), dtype=np.uint64)


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash, modulo 2**64, of each window of n words."""
    if len(ids) < n:
        return np.empty(0, dtype=np.uint64)
    h = ids[: len(ids) - n + 1].copy()
    for k in range(1, n):
        h = h * _P + ids[k : len(ids) - n + 1 + k]
    return h


def _rolling(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes and powers, which give the hash of any window in one step."""
    power = np.ones(len(ids) + 1, dtype=np.uint64)
    if len(ids):
        power[1:] = np.cumprod(np.full(len(ids), _P, dtype=np.uint64), dtype=np.uint64)
    pre, run = np.zeros(len(ids) + 1, dtype=np.uint64), 0
    p, m = int(_P), (1 << 64) - 1
    for k, x in enumerate(ids.tolist()):
        run = (run * p + x) & m
        pre[k + 1] = run
    return pre, power


def tiles(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item start, document start, length), longest first, no word in two tiles."""
    n, m = len(item), len(doc)
    if min(n, m) < least:
        return []
    a, b = item.tolist(), doc.tolist()
    (pa, power), (pb, power_b) = _rolling(item), _rolling(doc)
    taken_a, taken_b = np.zeros(n, dtype=np.int64), np.zeros(m, dtype=np.int64)
    out, s = [], max(least, min(n, m, 32))
    while True:
        free_a, free_b = np.concatenate(([0], np.cumsum(taken_a))), np.concatenate(([0], np.cumsum(taken_b)))
        ok_a, ok_b = np.nonzero(free_a[s:] == free_a[:-s])[0], np.nonzero(free_b[s:] == free_b[:-s])[0]
        ha, hb = pa[ok_a + s] - pa[ok_a] * power[s], pb[ok_b + s] - pb[ok_b] * power_b[s]
        at: dict[int, list[int]] = {}
        for h, i in zip(ha.tolist(), ok_a.tolist()):
            at.setdefault(h, []).append(i)
        hit = np.isin(hb, ha)
        found, longest = [], 0
        for h, j in zip(hb[hit].tolist(), ok_b[hit].tolist()):
            for i in at[h]:
                if i and j and a[i - 1] == b[j - 1] and not taken_a[i - 1] and not taken_b[j - 1]:
                    continue  # part of a run that starts earlier
                k = 0
                while i + k < n and j + k < m and a[i + k] == b[j + k] and not taken_a[i + k] and not taken_b[j + k]:
                    k += 1
                if k >= s:
                    found.append((k, i, j))
                    longest = max(longest, k)
        if longest > 2 * s:
            s = longest
            continue
        again = False
        for k, i, j in sorted(found, key=lambda t: (-t[0], t[1], t[2])):
            if not taken_a[i : i + k].any() and not taken_b[j : j + k].any():
                taken_a[i : i + k] = taken_b[j : j + k] = 1
                out.append((i, j, k))
            else:
                again = True  # what is left of this run may still be a tile of this length
        if again:
            continue
        if s == least:
            return out
        s = max(least, s // 2)


def _regions(doc: np.ndarray, item: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The document cut down to runs of at least `least` words that the item has somewhere in a row, one gap between runs."""
    hit = np.isin(window_hashes(doc, least), window_hashes(item, least))
    keep = np.zeros(len(doc), dtype=bool)
    for k in range(least):
        keep[k : k + len(hit)] |= hit
    # a gap word that no item has, so that runs do not touch
    edge = np.nonzero(~keep[1:] & keep[:-1])[0] + 1
    out = np.where(keep, doc, np.uint64(0))
    keep[edge] = True
    return out[keep]


def item_seeds(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct seed hashes of an item and at how many places each stands."""
    if len(ids) < SHORTEST:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return np.unique(window_hashes(ids, min(SEED, len(ids))), return_counts=True)


def spare(n_words: int, cover: float) -> int:
    """Places of seeds that an item can do without: if it is covered by tiles of SEED words or more, one of the other places is hit."""
    covered = math.ceil(cover * n_words)
    return max(0, covered - (SEED - 1) * (covered // SEED) - 1) if n_words >= SEED else 0


def compared(item: np.ndarray, doc: np.ndarray) -> tuple[float, int, int, bool]:
    """(coverage of the item, tiles, longest tile, whether the tiles stand in another order than in the item)."""
    least = min(LEAST, len(item))
    t = tiles(item, _regions(doc, item, least), least)
    order = [j for _, j, _ in sorted(t)]
    return sum(k for *_, k in t) / max(1, len(item)), len(t), max((k for *_, k in t), default=0), order != sorted(order)


@dataclass
class Items:
    """A benchmark of bounded size, as it goes to the tasks: ids and words of its items, their seeds, and which items hold each."""

    ids: list[int | None]
    words: list[np.ndarray]
    vocabulary: list[str]
    lengths: list[int]
    seeds: np.ndarray
    starts: np.ndarray
    holders: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]], cover: float) -> Items:
        rows = [(i, t, w) for i, t in rows if len(w := word_ids(t)) >= SHORTEST]
        found = [item_seeds(w) for *_, w in rows]
        seeds, of_seed, shared = np.unique(np.concatenate([h for h, _ in found] or [np.empty(0, np.uint64)]), return_inverse=True, return_counts=True)
        kept: list[tuple[int, int]] = []
        at = 0
        for k, (h, places) in enumerate(found):
            mine = of_seed[at : at + len(h)]
            at += len(h)
            common = np.lexsort((h, -shared[mine]))
            left_out = (np.cumsum(places[common]) <= spare(len(rows[k][2]), cover)) & (shared[mine][common] > COMMON)
            kept += [(int(s), k) for s in mine[common][~left_out]]
        pairs = np.array(sorted(kept), dtype=np.int64).reshape(-1, 2)
        used, starts = np.unique(pairs[:, 0], return_index=True)
        vocabulary = sorted({w for _, t, _ in rows for w in _WORD.findall((t or "").lower())})
        return cls([i for i, *_ in rows], [w for *_, w in rows], vocabulary, sorted({min(SEED, len(w)) for *_, w in rows}), seeds[used], np.append(starts, len(pairs)), pairs[:, 1])


class Finder:
    """text -> the items that it may hold.  Words outside the vocabulary are in no known window, so they need no hash."""

    def __init__(self, items: Items):
        self.items = items
        self.number = {w: k for k, w in enumerate(items.vocabulary, 1)}
        self.hash = np.concatenate((np.zeros(1, np.uint64), word_ids(" ".join(items.vocabulary))))
        self.door = np.zeros(1 << 22, dtype=bool)
        self.door[items.seeds >> np.uint64(42)] = True

    def candidates(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(the items, the document's word hashes, zero for words that no item has)."""
        words = _WORD.findall((text or "").lower())
        k = np.fromiter(map(self.number.get, words, repeat(0)), dtype=np.int32, count=len(words))
        inside = np.concatenate(([0], np.cumsum(k > 0)))
        if inside[-1] < SHORTEST:
            return np.empty(0, np.int64), self.hash[:0]
        ids, places = self.hash[k], []
        for n in self.items.lengths:
            if len(words) < n:
                break
            h = window_hashes(ids, n)[inside[n:] - inside[:-n] == n]
            h = np.unique(h[self.door[h >> np.uint64(42)]])
            at = np.searchsorted(self.items.seeds, h)
            at[at == len(self.items.seeds)] = 0
            places.append(at[self.items.seeds[at] == h] if len(h) else at)
        starts = self.items.starts
        held = [self.items.holders[starts[p] : starts[p + 1]] for p in np.concatenate([*places, np.empty(0, np.int64)])]
        return np.unique(np.concatenate(held)) if held else np.empty(0, np.int64), ids

    def matches(self, text: str | None, cover: float) -> Iterator[tuple]:
        """(item_id, coverage, tiles, longest, reordered) of each item that the text holds."""
        found, ids = self.candidates(text)
        for k in found:
            out = compared(self.items.words[k], ids)
            if out[0] >= cover:
                yield (self.items.ids[k], *out)


def _distinct_items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text").distinct()


def _sent(docs: DataFrame, benchmark: DataFrame, cover: float) -> Broadcast | None:
    """The benchmark for all tasks, or None where it is larger than MOST_SENT."""
    items = _distinct_items(benchmark)
    if (items.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0) > MOST_SENT:
        return None
    return docs.sparkSession.sparkContext.broadcast(Items.of(sorted(((r.item_id, r.text) for r in items.toLocalIterator()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])), cover))


_finders: dict[int, Finder] = {}


def _finder(sent: Broadcast) -> Finder:
    """One for each worker process and benchmark."""
    if id(sent.value) not in _finders:
        _finders.clear()
        _finders[id(sent.value)] = Finder(sent.value)
    return _finders[id(sent.value)]


_MATCH = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64()), ("longest", pa.int64()), ("reordered", pa.bool_())])
_MATCH_DDL = "doc_id long, th long, item_id long, coverage double, n_tiles long, longest long, reordered boolean"


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MATCH)], schema=_MATCH)


def _joined(texts: DataFrame, benchmark: DataFrame, cover: float) -> DataFrame:
    """The same for a benchmark of any size: chosen seeds of items meet seeds of documents in a join, pairs meet their texts."""
    items = stash(_distinct_items(benchmark).withColumn("ih", F.xxhash64("text")), "items")

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_ids(t.as_py()) for t in batch.column("text")]
            found = [item_seeds(w) for w in words]
            sizes = [len(h) for h, _ in found]
            take = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            long = lambda parts: pa.array(np.concatenate([*parts, np.empty(0, np.int64)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(take), batch.column("ih").take(take), long([h.view(np.int64) for h, _ in found]), long([c for _, c in found]),
                 pa.array(np.repeat([min(SEED, len(w)) for w in words], sizes).astype(np.int64)), pa.array(np.repeat([spare(len(w), cover) for w in words], sizes).astype(np.int64))],
                names=["item_id", "ih", "h", "places", "n", "spare"],
            )

    seeds = stash(items.mapInArrow(of_items, "item_id long, ih long, h long, places long, n long, spare long"), "seeds")
    shared = seeds.groupBy("h").agg(F.count("*").alias("shared"))
    commonest = Window.partitionBy("item_id", "ih").orderBy(F.desc("shared"), F.col("h")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = stash(seeds.join(shared, "h").withColumn("upto", F.sum("places").over(commonest)).where(f"not (upto <= spare and shared > {COMMON})").select("h", "item_id", "ih"), "chosen")
    lengths = sorted(r.n for r in seeds.select("n").distinct().collect())  # SEED numbers at most

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [word_ids(t.as_py()) for t in batch.column("text")]
            found = [np.unique(np.concatenate([window_hashes(w, n) for n in lengths] or [w[:0]])).view(np.int64) for w in ids]
            take = pa.array(np.repeat(np.arange(batch.num_rows), [len(h) for h in found]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(np.concatenate([*found, np.empty(0, np.int64)]))], names=["doc_id", "th", "h"])

    pairs = stash(texts.mapInArrow(of_texts, "doc_id long, th long, h long").join(chosen, "h").select("doc_id", "th", "item_id", "ih").distinct(), "pairs")
    d, p, i = texts.dropDuplicates(["doc_id", "th"]).alias("d"), pairs.alias("p"), items.alias("i")
    both = (
        p.join(d, (F.col("d.th") == F.col("p.th")) & F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")))
        .join(i, (F.col("i.ih") == F.col("p.ih")) & F.col("i.item_id").eqNullSafe(F.col("p.item_id")))
        .select("p.doc_id", "p.th", "p.item_id", F.col("d.text").alias("text"), F.col("i.text").alias("item"))
    )

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*key, *compared(word_ids(item), word_ids(text))) for *key, text, item in zip(*(c.to_pylist() for c in batch.columns))]
            if rows := [r for r in rows if r[3] >= cover]:
                yield _as_batch(rows)

    out = stash(both.mapInArrow(tiled, _MATCH_DDL), "tiled")
    for t in (items, seeds, chosen, pairs):
        forget(t)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """doc_id, th, item_id, coverage, n_tiles, longest, reordered: pairs whose tiles cover enough of the item.

    th is the hash of the text that with doc_id identifies a document; rows that repeat both give one row.  Null and
    empty texts match nothing, nor do items of fewer than SHORTEST words.  Rows that share an item_id with different texts are
    items of their own; the pair tells of the one that is covered best.  A null doc_id or item_id is an id like others.  Empty tables
    give no rows, further columns are not read.
    """
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    sent = _sent(docs, benchmark, cover)
    if sent is None:
        found = _joined(texts, benchmark, cover)
    else:

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = _finder(sent)
            for batch in batches:
                rows = [
                    (doc_id, th, *m)
                    for doc_id, th, text in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), batch.column("text"))
                    for m in finder.matches(text.as_py(), cover)
                ]
                if rows:
                    yield _as_batch(rows)

        found = texts.mapInArrow(search, _MATCH_DDL)
    best = F.max(F.struct("coverage", "longest", (-F.col("n_tiles")).alias("n"), "reordered")).alias("b")
    return found.groupBy("doc_id", "th", "item_id").agg(best).select("doc_id", "th", "item_id", "b.coverage", (-F.col("b.n")).alias("n_tiles"), "b.longest", "b.reordered")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns; null and empty texts stay, repeated rows go or stay together."""
    sent = _sent(docs, benchmark, cover)
    if sent is not None:

        def holds(texts: pd.Series) -> pd.Series:
            finder = _finder(sent)
            return pd.Series([next(finder.matches(t, cover), None) is not None for t in texts], dtype=bool)

        return docs.where(~F.pandas_udf(holds, BooleanType())("text"))
    bad = stash(matches(docs, benchmark, cover).select(F.col("doc_id").alias("_id"), "th").distinct(), "contaminated")
    th = fresh(docs, "_th")
    d = docs.withColumn(th, F.xxhash64("text"))
    return d.join(bad, (d[th] == bad["th"]) & d["doc_id"].eqNullSafe(bad["_id"]), "left_anti").drop(th)
