"""Alignment of the tokens that two tokenizers give the same texts.

A is a byte-level vocabulary (a JSON file), B a piece vocabulary with byte fallback (a model file); B puts a space before a text, A gets it with one.
Where a token of each ends at the same byte, both sequences are cut; a group is what stands between two cuts, and its last two tokens are a link.

Counting links corpus-wide has a fast path.  An array gives, for each A id, the B id of the same bytes; a group of one token a side that agrees with it needs only its
A id, so such groups are counted in a vector as long as the vocabulary.  Only the links of other groups are shuffled by id pair.  On the way back, the vector and
the HOT commonest other pairs go to all tasks, both of a bound that does not depend on the corpus; the counts of all other pairs are joined.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import forget, stash

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: How A cuts text before it merges: fixed value of its vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs whose counts go to all tasks; code points that are aligned at once, at least one text; words that a worker remembers the pieces of.
HOT, CHUNK, WORDS = 65_536, 1_000_000, 200_000
MARK = "▁"
BASE = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
ENCODED = f"{BASE}, same array<int>, same_n array<int>, pairs array<long>, pairs_n array<int>"


def byte_letters() -> dict[str, int]:
    """The letter of each byte in A's file: printable ones of Latin-1 stand for themselves, the others for 256 and up, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Pair:
    """Both tokenizers, the bytes of their tokens, and the B id of the same bytes for each A id, -1 if none."""

    def __init__(self, a_path: str, b_path: str):
        self._a_path = a_path
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        special, vocab, letter = {t["content"] for t in spec["added_tokens"]}, spec["model"]["vocab"], byte_letters()
        ranks = {bytes(letter[c] for c in t): i for t, i in vocab.items() if t not in special}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids of A do not follow the order of its merges")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.n_a = max(vocab.values(), default=-1) + 1
        self.a_bytes = [b""] * self.n_a
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.n_b = self.b.get_piece_size()
        self.b_bytes = [self._piece(i) for i in range(self.n_b)]
        # a piece comes before a single byte of the same value
        first = {t: i for t, i in sorted(((t, i) for i, t in enumerate(self.b_bytes) if t), key=lambda x: (not self.b.is_byte(x[1]), -x[1]))}
        self.same = np.array([first.get(t, -1) if t else -1 for t in self.a_bytes], dtype=np.int64)
        self.a_len, self.b_len = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        # pieces have marks at their start only, so merges never cross the start of a word, and words can be remembered
        self._by_word = all(MARK not in self.b.id_to_piece(i).lstrip(MARK) for i in range(self.n_b))
        self._space, self._words = self.b.piece_to_id(MARK), {}
        self._word = re.compile(" *[^ ]+| +")
        self.shown = [f"{i}{end}" for n, end in ((self.n_a, ","), (self.n_a, "|"), (self.n_b, ","), (self.n_b, ";")) for i in range(n)]

    def _piece(self, i: int) -> bytes:
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode()

    def encode_a(self, text: str) -> np.ndarray:
        """A's ids; strings of special tokens are plain text.  Runs of white space that the fast encoder cannot take go to the file's own one."""
        try:
            return self.a.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        except ValueError:
            slow = Tokenizer.from_file(self._a_path)
            slow.encode_special_tokens = True
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.int64)

    def _fits(self, ids: list[int], text: str) -> list[int] | None:
        return ids if b"".join(map(self.b_bytes.__getitem__, ids)) == text.encode() else None

    def encode_b(self, text: str) -> list[int] | None:
        """B's ids of a text, None where their bytes are not those of a space and the text."""
        if MARK in text:  # comes back as a space
            return None
        if not self._by_word:
            return self._fits(self.b.encode(text), " " + text)
        out: list[int] = []
        for word in self._word.findall(" " + text):
            ids = self._words.get(word, 0)
            if ids == 0:
                ids = self._fits([self._space] if word == " " else self.b.encode(word[1:]), word)
                if len(word) <= 64:
                    if len(self._words) >= WORDS:
                        self._words.clear()
                    self._words[word] = ids
            if ids is None:
                return None
            out += ids
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        b = self.encode_b(text) if text else None
        if b is None:
            return None
        a = self.encode_a(" " + text)
        return (a, np.array(b, dtype=np.int64)) if self.a.decode_bytes(a.tolist()) == (" " + text).encode() else None


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    """Once for each Python worker."""
    return Pair(a_path, b_path)


def align(p: Pair, encoded: list[tuple[np.ndarray, np.ndarray]]) -> tuple[dict[str, np.ndarray], list[str]]:
    """Of encoded texts, all at once: counts of each text and their links; the digest of each text's groups.

    Links: key (text, A id) of those in same[] and key (text, A id, B id) of the others, each with its count, in order of the key.
    """
    m = len(encoded)
    count_a, count_b = (np.array([len(x[k]) for x in encoded], dtype=np.int64) for k in (0, 1))
    a, b = (np.concatenate([x[k] for x in encoded]) for k in (0, 1))
    end_a, end_b = np.cumsum(p.a_len[a]), np.cumsum(p.b_len[b])
    cut = np.zeros(end_a[-1] + 1, dtype=np.int8)
    cut[end_a] += 1
    cut[end_b] += 1
    cut_a, cut_b = cut[end_a] == 2, cut[end_b] == 2
    last_a, last_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
    single = (np.diff(last_a, prepend=-1) == 1) & (np.diff(last_b, prepend=-1) == 1)
    text = np.repeat(np.arange(m), count_a)[last_a]
    la, lb = a[last_a], b[last_b]
    regular = single & (p.same[la] == lb)
    same, same_n = np.unique(text[regular] * p.n_a + la[regular], return_counts=True)
    pairs, pairs_n = np.unique((text[~regular] * p.n_a + la[~regular]) * p.n_b + lb[~regular], return_counts=True)
    # tokens in the order of their groups, A's before B's, each as one string with what follows it
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    order = np.empty(len(a) + len(b), dtype=np.int64)
    order[np.arange(len(a)) + np.concatenate(([0], last_b + 1))[group_a]] = a + p.n_a * cut_a
    order[np.arange(len(b)) + (last_a + 1)[group_b]] = b + 2 * p.n_a + p.n_b * cut_b
    stop = np.cumsum(count_a + count_b)
    digests = [hashlib.sha256("".join(map(p.shown.__getitem__, order[lo:hi].tolist()))[:-1].encode()).hexdigest() for lo, hi in zip((stop - count_a - count_b).tolist(), stop.tolist())]
    return {"n_a": count_a, "n_b": count_b, "n_groups": np.bincount(text, minlength=m), "same": same, "same_n": same_n, "pairs": pairs, "pairs_n": pairs_n}, digests


def _lists(owner: np.ndarray, values: np.ndarray, m: int, kind: pa.DataType) -> pa.Array:
    """Lists of m rows from values in the order of their owners."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=m)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))


def encode(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """A row for each row of docs: BASE, the A ids of its regular links (same) and the code of its other links (pairs: A id * 2^32 + B id), with how often each occurs.

    row is unique and is only stable once the result is written.
    """

    def rows(p: Pair, ids: list, texts: list[str | None]) -> pa.RecordBatch:
        encoded = [p.encode(t) if t else None for t in texts]
        at = np.array([i for i, e in enumerate(encoded) if e], dtype=np.int64)
        m = len(texts)
        found, digests = align(p, [e for e in encoded if e]) if len(at) else ({k: np.empty(0, np.int64) for k in ("n_a", "n_b", "n_groups", "same", "same_n", "pairs", "pairs_n")}, [])
        counts = {}
        for k in ("n_a", "n_b", "n_groups"):
            counts[k] = np.zeros(m, dtype=np.int64)
            counts[k][at] = found[k]
        shown = [""] * m
        for i, d in zip(at.tolist(), digests):
            shown[i] = d
        own, ab = at[found["same"] // p.n_a], found["pairs"] % (p.n_a * p.n_b)
        of = at[found["pairs"] // (p.n_a * p.n_b)]
        return pa.RecordBatch.from_arrays(
            [*ids, *[pa.array(counts[k]) for k in ("n_a", "n_b", "n_groups", "n_groups")], pa.array(shown), _lists(own, found["same"] % p.n_a, m, pa.int32()), _lists(own, found["same_n"], m, pa.int32()),
             _lists(of, (ab // p.n_b << 32) + ab % p.n_b, m, pa.int64()), _lists(of, found["pairs_n"], m, pa.int32())],
            names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_n", "pairs", "pairs_n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(a_path, b_path)
        for batch in batches:
            start, size, texts = 0, 0, []
            for i in range(batch.num_rows):
                texts.append(batch.column(2)[i].as_py())
                size += len(texts[-1] or "")
                if size >= CHUNK or i == batch.num_rows - 1:
                    yield rows(p, [batch.column(k).slice(start, len(texts)) for k in (0, 1)], texts)
                    start, size, texts = i + 1, 0, []

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ENCODED)


def _vectors(encoded: DataFrame, n_a: int) -> DataFrame:
    """(a, n): corpus-wide counts of regular links; each task counts in a vector as long as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_a, dtype=np.int64)
        for batch in batches:
            ids, n = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
            np.add.at(total, ids, n)
        a = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(total[a])], names=["a", "n"])

    return encoded.select("same", "same_n").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def _answer(p_paths: tuple[str, str], counts: np.ndarray, best: np.ndarray, hot: np.ndarray, hot_n: np.ndarray) -> Callable:
    """Sums over links that need no join, and the pairs that do.  counts: by A id; best: by B id; hot: codes in order, with their counts."""

    def sums(owner: np.ndarray, n: np.ndarray, count: np.ndarray, is_best: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((2, m), dtype=np.int64)
        np.add.at(out[0], owner, n * count)
        np.add.at(out[1], owner, n * is_best)
        return out[0], out[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = pair(*p_paths).same
        for batch in batches:
            m, cols = batch.num_rows, {k: batch.column(k) for k in ("same", "same_n", "pairs", "pairs_n")}
            flat = {k: c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k, c in cols.items()}
            own, of = (np.repeat(np.arange(m), cols[k].value_lengths().to_numpy(zero_copy_only=False)) for k in ("same", "pairs"))
            total, top = sums(own, flat["same_n"], counts[flat["same"]], counts[flat["same"]] == best[same[flat["same"]]], m)
            code = flat["pairs"]
            at = np.minimum(np.searchsorted(hot, code), max(len(hot) - 1, 0))
            known = hot[at] == code if len(hot) else np.zeros(len(code), dtype=bool)
            n = hot_n[at[known]]
            more, more_top = sums(of[known], flat["pairs_n"][known], n, n == best[code[known] & 0xFFFFFFFF], m)
            left = of[~known]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")], pa.array(top + more_top), pa.array(total + more), _lists(left, code[~known], m, pa.int64()), _lists(left, flat["pairs_n"][~known], m, pa.int32())],
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "pairs", "pairs_n"],
            )

    return run


def alignment(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row for each row of docs.

    n_links: links, one for each group; n_best: those whose id pair is the commonest of its B id in all docs, ties included; count_sum: how often their pairs are linked in all
    docs, summed.  A text that is null, empty or does not come back from both tokenizers byte by byte has no tokens: zeros and an empty digest.  Texts of any length are aligned
    whole.  Rows that repeat doc_id or text count each; a null doc_id stays null; further columns are not read.  An empty table gives no rows.
    """
    p = pair(a_path, b_path)
    encoded = stash(encode(docs, a_path, b_path), "encoded")
    exploded = encoded.select(F.explode(F.arrays_zip("pairs", "pairs_n")).alias("x")).select(F.col("x.pairs").alias("code"), F.col("x.pairs_n").cast("long").alias("n"))
    others = stash(exploded.groupBy("code").agg(F.sum("n").alias("n")), "pairs")
    counts = np.zeros(p.n_a, dtype=np.int64)
    for r in _vectors(encoded, p.n_a).collect():  # no more rows than A has ids
        counts[r.a] = r.n
    best = np.zeros(p.n_b, dtype=np.int64)
    np.maximum.at(best, p.same[p.same >= 0], counts[p.same >= 0])
    for r in others.groupBy(F.col("code").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("n").alias("n")).collect():  # no more rows than B has ids
        best[r.b] = max(best[r.b], r.n)
    commonest = sorted((r.code, r.n) for r in others.orderBy(F.desc("n"), "code").limit(hot).collect()) if hot else []  # at most `hot` rows
    codes, codes_n = (np.array([r[k] for r in commonest], dtype=np.int64) for k in (0, 1))
    answered = stash(encoded.mapInArrow(_answer((a_path, b_path), counts, best, codes, codes_n), f"{BASE}, n_best long, count_sum long, pairs array<long>, pairs_n array<int>"), "answered")
    forget(encoded)
    of_b = docs.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(best)], "b long, top long")
    known = others.withColumn("b", F.col("code").bitwiseAND(0xFFFFFFFF)).join(F.broadcast(of_b), "b").select("code", "n", (F.col("n") == F.col("top")).alias("is_best"))
    rest = answered.select("row", F.explode(F.arrays_zip("pairs", "pairs_n")).alias("x")).select("row", F.col("x.pairs").alias("code"), F.col("x.pairs_n").alias("k"))
    met = rest.join(known, "code").groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("k")).otherwise(0)).alias("_best"), F.sum(F.col("k") * F.col("n")).alias("_sum"))
    out = answered.drop("pairs", "pairs_n").join(met, "row", "left")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("_best", F.lit(0))).cast("long").alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).cast("long").alias("count_sum"), "groups_sha256",
    )
