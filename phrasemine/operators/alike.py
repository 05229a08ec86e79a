"""Pairs of short strings that are alike letter by letter, found without comparing all pairs and without losing any.

Two strings of lengths m <= n with a sequence ratio of `least` or more have M >= least * (m + n) / 2 letters in common in order, so at most
d = m + n - 2 M letters stand unmatched.  Cut the shorter one into d + 1 segments: one of them stands whole in the longer one, and its place there
is shifted by no more than the unmatched letters to its left or right allow.  Segments and the substrings at those places meet in an equality
join; counts of shared letters, as bits, drop most of what meets.

Segments have about three letters however long the string is, so any two long strings share one somewhere.  Strings of over LONGEST letters are
therefore compared by blocks of like length: counts of letters first, then common letters in order.  This is exact and grows with the square of
the number of long strings; it is meant for phrases, few of which are long.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to this length strings meet by segments, beyond it by blocks of so many strings.
LONGEST, BLOCK = 48, 2048
#: Bits of a string's letters: one for each letter and its number among equal ones.
WORDS, BITS = 4, 256


def unmatched(m: int, n: int, least: float) -> int:
    """The most letters that stand unmatched in strings of these lengths with a ratio of `least`; negative where the shorter one cannot reach it."""
    need = math.ceil(least * (m + n) / 2 - 1e-9)
    return m + n - 2 * need if need <= min(m, n) else -1


@lru_cache(maxsize=4096)
def cuts(m: int, k: int) -> tuple[tuple[int, int], ...]:
    """Starts and ends of k segments of nearly equal length."""
    return tuple((m * i // k, m * (i + 1) // k) for i in range(k))


@lru_cache(maxsize=4096)
def segment_cuts(m: int, least: float) -> tuple[tuple[int, int, int, int], ...]:
    """(k, i, start, end) of all segments under which a string of length m is found by longer ones."""
    counts, n = set(), m
    while (d := unmatched(m, n, least)) >= 0:
        counts.add(d + 1)
        n += 1
    return tuple((k, i, a, b) for k in sorted(counts) for i, (a, b) in enumerate(cuts(m, k)))


@lru_cache(maxsize=4096)
def probe_cuts(n: int, least: float) -> tuple[tuple[int, int, int, int, int], ...]:
    """(m, k, i, start, end) of all places at which a string of length n may hold a segment of one that is not longer."""
    out, m = [], n
    while m >= 0 and (d := unmatched(m, n, least)) >= 0:
        for i, (a, b) in enumerate(cuts(m, d + 1)):
            low, high = max(-i, n - m - (d - i)), min(i, n - m + (d - i))
            out += [(m, d + 1, i, a + s, b + s) for s in range(low, high + 1) if a + s >= 0 and b + s <= n]
        m -= 1
    return tuple(out)


def letter_bits(s: str) -> tuple[int, ...]:
    """Four words of bits; letters may fall on one bit, so a string has at most as many bits as letters."""
    seen: dict[str, int] = {}
    bits = 0
    for c in s:
        at = seen[c] = seen.get(c, 0) + 1
        bits |= 1 << ((ord(c) * 9 + at) % BITS)
    words = [bits >> (64 * w) & (2**64 - 1) for w in range(WORDS)]
    return tuple(w - 2**64 if w >= 2**63 else w for w in words)


def common_letters(x: str, y: str) -> int:
    """The length of the longest common subsequence, all places of x at once."""
    full = (1 << len(x)) - 1
    at: dict[str, int] = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << i
    v = full
    for c in y:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & full
    return len(x) - v.bit_count()


def _keys(least: float, probe: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each segment, or for each place that is probed; a key names lengths, number and letters of a segment."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", *[f"b{w}" for w in range(WORDS)], "key"]
        types = [pa.int64(), pa.int32(), *[pa.int64()] * WORDS, pa.string()]
        for batch in batches:
            out: list[tuple] = []
            for key, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                head = (key, len(s), *letter_bits(s))
                if probe:
                    found = {f"{m},{k},{i},{s[a:b]}" for m, k, i, a, b in probe_cuts(len(s), least)}
                else:
                    found = {f"{len(s)},{k},{i},{s[a:b]}" for k, i, a, b in segment_cuts(len(s), least)}
                out += [(*head, f) for f in found]
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return rows


def _by_segments(s: DataFrame, least: float) -> DataFrame:
    schema = "id long, n int, " + ", ".join(f"b{w} long" for w in range(WORDS)) + ", key string"
    x, y = (s.mapInArrow(_keys(least, probe), schema).alias(name) for name, probe in (("x", False), ("y", True)))
    shared = sum((F.bit_count(F.col(f"x.b{w}").bitwiseAND(F.col(f"y.b{w}"))) for w in range(WORDS)), F.lit(0))
    # letters that fell on one bit are counted once: no more are shared unseen than the string with fewer of them has
    unseen = F.least(*[F.col(f"{t}.n") - sum((F.bit_count(f"{t}.b{w}") for w in range(WORDS)), F.lit(0)) for t in "xy"])
    enough = shared + unseen >= F.ceil(F.lit(least) * (F.col("x.n") + F.col("y.n")) / 2 - 1e-9)
    once = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & once & enough)
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _block_pairs(least: float, longest: int):
    """Pairs within two blocks, one of each string over `longest` letters, whose common letters in order may reach the ratio."""

    def letters(strings: list[str]) -> np.ndarray:
        return np.array([np.bincount([ord(c) % 64 for c in s], minlength=64) for s in strings], dtype=np.int32)

    def compare(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        if len(x) and len(y):
            one_block = key[0] == key[2] and key[1] == key[3]
            xs, ys, ids = x["s"].tolist(), y["s"].tolist(), y["id"].to_numpy()
            hx, hy, n = letters(xs), letters(ys), np.array([len(t) for t in ys])
            for row, (i, t) in enumerate(zip(x["id"], xs)):
                need = np.ceil(least * (len(t) + n) / 2 - 1e-9).astype(np.int64)
                near = (need <= np.minimum(n, len(t))) & (np.maximum(n, len(t)) > longest)
                if one_block:
                    near &= ids > i
                near &= np.abs(hy - hx[row]).sum(axis=1) <= len(t) + n - 2 * need
                found += [(min(i, ids[k]), max(i, ids[k])) for k in np.flatnonzero(near) if common_letters(t, ys[k]) >= need[k]]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return compare


def _by_blocks(s: DataFrame, least: float, longest: int, block: int) -> DataFrame | None:
    """Bands of lengths, so wide that alike strings are in one band or in two that follow each other, cut into blocks; None without long strings."""
    step = 1.000001 * max((2 - least) / least, 1.01)
    band = F.floor(F.log(F.length("s")) / F.lit(math.log(step))).cast("int")
    t = s.where(F.length("s") * F.lit(step) > longest).withColumn("band", band)
    # as many rows as there are bands: some 20 for each factor of 1,000 in length
    counts = {r.band: -(-r.n // block) for r in t.groupBy("band").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    blocks = F.create_map(*[F.lit(v) for pair in counts.items() for v in pair])
    t = t.withColumn("blocks", F.element_at(blocks, F.col("band")).cast("int")).withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))

    def range_of(first, last):
        return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    def deal(same, other, left: bool):
        there = F.coalesce(F.element_at(blocks, other), F.lit(0))
        mine, zero = F.col("band"), F.lit(0)
        keys = F.concat(
            F.transform(same, lambda o: F.struct(mine.alias("k0"), (F.col("block") if left else o).alias("k1"), mine.alias("k2"), (o if left else F.col("block")).alias("k3"))),
            F.transform(range_of(zero, (there - 1).cast("int")), lambda o: F.struct((mine if left else other).alias("k0"), (F.col("block") if left else o).alias("k1"), (other if left else mine).alias("k2"), (o if left else F.col("block")).alias("k3"))),
        )
        return t.select(F.inline(keys), "id", "s")

    up, down = F.col("band") + 1, F.col("band") - 1
    x = deal(range_of(F.col("block"), F.col("blocks") - 1), up, True)
    y = deal(range_of(F.lit(0), F.col("block")), down, False)
    by = ["k0", "k1", "k2", "k3"]
    return x.groupBy(*by).cogroup(y.groupBy(*by)).applyInPandas(_block_pairs(least, longest), "a long, b long")


def near_strings(strings: DataFrame, least: float, longest: int = LONGEST, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (a < b) of ids of strings whose sequence ratio may reach `least`, with all that do.

    strings: (id long, s string) with distinct ids, and 0 < least <= 1; rows with a null are left out.  Repeated strings are paired like others, so
    give each once.  A string of 25 letters has some 20 segments and 140 probes at 0.85, one of 48 letters about 900.  A segment that very many
    strings of one length share is compared under that key in full, by bits; Spark splits such a key at run time.
    """
    s = strings.select("id", "s").where("id is not null and s is not null")
    short = _by_segments(s.where(F.length("s") <= longest), least)
    long_ = _by_blocks(s, least, longest, block)
    return short if long_ is None else short.union(long_)
