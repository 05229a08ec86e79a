"""Toxicity scores from a learned lexicon that also catches misspelt terms.

fit() learns a lexicon (words and word beginnings that toxic training texts hold far more often than others) and the weights of a
logistic regression on a bounded sample of labelled rows.  Words are matched by Levenshtein automata intersected
with the trie of the lexicon: the set of (trie node, edits so far) reached after each letter is one state of a deterministic automaton,
built as texts need it, so a word costs one table look-up a letter and most words die after a few.  Each hit is weighed by
its context: quotation marks and words of reporting nearby count apart from plain or direct use.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import stash

FOLDS, HELD_OUT = 5, 0
#: Labelled rows that fit() learns from at most, chosen by hash.  The lexicon has no bound of its own: every term of that sample that at
#: least SUPPORT toxic texts hold, LIFT times (as a logarithm) as often as others and beyond SIGMA deviations of chance.
TRAIN_ROWS, SUPPORT, LIFT, SIGMA = 8000, 5, 2.0, 4.0
#: Edits allowed for terms of at least so many letters.
FUZZY = ((5, 1), (9, 2))
PREFIXES = range(4, 8)
CONTEXT = 4
_TOKEN = re.compile(r"\w+|[\"“”„«»‘’'‹›]")
_QUOTES = frozenset("\"“”„«»‘’'‹›")
#: Words that report speech, and words that address someone.
REPORTING = frozenset("said says say quoted quote called calls wrote writes according claimed reported word words dit écrit disait sagte sagt nannte schrieb dijo dice llamó escribió".split())
ADDRESS = frozenset("you your youre u are tu vous toi es du ihr sie bist usted ustedes eres".split())


#: States that a worker keeps before it starts afresh; one word adds no more than it has letters.
MOST_STATES = 60_000


class _State:
    """Trie nodes reached with so many edits; moves: the states that letters lead to, as far as texts needed them."""

    __slots__ = ("reached", "moves", "word", "prefix")

    def __init__(self, reached: tuple[tuple[int, int], ...], word: tuple[int, int] | None, prefix: int):
        self.reached, self.word, self.prefix = reached, word, prefix
        self.moves: dict[str, _State] = {}


class _Automaton:
    """The lexicon's trie run beside Levenshtein automata, made deterministic state by state."""

    def __init__(self, words: dict[str, int], prefixes: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.prefix: list[int] = [-1]
        self.room: list[int] = [0]  # most edits that a word below this node allows
        self.size: list[int] = [0]
        for entries, mark in ((words, self.word), (prefixes, self.prefix)):
            for w, k in entries.items():
                at, room = 0, self.allowed(w) if mark is self.word else 0
                self.room[0] = max(self.room[0], room)
                for c in w:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        for column in (self.word, self.prefix):
                            column.append(-1)
                        self.next.append({})
                        self.room.append(0)
                        self.size.append(0)
                    at = self.next[at][c]
                    self.room[at] = max(self.room[at], room)
                mark[at] = k
                self.size[at] = max(self.size[at], room)
        self.letters = {c for n in self.next for c in n}
        self._forget()

    def _forget(self) -> None:
        """Drop all states: they hold each other through their moves, so the first one goes with the table."""
        self.states: dict[frozenset, _State] = {}
        self.start = self._state({(0, 0)})

    @staticmethod
    def allowed(word: str) -> int:
        return max((k for n, k in FUZZY if len(word) >= n), default=0)

    def _state(self, reached: set[tuple[int, int]]) -> _State:
        """The state of these trie nodes and edits, with letters of the term left out, and without nodes that fewer edits reach."""
        best: dict[int, int] = {}
        todo = list(reached)
        while todo:
            node, edits = todo.pop()
            if edits > self.room[node] and edits or best.get(node, 99) <= edits:
                continue
            best[node] = edits
            todo += [(child, edits + 1) for child in self.next[node].values()]
        key = frozenset(best.items())
        if (state := self.states.get(key)) is None:
            words = [(e, self.word[n]) for n, e in best.items() if self.word[n] >= 0 and e <= self.size[n]]
            prefixes = [self.prefix[n] for n, e in best.items() if e == 0 and self.prefix[n] >= 0]
            state = self.states[key] = _State(tuple(best.items()), min(words, default=None), max(prefixes, default=-1))
        return state

    def step(self, state: _State, letter: str) -> _State:
        to: set[tuple[int, int]] = set()
        for node, edits in state.reached:
            if letter in self.next[node]:
                to.add((self.next[node][letter], edits))
            to.add((node, edits + 1))  # a letter too many
            to.update((child, edits + 1) for child in self.next[node].values())  # another letter
        out = state.moves[letter] = self._state(to)
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        """(entry, edits) of the best match: fewest edits, then a whole word before a beginning, then the first entry of words, the last of beginnings."""
        if len(self.states) > MOST_STATES:
            self._forget()
        state, prefix = self.start, -1
        for c in word:
            if c not in self.letters:
                c = "\x00"
            state = state.moves.get(c) or self.step(state, c)
            if not state.reached:
                return (prefix, 0) if prefix >= 0 else None
            if state.prefix > prefix:
                prefix = state.prefix
        if state.word is not None and (state.word[0] == 0 or prefix < 0):
            return state.word[1], state.word[0]
        return (prefix, 0) if prefix >= 0 else None


class _Matcher(dict):
    """Word -> match, remembered for the words of late."""

    def __init__(self, model: dict):
        kinds = [{t: k for k, (t, is_prefix, _) in enumerate(model["lexicon"]) if is_prefix == p} for p in (False, True)]
        self.automaton = _Automaton(*kinds)
        self.weight = [w for *_, w in model["lexicon"]]

    def __missing__(self, word: str):
        if len(self) > 300_000:
            self.clear()
        self[word] = m = self.automaton.match(word)
        return m


N_FEATURES = 9


def features(text: str | None, matcher: _Matcher) -> np.ndarray:
    """Of one whole text; all zero for a text without words."""
    tokens = _TOKEN.findall((text or "").lower())
    x = np.zeros(N_FEATURES)
    if not tokens:
        return x
    entries = set()
    for i, m in enumerate(map(matcher.__getitem__, tokens)):
        if m is None:
            continue
        entry, edits = m
        weight = matcher.weight[entry]
        near = tokens[max(0, i - CONTEXT) : i + CONTEXT + 1]
        quoted = sum(t in _QUOTES for t in near) >= 2 or any(t in REPORTING for t in near)
        x[3 if quoted else 0 if edits == 0 else 1] += weight
        x[2] = max(x[2], 0.0 if quoted else weight * (1.0 if edits == 0 else 0.7))
        x[4] += any(t in ADDRESS for t in near)
        entries.add(entry)
        x[5] += 1
    x[6] = len(entries)
    x[7] = x[5] / len(tokens)
    x[:2], x[3:7] = np.log1p(x[:2]), np.log1p(x[3:7])
    x[8] = float(x[2] > 0)
    return x


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT


def _half(doc_id: int) -> int:
    return (doc_id * 2654435761 >> 8) & 1


def _term_counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents that hold each word or beginning, by label and half of the sample; counted within a batch first."""
    for p in parts:
        counts: dict[tuple[str, bool], list[int]] = {}
        for doc_id, text, toxic in zip(p["doc_id"], p["text"], p["toxic"]):
            at = 2 * int(toxic > 0) + _half(int(doc_id))
            words = set(_TOKEN.findall((text or "").lower())) - _QUOTES
            for key in [(w, False) for w in words] + [(w, True) for w in {w[:k] for w in words for k in PREFIXES if len(w) > k}]:
                counts.setdefault(key, [0] * 4)[at] += 1
        if counts:
            yield pd.DataFrame([(*k, *v) for k, v in counts.items()], columns=["term", "is_prefix", "c0", "c1", "t0", "t1"])


def _lexicon(terms: DataFrame, sizes: dict[tuple[int, int], int], halves: tuple[int, ...]) -> list[tuple[str, bool, float]]:
    """The terms that toxic texts of some halves hold far more often than others."""
    t, c = (sum((F.col(f"{k}{h}") for h in halves), F.lit(0)) for k in "tc")
    n1, n0 = (max(1, sum(sizes.get((label, h), 0) for h in halves)) for label in (1, 0))
    lift = F.log((t + 0.5) / n1) - F.log((c + 0.5) / n0)
    chance = (t + c + 0.5) * (n1 / (n1 + n0))
    sigma = (t - chance) / F.sqrt(chance * (n0 / (n1 + n0)))
    x = terms.select("term", "is_prefix", t.alias("t"), lift.alias("lift"), sigma.alias("sigma")).where(f"t >= {SUPPORT} and lift > {LIFT} and sigma > {SIGMA}")
    return [(r.term, r.is_prefix, r.lift) for r in x.orderBy((-F.col("lift") * F.sqrt("t")), "term", "is_prefix").collect()]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for an L2-regularised logistic regression; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """Learn from labelled documents outside the held-out fold: at most train_rows of them, chosen by a hash of doc_id.

    Texts stay on the executors: the driver gets the labels of the sample, the lexicon and nine numbers a row.

    Rows without a label or doc_id are skipped; a doc_id labelled twice is toxic if either says so.  Without any row of
    one class all scores are the share of toxic rows, 0 for none.
    """
    ids = (
        labels.where("toxic is not null and doc_id is not null").where(~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    )
    # copies of a text say no more than one of them, and would make its chance words look borne out
    labelled = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    sample = stash(labelled.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), "sample")
    sizes: dict[tuple[int, int], int] = {}
    for r in sample.select("doc_id", (F.col("toxic") > 0).cast("int").alias("y")).toLocalIterator():
        sizes[r.y, _half(r.doc_id)] = sizes.get((r.y, _half(r.doc_id)), 0) + 1
    n = {y: sizes.get((y, 0), 0) + sizes.get((y, 1), 0) for y in (0, 1)}
    if not n[0] or not n[1]:
        return {"lexicon": [], "weights": [0.0] * N_FEATURES + [float(np.log((n[1] + 0.5) / (n[0] + 0.5))) if n[0] + n[1] else -30.0]}
    schema = "term string, is_prefix boolean, c0 long, c1 long, t0 long, t1 long"
    terms = stash(sample.mapInPandas(_term_counts, schema).groupBy("term", "is_prefix").agg(*[F.sum(k).alias(k) for k in ("c0", "c1", "t0", "t1")]).where(f"t0 + t1 >= {SUPPORT}"), "terms")
    # terms learned on one half are weighed on the other, and the other way round, so that weights see honest hits
    other = [_lexicon(terms, sizes, (1 - h,)) for h in (0, 1)]

    def measured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matchers = [_Matcher({"lexicon": x}) for x in other]
        for p in parts:
            x = [features(t, matchers[_half(int(d))]) for d, t in zip(p["doc_id"], p["text"])]
            yield pd.DataFrame({"y": (p["toxic"] > 0).astype(float), "x": x})

    rows = sorted((r.y, *r.x) for r in sample.mapInPandas(measured, "y double, x array<double>").collect())
    xy = np.array(rows)
    return {"lexicon": _lexicon(terms, sizes, (0, 1)), "weights": _logistic(xy[:, 1:], xy[:, 0]).tolist()}


@lru_cache(maxsize=2)
def _loaded(model: str) -> tuple[_Matcher, np.ndarray]:
    m = json.loads(model)
    return _Matcher(m), np.array(m["weights"])


def score_column(model: dict):
    """text -> score between 0 and 1."""
    said = json.dumps(model)

    def scores(texts: pd.Series) -> pd.Series:
        matcher, w = _loaded(said)
        x = np.array([features(t, matcher) for t in texts]).reshape(-1, N_FEATURES)
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))))

    return F.pandas_udf(scores, DoubleType())


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs.

    Null and empty texts have the score of a text without hits.  The fold of a null doc_id is null: not held out.  Texts are scored
    whole, however long; rows that repeat each give a row, an empty table none; further columns are left out.
    """
    out = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score_column(model)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns; repeated rows go or stay together, null texts score as empty ones."""
    return docs.where(score_column(model)("text") < threshold)
