"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

Blocks are labelled article text or not from features of their ancestors and their text, and of their neighbours by the chain.
The weights maximise the conditional likelihood of labelled pages (forward-backward, L2 prior); pages are decoded by Viterbi.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .html_blocks import Block, blocks
from .html_pages import labelled_pages

#: Labelled pages that fit() learns from, passes over them, strength of the prior.
TRAIN_PAGES, PASSES, RIDGE = 700, 120, 0.0002
_MARK = re.compile(r"^@([YN])\d+@ ?")
_MARKS = re.compile(r"@[YN]\d+@ ?")


def training_set(n: int = TRAIN_PAGES, seed: int = 1) -> list[tuple[list[list[str]], list[int]]]:
    """(features of each block, label of each block) for each labelled page; markers do not reach the features."""
    out = []
    for page in labelled_pages(n, seed):
        marked = blocks(page)
        clean = blocks(_MARKS.sub("", page))
        labels = [int(b.text[1] == "Y") if _MARK.match(b.text) else 0 for b in marked]
        if len(marked) == len(clean) and clean:
            out.append(([b.features for b in clean], labels))
    return out


def _fit(pages: list[tuple[list[list[str]], list[int]]], passes: int = PASSES, ridge: float = RIDGE) -> dict:
    names = sorted({f for x, _ in pages for b in x for f in b})
    at = {f: i for i, f in enumerate(names)}
    longest, n = max(len(y) for _, y in pages), len(pages)
    label, real = np.zeros((n, longest), dtype=int), np.zeros((n, longest), dtype=bool)
    for k, (_, y) in enumerate(pages):
        label[k, : len(y)], real[k, : len(y)] = y, True
    # features of all blocks of all pages in a row
    of_block = [b for x, _ in pages for b in x]
    flat = np.array([at[f] for b in of_block for f in b])
    counts = np.array([len(b) for b in of_block])
    starts = np.cumsum(counts) - counts
    w, trans = np.zeros((len(names), 2)), np.zeros((2, 2))
    m, v = [np.zeros_like(w), np.zeros_like(trans)], [np.zeros_like(w), np.zeros_like(trans)]
    pairs = real[:, 1:]
    for step in range(1, passes + 1):
        e = np.zeros((n, longest, 2))  # page, block, label
        e[real] = np.add.reduceat(w[flat], starts, axis=0)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(alpha[:, t - 1, :, None] + trans, axis=1) + e[:, t]
            alpha[:, t] = np.where(real[:, t, None], new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(real[:, t + 1, None], new, 0.0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p = np.exp(alpha + beta - z[:, None, None]) * real[:, :, None]
        diff = (p - np.eye(2)[label] * real[:, :, None])[real]
        gw = np.stack([np.bincount(flat, weights=np.repeat(diff[:, c], counts), minlength=len(w)) for c in range(2)], axis=1)
        pair = np.exp(alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[:, :, None, None]
        gt = pair.sum(axis=(0, 1))
        np.subtract.at(gt, (label[:, :-1][pairs], label[:, 1:][pairs]), 1)
        grads = [gw / n + ridge * w, gt / n + ridge * trans]
        rate = 0.1 if 2 * step < passes else 0.03
        for k, (param, g) in enumerate(((w, grads[0]), (trans, grads[1]))):  # Adam
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            param -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return {"weights": {f: [float(a) for a in w[i]] for f, i in at.items()}, "trans": trans.tolist()}


@lru_cache(maxsize=1)
def fit() -> str:
    """The model, as JSON; the same for the same labelled pages."""
    return json.dumps(_fit(training_set()))


def decode(page_blocks: list[Block], weights: dict[str, list[float]], trans: list[list[float]]) -> list[int]:
    """Viterbi: the likeliest labels of a page's blocks."""
    (t00, t01), (t10, t11) = trans
    a = b = 0.0
    back = []
    for i, block in enumerate(page_blocks):
        e0 = e1 = 0.0
        for f in block.features:
            if f in weights:
                x = weights[f]
                e0 += x[0]
                e1 += x[1]
        if i == 0:
            a, b = e0, e1
            continue
        from0, from1 = a + t00 >= b + t10, a + t01 >= b + t11
        back.append((0 if from0 else 1, 0 if from1 else 1))
        a, b = (a + t00 if from0 else b + t10) + e0, (a + t01 if from1 else b + t11) + e1
    if not page_blocks:
        return []
    out = [0 if a >= b else 1]
    for step in reversed(back):
        out.append(step[out[-1]])
    return out[::-1]


@lru_cache(maxsize=1)
def _loaded(model: str) -> tuple[dict, list]:
    m = json.loads(model)
    return m["weights"], m["trans"]


def main_text(page: str | None, model: str) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, y in zip(found, decode(found, *_loaded(model))) if y)


def extract(pages: DataFrame, model: str | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages.

    text joins the article's blocks in page order by a line break, empty if there is none; a null or empty html is an empty
    page.  Pages are whole, however long; broken markup is read as far as it goes.  Rows that repeat, or have a null page_id, each
    give a row; an empty table gives none.  Further columns of pages are left out, whatever their names.
    """
    said = model or fit()

    def texts(pages_: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, said) for p in pages_], dtype=object)

    out = pages.select("page_id", "url", F.pandas_udf(texts, StringType())("html").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
