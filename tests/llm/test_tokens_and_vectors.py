"""Alignment of tokenizers, whitening and vantage-point search against brute force, and on odd input."""

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from phrasemine.llm import alignment, queries, vptree, whitening

# alignment


def aligned(rows):
    """What alignment() returns, from both libraries' own encoders and sets of ends."""
    a_of, b_of = Tokenizer.from_file(alignment.A_PATH), sentencepiece.SentencePieceProcessor(model_file=alignment.B_PATH)
    a_of.encode_special_tokens = True
    p = alignment.pair(alignment.A_PATH, alignment.B_PATH)
    out, counts = [], collections.Counter()
    for i, text in rows:
        a = a_of.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_of.encode(text) if text else []
        if not text or not b"".join(p.a_bytes[x] for x in a) == (" " + text).encode() == b"".join(p.b_bytes[x] for x in b):
            out.append((i, 0, 0, [], ""))
            continue
        ends = [np.cumsum([len(t[x]) for x in ids]).tolist() for t, ids in ((p.a_bytes, a), (p.b_bytes, b))]
        links, groups, at_a, at_b = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            to_a, to_b = ends[0].index(end, at_a) + 1, ends[1].index(end, at_b) + 1
            groups.append(",".join(map(str, a[at_a:to_a])) + "|" + ",".join(map(str, b[at_b:to_b])))
            links.append((a[to_a - 1], b[to_b - 1]))
            at_a, at_b = to_a, to_b
        counts.update(links)
        out.append((i, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(i, a, b, len(ls), len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), h) for i, a, b, ls, h in out]


def low(row):
    return tuple(-1 if x is None else x for x in row)


@pytest.mark.parametrize("hot", [0, 7, alignment.HOT])
def test_alignment_is_brute_force(spark, hot):
    r = random.Random(5)
    letters = [" ", "  ", "the ", "of", "\n", "\t", "é", "é", "中文", "▁", "<s>", "</s>", "<0x41>", "<|endoftext|>", "🙂", "\x00", "1999", "ﬁ", " ", "'s", "keyboard", "Key"]
    rows = [(i, "".join(r.choices(letters, k=r.randint(1, 30)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, " "), (903, "word " * 40_000), (None, "the the the"), (3, rows[3][1]), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("n_a", F.lit(1)).withColumn("PAIRS", F.lit(2))
    got = sorted(low(x) for x in alignment.alignment(docs, hot=hot).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    assert got == sorted(low(x) for x in aligned(rows))


def test_alignment_of_nothing(spark):
    assert alignment.alignment(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only = alignment.alignment(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(tuple(x) for x in only) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_words_are_cut_as_whole_texts_are():
    p, r = alignment.pair(alignment.A_PATH, alignment.B_PATH), random.Random(6)
    assert p._by_word
    for _ in range(3000):
        text = "".join(r.choices(["a", "b", "th", " ", " ", "\n", "é", "中", "ing", "-", "7"], k=r.randint(1, 25)))
        assert p.encode_b(text) == p.b.encode(text)


def test_white_space_that_the_fast_encoder_cannot_take():
    p = alignment.pair(alignment.A_PATH, alignment.B_PATH)
    a = p.encode_a(" " * 400_000)
    assert p.a_len[a].sum() == 400_000


# whitening


def test_eigen_agrees_with_numpy():
    rng = np.random.default_rng(0)
    turn = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    for a in (np.cov(rng.normal(size=(40, 300))), np.diag([1e-6, 1.0, 1e6]), np.ones((5, 5)), np.cov(rng.normal(size=(7, 4))), np.zeros((3, 3)), turn @ np.diag(10.0 ** -np.arange(12)) @ turn.T, np.eye(6), np.array([[2.0]])):
        values, axes = whitening.eigen(a)
        want = np.sort(np.linalg.eigvalsh(a))[::-1][: len(values)]
        assert np.abs(values - want).max(initial=0) <= 1e-13 * max(want.max(initial=0), 1)
        assert np.abs(a @ axes - axes * values).max(initial=0) <= 1e-13 * max(np.abs(a).max(), 1) and np.abs(axes.T @ axes - np.eye(len(values))).max(initial=0) < 1e-13
    assert len(whitening.eigen(np.ones((5, 5)))[0]) == 1 and len(whitening.eigen(np.zeros((3, 3)))[0]) == 0


def test_small_eigenvalues_keep_their_digits():
    scale = np.diag(10.0 ** np.array([0, -2, -4, -6]))
    a = scale @ (np.eye(4) + 0.1) @ scale
    values = whitening.eigen(a)[0]
    # of a graded matrix, the product is its determinant, known to full relative precision
    assert abs(values.prod() / (np.linalg.det(np.eye(4) + 0.1) * 1e-24) - 1) < 1e-12


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("whitened", F.lit("w")).withColumn("_white", F.lit(2))


def test_whitening_is_brute_force(spark):
    rng = np.random.default_rng(2)
    e = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 3
    rows = [(i, v.tolist()) for i, v in enumerate(e)] + [(1, e[1].tolist()), (None, e[2].tolist())]
    odd = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [1.0, 2.0]), (905, [])]
    df = vectors(spark, rows + odd)
    w = whitening.fit(df, 4)
    x = np.array([np.floor(64 * np.array(v)) + 1_000_000 for _, v in rows]).astype(np.int64)
    n, s = len(x), x.sum(axis=0)
    values, axes = np.linalg.eigh((x - s / n).T @ (x - s / n) / n)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    assert w.n == n and w.sums == s.tolist() and np.allclose(w.values, values, rtol=1e-12) and np.allclose(np.array(w.explained), values / ((x - s / n) ** 2).mean(axis=0).sum(), rtol=1e-12)
    got = {(r.vec_id, r.deviation): r.whitened for r in whitening.transform(df, w).select("vec_id", "deviation", "whitened").collect()}
    want = (x - s / n) @ axes / np.sqrt(values) * np.sign((axes * w.vectors).sum(axis=0))
    for (i, _), row, dev in zip(rows, want, ((n * x - s) ** 2).sum(axis=1)):
        assert np.allclose(got[i, dev], row, atol=1e-9)
    assert whitening.transform(df, w).count() == n and whitening.identity_error(df, w) < 1e-10


def test_whitening_of_little(spark):
    assert whitening.fit(vectors(spark, [])).n == 0 and whitening.transform(vectors(spark, []), whitening.fit(vectors(spark, []))).count() == 0
    same = vectors(spark, [(i, [1.0, 2.0]) for i in range(5)])
    w = whitening.fit(same)
    assert len(w.values) == 0 and whitening.identity_error(same, w) == 0 and {r.deviation for r in whitening.transform(same, w).collect()} == {0}
    line = vectors(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(50)])
    assert len(whitening.fit(line).values) == 1 and whitening.identity_error(line, whitening.fit(line)) < 1e-10


def test_sums_that_no_long_holds(spark):
    big = vectors(spark, [(0, [1e15, 0.0]), (1, [-1e15, 1.0]), (2, [0.0, 2.0])])
    w = whitening.fit(big)
    got = {r.vec_id: r.deviation for r in whitening.transform(big, w).collect()}
    assert got[0] is None and got[1] is None and got[2] == 64 * 64 * 9


def test_whitening_query_on_the_given_table(spark):
    rows = queries.op12_whitening(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 500 * 32 and {r.component for r in rows} == set(range(1, 33)) and rows[0].identity_error < 1e-4


# vantage-point trees


def odd_vectors():
    base = np.random.default_rng(1).integers(-3, 4, size=(400, 5)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[3].tolist()) for i in range(60)]
    rows += [(5, base[5].tolist()), (5, base[5].tolist()), (20, [1.0, 2.0, 3.0, 4.0, 5.0]), (None, [1.0] * 5), (2000, None), (2020, [0.0] * 5)]
    return [*rows, (2040, [1.0, None, 1.0, 1.0, 1.0]), (2060, [float("nan")] * 5), (2080, [1.0, 2.0]), (2100, []), (2120, [float("inf")] * 5)]


def nearest_by_hand(rows, k):
    ok = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 5 and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = []
    for i, v in ok:
        if i % 20 == 0:
            near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(v, w)))), j) for j, w in ok if j != i)[:k]
            out += [(i, r + 1, j, round(d, 12)) for r, (d, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"shard": 40, "block": 16, "asked": 3, "sampled": 200}])
def test_factor_one_is_exact(spark, sizes):
    """Copies beyond k, ties, repeated rows, a key with two vectors, and rows that take no part; also with the tasks of a larger table."""
    df = spark.createDataFrame(odd_vectors(), "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("q", F.lit(2)).withColumn("shard", F.lit("x"))
    for parts in ("4", "60"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(parts == "4").lower())
        got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in vptree.nearest(df, df.where("vec_id % 20 = 0"), 10, 1.0, **sizes).collect())
        assert got == nearest_by_hand(odd_vectors(), 10)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_few_or_no_candidates(spark):
    df = spark.createDataFrame(odd_vectors()[:4], "vec_id long, embedding array<double>")
    assert vptree.nearest(df, df).count() == 12 and vptree.nearest(df.limit(0), df).count() == 0 and vptree.nearest(df, df.limit(0)).count() == 0


def test_recall_of_the_production_factor(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids, e = (np.array(x) for x in zip(*[(r.vec_id, r.embedding) for r in df.collect()]))
    ask = np.flatnonzero(ids % 20 == 0)
    d = 2 - 2 * e[ask] @ e.T
    d[np.arange(len(ask)), ask] = 9
    want = {int(ids[q]): set(ids[row].tolist()) for q, row in zip(ask, np.argsort(d, axis=1)[:, :10])}
    got = collections.defaultdict(set)
    for r in vptree.nearest(df, df.where("vec_id % 20 = 0"), shard=400, sampled=1000).collect():
        got[r.query_id].add(r.vec_id)
    assert np.mean([len(got[q] & w) / 10 for q, w in want.items()]) >= 0.9


def test_bounds_hold():
    """No vector of a leaf is nearer than the leaf's bound, whether the shells are those of its vectors or open."""
    rng = np.random.default_rng(4)
    v, q = rng.normal(size=(600, 3)), rng.normal(size=(50, 3))
    for tree in (vptree.Tree(v, 20), vptree.Tree(v[:100], 20, open_shells=True)):
        low = tree.bounds(q)
        leaf = tree.place(v)
        for i, at in enumerate(leaf):
            assert (np.sqrt(((q - v[i]) ** 2).sum(axis=1)) >= low[:, at] - 1e-9).all()
    assert sorted(np.concatenate(vptree.Tree(np.ones((300, 2)), 20).leaves).tolist()) == list(range(300))
