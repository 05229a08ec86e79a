"""All pairs in blocks: the same neighbours as a whole matrix gives, and nothing written for a pair of blocks."""

import os

import numpy as np
import pyarrow as pa

from phrasemine.operators import hierarchy, vectors


def written(spark):
    return sum(os.path.getsize(f"{at}/{f}") for at, _, files in os.walk(spark.conf.get("spark.local.dir")) for f in files if os.path.exists(f"{at}/{f}"))


def frame(spark, x):
    return spark.createDataFrame([(i, None if v is None else v.tolist()) for i, v in enumerate(x)], "phrase_id long, embedding array<double>").repartition(3)


def test_disk_grows_with_the_rows_and_not_with_the_pairs(spark):
    x = np.random.default_rng(1).normal(size=(3000, 32))
    df = frame(spark, x)
    before = written(spark)
    assert vectors.knn(df, 5, block=64).count() == 15_000
    assert written(spark) - before < 12 * x.nbytes  # each pair of the 47 blocks: 94


def test_copies_null_vectors_and_small_blocks(spark):
    r = np.random.default_rng(2)
    x = list(r.normal(size=(150, 6))) + [np.ones(6)] * 90 + [np.zeros(6), None, np.full(6, np.nan)]
    got = {}
    for row in vectors.knn(frame(spark, x), 7, block=40).collect():
        got.setdefault(row.src, []).append((row["rank"], row.distance, row.dst))
    u = np.array([v / (np.linalg.norm(v) or 1) for v in x[:241]])
    d = np.sqrt(np.maximum(0, 2 - 2 * np.round(u @ u.T, 12)))
    np.fill_diagonal(d, np.inf)
    assert set(got) == set(range(241))
    for i, near in got.items():
        want = sorted((d[i, j], j) for j in range(241))[:7]
        assert [(n, j) for n, _, j in sorted(near)] == [(n + 1, j) for n, (_, j) in enumerate(want)]
        assert np.allclose([a for _, a, _ in sorted(near)], [a for a, _ in want], atol=1e-6)


def test_few_queries_few_vectors_and_none(spark):
    df = frame(spark, np.random.default_rng(3).normal(size=(300, 4)))
    asked = df.where("phrase_id < 2")
    whole = {(r.src, r.dst, r["rank"]) for r in vectors.knn(df, 4).where("src < 2").collect()}
    assert {(r.src, r.dst, r["rank"]) for r in vectors.knn(df, 4, asked, block=16).collect()} == whole and len(whole) == 8
    assert vectors.knn(asked, 4).count() == 2 and vectors.knn(df.limit(0), 4).count() == 0 and vectors.knn(df, 4, df.limit(0)).count() == 0


def test_least_outgoing_edges_from_blocks_one_by_one():
    """What blocks give one after the other is what the whole matrix gives, however the points are cut, bounds and ties included."""
    r = np.random.default_rng(4)
    u = np.concatenate([r.normal(size=(500, 5)), np.ones((60, 5))])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    n = len(u)
    c, core = r.integers(0, 9, n), r.uniform(0.05, 0.4, n)
    most = np.where(c == 3, np.inf, 0.5)
    table = lambda at, **more: pa.table({"phrase_id": at, "embedding": pa.array(u[at].tolist()), "c": c[at], "core": core[at], **more})
    w = np.round(np.maximum(np.maximum(core[:, None], core[None, :]), np.sqrt(np.maximum(0, 2 - 2 * np.round(u @ u.T, 12)))), 9)
    want = {}
    for i, j in zip(*np.nonzero((c[:, None] != c[None, :]) & (w <= most[:, None]))):
        edge = (w[i, j], min(i, j), max(i, j), c[j])
        want[c[i]] = min(want.get(c[i], edge), edge)
    for size in (70, n):
        state = hierarchy._Outgoing(table(np.arange(n), most=most))
        for at in range(0, n, size):
            state.meet(table(np.arange(at, min(n, at + size))))
        assert {x["ca"]: (x["w"], x["lo"], x["hi"], x["cb"]) for x in state.found().to_pylist()} == want and len(want) == 9
