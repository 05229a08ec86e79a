"""Neighbour graphs by descent against all pairs."""

import numpy as np

from phrasemine.operators import descent, vectors


def test_recall_and_odd_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("vec_id as phrase_id", "embedding")
    df = df.unionByName(spark.createDataFrame([(90_000, None)], df.schema))
    asked = df.where("phrase_id % 20 = 0")
    want = {(r.src, r.dst) for r in vectors.knn(df, 10, asked).collect()}
    got = descent.descend(df, 10).collect()
    assert len({(r.src, r.dst) for r in got} & want) >= 0.9 * len(want)
    by = {}
    for r in got:
        by.setdefault(r.src, []).append((r["rank"], r.distance, r.dst))
    assert len(by) == 500 and all([x[0] for x in sorted(v)] == list(range(1, 11)) and [x[1:] for x in sorted(v)] == sorted(x[1:] for x in v) for v in by.values())
    e = {r.phrase_id: np.array(r.embedding, dtype=float) for r in df.collect() if r.embedding}
    r = got[0]
    a, b = (e[x] / np.linalg.norm(e[x]) for x in (r.src, r.dst))
    assert abs(np.linalg.norm(a - b) - r.distance) < 1e-6


def test_few_or_none(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "phrase_id long, embedding array<double>")
    assert descent.descend(df, 10).count() == 6 and descent.descend(df.limit(1), 10).count() == 0 and descent.descend(df.limit(0), 10).count() == 0
