"""Merge trees against merging one pair after the other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasemine.operators import linkage


def heights_by_hand(x, method):
    """Lance-Williams, one merger a step; labels after each number of clusters."""
    n = len(x)
    d = {(i, j): float(np.linalg.norm(x[i] - x[j])) for i in range(n) for j in range(i + 1, n)}
    size, out, members = dict.fromkeys(range(n), 1), [], {i: {i} for i in range(n)}
    parts = [set(map(frozenset, members.values()))]
    while len(size) > 1:
        (a, b), h = min(d.items(), key=lambda kv: (kv[1], kv[0]))
        out.append(h)
        for c in size:
            if c in (a, b):
                continue
            da, db, dc = d[min(a, c), max(a, c)], d[min(b, c), max(b, c)], size[c]
            if method == "complete":
                new = max(da, db)
            elif method == "average":
                new = (size[a] * da + size[b] * db) / (size[a] + size[b])
            else:
                new = math.sqrt(((size[a] + dc) * da**2 + (size[b] + dc) * db**2 - dc * h**2) / (size[a] + size[b] + dc))
            d[min(a, c), max(a, c)] = new
        size[a] += size.pop(b)
        members[a] |= members.pop(b)
        d = {k: v for k, v in d.items() if b not in k}
        parts.append(set(map(frozenset, members.values())))
    return out, parts


@pytest.mark.parametrize("method", linkage.METHODS)
def test_heights_are_those_of_single_mergers(spark, method):
    x = np.random.default_rng(7).normal(size=(50, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "phrase_id long, embedding array<double>").repartition(3)
    tree = linkage.merge_tree(df, method).persist()
    want, parts = heights_by_hand(x, method)
    assert np.allclose(sorted(r.height for r in tree.collect()), sorted(want), atol=1e-7)
    got = {}
    for r in linkage.cut(df.select(F.col("phrase_id").alias("node")), tree, 9).collect():
        got.setdefault(r.cluster_id, set()).add(r.node)
    assert set(map(frozenset, got.values())) == parts[50 - 9] and sorted(got) == list(range(9))


def test_number_of_clusters_by_silhouette(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.eye(6)[c] * 5 + rng.normal(size=(25, 6)) * 0.3 for c in range(4)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "phrase_id long, embedding array<double>")
    for micro in (2000, 40):
        got = [r.cluster_id for r in linkage.agglomerative(df, [2, 4, 8], micro=micro).orderBy("phrase_id").collect()]
        assert len(got) == 100 and [len(set(got[i : i + 25])) for i in range(0, 100, 25)] == [1] * 4 and len(set(got)) == 4
    assert linkage.agglomerative(df.limit(0), [2]).count() == 0
