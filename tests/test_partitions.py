"""k-means, the search for k and principal components against numpy."""

import numpy as np
import pytest

from phrasemine.operators import cluster, vectors


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "phrase_id long, embedding array<double>")


@pytest.fixture(scope="module")
def points():
    """Six blobs of unequal width."""
    r = np.random.default_rng(4)
    return np.vstack([r.normal(4 * r.normal(size=5), 0.2 + 0.1 * k, size=(30, 5)) for k in range(6)])


def by_numpy(x, label):
    """Silhouette, Davies-Bouldin and Calinski-Harabasz, as they are defined."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    names, out = np.unique(label), []
    for i in range(len(x)):
        own = (label == label[i]) & (np.arange(len(x)) != i)
        near = min(d[i, label == c].mean() for c in names if c != label[i])
        out.append((near - d[i, own].mean()) / max(near, d[i, own].mean()) if own.any() else 0)
    mean = np.array([x[label == c].mean(axis=0) for c in names])
    within = [np.sqrt(((x[label == c] - m) ** 2).sum(axis=1)) for c, m in zip(names, mean)]
    s = [w.mean() for w in within]
    pairs = [max((s[i] + s[j]) / np.linalg.norm(mean[i] - mean[j]) for j in range(len(names)) if j != i) for i in range(len(names))]
    between = sum(len(w) * ((m - x.mean(axis=0)) ** 2).sum() for w, m in zip(within, mean))
    return np.mean(out), np.mean(pairs), between * (len(x) - len(names)) / (sum((w**2).sum() for w in within) * (len(names) - 1))


def labels(d, n):
    got = {r.phrase_id: r.cluster_id for r in d.select("phrase_id", "cluster_id").collect()}
    return np.array([got[i] for i in range(n)])


def test_kmeans_is_settled(spark, points):
    """No point is nearer to another centre than to its own, and no other start of plain k-means is much better."""
    label = labels(cluster.kmeans(table(spark, points), 6), len(points))
    mean = np.array([points[label == c].mean(axis=0) for c in range(6)])
    d = ((points[:, None] - mean[None]) ** 2).sum(axis=2)
    assert (d.argmin(axis=1) == label).all()
    r, best = np.random.default_rng(1), np.inf
    for _ in range(20):
        c = points[r.choice(len(points), 6, replace=False)]
        for _ in range(30):
            near = ((points[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([points[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(6)])
        best = min(best, ((points - c[near]) ** 2).sum())
    assert d.min(axis=1).sum() <= 1.3 * best


def test_search_k_gives_the_indices_of_each_fit(spark, points, monkeypatch):
    """A fit depends on how rows are dealt out, so the labels of the very fits are kept and measured again."""
    fits, fit = {}, cluster.kmeans

    def kept(d, k):
        rows = fit(d, k).collect()
        fits[k] = np.array([r.cluster_id for r in sorted(rows)])
        return spark.createDataFrame(rows, "phrase_id long, cluster_id int, embedding array<double>")

    monkeypatch.setattr(cluster, "kmeans", kept)
    got = [tuple(r) for r in cluster.search_k(table(spark, points), [3, 6, 9]).collect()]
    assert sorted(g[0] for g in got) == [3, 6, 9] and [g[1] for g in got] == sorted((g[1] for g in got), reverse=True)
    for k, *indices in got:
        assert indices == pytest.approx(by_numpy(points, fits[k]), rel=1e-6)


def test_explained_variance(spark, points):
    values = np.linalg.eigvalsh(np.cov(points.T))[::-1]
    got = vectors.explained_variance(table(spark, points), 4).orderBy("component").collect()
    assert [r.explained for r in got] == pytest.approx(values[:4] / values.sum()) and [r.cumulative for r in got] == pytest.approx(np.cumsum(values[:4]) / values.sum())
