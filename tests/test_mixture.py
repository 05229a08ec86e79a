"""Diagonal mixtures against plain expectation maximisation."""

import math

import numpy as np
from pyspark.sql import functions as F

from phrasemine.operators import mixture


def em_by_hand(x, means, variance, rounds):
    """The log-likelihood before each round and after the last, point by point and component by component."""
    k, d = means.shape
    w, s, out = np.full(k, 1 / k), np.tile(variance + 1e-6, (k, 1)), []
    for step in range(rounds + 1):
        log = np.array([[math.log(w[j]) + sum(-0.5 * math.log(2 * math.pi * s[j, i]) - (p[i] - means[j, i]) ** 2 / (2 * s[j, i]) for i in range(d)) for j in range(k)] for p in x])
        top = log.max(axis=1)
        each = top + np.log(np.exp(log - top[:, None]).sum(axis=1))
        out.append(each.sum())
        if step == rounds or step and out[-1] - out[-2] < 1e-3 * len(x):
            break
        r = np.exp(log - each[:, None])
        n = r.sum(axis=0) + 10 * np.finfo(float).eps
        means = (r.T @ x) / n[:, None]
        s = np.stack([(r[:, [j]] * (x - means[j]) ** 2).sum(axis=0) / n[j] for j in range(k)]) + 1e-6
        w = n / n.sum()
    return out


def test_fit_is_plain_em(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([c + rng.normal(size=(60, 4)) * s for c, s in ((0, 1.0), (3, 0.5), (np.array([6, 0, 6, 0]), 2.0))])
    points = spark.createDataFrame([(v.tolist(),) for v in x], "e array<double>").repartition(3)
    first, variance = x[[0, 70, 130]], x.var(axis=0)
    m = mixture.fit(points, first, variance, rounds=15)
    want = em_by_hand(x, first, variance, 15)
    assert len(m.log_likelihood) == len(want) and np.allclose(m.log_likelihood, want, rtol=1e-8)
    assert all(b >= a - 1e-9 for a, b in zip(want, want[1:])) and abs(m.weights.sum() - 1) < 1e-12


def test_mixtures_by_k(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([c + rng.normal(size=(50, 3)) * 0.2 for c in (0.0, 4.0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "phrase_id long, embedding array<double>")
    rows = {r.k: r for r in mixture.diagonal_mixtures(df, [1, 2, 500]).collect()}
    assert set(rows) == {1, 2} and rows[2].bic < rows[1].bic and rows[2].aic < rows[1].aic and rows[2].n_components == 2 and rows[2].silhouette > 0.8
    for k, r in rows.items():
        free = 2 * k * 3 + k - 1
        assert math.isclose(r.aic, 2 * free - 2 * r.log_likelihood) and math.isclose(r.bic, free * math.log(100) - 2 * r.log_likelihood)
    one = (-0.5 * (np.log(2 * np.pi * (x.var(axis=0) + 1e-6)) + (x - x.mean(axis=0)) ** 2 / (x.var(axis=0) + 1e-6))).sum()
    assert abs(rows[1].log_likelihood - one) < 1e-6


def test_mixtures_of_nothing(spark):
    none = spark.createDataFrame([], "phrase_id long, embedding array<double>")
    assert mixture.diagonal_mixtures(none, [2]).collect() == [] and mixture.compare(none, [2], [2]).collect() == []
    assert mixture.diagonal_mixtures(none.union(spark.createDataFrame([(1, None)], none.schema)), [2]).withColumn("x", F.lit(1)).collect() == []
