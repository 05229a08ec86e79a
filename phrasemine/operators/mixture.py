"""Gaussian mixtures with diagonal covariance, for many components and wide vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import stash
from .cluster import kmeans, validity
from .relate import sample
from .vectors import _matrix, as_ml

#: What is added to every variance; vectors that the first centres are learned from at most; rows whose responsibilities are held at once.
FLOOR, FIRST, AT_ONCE = 1e-6, 20_000, 1024


@dataclass
class Mixture:
    """Weights (k), means and variances (k x width), and the log-likelihood before each round and after the last one."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    log_likelihood: list[float]

    def joint(self, x: np.ndarray) -> np.ndarray:
        """log(weight * density) of each row and component."""
        p = 1 / self.variances
        d = (x * x) @ p.T - 2 * x @ (self.means * p).T + (self.means**2 * p).sum(axis=1)
        return np.log(self.weights) - 0.5 * (x.shape[1] * math.log(2 * math.pi) + np.log(self.variances).sum(axis=1) + d)


def _shares(joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Responsibilities and the log-likelihood of each row."""
    top = joint.max(axis=1, keepdims=True)
    total = top + np.log(np.exp(joint - top).sum(axis=1, keepdims=True))
    return np.exp(joint - total), total[:, 0]


def _sums(points: DataFrame, m: Mixture) -> tuple[np.ndarray, float]:
    """(k x (1 + 2 width): sums of r, r x, r x^2; log-likelihood).  Tasks add up their rows, Spark the tasks; no more than that matrix comes to the driver."""
    k, d = m.means.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, 1 + 2 * d))
        likely = 0.0
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                x = _matrix(pa.chunked_array([b.column(0).slice(at, AT_ONCE)]))
                r, ll = _shares(m.joint(x))
                total += np.hstack([r.sum(axis=0)[:, None], r.T @ x, r.T @ (x * x)])
                likely += float(ll.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size + 1)), pa.array(np.append(total.ravel(), likely))], names=["i", "v"])

    out = np.zeros(k * (1 + 2 * d) + 1)
    for r in points.select("e").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out[:-1].reshape(k, 1 + 2 * d), float(out[-1])


def fit(points: DataFrame, first: np.ndarray, variance: np.ndarray, rounds: int = 100, least_gain: float = 1e-3) -> Mixture:
    """Expectation maximisation from these means and equal weights: points has e (array of doubles).  Ends when the mean log-likelihood of a point gains less than least_gain."""
    k = len(first)
    m = Mixture(np.full(k, 1 / k), first.copy(), np.tile(variance + FLOOR, (k, 1)), [])
    n = None
    for _ in range(rounds):
        s, ll = _sums(points, m)
        n = s[:, 0].sum()
        m.log_likelihood.append(ll)
        if len(m.log_likelihood) > 1 and ll - m.log_likelihood[-2] < least_gain * n:
            return m
        r = s[:, :1] + 10 * np.finfo(float).eps
        d = first.shape[1]
        means = s[:, 1 : 1 + d] / r
        m = Mixture(r[:, 0] / r.sum(), means, np.maximum(s[:, 1 + d :] / r - means**2, 0) + FLOOR, m.log_likelihood)
    m.log_likelihood.append(_sums(points, m)[1])
    return m


def assign(vectors: DataFrame, m: Mixture) -> DataFrame:
    """(phrase_id, cluster_id, embedding): the component that is likeliest for each vector."""

    @F.arrow_udf("int")
    def likeliest(e: pa.Array) -> pa.Array:
        out = [m.joint(_matrix(pa.chunked_array([e.slice(at, AT_ONCE)]))).argmax(axis=1) for at in range(0, len(e), AT_ONCE)]
        return pa.array(np.concatenate(out) if out else [], pa.int32())

    return vectors.where("embedding is not null").select("phrase_id", likeliest(F.col("embedding").cast("array<double>")).alias("cluster_id"), "embedding")


def diagonal_mixtures(vectors: DataFrame, ks: list[int], seed: int = 42, rounds: int = 100) -> DataFrame:
    """K, log_likelihood, aic, bic, rounds, n_components (that any vector is likeliest in), silhouette, davies_bouldin: one row for each k.

    A mixture has 2 k d + k - 1 free numbers.  First centres are those of k-means on at most FIRST vectors chosen by hash; variances start as the whole table's.  Null vectors take no part;
    of k beyond the number of vectors there is no row, nor any for an empty table.
    """
    spark, schema = vectors.sparkSession, "k int, log_likelihood double, aic double, bic double, rounds int, n_components long, silhouette double, davies_bouldin double"
    v = stash(vectors.where("embedding is not null").select("phrase_id", F.col("embedding").cast("array<double>").alias("embedding")), "vectors")
    n = v.count()
    out = spark.createDataFrame([], schema)
    if not n:
        return out
    points = v.select(F.col("embedding").alias("e"))
    width = len(v.first().embedding)
    moments = points.select(F.posexplode("e").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("s")).collect()  # a row for each dimension
    variance = np.zeros(width)
    for r in moments:
        variance[r.i] = r.s
    some = as_ml(sample(v, FIRST, seed, "phrase_id")).persist()
    for k in sorted(x for x in ks if x <= n):
        first = np.array(KMeans(k=k, seed=seed, maxIter=10).fit(some).clusterCenters()) if k > 1 else None
        if first is None:
            first = np.array([[r.c for r in points.select(F.posexplode("e").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("c")).orderBy("i").collect()]])
        m = fit(points, first, variance, rounds)
        ll, free = m.log_likelihood[-1], 2 * len(first) * width + len(first) - 1
        labelled = stash(assign(v, m), "labelled")
        seen = labelled.agg(F.count_distinct("cluster_id").alias("n_components"))
        q = validity(labelled).select("silhouette", "davies_bouldin")
        row = seen.join(F.broadcast(q)).select(F.lit(k).alias("k"), F.lit(ll).alias("log_likelihood"), F.lit(2.0 * free - 2 * ll).alias("aic"), F.lit(free * math.log(n) - 2 * ll).alias("bic"), F.lit(len(m.log_likelihood) - 1).alias("rounds"), "n_components", "silhouette", "davies_bouldin")
        out = out.unionByName(row)
    some.unpersist()
    return out


def compare(vectors: DataFrame, k_means: list[int], mixtures: list[int], seed: int = 42) -> DataFrame:
    """Method, k, silhouette, davies_bouldin, calinski_harabasz, aic, bic: k-means and mixtures side by side over the same vectors."""
    none = F.lit(None).cast("double")
    m = diagonal_mixtures(vectors, mixtures, seed)
    out = m.select(F.lit("mixture").alias("method"), "k", "silhouette", "davies_bouldin", none.alias("calinski_harabasz"), "aic", "bic")
    if vectors.where("embedding is not null").isEmpty():
        return out
    for k in k_means:
        labelled = stash(kmeans(vectors.where("embedding is not null"), k, seed), "labelled")
        row = validity(labelled).select(F.lit("kmeans").alias("method"), F.lit(k).alias("k"), "silhouette", "davies_bouldin", "calinski_harabasz", none.alias("aic"), none.alias("bic"))
        out = out.unionByName(row)
    return out
