"""Clusterings of vectors and groups of similar phrases."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import forget, stash
from .graph import components
from .relate import numbered, renumbered, sample
from .vectors import _matrix, as_ml, co_blocks, knn


def density_clusters(vectors: DataFrame, min_size: int = 30, min_samples: int = 3, epsilon: float = 0.9, k: int = 20, within: str | None = None, near: DataFrame | None = None) -> DataFrame:
    """V9: (phrase_id, cluster_id): points joined by mutual reachability within epsilon; smaller components are noise, -1.

    A point's core distance is the distance to its min_samples-th neighbour; two neighbours are as far apart as the
    largest of both core distances and their own distance.  within: a column whose values are clustered apart, in one job; it
    is returned too, and labels count from 0 in each.  near: the max(k, min_samples) nearest of each, where they are known.
    """
    near = stash(knn(vectors, max(k, min_samples), within=within), "knn") if near is None else near
    core = near.where(F.col("rank") == min_samples).select(F.col("src").alias("node"), F.col("distance").alias("core"))
    e = near.join(core.select(F.col("node").alias("src"), F.col("core").alias("ca")), "src").join(core.select(F.col("node").alias("dst"), F.col("core").alias("cb")), "dst")
    e = e.where(F.greatest("ca", "cb", "distance") <= epsilon).select("src", "dst")
    c = components(vectors.select(F.col("phrase_id").alias("node")), e)
    n = c.groupBy("component").agg(F.count("*").alias("n"))
    kept = c.join(n, "component").select(F.col("node").alias("phrase_id"), F.when(F.col("n") >= min_size, F.col("component")).otherwise(-1).alias("cluster_id"))
    if not within:
        return renumbered(kept, "cluster_id").select("phrase_id", "cluster_id")
    placed = stash(kept.join(vectors.select("phrase_id", within), "phrase_id"), "placed")
    order = placed.where("cluster_id <> -1").select(within, "cluster_id").distinct().withColumn("_new", F.row_number().over(Window.partitionBy(within).orderBy("cluster_id")) - 1)
    return placed.join(order, [within, "cluster_id"], "left").select("phrase_id", within, F.coalesce("_new", F.lit(-1)).cast("int").alias("cluster_id"))


def sub_clusters(vectors: DataFrame, min_size: int = 10, min_samples: int = 2, epsilon: float = 0.9, k: int = 20) -> DataFrame:
    """Vectors (with parent) clustered by density inside each parent, all in one job.

    Id = parent * 10000 + local label; points in no cluster are -1, as are those whose parent is noise.
    """
    inside = density_clusters(vectors.where("parent <> -1"), min_size, min_samples, epsilon, k, within="parent")
    ids = inside.select("phrase_id", F.when(F.col("cluster_id") != -1, F.col("parent") * 10_000 + F.col("cluster_id")).alias("new"))
    return vectors.select("phrase_id").join(ids, "phrase_id", "left").select("phrase_id", F.coalesce("new", F.lit(-1)).cast("int").alias("cluster_id"))


def resplit(vectors: DataFrame, labels: DataFrame, cluster_id: int, start: int = 1001, **how) -> DataFrame:
    """One cluster clustered anew; its parts get ids from `start`, the others keep theirs."""
    own = labels.where(F.col("cluster_id") == cluster_id).select("phrase_id")
    parts = density_clusters(vectors.join(own, "phrase_id", "left_semi"), **how)
    shifted = parts.select("phrase_id", F.when(F.col("cluster_id") == -1, -1).otherwise(F.col("cluster_id") + start).cast("int").alias("new"))
    return labels.join(shifted, "phrase_id", "left").select("phrase_id", F.coalesce("new", "cluster_id").alias("cluster_id"))


def kmeans(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """V12."""
    data = as_ml(vectors)
    return KMeans(k=k, seed=seed, maxIter=20).fit(data).transform(data).select("phrase_id", F.col("prediction").alias("cluster_id"), "embedding")


def bisecting(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """A divisive hierarchy cut at k clusters."""
    data = as_ml(vectors)
    return BisectingKMeans(k=k, seed=seed, maxIter=10).fit(data).transform(data).select("phrase_id", F.col("prediction").alias("cluster_id"), "embedding")


def centroid_indices(labelled: DataFrame) -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz from centroids, over all points of clusters, in one row."""
    v = labelled.where("cluster_id <> -1").select("phrase_id", "cluster_id", F.col("embedding").cast("array<double>").alias("e"))
    long = v.select("phrase_id", "cluster_id", F.posexplode("e").alias("d", "x"))
    cents = stash(long.groupBy("cluster_id", "d").agg(F.avg("x").alias("c"), F.count("*").alias("n")), "centroids")
    grand = long.groupBy("d").agg(F.avg("x").alias("g"))
    dist = long.join(cents, ["cluster_id", "d"]).groupBy("phrase_id", "cluster_id").agg(F.sum(F.pow(F.col("x") - F.col("c"), 2)).alias("d2"))
    per = stash(dist.groupBy("cluster_id").agg(F.avg(F.sqrt("d2")).alias("s"), F.sum("d2").alias("within"), F.count("*").alias("n")), "within")
    between = cents.join(grand, "d").agg(F.sum(F.col("n") * F.pow(F.col("c") - F.col("g"), 2)).alias("between"))
    # pairs of clusters, not of points; centroids as arrays, so that each pair is one row
    rows = cents.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "c"))), lambda x: x["c"]).alias("e"))
    a, b = rows.alias("a"), rows.alias("b")
    m = F.expr("sqrt(aggregate(zip_with(a.e, b.e, (x, y) -> (x - y) * (x - y)), 0D, (acc, v) -> acc + v))")
    apart = a.join(b, F.col("a.cluster_id") != F.col("b.cluster_id")).select(F.col("a.cluster_id").alias("i"), F.col("b.cluster_id").alias("j"), m.alias("m"))
    si, sj = per.select(F.col("cluster_id").alias("i"), F.col("s").alias("si")), per.select(F.col("cluster_id").alias("j"), F.col("s").alias("sj"))
    db = apart.join(si, "i").join(sj, "j").groupBy("i").agg(F.max(F.try_divide(F.col("si") + F.col("sj"), F.col("m"))).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    totals = per.agg(F.sum("within").alias("within"), F.sum("n").alias("n"), F.count("*").alias("k"))
    ch = totals.join(F.broadcast(between)).select(F.try_divide(F.col("between") * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1)).alias("calinski_harabasz"))
    return db.join(F.broadcast(ch))


def validity(labelled: DataFrame, n_sample: int = 500) -> DataFrame:
    """The indices of centroids, and the silhouette of a hash sample of stated size, in one row."""
    v = labelled.where("cluster_id <> -1").select("phrase_id", "cluster_id", F.col("embedding").cast("array<double>").alias("e"))
    return centroid_indices(labelled).join(F.broadcast(silhouette(v, n_sample)))


def silhouette(v: DataFrame, n_sample: int) -> DataFrame:
    """Mean silhouette, plain Euclidean, of a hash sample of at most n_sample points against each other."""
    s = sample(v, n_sample, 42, "phrase_id")
    a, b = s.alias("a"), F.broadcast(s.alias("b"))
    d = F.expr("sqrt(aggregate(zip_with(a.e, b.e, (x, y) -> (x - y) * (x - y)), 0D, (acc, t) -> acc + t))")
    pairs = a.join(b, F.col("a.phrase_id") != F.col("b.phrase_id")).groupBy(F.col("a.phrase_id").alias("p"), F.col("a.cluster_id").alias("own"), F.col("b.cluster_id").alias("c")).agg(F.avg(d).alias("d"))
    x = pairs.groupBy("p").agg(F.max(F.when(F.col("c") == F.col("own"), F.col("d"))).alias("a"), F.min(F.when(F.col("c") != F.col("own"), F.col("d"))).alias("b"))
    return x.agg(F.avg(F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))).alias("silhouette"))


def whole_silhouette(labelled: DataFrame) -> DataFrame:
    """Mean silhouette, plain Euclidean, over all points of clusters, with their number, in one row; a point alone in its cluster counts 0.

    Blocks of points meet blocks of points and send on, for each point, the sum of its distances to each cluster in the block: no pair leaves a task.  Without points, or with one cluster only, the mean is null or 0.
    """
    v = stash(labelled.where("cluster_id <> -1 and embedding is not null").select("phrase_id", F.col("cluster_id").cast("long").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(0).alias("cell")), "points")
    schema = pa.schema([("p", pa.int64()), ("own", pa.int64()), ("c", pa.int64()), ("d", pa.float64()), ("n", pa.int64())])

    def sums(q: pa.Table, t: pa.Table) -> pa.Table:
        if not q.num_rows or not t.num_rows:
            return schema.empty_table()
        x, y, ids, own, others = _matrix(q["embedding"]), _matrix(t["embedding_"]), q["phrase_id"].to_numpy(), q["cluster_id"].to_numpy(), t["phrase_id_"].to_numpy()
        clusters, at = np.unique(t["cluster_id_"].to_numpy(), return_inverse=True)
        member = np.zeros((len(others), len(clusters)))
        member[np.arange(len(others)), at] = 1
        total, count = np.empty((len(ids), len(clusters))), np.tile(member.sum(axis=0), (len(ids), 1))
        for s in range(0, len(ids), 256):
            z = x[s : s + 256]
            d = np.sqrt(np.maximum(0.0, (z * z).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * z @ y.T))
            same = ids[s : s + 256, None] == others[None, :]
            d[same] = 0
            total[s : s + 256] = d @ member
            count[s : s + 256] -= same @ member
        k = len(clusters)
        return pa.Table.from_arrays([pa.array(np.repeat(ids, k)), pa.array(np.repeat(own, k)), pa.array(np.tile(clusters, len(ids))), pa.array(total.ravel()), pa.array(count.ravel().astype(np.int64))], schema=schema)

    part = co_blocks(v, v).applyInArrow(sums, "p long, own long, c long, d double, n long").groupBy("p", "own", "c").agg((F.try_divide(F.sum("d"), F.sum("n"))).alias("d"))
    x = part.groupBy("p").agg(F.max(F.when(F.col("c") == F.col("own"), F.col("d"))).alias("a"), F.min(F.when(F.col("c") != F.col("own"), F.col("d"))).alias("b"))
    one = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return x.agg(F.count("*").alias("n"), F.avg(one).alias("silhouette"))


def search_k(vectors: DataFrame, ks: list[int], n_sample: int = 10_000) -> DataFrame:
    """Each k fitted on a hash sample, with the validity of the whole sample, best silhouette first."""
    s = stash(sample(vectors, n_sample, 42, "phrase_id"), "sample")
    out = None
    for k in ks:
        fitted = stash(kmeans(s, k), "fitted")
        row = centroid_indices(fitted).join(F.broadcast(whole_silhouette(fitted).select("silhouette"))).select(F.lit(k).alias("k"), "silhouette", "davies_bouldin", "calinski_harabasz")
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("silhouette"), "k")


def kmeans_within(vectors: DataFrame, rounds: int = 10) -> DataFrame:
    """(phrase_id, cluster_id, part): k-means in every cluster at once, from vectors with cluster_id and n_parts.

    The few centres of a cluster are one array (n_parts of them, no more), so each round is one join by cluster_id, which leaves a cluster of any size spread over
    tasks, and one map-side combined mean; no point is shuffled by its id.  The first centre of a cluster is the point farthest from its mean, each further one the point
    farthest from those before; parts are numbered in that order and may be fewer where points coincide.
    """
    v = stash(vectors.select("phrase_id", "cluster_id", "n_parts", F.col("embedding").cast("array<double>").alias("e")), "points")
    mean = lambda d, keys: d.select(*keys, array_to_vector("e").alias("f")).groupBy(*keys).agg(Summarizer.mean(F.col("f")).alias("m")).select(*keys, vector_to_array("m").alias("c"))

    def met(centres: DataFrame) -> DataFrame:
        """Points with the nearest centre of their cluster: its distance, squared, and its part."""
        arrays = centres.groupBy("cluster_id").agg(F.collect_list(F.struct("part", "c")).alias("cs"))
        near = F.array_min(F.transform("cs", lambda x: F.struct(F.aggregate(F.zip_with("e", x["c"], lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d).alias("d"), x["part"].alias("part"))))
        return v.join(arrays, "cluster_id").withColumn("near", near).select("phrase_id", "cluster_id", "n_parts", "e", "near.d", "near.part")

    most = v.agg(F.max("n_parts")).first()[0] or 0
    centres = mean(v, ["cluster_id"]).withColumn("part", F.lit(-1))
    for part in range(most):
        d = met(centres).where((F.col("n_parts") > part) & (F.col("d") > 0))
        far = d.groupBy("cluster_id").agg(F.max_by("e", F.struct("d", -F.col("phrase_id"))).alias("c")).withColumn("part", F.lit(part))
        centres = stash((centres.where("part >= 0") if part else far.limit(0)).unionByName(far), "centres")
    for _ in range(rounds):
        new = stash(mean(met(centres), ["cluster_id", "part"]).select("cluster_id", "c", "part"), "centres")
        still = new.exceptAll(centres.select("cluster_id", "c", "part")).isEmpty()
        forget(centres)
        centres = new
        if still:
            break
    return met(centres).select("phrase_id", "cluster_id", "part")


def split_inconsistent(vectors: DataFrame, labels: DataFrame, verdicts: DataFrame, least: int = 5, below: float = 0.7) -> DataFrame:
    """Clusters of enough phrases that a verdict (cluster_id, consistent, score, n_parts) calls inconsistent, split by k-means; new ids follow the largest.

    n_parts is 2 where the verdict names none.
    """
    size = labels.groupBy("cluster_id").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("cluster_id") != -1))
    bad = verdicts.where(~F.col("consistent") | (F.col("score") < below)).join(size, "cluster_id").select("cluster_id", F.coalesce("n_parts", F.lit(2)).alias("n_parts"))
    local = stash(kmeans_within(vectors.select("phrase_id", "embedding").join(labels, "phrase_id").join(bad, "cluster_id")), "parts")
    ids = numbered(local.select("cluster_id", "part").distinct(), ["cluster_id", "part"])
    top = labels.agg(F.max("cluster_id").alias("top"))  # one row
    moved = local.join(ids.join(F.broadcast(top)).select("cluster_id", "part", (F.col("number") + F.col("top")).alias("new")), ["cluster_id", "part"]).select("phrase_id", "new")
    return labels.join(moved, "phrase_id", "left").select("phrase_id", F.coalesce("new", "cluster_id").cast("int").alias("cluster_id"), F.when(F.col("new").isNotNull(), F.col("cluster_id")).alias("parent"))


def mixtures(vectors: DataFrame, ks: list[int], seed: int = 42) -> DataFrame:
    """Gaussian mixtures compared by log-likelihood, AIC and BIC (full covariance)."""
    data = as_ml(vectors).persist()
    n, rows = data.count(), []
    if not n:
        return vectors.sparkSession.createDataFrame([], "k int, log_likelihood double, aic double, bic double")
    d = len(data.first().embedding)
    for k in ks:
        ll = float(GaussianMixture(k=k, seed=seed, maxIter=5).fit(data).summary.logLikelihood)
        free = k - 1 + k * d + k * d * (d + 1) // 2
        rows.append((k, ll, 2.0 * free - 2 * ll, float(free * math.log(max(n, 1)) - 2 * ll)))
    data.unpersist()
    return vectors.sparkSession.createDataFrame(rows, "k int, log_likelihood double, aic double, bic double")


def density_sweep(vectors: DataFrame, grid: list[tuple[int, int]], epsilon: float) -> DataFrame:
    """Clusters, noise and sizes for each (min_size, min_samples)."""
    near = {k: stash(knn(vectors, k), "knn") for k in {max(20, samples) for _, samples in grid}}
    out = None
    for size, samples in grid:
        c = density_clusters(vectors, size, samples, epsilon, 20, near=near[max(20, samples)]).groupBy("cluster_id").agg(F.count("*").alias("n"))
        real = F.when(F.col("cluster_id") != -1, F.col("n"))
        row = c.agg(F.count(real).alias("n_clusters"), (F.coalesce(F.sum(F.when(F.col("cluster_id") == -1, F.col("n"))), F.lit(0)) / F.sum("n")).alias("noise"), F.min(real).alias("least"), F.max(real).alias("most"))
        row = row.select(F.lit(size).alias("min_size"), F.lit(samples).alias("min_samples"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def greedy_groups(phrases: DataFrame, pairs: DataFrame) -> DataFrame:
    """(member, leader): phrases in order of id; each takes the first earlier leader that is similar, else leads.

    pairs: (a, b) with a < b.  Rounds settle all phrases whose earlier similar ones are settled: a phrase is a leader once no earlier one
    that is similar can be, and a member once one is; no chain is closed transitively.
    """
    nodes = phrases.select(F.col("phrase_id").alias("node"))
    e = stash(pairs.select("a", "b").distinct(), "pairs")
    state = stash(nodes.withColumn("leader", F.lit(None).cast("long")), "groups")
    while True:
        lead = state.where("leader = node").select(F.col("node").alias("a"))
        open_ = state.where("leader is null").select("node")
        if open_.isEmpty():
            break
        by = e.join(lead, "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("first"))
        wait = e.join(open_.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("open"))
        x = state.join(by, "node", "left").join(wait, "node", "left")
        settled = F.when(F.col("first").isNotNull() & (F.col("open").isNull() | (F.col("first") < F.col("open"))), F.col("first")).when(F.col("first").isNull() & F.col("open").isNull(), F.col("node"))
        new = stash(x.select("node", F.coalesce("leader", settled).alias("leader")), "groups")
        forget(state)
        state = new
    return state.select(F.col("node").alias("member"), "leader")
