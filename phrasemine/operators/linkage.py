"""Agglomerative clustering: a whole merge tree by rounds of mutually nearest clusters.

Ward's, complete and average linkage never bring a third cluster nearer than both parts of a merger were.  So two clusters that are each other's nearest stay so until they
merge, whatever happens elsewhere, and all such pairs of a round merge at once at the heights that merging one pair after the other gives.  Between two clusters three numbers
are kept, the sum, the largest and the sum of squares of the distances between their members; those of merged clusters are sums and maxima of these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import forget, stash
from .cluster import validity
from .graph import roots
from .relate import renumbered
from .vectors import _matrix, as_ml, co_blocks, normalised

METHODS = ("ward", "complete", "average")
#: Points that pairs are made of; more are grouped first.
MICRO = 2000


def _pairs(points: DataFrame) -> DataFrame:
    """(a, b, d) for a < b: Euclidean distances, block by block."""
    unit = points.select("phrase_id", "embedding", F.lit(0).alias("cell"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.float64())])

    def all_of(q: pa.Table, v: pa.Table) -> pa.Table:
        if not q.num_rows or not v.num_rows:
            return schema.empty_table()
        x, y, a, b = _matrix(q["embedding"]), _matrix(v["embedding_"]), q["phrase_id"].to_numpy(), v["phrase_id_"].to_numpy()
        i, j = np.nonzero(a[:, None] < b[None, :])
        d = np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * np.round(x @ y.T, 12)))[i, j]
        return pa.Table.from_arrays([pa.array(a[i]), pa.array(b[j]), pa.array(d)], schema=schema)

    return co_blocks(unit, unit, 1024).applyInArrow(all_of, "a long, b long, d double")


def merge_tree(points: DataFrame, method: str = "ward", size: DataFrame | None = None) -> DataFrame:
    """(a, b, height, n): every merger of the tree, a and b the least ids of both clusters, n the points of the new one.  points: phrase_id, embedding.

    size: (c, n, inner) of points that stand for groups: how many points, and the sum of squared distances over pairs of them.  Ties are settled by the ids.  One point or none gives no rows.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    if size is None:
        size = points.select(F.col("phrase_id").alias("c"), F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("inner"))
    size = stash(size, "sizes")
    a, b = (size.select(F.col("c").alias(x), F.col("n").alias(f"n_{x}"), F.col("inner").alias(f"i_{x}")) for x in "ab")
    p = _pairs(points).join(a, "a").join(b, "b")
    squares = F.col("n_a") * F.col("n_b") * F.col("d") * F.col("d") + F.col("n_b") * F.col("i_a") / F.col("n_a") + F.col("n_a") * F.col("i_b") / F.col("n_b")
    pairs = stash(p.select("a", "b", (F.col("n_a") * F.col("n_b") * F.col("d")).alias("total"), F.col("d").alias("most"), squares.alias("squares")), "pairs")
    done: list[DataFrame] = []
    while True:
        a, b = (size.select(F.col("c").alias(x), F.col("n").alias(f"n_{x}"), F.col("inner").alias(f"i_{x}")) for x in "ab")
        both = F.col("n_a") * F.col("n_b")
        centres = F.col("squares") / both - F.col("i_a") / (F.col("n_a") * F.col("n_a")) - F.col("i_b") / (F.col("n_b") * F.col("n_b"))
        height = {"average": F.col("total") / both, "complete": F.col("most"), "ward": F.sqrt(F.greatest(F.lit(0.0), 2 * both / (F.col("n_a") + F.col("n_b")) * centres))}[method]
        far = pairs.join(F.broadcast(a), "a").join(F.broadcast(b), "b").select("a", "b", F.round(height, 9).alias("h"))  # sizes: at most MICRO rows
        near = far.select("h", "a", "b", F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.min(F.struct("h", "a", "b")).alias("x"))
        new = stash(near.groupBy("x").count().where("count = 2").select("x.*").join(F.broadcast(a), "a").join(F.broadcast(b), "b").select("a", "b", F.col("h").alias("height"), (F.col("n_a") + F.col("n_b")).alias("n"), "i_a", "i_b"), "mergers")
        if new.isEmpty():
            break
        done.append(new)
        to = new.select(F.col("b").alias("old"), F.col("a").alias("new"))
        moved = pairs.join(F.broadcast(to.select(F.col("old").alias("a"), F.col("new").alias("x"))), "a", "left").join(F.broadcast(to.select(F.col("old").alias("b"), F.col("new").alias("y"))), "b", "left")
        moved = moved.select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"), "total", "most", "squares").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "total", "most", "squares")
        summed = stash(moved.groupBy("a", "b").agg(F.sum("total").alias("total"), F.max("most").alias("most"), F.sum("squares").alias("squares")), "pairs")
        inside = new.join(summed.where("a = b").select("a", "squares"), "a").select(F.col("a").alias("c"), "n", (F.col("i_a") + F.col("i_b") + F.col("squares")).alias("inner"))
        gone = new.select(F.explode(F.array("a", "b")).alias("c"))
        grown = stash(size.join(gone, "c", "left_anti").unionByName(inside), "sizes")
        for t in (pairs, size):
            forget(t)
        pairs, size = stash(summed.where("a <> b"), "pairs"), grown
        forget(summed)
    out = None
    for part in done:
        out = part if out is None else out.unionByName(part)
    return (out if out is not None else size.select(F.col("c").alias("a"), F.col("c").alias("b"), F.col("inner").alias("height"), "n").limit(0)).select("a", "b", "height", "n")


def cut(nodes: DataFrame, tree: DataFrame, n_clusters: int) -> DataFrame:
    """(node, cluster_id): the lowest mergers undone last, until n_clusters are left; clusters from 0 in order of their least node.  A tree over n nodes has n - 1 mergers."""
    mergers = tree.orderBy("height", "n", "a", "b").limit(max(0, nodes.count() - n_clusters))
    to = roots(mergers.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return renumbered(nodes.join(to, "node", "left").select("node", F.coalesce("root", "node").alias("cluster_id")), "cluster_id").select("node", "cluster_id")


def agglomerative(vectors: DataFrame, ns: list[int], method: str = "ward", micro: int = MICRO, seed: int = 42) -> DataFrame:
    """(phrase_id, cluster_id, embedding) of unit vectors, cut where the silhouette is best of the numbers of clusters in ns, the first of equal ones.

    Up to `micro` vectors are merged one by one.  More are first put into that many groups by k-means, which join as one: for Ward's linkage their sizes and inner squares are exact, for
    the others a group stands at its centre.  Null vectors are left out; an empty table gives no rows.
    """
    v = stash(normalised(vectors.where("embedding is not null").select("phrase_id", "embedding"), "float64"), "unit")
    n = v.count()
    if not n:
        return v.select("phrase_id", F.lit(0).alias("cluster_id"), "embedding")
    if n > micro:
        data = as_ml(v)
        model = KMeans(k=micro, seed=seed, maxIter=10, initSteps=2).fit(data)
        of = stash(model.transform(data).select("phrase_id", F.col("prediction").cast("long").alias("c"), "embedding"), "groups")
        long = of.select("c", F.posexplode("embedding").alias("d", "x")).groupBy("c", "d").agg(F.avg("x").alias("x"), F.count("*").alias("n"), F.var_pop("x").alias("s"))
        centre = stash(long.groupBy("c").agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("n")).alias("ss"), F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda y: y["x"]).alias("embedding")), "centres")
        points, size = centre.select(F.col("c").alias("phrase_id"), "embedding"), centre.select("c", "n", (F.col("n") * F.col("ss")).alias("inner"))
    else:
        of, points, size = v.select("phrase_id", F.col("phrase_id").alias("c"), "embedding"), v, None
    tree = stash(merge_tree(points, method, size), "tree")
    nodes = points.select(F.col("phrase_id").alias("node"))
    best = None
    for k in ns:
        labelled = stash(of.join(cut(nodes, tree, k).withColumnRenamed("node", "c"), "c").select("phrase_id", "cluster_id", "embedding"), "labelled")
        score = validity(labelled).first().silhouette if len(ns) > 1 else 0.0
        if best is None or (score or 0.0) > best[0]:
            best = (score or 0.0, labelled)
    return best[1]
