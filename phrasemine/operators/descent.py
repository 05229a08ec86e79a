"""Neighbour graphs without comparing all pairs: neighbours of neighbours are likely neighbours.

Every vector starts with the nearest ones of a few small random groups.  In each round the vectors that one vector has in its list, or that have it in theirs, are compared with each
other where one of both is new there; each keeps the best it has seen.  Rounds end when hardly any list changes.  The result is approximate; knn() is the exact way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import forget, stash
from .vectors import _matrix, normalised

#: Vectors of a random group; groups of each vector at the start; pivots whose lists are compared in one task call.
GROUP, STARTS, PIVOTS = 256, 2, 256
FOUND = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("distance", pa.float64())])


def _distances(a: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * np.round(a @ a.T, 12)))


def _start(unit: DataFrame, n: int, pool: int) -> DataFrame:
    """The nearest of each vector in its random groups."""

    def near(t: pa.Table) -> pa.Table:
        ids, d = t["phrase_id"].to_numpy(), _distances(_matrix(t["embedding"]))
        np.fill_diagonal(d, np.inf)
        k = min(pool, len(ids) - 1)
        if k < 1:
            return FOUND.empty_table()
        to = np.argpartition(d, k - 1, axis=1)[:, :k]
        return pa.Table.from_arrays([pa.array(np.repeat(ids, k)), pa.array(ids[to].ravel()), pa.array(np.take_along_axis(d, to, axis=1).ravel())], schema=FOUND)

    groups = max(1, round(n / GROUP))
    dealt = unit.withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(STARTS)))).withColumn("g", F.pmod(F.xxhash64("phrase_id", "start"), F.lit(groups)))
    return dealt.groupBy("start", "g").applyInArrow(near, "src long, dst long, distance double")


def _best(edges: DataFrame, pool: int) -> DataFrame:
    """The nearest `pool` of each list; what was there before is not new."""
    once = edges.groupBy("src", "dst").agg(F.min("distance").alias("distance"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))
    return once.withColumn("rank", rank).where(F.col("rank") <= pool)


def _compared(lists: DataFrame, unit: DataFrame, n: int, pool: int) -> DataFrame:
    """Pairs within the lists of each pivot that are nearer than the last one in the list of either."""
    there = lists.select(F.col("src").alias("pivot"), F.col("dst").alias("m"), "new")
    # as many that have the pivot in their lists, chosen by hash: some vectors are in very many
    back = lists.select(F.col("dst").alias("pivot"), F.col("src").alias("m"), "new")
    back = back.withColumn("_r", F.row_number().over(Window.partitionBy("pivot").orderBy(F.desc("new"), F.xxhash64("m", "pivot")))).where(F.col("_r") <= pool).drop("_r")
    members = there.unionByName(back).groupBy("pivot", "m").agg(F.max("new").alias("new"))
    last = lists.groupBy(F.col("src").alias("phrase_id")).agg(F.count("*").alias("k"), F.max("distance").alias("d"))
    bound = unit.join(last, "phrase_id", "left").select(F.col("phrase_id").alias("m"), "embedding", F.when(F.col("k") == pool, F.col("d")).otherwise(F.lit(float("inf"))).alias("bound"))

    def compare(t: pa.Table) -> pa.Table:
        pivot, m, new, bound_ = (t[c].to_numpy() for c in ("pivot", "m", "new", "bound"))
        e = _matrix(t["embedding"])
        order = np.argsort(pivot, kind="stable")
        out = []
        for rows in np.split(order, np.flatnonzero(np.diff(pivot[order])) + 1):
            if len(rows) > 1 and new[rows].any():
                d = _distances(e[rows])
                d[~(new[rows][:, None] | new[rows][None, :])] = np.inf
                np.fill_diagonal(d, np.inf)
                i, j = np.nonzero(d < bound_[rows][:, None])
                out.append((m[rows][i], m[rows][j], d[i, j]))
        if not out:
            return FOUND.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=FOUND)

    blocks = max(1, -(-n // PIVOTS))
    return members.join(bound, "m").withColumn("b", F.pmod(F.xxhash64("pivot"), F.lit(blocks))).groupBy("b").applyInArrow(compare, "src long, dst long, distance double")


def descend(vectors: DataFrame, k: int, pool: int | None = None, rounds: int = 12, still: float = 0.002) -> DataFrame:
    """V4: (src, dst, rank, distance) as knn() gives it, approximately: the k nearest others of each vector, from lists of `pool` (4 k unless given).

    Ends after `rounds`, or when a round changes no more than the share `still` of all list entries.  Null vectors take no part; one vector has no neighbours.
    """
    pool = pool or 4 * k
    unit = stash(normalised(vectors.where("embedding is not null").select("phrase_id", "embedding"), "float64"), "unit")
    n = unit.count()
    lists = stash(_best(_start(unit, n, pool).withColumn("new", F.lit(True)), pool), "lists")
    for _ in range(rounds):
        found = _compared(lists, unit, n, pool)
        known = lists.select("src", "dst", "distance", F.lit(False).alias("new"))
        better = stash(_best(known.unionByName(found.withColumn("new", F.lit(True))), pool), "lists")
        changed = better.where("new").count()
        forget(lists)
        lists = better
        if changed <= still * n * pool:
            break
    return lists.where(F.col("rank") <= k).select("src", "dst", "rank", "distance")
