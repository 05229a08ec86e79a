"""Similarity graphs: edges, statistics, components and communities.  Edges: (src, dst, weight), src < dst."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import forget, stash
from .relate import renumbered

#: Edges up to which what is left of a contraction is finished in one task; the count is checked.
FEW = 200_000


def knn_edges(neighbours: DataFrame, least: float = 0.6) -> DataFrame:
    """V4: (i, j) with i < j where j is among the neighbours of i and their weight 1 - d^2 / 2 is at least `least`."""
    w = 1 - F.col("distance") * F.col("distance") / 2
    return neighbours.where("src < dst").select("src", "dst", w.alias("weight")).where(F.col("weight") >= least)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def roots(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of undirected edges (src, dst) reaches, itself included.

    Alternates large-star and small-star steps.  Minima are partial aggregates and the joins that carry them back can be
    split by AQE, so a node with very many neighbours is no bottleneck; the number of rounds grows with the logarithm of a
    component's diameter.  Each round is a table in the shared folder.  At most FEW edges are joined in one task instead.
    """

    def star(sym: DataFrame) -> DataFrame:
        low = sym.groupBy("src").agg(F.min("dst").alias("m"))
        return sym.join(low.withColumn("m", F.least("m", "src")), "src")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    e = stash(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    before = mark(e)
    while before[0] > FEW:
        large = star(e.union(e.select("dst", "src"))).where("dst > src and dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        near = star(large)
        small = near.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(near.select("src", F.col("m").alias("dst"))).distinct()
        new = stash(small, "edges")
        after = mark(new)
        forget(e)
        e = new
        if after == before:
            break
        before = after
    if before[0] <= FEW:
        return _few_roots(e)
    both = e.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(e.select(F.col("dst").alias("node"), F.col("dst").alias("root")))
    return both.groupBy("node").agg(F.min("root").alias("root"))


def _few_roots(edges: DataFrame) -> DataFrame:
    """What roots() returns, in one task: the least label of each end goes to the root of the other, labels are followed to their end, until none changes."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(b.column("src").to_numpy(), b.column("dst").to_numpy()) for b in batches if b.num_rows]
        if not ends:
            return
        src, dst = (np.concatenate(x) for x in zip(*ends))
        ids, at = np.unique(np.concatenate((src, dst)), return_inverse=True)  # in order, so the least number is the least id
        a, b = at[: len(src)], at[len(src) :]
        root = np.arange(len(ids))
        while (root[a] != root[b]).any():
            ra, rb = root[a], root[b]
            np.minimum.at(root, ra, rb)
            np.minimum.at(root, rb, ra)
            while (root != root[root]).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["node", "root"])

    return edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).coalesce(1).mapInArrow(join, "node long, root long")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached."""
    return nodes.select("node").join(roots(edges), "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def statistics(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """V5: nodes, edges, kept share of possible edges, mean degree, density, components."""
    n = nodes.agg(F.count("*").alias("n_nodes"))
    m = edges.agg(F.count("*").alias("n_edges"))
    c = components(nodes, edges).agg(F.count_distinct("component").alias("n_components"))
    s = n.join(F.broadcast(m)).join(F.broadcast(c))  # one row each
    v, e = F.col("n_nodes"), F.col("n_edges")
    return s.select(
        "n_nodes", "n_edges", (v * k).alias("potential_edges"), F.round(1 - F.try_divide(e, v * k), 6).alias("filter_rate"), F.round(F.try_divide(2 * e, v), 6).alias("mean_degree"),
        F.round(F.try_divide(2 * e, v * (v - 1)), 6).alias("density"), "n_components",
    )


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """V7: weighted modularity of labels (node, community), in one row."""
    a, b = labels.select(F.col("node").alias("src"), F.col("community").alias("ca")), labels.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    e = edges.join(a, "src").join(b, "dst")
    inside = e.groupBy(F.col("ca").alias("c")).agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("w_in"))
    degree = e.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), "weight"), F.struct(F.col("cb").alias("c"), "weight"))).alias("x")).select("x.*").groupBy("c").agg(F.sum("weight").alias("deg"))
    m = edges.agg(F.sum("weight").alias("m"))
    q = degree.join(inside, "c", "left").join(F.broadcast(m))
    return q.agg(F.round(F.coalesce(F.sum(F.coalesce("w_in", F.lit(0.0)) / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), 2)), F.lit(0.0)), 9).alias("modularity"))


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 10, resolution: float = 1.0) -> DataFrame:
    """V6: communities by synchronous local moves of the Louvain gain.

    Each node starts alone.  In each round the nodes of one hash parity move to the neighbouring community with the largest gain in
    weighted modularity, the least id on a tie.  Stops when two rounds on end move nothing.
    """
    sym = stash(both_ways(edges), "sym")
    degree = stash(sym.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k")), "degree")
    two_m = F.lit(float(degree.agg(F.coalesce(F.sum("k"), F.lit(1.0))).first()[0]))
    labels = stash(nodes.select("node", F.col("node").alias("community")), "labels")
    still = 0
    for r in range(rounds):
        total = labels.join(degree, "node").groupBy("community").agg(F.sum("k").alias("tot"))
        # a loop stays inside wherever its node goes
        to = sym.where("src <> dst").join(labels.select(F.col("node").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.sum("weight").alias("w"))
        own = labels.select(F.col("node").alias("src"), F.col("community").alias("own"))
        cand = to.join(own, "src").join(total, "community").join(degree.select(F.col("node").alias("src"), "k"), "src")
        rest = F.col("tot") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.col("w") - resolution * rest * F.col("k") / two_m
        stay = F.when(F.col("community") == F.col("own"), gain)
        best = cand.withColumn("gain", gain).groupBy("src").agg(F.max_by("community", F.struct("gain", -F.col("community"))).alias("to"), F.max("gain").alias("gain"), F.max(stay).alias("stay"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == r % 2
        move = turn & F.col("to").isNotNull() & (F.col("gain") > F.coalesce("stay", F.lit(0.0)) + 1e-12)
        new = stash(labels.join(best.withColumnRenamed("src", "node"), "node", "left").select("node", F.when(move, F.col("to")).otherwise(F.col("community")).alias("community"), F.coalesce(move & (F.col("to") != F.col("community")), F.lit(False)).alias("moved")), "labels")
        moved = new.where("moved").count()
        forget(labels)
        labels = new.drop("moved")
        labels.stash_path = new.stash_path
        still = still + 1 if not moved else 0
        if still == 2:
            break
    for t in (sym, degree):
        forget(t)
    return labels


def contracted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between communities, weights summed; those inside one are its loop (src = dst)."""
    a, b = labels.select(F.col("node").alias("src"), F.col("community").alias("ca")), labels.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    e = edges.join(a, "src").join(b, "dst").select(F.least("ca", "cb").alias("src"), F.greatest("ca", "cb").alias("dst"), "weight")
    return e.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def louvain_levels(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, levels: int = 20, rounds: int = 10) -> list[tuple[DataFrame, float]]:
    """V6: the labels (node, community) of each level with their modularity, which rises from level to level.

    A level moves nodes as communities() does, then its communities become the nodes of the next one: edges between two are summed to one edge, those inside to a
    loop, which counts twice in the degree.  Ends where a level merges nothing or modularity would not rise.
    """
    of = stash(nodes.select("node", F.col("node").alias("community")), "level")
    graph, quality = stash(edges.select("src", "dst", "weight"), "graph"), None
    out: list[tuple[DataFrame, float]] = []
    for _ in range(levels):
        labels = communities(of.select(F.col("community").alias("node")).distinct(), graph, rounds, resolution)
        higher = stash(contracted(graph, labels), "graph")
        # of a contracted graph with each node alone: loops inside, degrees squared expected
        s = stash(both_ways(higher), "sym")
        m2 = s.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
        inside = s.where("src = dst").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
        squares = s.groupBy("src").agg(F.sum("weight").alias("k")).agg(F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0.0))).first()[0]
        new = inside / m2 - resolution * squares / (m2 * m2) if m2 else 0.0
        for t in (s, graph):
            forget(t)
        if quality is not None and new <= quality + 1e-9:
            break
        quality = new
        of = stash(of.join(labels.select(F.col("node").alias("community"), F.col("community").alias("next")), "community").select("node", F.col("next").alias("community")), "level")
        out.append((of, quality))
        forget(labels)
        graph = higher
    return out


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """V6: (node, community) of the last level: communities in order of their least node, from 0; nodes without edges are alone, an empty graph gives no rows."""
    of = louvain_levels(nodes, edges, resolution)[-1][0]
    first = of.groupBy("community").agg(F.min("node").alias("least"))
    return renumbered(of.join(first, "community").select("node", F.col("least").alias("community")), "community").select("node", "community")


def prune(labels: DataFrame, least: int = 10) -> DataFrame:
    """V8: communities of fewer nodes become -1; the others 0, 1, ... in the order of their labels."""
    n = labels.groupBy("community").agg(F.count("*").alias("n"))
    kept = labels.join(n, "community").select("node", F.when(F.col("n") >= least, F.col("community")).otherwise(-1).alias("community"))
    return renumbered(kept, "community").select("node", "community")
