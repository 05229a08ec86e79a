"""Nearest neighbours through vantage-point trees, one for each shard of the vectors.

A tree over a bounded sample deals all vectors to shards: at each node by their distance to a vantage point, within the median or beyond it.  A crowded shard is cut into
blocks.  A query searches its own shard first, whose k-th distance is its radius; it then visits the other shards that the radius can reach.  In a block, a tree of its own
orders leaves by the least distance that the triangle inequality leaves them.

A shard or leaf is skipped where `factor` times that least distance exceeds the radius.  Factor one is exact: nothing that could be nearer is skipped.  In many dimensions
distances are alike and the inequality proves little; a larger factor takes the bound for a sign and skips more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash
from .whitening import finite

K = 10
#: Production value of `factor`; recall is in the README.
FACTOR = 5.0
#: Vectors in a shard, on average; most vectors and most queries that meet in one task; vectors in a leaf; vectors that shards are learned from, and of them in each shard at least.
SHARD, BLOCK, ASKED, LEAF, SAMPLE, LEARN = 8192, 32_768, 4096, 64, 16_384, 16
#: What rounding may take from a bound.
SLACK = 1e-9


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])]
    return (np.concatenate(flat) if flat else np.empty(0)).astype(np.float64).reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between rows of a and of b, by products: good to about 1e-7 for unit vectors near each other, and never the result."""
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of a to the rows of b beside them, in double precision."""
    d = a - b
    return np.sqrt((d * d).sum(axis=1))


class Tree:
    """A vantage-point tree over vectors.  Nodes in order of depth: vantage point, the children and the shell of distances that each child's vectors lie in; leaves hold row numbers."""

    def __init__(self, vectors: np.ndarray, leaf: int, open_shells: bool = False):
        self.vantage, self.kids, self.leaves, self.split = [], [], [], []
        todo = [(np.arange(len(vectors)), None, 0)]
        while todo:
            rows, parent, side = todo.pop(0)
            # a far point of a far point: distances to corners spread most
            d = apart(vectors[rows], vectors[rows[0]]) if len(rows) > leaf else None
            if d is not None:
                point = vectors[rows[int(d.argmax())]]
                d = apart(vectors[rows], point)
                middle = float(np.median(d))
                inner = d <= middle
            if d is None or inner.all():  # few vectors, or all as far
                self._link(parent, side, ~len(self.leaves))
                self.leaves.append(rows)
                continue
            at = len(self.vantage)
            self._link(parent, side, at)
            self.vantage.append(point)
            self.split.append(middle)
            # shells of any vector that descends here, or of those at hand
            shells = [(0.0, middle), (middle, np.inf)] if open_shells else [(float(d[m].min()), float(d[m].max())) for m in (inner, ~inner)]
            self.kids.append([[0, *shells[0]], [0, *shells[1]]])
            todo += [(rows[inner], at, 0), (rows[~inner], at, 1)]

    def _link(self, parent: int | None, side: int, child: int) -> None:
        if parent is not None:
            self.kids[parent][side][0] = child

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The least distance that each leaf's vectors can have from each query."""
        out = np.zeros((len(queries), len(self.leaves)))
        if not self.vantage:
            return out
        d = distances(queries, np.array(self.vantage))
        least = {0: np.zeros(len(queries))}
        for node, kids in enumerate(self.kids):
            for child, low, high in kids:
                b = np.maximum(least[node], np.maximum(low - d[:, node], d[:, node] - high))
                if child < 0:
                    out[:, ~child] = b
                else:
                    least[child] = b
        return out

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that each vector descends to."""
        at = np.zeros(len(vectors), dtype=np.int64) if self.vantage else np.full(len(vectors), -1)
        while (at >= 0).any():
            for node in np.unique(at[at >= 0]):
                here = np.flatnonzero(at == node)
                outer = apart(vectors[here], self.vantage[node]) > self.split[node]
                at[here] = np.where(outer, self.kids[node][1][0], self.kids[node][0][0])
        return ~at


def best(q: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest of each query, ties to smaller ids."""
    order = np.lexsort((ids, d, q))
    sorted_q = q[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_q, sorted_q)
    return order[rank < k]


def search(queries: np.ndarray, own: np.ndarray, radius: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, factor: float, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, distance): of one block, the k nearest within each query's radius, but for the id that is its own.

    Each query takes leaves in order of their bounds, one in each round, and stops at the first that its radius, which shrinks as it finds, does not reach.
    """
    tree = Tree(vectors, leaf)
    low = tree.bounds(queries) * factor
    order, radius = np.argsort(low, axis=1, kind="stable"), radius.copy()
    q, d, found = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
    for turn in range(len(tree.leaves)):
        asked = np.flatnonzero(low[np.arange(len(queries)), order[:, turn]] <= radius + SLACK)
        if not len(asked):
            break
        new_q, new_at = [], []
        for leaf_no in np.unique(order[asked, turn]):
            who, rows = asked[order[asked, turn] == leaf_no], tree.leaves[leaf_no]
            i, j = np.nonzero(distances(queries[who], vectors[rows]) <= radius[who][:, None] + 1e-6)
            new_q.append(who[i])
            new_at.append(rows[j])
        i, j = np.concatenate(new_q), np.concatenate(new_at)
        other = ids[j] != own[i]
        i, j = i[other], j[other]
        q, d, found = np.concatenate((q, i)), np.concatenate((d, apart(queries[i], vectors[j]))), np.concatenate((found, ids[j]))
        take = best(q, d, found, k)
        q, d, found = q[take], d[take], found[take]
        many = np.bincount(q, minlength=len(queries)) >= k
        last = np.zeros(len(queries))
        np.maximum.at(last, q, d)
        radius = np.where(many, np.minimum(radius, last), radius)
    near = d <= radius[q] + SLACK
    return q[near], found[near], d[near]


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD, block: int = BLOCK, asked: int = ASKED, sampled: int = SAMPLE
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of `vectors` for each row of `queries`, by Euclidean distance in double precision, ties to smaller ids.

    Queries and vectors are rows with an integer key and an array of numbers.  A row whose key or vector is null, or whose vector is zero or has null or non-finite entries, takes no part; of several widths
    the commonest of `vectors` does, the larger on a tie.  Rows that repeat key and vector count once; a key with several vectors is several queries and candidates, none of which finds another.
    Of copies of one vector only the k + 1 smallest keys can be among the nearest, so no more are searched.  All others are in a shard, whatever its size.  Fewer than k candidates give fewer rows, an empty
    table none; further columns are not read.
    """
    spark = vectors.sparkSession
    square = F.aggregate(vector, F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).withColumnRenamed("v", vector).where(F.col("id").isNotNull() & finite(F.col(vector)) & (F.size(vector) > 0))
        return rows.where(square > 0).select("id", F.col(vector).alias("v"))

    top = clean(vectors).groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if top is None:
        return spark.createDataFrame([], schema)
    distinct = lambda df: clean(df).where(F.size("v") == top.d).dropDuplicates(["id", "v"])
    copies = Window.partitionBy("v").orderBy("id")
    # limited to k + 1 rows of a vector before they are shuffled
    rows = stash(distinct(vectors).withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1).drop("_n"), "vectors")
    n = rows.count()
    picked = matrix(pa.array([r.v for r in rows.orderBy(F.xxhash64("id", "v"), "id").limit(sampled).collect()], pa.list_(pa.float64())))  # at most `sampled` rows
    shards = max(1, min(-(-n // shard), len(picked) // LEARN))
    tree = Tree(picked, -(-len(picked) // shards), open_shells=True)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.place(matrix(b.column("v"))))], names=[*b.schema.names, "shard"])

    kind = rows.schema["v"].dataType.simpleString()
    base = stash(rows.mapInArrow(placed, f"id long, v {kind}, shard long"), "shards")
    asks = stash(distinct(queries).withColumn("q", F.monotonically_increasing_id()).mapInArrow(placed, f"id long, v {kind}, q long, shard long"), "queries")
    sizes = base.groupBy("shard").agg(F.count("*").alias("n")).select("shard", F.ceil(F.col("n") / block).alias("blocks"))

    def met(ask: DataFrame) -> DataFrame:
        """(q, id, d): what each row of ask, a query with a shard and a radius, finds in that shard."""
        parts = ask.groupBy("shard").agg(F.count("*").alias("m")).select("shard", F.ceil(F.col("m") / asked).alias("parts"))
        cut = sizes.join(parts, "shard")  # as many rows as there are shards
        # longs on both sides: rows of a group meet by the hash of their keys
        each = lambda name: F.explode(F.sequence(F.lit(1).cast("long"), F.col(name).cast("long")))
        left = ask.join(F.broadcast(cut), "shard").select("shard", each("blocks").alias("block"), (F.pmod(F.xxhash64("q"), F.col("parts")) + 1).alias("part"), "q", "id", "v", "radius")
        right = base.join(F.broadcast(cut), "shard").select(F.col("shard").alias("s"), (F.pmod(F.xxhash64("id"), F.col("blocks")) + 1).alias("b"), each("parts").alias("p"), F.col("id").alias("vec_id"), F.col("v").alias("w"))

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            out = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
            if a.num_rows and b.num_rows:
                i, ids, d = search(matrix(a["v"]), a["id"].to_numpy(), a["radius"].to_numpy(), matrix(b["w"]), b["vec_id"].to_numpy(), k, factor)
                out = [a["q"].to_numpy()[i], ids, d]
            return pa.Table.from_arrays([pa.array(x) for x in out], names=["q", "vec_id", "d"])

        return left.groupBy("shard", "block", "part").cogroup(right.groupBy("s", "b", "p")).applyInArrow(run, "q long, vec_id long, d double")

    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))
    first = lambda df: df.withColumn("rank", rank).where(F.col("rank") <= k)
    home = stash(first(met(asks.withColumn("radius", F.lit(float("inf"))))).drop("rank"), "home")
    radius = home.groupBy("q").agg(F.count("*").alias("n"), F.max("d").alias("d")).where(F.col("n") == k).select("q", F.col("d").alias("radius"))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each other shard that a query has to visit."""
        for b in batches:
            if b.num_rows:
                own, far = b.column("shard").to_numpy(), tree.bounds(matrix(b.column("v"))) * factor <= b.column("radius").to_numpy()[:, None] + SLACK
                far[np.arange(len(own)), own] = False
                i, to = np.nonzero(far)
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(i)) for c in ("id", "v", "q", "radius")], pa.array(to)], names=["id", "v", "q", "radius", "shard"])

    ask = asks.join(radius, "q", "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf")))).select("id", "v", "q", "shard", "radius")
    beyond = stash(ask.mapInArrow(reached, f"id long, v {kind}, q long, radius double, shard long"), "visits")
    found = first(met(beyond).union(home.select("q", "vec_id", "d")))
    return found.join(asks.select("q", F.col("id").alias("query_id")), "q").select("query_id", "rank", "vec_id", F.col("d").alias("score"))
