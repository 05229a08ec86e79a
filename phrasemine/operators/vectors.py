"""Vectors of phrases: cache, neighbours and profiles.  Vectors: (phrase_id, embedding array<float>)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from ..functions.scratch import stash
from .blocks import meet
from .order import percentiles
from .relate import sample

#: Vectors and queries that meet in one group at most (rows by hash, so nearly); vectors that cells are learned from.
BLOCK, CELL_SAMPLE = 4096, 20_000


def as_ml(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))


def normalised(vectors: DataFrame, dtype: str = "float32") -> DataFrame:
    """V1: unit vectors; a zero vector stays."""
    out = Normalizer(p=2.0, inputCol="features", outputCol="_unit").transform(as_ml(vectors))
    return out.withColumn("embedding", vector_to_array("_unit", dtype)).drop("_unit", "features")


def missing_texts(phrases: DataFrame, cache: DataFrame, model: str, version: str, dim: int) -> DataFrame:
    """V2: texts without a vector of this model, version and width."""
    have = cache.where((F.col("model") == model) & (F.col("version") == version) & (F.col("dim") == dim)).select("text_md5")
    return phrases.select(F.md5("phrase").alias("text_md5"), "phrase").distinct().join(have, "text_md5", "left_anti")


def aligned(phrases: DataFrame, cache: DataFrame) -> DataFrame:
    """V3: phrases with their cached vectors, by the digest of the text; phrases without one are left out together with their id."""
    return phrases.withColumn("text_md5", F.md5("phrase")).join(cache.select("text_md5", "embedding"), "text_md5").drop("text_md5")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(len(column), -1)


def cells(vectors: DataFrame, n: int, most: int = CELL_SAMPLE, seed: int = 42) -> np.ndarray:
    """Centres of n cells, learned by k-means on a hash sample of at most `most` unit vectors."""
    picked = normalised(sample(vectors, most, seed, "phrase_id").select("phrase_id", "embedding"), "float64")
    return np.array(KMeans(k=n, seed=seed, maxIter=10).fit(as_ml(picked)).clusterCenters())


def in_cells(unit: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """Each unit vector (phrase_id, embedding) in its `probes` nearest cells, a row each."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (centres * centres).sum(axis=1) / 2
        for b in batches:
            if not b.num_rows:
                continue
            d = half - _matrix(pa.chunked_array([b.column("embedding")])) @ centres.T
            best = np.argpartition(d, min(probes, len(centres)) - 1, axis=1)[:, :probes]
            take = pa.array(np.repeat(np.arange(b.num_rows), best.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column("phrase_id").take(take), b.column("embedding").take(take), pa.array(best.ravel().astype(np.int64))], names=["phrase_id", "embedding", "cell"])

    return unit.select("phrase_id", "embedding").mapInArrow(near, "phrase_id long, embedding array<double>, cell long")


def co_blocks(asked: DataFrame, unit: DataFrame, block: int = BLOCK) -> PandasCogroupedOps:
    """Rows of asked and of unit with the same cell, co-grouped: each pair of blocks of a cell meets in one group, of at most about block rows a side.

    Both have cell and phrase_id; columns of unit are named with an underscore at the end.
    """
    parts = F.ceil(F.col("n") / F.lit(block))
    # a small table still gives every core some queries
    n_asked = F.greatest(parts, F.least(F.lit(unit.sparkSession.sparkContext.defaultParallelism), F.ceil(F.col("n") / F.lit(64))))
    counted = lambda d, name, n: d.groupBy(F.col("cell").alias("_cell")).agg(F.count("*").alias("n")).select("_cell", n.alias(name))
    sizes = counted(unit, "n_v", parts).alias("a").join(counted(asked, "n_q", n_asked).alias("b"), F.expr("a._cell <=> b._cell")).select("a._cell", "n_v", "n_q")
    dealt = lambda d, own, other: d.join(sizes, F.expr("cell <=> _cell")).select(
        *d.columns, F.pmod(F.xxhash64("phrase_id"), F.col(f"n_{own}")).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}") - 1)).alias(other)
    )
    # under names of their own: a co-group of a table with itself needs columns that it can tell apart
    right = dealt(unit, "v", "q")
    right = right.select(*[F.col(c).alias(f"{c}_") for c in right.columns])
    return dealt(asked, "q", "v").groupBy("cell", "q", "v").cogroup(right.groupBy("cell_", "q_", "v_"))


class Nearest:
    """The k nearest others of each query of a block, among the blocks of unit vectors that meet() is given; ties by id."""

    def __init__(self, k: int, queries: pa.Table):
        self.k, self.ids = k, queries["phrase_id"].to_numpy()
        self.own = -_matrix(queries["embedding"]) if len(self.ids) else np.empty((0, 0))
        # for each 256 queries: the query, the negative product, rounded so that equal vectors tie, and the neighbour
        self.best = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)) for _ in range(0, len(self.ids), 256)]
        # of the k-th, once there is one
        self.most, self.last = np.full(len(self.ids), np.inf), np.zeros(len(self.ids), np.int64)

    def meet(self, vectors: pa.Table) -> None:
        if not (vectors.num_rows and len(self.ids)):
            return
        k, v_ids, all_ = self.k, vectors["phrase_id"].to_numpy(), _matrix(vectors["embedding"]).T
        for n, at in enumerate(range(0, len(self.ids), 256)):
            s = slice(at, at + 256)
            ids, most, last = self.ids[s], self.most[s], self.last[s]
            p = self.own[s] @ all_
            bound = most
            if np.isinf(most).any():
                p[ids[:, None] == v_ids[None, :]] = np.inf
                if len(v_ids) > k:
                    bound = np.fmin(most, np.partition(p, k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero(p <= bound[:, None] + 2e-12)
            x = np.maximum(np.round(p[i, j], 12), -1.0)
            dst = v_ids[j]
            better = np.isfinite(x) & (dst != ids[i]) & ((x < most[i]) | (x == most[i]) & (dst < last[i]))
            if not better.any():
                continue
            i, x, dst = (np.concatenate(c) for c in zip(self.best[n], (i[better], x[better], dst[better])))
            order = np.lexsort((dst, x, i))
            row = i[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            kept = order[place < k]
            self.best[n] = i[kept], x[kept], dst[kept]
            full = order[place == k - 1]
            most[i[full]], last[i[full]] = x[full], dst[full]

    def found(self) -> pa.Table:
        parts = [(self.ids[at * 256 + i], dst, np.sqrt(2 + 2 * x)) for at, (i, x, dst) in enumerate(self.best)]
        src, dst, distance = (np.concatenate(c) for c in zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "distance": pa.array(distance, pa.float64())})


def knn(vectors: DataFrame, k: int, queries: DataFrame | None = None, within: str | None = None, n_cells: int | None = None, probes: int = 8, block: int = BLOCK) -> DataFrame:
    """(src, dst, rank, distance): the k nearest other vectors by distance of unit vectors, ties by id.

    Blocks of queries read the blocks of all vectors one after the other and keep the best of each query (operators/blocks.py): exact at every size, and
    nothing is written for a pair of blocks.  Where cells keep vectors apart, the blocks of a cell meet in groups of bounded size.  within: a column whose values keep vectors apart.  n_cells: vectors are dealt into so many cells, learned
    from a sample, and queries look into their `probes` nearest ones only; a large cell is cut into blocks like the whole.
    """
    keys = [within] if within else []
    unit = normalised(vectors.where("embedding is not null").select("phrase_id", "embedding", *keys), "float64")
    asked = unit if queries is None else normalised(queries.where("embedding is not null").select("phrase_id", "embedding", *keys), "float64")
    if n_cells:
        centres = cells(vectors, n_cells)
        unit, asked = in_cells(unit, centres, 1), in_cells(asked, centres, probes)
    else:
        unit, asked = (d.withColumn("cell", F.col(within) if within else F.lit(0)).select("phrase_id", "embedding", "cell") for d in (unit, asked))
    if n_cells or within:

        def search(q: pa.Table, v: pa.Table) -> pa.Table:
            state = Nearest(k, q)
            state.meet(v.rename_columns([c.rstrip("_") for c in v.column_names]))
            return state.found()

        near = co_blocks(asked, unit, block).applyInArrow(search, "src long, dst long, distance double")
    else:
        near, _ = meet(asked.select("phrase_id", "embedding"), unit.select("phrase_id", "embedding"), lambda q: Nearest(k, q), "src long, dst long, distance double", block)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))).where(F.col("rank") <= k).select("src", "dst", "rank", "distance")


def assign(new: DataFrame, known: DataFrame, k: int = 5, most: float = 0.5) -> DataFrame:
    """New vectors take the commonest cluster of their k nearest clustered ones within cosine distance `most`; the nearest on a tie; -1 without any."""
    near = knn(known, k, new).withColumn("cosine", F.col("distance") * F.col("distance") / 2).where(F.col("cosine") <= most)
    votes = near.join(known.select(F.col("phrase_id").alias("dst"), "cluster_id").where("cluster_id <> -1"), "dst").groupBy("src", "cluster_id").agg(F.count("*").alias("n"), F.min("distance").alias("d"))
    best = votes.groupBy("src").agg(F.max_by("cluster_id", F.struct("n", -F.col("d"), -F.col("cluster_id"))).alias("cluster_id"))
    return new.select(F.col("phrase_id").alias("src")).join(best, "src", "left").select(F.col("src").alias("phrase_id"), F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


def dimension_profile(vectors: DataFrame) -> DataFrame:
    """Mean, deviation, least and most of each dimension."""
    return vectors.select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(*[F.round(f(F.col("x").cast("double")), 6).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("low", F.min), ("high", F.max))])


def distance_profile(vectors: DataFrame, n: int = 500) -> DataFrame:
    """Euclidean distances of all pairs of a hash sample of n vectors, n stated and small: moments, percentiles, a diagnosis."""
    s = sample(vectors, n, 42, "phrase_id").select("phrase_id", F.col("embedding").cast("array<double>").alias("e"))
    a, b = s.alias("a"), F.broadcast(s.alias("b"))
    d = a.join(b, F.col("a.phrase_id") < F.col("b.phrase_id")).select(F.expr("sqrt(aggregate(zip_with(a.e, b.e, (x, y) -> (x - y) * (x - y)), 0D, (acc, v) -> acc + v))").alias("d"))
    p = d.agg(F.avg("d").alias("mean"), F.var_pop("d").alias("var"), F.min("d").alias("low"), F.max("d").alias("high"), F.percentile("d", F.array(*[F.lit(x) for x in (0.01, 0.25, 0.5, 0.75, 0.99)])).alias("percentiles"))
    return p.withColumn("diagnosis", F.when(F.col("mean") > 1.2, "scattered").when(F.col("mean") > 1.0, "fairly scattered").otherwise("compact"))


def neighbour_profile(neighbours: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Mean and largest distance of each point to its nearest k, for several k."""
    near = lambda k: F.when(F.col("rank") <= k, F.col("distance"))
    return neighbours.groupBy("src").agg(*[x for k in ks for x in (F.round(F.avg(near(k)), 6).alias(f"mean_{k}"), F.round(F.max(near(k)), 6).alias(f"max_{k}"))])


def local_density(neighbours: DataFrame, k: int = 20) -> DataFrame:
    """1 / (mean distance to the nearest k + 1e-10)."""
    return neighbours.where(F.col("rank") <= k).groupBy("src").agg((1 / (F.avg("distance") + 1e-10)).alias("density"))


def density_bands(density: DataFrame) -> DataFrame:
    """Points denser than the 90th and sparser than the 10th percentile."""
    density = stash(density.select("density"), "density")
    lo, hi = (F.lit(x).cast("double") for x in percentiles(density, "density", [0.1, 0.9]))
    return density.agg(F.count("*").alias("n"), F.count_if(F.col("density") > hi).alias("dense"), F.count_if(F.col("density") < lo).alias("sparse"), F.round(lo, 6).alias("p10"), F.round(hi, 6).alias("p90"))


def explained_variance(vectors: DataFrame, k: int = 50) -> DataFrame:
    """Variance that each component explains, and the running sum."""
    model = PCA(k=k, inputCol="features", outputCol="p").fit(as_ml(vectors))
    ev = [float(x) for x in model.explainedVariance.toArray()]  # k numbers
    return vectors.sparkSession.createDataFrame([(i + 1, v, float(sum(ev[: i + 1]))) for i, v in enumerate(ev)], "component int, explained double, cumulative double")


def cosine_pairs(neighbours: DataFrame) -> DataFrame:
    """Cosine similarity of neighbours."""
    return neighbours.select("src", "dst", (1 - F.col("distance") * F.col("distance") / 2).alias("cosine"))
