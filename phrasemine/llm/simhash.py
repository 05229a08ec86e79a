"""SimHash near-duplicates found through deletion-variant signatures.

64-bit fingerprints within 4 bits of each other are linked.  Cut into three segments, two such fingerprints differ by
at most one bit in at least one segment (three segments with two bits each would make six).  So each segment is
indexed once for each of its bits with that bit deleted, 64 variants in all; equal variants meet in an equality join
and the pair is verified on all 64 bits.

Where more than PAIRWISE fingerprints share a variant, they are not compared with each other.  Those within 4 bits of the least of them
are linked to it; if that leaves several components in the bucket, the same method is applied again below that variant: the bits
not compared yet are cut into three segments, indexed with one bit deleted each, and so on.  So every pair is still found, or its two sides are
already in one component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import forget, fresh, roots, row_key, stash

SHINGLE, BITS, SEED = 4, 4, 42
#: Fingerprints of one variant that are still compared pairwise; only links leave that join.
PAIRWISE = 512


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as an unsigned integer; zero for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if n < shingle:
        return hashed(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total, count = np.zeros(64, dtype=np.int64), n - shingle + 1
    for k in range(0, count, 65536):  # bounded memory for very long texts
        m = min(65536, count - k)
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[k : k + m].tolist(), ends[k + shingle - 1 : k + shingle - 1 + m].tolist())], dtype=">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > count).tobytes(), "big")


@F.pandas_udf(LongType())
def fingerprint_udf(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in text], dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row for each row of docs; the fingerprint's bits as a signed long."""
    return docs.select("doc_id", fingerprint_udf("text").alias("fp"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def segments(bits: list[int]) -> list[list[int]]:
    """Bits in three nearly equal parts; of two fingerprints that differ by at most four of them, one part differs by at most one."""
    cut = [0, (len(bits) + 2) // 3, len(bits) - len(bits) // 3, len(bits)]
    return [bits[x:y] for x, y in zip(cut, cut[1:]) if x < y]


def _steps(open_: dict[int, list[int]]) -> tuple[list[tuple[int, int, int]], dict[int, list[int]], dict[int, tuple[int, int, int, int]]]:
    """Of paths with the bits that they leave: (path, next path, bits compared in addition) of each variant; the bits that next paths leave; and
    of each next path its segment, the segment's first bit, and up to two segments before it, as masks."""
    rows, after, cut = [], {}, {}
    for path, bits in open_.items():
        masks = [sum(1 << b for b in s) for s in segments(bits)]
        for k, segment in enumerate(segments(bits)):
            to = path * 3 + k + 1
            after[to] = [b for b in bits if b not in segment]
            rows += [(path, to, _signed(masks[k] & ~(1 << b))) for b in segment]
            before = [*masks[:k], 0, 0]
            cut[to] = tuple(map(_signed, (masks[k], 1 << segment[0], before[0], before[1])))
    return rows, after, cut


def _once(cut: dict[int, tuple[int, int, int, int]]) -> Column:
    """Whether this is the one variant in which the pair (a, b) is to be found: the first segment that differs by at most one bit, with that bit
    deleted, or the first bit where none differs."""
    segment, bit, one, two = (F.element_at(F.create_map(*[x for to, v in cut.items() for x in (F.lit(to).cast("long"), F.lit(v[k]).cast("long"))]), F.col("a.path")) for k in range(4))
    d = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    far = lambda m: (m == 0) | (F.bit_count(d.bitwiseAND(m)) > 1)
    return ((d.bitwiseAND(segment) != 0) | (F.col("a.mask").bitwiseAND(bit) == 0)) & far(one) & far(two)


def links(fps: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges (src, dst) whose components are those of all pairs of distinct fingerprints within BITS bits.

    A bucket is (path, mask, v): the segments taken so far, the bits compared, and their values.  Its size is a map-side
    combined count, and the join that brings it back can be split by AQE.
    """
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= BITS
    bucket, spark = ["path", "mask", "v"], fps.sparkSession
    # dealt out before each row becomes 64
    rows = fps.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).select("fp", F.col("fp").alias("c"), F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("mask"))
    edges, open_ = None, {0: list(range(64))}
    while True:
        steps, open_, cut = _steps(open_)
        if not steps:
            break
        by_path: dict[int, list[tuple[int, int]]] = {}
        for path, to, add in steps:
            by_path.setdefault(path, []).append((to, add))
        if len(by_path) == 1:  # the first level: the same 64 masks for all
            variants = rows.select("fp", "c", "mask", F.explode(F.array(*[F.struct(F.lit(to).cast("long").alias("to"), F.lit(add).cast("long").alias("add")) for _, to, add in steps])).alias("s")).select("fp", "c", "mask", "s.to", "s.add")
        else:
            variants = rows.join(F.broadcast(spark.createDataFrame(steps, "path long, to long, add long")), "path").select("fp", "c", "mask", "to", "add")
        variants = variants.select("fp", "c", F.col("to").alias("path"), F.col("mask").bitwiseOR(F.col("add")).alias("mask")).withColumn("v", F.col("fp").bitwiseAND(F.col("mask")))
        last = F.col("path").isin(*[k for k, bits in open_.items() if not bits])
        sizes = stash(variants.groupBy(*bucket).agg(F.count("*").alias("n"), F.min("fp").alias("low")).where((F.col("n") > pairwise) & ~last).select(*bucket, "low"), "sizes")
        any_crowd = not sizes.isEmpty()
        few = variants.join(sizes.select(*bucket), bucket, "left_anti") if any_crowd else variants
        a, b = few.alias("a"), few.alias("b")
        same = (F.col("a.path") == F.col("b.path")) & (F.col("a.mask") == F.col("b.mask")) & (F.col("a.v") == F.col("b.v"))
        pairs = a.join(b.hint("merge"), same & (F.col("a.fp") < F.col("b.fp")) & (F.col("a.c") != F.col("b.c")) & near("a.fp", "b.fp") & _once(cut)).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
        if not any_crowd:
            new = stash(pairs.distinct(), "links")
            edges = new if edges is None else edges.union(new)
            break
        crowded = stash(variants.join(sizes, bucket), "crowded")
        stars = crowded.where((F.col("fp") != F.col("low")) & near("fp", "low")).select(F.col("low").alias("src"), F.col("fp").alias("dst"))
        new = stash(pairs.union(stars).distinct(), "links")
        edges = new if edges is None else edges.union(new)
        component = stash(roots(edges).withColumnRenamed("node", "fp"), "roots")
        marked = stash(crowded.drop("c", "low").join(component, "fp", "left").withColumn("c", F.coalesce("root", "fp")).drop("root"), "marked")
        open_keys = marked.groupBy(*bucket).agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select(*bucket)
        rows = stash(marked.join(open_keys, bucket, "left_semi").select("fp", "c", "path", "mask"), "rows")
        for t in (sizes, crowded, marked):
            forget(t)
        if rows.isEmpty():
            break
    return edges


def _components(fp: DataFrame) -> DataFrame:
    """(fp, component_id, least): of each fingerprint's component the smallest doc_id, null if it has none, and then the least digest of its rows without doc_id.

    fp: doc_id, fp, and sha where rows without doc_id are to be told apart.
    """
    sha = F.min(F.when(F.col("doc_id").isNull(), F.col("sha"))) if "sha" in fp.columns else F.min(F.lit(None).cast("string"))
    classes = stash(fp.groupBy("fp").agg(F.min("doc_id").alias("least"), sha.alias("sha")), "classes")
    comp = roots(links(classes.select("fp")))
    rooted = classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stash(rooted.select("fp", "root", "least", "sha"), "rooted")
    # a table of its own, so that AQE can split the join on a component of very many fingerprints
    ids = stash(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("sha").alias("sha")), "ids")
    return stash(rooted.select("fp", "root").join(ids, "root").select("fp", "component_id", F.when(F.col("component_id").isNull(), F.col("sha")).alias("least")), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row of docs.

    fingerprint: 16 hex digits; component_id: the smallest doc_id reachable over links, itself included.  Null texts and
    texts without words have fingerprint zero and are linked like others.  Equal fingerprints are linked; links are
    sought between distinct ones only, so large groups of copies cost no more than one.  A null doc_id takes the
    smallest doc_id of its component, null if there is none.  An empty table gives no rows; further columns are not read.
    """
    fp = stash(fingerprints(docs), "fp")
    by_fp = _components(fp).select("fp", "component_id")
    return fp.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component stays, with all its columns: the one whose doc_id names it.

    Rows with a null doc_id go where their component has any doc_id; of a component without one, the text of the least SHA-256 stays.
    Rows that repeat a doc_id, or a text without one, stay together: which text such an id stands for is not decided here.
    """
    key = fresh(docs, "_key")
    sha = F.when(F.col("doc_id").isNull(), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    fp = stash(docs.select("doc_id", fingerprint_udf("text").alias("fp"), sha.alias("sha")), "fp")
    named = F.when(F.col("component_id").isNull(), F.col("sha") == F.col("least")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    keep = fp.join(_components(fp), "fp").where(named).select(row_key(F.col("doc_id"), fp["sha"]).alias(key)).distinct()
    return docs.withColumn(key, row_key(F.col("doc_id"), sha)).join(keep, key, "left_semi").drop(key)
