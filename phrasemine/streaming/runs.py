"""Tables that grow batch by batch, kept as sorted-out runs: a batch writes what it brings, and runs of like size are merged now and then.

    run=<batch>-<level>/        rows of one run; level 0 is one batch, level n + 1 the merge of `fanout` runs of level n
    manifest=<batch>/           (run, level) of the runs that make up the table after that batch, written last

A manifest counts once Spark has marked it complete, so a batch that ends half-way leaves the table as it was and, run again, writes the same
names again.  Each row is written once for each level, so all batches together write about log(batches) / log(fanout) times what they bring, and
a reader merges fewer than `fanout` runs of each level.  Only what merges by itself may be kept so: merge(a, b) must be associative, and the order
of runs must not matter.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return [str(f.getPath()) for f in found or []]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def batches(spark: SparkSession, path: str) -> list[int]:
    """Batches whose manifest is complete, in order."""
    return sorted(int(p.split("/")[-2].split("=")[1]) for p in _glob(spark, f"{path}/manifest=*/_SUCCESS"))


def manifest(spark: SparkSession, path: str, batch_id: int) -> list[tuple[str, int]]:
    """(run, level) of all runs after a batch: fewer than `fanout` for each level, so few."""
    return sorted((r.run, r.level) for r in spark.read.parquet(f"{path}/manifest={batch_id}").collect())


def _merged(spark: SparkSession, path: str, names: list[str], merge: Merge) -> DataFrame:
    return reduce(merge, [spark.read.parquet(f"{path}/run={n}") for n in names])


def read(spark: SparkSession, path: str, merge: Merge) -> DataFrame | None:
    """The table after the last complete batch, None before the first."""
    done = batches(spark, path)
    return _merged(spark, path, [n for n, _ in manifest(spark, path, done[-1])], merge) if done else None


def append(rows: DataFrame, path: str, batch_id: int, merge: Merge, fanout: int = 8) -> None:
    """Add the rows of a batch; a batch that is complete already, or older than one that is, changes nothing.

    The manifest before this one and its runs are kept for readers that have just opened them; older ones are deleted.
    """
    spark = rows.sparkSession
    done = batches(spark, path)
    if done and done[-1] >= batch_id:
        return
    rows.write.mode("overwrite").parquet(f"{path}/run={batch_id}-0")
    before = manifest(spark, path, done[-1]) if done else []
    now = [*before, (f"{batch_id}-0", 0)]
    level = 0
    while len(full := [n for n, l in now if l == level]) >= fanout:
        name = f"{batch_id}-{level + 1}"
        _merged(spark, path, full, merge).write.mode("overwrite").parquet(f"{path}/run={name}")
        now = [*[(n, l) for n, l in now if l != level], (name, level + 1)]
        level += 1
    spark.createDataFrame(now, "run string, level int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest={batch_id}")
    keep = {n for n, _ in [*before, *now]}
    for run in _glob(spark, f"{path}/run=*"):
        if run.split("/run=")[-1] not in keep:
            _delete(spark, run)
    for old in done[:-1]:
        _delete(spark, f"{path}/manifest={old}")
