"""Tables in the folder that all executors share; they cut the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes the shuffles of a query as it ends; else they stay until the driver's garbage collector finds them, which an iterative job may not live to see.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the tables that this process wrote and did not delete, in order.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own in local mode, as in tests, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="phrasemine-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def made(path: str) -> None:
    """A path that clear() deletes."""
    _made.append(path)


def stash(df: DataFrame, name: str = "t") -> DataFrame:
    """Write a table to the shared folder and read it back; the shuffles that made it are deleted, since nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/phrasemine-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    made(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _made:
        _made.remove(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete paths that no later plan reads."""
    for path in paths:
        _delete(spark, path)


def forget(df: DataFrame) -> None:
    """Delete a stash that no later plan reads."""
    path = getattr(df, "stash_path", None)
    if path:
        _delete(df.sparkSession, path)


def clear(spark: SparkSession, *but: DataFrame) -> None:
    """Delete all stashes of this process but these: once a result is written, nothing reads the others."""
    keep = {getattr(d, "stash_path", None) for d in but}
    for path in [p for p in _made if p not in keep]:
        _delete(spark, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() returns as a stash of its own, without the stashes that were made for it."""
    before = set(_made)
    out = stash(make(), name)
    for path in [p for p in _made if p not in before and p != out.stash_path]:
        _delete(spark, path)
    return out


def spread(df: DataFrame) -> DataFrame:
    """A table read from fewer splits than there are cores, dealt out to all of them; larger ones are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
