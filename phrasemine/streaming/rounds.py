"""Structured Streaming jobs: round ingestion, running word counts, event roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean
from ..operators.relate import new_by_key
from ..operators.tokens import merge_counts, segment_unified
from . import runs


def ingest_rounds(source: DataFrame, target: str, checkpoint: str):
    """K1: raw phrase files as a stream; each batch is cleaned and only phrases that are not stored yet are appended.

    A batch writes its own folder, by overwrite, and reads the folders before it: a replay changes nothing.
    """
    spark = source.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/batch=*")
        fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        before = [str(f.getPath()) for f in fs.globStatus(fs_path) or [] if int(f.getPath().getName().split("=")[1]) < batch_id]
        fresh = clean.clean_phrases(batch)
        fresh = new_by_key(fresh, spark.read.parquet(*before).select("phrase"), "phrase", ["phrase_id"]) if before else new_by_key(fresh, fresh.limit(0), "phrase", ["phrase_id"])
        fresh.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(source: DataFrame, target: str, checkpoint: str, least: int = 1, fanout: int = 8):
    """K2: words with counts and seeds, added batch by batch to a stored table of runs (`runs.append`).

    A batch writes the counts of its own words and reads nothing else, but for a merge of `fanout` runs now and then; a replay changes nothing.
    No seed set grows in streaming state.  `stored_counts` reads the table.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        runs.append(segment_unified(batch, least), target, batch_id, merge_counts, fanout)

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_counts(spark: SparkSession, target: str) -> DataFrame | None:
    """K2: (word, word_count, frequency, seeds) after the last complete batch, None before the first."""
    return runs.read(spark, target, merge_counts)


def event_rollup(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """K3: events by type in tumbling windows; those later than the watermark are dropped by a stream."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", window), "event_type").agg(F.count("*").alias("n"), F.max("new_score").alias("top_score")).select(
        F.col("window.start").alias("window_start"), "event_type", "n", "top_score"
    )


def event_sessions(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """K3: sessions of each demand's events."""
    return events.withWatermark("created_at", late).groupBy(F.session_window("created_at", gap), "demand_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), "demand_id", "n")


def latest_scores(events: DataFrame) -> DataFrame:
    """K3: the latest score of each demand; in a stream, with update or complete output."""
    return events.groupBy("demand_id").agg(F.max_by("new_score", F.struct("created_at", "provenance_id")).alias("confidence"))
