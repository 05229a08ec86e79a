"""Registered queries: streaming jobs (K), run over files written from the tables until all are read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import shared_dir
from ..streaming import rounds
from .q_tokens import UNIFIED, grams, sg
from .registry import Tables, register


def _at(t: Tables) -> str:
    return f"{shared_dir(t.spark)}/phrasemine-stream-{uuid.uuid4().hex}"


def _stream(t: Tables, df: DataFrame, at: str, by: str) -> DataFrame:
    """Rows as files, one folder for each value of a column, read as a stream a few files at a time."""
    df.withColumn("_part", F.col(by)).write.partitionBy("_part").parquet(f"{at}/in")
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/in/*")


@register("k1_ingest_rounds", "SELECT lower(trim(phrase)) AS phrase, count(*) > 0 AS stored FROM kw GROUP BY 1", "kw")
def k1(t: Tables) -> DataFrame:
    at = _at(t)
    rounds.ingest_rounds(_stream(t, t.kw.repartition(2), at, "first_seen_round"), f"{at}/out", f"{at}/ck").awaitTermination()
    return t.spark.read.parquet(f"{at}/out").select("phrase", F.lit(True).alias("stored"))


@register("k2_running_counts", f", {sg('kw')}, {grams('sg', 1, 6, 'seed_word, ')}, {UNIFIED.replace('HAVING count(*) >= 2', '')} SELECT word, word_count, frequency, seeds FROM un", "kw")
def k2(t: Tables) -> DataFrame:
    at = _at(t)
    rounds.running_counts(_stream(t, t.kw.repartition(2), at, "first_seen_round"), f"{at}/out", f"{at}/ck").awaitTermination()
    return rounds.stored_counts(t.spark, f"{at}/out").withColumn("seeds", F.array_join("seeds", ","))


@register("k3_event_rollup", "SELECT date_trunc('day', created_at) AS window_start, event_type, count(*) AS n, max(new_score) AS top_score FROM events_ GROUP BY 1, 2", "events_")
def k3(t: Tables) -> DataFrame:
    at, name = _at(t), f"k3_{uuid.uuid4().hex}"
    t.events.withColumn("_m", F.lit(1)).drop("_m").write.parquet(f"{at}/in")
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{at}/in")
    # complete output to memory keeps one row for each window and type; a job writes append output to files
    rounds.event_rollup(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{at}/ck").trigger(availableNow=True).start().awaitTermination()
    return t.spark.table(name)


@register("k3_event_sessions", """, x AS (SELECT demand_id, created_at, CASE WHEN created_at < lag(created_at) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events_ WINDOW w AS (PARTITION BY demand_id ORDER BY created_at, provenance_id)),
 y AS (SELECT *, sum(first) OVER (PARTITION BY demand_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT min(created_at) AS session_start, demand_id, count(*) AS n FROM y GROUP BY demand_id, k""", "events_")
def k3_sessions(t: Tables) -> DataFrame:
    return rounds.event_sessions(t.events)


@register("k3_latest_scores", "SELECT demand_id, arg_max(new_score, (created_at, provenance_id)) AS confidence FROM events_ GROUP BY 1", "events_")
def k3_latest(t: Tables) -> DataFrame:
    return rounds.latest_scores(t.events)
