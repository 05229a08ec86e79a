"""All pairs of two tables of vectors: blocks of rows stand once in the shared folder, and each task reads them one after the other.

Nothing is copied for each pair of blocks: what is written grows with the rows, what is read and computed with the pairs.  A task holds two blocks and what it found so far.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession

from ..functions.scratch import forget, made, shared_dir, stash

#: Rows of a block (rows by hash, so nearly), and the fewest of a block of queries where a small table is dealt to all cores.
BLOCK, SMALL = 4096, 64


def _stored(rows: DataFrame, block: int) -> tuple[RDD, str]:
    """((partition, number), Arrow bytes) of each block of rows, from files of their own."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, 2 * block - n)
                b = b.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == 2 * block:
                    yield pa.RecordBatch.from_arrays([pa.array([_bytes(pa.Table.from_batches(held))], pa.binary())], names=["block"])
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([_bytes(pa.Table.from_batches(held))], pa.binary())], names=["block"])

    spark = rows.sparkSession
    # written as a table first, so that Spark deletes the shuffles before it
    table = stash(rows.mapInArrow(pack, "block binary"), "packed")
    at = f"{shared_dir(spark)}/phrasemine-blocks-{uuid.uuid4().hex}"
    table.rdd.mapPartitionsWithIndex(lambda p, own: (((p, i), bytes(r[0])) for i, r in enumerate(own))).saveAsPickleFile(at, 1)
    made(at)
    forget(table)
    return spark.sparkContext.pickleFile(at), at


def _bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _table(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def meet(asked: DataFrame, rows: DataFrame, start: Callable, schema: str, block: int = BLOCK) -> tuple[DataFrame, list[str]]:
    """What start(block of asked) found, after its meet(block) was given all blocks of rows, or a part of them: its found(), a pa.Table of the schema; and the paths of what that reads.

    Blocks of asked may meet rows in several tasks, twice as many as there are cores in all, so what is found is still to be merged.
    """
    spark: SparkSession = asked.sparkSession
    cores = spark.sparkContext.defaultParallelism
    n = asked.count()
    parts = max(-(-n // block), min(cores, -(-n // SMALL)), 1)
    queries, a = _stored(asked.repartition(parts, "phrase_id"), block)
    others, b = _stored(rows, block)
    others = others.coalesce(max(1, -(-2 * cores // parts)))

    def run(pairs: Iterator) -> Iterator[tuple[bytes]]:
        at, state = None, None
        for (key, own), (_, other) in pairs:  # the pairs of one block of asked, then those of the next
            if key != at:
                if state is not None:
                    yield (_bytes(state.found()),)
                at, state = key, start(_table(own))
            state.meet(_table(other))
        if state is not None:
            yield (_bytes(state.found()),)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for found in x.column("found"):
                yield from _table(found.as_py()).to_batches()

    found = spark.createDataFrame(queries.cartesian(others).mapPartitions(run), "found binary")
    return found.mapInArrow(unpack, schema), [a, b]
