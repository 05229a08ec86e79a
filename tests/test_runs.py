"""Tables of runs: equal to one count of all batches, whatever is replayed or broken off, and written in proportion to what batches bring."""

import os
import random

import pytest
from pyspark.sql import functions as F

from phrasemine.operators.tokens import merge_counts
from phrasemine.streaming import runs


def counts(spark, words):
    d = spark.createDataFrame([(w, 1, n, [s]) for w, n, s in words], "word string, word_count int, frequency long, seeds array<string>").coalesce(1)
    return d.groupBy("word", "word_count").agg(F.sum("frequency").alias("frequency"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("seeds")))).alias("seeds"))


def rows(d):
    return sorted((r.word, r.frequency, tuple(r.seeds)) for r in d.collect())


def size(path):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


@pytest.fixture
def batches():
    r = random.Random(2)
    return [[(f"w{r.randrange(30)}", r.randint(1, 5), f"s{r.randrange(3)}") for _ in range(20)] for _ in range(8)]


def test_runs_equal_one_count(spark, tmp_path, batches):
    """Eight batches with merges of three runs each, on two levels; every batch is given twice."""
    at = str(tmp_path)
    assert runs.read(spark, at, merge_counts) is None
    for i, b in enumerate(batches):
        for _ in range(2):
            runs.append(counts(spark, b), at, i, merge_counts, fanout=3)
    assert rows(runs.read(spark, at, merge_counts)) == rows(counts(spark, sum(batches, [])))
    assert sorted(level for _, level in runs.manifest(spark, at, 7)) == [0, 0, 1, 1]
    kept = {d for d in os.listdir(at) if d.startswith("run=")}
    assert kept == {f"run={n}" for b in (6, 7) for n, _ in runs.manifest(spark, at, b)} and runs.batches(spark, at) == [6, 7]


def test_batch_that_ends_before_its_manifest(spark, tmp_path, batches, monkeypatch):
    """Killed with its run, or its merge, written and no manifest: the table is as before, and the batch run again gives what it should."""
    at = str(tmp_path)
    for i in (0, 1):
        runs.append(counts(spark, batches[i]), at, i, merge_counts, fanout=3)
    new = counts(spark, batches[2])

    def killed(*_):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", killed)
        with pytest.raises(OSError):
            runs.append(new, at, 2, merge_counts, fanout=3)
    assert os.path.isdir(f"{at}/run=2-1") and runs.batches(spark, at) == [0, 1]
    assert rows(runs.read(spark, at, merge_counts)) == rows(counts(spark, sum(batches[:2], [])))
    runs.append(new, at, 2, merge_counts, fanout=3)
    assert rows(runs.read(spark, at, merge_counts)) == rows(counts(spark, sum(batches[:3], [])))


def test_small_batch_writes_little(spark, tmp_path):
    """A batch with 1 % of the words writes less than 5 % of what the table holds; an empty one writes no rows."""
    at = str(tmp_path)
    whole = [(f"{i * 7919 % 10**9:09}", 1, "s") for i in range(20_000)]
    runs.append(counts(spark, whole), at, 0, merge_counts)
    before = size(f"{at}/run=0-0")
    runs.append(counts(spark, whole[::100]), at, 1, merge_counts)
    assert size(f"{at}/run=1-0") < 0.05 * before and size(f"{at}/run=0-0") == before
    runs.append(counts(spark, whole).limit(0), at, 2, merge_counts)
    got = runs.read(spark, at, merge_counts)
    assert got.count() == 20_000 and got.agg(F.sum("frequency")).first()[0] == 20_200
