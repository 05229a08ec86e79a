"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import forget, shared_dir, spread, stash
from ..operators.graph import roots

__all__ = ["NOT_SPACE", "ascii_lower", "forget", "fresh", "roots", "row_key", "shared_dir", "stash", "table", "word_count"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of the contracts: runs of anything but the six ASCII white-space characters.
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII text, the common case, takes the fast built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def word_count(c: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(c, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def row_key(*cols: Column) -> Column:
    """One string that tells rows apart by the values of some columns, nulls included."""
    return F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols])


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name
