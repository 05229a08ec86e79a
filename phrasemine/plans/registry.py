"""All registered queries of the engine, and the same in SQL.

Each module q_* registers its operators over the adapted tables.  A registered function takes Tables and returns a
DataFrame; SQL texts start with SELECT or with further common tables (", name AS (...)"), and see the adapted tables by name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..functions.scratch import spread
from ..sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The driver's tables in the roles of FIXTURES.md."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.raw("documents"))

    @cached_property
    def doc(self) -> DataFrame:
        return adapters.phrases_doc(self.documents)

    @cached_property
    def kw(self) -> DataFrame:
        return adapters.phrases_kw(self.raw("part"))

    @cached_property
    def products(self) -> DataFrame:
        return adapters.products(self.raw("part"))

    @cached_property
    def communities(self) -> DataFrame:
        return adapters.communities(self.raw("supplier"))

    @cached_property
    def demands(self) -> DataFrame:
        return adapters.demands(self.raw("orders"))

    @cached_property
    def links(self) -> DataFrame:
        return adapters.demand_product(self.raw("lineitem"))

    @cached_property
    def events(self) -> DataFrame:
        return adapters.demand_events(self.raw("events"))

    @cached_property
    def vectors(self) -> DataFrame:
        return adapters.vectors(self.raw("embeddings"))

    @cached_property
    def meta(self) -> DataFrame:
        return adapters.cluster_meta(self.kw)


def register(name: str, sql: str | None = None, *needs: str) -> Callable:
    """Register f(Tables) as a query; needs: the adapted tables that the SQL names."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            with_ = ", ".join(f"{n} AS ({adapters.SQL[n]})" for n in adapters.closure(needs))
            body = sql.strip()
            ORACLE[name] = (f"WITH {with_} " if with_ else "") + (body if not body.startswith(",") else body if with_ else "WITH " + body[1:])
        return f

    return add


def _load() -> None:
    from . import q_annotate, q_clean, q_cluster, q_functions, q_relate, q_score, q_sources, q_state, q_stats, q_stream, q_templates, q_tokens  # noqa: F401


_load()
