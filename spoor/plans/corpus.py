"""A corpus: canonical tables over one data folder, with shared results kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from spoor.session import land
from spoor.sources import tables, trade


class Corpus:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._kept: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return tables.table(self.spark, self.sf_dir, name)

    @cached_property
    def events(self) -> DataFrame:
        """Canonical events, landed once as Parquet so that every query reads only its columns."""
        return land(tables.events(self.spark, self.sf_dir, linked=True), "events")

    @cached_property
    def nodes(self) -> DataFrame:
        return land(tables.graph_nodes(self.spark, self.sf_dir), "nodes")

    @cached_property
    def edges(self) -> DataFrame:
        return land(tables.graph_edges(self.spark, self.sf_dir), "edges")

    @cached_property
    def preconditions(self) -> DataFrame:
        return land(tables.preconditions(self.spark, self.sf_dir), "preconditions")

    @cached_property
    def trade_edge_keys(self) -> DataFrame:
        """Keys of the order graphs' edges; the names are spelled out where they are read."""
        return land(trade.edge_keys(self.spark, self.sf_dir), "trade_edges")

    @cached_property
    def trade_edges(self) -> DataFrame:
        return trade.trade_edges(self.trade_edge_keys)

    @cached_property
    def trade_nodes(self) -> DataFrame:
        return trade.trade_nodes(land(trade.node_keys(self.trade_edge_keys), "trade_nodes"))

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Compute a shared table once per session and data folder (landed as Parquet)."""
        if name not in self._kept:
            self._kept[name] = land(build(), name)
        return self._kept[name]


_CORPORA: dict[tuple[str, str], Corpus] = {}


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _CORPORA or _CORPORA[key].spark is not spark:
        _CORPORA[key] = Corpus(spark, str(sf_dir))
    return _CORPORA[key]


class Query:
    """A named query: the Spark plan and, where one exists, the SQL that checks it."""

    def __init__(self, name: str, plan: Callable[[Corpus], DataFrame], sql: str | None = None):
        self.name, self.plan, self.sql = name, plan, sql


def r6(df: DataFrame, places: int = 6) -> DataFrame:
    """Round doubles for comparison with another engine (summation order differs in the last digits)."""
    from pyspark.sql import functions as F

    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
