"""Named queries: a Spark callable and, where SQL can say it, an oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sluice.session import tune

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class Tables:
    """The given parquet tables of one scale."""

    spark: SparkSession
    folder: str

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def shape(self, text: str) -> DataFrame:
        """Run a shaping query whose tables are written as ``{name}``."""
        used = {n: self[n] for n in TABLES if "{" + n + "}" in text}
        return self.spark.sql(text, **used)


def sql(text: str) -> str:
    """The same shaping query for the oracle, on the bare table names."""
    for name in TABLES:
        text = text.replace("{" + name + "}", name)
    return text


Query = Callable[[Tables], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is defined twice")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function
    return add


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    function = QUERIES[name]
    return lambda spark, folder: function(Tables(tune(spark), folder))
