"""Registered queries: name, inventory ids, Spark builder and, where SQL can say it, the DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..tables import Tables, with_fixtures


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    build: Callable[[Tables], DataFrame]
    oracle: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, ids: str, oracle: str | None = None):
    def deco(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, ids, fn, with_fixtures(oracle) if oracle else None)
        return fn

    return deco
