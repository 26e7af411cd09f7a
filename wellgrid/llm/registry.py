"""Queries of this subpackage and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its name, with an equivalent DuckDB text if there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def load_all() -> None:
    import importlib

    for name in OPERATORS:
        importlib.import_module(f"{__package__}.{name}")


OPERATORS = ["sharding", "mixing", "winnowing", "simhash", "language", "contexttree", "vptree", "tokencount", "private", "toxicity", "periodic", "packing", "merkle"]
