"""Registered queries: a name, a builder over the given tables and, where SQL can say it, its SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabularium.session import table

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}
ROWS: dict[str, tuple[str, ...]] = {}

MODULES = ("scans", "columns", "joins", "statistics", "multivariate", "splits", "runs", "monitoring",
           "tables", "quality", "streams")


class Tables:
    """Attribute access to the driver tables of one folder; times without a zone are read as UTC."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``covers`` lists the inventory rows it answers."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        ROWS[name] = tuple(covers.split())
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"tabularium.catalog.{module}")
