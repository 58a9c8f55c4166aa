"""The registered queries: name, Spark builder, and equivalent SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from recordloom.session import ensure_checkpoint_dir, ship_package


@dataclass(frozen=True)
class Tables:
    """The input tables of one run, as attributes."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def scratch(self) -> str:
        """A new folder below the shared checkpoint folder."""
        return f"{ensure_checkpoint_dir(self.spark).removeprefix('file:')}/{uuid.uuid4().hex}"


BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of :class:`Tables` under its own name."""

    def add(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return build(Tables(spark, folder))

        name = build.__name__
        BUILDERS[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return add
