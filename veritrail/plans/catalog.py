"""Where plan modules register their queries: a name, a function of (spark, sf_dir), and DuckDB SQL if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a function of Tables, or of (Tables, spark), as a query."""

    def add(make):
        wants_spark = make.__code__.co_argcount == 2

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            t = Tables(spark, sf_dir)
            return make(t, spark) if wants_spark else make(t)

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return make

    return add
