"""Registered queries: Spark callables with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
# The JVM compiles no method above this many bytes of code; it would interpret it, row by row.
COMPILED_BYTES = 8_000


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            # A stage whose rules need more code runs operator by operator, each in small methods.
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED_BYTES)
            return fn(spark, folder)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
