"""Shared folder for intermediate tables, and ranges of ascending ids."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.words import give_back


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder named by ``spark.checkpoint.dir``; a temporary one on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="postmill-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and there when executors are lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """Lets the driver drop what finished steps left: collected results, broadcasts, plans.

    A heap that a step has widened is not narrowed again before a full collection, and broadcasts and shuffle files of
    earlier steps go only when their handles are collected.
    """
    spark._jvm.java.lang.System.gc()
    give_back()


#: Most ranges whose bounds the driver holds.
MOST_RANGES = 10_000


def id_bounds(df: DataFrame, column: str, rows_per_range: int) -> list[int]:
    """Ascending ids that occur in the column and cut it into ranges of about ``rows_per_range`` rows.

    The first is the smallest id. One pass over the id column; at most ``MOST_RANGES`` ranges, which then
    hold more rows each.
    """
    ids = df.where(F.col(column).isNotNull()).select(F.col(column).cast("bigint").alias("id"))
    n = ids.count()
    if not n:
        return []
    parts = min(MOST_RANGES, max(1, math.ceil(n / rows_per_range)))
    shares = [i / parts for i in range(1, parts)]
    row = ids.agg(F.min("id"), F.percentile_approx("id", shares or [0.5], max(10_000, 100 * parts))).first()
    return sorted({row[0], *row[1]}) if shares else [row[0]]


def place_of(column: str, bounds: list[int]):
    """Struct of ``part``, the range an id lies in, and ``head``: is it the id that opens its range?

    A null id belongs before all others, to range 0.
    """
    edges = np.array(bounds or [0], dtype=np.int64)

    @F.pandas_udf("part int, head boolean")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for ids in batches:
            known = ids.notna().to_numpy()
            values = ids.fillna(edges[0]).astype("int64").to_numpy()
            part = np.maximum(np.searchsorted(edges, values, side="right") - 1, 0).astype(np.int32)
            yield pd.DataFrame({"part": part, "head": known & (edges[part] == values)})

    return place(F.col(column).cast("bigint"))
