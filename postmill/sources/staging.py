"""Sources as tables of their own, so that one that fails leaves the others alone."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.lineage import staging_path
from postmill.operators.model import with_raw_columns

STATUS = "source string, source_rank int, n_rows bigint, state string, reason string"
REASON_LIMIT = 500


def merge_isolated(spark: SparkSession, sources: Sequence[tuple[str, Callable[[], DataFrame]]]) -> tuple[DataFrame, DataFrame]:
    """Merged raw postings of the sources that work, and ``(source, source_rank, n_rows, state, reason)`` of each.

    Every source is built and written to a folder of its own before any other is looked at. Spark commits
    a folder when all of its tasks are done, so a source that fails while it is built or while it runs
    contributes no row. The others keep the rank of their place, and the result is that of a run without it.
    """
    staged, status = [], []
    for rank, (name, build) in enumerate(sources):
        path = staging_path(spark, f"source-{rank}")
        try:
            with_raw_columns(build()).write.parquet(path)
            rows = spark.read.parquet(path)
            status.append((name, rank, rows.count(), "ok", None))
            staged.append(rows.withColumn("source_rank", F.lit(rank)))
        except Exception as failure:  # whatever a source does wrong is its own affair
            status.append((name, rank, 0, "failed", f"{type(failure).__name__}: {failure}"[:REASON_LIMIT]))
    if not staged:
        staged.append(with_raw_columns(spark.range(0).select(F.col("id").alias("page_id"), F.col("id").alias("ord"))).withColumn("source_rank", F.lit(0)))
    merged = staged[0]
    for rows in staged[1:]:
        merged = merged.unionByName(rows, allowMissingColumns=True)
    return merged, spark.createDataFrame(status, STATUS)
