"""Counters of each step as one-row or one-row-per-group frames.

All are hash aggregates with a partial count in front of the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.operators.enrich import RICH_TEXT
from postmill.operators.filters import with_drop_reason
from postmill.operators.fuzzy import dedup_fuzzy
from postmill.operators.lineage import cut_lineage
from postmill.operators.model import fingerprint, order_columns


def filter_summary(df: DataFrame) -> DataFrame:
    reason = F.coalesce(F.col("drop_reason"), F.lit("kept"))
    return with_drop_reason(df).groupBy(reason.alias("outcome")).agg(F.count("*").alias("n_rows"))


def dedup_summary(df: DataFrame) -> DataFrame:
    """Unique and duplicate rows. Two steps, so a frequent key is counted map-side."""
    per_key = df.groupBy(
        fingerprint(F.col("url"), F.col("title"), F.col("company")).alias("fp")
    ).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.count("*").alias("n_unique"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"),
    )


def fuzzy_summary(df: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Kept and dropped rows of the near-duplicate removal.

    What it compares is written once, for the rows are read several times and may cost much to make.
    """
    rows = cut_lineage(df.select(*order_columns(df), "title", "company"))
    kept = dedup_fuzzy(rows, threshold).select(F.lit(1).alias("kept"))
    return rows.select(F.lit(0).alias("kept")).unionByName(kept).agg(
        F.count_if(F.col("kept") == 1).alias("n_unique"),
        (F.count_if(F.col("kept") == 0) - F.count_if(F.col("kept") == 1)).alias("n_duplicates"),
    )


def enrich_summary(df: DataFrame) -> DataFrame:
    rich = F.length(F.coalesce(F.col("description"), F.lit(""))) > RICH_TEXT
    return df.agg(F.count_if(rich).alias("n_rich"), F.count("*").alias("n_total"))


def source_counts(df: DataFrame) -> DataFrame:
    """Rows per source and, as ``(all)``, in total."""
    return df.rollup("source").agg(F.count("*").alias("n_rows"), F.grouping("source").alias("_all")).select(
        F.when(F.col("_all") == 1, "(all)").otherwise(F.col("source")).alias("source"), "n_rows"
    )


def normalise_summary(df: DataFrame) -> DataFrame:
    """Valid and input rows of a canonicalised frame."""
    return df.agg(F.count_if(F.col("reject_reason").isNull()).alias("n_ok"), F.count("*").alias("n_input"))
