"""SQL over exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT_COLUMNS = ("title", "company", "location", "salary", "job_type", "source", "posted_date", "scraped_at")


def adhoc_sql(export: DataFrame, sql: str | None = None) -> DataFrame:
    """Any SQL over one export, named ``{table}`` in the text; all rows by default."""
    return export.sparkSession.sql(sql or "SELECT * FROM {table}", table=export)


def analysis_query(export: DataFrame) -> DataFrame:
    """The standing report: eight columns of named postings, latest first."""
    return adhoc_sql(
        export,
        f"SELECT {', '.join(REPORT_COLUMNS)} FROM {{table}} WHERE title IS NOT NULL ORDER BY scraped_at DESC",
    )


def with_stated_salary(export: DataFrame) -> DataFrame:
    """Named postings that state a salary."""
    return adhoc_sql(export, "SELECT * FROM {table} WHERE title IS NOT NULL AND salary <> 'Not specified'")


def latest_first(df: DataFrame) -> DataFrame:
    """Order by collection time; posting order decides between equal times."""
    ties = [c for c in ("source_rank", "ord") if c in df.columns]
    return df.orderBy(F.desc("scraped_at"), *ties)
