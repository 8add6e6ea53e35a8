"""Validation of raw postings into the canonical relation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.dates import parse_date
from postmill.functions.job_type import model_job_type
from postmill.functions.salary import salary_settled, salary_sync
from postmill.functions.text import blank_null, first_nonblank, norm_tags, strip
from postmill.schema import ORDER_COLUMNS, RAW_TYPES

TITLE_LIMIT, COMPANY_LIMIT, LOCATION_LIMIT = 512, 256, 256
FINGERPRINT_LENGTH = 16


def fingerprint(url: Column, title: Column, company: Column) -> Column:
    """16 hex digits identifying a posting: by url, else by title and company."""
    address = F.rtrim(F.lower(strip(F.coalesce(url, F.lit("")))), F.lit("/"))
    named = F.concat(
        F.lower(strip(F.coalesce(title, F.lit("")))), F.lit("|"), F.lower(strip(F.coalesce(company, F.lit(""))))
    )
    key = F.when(address.isin("", "#"), named).otherwise(address)
    return F.substring(F.sha2(key, 256), 1, FINGERPRINT_LENGTH)


def with_raw_columns(df: DataFrame) -> DataFrame:
    """Cast to the raw column types and add the ones an adapter does not supply."""
    extra = [c for c in df.columns if c not in RAW_TYPES]
    absent = {"location": F.lit("Remote")}
    raw = [
        (F.col(name) if name in df.columns else absent.get(name, F.lit(None))).cast(kind).alias(name)
        for name, kind in RAW_TYPES.items()
    ]
    return df.select(*extra, *raw)


def reject_reason(df: DataFrame) -> Column:
    """Why a stripped posting is not valid; null for a valid one."""
    def length(name: str) -> Column:
        return F.length(F.col(name))

    return (
        F.when(length("title") == 0, "title missing")
        .when(length("title") > TITLE_LIMIT, "title too long")
        .when(length("company") == 0, "company missing")
        .when(length("company") > COMPANY_LIMIT, "company too long")
        .when(length("url") == 0, "url missing")
        .when(length("location") > LOCATION_LIMIT, "location too long")
        .when(F.col("max_experience_required") < 0, "experience negative")
    )


def canonicalise(df: DataFrame, as_of: datetime) -> DataFrame:
    """Every posting with canonical columns and a ``reject_reason``.

    Nothing is dropped here, so one bad record costs only itself. Order of work:
    sync texts, strip, coerce types, dates, bounds, id.
    """
    raw = with_raw_columns(df)
    keep = [c for c in raw.columns if c not in RAW_TYPES]
    salary, salary_raw = salary_sync(F.col("salary"), F.col("salary_raw"))

    def text(name: str) -> Column:
        return strip(F.coalesce(F.col(name), F.lit(""))).alias(name)

    stripped = raw.select(
        *keep,
        text("title"),
        text("company"),
        F.lower(text("source")).alias("source"),
        text("url"),
        text("location"),
        text("description"),
        model_job_type(F.col("job_type")).alias("job_type"),
        strip(salary).alias("salary"),
        strip(salary_raw).alias("salary_raw"),
        "salary_min",
        "salary_max",
        strip(F.col("experience_raw")).alias("experience_raw"),
        "max_experience_required",
        norm_tags(F.col("tags")).alias("tags"),
        parse_date(F.col("posted_date"), as_of).alias("posted_date"),
        strip(F.col("company_logo")).alias("company_logo"),
        strip(F.coalesce(F.col("scraped_at"), F.lit(as_of.isoformat()))).alias("scraped_at"),
        strip(F.col("job_id")).alias("job_id"),
    )
    settled = stripped.withColumn(
        "_bounds",
        salary_settled(F.col("salary_min"), F.col("salary_max"), first_nonblank(F.col("salary"), F.col("salary_raw"))),
    )
    columns = [c for c in stripped.columns if c not in ("salary_min", "salary_max", "job_id")]
    return settled.select(
        *columns,
        F.col("_bounds.lo").alias("salary_min"),
        F.col("_bounds.hi").alias("salary_max"),
        F.coalesce(
            blank_null(F.col("job_id")), fingerprint(F.col("url"), F.col("title"), F.col("company"))
        ).alias("job_id"),
        reject_reason(settled).alias("reject_reason"),
    )


def valid(df: DataFrame) -> DataFrame:
    """Postings that passed validation."""
    return df.where(F.col("reject_reason").isNull()).drop("reject_reason")


def quarantine(df: DataFrame) -> DataFrame:
    """Rejected postings with their reason."""
    return df.where(F.col("reject_reason").isNotNull())


def has_required(df: DataFrame) -> DataFrame:
    """Postings whose title, company, url and source are all non-empty."""
    required = [blank_null(F.col(c)).isNotNull() for c in ("title", "company", "url", "source")]
    return df.where(required[0] & required[1] & required[2] & required[3])


def order_columns(df: DataFrame) -> list[str]:
    return [c for c in ORDER_COLUMNS if c in df.columns]
