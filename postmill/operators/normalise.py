"""The normalise step and the export projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.experience import max_experience
from postmill.functions.job_type import norm_job_type
from postmill.functions.salary import salary_coerce, salary_ordered, salary_refilled
from postmill.functions.text import (
    blank_null, first_nonblank, norm_company, norm_description, norm_location, norm_title, strip,
)
from postmill.schema import EXPORT_COLUMNS, METADATA_COLUMNS


def normalise_postings(df: DataFrame) -> DataFrame:
    """One spelling per field for already valid postings.

    The id is kept: it names the posting as it was collected. A stated maximum
    experience is never parsed again.
    """
    exp = F.col("experience_raw")
    years = F.coalesce(F.col("max_experience_required"), max_experience(exp, F.col("description")))
    refilled = df.withColumn(
        "_bounds", salary_refilled(F.col("salary_min"), F.col("salary_max"), F.col("salary_raw"))
    )
    lo, hi = salary_ordered(salary_coerce(F.col("_bounds.lo")), salary_coerce(F.col("_bounds.hi")))
    changed = {
        "title": norm_title(F.col("title")),
        "company": norm_company(F.col("company")),
        "location": norm_location(F.col("location")),
        "description": norm_description(F.col("description")),
        "job_type": norm_job_type(F.col("job_type")),
        "experience_raw": blank_null(strip(exp)),
        "max_experience_required": years,
        "salary_min": lo,
        "salary_max": hi,
    }
    return refilled.select(*[changed.get(c, F.col(c)).alias(c) for c in df.columns])


def export_projection(df: DataFrame, include_metadata: bool = False, columns: Sequence[str] = EXPORT_COLUMNS) -> DataFrame:
    """The twelve text columns of an export, or some of them, nulls as ``""``; metadata with all of them on request."""
    def text(c):
        return F.coalesce(c.cast("string"), F.lit(""))

    special = {"salary": first_nonblank(F.col("salary"), F.col("salary_raw"))}
    shown = [text(special.get(c, F.col(c))).alias(c) for c in EXPORT_COLUMNS if c in columns]
    if include_metadata:
        # The years column turns back into a nullable number beside the metadata.
        shown[EXPORT_COLUMNS.index("max_experience_required")] = F.col("max_experience_required")
        extra = {
            "tags": F.array_join("tags", ", "),
            "company_logo": text(F.col("company_logo")),
        }
        shown += [extra.get(c, F.col(c)).alias(c) for c in METADATA_COLUMNS]
    return df.select(*shown)
