"""Queries for CSV exports: every one writes, reads back and compares."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.checks import derived, duck
from postmill.checks.catalog import query
from postmill.checks.scalar_queries import SEARCH_CTES
from postmill.functions.search import parse_search
from postmill.operators.lineage import staging_path
from postmill.operators.model import canonicalise, valid
from postmill.operators.normalise import export_projection, normalise_postings
from postmill.schema import EXPORT_COLUMNS
from postmill.sources import exports

RUN_AT = derived.AS_OF
# The exports repeat whole descriptions: as plain text they take many times the disk of the tables.
PACKED = {"compression": "gzip"}
CANON_EXPORT = (
    "title, company, location, description, coalesce(salary, salary_raw, '') AS salary, coalesce(experience_raw, '') AS experience_raw,"
    " '' AS max_experience_required, url, coalesce(posted_date, '') AS posted_date, job_type, source, scraped_at"
)
GOOD = f"{duck.stages('good')} SELECT {CANON_EXPORT} FROM good"


def _postings(spark, sf):
    """Valid postings with their line breaks, quotes and commas still in place."""
    return valid(canonicalise(derived.raw_postings(spark, sf), RUN_AT))


def _written(spark, rows, name, **options):
    path = staging_path(spark, name) + ".csv"
    exports.write_csv(rows, path, RUN_AT, **PACKED, **options)
    return path


@query("write_csv", GOOD)
def write_csv(spark, sf):
    return exports.read_csv_text(spark, _written(spark, export_projection(_postings(spark, sf)), "export"))


@query("scan_csv_text", f"{duck.stages('good')} SELECT {CANON_EXPORT} FROM good")
def scan_csv_text(spark, sf):
    path = _written(spark, export_projection(_postings(spark, sf)), "export")
    return exports.read_csv_text(spark, path)


@query(
    "scan_csv_typed",
    f"{duck.stages('norm')} SELECT source, job_type, count(*) AS n_rows, CAST(sum(max_experience_required) AS BIGINT) AS sum_years, count(posted_date) AS n_dated FROM norm GROUP BY source, job_type",
)
def scan_csv_typed(spark, sf):
    path = _written(spark, export_projection(normalise_postings(_postings(spark, sf))), "export")
    return exports.read_csv_typed(spark, path).groupBy("source", "job_type").agg(
        F.count("*").alias("n_rows"), F.sum("max_experience_required").alias("sum_years"), F.count("posted_date").alias("n_dated"))


def _two_runs(spark, sf):
    folder = staging_path(spark, "runs")
    rows = _postings(spark, sf)
    for place, part in (("pune", rows.where("k % 2 = 0")), ("noida", rows.where("k % 2 = 1"))):
        exports.write_csv(export_projection(part), exports.run_path(folder, RUN_AT, "Data Engineer", place) + ".csv", RUN_AT, **PACKED)
    return folder


@query("scan_csv_glob", GOOD)
def scan_csv_glob(spark, sf):
    return exports.read_csv_glob(spark, _two_runs(spark, sf) + "/jobs_*.csv")


_RUN_NAME = f"'jobs_data-engineer_' || CASE k % 2 WHEN 0 THEN 'pune' ELSE 'noida' END || '_{RUN_AT:%Y%m%d_%H%M%S}.csv'"


@query("list_exports", f"{duck.stages('good')} SELECT DISTINCT {_RUN_NAME} AS name FROM good")
def list_exports(spark, sf):
    return exports.list_exports(spark, _two_runs(spark, sf))


_EXTRA_EXPORT = CANON_EXPORT.replace("scraped_at", f"'{RUN_AT.isoformat()}' AS scraped_at")


@query("write_csv_extra", f"{duck.stages('good')} SELECT {_EXTRA_EXPORT}, CAST(k AS VARCHAR) AS board_key FROM good")
def write_csv_extra(spark, sf):
    """Two export columns are absent, one column is extra."""
    frame = _postings(spark, sf).select(
        "title", "company", "location", "description", F.coalesce("salary", F.lit("")).alias("salary"),
        F.coalesce("experience_raw", F.lit("")).alias("experience_raw"), "url", "posted_date", "job_type", "source", F.col("k").alias("board_key"))
    path = _written(spark, frame, "extra", keep_extra=True)
    ddl = ", ".join(f"{c} string" for c in (*EXPORT_COLUMNS, "board_key"))
    return spark.read.schema(ddl).options(**exports.READ_OPTIONS).csv(path).fillna("")


@query("append_csv", f"{duck.stages('good')} SELECT {CANON_EXPORT} FROM good UNION ALL SELECT {CANON_EXPORT} FROM good WHERE k % 3 = 0")
def append_csv(spark, sf):
    rows = _postings(spark, sf)
    path = _written(spark, export_projection(rows), "export")
    exports.write_csv(export_projection(rows.where("k % 3 = 0")), path, RUN_AT, append=True, **PACKED)
    return exports.read_csv_text(spark, path)


@query(
    "fill_export_defaults",
    f"{duck.stages('base')} SELECT k, coalesce(nullif(CASE WHEN k % 2 = 0 THEN posted_raw WHEN k % 2 = 1 THEN '' END, ''), CASE WHEN k % 3 = 0 THEN 'old' END, '') AS posted_date, coalesce(nullif(CASE WHEN k % 4 = 0 THEN '2001' WHEN k % 4 = 1 THEN '' END, ''), '{RUN_AT.isoformat()}') AS scraped_at FROM base",
)
def fill_export_defaults(spark, sf):
    k = F.col("k")
    rows = derived.postings(spark, sf).select(
        "k",
        F.when(k % 2 == 0, F.col("posted_raw")).otherwise("").alias("posted_date"),
        F.when(k % 3 == 0, "old").alias("posting_date"),
        F.when(k % 4 == 0, "2001").when(k % 4 == 1, "").alias("scraped_at"),
    )
    return exports.fill_export_defaults(rows, RUN_AT).select("k", "posted_date", "scraped_at")


_PLACES = "array_to_string(locations, ' ')"


@query(
    "run_output_path",
    f"WITH {SEARCH_CTES} SELECT search_id, coalesce(nullif({duck.slug('role')}, ''), 'all') AS role_slug, coalesce(nullif({duck.slug(_PLACES)}, ''), 'all') AS location_slug FROM parsed",
)
def run_output_path(spark, sf):
    s = derived.searches(spark, sf).select("search_id", parse_search(F.col("text")).alias("s"))
    role, place = exports.run_slug(F.col("s.role"), F.array_join("s.locations", " "))
    return s.select("search_id", role.alias("role_slug"), place.alias("location_slug"))


@query("empty_guard", f"{GOOD} WHERE title = 'no such title'")
def empty_guard(spark, sf):
    """Nothing matches, nothing is written, and the missing export reads as empty."""
    path = staging_path(spark, "none") + ".csv"
    exports.write_csv(export_projection(_postings(spark, sf).where(F.col("title") == "no such title")), path, RUN_AT)
    return exports.read_csv_text(spark, path)
