"""CSV exports: writing, reading and listing."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from postmill.functions.search import slugify
from postmill.functions.text import first_nonblank
from postmill.operators.lineage import observed
from postmill.schema import EXPORT_COLUMNS, EXPORT_DDL, EXPORT_TYPED_DDL
from postmill.sources.csv_records import read_csv_records

# Quotes double as in RFC 4180, blanks stay blanks, no value is trimmed.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
WRITE_OPTIONS = {**CSV_OPTIONS, "emptyValue": "", "nullValue": ""}
READ_OPTIONS = {**CSV_OPTIONS, "multiLine": True}


def fill_export_defaults(df: DataFrame, run_at: datetime) -> DataFrame:
    """Missing dates become ``""`` (an older ``posting_date`` helps out), missing times the run time."""
    none = F.lit(None).cast("string")
    posted = [F.col(c) if c in df.columns else none for c in ("posted_date", "posting_date")]
    scraped = F.col("scraped_at") if "scraped_at" in df.columns else none
    return df.withColumns(
        {
            "posted_date": F.coalesce(first_nonblank(*posted), F.lit("")),
            "scraped_at": F.coalesce(first_nonblank(scraped), F.lit(run_at.isoformat())),
        }
    )


def export_rows(df: DataFrame, run_at: datetime, keep_extra: bool = False) -> DataFrame:
    """The twelve columns in file order, absent ones blank; extras after them on request."""
    filled = fill_export_defaults(df, run_at)
    columns = [(F.col(c) if c in filled.columns else F.lit("")).alias(c) for c in EXPORT_COLUMNS]
    extra = [c for c in filled.columns if c not in EXPORT_COLUMNS] if keep_extra else []
    return filled.select(*columns, *extra)


def run_slug(role: Column, location: Column) -> tuple[Column, Column]:
    """Directory names of a search run, ``all`` where nothing usable is given."""
    def named(c: Column) -> Column:
        return F.coalesce(first_nonblank(slugify(c)), F.lit("all"))

    return named(role), named(location)


def run_path(folder: str, run_at: datetime, role: str | None = None, location: str | None = None) -> str:
    """Folder of one run; the time makes it unique and an existing one is an error."""
    def slug(text: str | None) -> str:
        words = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in (text or "").lower())
        return "-".join(words.split()) or "all"

    stamp = run_at.strftime("%Y%m%d_%H%M%S")
    name = "jobs_all" if role is None and location is None else f"jobs_{slug(role)}_{slug(location)}"
    return f"{folder.rstrip('/')}/{name}_{stamp}"


def write_csv(
    df: DataFrame, path: str, run_at: datetime, append: bool = False, keep_extra: bool = False, compression: str = "none",
) -> str:
    """Write an export and return its path, or ``""`` and nothing when there are no rows.

    The plan runs once and nothing is kept: whether there were rows is counted while they are written.
    More rows for an export that is there are written to a hidden folder inside of it, which readers
    skip, and its files are moved up when all of them are complete.
    ``compression``, such as ``gzip``, is of the part files; readers tell it by their names, so parts may differ in it.
    """
    spark = df.sparkSession
    seen = Observation()
    rows = export_rows(df, run_at, keep_extra).observe(seen, F.count(F.lit(1)).alias("n_rows"))
    adds = append and _exists(spark, path)
    target = f"{path.rstrip('/')}/_adding-{uuid.uuid4().hex}" if adds else path
    rows.write.mode("errorifexists").options(**WRITE_OPTIONS, compression=compression).csv(target)
    any_rows = bool(observed(seen).get("n_rows"))
    if adds and any_rows:
        _move_parts(spark, target, path)
    if adds or not any_rows:
        folder, files = _folder(spark, target)
        files.delete(folder, True)
    return path if any_rows else ""


def _folder(spark: SparkSession, path: str):
    """A path and its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _move_parts(spark: SparkSession, source: str, target: str) -> None:
    """Part files to another folder; their names hold the id of their job, so none meets one of the same name."""
    folder, files = _folder(spark, source)
    goal, _ = _folder(spark, target)
    for part in files.listStatus(folder):
        name = part.getPath().getName()
        if name.startswith("part-") and not files.rename(part.getPath(), spark._jvm.org.apache.hadoop.fs.Path(goal, name)):
            raise OSError(f"{name} could not be added to {target}")


def _exists(spark: SparkSession, path: str) -> bool:
    folder, files = _folder(spark, path)
    found = files.globStatus(folder)
    return found is not None and len(found) > 0


def _read(spark: SparkSession, path: str, ddl: str, by_split: bool) -> DataFrame:
    """A task reads a whole file; with ``by_split`` many tasks read it, for more shuffling and the same rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], ddl)
    if by_split:
        return read_csv_records(spark, path, ddl, READ_OPTIONS)
    return spark.read.schema(ddl).options(**READ_OPTIONS).csv(path)


def read_csv_text(spark: SparkSession, path: str, by_split: bool = False) -> DataFrame:
    """Exports below a path or glob as text, blanks as ``""``; a missing one reads as empty."""
    return _read(spark, path, EXPORT_DDL, by_split).fillna("")


def read_csv_typed(spark: SparkSession, path: str, infer: bool = False, by_split: bool = False) -> DataFrame:
    """An export with typed columns: declared ones, or inferred on request."""
    if infer and _exists(spark, path):
        return spark.read.options(**READ_OPTIONS, inferSchema=True).csv(path)
    return _read(spark, path, EXPORT_TYPED_DDL, by_split)


def read_csv_glob(spark: SparkSession, pattern: str, by_split: bool = False) -> DataFrame:
    """All exports whose path matches ``pattern``, under the one declared schema."""
    return read_csv_text(spark, pattern, by_split)


def list_exports(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the export runs in a folder, from file metadata alone."""
    names = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,csv.*}").option("recursiveFileLookup", True)
        .load(folder).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("name"))
    )
    return names.distinct()
