"""Exact duplicate removal with first-wins order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import blank_null, strip
from postmill.operators.marks import marked, marks, numbered
from postmill.operators.model import fingerprint, order_columns


# What tells postings apart that hold one position; the rest, whole descriptions among it, isn't read for the order.
IDENTITY = ("job_id", "url", "title", "company")


def first_per_group(
    df: DataFrame, keys: Sequence[Column], order: Sequence[Column | str], rows: int = 1, tie: Sequence[str] = ()
) -> DataFrame:
    """The first ``rows`` rows of every group.

    ``row_number() <= rows`` lets Spark put a group limit in front of the shuffle:
    each map task forwards at most ``rows`` rows per key, so a key that holds a
    third of the table still reaches its reducer as a handful of rows. Rows that tie
    in ``order`` are told apart by a hash of the columns ``tie``, by default of the whole
    row, so a re-run task picks the same one.
    """
    names = tie or [c for c, kind in df.dtypes if "map<" not in kind]
    content = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    window = Window.partitionBy(*keys).orderBy(*order, content)
    return df.withColumn("_nth", F.row_number().over(window)).where(F.col("_nth") <= rows).drop("_nth")


def _tie(df: DataFrame) -> list[str]:
    """Numbered postings tie only where a position is given twice; their identity is enough then."""
    return [c for c in IDENTITY if c in df.columns] if "ord" in df.columns else []


def dedup_exact(df: DataFrame) -> DataFrame:
    """First posting per ``job_id``; a blank id falls back to the fingerprint."""
    key = F.coalesce(blank_null(F.col("job_id")), fingerprint(F.col("url"), F.col("title"), F.col("company")))
    return first_per_group(df, [key], order_columns(df), tie=_tie(df))


def dedup_exact_written(df: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``dedup_exact`` of postings with whole descriptions: ``cut`` writes them, what decides is shuffled without them.

    The rows that stay are marked by their numbers, and the others are left out where the written rows are read.
    Unnumbered postings are told apart by all of their columns, so they are shuffled whole.
    """
    if not _tie(df):
        return dedup_exact(df)
    written = cut(numbered(df, "_row"))
    first = dedup_exact(written.drop("description"))
    return marked(written, F.col("_row"), marks(first.select("_row"))).drop("_row")


def dedup_exact_raw(df: DataFrame) -> DataFrame:
    """First raw row per fingerprint, which is always computed anew."""
    return first_per_group(df, [fingerprint(F.col("url"), F.col("title"), F.col("company"))], order_columns(df), tie=_tie(df))


def dedup_natural_key(df: DataFrame) -> DataFrame:
    """First posting per title, company and location, compared without case."""
    keys = [F.lower(strip(F.coalesce(F.col(c), F.lit("")))) for c in ("title", "company", "location")]
    return first_per_group(df, keys, order_columns(df), tie=_tie(df))


def merge_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """Concatenate source outputs in the given order; the place becomes ``source_rank``."""
    ranked = [df.withColumn("source_rank", F.lit(rank)) for rank, df in enumerate(sources)]
    merged = ranked[0]
    for df in ranked[1:]:
        merged = merged.unionByName(df, allowMissingColumns=True)
    return merged


def cross_source_dedup(sources: Sequence[DataFrame]) -> DataFrame:
    return dedup_exact(merge_sources(sources))


def cap_per_source(df: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` postings of each source."""
    return first_per_group(df, [F.col("source")], order_columns(df), limit, _tie(df))
