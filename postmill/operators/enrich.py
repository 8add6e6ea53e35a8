"""Fill blanks of a posting from its full text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.experience import with_deep_fields
from postmill.functions.text import blank_null, first_nonblank, strip
from postmill.operators.dedup import first_per_group
from postmill.operators.lineage import cut_lineage, passing_steps
from postmill.operators.marks import marked, marks, numbered, place, with_mark
from postmill.operators.model import order_columns
from postmill.schema import SOURCES

MINIMUM_TEXT = 80
RICH_TEXT = 200


def usable_details(details: DataFrame) -> DataFrame:
    """``details(source, url, text)`` to one usable text per url: the longest, of equally long ones that of the smallest hash.

    Texts are no part of the order, so no text is compared or sorted by.
    """
    return _longest(_named(details)).drop("_length", "_hash")


def _named(details: DataFrame) -> DataFrame:
    """Keys and texts with what texts are ordered by, so that a text nobody reads afterwards is not shuffled."""
    text = strip(F.col("text"))
    return details.select(
        F.lower(strip(F.col("source"))).alias("d_source"), F.col("url").alias("d_url"), text.alias("d_text"),
        F.length(text).alias("_length"), F.xxhash64(text).alias("_hash"),
    )


# What tells which of several texts a page link takes.
PAGE_KEYS = ("d_source", "d_url", "_length", "_hash")


def _longest(named: DataFrame) -> DataFrame:
    order = [F.desc("_length"), F.col("_hash")]
    return first_per_group(
        named.where(F.col("_length") >= MINIMUM_TEXT), [F.col("d_source"), F.col("d_url")], order, tie=["_hash"])


def known_sources(df: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """Adapter name of each posting, null where no adapter knows the source."""
    source = F.lower(strip(F.col("source")))
    return df.withColumn("adapter", F.when(source.isin(*sources), source))


# Columns of a posting that a filled column is made of, beside itself.
FILLED_FROM = {"salary": ("salary_raw",)}
# Columns that a page text can fill.
FILLED = ("description", "experience_raw", "max_experience_required", "salary", "salary_raw", "salary_min", "salary_max")


def carried(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """The columns of the postings that a result with ``columns`` needs, those of keys and order among them."""
    if columns is None:
        return df
    needed = {*columns, *(c for name in columns for c in FILLED_FROM.get(name, ())), "source", "url", *(order_columns(df) or ["job_id"])}
    return df.select(*[c for c in df.columns if c in needed])


def enrich_details(
    df: DataFrame, details: DataFrame, sources: Sequence[str] = SOURCES, columns: Sequence[str] | None = None,
    read: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Longer text replaces the description; other fields fill only where blank.

    The postings are written once. Their page keys go to the pages as bitmaps of bounded size, so pages that no
    posting asks for are left out where they are read; the few that share a place in the bitmap go in the join.
    What is left of the pages is written too, and which page a posting takes is found by keys and lengths alone.
    Only then texts are shuffled: of each page taken once, and of a description only if no longer page text
    replaces it. Postings without a page are not shuffled at all. Texts are parsed after the join.

    Placeholder urls and unknown sources ask for no page.

    With ``columns`` the result has these only, and what none of them needs is neither written nor shuffled.
    ``read`` makes texts of ``details(source, url, ...)``, of those pages only that may be asked for.
    """
    result = [c for c in df.columns if columns is None or c in columns]
    left = cut_lineage(numbered(known_sources(carried(df, columns), sources), "_row"))
    has_page = F.col("adapter").isNotNull() & ~F.coalesce(F.col("url"), F.lit("")).isin("", "#", "/")
    asking = left.where(has_page)
    asked_for = marks(asking.select(place(F.col("adapter"), F.col("url"))))
    found = marked(details, place(F.lower(strip(F.col("source"))), F.col("url")), asked_for)
    pages = _named(read(found) if read else found)
    text = ["d_text"] if any(c in FILLED for c in result) else []
    keys = (F.col("adapter") == F.col("d_source")) & (F.col("url") == F.col("d_url"))

    with passing_steps(df.sparkSession) as cut:
        written = cut_lineage(numbered(pages.where(F.col("_length") >= MINIMUM_TEXT).select(*PAGE_KEYS, *text), "_page"))
        chosen = _longest(written.select(*PAGE_KEYS, "_page"))
        own = F.length(F.coalesce(F.col("description"), F.lit(""))) if "description" in left.columns else F.lit(0)
        decided = cut(asking.select("_row", "adapter", "url", own.alias("_own")).join(chosen, keys).select(
            "_row", "_page", (F.col("_length") > F.col("_own")).alias("_replaced")))
        taken, paged = marks(decided.select("_page")), marks(decided.select("_row"))
        replaced = marks(decided.where("_replaced").select("_row"))

    number = F.col("_row")
    told = with_mark(with_mark(left, number, paged, "_paged"), number, replaced, "_replaced")
    if "description" in left.columns:
        told = told.withColumn("description", F.when(~F.col("_replaced"), F.col("description")))
    alone = told.where(~F.col("_paged")).withColumn("d_text", F.lit(None).cast("string"))
    # The marks leave one text per link; the choice stays in the plan, for it deals the texts as the join needs them.
    texts = _longest(marked(written, F.col("_page"), taken)).select("d_source", "d_url", *text)
    matched = alone.unionByName(told.where("_paged").join(texts, keys).drop("d_source", "d_url"), allowMissingColumns=True)
    joined = with_deep_fields(matched, "d_text")
    longer = F.length("d_text") > F.length(F.coalesce(F.col("description"), F.lit("")))
    salary_open = blank_null(F.col("salary_raw")).isNull()
    filled = {
        "description": F.when(longer, F.col("d_text")).otherwise(F.col("description")),
        "experience_raw": first_nonblank(F.col("experience_raw"), F.col("d_experience.experience_raw")),
        "max_experience_required": F.coalesce(F.col("max_experience_required"), F.col("d_experience.max_experience")),
        "salary": F.when(salary_open, first_nonblank(F.col("salary"), F.col("d_salary_raw"))).otherwise(F.col("salary")),
        "salary_raw": first_nonblank(F.col("salary_raw"), F.col("d_salary_raw")),
        "salary_min": F.coalesce(F.col("salary_min"), F.nullif(F.col("d_bounds.lo"), F.lit(0))),
        "salary_max": F.coalesce(F.col("salary_max"), F.nullif(F.col("d_bounds.hi"), F.lit(0))),
    }
    return joined.select(*[filled.get(c, F.col(c)).alias(c) for c in result])
