"""The whole posting run as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.operators.dedup import IDENTITY, cap_per_source, dedup_exact, dedup_exact_written
from postmill.operators.enrich import carried, enrich_details
from postmill.operators.filters import EXPERIENCE_CEILING, experience_ceiling, with_drop_reason
from postmill.operators.lineage import passing_steps
from postmill.operators.model import canonicalise, valid
from postmill.operators.normalise import export_projection, normalise_postings
from postmill.plans.counters import Counters, watch_filter, watch_result, watch_unique, watch_validation
from postmill.schema import SOURCES


def posting_flow(
    raw: DataFrame,
    details: DataFrame,
    as_of: datetime,
    *,
    cap: int | None = None,
    ceiling: int = EXPERIENCE_CEILING,
    refilter: bool = False,
    sources: Sequence[str] = SOURCES,
    counters: Counters | None = None,
    columns: Sequence[str] | None = None,
    read: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Merged raw postings to deduplicated, enriched canonical postings.

    ``raw`` carries ``source_rank`` and ``ord``. Cheap row-local work comes first,
    then duplicates go, and only what is left is joined to the large page texts.
    The years found in a page do not remove a posting unless ``refilter`` asks for it.
    ``counters`` are filled by the run itself, which then reads its input once.
    With ``columns`` the result has these only, and the steps carry no others than they need.
    ``read`` turns ``details(source, url, ...)`` into texts; pages that no posting asks for are left out before.
    """
    if columns is not None and (refilter or counters is not None):
        raise ValueError("counters and refilter look at all columns")

    def watched(watch: Callable[[Counters, DataFrame], DataFrame], df: DataFrame) -> DataFrame:
        return df if counters is None else watch(counters, df)

    postings = valid(watched(watch_validation, canonicalise(raw, as_of)))
    if cap is not None:
        postings = cap_per_source(postings, cap)
    judged = watched(watch_filter, with_drop_reason(normalise_postings(postings), ceiling))
    shortlisted = judged.where(F.col("drop_reason").isNull()).drop("drop_reason")
    shortlisted = carried(shortlisted, None if columns is None else [*columns, *IDENTITY])
    with passing_steps(raw.sparkSession) as cut:
        unique = dedup_exact_written(shortlisted, cut) if "description" in shortlisted.columns else dedup_exact(shortlisted)
        enriched = enrich_details(watched(watch_unique, unique), details, sources, columns, read)
    return watched(watch_result, experience_ceiling(enriched, ceiling) if refilter else enriched)


def export_flow(raw: DataFrame, details: DataFrame, as_of: datetime, *, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """The flow with the twelve export columns, or those of them that ``columns`` names."""
    if columns is None:
        return export_projection(posting_flow(raw, details, as_of, **options))
    needed = [*columns, *(["salary_raw"] if "salary" in columns else [])]
    return export_projection(posting_flow(raw, details, as_of, columns=needed, **options), columns=columns)
