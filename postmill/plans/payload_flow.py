"""One run from landed payloads to an export: adapters, merge, flow, page texts, CSV."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import partial, reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.text import strip
from postmill.plans.counters import Counters
from postmill.plans.posting_flow import export_flow
from postmill.sources.details import CONTAINERS, extract_body_text
from postmill.sources.exports import write_csv
from postmill.sources.registry import SourceRegistry, default_registry
from postmill.sources.staging import merge_isolated


class Landed(NamedTuple):
    """Payloads of one source, the adapter that reads them and its options."""

    adapter: str
    payloads: DataFrame
    options: Mapping = {}


class Run(NamedTuple):
    """Where the export is (``""`` without rows), how each source fared and what each step counted."""

    path: str
    status: DataFrame
    counts: DataFrame


def details_of(pages: DataFrame) -> DataFrame:
    """Landed detail pages ``(source, url, html)`` as ``(source, url, text)``, each board by its own containers."""
    named = pages.select(F.lower(strip(F.col("source"))).alias("source"), "url", "html")
    parts = [extract_body_text(named.where(F.col("source") == board), board) for board in CONTAINERS]
    # A generator's columns are worked out once: a page isn't parsed again by the filters on its text.
    once = [p.select("source", "url", F.inline(F.array(F.struct("text")))) for p in parts]
    return reduce(DataFrame.unionByName, once).where(F.col("text") != "")


def payload_flow(
    spark: SparkSession, landed: Sequence[Landed], pages: DataFrame, as_of: datetime, path: str,
    registry: SourceRegistry | None = None, **options,
) -> Run:
    """Runs the sources in the given order, which is the order of "first wins", and writes the export.

    A source that fails is left out and named in the status. ``options`` are those of ``posting_flow``.
    """
    known = registry or default_registry()
    sources = [(s.adapter, partial(known.postings, s.adapter, s.payloads, **s.options)) for s in landed]
    raw, status = merge_isolated(spark, sources)
    counters = Counters()
    written = write_csv(export_flow(raw, pages, as_of, counters=counters, read=details_of, **options), path, as_of)
    return Run(written, status, counters.frame(spark))
