"""What the payload scans leave out, with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.html import html_nodes
from postmill.functions.text import let


def rejected(payloads: DataFrame, elements: Column, payload: str) -> DataFrame:
    """``(page columns, ord, reject_reason)`` for every payload or element that no scan can use.

    A payload without a readable list is one row with a null ``ord``; an element that is
    not an object is one row under its place. An empty list rejects nothing.
    """
    keep = [c for c in payloads.columns if c != payload]
    missing = F.col(payload).isNull()

    def reject(ord: Column, reason: Column) -> Column:
        return F.struct(ord.cast("bigint").alias("ord"), reason.alias("reject_reason"))

    # The payload is parsed once, and of its elements only places and reasons go on.
    def found(texts: Column) -> Column:
        whole = F.array(reject(F.lit(None), F.when(missing, "payload missing").otherwise("no list of elements")))
        usable = lambda text: F.coalesce(text.startswith("{"), F.lit(False))
        marked = F.transform(texts, lambda text, i: F.when(~usable(text), reject(i, F.lit("element is no object"))))
        return F.when(missing | texts.isNull(), whole).otherwise(F.filter(marked, lambda r: r.isNotNull()))

    return payloads.select(*keep, F.inline(let(elements, found)))


def page_rejects(pages: DataFrame, html: str = "html") -> DataFrame:
    """``(page columns, reject_reason)`` of every page that no card or text scan can read."""
    keep = [c for c in pages.columns if c != html]
    parsed = pages.select(*keep, F.col(html).isNull().alias("_missing"), html_nodes(F.col(html)).isNull().alias("_unread"))
    reason = F.when(F.col("_missing"), "page missing").when(F.col("_unread"), "page not readable")
    return parsed.select(*keep, reason.alias("reject_reason")).where(F.col("reject_reason").isNotNull())
