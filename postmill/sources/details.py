"""Detail pages: main text of a posting page per board."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.html import any_of, body_text, element, html_nodes

_CHROME_TAGS = [element(t) for t in ("nav", "header", "footer", "script", "style")]

# Page parts without posting text, and text containers in order.
CHROME = {
    "naukri": any_of(*_CHROME_TAGS, element(cls_has="apply"), element(cls_has="sidebar")),
    "remoteok": any_of(
        *_CHROME_TAGS, element(cls_has="apply"), element(cls_has="sidebar"), element(cls_has="social")
    ),
    "wellfound": any_of(
        *_CHROME_TAGS, element(cls_has="apply-btn"), element(cls_has="sidebar"), element(cls_has="social"),
        element(cls_has="navbar"), element(cls_has="cookie"), element(label="navigation"),
    ),
}
CONTAINERS = {
    "naukri": (
        element(cls="styles_JDC__dang-inner-html"), element(cls="dang-inner-html"), element(cls="job-desc"),
        element(cls_has="styles_JDC__dang-inner-html"), element("section", cls="styles_job-desc-container"),
        element(cls_has="job-desc-container"), element("div", cls_has="job-description"),
        element(cls_has="jd-container"), element("main"), element("article"),
    ),
    "remoteok": (
        element("div", cls="description"), element("td", cls="description"), element("div", cls_has="description"),
        element("div", cls="markdown"), element(cls="job-description"), element("article"), element("main"),
        element("body"),
    ),
    "wellfound": (
        element(cls="job-description"), element(testid_has="job-description"),
        element("div", cls_has="description"), element("section", cls_has="description"),
        element(cls_has="styles_description"), element(cls_has="jobDescription"), element("main"), element("article"),
    ),
}


def extract_body_text(pages: DataFrame, source: str) -> DataFrame:
    """``pages(html, ...)`` with the page source replaced by its main ``text``."""
    keep = [c for c in pages.columns if c != "html"]
    parsed = pages.select(*keep, html_nodes(F.col("html")).alias("_nodes"))
    return parsed.select(*keep, body_text(F.col("_nodes"), CHROME[source], CONTAINERS[source]).alias("text"))
