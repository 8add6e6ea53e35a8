"""Payloads to export in one run; sources that fail; pages that can't be read."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from postmill.operators.dedup import merge_sources
from postmill.plans.payload_flow import Landed, details_of, payload_flow
from postmill.plans.posting_flow import export_flow
from postmill.sources.exports import read_csv_text
from postmill.sources.registry import default_registry
from postmill.sources.rejects import page_rejects
from postmill.sources.staging import merge_isolated

AS_OF = datetime(2026, 10, 1, tzinfo=timezone.utc)
LONG = "Wir bauen Brücken – 日本語 and more text about the work that is to be done here every day. " * 3


def feed_item(n, title, **more):
    return {"id": str(n), "position": title, "company": f"Firma {n}", "tags": ["remote", "python"], "description": f"<p>Größe {n} &amp; mehr</p>",
            "location": "Remote", "url": f"https://r.example.com/{n}", "date": "2026-09-20T10:00:00+00:00", **more}


@pytest.fixture
def landed(spark):
    feed = json.dumps([{"legal": "notice"}, feed_item(1, "Bäcker"), "stray", feed_item(2, "Gärtner, \"jung\""), feed_item(1, "Bäcker again")])
    api = json.dumps({"jobDetails": [
        {"title": f"Schlosser {n}", "companyName": "Werk", "jdURL": f"/stelle-{n}", "jobDescription": "Metall\nund mehr", "createdDate": "2026-09-24"} for n in (1, 2, 3)
    ]})
    card = '<div data-testid="job-card"><h2>{t}</h2><h4>Neu</h4><a href="/jobs/{t}">x</a><p>Ort</p></div>'
    html = "<html><body>" + card.format(t="Imker") + card.format(t="Senior Imker") + "</body></html>"
    frame = spark.createDataFrame
    return [
        Landed("naukri", frame([(0, api), (1, "broken")], "page_id long, payload string"), {"as_of": AS_OF}),
        Landed("remoteok", frame([(0, feed)], "page_id long, payload string"), {"as_of": AS_OF}),
        Landed("wellfound", frame([(0, html, "pune"), (1, "<![foo[ x", "")], "page_id long, html string, search_location string")),
    ]


@pytest.fixture
def pages(spark):
    rows = [("naukri", "https://www.naukri.com/stelle-2", f"<html><body><nav>menu</nav><main>{LONG}</main></body></html>"),
            ("remoteok", "https://r.example.com/2", "<![foo[ x"), ("naukri", "https://www.naukri.com/stelle-3", None)]
    return spark.createDataFrame(rows, "source string, url string, html string")


def test_payloads_to_export(spark, landed, pages, tmp_path):
    run = payload_flow(spark, landed, pages, AS_OF, f"{tmp_path}/run")
    rows = {r["title"]: r for r in read_csv_text(spark, run.path).collect()}
    assert sorted(rows) == ["Bäcker", "Gärtner, \"jung\"", "Imker", "Schlosser 1", "Schlosser 2", "Schlosser 3"]
    assert rows["Schlosser 2"]["description"] == LONG.strip() and rows["Bäcker"]["description"] == "Größe 1 & mehr"
    assert rows["Imker"]["url"].endswith("/jobs/Imker") and rows["Schlosser 1"]["source"] == "naukri"
    counts = {(r["step"], r["counter"]): r["n_rows"] for r in run.counts.collect()}
    # The second Bäcker has the first one's link, the senior beekeeper goes.
    assert (counts["normalise", "n_input"], counts["filter", "kept"], counts["filter", "senior"], counts["dedup", "n_unique"]) == (8, 7, 1, 6)
    assert (counts["sources", "naukri"], counts["sources", "remoteok"], counts["sources", "wellfound"], counts["sources", "other"]) == (3, 2, 1, 0)
    assert counts["enrich", "n_rich"] == 1 and counts["enrich", "n_total"] == 6
    assert [(r["source"], r["state"], r["n_rows"]) for r in run.status.orderBy("source_rank").collect()] == [
        ("naukri", "ok", 3), ("remoteok", "ok", 3), ("wellfound", "ok", 2)]


def test_a_failing_source_contributes_nothing(spark, landed, pages, tmp_path):
    """One adapter raises at once, another while its tasks run; the rest is as without them."""
    registry = default_registry()

    def raising(payloads):
        raise KeyError("no such field")

    def breaking(payloads):
        return payloads.select("page_id", F.lit("x").alias("title"), F.raise_error(F.lit("bad block")).cast("string").alias("company"))

    registry.register("raising", raising)
    registry.register("breaking", breaking)
    bad = [Landed(name, landed[0].payloads) for name in ("raising", "breaking")]
    mixed = [bad[0], landed[0], bad[1], landed[1]]
    got = payload_flow(spark, mixed, pages, AS_OF, f"{tmp_path}/mixed", registry)
    alone = payload_flow(spark, landed[:2], pages, AS_OF, f"{tmp_path}/alone", registry)
    read = lambda run: sorted(map(tuple, read_csv_text(spark, run.path).collect()))
    assert read(got) == read(alone) and len(read(got)) == 5
    status = got.status.orderBy("source_rank").collect()
    assert [r["state"] for r in status] == ["failed", "ok", "failed", "ok"]
    assert "no such field" in status[0]["reason"] and status[2]["reason"]
    none = payload_flow(spark, bad, pages, AS_OF, f"{tmp_path}/none", registry)
    assert none.path == "" and not (tmp_path / "none").exists()


def test_isolated_merge_equals_the_plain_one(spark, landed, pages):
    """Staging changes nothing about the postings."""
    known = default_registry()
    build = [lambda s=s: known.postings(s.adapter, s.payloads, **s.options) for s in landed]
    merged, _ = merge_isolated(spark, list(zip("abc", build, strict=True)))
    plain = merge_sources([b() for b in build])
    read = lambda raw: sorted(map(tuple, export_flow(raw, details_of(pages), AS_OF).drop("scraped_at").collect()), key=str)
    assert read(merged) == read(plain)


def test_page_rejects(spark, landed, pages):
    got = sorted((r["url"], r["reject_reason"]) for r in page_rejects(pages).collect())
    assert got == [("https://r.example.com/2", "page not readable"), ("https://www.naukri.com/stelle-3", "page missing")]
    assert [(r["page_id"], r["reject_reason"]) for r in page_rejects(landed[2].payloads).collect()] == [(1, "page not readable")]
    assert page_rejects(pages.limit(0)).count() == 0
