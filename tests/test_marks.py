"""Bitmaps of numbers, and flows that shuffle no text they can leave where it is."""

import random

import pytest
from pyspark.sql import functions as F

from postmill.checks import derived
from postmill.operators import dedup, enrich, lineage, marks
from postmill.plans.counters import Counters
from postmill.plans.posting_flow import export_flow, posting_flow

NUMBERS = [0, 1, 7, 8, 9, 32767, 32768, 32769, 1 << 33, (1 << 33) + 5, (5 << 33) + 70000]


def test_marked_numbers_are_found_again(spark):
    found = marks.marks(spark.createDataFrame([(n,) for n in NUMBERS + [None, 7]], "n bigint"))
    near = sorted({n + d for n in NUMBERS for d in range(-9, 10) if n + d >= 0})
    rows = spark.createDataFrame([(n,) for n in near] + [(None,)], "x bigint")
    assert sorted(r.x for r in marks.marked(rows, F.col("x"), found).collect()) == NUMBERS
    told = marks.with_mark(rows, F.col("x"), found, "hit")
    assert told.columns == ["x", "hit"] and told.count() == len(near) + 1
    assert sorted(r.x for r in told.where("hit").collect()) == NUMBERS


def test_places_stay_in_their_range(spark):
    rows = spark.range(2000).select(marks.place(F.col("id").cast("string"), F.lit("x")).alias("p"))
    low, high = rows.agg(F.min("p"), F.max("p")).first()
    assert 0 <= low and high < marks.KEY_PLACES


POSTING = "ord long, title string, company string, url string, source string, description string, salary string, salary_raw string, experience_raw string, max_experience_required bigint, salary_min bigint, salary_max bigint, source_rank int, job_id string"


def _postings(spark, n=300):
    dice = random.Random(3)
    urls = ["", "#", "/", None] + [f"https://j.example.com/{i}" for i in range(60)]
    rows = [(i, f"T{i}", "C", dice.choice(urls), dice.choice(["naukri", " Naukri ", "remoteok", "other", None]), dice.choice(["", None, "short", "d" * 150]),
             None, dice.choice([None, "6 LPA"]), dice.choice([None, "", "2 years"]), dice.choice([None, 1]), None, None, 0, f"j{i % 200}") for i in range(n)]
    return spark.createDataFrame(rows, POSTING)


def _pages(spark):
    dice = random.Random(4)
    rows = [(dice.choice(["naukri", "NAUKRI ", "remoteok", "other"]), f"https://j.example.com/{dice.randint(0, 80)}",
             f" CTC: $8,000 - $15,000 per annum. Minimum {i % 7} years. " + "x " * dice.randint(5, 90)) for i in range(200)]
    return spark.createDataFrame(rows + [("naukri", None, "y" * 90), (None, "https://j.example.com/1", "y" * 90)], "source string, url string, text string")


def _plain(postings, pages):
    """The description every posting ends with, from a plain join with one text per url."""
    known = enrich.known_sources(postings).where(F.col("adapter").isNotNull() & ~F.col("url").isin("", "#", "/"))
    texts = enrich.usable_details(pages)
    joined = known.join(texts, (F.col("adapter") == F.col("d_source")) & (F.col("url") == F.col("d_url")))
    return {r.ord: r.d_text for r in joined.collect()}


@pytest.mark.parametrize("shipped", [marks.SHIPPED_BITMAPS, 0])
def test_enrichment_as_by_a_plain_join(spark, monkeypatch, shipped):
    """Also where bitmaps share places and are not shipped."""
    monkeypatch.setattr(marks, "SHIPPED_BITMAPS", shipped)
    monkeypatch.setattr(marks, "KEY_PLACES", 16)
    postings, pages = _postings(spark), _pages(spark)
    page = _plain(postings, pages)
    before = {r.ord: r for r in postings.collect()}
    after = {r.ord: r for r in enrich.enrich_details(postings, pages).collect()}
    assert after.keys() == before.keys() and 50 < len(page) < 300
    for i, row in before.items():
        longer = len(page.get(i, "")) > len(row.description or "")
        assert after[i].description == (page[i] if longer else row.description)
        assert after[i].title == row.title and bool(after[i].salary_raw) == bool(row.salary_raw or i in page)
        assert (after[i].experience_raw or "") == (row.experience_raw or "") or i in page and not row.experience_raw
    some = enrich.enrich_details(postings, pages, columns=("ord", "title"))
    assert sorted(map(tuple, some.collect())) == sorted((r.ord, r.title) for r in before.values())


def test_written_duplicates_as_by_the_plain_rule(spark):
    postings = _postings(spark)
    with lineage.passing_steps(spark) as cut:
        got = sorted(map(tuple, dedup.dedup_exact_written(postings, cut).collect()), key=str)
        bare = sorted(map(tuple, dedup.dedup_exact_written(postings.drop("ord"), cut).collect()), key=str)
    assert got == sorted(map(tuple, dedup.dedup_exact(postings).collect()), key=str)
    assert bare == sorted(map(tuple, dedup.dedup_exact(postings.drop("ord")).collect()), key=str)


def test_a_written_step_leaves_no_shuffle_files(spark, tmp_path, monkeypatch):
    """A step's shuffles end with its write; they used to stay until the JVM collected its plan."""
    monkeypatch.setattr(lineage, "shared_folder", lambda _: str(tmp_path))
    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f"{f}" for f in folder.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}

    before = files()
    rows = spark.range(2000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t"))
    out = lineage.cut_lineage(rows.repartition(7, "t"))
    assert not files() - before
    assert out.count() == 2000
    assert spark.conf.get(lineage.SHUFFLES_GO) == "false"


def test_duplicates_of_the_flow_are_chosen_without_texts(spark, sf):
    """No plan that is written shuffles a description, and only texts of pages that are asked for are kept."""
    plans = []
    with pytest.MonkeyPatch.context() as patch:
        write = lineage._written
        patch.setattr(lineage, "_written", lambda df, path: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, path))
        counters = Counters()
        rows = posting_flow(derived.raw_postings(spark, sf), derived.details(spark, sf), derived.AS_OF, counters=counters)
    windows = [p for p in plans if "Window" in p]
    assert windows and not any("description" in line or "d_text" in line for p in windows for line in p.split("\n") if "Exchange" in line)
    assert rows.count() == export_flow(derived.raw_postings(spark, sf), derived.details(spark, sf), derived.AS_OF).count()
    seen = {(r.step, r.counter): r.n_rows for r in counters.frame(spark).collect()}
    assert seen["dedup", "n_unique"] == seen["enrich", "n_total"] == rows.count()
