"""What keeps work in proportion to rows: cheap expressions that say the same, and plans that read a text once."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from postmill.checks import derived
from postmill.functions import text
from postmill.functions.html import element, spaced_text
from postmill.operators import filters
from postmill.plans.posting_flow import export_flow
from postmill.sources import cards, feed
from postmill.sources.exports import list_exports, read_csv_text, write_csv

PLAIN_RUN = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
PLAIN_LIMITS = (
    r"(?iU)\bus\s+only\b|\bu\.s\.\s+only\b|\bunited states\s+only\b|\beurope\s+only\b|\blatam\b"
    r"|\buk\s+only\b|\bwithin\s+germany\b|\bberlin\s+office\b"
)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _texts(spark, pieces, n=4000):
    dice = random.Random(7)
    rows = [("".join(dice.choices(pieces, k=dice.randint(0, 9))),) for _ in range(n)]
    return spark.createDataFrame(rows + [("",), (None,)], "t string")


def test_blanks_collapse_as_by_the_plain_class(spark):
    rows = _texts(spark, list("ab \xe9  \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u1fff\u2000\u200a\u200b\u2027\u2028\u2029\u202f\u205f\u3000\u3001"))
    plain = F.btrim(F.regexp_replace("t", PLAIN_RUN, " "))
    assert rows.where(~text.collapse(F.col("t")).eqNullSafe(plain)).isEmpty()


def test_single_blanks_are_no_match(spark):
    """A text of words and single blanks has nothing to replace."""
    assert spark.range(1).select(F.regexp_count(F.lit("a few words here"), F.lit(text.WS_RUN))).first()[0] == 0


def test_regional_limits_as_by_the_plain_rules(spark):
    words = ["us", "US", "U.S.", "uſ", "bus", "uk", "uK", "United States", "europe", "only", "ONLY", "lonely", "latam", "LATAM", "within",
             "wıthİn", "germany", "berlin", "berlİn", "berlın", "office", "offıce", "é", " ", " ", " ", " ", "-", "."]
    rows = _texts(spark, words, 12000)
    found = ~filters.open_to_applicants(F.array().cast("array<string>"), F.col("t"))
    expected = spaced_text(F.col("t")).rlike(PLAIN_LIMITS)
    assert rows.where(~found.eqNullSafe(expected)).isEmpty()
    assert rows.where(found).count() > 100


def test_pieces_as_by_splitting(spark):
    rows = _texts(spark, ["a", " ", "\x01", "<b>", "</b>", "&amp;", "\n", "　"])
    split = F.split(F.regexp_replace(F.coalesce("t", F.lit("")), "</?b>", text.SEP), text.SEP)
    plain = F.array_join(F.filter(F.transform(F.transform(split, lambda p: F.replace(p, F.lit("&amp;"), F.lit("&"))), text.strip), lambda p: p != ""), " ")
    assert rows.where(~spaced_text(F.col("t")).eqNullSafe(plain)).isEmpty()


@pytest.mark.parametrize("make", [derived.postings, derived.details])
def test_texts_meet_orders_in_tasks_of_bounded_rows(spark, sf, monkeypatch, make):
    monkeypatch.setattr(derived, "ROWS_PER_TASK", 50, raising=False)
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert make(spark, sf).rdd.getNumPartitions() >= n / 50


def test_feed_payload_is_parsed_once(spark):
    payloads = spark.createDataFrame([(1, '[{"legal":"x"},{"position":"a"},7]'), (2, "no"), (3, "[]"), (4, None), (5, '[{"legal":"x"}]')], "page_id int, payload string")
    items = feed.scan_feed_json(payloads)
    assert sorted((r.page_id, r.ord) for r in items.collect()) == [(1, 1), (5, 0)]
    assert _plan(items).count("ArrayType(StringType,true), payload") + _plan(items).count("from_json(ArrayType(StringType,true)") <= 2


def test_card_titles_are_looked_up_once(spark):
    pages = spark.createDataFrame([(1, '<div class="jobTuple"><a class="title">T</a></div><div class="jobTuple"></div>')], "page_id int, html string")
    rows = cards.project_card(cards.scan_html_cards(pages), datetime(2002, 1, 1, tzinfo=timezone.utc))
    assert [r.title for r in rows.collect()] == ["T"]
    assert "Filter NOT (title" in _plan(rows)


def test_class_tokens_are_whole_words(spark):
    nodes = spark.sql("SELECT explode(array('a', 'x a', 'a\ty', 'ab', 'b a', 'A', NULL, '')) AS cls").select(F.struct(F.lit("p").alias("tag"), "cls").alias("n"))
    hits = nodes.where(element(cls="a")(F.col("n"), F.array("n"))).select("n.cls").collect()
    assert [h.cls for h in hits] == ["a", "x a", "a\ty", "b a"]


def _flow(spark, **options):
    rows = [(1, 0, "naukri", "https://a.example.com/1", "T1", "C", None, "short"), (2, 0, "naukri", "https://a.example.com/2", "T2", "C", "6 LPA", "d" * 300)]
    raw = spark.createDataFrame(rows, "ord int, source_rank int, source string, url string, title string, company string, salary_raw string, description string")
    pages = [("Naukri", "https://a.example.com/1", "CTC: $8,000 - $15,000 per annum. " + "x " * 60), ("naukri", "https://a.example.com/1", "y" * 90)]
    details = spark.createDataFrame(pages, "source string, url string, text string")
    return export_flow(raw, details, derived.AS_OF, **options)


def test_flow_carries_named_columns_only(spark):
    whole, some = _flow(spark), _flow(spark, columns=("title", "salary"))
    assert some.columns == ["title", "salary"]
    assert sorted(some.collect()) == sorted(whole.select("title", "salary").collect())
    assert "description" not in _plan(some)
    assert "d_text" not in _flow(spark, columns=("title", "source"))._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]


def test_packed_exports_read_as_plain_ones(spark, tmp_path):
    rows = spark.createDataFrame([("a,\n\"b\"", "C"), ("d", "")], "title string, company string")
    plain, packed = str(tmp_path / "jobs_a_1.csv"), str(tmp_path / "jobs_b_1.csv")
    write_csv(rows, plain, derived.AS_OF)
    write_csv(rows, packed, derived.AS_OF, compression="gzip")
    write_csv(rows, packed, derived.AS_OF, append=True)
    assert all(name.name.endswith(".csv.gz") for name in (tmp_path / "jobs_b_1.csv").glob("part-*-c000.csv.gz"))
    assert sorted(read_csv_text(spark, packed).collect()) == sorted(read_csv_text(spark, plain).collect() * 2)
    assert sorted(r.name for r in list_exports(spark, str(tmp_path)).collect()) == ["jobs_a_1.csv", "jobs_b_1.csv"]
