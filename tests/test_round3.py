import random

import pytest
from pyspark.sql import functions as F

from postmill.checks import all_queries, payloads
from postmill.functions import html
from postmill.functions.experience import BADGE_EXPERIENCE
from postmill.sources import api, feed, startup

PIECES = (
    "<div>", "</div>", "<p class='a b'>", "</p>", "<br>", "<br/>", '<a href="/x>y" data-testid=\'t\'>', "</a>", "text", "\n", "&amp;", "&nope;", "&lt;x",
    "<style>a > b</style>", "<script>x<y</script>", "<!-- c -->", "<!doctype html>", "<", "&#65;", "<input disabled>", '<A HREF="q" HREF="z">', "<title>a</title>",
    "<p class=x>", '<b a="1"c="2">', "<template>", "</template>", "<p / >", "</p >", '<style a="b"></STYLE>', "é",
)


def _tokenized(page: str) -> list[list]:
    parser = html._Nodes(html.entity_table())
    parser.feed(page)
    parser.close()
    parser.flush()
    for node in parser.open:
        node["hi"] = len(parser.nodes)
    return [[n.get(name) for name in html.NODE_FIELDS] for n in parser.nodes]


def test_plain_pages_read_as_by_the_tokenizer():
    entities, rnd, plain = html.entity_table(), random.Random(3), 0
    for _ in range(4000):
        page = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 7)))
        found = html.plain_nodes(page, entities)
        plain += found is not None
        assert found is None or found == _tokenized(page), page
    assert plain > 1000


def test_result_pages_are_plain(spark, sf, monkeypatch):
    """Pages of cards need no tokenizer."""
    pages = payloads.cards(spark, sf).limit(30).collect()
    monkeypatch.setattr(html._Nodes, "feed", None)
    entities = html.entity_table()
    assert all(html.plain_nodes(r["html"], entities) for r in pages)


def test_null_empty_and_odd_pages_beside_plain_ones(spark):
    rows = [(0, None), (1, ""), (2, "<p>a</p>"), (3, "<![foo[ x"), (4, "<p class=x>b<i>c")]
    df = spark.createDataFrame(rows, "i int, html string").coalesce(1).select("i", html.html_nodes("html").alias("n"))
    found = {r["i"]: r["n"] for r in df.collect()}
    assert found[0] == found[1] == [] and found[3] is None
    assert [(n["lo"], n["hi"], n["tag"], n["text"]) for n in found[2]] == [(0, 2, "p", None), (1, 2, "", "a")]
    assert [(n["lo"], n["hi"], n["tag"], n["cls"]) for n in found[4]] == [(0, 4, "p", "x"), (1, 2, "", None), (2, 4, "i", None), (3, 4, "", None)]


@pytest.mark.parametrize("rejects, parts", [(feed.feed_rejects, 1), (api.api_rejects, 1)])
def test_rejects_parse_a_payload_once(spark, rejects, parts):
    rows = [(0, None), (1, "x"), (2, "[]"), (3, '["a",{"b":1},null]'), (4, '{"jobDetails":[7,{"a":1}]}')]
    found = rejects(spark.createDataFrame(rows, "page_id int, payload string"))
    assert str(found._jdf.queryExecution().optimizedPlan()).count("from_json(") == parts
    assert (0, None, "payload missing") in [tuple(r) for r in found.collect()]


def test_badge_years_as_by_the_plain_boundary(spark):
    """The boundary is looked for before digits only; hits are those of the rule without that."""
    assert "(?=" in BADGE_EXPERIENCE
    texts = ["a5 years", "é3 yrs", "x 3 - 5 YEARS exp", "12+ years experience", "1to2 yr.", "٣ years", "5 yearsé", "_4 yrs 6 yrs", "", "no years", "2–4 yrs"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = BADGE_EXPERIENCE.replace(r"(?=\d)", "")
    rows = df.select(F.regexp_substr("t", F.lit(BADGE_EXPERIENCE)).alias("a"), F.regexp_substr("t", F.lit(plain)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and any(r["a"] for r in rows)


def test_markdown_lines_end_as_before_and_lose_links_and_marks(spark):
    """All line ends count; the strip before links are taken out is part of the rule."""
    link = "[**Clerk**](https://wellfound.com/jobs/1-a)"
    ends = ["\r\n", *map(chr, (10, 11, 12, 13, 28, 29, 30, 0x85, 0x2028, 0x2029))]
    rows = [(i, None, f"`far`{e}2 *years* exp{e}{link}{e}see [x](http://y.z) _now_{e} plain{e}far") for i, e in enumerate(ends)]
    rows += [(90, None, f"a b{e}{link}") for e in (" ", "-", "#", chr(0x2027), chr(0x202A))]
    found = startup.project_markdown_links(spark.createDataFrame(rows, "page_id int, search_location string, markdown string")).collect()
    assert {r["description"] for r in found if r["page_id"] < 90} == {"far | 2 years exp | see x now | plain"}
    assert len(found) == len(rows) and {r["title"] for r in found} == {"Clerk"}
    assert {r["description"] for r in found if r["page_id"] == 90} == {"Clerk role at Startup (Wellfound)"}


def test_large_rules_run_as_compiled_code(spark, sf):
    """A registered query lets no stage become one method that the JVM doesn't compile."""
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    all_queries()["scan_html_cards"](spark, sf)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
