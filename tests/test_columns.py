"""Input and expected rows of the column transforms, one Spark job per operator."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from postmill.functions import dates, experience, html, job_type, salary, search, text
from postmill.operators import filters

AS_OF = datetime(2026, 11, 20, 12, 0, tzinfo=timezone.utc)
NBSP = chr(0xA0)


def run(spark, cases, make, ddl="v string"):
    """``[(input..., expected)]`` through ``make(columns)``; returns (got, expected) lists."""
    rows = [(i, *case[:-1]) for i, case in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, " + ddl)
    got = {r["i"]: r["out"] for r in df.select("i", make().alias("out")).collect()}
    return [got[i] for i in range(len(cases))], [case[-1] for case in cases]


def check(*args, **kwargs):
    got, expected = run(*args, **kwargs)
    assert got == expected


def test_calendar_dates(spark):
    """Every written form of one day, then its order of day and month, ranges and blanks around it."""
    leap = "2024-02-29"
    check(spark, [
        *[(form, leap) for form in (
            "29 February 2024", "29 Feb 2024", "29-FEB-2024", "Feb 29, 2024", "February 29, 2024", "Feb 29 2024",
            "29/02/2024", "29-02-2024", "02/29/2024", "2024/02/29", "2024-02-29", "29   feb   2024", NBSP + "2024-02-29 ",
        )],
        ("07/08/2025", "2025-08-07"), ("08/31/2025", "2025-08-31"), ("29/02/2025", None), ("30 Feb 2025", None),
        ("07/08/25", None), ("0007/08/2025", None), ("on 7 Aug 2025", None), ("2025-13-01", None),
    ], lambda: dates.parse_date(F.col("v"), AS_OF))


def test_instants_and_weeks(spark):
    check(spark, [
        ("2025-12-31T23:59:59-11:00", "2025-12-31"), ("2025-12-31T00:00:01Z", "2025-12-31"), ("2025-12-31T08:15:00+05:30", "2025-12-31"),
        ("20251231T081500", "2025-12-31"), ("2025-12-31T24:30", None),
        ("2025-W01-1", "2024-12-30"), ("2025-W01", "2024-12-30"), ("2025-W54", None),
        ("1735689600", "2025-01-01"), ("1735689600999", "2025-01-01"),
    ], lambda: dates.parse_date(F.col("v"), AS_OF))


def test_relative_dates(spark):
    """Counted back from noon of 20 November 2026."""
    check(spark, [
        ("yesterday", "2026-11-19"), ("TODAY", "2026-11-20"), ("just NOW", "2026-11-20"), ("few hours ago", "2026-11-20"),
        ("20 days ago", "2026-10-31"), ("Posted 4 days ago", "2026-11-16"), ("Active 2w ago", "2026-11-06"),
        ("4w", "2026-10-23"), ("10+ days ago", "2026-11-10"), ("11 hours ago", "2026-11-20"), ("14 hours ago", "2026-11-19"),
        ("1 month ago", "2026-10-21"), ("2 years ago", "2024-11-20"), ("some days ago", None), ("888888888888 months ago", None),
    ], lambda: dates.parse_date(F.col("v"), AS_OF))


@pytest.mark.parametrize("blank", ["", "\t \n", "NULL", "n/a", "None", "not specified", None])
def test_blank_dates(spark, blank):
    check(spark, [(blank, None)], lambda: dates.parse_date(F.col("v"), AS_OF))


def test_format_date_keeps_unreadable_text(spark):
    check(spark, [("6 days ago", "2026-11-14"), ("when the tide turns", "when the tide turns"), ("", ""), (None, "")],
          lambda: dates.format_date(F.col("v"), AS_OF))


def test_salary_bounds(spark):
    def pair():
        b = salary.salary_bounds(F.col("v"))
        return F.when(b.isNotNull(), F.concat_ws(",", b.lo, b.hi))

    check(spark, [
        ("$80,000 - $120,000", "80000,120000"), ("$80k", "80000,80000"), ("$200k - $300k", "200000,300000"),
        ("₹6,00,000", "600000,600000"), ("6-12 Lacs PA", "600000,1200000"), ("8 LPA", "800000,800000"),
        ("8 - 14 LPA", "800000,1400000"), ("6 lakhs - 12 lakhs", "600000,600000"), ("1 crore - 2 crore", "10000000,10000000"),
        ("Up to $120000", "120000,120000"), ("$80k - $120000", "80000,120000000"), ("50", "5000000,5000000"),
        ("8.2 lpa", "819999,819999"), ("6 to 9 lpa", "600000,900000"), ("Not specified", None), ("negotiable", None),
        ("n/a", None), ("Competitive", None), ("ask us", None), ("", None), (None, None), (f"8{NBSP}LPA", "800000,800000"),
    ], pair)


def test_salary_texts(spark):
    check(spark, [("₹5,00,000 - ₹8,00,000", "5,00,000 - ₹8,00,000"), ("₹5,00,000 per annum", "5,00,000"), ("", "Not specified"),
                  (None, "Not specified"), ("Rs. 5 Lacs P.A.", "5 Lacs"), ("Salary 5", "5")],
          lambda: salary.clean_salary_inr(F.col("v")))
    check(spark, [(80000, 120000, "$80,000 - $120,000"), (80000, 0, "$80,000+"), (None, 9000, "Up to $9,000"), (0, 0, "Not specified")],
          lambda: salary.format_salary_usd(F.col("a"), F.col("b")), ddl="a long, b long")


def test_years_in_the_experience_text(spark):
    """The upper end of a range, a minimum as it stands, whatever the spelling."""
    ranges = [(f"{lo}{dash}{hi} {unit}", "", hi) for lo, hi, dash, unit in (
        (0, 4, "-", "Yrs"), (4, 9, " - ", "years"), (6, 11, " to ", "yrs"), (12, 20, "-", "Years"), (9, 13, "–", "Yrs"))]
    check(spark, ranges + [
        ("4+ years", "", 4), ("12+ yrs", "", 12), ("at least 9", "", 9), ("11", "", 11), ("FRESHER", "", 0), ("20-4 yrs", "", 20),
        ("lead", "9+ years", None), (None, None, None), (None, "", None), ("elm\x01fir 4-6 years of experience", "", 6),
    ], lambda: experience.max_experience(F.col("e"), F.col("d")), ddl="e string, d string")


def test_years_in_the_description(spark):
    check(spark, [
        ("", "The quarry wants 8+ years of experience with granite", 8), ("", "Min 4 years under sail", 4),
        ("", "Minimum of 11 years, no less", 11), ("", "Potters with at least 9 years experience", 9),
        ("", "Freshers may row along", 0), ("", "No experience is needed to peel apples", None), ("", "Bring gloves and a lamp", None),
        (" ", "4 yrs experience", 4), ("", "experience required: 5-9 years", 9), ("", "Exp: 8 yrs", 8),
        ("", "ash\x01yew 6-9 years of experience", 9),
    ], lambda: experience.max_experience(F.col("e"), F.col("d")), ddl="e string, d string")


def test_seniority(spark):
    check(spark, [
        ("Senior Beekeeper", None, True), ("Sr. Tailor", None, True), ("Sr Tailor", None, True),
        ("Harvest Lead", None, True), ("Principal Cellist", None, True), ("Bakery Manager", None, True),
        ("Garden Architect", None, True), ("Museum Director", None, True), ("Head of Pastry", None, True),
        ("Tailor", "senior", True), ("Tailor", "Sr. grade", True), ("Tailor", "0-1 Yrs", False),
        ("Junior Tailor", None, False), ("Beekeeper", None, False), ("Lead-free Glazier", None, True), ("Misleading Ads Checker", None, False), (None, None, False),
    ], lambda: experience.says_senior(F.col("t"), F.col("e")), ddl="t string, e string")


def _deep(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return experience.with_deep_fields(df, "t").orderBy("i").collect()


def test_deep_fields(spark):
    rows = _deep(spark, [
        "Who fits\nA weaver with 0-2 years of experience on hand looms.",
        "1 - 5 years of proven experience with tide tables.",
        "Minimum 3+ years of experience as a ferry pilot.",
        "Experience: 4-9 Yrs",
        "Freshers can apply, we teach knots on board.",
        "An entry-level place in the pottery.",
        "Sea view, long lunches, a quiet dog.",
        "Salary: 4-9 LPA after the first harvest.",
        "CTC: ₹7,00,000 - ₹11,00,000 per annum",
        "", "   \n\t  ", None, "we look for 10 key skills",
    ])
    years = [r["d_experience"]["max_experience"] if r["d_experience"] else None for r in rows]
    assert years == [2, 5, 3, 9, 0, 0, None, None, None, None, None, None, None]
    assert rows[0]["d_experience"]["experience_raw"] == "with 0-2 years of experience on h"
    assert rows[4]["d_experience"]["experience_raw"] == "Fresher"
    pay = [r["d_salary_raw"] for r in rows]
    assert pay[7] == "Salary: 4-9 LPA" and pay[8] == "CTC: ₹7,00,000 - ₹11,00,000 per annum" and pay[9:12] == [None] * 3
    assert tuple(rows[8]["d_bounds"]) == (700000, 1100000)
    # A number before a word starting with k counts as thousands.
    assert pay[12] == "10 k" and tuple(rows[12]["d_bounds"]) == (10000, 10000)


def test_text_fields(spark):
    check(spark, [("\tMaster   Brewer  /  Maltster ", "Master Brewer / Maltster"), (f"x{NBSP}\r\n y", "x y"), (None, "")],
          lambda: text.norm_title(F.col("v")))
    check(spark, [("Harbour Mills 3.7 ★★", "Harbour Mills"), ("Kiln 5 *", "Kiln"), ("Studio 54", "Studio 54"), (None, "")],
          lambda: text.norm_company(F.col("v")))
    check(spark, [("Kiln 3.9", "Kiln"), ("Kiln 77 Ratings", "Kiln"), ("Kiln 2k Followers since May", "Kiln"), ("Studio 54", "Studio")],
          lambda: text.clean_company_ratings(F.col("v")))
    check(spark, [("WFH on Fridays", "Remote"), (" ", ""), ("", "Remote"), (None, "Remote"), ("\tKochi ", "Kochi"), ("telecommute", "Remote")],
          lambda: text.norm_location(F.col("v")))
    check(spark, [("port-au-prince", "Port-Au-Prince"), ("st. john's bay", "St. John'S Bay"), ("KOCHI", "Kochi")],
          lambda: text.title_case(F.col("v")))
    check(spark, [("sailing,contract", "Contract"), ("bakery,part time", "Part-time"), ("pottery,internship", "Internship"), ("glass,kiln", "Full-time")],
          lambda: job_type.job_type_from_tags(F.split("v", ",")))
    check(spark, [("full time", "Full-time"), ("Temporary", "Contract"), ("Seasonal", "Seasonal"), ("", "Full-time"), (None, "Full-time")],
          lambda: job_type.norm_job_type(F.col("v")))


def test_html(spark):
    check(spark, [
        ("<ul><li>Knots<li>Sails &mdash; <em>all</em>sizes</ul>", "Knots Sails — all sizes"),
        ("<div>" + "yo " * 300 + "</div>", ("yo " * 300)[:500] + "..."),
        ("1 &lt 2 &&&gt; &nosuch; &#x41;&#66; &#151; &#0; &#xD800; &#99999999;", "1 < 2 &&> &nosuch AB — � � �"),
        ("q<!-- <i>w</i> -->e<style>p > a {}</style>r <p data-x='1 > 0'>t</p> 4 < 5", "q e r t 4 < 5"),
        ("bare words", "bare words"), ("", ""), (None, ""),
    ], lambda: html.clean_html(F.col("v"), 500))


def test_every_entity_name_is_found(spark):
    names = html.entity_table()
    df = spark.createDataFrame([(f"[&{name};]", f"[{put}]") for name, put in names.items()], "v string, want string")
    wrong = df.select("v", "want", html.decode_entities(F.col("v")).alias("got")).where("got <> want")
    assert wrong.collect() == []


def test_keywords(spark):
    """Position and tags for specific words, the whole text for phrases and general words."""
    post = ("Cheese Maker", ["dairy", "Alpine"], "<p>Turning <b>wheels</b> for a senior analyst</p>")

    def keywords(*words, row=post):
        df = spark.createDataFrame([row], "p string, t array<string>, d string")
        return df.select(filters.match_keywords(F.col("p"), F.col("t"), F.col("d"), words)).first()[0]

    assert keywords()
    assert keywords("cheese") and keywords("ALPINE") and keywords("dairy farm")
    assert keywords("Turning Wheels") and not keywords("turning tables")
    assert keywords("analyst senior") and not keywords("senior architect")
    assert not keywords("wheels of steel") and keywords("wine", "cheese")
    assert not keywords(" ") and not keywords("wine", "bread")
    assert not keywords("cheese", row=(None, None, None))


def test_locations(spark):
    """``(place, tags, description, requested, found)``."""
    cases = [
        ("Oslo, Norway", [], "", [], False), ("Oslo, Norway", [], "", ["NORWAY "], True), ("Oslo, Norway", [], "", ["", "\t"], False),
        ("Oslo, Norway", ["worldwide"], "", [], True), ("Oslo, Norway", ["worldwide"], "Applicants within Germany", [], False),
        ("Chennai", [], "", ["lima"], True), (" ", [], "", ["lima"], True), (None, None, None, [], True),
        ("Anywhere", [], "Our crew sits in the <i>Berlin</i> office", [], False), ("Anywhere", [], "Berlin bears", [], True),
        ("Chennai", ["united", "kingdom only"], "", [], False), ("Chennai", ["kingdom only"], "", [], True),
        ("Chennai", [], "This one is EUROPE only", [], False),
    ]
    df = spark.createDataFrame([(i, p, t, d) for i, (p, t, d, *_) in enumerate(cases)], "i int, l string, t array<string>, d string")
    for i, (*_, wanted, expected) in enumerate(cases):
        got = df.where(F.col("i") == i).select(filters.match_location(F.col("l"), F.col("t"), F.col("d"), wanted)).first()[0]
        assert got is expected, cases[i]


def test_search(spark):
    def parsed():
        s = search.parse_search(F.col("v"))
        return F.concat_ws("|", s.role, F.array_join(s.locations, ","))

    check(spark, [
        ("looking for glass blower openings in chennai", "glass blower|chennai"),
        ("tram driver jobs across Bengaluru, Kochi and delhi", "tram driver|bangalore,kochi,delhi"),
        ("tram driver", "tram driver|"), (None, "|"), ("  ", "|"), ("cook at Kochi or kochi & Gurugram.", "cook|kochi,gurgaon"),
    ], parsed)
    check(spark, [("glass blower", "kochi", "https://www.naukri.com/glass-blower-jobs-in-kochi"),
                  ("cook", "", "https://www.naukri.com/cook-jobs"),
                  ("Tram Driver", "Navi Mumbai", "https://www.naukri.com/tram-driver-jobs-in-navi-mumbai")],
          lambda: search.board_url(F.col("r"), F.col("l")), ddl="r string, l string")
    check(spark, [("glass blower", "kochi", ["https://wellfound.com/role/l/glass-blower/kochi", "https://wellfound.com/role/r/glass-blower"]),
                  ("cook", None, ["https://wellfound.com/role/r/cook"])],
          lambda: search.startup_urls(F.col("r"), F.col("l")), ddl="r string, l string")
    base = "https://www.naukri.com"
    check(spark, [("/a", base + "/a"), ("a", base + "/a"), ("//c.x/a", "https://c.x/a"), ("http://y/z", "http://y/z"), ("#", base), ("?q=1", base + "?q=1")],
          lambda: search.resolve_url(base, F.col("v")))


@pytest.mark.parametrize("threshold", [0.0, 1.5])
def test_fuzzy_threshold_is_checked(spark, threshold):
    from postmill.operators.fuzzy import dedup_fuzzy

    with pytest.raises(ValueError):
        dedup_fuzzy(spark.createDataFrame([], "ord long, title string, company string"), threshold)
