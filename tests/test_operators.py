"""Operators, sources and the flow on small frames."""

import random
from datetime import datetime, timezone
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from postmill.checks import derived
from postmill.operators import dedup, enrich, filters, fuzzy, lineage, matching, summary
from postmill.operators.model import canonicalise, quarantine, valid
from postmill.operators.normalise import export_projection, normalise_postings
from postmill.plans import reports
from postmill.plans.posting_flow import export_flow, posting_flow
from postmill.schema import EXPORT_COLUMNS
from postmill.sources import api, cards, exports, feed, startup
from postmill.sources.details import extract_body_text
from postmill.sources.registry import SourceRegistry, default_registry

AS_OF = datetime(2026, 11, 20, tzinfo=timezone.utc)
RAW = "ord long, title string, company string, url string, source string"


def posts(spark, rows, ddl=RAW):
    return spark.createDataFrame(rows, ddl)


def canon(spark, rows, ddl=RAW):
    return canonicalise(posts(spark, rows, ddl), AS_OF)


def test_model_rules(spark):
    ddl = RAW + ", salary_min string, salary_max string, salary_raw string, job_type string, posted_date string, max_experience_required int"
    rows = [
        (0, " Eng ", "A", "https://a.com/1", " NAUKRI ", "180000", "120000", None, "FULL TIME", "2 days ago", None),
        (1, "Eng", "A", "https://a.com/2", "x", None, None, "8 - 14 LPA", "", "soon", None),
        (2, "Eng", "A", " ", "x", None, None, None, None, None, None),
        (3, "t" * 513, "A", "u", "x", None, None, None, None, None, None),
        (4, "Eng", "", "u", "x", None, None, None, None, None, None),
        (5, "Eng", "A", "u", "x", "bad", "-4", None, None, None, -1),
    ]
    df = canon(spark, rows, ddl)
    good = {r["ord"]: r for r in valid(df).collect()}
    assert sorted(good) == [0, 1]
    assert (good[0]["salary_min"], good[0]["salary_max"], good[0]["source"], good[0]["title"]) == (120000, 180000, "naukri", "Eng")
    assert good[0]["posted_date"] == "2026-11-18" and good[1]["posted_date"] is None
    assert (good[1]["salary_min"], good[1]["salary_max"], good[1]["salary"]) == (800000, 1400000, "8 - 14 LPA")
    assert good[0]["location"] == "Remote" and good[1]["job_type"] == "Full-time"
    reasons = {r["ord"]: r["reject_reason"] for r in quarantine(df).collect()}
    assert reasons == {2: "url missing", 3: "title too long", 4: "company missing", 5: "experience negative"}


def test_id_ignores_case_and_trailing_slash(spark):
    rows = [(0, "Eng", "A", "https://a.com/J1", "naukri"), (1, "X", "B", "https://a.com/j1/", "remoteok"),
            (2, "Dev", "C", "#", "x"), (3, "DEV", "c", "#", "y")]
    ids = [r["job_id"] for r in canon(spark, rows).orderBy("ord").collect()]
    assert ids[0] == ids[1] and ids[2] == ids[3] != ids[0] and all(len(i) == 16 for i in ids)


def test_first_wins_whatever_the_partitioning(spark):
    rows = [(i, f"T{i % 7}", "A", f"https://a.com/{i % 5}", "s") for i in range(60)]
    df = canon(spark, rows)
    for operator, expected in ((dedup.dedup_exact, [0, 1, 2, 3, 4]), (dedup.dedup_exact_raw, [0, 1, 2, 3, 4]),
                               (dedup.dedup_natural_key, list(range(7))), (lambda d: dedup.cap_per_source(d, 4), [0, 1, 2, 3])):
        for parts in (1, 7):
            shuffled = df.orderBy(F.rand(parts)).repartition(parts)
            assert sorted(r["ord"] for r in operator(shuffled).collect()) == expected


def test_hot_key_is_cut_before_the_shuffle(spark):
    plan = dedup.dedup_exact(canon(spark, [(0, "T", "A", "u", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange hashpartitioning")[1]


def test_merge_sources_keeps_order(spark):
    a = posts(spark, [(0, "A0", "c", "https://x/1", "naukri"), (1, "A1", "c", "https://x/2", "naukri")])
    b = posts(spark, [(0, "B0", "c", "https://x/1/", "remoteok")])
    assert dedup.merge_sources([a, b]).count() == 3
    kept = dedup.dedup_exact_raw(dedup.merge_sources([a, b])).collect()
    assert sorted(r["title"] for r in kept) == ["A0", "A1"]


def test_strict_filter(spark):
    ddl = "ord long, title string, experience_raw string, max_experience_required long"
    rows = [(0, "Trainee Analyst", None, 0), (1, "Map Editor", None, 1), (2, "Game Tester", None, None),
            (3, "Senior Botanist", None, 0), (4, "Map Editor", "senior", None), (5, "Kitchen Lead", None, None),
            (6, "Sr. Glass Blower", None, None), (7, "Map Editor", None, 3), (8, "Rust Hacker", None, 2),
            (9, "Payroll Clerk", "0-3 Yrs", 3), (10, "Survey Clerk", "0-6 Yrs", 6)]
    df = posts(spark, rows, ddl)
    assert sorted(r["ord"] for r in filters.strict_filter(df).collect()) == [0, 1, 2]
    counts = {r["outcome"]: r["n_rows"] for r in summary.filter_summary(df).collect()}
    assert counts == {"kept": 3, "senior": 4, "experience": 4}


PAGE_TEXT = (
    "The workshop\nOur bindery repairs maps and atlases for libraries across the region.\n\nYou bring\n"
    "- Steady hands and a liking for old paper.\n- 0-1 years of experience required.\n"
)


def test_enrichment(spark):
    ddl = RAW + ", description string, salary string, salary_raw string"
    rows = [(0, "F", "A", "https://a.com/1", "Board", "Short", None, None), (1, "B", "A", "https://a.com/2", "board", "keep", None, None),
            (2, "C", "A", "https://a.com/1", "unknown", "keep", None, None), (3, "D", "A", "#", "board", "keep", None, None),
            (4, "E", "A", "https://a.com/3", "board", "x", "Not specified", None)]
    details = posts(spark, [("board", "https://a.com/1", PAGE_TEXT), ("board", "https://a.com/1", PAGE_TEXT), ("board", "https://a.com/2", "too short"),
                            ("board", "#", PAGE_TEXT), ("board", "https://a.com/3", PAGE_TEXT + " Salary: 6-12 LPA")],
                    "source string, url string, text string")
    out = {r["ord"]: r for r in enrich.enrich_details(valid(canon(spark, rows, ddl)), details, ["board"]).collect()}
    assert len(out) == 5
    assert out[0]["description"] == PAGE_TEXT.strip() and out[0]["max_experience_required"] == 1
    assert out[0]["experience_raw"] == "r.\n- 0-1 years of experience requ"
    assert [out[i]["description"] for i in (1, 2, 3)] == ["keep"] * 3
    # A sentinel text blocks the salary text but not the bounds.
    assert (out[4]["salary"], out[4]["salary_raw"], out[4]["salary_min"], out[4]["salary_max"]) == ("Not specified", "Not specified", 600000, 1200000)


def _greedy(rows, threshold):
    kept = []
    for o, title, company in sorted(rows):
        sig = f"{title} {company}".lower()
        if not any(SequenceMatcher(None, sig, other).ratio() >= threshold for _, other in kept):
            kept.append((o, sig))
    return [o for o, _ in kept]


@pytest.mark.parametrize(("threshold", "block"), [(0.85, 32), (0.6, 256)])
def test_fuzzy_dedup_equals_the_sequential_rule(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(fuzzy, "FIRST_BLOCK", block)
    rnd = random.Random(11)
    words = "data senior python engineer dev ops analyst bolt ring lead ml ai qa web cloud".split()
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))), rnd.choice(["Acme", "Globex Ltd", "Ac"])) for i in range(150)]
    rows += [(150 + i, rows[i][1].replace("e", "x", 1), rows[i][2]) for i in range(30)]
    df = posts(spark, rows, "ord long, title string, company string").repartition(3)
    wanted = _greedy(rows, threshold)
    assert sorted(r["ord"] for r in fuzzy.dedup_fuzzy(df, threshold).select("ord").collect()) == wanted
    if block == 32:
        assert summary.fuzzy_summary(df, threshold).first().asDict() == {"n_unique": len(wanted), "n_duplicates": len(rows) - len(wanted)}


def test_common_subsequence_bounds_similarity():
    """The filter in front of difflib never is below what difflib matches."""
    rnd = random.Random(31)
    for _ in range(2000):
        a, b = ("".join(rnd.choice("abcd é") for _ in range(rnd.randrange(0, 90))) for _ in range(2))
        matched = sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
        assert matched <= fuzzy.common(fuzzy._masks(b), len(b), a) <= min(len(a), len(b))


def test_rows_sharing_a_position_are_judged_by_their_own_text(spark):
    rows = [(0, 0, 0, "welder night shift", "Brook"), (0, 0, 1, "welder night shifts", "Brook"), (0, 1, 1, "tax clerk", "Orchard"),
            (0, 1, 0, "florist", "Moss"), (0, 1, 0, "florists", "Moss")]
    df = posts(spark, rows, "source_rank int, page_id long, ord long, title string, company string")
    for parts in (1, 5):
        shuffled = df.orderBy(F.rand(parts)).repartition(parts)
        got = sorted(r["title"] for r in fuzzy.dedup_fuzzy(shuffled).collect())
        assert got == ["florist", "tax clerk", "welder night shift"]
        assert fuzzy.dedup_fuzzy(shuffled, 1.0).count() == 5


def test_first_wins_over_pages_and_ties(spark):
    rows = [(1, 0, "second page"), (0, 1, "first page, later"), (0, 0, "tie b"), (0, 0, "tie a")]
    df = posts(spark, [(p, o, t, "C", "https://x/1", "s") for p, o, t in rows], "page_id long, ord long, title string, company string, url string, source string")
    picked = {dedup.dedup_exact_raw(df.orderBy(F.rand(i)).repartition(i)).first()["title"] for i in (1, 2, 3, 4)}
    assert len(picked) == 1 and picked <= {"tie a", "tie b"}
    assert sorted(r["page_id"] for r in dedup.cap_per_source(df, 3).collect()) == [0, 0, 0]


def test_payload_rejects(spark):
    ddl = "page_id long, payload string"
    rows = posts(spark, [(0, '[{"position":"a"},5,null]'), (1, "not json"), (2, None), (3, "[]"), (4, '{"error":1}')], ddl)
    got = sorted((r["page_id"], r["ord"] if r["ord"] is not None else -1, r["reject_reason"]) for r in feed.feed_rejects(rows).collect())
    assert got == [(0, 1, "element is no object"), (0, 2, "element is no object"), (1, -1, "no list of elements"),
                   (2, -1, "payload missing"), (4, -1, "no list of elements")]
    rows = posts(spark, [(0, '{"jobDetails":["x",{"title":"a"}]}'), (1, '{"other":1}'), (2, '{"jobDetails":3}')], ddl)
    got = sorted((r["page_id"], r["reject_reason"]) for r in api.api_rejects(rows).collect())
    assert got == [(0, "element is no object"), (1, "no list of elements"), (2, "no list of elements")]
    assert feed.feed_rejects(rows.limit(0)).count() == 0


def test_saved_searches_equal_the_single_search(spark, sf):
    rows = derived.postings(spark, sf)
    asked = [(1, "widget developer", ["pune"]), (2, "developer", []), (3, "python", ["san francisco"]), (4, "", ["pune"])]
    searches = posts(spark, asked, "search_id long, role string, locations array<string>")
    hits = matching.match_searches(rows.select("k", "title", "tags", "description", "location"), searches)
    got = {r["search_id"]: r["n"] for r in hits.groupBy("search_id").agg(F.count("*").alias("n")).collect()}
    items = rows.withColumnRenamed("title", "position")
    assert got == {i: filters.filter_feed(items, [role], places).count() for i, role, places in asked[:3]}


def test_feed(spark):
    item = ('{"id":1,"position":"Python Developer","company":"Test","tags":["python","remote"],"description":"<p>Test</p>","location":"",'
            '"apply_url":"https://r/x","salary_min":80000,"salary_max":120000,"date":"2026-09-22T14:36:54+00:00","url":""}')
    payloads = posts(spark, [(0, f'[{{"legal":"x"}},{item}]'), (1, '[{"legal":"x","position":"kept"}]'), (2, "broken"), (3, f'["s",null,{item}]')],
                     "page_id long, payload string")
    scanned = {(r["page_id"], r["ord"]): r["position"] for r in feed.scan_feed_json(payloads).collect()}
    assert scanned == {(0, 1): "Python Developer", (1, 0): "kept", (3, 2): "Python Developer"}
    job = valid(canonicalise(feed.feed_postings(payloads.where("page_id = 0"), AS_OF, ["python"], ["remote"]), AS_OF)).first()
    assert (job["title"], job["location"], job["url"], job["source"]) == ("Python Developer", "Remote", "https://r/x", "remoteok")
    assert (job["salary"], job["salary_min"], job["salary_max"], job["posted_date"]) == ("$80,000 - $120,000", 80000, 120000, "2026-09-22")


def test_api(spark):
    payload = ('{"jobDetails":[{"title":"Python Developer","companyName":"Acme","placeholders":[{"type":"location","value":"Pune"},'
               '{"type":"salary","value":"₹8-12 Lacs P.A."}],"jobDescription":"Build APIs.","jdURL":"/python-developer-123","createdDate":"2026-09-24"},'
               '"x",{"title":"ML Intern","placeholders":[{"type":"location","label":""},{"type":"location","label":"Goa"}],"jobId":7}]}')
    rows = api.api_postings(posts(spark, [(0, payload), (1, '{"jobDetails":3}'), (2, "no")], "page_id long, payload string"), AS_OF, "new-delhi").orderBy("ord").collect()
    assert len(rows) == 2
    first, second = rows
    assert (first["title"], first["company"], first["location"], first["source"]) == ("Python Developer", "Acme", "Pune", "naukri")
    assert (first["salary"], first["url"]) == ("8-12 Lacs", "https://www.naukri.com/python-developer-123")
    assert (second["location"], second["job_type"], second["url"]) == ("New-Delhi", "Internship", "https://www.naukri.com/job-listings-7")


def test_cards(spark):
    html = ('<div class="srp-jobtuple-wrapper"><a class="title" href="/job-details/python-dev-123">Python Developer</a>'
            '<a class="comp-name">Acme Corp</a><span class="loc-wrap">Bangalore</span><span class="exp-wrap">2-4 years</span>'
            '<span class="sal-wrap">₹5,00,000 - ₹8,00,000</span><span class="job-post-day">2 days ago</span></div>')
    pages = posts(spark, [(0, html), (1, "<p>none</p>"), (2, None)], "page_id long, html string")
    for rendered, project in ((False, cards.project_card), (True, cards.project_card_rendered)):
        job = project(cards.scan_html_cards(pages, rendered), AS_OF).collect()
        assert len(job) == 1
        assert (job[0]["title"], job[0]["company"], job[0]["location"]) == ("Python Developer", "Acme Corp", "Bangalore")
        assert (job[0]["salary"], job[0]["experience_raw"], job[0]["posted_date"]) == ("5,00,000 - ₹8,00,000", "2-4 years", "2026-11-18")
        assert job[0]["url"] == "https://www.naukri.com/job-details/python-dev-123"


def test_startup_pages(spark):
    html = ('<article data-testid="job-card"><a href="/jobs/product-manager-123"><h2>Product Manager</h2></a><h4>Acme Labs</h4>'
            "<p>Bangalore, India · ₹12,00,000 - ₹18,00,000</p></article>")
    job = startup.project_startup_card(posts(spark, [(html, "bangalore")], "html string, search_location string")).first()
    assert (job["title"], job["company"], job["url"]) == ("Product Manager", "Acme Labs", "https://wellfound.com/jobs/product-manager-123")
    assert job["salary"] == "₹12,00,000 - ₹18,00,000" and job["location"] == "Bangalore"
    assert job["description"] == "Bangalore, India · ₹12,00,000 - ₹18,00,000"

    md = ("## [Data Engineer](https://wellfound.com/jobs/data-engineer-123)\n[Acme Labs](https://wellfound.com/company/acme-labs)\n")
    rows = [(0, md, "hyderabad"), (1, "[AI Engineer](https://wellfound.com/jobs/ai-engineer-123)", "remote"), (2, md + "Verify you are human", "pune"), (3, "", None)]
    got = {r["page"]: r for r in startup.project_markdown_links(posts(spark, rows, "page long, markdown string, search_location string")).collect()}
    assert sorted(got) == [0, 1]
    assert (got[0]["company"], got[0]["location"], got[0]["description"]) == ("Acme Labs", "Hyderabad", "Data Engineer role at Acme Labs")
    assert (got[1]["company"], got[1]["location"]) == ("Startup (Wellfound)", "Remote")
    blocked = posts(spark, [("x", "<body>Verify you are human</body>"), ("y", "<p>ok</p>")], "markdown string, html string")
    assert [r["markdown"] for r in filters.drop_blocked_pages(blocked, "markdown", "html").collect()] == ["y"]


def test_body_text_waterfall(spark):
    body = "word " * 30
    html = f"<body><nav>menu</nav><div class='job-desc'>short</div><main><p>{body}<div class='apply-now'>Apply</div><p>end &amp; more</main><footer>f</footer></body>"
    pages = posts(spark, [(html,)], "html string")
    expected = f"{body.strip()}\nend & more"
    assert extract_body_text(pages, "naukri").first()["text"] == expected
    assert extract_body_text(pages, "wellfound").first()["text"] == f"{body.strip()}\nApply\nend & more"


def test_csv_round_trip(spark, tmp_path):
    rows = [('Software Engineer, "Full" Stack', "Acme, Inc.", "https://e.com/1", "test", " line one\nline two \\ x"), ("T2", "B", "https://e.com/2", "test", "")]
    df = posts(spark, rows, "title string, company string, url string, source string, description string")
    path = exports.write_csv(df, str(tmp_path / "out.csv"), AS_OF)
    back = exports.read_csv_text(spark, path).orderBy("url").collect()
    assert tuple(back[0].asDict()) == EXPORT_COLUMNS
    assert (back[0]["title"], back[0]["company"], back[0]["description"]) == rows[0][:2] + rows[0][4:]
    assert back[0]["scraped_at"] == AS_OF.isoformat() and back[1]["description"] == ""
    part = next((tmp_path / "out.csv").glob("part-*.csv")).read_text().splitlines()
    assert part[0] == ",".join(EXPORT_COLUMNS)
    with pytest.raises(Exception):
        exports.write_csv(df, path, AS_OF)
    exports.write_csv(df, path, AS_OF, append=True)
    assert exports.read_csv_glob(spark, str(tmp_path / "*.csv")).count() == 4
    assert exports.write_csv(df.limit(0), path, AS_OF, append=True) == "" and exports.read_csv_text(spark, path).count() == 4
    assert not list((tmp_path / "out.csv").glob("_adding*"))
    assert exports.write_csv(df.where("url = 'none'"), str(tmp_path / "none.csv"), AS_OF) == ""
    assert exports.write_csv(df.limit(0), str(tmp_path / "none.csv"), AS_OF) == "" and not (tmp_path / "none.csv").exists()
    assert exports.read_csv_typed(spark, str(tmp_path / "none.csv")).columns == list(EXPORT_COLUMNS)
    assert exports.read_csv_typed(spark, path, infer=True).count() == 4
    assert [r["name"] for r in exports.list_exports(spark, str(tmp_path)).collect()] == ["out.csv"]
    assert exports.run_path("/d/", AS_OF, "product manager", "Bangalore") == "/d/jobs_product-manager_bangalore_20261120_000000"
    assert exports.run_path("/d", AS_OF) == "/d/jobs_all_20261120_000000"


def test_sql_reports(spark):
    df = spark.createDataFrame([tuple(["t", "c"] + ["x"] * 9 + [str(i)]) for i in range(3)], ", ".join(f"{c} string" for c in EXPORT_COLUMNS))
    assert [r["scraped_at"] for r in reports.analysis_query(df).collect()] == ["2", "1", "0"]
    assert reports.adhoc_sql(df).columns == list(EXPORT_COLUMNS)
    assert reports.adhoc_sql(df, "SELECT count(*) AS n FROM {table}").first()["n"] == 3


def test_export_projection(spark):
    df = normalise_postings(valid(canon(spark, [(0, " A  b ", "Acme 4.3 ★★★", "https://a.com/1", "naukri")])))
    row = export_projection(df).first()
    assert tuple(row.asDict()) == EXPORT_COLUMNS and row["title"] == "A b" and row["company"] == "Acme" and row["max_experience_required"] == ""
    meta = export_projection(df, include_metadata=True)
    assert meta.columns == [*EXPORT_COLUMNS, "salary_min", "salary_max", "tags", "job_id", "company_logo"]


def test_flow_options_and_plan(spark, sf):
    raw, details = derived.raw_postings(spark, sf), derived.details(spark, sf)
    everything = posting_flow(raw, details, derived.AS_OF)
    assert everything.where("max_experience_required > 1").count() > 0
    assert posting_flow(raw, details, derived.AS_OF, refilter=True).where("max_experience_required > 1").count() == 0
    assert posting_flow(raw, details, derived.AS_OF, cap=5).count() <= 15
    plan = export_flow(raw, details, derived.AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_registry(spark):
    registry = SourceRegistry()
    registry.register(" Board ", lambda payloads, tag: payloads.withColumn("tag", F.lit(tag)))
    assert registry.names() == ["board"]
    assert registry.postings("BOARD", spark.range(1), tag="x").first()["tag"] == "x"
    assert default_registry().names()[:3] == ["naukri", "remoteok", "wellfound"]
    with pytest.raises(ValueError):
        registry.register(" ", lambda p: p)


def test_long_pages_of_cards(spark):
    """Thousands of cards on a page, each with its own fields; links outside of cards belong to none."""
    card = '<div class="jobTuple"><h2><a href="/d/{i}"> T{i} </a></h2><div class="row2"><span><a>C{i}</a></span></div><i>x<b>y</b></i></div><a href="/no">no</a>'
    page = "<html><body><p>first</p>" + "".join(card.format(i=i) for i in range(3000)) + "</body></html>"
    rows = cards.card_postings(spark.createDataFrame([(0, page)], "page_id int, html string"), AS_OF).select("ord", "title", "company", "url").collect()
    assert sorted(map(tuple, rows)) == [(i, f"T{i}", f"C{i}", f"https://www.naukri.com/d/{i}") for i in range(3000)]


def test_unreadable_pages_do_not_end_the_job(spark):
    from postmill.functions.html import html_nodes

    pages = [(0, "<p>fine</p>"), (1, "<![foo[ x"), (2, "<p>&#" + "9" * 5000 + "; end</p>")]
    rows = spark.createDataFrame(pages, "i int, html string").select("i", html_nodes("html").alias("n")).collect()
    found = {r["i"]: r["n"] for r in rows}
    assert found[0] and found[1] is None and found[2]


def test_pages_are_filtered_before_they_are_shuffled(spark, tmp_path):
    ddl = RAW + ", description string, salary string, salary_raw string"
    left = valid(canon(spark, [(0, "F", "A", "https://a.com/1", "board", "Short", None, None)], ddl))
    posts(spark, [("board", f"https://a.com/{i}", PAGE_TEXT) for i in range(5)], "source string, url string, text string").write.parquet(str(tmp_path / "d"))
    out = enrich.enrich_details(left, spark.read.parquet(str(tmp_path / "d")), ["board"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("LeftSemi")  # below the choice of one text per url
    assert out.count() == 1


def test_fuzzy_dedup_leaves_no_passing_steps(spark, tmp_path, monkeypatch):
    """After a run one table of kept rows for each block is there, and the result still reads."""
    resolved = []
    inner = fuzzy._resolve
    monkeypatch.setattr(fuzzy, "_resolve", lambda block, pairs: resolved.append(1) or inner(block, pairs))
    monkeypatch.setattr(fuzzy, "FIRST_BLOCK", 8)
    monkeypatch.setattr(lineage, "shared_folder", lambda _: str(tmp_path))
    rows = [(i, f"{i * 7919} clerk {i * i}", "Moss") for i in range(40)] + [(40, "0 clerk 0.", "Moss")]
    found = fuzzy.dedup_fuzzy(posts(spark, rows, "ord long, title string, company string"), 0.9)
    assert len(resolved) > 1
    assert len(list(tmp_path.iterdir())) == len(resolved)
    assert sorted(r["ord"] for r in found.collect()) == _greedy(rows, 0.9)


def test_a_local_session_without_a_folder_gets_one(spark):
    class Session:
        sparkContext = spark.sparkContext

        class conf:
            get = staticmethod(lambda name, default=None: default)

    assert lineage.shared_folder(Session) == lineage.shared_folder(Session)
