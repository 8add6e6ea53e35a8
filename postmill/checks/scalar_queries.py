"""Queries for the column transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.checks import derived, duck
from postmill.checks.catalog import query
from postmill.functions import dates, experience, job_type, salary, search, text
from postmill.operators.model import canonicalise, fingerprint, valid
from postmill.operators.normalise import normalise_postings

BASE = duck.stages("base")
CANON = duck.stages("canon")
KEY = ("k",)


def _select(spark, sf, **columns):
    return derived.postings(spark, sf).select("k", *[c.alias(n) for n, c in columns.items()])


def _scalar(name: str, oracle: str, **columns):
    """Register ``SELECT k, ...`` over the derived postings."""
    query(name, f"{BASE} SELECT k, {oracle} FROM base")(lambda spark, sf: _select(spark, sf, **{n: f() for n, f in columns.items()}))


@query("salary_bounds", f"WITH base AS ({derived.postings_sql(derived.DUCK)}), {duck.bounds_cte('b', 'base', 'salary_raw')} SELECT k, lo, hi FROM b")
def salary_bounds(spark, sf):
    rows = _select(spark, sf, b=salary.salary_bounds(F.col("salary_raw")))
    return rows.select("k", F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))


@query(
    "salary_sync",
    f"{BASE} SELECT k, {duck.first('given', 'salary_raw')} AS salary, {duck.first('salary_raw', 'given')} AS salary_raw FROM (SELECT *, CASE WHEN k % 4 = 0 THEN 'given' WHEN k % 4 = 1 THEN '' END AS given FROM base) q",
)
def salary_sync(spark, sf):
    k = F.col("k")
    given = F.when(k % 4 == 0, "given").when(k % 4 == 1, "")
    a, b = salary.salary_sync(given, F.col("salary_raw"))
    return _select(spark, sf, salary=a, salary_raw=b)


_scalar("salary_coerce", f"{duck.coerce('salary_min')} AS lo, {duck.coerce('salary_max')} AS hi",
        lo=lambda: salary.salary_coerce(F.col("salary_min")), hi=lambda: salary.salary_coerce(F.col("salary_max")))

_A, _B = "CAST(k % 17 AS BIGINT)", "CASE WHEN k % 5 > 0 THEN CAST(k % 13 AS BIGINT) END"
_a, _b = lambda: (F.col("k") % 17).cast("bigint"), lambda: F.when(F.col("k") % 5 > 0, (F.col("k") % 13).cast("bigint"))
_scalar("salary_swap", f"CASE WHEN {_A} > {_B} THEN {_B} ELSE {_A} END AS lo, CASE WHEN {_A} > {_B} THEN {_A} ELSE {_B} END AS hi",
        lo=lambda: salary.salary_ordered(_a(), _b())[0], hi=lambda: salary.salary_ordered(_a(), _b())[1])


@query("salary_derive", f"{CANON} SELECT k, salary_min, salary_max FROM canon")
def salary_derive(spark, sf):
    settled = salary.salary_settled(F.col("salary_min"), F.col("salary_max"), F.col("salary_raw"))
    return _select(spark, sf, b=settled).select("k", F.col("b.lo").alias("salary_min"), F.col("b.hi").alias("salary_max"))


@query(
    "salary_refill",
    f"{CANON}, {duck.bounds_cte('b', 'canon', 'salary_raw')} SELECT k, CASE WHEN coalesce(salary_raw, '') <> '' THEN coalesce(salary_min, lo) ELSE salary_min END AS lo, CASE WHEN coalesce(salary_raw, '') <> '' THEN coalesce(salary_max, hi) ELSE salary_max END AS hi FROM b",
)
def salary_refill(spark, sf):
    rows = canonicalise(derived.raw_postings(spark, sf), derived.AS_OF)
    filled = salary.salary_refilled(F.col("salary_min"), F.col("salary_max"), F.col("salary_raw"))
    return rows.select("k", filled.alias("b")).select("k", F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))


_USD_LO, _USD_HI = "CASE WHEN k % 3 > 0 THEN k * 37 END", "CASE WHEN k % 5 > 1 THEN k * 53 ELSE 0 END"
_scalar("format_salary_usd", f"{duck.usd(f'({_USD_LO})', f'({_USD_HI})')} AS salary",
        salary=lambda: salary.format_salary_usd(F.when(F.col("k") % 3 > 0, F.col("k") * 37), F.when(F.col("k") % 5 > 1, F.col("k") * 53).otherwise(0)))
_scalar("clean_salary_inr", f"{duck.inr('salary_raw')} AS salary", salary=lambda: salary.clean_salary_inr(F.col("salary_raw")))
_scalar("parse_date", f"{duck.date('posted_raw')} AS posted_date", posted_date=lambda: dates.parse_date(F.col("posted_raw"), derived.AS_OF))
_scalar("format_date", f"coalesce({duck.date('posted_raw')}, posted_raw, '') AS posted_date",
        posted_date=lambda: dates.format_date(F.col("posted_raw"), derived.AS_OF))
_scalar("max_experience", f"{duck.max_experience('experience_raw', 'description')} AS years",
        years=lambda: experience.max_experience(F.col("experience_raw"), F.col("description")))

_DEEP = f"WITH pages_raw AS ({derived.details_sql(derived.DUCK, gaps=False)}), {duck.deep_ctes('deep', 'pages_raw', 'text')}"


@query("deep_experience", f"{_DEEP} SELECT k, x_exp AS experience_raw, CAST(x_max AS BIGINT) AS years FROM deep")
def deep_experience(spark, sf):
    found = experience.with_deep_fields(derived.details(spark, sf, gaps=False), "text")
    return found.select("k", F.col("d_experience.experience_raw").alias("experience_raw"), F.col("d_experience.max_experience").alias("years"))


@query("deep_salary", f"{_DEEP} SELECT k, x_sal AS salary_raw, nullif(lo, 0) AS salary_min, nullif(hi, 0) AS salary_max FROM deep")
def deep_salary(spark, sf):
    found = experience.with_deep_fields(derived.details(spark, sf, gaps=False), "text")
    lo, hi = (F.nullif(F.col(f"d_bounds.{c}"), F.lit(0)) for c in ("lo", "hi"))
    return found.select("k", F.col("d_salary_raw").alias("salary_raw"), lo.alias("salary_min"), hi.alias("salary_max"))


_scalar("norm_title", f"{duck.collapse('title')} AS title", title=lambda: text.norm_title(F.col("title")))
_scalar("norm_company", f"{duck.company('company')} AS company", company=lambda: text.norm_company(F.col("company")))
_FOLLOWED = "'Acme ' || k || 'k+ Followers on site'"
_NUMBERED = "'Forever ' || k"
_scalar("clean_company_ratings",
        f"{duck.company_ratings('company')} AS company, {duck.company_ratings(_FOLLOWED)} AS followed, {duck.company_ratings(_NUMBERED)} AS numbered",
        company=lambda: text.clean_company_ratings(F.col("company")),
        followed=lambda: text.clean_company_ratings(F.concat(F.lit("Acme "), F.col("k").cast("string"), F.lit("k+ Followers on site"))),
        numbered=lambda: text.clean_company_ratings(F.concat(F.lit("Forever "), F.col("k").cast("string"))))
_scalar("norm_location", f"{duck.location('location')} AS location", location=lambda: text.norm_location(F.col("location")))


@query("norm_description", f"SELECT doc_id, {duck.collapse('text')} AS description FROM documents")
def norm_description(spark, sf):
    return derived.tables(spark, sf, "documents")["documents"].select("doc_id", text.norm_description(F.col("text")).alias("description"))


_scalar("norm_job_type", f"{duck.job_type('job_type', True)} AS normalised, {duck.job_type('job_type', False)} AS modelled",
        normalised=lambda: job_type.norm_job_type(F.col("job_type")), modelled=lambda: job_type.model_job_type(F.col("job_type")))
FROM_TAGS = (
    f"CASE WHEN list_has_any({duck.LOWER_TAGS}, ['contract', 'freelance']) THEN 'Contract'"
    f" WHEN list_has_any({duck.LOWER_TAGS}, ['part time', 'part-time']) THEN 'Part-time'"
    f" WHEN list_has_any({duck.LOWER_TAGS}, ['internship', 'junior']) THEN 'Internship' ELSE 'Full-time' END"
)
_scalar("job_type_from_tags", f"{FROM_TAGS} AS job_type", job_type=lambda: job_type.job_type_from_tags(F.col("tags")))
_scalar("job_type_intern",
        "CASE WHEN contains(lower(title || ' ' || description), 'intern') THEN 'Internship' ELSE 'Full-time' END AS by_text, CASE WHEN contains(lower(title), 'intern') THEN 'Internship' ELSE 'Full-time' END AS by_title",
        by_text=lambda: job_type.job_type_intern(F.col("title"), F.col("description")), by_title=lambda: job_type.job_type_intern(F.col("title")))
_scalar("norm_tags", f"array_to_string({duck.NORM_TAGS}, ', ') AS tags", tags=lambda: F.array_join(text.norm_tags(F.col("tags")), ", "))
_scalar("norm_strings", f"{duck.strip('title')} AS title, lower({duck.strip('source')}) AS source, nullif({duck.strip('url')}, '') AS url",
        title=lambda: text.strip(F.col("title")), source=lambda: F.lower(text.strip(F.col("source"))), url=lambda: text.blank_null(text.strip(F.col("url"))))
_scalar("fingerprint", f"{duck.fingerprint('url', 'title', 'company')} AS job_id", job_id=lambda: fingerprint(F.col("url"), F.col("title"), F.col("company")))
_scalar("slugify", f"{duck.slug('title')} AS dashed, {duck.slug_loose('title')} AS loose", dashed=lambda: search.slugify(F.col("title")), loose=lambda: search.slugify_loose(F.col("title")))
_scalar("alias_location", f"{duck.alias('place')} AS place, {duck.slug(duck.alias('place'))} AS slug FROM (SELECT k, CASE k % 4 WHEN 0 THEN ' Bengaluru ' WHEN 1 THEN 'GURUGRAM' ELSE location END AS place FROM base) base -- ",
        place=lambda: search.alias_location(_place()), slug=lambda: search.location_slug(_place()))


def _place():
    k = F.col("k")
    return F.when(k % 4 == 0, " Bengaluru ").when(k % 4 == 1, "GURUGRAM").otherwise(F.col("location"))


_TAG_HIT = r"regexp_matches(t, '(?i)\b(\d+[\s\-\+to]*\d*\s*(?:yrs?|years?))\b') OR lower(t) IN ('junior', 'entry level', 'entry-level', 'intern', 'internship', 'senior', 'lead', 'staff', 'principal')"
EXP_FROM_TAGS = f"list_filter(list_transform({duck.TAGS}, lambda t: trim(t)), lambda t: {_TAG_HIT})[1]"
_scalar("experience_from_tags", f"{EXP_FROM_TAGS} AS experience_raw", experience_raw=lambda: experience.experience_from_tags(F.col("tags")))

_CARD = "'Role · ' || coalesce(salary_raw, '') || ' ' || coalesce(experience_raw, '') || ' exp'"
BADGE_PAY = r"coalesce(nullif(regexp_extract({x}, '([₹$€£][\d,]+(?:\s*[-–to]+\s*[₹$€£]?[\d,]+)?)', 1), ''), 'Not specified')"
BADGE_YEARS = r"nullif(regexp_extract({x}, '(?i)\b(\d+\s*[-–to]+\s*\d+\s*(?:yrs?|years?)|(?:\d+\+?\s*(?:yrs?|years?)\s*(?:exp|experience)?))\b', 1), '')"


def _card():
    none = F.lit("")
    return F.concat(F.lit("Role · "), F.coalesce("salary_raw", none), F.lit(" "), F.coalesce("experience_raw", none), F.lit(" exp"))


_scalar("badge_fields", f"{BADGE_PAY.format(x=_CARD)} AS salary, {duck.strip(BADGE_YEARS.format(x=_CARD))} AS experience_raw",
        salary=lambda: salary.badge_salary(_card()), experience_raw=lambda: experience.badge_experience(_card()))

_LINK = "CASE k % 5 WHEN 0 THEN '/job/' || k WHEN 1 THEN 'job/' || k WHEN 2 THEN '//cdn.example.com/' || k WHEN 3 THEN '' ELSE url END"


def _link():
    k = F.col("k")
    n = k.cast("string")
    return (F.when(k % 5 == 0, F.concat(F.lit("/job/"), n)).when(k % 5 == 1, F.concat(F.lit("job/"), n))
            .when(k % 5 == 2, F.concat(F.lit("//cdn.example.com/"), n)).when(k % 5 == 3, "").otherwise(F.col("url")))


RESOLVE = "CASE WHEN regexp_matches({u}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {u} WHEN starts_with({u}, '//') THEN 'https:' || {u} WHEN {u} IN ('', '#') THEN 'https://www.naukri.com' WHEN starts_with({u}, '/') THEN 'https://www.naukri.com' || {u} ELSE 'https://www.naukri.com/' || {u} END"
_scalar("resolve_url", f"{RESOLVE.format(u='link')} AS joined, CASE WHEN link = '' OR starts_with(link, 'http') THEN link ELSE 'https://wellfound.com' || link END AS prefixed FROM (SELECT k, {_LINK} AS link FROM base) base -- ",
        joined=lambda: search.resolve_url(search.BOARD_URL, _link()), prefixed=lambda: search.prefix_url(search.STARTUP_URL, _link()))

# ---------------------------------------------------------------- searches

_ROLE = r"regexp_replace(CASE WHEN split THEN a ELSE q END, '(?i)\b(?:find|search|looking\s+for|jobs?|roles?|openings?)\b', ' ', 'g')"
SEARCH_CTES = f"""raw AS ({derived.searches_sql(derived.DUCK)}),
  q AS (SELECT search_id, {duck.collapse('text')} AS q FROM raw),
  h AS (SELECT search_id, q, regexp_extract(q, '(?i)^(.*?)\\b(?:in|at|across)\\b(.*)$', 1) AS a, regexp_extract(q, '(?i)^(.*?)\\b(?:in|at|across)\\b(.*)$', 2) AS b, regexp_matches(q, '(?i)\\b(?:in|at|across)\\b') AS split FROM q),
  p AS (SELECT search_id, trim({duck.collapse(_ROLE)}, ' ,.-') AS role,
     list_filter(list_transform(regexp_split_to_array(CASE WHEN split THEN b ELSE '' END, '(?i)\\s*(?:,|\\band\\b|\\bor\\b|&)\\s*'), lambda x: trim({duck.collapse('x')}, ' .')), lambda x: x <> '') AS places FROM h),
  s AS (SELECT search_id, role, list_transform(places, lambda x: {duck.alias('x')}) AS dup FROM p),
  parsed AS (SELECT search_id, role, list_filter(dup, lambda x, i: list_position(dup, x) = i) AS locations FROM s)
"""
_SEARCH = f"WITH {SEARCH_CTES}"


def _parsed(spark, sf):
    return derived.searches(spark, sf).select("search_id", search.parse_search(F.col("text")).alias("s")).select("search_id", "s.role", "s.locations")


@query("parse_search", f"{_SEARCH} SELECT search_id, role, array_to_string(locations, '|') AS locations FROM parsed")
def parse_search(spark, sf):
    return _parsed(spark, sf).withColumn("locations", F.array_join("locations", "|"))


_BOARD = "'https://www.naukri.com/' || {r} || '-jobs' || CASE WHEN {l} <> '' THEN '-in-' || {l} ELSE '' END"
_LOC = duck.slug(duck.alias("coalesce(place, '')"))


@query(
    "build_targets",
    f"""{_SEARCH}, board AS (SELECT search_id, 'board' AS kind, unnest(CASE WHEN len(locations) = 0 THEN [''] ELSE locations[1:2] END) AS place, role FROM parsed),
    listed AS (SELECT search_id, role, CASE WHEN len(locations) = 0 THEN [''] ELSE locations END AS ls FROM parsed WHERE {duck.slug('role')} <> ''),
    st AS (SELECT search_id, role, {duck.slug_loose('role')} AS r, locations[1] AS place FROM parsed)
    SELECT search_id, kind, {_BOARD.format(r=duck.slug('role'), l=_LOC)} AS url FROM board
    UNION ALL SELECT search_id, 'listed' AS kind, {_BOARD.format(r=duck.slug('role'), l=duck.slug('place'))} AS url FROM (SELECT search_id, role, unnest(ls) AS place FROM listed) q
    UNION ALL SELECT search_id, 'startup' AS kind, 'https://wellfound.com/role/l/' || r || '/' || replace({duck.slug_loose('place')}, 'bengaluru', 'bangalore') AS url FROM st WHERE coalesce(place, '') <> ''
    UNION ALL SELECT search_id, 'startup' AS kind, 'https://wellfound.com/role/r/' || r AS url FROM st""",
)
def build_targets(spark, sf):
    parsed = _parsed(spark, sf)
    targets = search.board_targets(F.array("role"), F.col("locations"), limit=2)
    board = parsed.select("search_id", F.lit("board").alias("kind"), F.explode(targets).alias("url"))
    listed = parsed.select("search_id", F.lit("listed").alias("kind"), F.explode(search.parsed_search_urls(F.col("role"), F.col("locations"))).alias("url"))
    first_place = F.try_element_at("locations", F.lit(1))
    startup = parsed.select("search_id", F.lit("startup").alias("kind"), F.explode(search.startup_urls(F.col("role"), first_place)).alias("url"))
    return board.union(listed).union(startup)


@query(
    "split_csv_setting",
    f"{BASE} SELECT k, array_to_string(list_filter(list_transform(string_split(title || ', ' || location || ',, ' || company, ','), lambda x: {duck.strip('x')}), lambda x: x <> ''), '|') AS items FROM base",
)
def split_csv_setting(spark, sf):
    setting = F.concat(F.col("title"), F.lit(", "), F.col("location"), F.lit(",, "), F.col("company"))
    return _select(spark, sf, items=F.array_join(search.split_csv_setting(setting), "|"))


@query("normalise_postings", f"{duck.stages('norm')} SELECT * REPLACE (array_to_string(tags, ', ') AS tags) FROM norm")
def normalised(spark, sf):
    rows = normalise_postings(valid(canonicalise(derived.raw_postings(spark, sf), derived.AS_OF)))
    return rows.withColumn("tags", F.array_join("tags", ", ")).drop("company_logo")
