"""Queries for filters, duplicates, joins, counters, SQL and the whole flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.checks import derived, duck
from postmill.checks.catalog import query
from postmill.checks.scalar_queries import SEARCH_CTES
from postmill.functions.search import parse_search
from postmill.operators import dedup, enrich, filters, summary
from postmill.operators.fuzzy import dedup_fuzzy
from postmill.operators.matching import match_searches
from postmill.operators.model import canonicalise, has_required, quarantine, valid
from postmill.operators.normalise import export_projection, normalise_postings
from postmill.plans import reports
from postmill.operators.lineage import staging_path
from postmill.plans.counters import Counters
from postmill.plans.posting_flow import export_flow, posting_flow
from postmill.schema import SOURCES

BASE = duck.stages("base")
KEYWORDS = ("Python", "widget developer", "developer", " ")
PLACES = ("pune", "San Francisco")


def _canon(spark, sf):
    return canonicalise(derived.raw_postings(spark, sf), derived.AS_OF)


def _norm(spark, sf):
    return normalise_postings(valid(_canon(spark, sf)))


# ---------------------------------------------------------------- predicates

HEAD = f"(lower(title) || chr(10) || array_to_string({duck.LOWER_TAGS}, chr(10)))"
TEXT = f"(lower(title) || ' ' || array_to_string({duck.LOWER_TAGS}, ' ') || ' ' || lower(description))"


def keyword_sql(phrase: str) -> str:
    """One fixed phrase against the derived postings."""
    words = phrase.lower().split()
    specific = filters.specific_words(phrase.lower())
    checks = [f"contains({TEXT}, '{phrase.lower().strip()}')"]
    if specific:
        checks += [f"contains({HEAD}, '{w}')" for w in specific]
    else:
        checks.append(" AND ".join(f"contains({TEXT}, '{w}')" for w in words))
    return "(" + " OR ".join(checks) + ")"


KEYWORD_SQL = " OR ".join(keyword_sql(p) for p in KEYWORDS if p.strip())
TAGS_TEXT = f"array_to_string({duck.TAGS}, ' ')"
OPEN_SQL = (
    rf"(NOT regexp_matches({TAGS_TEXT}, '(?i)\b(us|u\.s\.|united states|europe|latin america|uk|united kingdom)\s+only\b|\blatam\b')"
    r" AND NOT regexp_matches(description, '(?i)\b(us|u\.s\.|united states|europe|uk)\s+only\b|\blatam\b|\bwithin\s+germany\b|\bberlin\s+office\b'))"
)
PLACE = f"lower({duck.strip('location')})"
NAMED = "remote|worldwide|anywhere|india|bengaluru|bangalore|hyderabad|pune|gurgaon|noida|delhi|mumbai|chennai"
REACHABLE_SQL = f"({PLACE} = '' OR regexp_matches({PLACE}, '{NAMED}') OR list_has_any({duck.LOWER_TAGS}, ['remote', 'worldwide', 'anywhere']))"
LOCATION_SQL = f"({OPEN_SQL} AND ({REACHABLE_SQL} OR regexp_matches({PLACE}, 'pune|san francisco')))"
BARE_LOCATION_SQL = f"({OPEN_SQL} AND {REACHABLE_SQL})"


@query("match_keywords", f"{BASE} SELECT k, ({KEYWORD_SQL}) AS hit, {keyword_sql('senior engineer')} AS hit_generic FROM base")
def match_keywords(spark, sf):
    fields = (F.col("title"), F.col("tags"), F.col("description"))
    return derived.postings(spark, sf).select(
        "k", filters.match_keywords(*fields, KEYWORDS).alias("hit"), filters.match_keywords(*fields, ["senior engineer"]).alias("hit_generic"))


@query("match_location", f"{BASE} SELECT k, {LOCATION_SQL} AS hit, {BARE_LOCATION_SQL} AS hit_anywhere FROM base")
def match_location(spark, sf):
    fields = (F.col("location"), F.col("tags"), F.col("description"))
    return derived.postings(spark, sf).select(
        "k", filters.match_location(*fields, PLACES).alias("hit"), filters.match_location(*fields, []).alias("hit_anywhere"))


@query("filter_feed", f"{BASE} SELECT k, title AS position, location FROM base WHERE ({KEYWORD_SQL}) AND {LOCATION_SQL}")
def filter_feed(spark, sf):
    items = derived.postings(spark, sf).withColumnRenamed("title", "position")
    return filters.filter_feed(items, KEYWORDS, PLACES).select("k", "position", "location")


@query("block_senior", f"{BASE} SELECT k, title, experience_raw FROM base WHERE NOT {duck.senior('title', 'experience_raw')}")
def block_senior(spark, sf):
    return filters.block_senior(derived.postings(spark, sf)).select("k", "title", "experience_raw")


@query("experience_ceiling", f"{duck.stages('norm')} SELECT k, max_experience_required FROM norm WHERE max_experience_required IS NULL OR max_experience_required <= 1")
def experience_ceiling(spark, sf):
    return filters.experience_ceiling(_norm(spark, sf)).select("k", "max_experience_required")


@query("strict_filter", f"{duck.stages('strict')} SELECT k, title, experience_raw, max_experience_required FROM strict")
def strict_filter(spark, sf):
    return filters.strict_filter(_norm(spark, sf)).select("k", "title", "experience_raw", "max_experience_required")


@query("validate_required", f"{BASE} SELECT k FROM base WHERE title <> '' AND company <> '' AND url <> '' AND source <> ''")
def validate_required(spark, sf):
    return has_required(derived.postings(spark, sf)).select("k")


_LONG = "CASE WHEN k % 53 = 0 THEN repeat('long title ', 60) ELSE title END"


@query(
    "validate_model",
    f"""{BASE}, t AS (SELECT k, {duck.strip(_LONG)} AS title, {duck.strip('company')} AS company, {duck.strip('url')} AS url, CASE WHEN k % 59 = 0 THEN -1 END AS years FROM base)
    SELECT k, CASE WHEN title = '' THEN 'title missing' WHEN length(title) > 512 THEN 'title too long' WHEN url = '' THEN 'url missing' ELSE 'experience negative' END AS reject_reason
    FROM t WHERE title = '' OR length(title) > 512 OR url = '' OR years < 0""",
)
def validate_model(spark, sf):
    k = F.col("k")
    raw = derived.raw_postings(spark, sf).withColumns({
        "title": F.when(k % 53 == 0, F.repeat(F.lit("long title "), 60)).otherwise(F.col("title")),
        "max_experience_required": F.when(k % 59 == 0, F.lit(-1)),
    })
    return quarantine(canonicalise(raw, derived.AS_OF)).select("k", "reject_reason")


@query("sql_predicates", f"{duck.stages('exported')} SELECT url, title, salary FROM exported WHERE title IS NOT NULL AND salary <> 'Not specified'")
def sql_predicates(spark, sf):
    return reports.with_stated_salary(_export(spark, sf, ("url", "title", "salary"))).select("url", "title", "salary")


# ---------------------------------------------------------------- duplicates, merging, order

_FP = duck.fingerprint("url", "title", "company")


def _first_sql(source: str, key: str, columns: str, rows: int = 1) -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY source_rank, ord) AS n FROM {source}) q WHERE n <= {rows}"


@query("dedup_exact", f"{duck.stages('good')} {_first_sql('good', 'job_id', 'k, job_id, title')}")
def dedup_exact(spark, sf):
    return dedup.dedup_exact(valid(_canon(spark, sf))).select("k", "job_id", "title")


@query("dedup_exact_raw", f"{BASE} {_first_sql('base', _FP, 'k, url, title')}")
def dedup_exact_raw(spark, sf):
    return dedup.dedup_exact_raw(derived.postings(spark, sf)).select("k", "url", "title")


_NATURAL = ", ".join(f"lower({duck.strip(c)})" for c in ("title", "company", "location"))


@query("dedup_natural_key", f"{BASE} {_first_sql('base', _NATURAL, 'k, title, company, location')}")
def dedup_natural_key(spark, sf):
    return dedup.dedup_natural_key(derived.postings(spark, sf)).select("k", "title", "company", "location")


@query("dedup_fuzzy")
def fuzzy(spark, sf):
    return dedup_fuzzy(valid(_canon(spark, sf)).select("k", "source_rank", "ord", "title", "company"))


@query("dedup_fuzzy_summary")
def fuzzy_summary(spark, sf):
    """Kept and dropped rows of the near-duplicate removal."""
    return summary.fuzzy_summary(valid(_canon(spark, sf)).select("k", "source_rank", "ord", "title", "company"))


_SIGNATURE = "lower(title) || ' ' || lower(company)"


@query("dedup_fuzzy_equal", f"{duck.stages('good')} {_first_sql('good', _SIGNATURE, 'k, title, company')}")
def fuzzy_equal(spark, sf):
    """At threshold 1 the first of every equal text stays."""
    return dedup_fuzzy(valid(_canon(spark, sf)).select("k", "source_rank", "ord", "title", "company"), 1.0).select("k", "title", "company")


def _by_source(df):
    """The postings split by board, as their adapters deliver them."""
    return [df.where(F.lower(F.trim("source")) == name).drop("source_rank") for name in SOURCES]


@query("merge_sources", f"{BASE} SELECT k, source_rank, ord, lower(trim(source)) AS source FROM base")
def merge_sources(spark, sf):
    merged = dedup.merge_sources(_by_source(derived.postings(spark, sf)))
    return merged.select("k", F.col("source_rank").cast("bigint").alias("source_rank"), "ord", F.lower(F.trim("source")).alias("source"))


@query("cross_source_dedup", f"{duck.stages('good')} {_first_sql('good', 'job_id', 'k, job_id, source')}")
def cross_source_dedup(spark, sf):
    return dedup.cross_source_dedup(_by_source(valid(_canon(spark, sf)))).select("k", "job_id", "source")


@query("cap_per_source", f"{duck.stages('good')} {_first_sql('good', 'source', 'k, source, title', 50)}")
def cap_per_source(spark, sf):
    return dedup.cap_per_source(valid(_canon(spark, sf)), 50).select("k", "source", "title")


_SEEN = "'2001-12-' || lpad(CAST(k % 28 + 1 AS STRING), 2, '0')"


@query("order_latest", f"{BASE} SELECT k, title, {_SEEN} AS scraped_at FROM base ORDER BY scraped_at DESC, source_rank, ord")
def order_latest(spark, sf):
    seen = F.concat(F.lit("2001-12-"), F.lpad((F.col("k") % 28 + 1).cast("string"), 2, "0"))
    return reports.latest_first(derived.postings(spark, sf).withColumn("scraped_at", seen)).select("k", "title", "scraped_at")


# ---------------------------------------------------------------- joins

_ENRICHED = "k, title, description, salary, salary_raw, salary_min, salary_max, experience_raw, max_experience_required"


@query("enrich_details", f"{duck.stages('enriched')} SELECT {_ENRICHED} FROM enriched")
def enrich_details(spark, sf):
    return posting_flow(derived.raw_postings(spark, sf), derived.details(spark, sf), derived.AS_OF).select(*_ENRICHED.split(", "))


@query("known_sources", f"{BASE}, b AS (SELECT k, CASE WHEN k % 13 = 0 THEN 'other' ELSE source END AS source FROM base) SELECT k, source, CASE WHEN lower(trim(source)) IN ('naukri', 'remoteok', 'wellfound') THEN lower(trim(source)) END AS adapter FROM b")
def known_sources(spark, sf):
    source = F.when(F.col("k") % 13 == 0, "other").otherwise(F.col("source"))
    return enrich.known_sources(derived.postings(spark, sf).withColumn("source", source)).select("k", "source", "adapter")


@query(
    "match_searches",
    f"""{BASE}, roles AS (SELECT search_id, lower(role) AS kw, locations FROM (
        WITH {SEARCH_CTES} SELECT * FROM parsed) p WHERE role <> ''),
      words AS (SELECT *, list_filter(string_split(kw, ' '), lambda w: w <> '') AS ws, list_filter(string_split(kw, ' '), lambda w: length(w) > 2 AND w NOT IN ({", ".join(repr(w) for w in filters.GENERIC_ROLE_WORDS)})) AS spec FROM roles),
      posts AS (SELECT k, {HEAD} AS head, {TEXT} AS txt, {PLACE} AS place, {REACHABLE_SQL} AS reachable FROM base WHERE {OPEN_SQL}),
      hits AS (SELECT search_id, k FROM words, posts WHERE
        (contains(txt, kw) OR len(list_filter(spec, lambda w: contains(head, w))) > 0 OR (len(spec) = 0 AND len(list_filter(ws, lambda w: contains(txt, w))) = len(ws)))
        AND (reachable OR len(list_filter(locations, lambda l: contains(place, l))) > 0))
      SELECT search_id, count(*) AS n_postings, min(k) AS first_k, max(k) AS last_k, CAST(sum(k) AS BIGINT) AS sum_k FROM hits GROUP BY search_id""",
)
def saved_searches(spark, sf):
    searches = derived.searches(spark, sf).select("search_id", parse_search(F.col("text")).alias("s")).select("search_id", "s.role", "s.locations")
    posts = derived.postings(spark, sf).select("k", "title", "tags", "description", "location")
    return match_searches(posts, searches, totals="k").toDF("search_id", "n_postings", "first_k", "last_k", "sum_k")


# ---------------------------------------------------------------- counters


@query("filter_summary", f"{duck.stages('judged')} SELECT coalesce(drop_reason, 'kept') AS outcome, count(*) AS n_rows FROM judged GROUP BY 1")
def filter_summary(spark, sf):
    return summary.filter_summary(_norm(spark, sf))


@query("dedup_summary", f"{BASE} SELECT count(DISTINCT {_FP}) AS n_unique, count(*) - count(DISTINCT {_FP}) AS n_duplicates FROM base")
def dedup_summary(spark, sf):
    return summary.dedup_summary(derived.postings(spark, sf))


@query("enrich_summary", f"{duck.stages('enriched')} SELECT count(*) FILTER (length(description) > 200) AS n_rich, count(*) AS n_total FROM enriched")
def enrich_summary(spark, sf):
    return summary.enrich_summary(posting_flow(derived.raw_postings(spark, sf), derived.details(spark, sf), derived.AS_OF))


@query("source_counts", f"{BASE}, s AS (SELECT lower(trim(source)) AS source FROM base) SELECT source, count(*) AS n_rows FROM s GROUP BY source UNION ALL SELECT '(all)' AS source, count(*) AS n_rows FROM s")
def source_counts(spark, sf):
    return summary.source_counts(derived.postings(spark, sf).select(F.lower(F.trim("source")).alias("source")))


_COUNTERS = {
    "canon": {"normalise": {"n_input": "TRUE", "n_ok": "reject_reason IS NULL"}},
    "judged": {"filter": {"kept": "drop_reason IS NULL", "senior": "drop_reason = 'senior'", "experience": "drop_reason = 'experience'"}},
    "uniq": {"dedup": {"n_unique": "TRUE"}},
    "enriched": {
        "enrich": {"n_rich": "length(description) > 200", "n_total": "TRUE"},
        "sources": {**{name: f"source = '{name}'" for name in SOURCES}, "other": "source NOT IN ('" + "', '".join(SOURCES) + "')"},
    },
}


@query("flow_counters", duck.stages("enriched") + " UNION ALL ".join(
    f"SELECT '{step}' AS step, '{name}' AS counter, count(*) FILTER ({test}) AS n_rows FROM {stage}"
    for stage, steps in _COUNTERS.items() for step, tests in steps.items() for name, test in tests.items()))
def flow_counters(spark, sf):
    """All counters of one run of the flow, taken while its rows are written."""
    counters = Counters()
    rows = posting_flow(derived.raw_postings(spark, sf), derived.details(spark, sf), derived.AS_OF, counters=counters)
    rows.write.option("compression", "zstd").parquet(staging_path(spark, "counted"))
    return counters.frame(spark)


@query("normalise_summary", f"{duck.stages('canon')} SELECT count(*) FILTER (reject_reason IS NULL) AS n_ok, count(*) AS n_input FROM canon")
def normalise_summary(spark, sf):
    return summary.normalise_summary(_canon(spark, sf))


# ---------------------------------------------------------------- export, SQL, flow


def _export(spark, sf, columns=None):
    return export_flow(derived.raw_postings(spark, sf), derived.details(spark, sf), derived.AS_OF, columns=columns)


_META = (
    "title, company, location, description, coalesce(salary, salary_raw, '') AS salary, coalesce(experience_raw, '') AS experience_raw, max_experience_required,"
    " url, coalesce(posted_date, '') AS posted_date, job_type, source, scraped_at, salary_min, salary_max, array_to_string(tags, ', ') AS tags, job_id, '' AS company_logo"
)


@query("export_projection", f"{duck.stages('norm')} SELECT {_META} FROM norm")
def export(spark, sf):
    return export_projection(_norm(spark, sf), include_metadata=True)


@query("adhoc_sql", f"{duck.stages('exported')} SELECT source, job_type, count(*) AS n_rows, count(DISTINCT company) AS n_companies, max(posted_date) AS latest FROM exported GROUP BY source, job_type")
def adhoc_sql(spark, sf):
    return reports.adhoc_sql(
        _export(spark, sf, ("source", "job_type", "company", "posted_date")),
        "SELECT source, job_type, count(*) AS n_rows, count(DISTINCT company) AS n_companies, max(posted_date) AS latest FROM {table} GROUP BY source, job_type",
    )


@query("analysis_query", f"{duck.stages('exported')} SELECT title, company, location, salary, job_type, source, posted_date, scraped_at FROM exported WHERE title IS NOT NULL ORDER BY scraped_at DESC")
def analysis_query(spark, sf):
    return reports.analysis_query(_export(spark, sf, reports.REPORT_COLUMNS))


@query("posting_flow", f"{duck.stages('exported')} SELECT {duck.EXPORT} FROM exported")
def flow(spark, sf):
    return _export(spark, sf)
