"""Postings, detail pages and searches derived from the given tables.

The tables hold no posting-like text, so postings are computed from ``orders``
joined to ``part``, ``supplier``, ``nation`` and ``documents`` by plain arithmetic
on the order key. One SQL text serves Spark and the checking engine; only the few
functions the two spell differently are filled in per dialect. Everything grows
with the tables.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2002, 1, 1, tzinfo=timezone.utc)

SPARK = {
    "days": "datediff(o_orderdate, DATE '1970-01-01')",
    "table": "{{{name}}}",
    # Every order brings a whole text: the join is dealt by rows, not by the bytes that go into it.
    "spread": "(SELECT /*+ REPARTITION({parts}, doc_k) */ * FROM ",
    "spread_end": ") o",
    "texts": "(SELECT /*+ REPARTITION({parts}, doc_id) */ * FROM {documents})",
}
DUCK = {
    "days": "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))",
    "table": "{name}",
    "spread": "",
    "spread_end": "",
    "texts": "documents",
}
# Orders of one task where they meet their texts.
ROWS_PER_TASK = 20_000
# Tables that drive row-heavy work.
SPREAD = ("orders", "documents", "pages")
BASE_TABLES = ("orders", "part", "supplier", "nation", "documents")


def _text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _pad(expr: str, width: int = 2) -> str:
    return f"lpad({_text(expr)}, {width}, '0')"


def _thousands(expr: str) -> str:
    """Whole number below a million with a thousands comma."""
    return f"CASE WHEN {expr} < 1000 THEN {_text(expr)} ELSE {_text(f'CAST(floor({expr} / 1000) AS BIGINT)')} || ',' || {_pad(f'{expr} % 1000', 3)} END"


def _pick(selector: str, *choices: str) -> str:
    """``CASE selector WHEN 0 THEN first ...``; the last choice is the rest."""
    *some, last = choices
    cases = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(some))
    return f"CASE {selector} {cases} ELSE {last} END"


_Y, _M, _D = "year(o_orderdate)", "month(o_orderdate)", "day(o_orderdate)"
_MONTH = _pick("month(o_orderdate) - 1", *[f"'{m}'" for m in (
    "January", "February", "March", "April", "May", "June", "July", "August",
    "September", "October", "November", "December")])
_MON = f"substr({_MONTH}, 1, 3)"


# What follows the text in a description, by order; each begins with a blank or is empty.
_ENDING = _pick("k % 9", "''", "' Needs 3+ years of experience.'", "' Min 2 years with SQL.'", "' Freshers can apply.'", "' US only.'",
                "' experience: 2-4 years'", "' at least 5 years'", "' 1 to 3 yrs'", "'   '")


def _letters(expr: str) -> str:
    """Letters and single blanks of a text, in Spark's spelling."""
    return f"btrim(regexp_replace({expr}, '[^\\\\pL]+', ' '))"


def postings_sql(dialect: dict[str, str], words: bool = False) -> str:
    """``(k, ord, source_rank, raw posting columns, tags_txt)``, one row per order.

    ``words`` (Spark only) adds the letters and single blanks of the description, those of the text worked out before the join.
    """
    texts = f"(SELECT *, {_letters('text')} AS doc_words FROM {dialect['texts']})" if words else dialect["texts"]
    doc_words = ", doc_words" if words else ""
    own_words = f", btrim(concat(doc_words, ' ', {_letters(_ENDING)})) AS words" if words else ""
    t = {name: dialect["table"].format(name=name) for name in BASE_TABLES}
    price, price_hi = "price", "(price + 12000)"
    seconds = f"({dialect['days']} * 86400 + k % 86400)"
    posted = _pick(
        "k % 17",
        f"{_text(_Y)} || '-' || {_pad(_M)} || '-' || {_pad(_D)}",
        f"{_text(_Y)} || '/' || {_pad(_M)} || '/' || {_pad(_D)}",
        f"{_pad(_D)} || '/' || {_pad(_M)} || '/' || {_text(_Y)}",
        f"{_text(_D)} || '-' || {_text(_M)} || '-' || {_text(_Y)}",
        f"{_pad(_M)} || '/' || {_pad(_D)} || '/' || {_text(_Y)}",
        f"{_pad(_D)} || ' ' || {_MON} || ' ' || {_text(_Y)}",
        f"{_text(_D)} || ' ' || {_MONTH} || ' ' || {_text(_Y)}",
        f"{_MON} || ' ' || {_pad(_D)} || ', ' || {_text(_Y)}",
        f"{_MONTH} || ' ' || {_text(_D)} || ', ' || {_text(_Y)}",
        f"{_MON} || ' ' || {_text(_D)} || ' ' || {_text(_Y)}",
        f"{_pad(_D)} || '-' || {_MON} || '-' || {_text(_Y)}",
        f"upper({_text(_D)} || '-' || {_MONTH} || '-' || {_text(_Y)})",
        f"{_text(_Y)} || '-' || {_pad(_M)} || '-' || {_pad(_D)} || 'T' || {_pad('k % 24')} || ':30:00Z'",
        f"{_text(_Y)} || '-' || {_pad(_M)} || '-' || {_pad(_D)} || 'T23:30:00-08:00'",
        _text(seconds),
        _text(f"({seconds} * 1000 + k % 1000)"),
        _pick("k % 6",
              f"{_text('k % 40 + 1')} || ' days ago'", f"'Posted ' || {_text('k % 9 + 1')} || 'w ago'",
              f"{_text('k % 30 + 1')} || '+ days ago'", f"'Active: ' || {_text('k % 20 + 1')} || ' hrs ago'",
              f"{_text('k % 12 + 1')} || ' months ago'", f"{_text('k % 3 + 1')} || 'y'"),
    )
    salary = _pick(
        "k % 13", "NULL", "'Not specified'",
        f"'$' || {_thousands(price)} || ' - $' || {_thousands(price_hi)}",
        f"'$' || {_text('k % 90 + 60')} || 'k'",
        f"'$' || {_text('k % 90 + 60')} || 'k - $' || {_text('k % 90 + 90')} || 'k'",
        f"{_text('k % 9 + 3')} || '.2 LPA'",
        f"{_text('k % 9 + 3')} || ' - ' || {_text('k % 9 + 7')} || ' LPA'",
        f"{_text('k % 9 + 3')} || '-' || {_text('k % 9 + 5')} || ' Lacs PA'",
        "'6 lakhs - 12 lakhs'", "'1 crore - 2 crore'",
        f"'Up to $' || {_thousands(price)}", f"'₹ ' || {_thousands(price)} || ' per annum'", "'Negotiable'",
    )
    return f"""
    SELECT k, k AS ord, CAST(k % 3 AS BIGINT) AS source_rank,
      CASE WHEN k % 19 = 0 THEN ' ' || upper(src) || ' ' ELSE src END AS source,
      CASE WHEN k % 97 = 0 THEN '' WHEN k % 101 = 0 THEN '#'
           WHEN k % 7 = 3 THEN upper('https://jobs.example.com/p/' || {_text('g')})
           WHEN k % 2 = 1 THEN 'https://jobs.example.com/p/' || {_text('g')} || '/'
           ELSE 'https://jobs.example.com/p/' || {_text('g')} END AS url,
      CASE WHEN k % 89 = 0 THEN ' ' ELSE {_pick('k % 7', "''", "'Senior '", "'Sr. '", "'Lead '", "'Junior '", "'  Data  '", "'Principal '")} || p_name
           || {_pick('k % 4', "''", "' developer'", "' Intern'", "' engineer '")} END AS title,
      s_name || {_pick('k % 4', "''", "' 4.2 ★'", "' 3.9 ★★★'", "' 12 Reviews'")} AS company,
      {_pick('k % 8', "''", "'Work from Home'", "'Bengaluru, India'", "'Remote - Worldwide'", "' Pune '", "n_name", "'San Francisco, CA'", "'Bangalore, Remote'")} AS location,
      {_pick('k % 6', "''", "'python|remote'", "'contract|SQL'", "'junior|anywhere'", "'US only|java'", _pick('k % 4', "'senior| 3+ years '", "' 3+ years |senior'", "'lead'", "'entry-level|4 yrs'"))} AS tags_txt,
      {salary} AS salary_raw,
      CASE WHEN k % 37 = 0 THEN {_text('price + 500')} WHEN k % 23 = 0 THEN '0' WHEN k % 41 = 0 THEN '75000.9' ELSE NULL END AS salary_min,
      CASE WHEN k % 37 = 0 THEN {_text('price')} WHEN k % 23 = 0 THEN '-5' ELSE NULL END AS salary_max,
      {_pick('k % 11', "NULL", "' '", "'0-1 Yrs'", "'0-3 Yrs'", "'1 - 4 years'", "'2 to 5 years'", "'5+ years'", "'Fresher'", "'min 2 years'", "'senior'", "'7'")} AS experience_raw,
      CASE WHEN k % 29 = 0 THEN {_pick('k % 3', "'Today'", "'Yesterday'", "'Just now'")} WHEN k % 31 = 0 THEN 'soon' ELSE {posted} END AS posted_raw,
      doc || {_ENDING} AS description,
      {_pick('k % 8', "''", "'FULL TIME'", "'parttime'", "'freelance'", "'intern'", "'permanent'", "' temporary '", "'Other'")} AS job_type{own_words}
    FROM (
      SELECT o_orderkey AS k, o_orderdate, p_name, s_name, n_name, text AS doc{doc_words},
        CASE WHEN o_orderkey % 5 = 4 THEN o_orderkey - 4 ELSE o_orderkey END AS g,
        CAST(floor(o_totalprice) AS BIGINT) AS price,
        {_pick('o_orderkey % 3', "'naukri'", "'remoteok'", "'wellfound'")} AS src
      FROM {dialect['spread']}(SELECT o.*, o_orderkey % (SELECT count(*) FROM {t['part']}) AS part_k,
                   o_orderkey % (SELECT count(*) FROM {t['supplier']}) AS supp_k,
                   o_orderkey % (SELECT count(*) FROM {t['nation']}) AS nation_k,
                   o_orderkey % (SELECT count(*) FROM {t['documents']}) AS doc_k
            FROM {t['orders']} o) o
      JOIN {t['part']} p ON p_partkey = part_k
      JOIN {t['supplier']} s ON s_suppkey = supp_k
      JOIN {t['nation']} n ON n_nationkey = nation_k{dialect['spread_end']}
      JOIN {texts} d ON doc_id = doc_k
    ) base
    """


def details_sql(dialect: dict[str, str], gaps: bool = True) -> str:
    """``(source, url, text)``: a page text for every order; with ``gaps`` three of ten have none, as in a join."""
    t = {name: dialect["table"].format(name=name) for name in ("orders", "documents")}
    experience = _pick(
        "k % 12", "' Needs 0-3 years of experience in SQL.'", "' Minimum 2 years.'", "' We want 4+ yrs.'",
        "' Experience: 3-7 Yrs.'", "' Freshers can apply.'", "' An entry-level role.'", "' exp 5 years'",
        "' 2 years of experience'", "''", "' at least 1 year'", "' 10 key skills'", "' No experience required.'",
    )
    salary = _pick(
        "k % 5", "' Salary: 6-12 LPA.'", "' CTC: $8,000 - $15,000 per annum.'", "' $90k - $120k a year.'", "''",
        "' about 15 lakh.'",
    )
    return f"""
    SELECT k, {_pick('k % 3', "'naukri'", "'remoteok'", "'wellfound'")} AS source,
      CASE WHEN k % 7 = 3 THEN upper('https://jobs.example.com/p/' || {_text('k')})
           WHEN k % 2 = 1 THEN 'https://jobs.example.com/p/' || {_text('k')} || '/'
           ELSE 'https://jobs.example.com/p/' || {_text('k')} END AS url,
      CASE WHEN k % 10 = 6 THEN ' too short ' ELSE '  ' || text || {experience} || {salary} || ' ' END AS text
    FROM (SELECT o_orderkey AS k, text
          FROM {dialect['spread']}(SELECT o_orderkey, o_orderkey % (SELECT count(*) FROM {t['documents']}) AS doc_k FROM {t['orders']}) o{dialect['spread_end']}
          JOIN {dialect['texts']} d ON doc_id = doc_k
          {'WHERE o_orderkey % 10 < 7' if gaps else ''}) base
    """


def searches_sql(dialect: dict[str, str]) -> str:
    """``(search_id, text)``: one saved search per supplier."""
    t = {name: dialect["table"].format(name=name) for name in ("supplier", "part", "nation")}
    text = _pick(
        "k % 12",
        "'find ' || p_name || ' roles in bangalore'",
        "p_name || ' jobs in pune, mumbai and bengaluru'",
        "'looking for ' || p_name || ' openings at ' || n_name",
        "'Search  developer  Jobs across Gurugram & Noida'",
        "p_name",
        "p_name || ' or data in delhi or chennai, Delhi.'",
        "'junior ' || p_name || ' job in ' || n_name || ' and San Francisco'",
        "'in pune'",
        "'data engineer roles'",
        "'  '",
        "'staff engineer at Hyderabad, India'",
        "'SENIOR ' || upper(p_name) || ' - openings in , india'",
    )
    return f"""
    SELECT k AS search_id, {text} AS text
    FROM (SELECT s_suppkey AS k, p_name, n_name
          FROM (SELECT s_suppkey, (s_suppkey * 7) % (SELECT count(*) FROM {t['part']}) AS part_k,
                       s_suppkey % (SELECT count(*) FROM {t['nation']}) AS nation_k
                FROM {t['supplier']}) s
          JOIN {t['part']} p ON p_partkey = part_k
          JOIN {t['nation']} n ON n_nationkey = nation_k) base
    """


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; one that arrives in fewer parts than there are cores is spread."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in SPREAD and df.rdd.getNumPartitions() < cores else df


def tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: table(spark, folder, name) for name in names}


def _dealt(spark: SparkSession, folder: str) -> dict[str, str]:
    """Spark's spelling with as many tasks as the orders ask for."""
    parts = max(spark.sparkContext.defaultParallelism, -(-table(spark, folder, "orders").count() // ROWS_PER_TASK))
    return {name: text.replace("{parts}", str(parts)) for name, text in SPARK.items()}


def _with_tags(df: DataFrame) -> DataFrame:
    tags = F.when(F.col("tags_txt") == "", F.array().cast("array<string>")).otherwise(F.split("tags_txt", r"\|"))
    return df.withColumn("tags", tags).drop("tags_txt")


def postings(spark: SparkSession, folder: str, words: bool = False) -> DataFrame:
    return _with_tags(spark.sql(postings_sql(_dealt(spark, folder), words), **tables(spark, folder, *BASE_TABLES)))


def raw_postings(spark: SparkSession, folder: str) -> DataFrame:
    """The postings in the column layout adapters deliver."""
    return postings(spark, folder).withColumn("salary", F.lit(None).cast("string")).withColumnRenamed(
        "posted_raw", "posted_date"
    )


def details(spark: SparkSession, folder: str, gaps: bool = True) -> DataFrame:
    return spark.sql(details_sql(_dealt(spark, folder), gaps), **tables(spark, folder, "orders", "documents"))


def searches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(searches_sql(SPARK), **tables(spark, folder, "supplier", "part", "nation"))
