"""Pages of the payload run: parsed once, and those only that a posting asks for."""

from pyspark.sql import functions as F

from postmill.operators import enrich
from postmill.plans.payload_flow import details_of

HTML = "<html><body><nav>menu</nav><main>" + "some text about the work " * 9 + "</main></body></html>"


def test_a_page_is_parsed_once(spark):
    pages = spark.range(9).select(F.lit(" Naukri").alias("source"), F.concat(F.lit("u"), "id").alias("url"), F.lit(HTML).alias("html"))
    texts = details_of(pages)
    assert texts.where(F.length("text") > 99).count() == 9
    plan = texts.where(F.length("text") > 99)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("\n\n")[0].count("ArrowEvalPython [") <= 3  # one for each board


def test_only_pages_asked_for_are_read(spark):
    seen = []
    left = spark.createDataFrame([(1, "naukri", "u3", "short", None, None, None, None, None, None)],
                                 "ord long, source string, url string, description string, salary string, salary_raw string, experience_raw string, max_experience_required bigint, salary_min bigint, salary_max bigint")
    pages = spark.range(9).select(F.lit(" Naukri").alias("source"), F.concat(F.lit("u"), "id").alias("url"), F.lit(HTML).alias("html"))

    def read(found):
        seen.extend(r.url for r in found.collect())
        return details_of(found)

    rows = enrich.enrich_details(left, pages, read=read).collect()
    assert seen == ["u3"] and rows[0].description.startswith("some text")
