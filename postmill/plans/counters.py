"""Counters of a run, taken while its rows pass."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from postmill.operators.enrich import RICH_TEXT
from postmill.operators.lineage import observed
from postmill.schema import SOURCES

COUNTS = "step string, counter string, n_rows bigint"


class Counters:
    """Row counts by step, without a job of their own.

    ``watch`` puts counts on a frame; they are known once an action or a write has run over it. A plan
    must run once for them to hold: a frame read by two actions is counted by the first one. Where Spark
    works off a task again after an executor was lost, its rows may count twice, so they are a report on
    a run and decide nothing in it.
    """

    def __init__(self) -> None:
        self._seen: dict[str, tuple[Observation, list[str]]] = {}

    def watch(self, step: str, df: DataFrame, **counts: Column) -> DataFrame:
        if step in self._seen:
            raise ValueError(f"step {step} is watched already")
        seen = Observation(f"{step}-{uuid.uuid4().hex}")
        self._seen[step] = seen, list(counts)
        return df.observe(seen, *[c.cast("bigint").alias(name) for name, c in counts.items()])

    def frame(self, spark: SparkSession) -> DataFrame:
        """``(step, counter, n_rows)``, a row for each counter; call it when the run is over.

        Null where Spark left a step out of the plan, having found that no row can come of it.
        """
        rows = []
        for step, (seen, names) in self._seen.items():
            found = observed(seen)
            rows += [(step, name, found.get(name)) for name in names]
        return spark.createDataFrame(rows, COUNTS)


def watch_validation(counters: Counters, canonical: DataFrame) -> DataFrame:
    return counters.watch(
        "normalise", canonical, n_input=F.count(F.lit(1)), n_ok=F.count_if(F.col("reject_reason").isNull()))


def watch_filter(counters: Counters, judged: DataFrame) -> DataFrame:
    reason = F.col("drop_reason")
    return counters.watch(
        "filter", judged, kept=F.count_if(reason.isNull()), senior=F.count_if(reason == "senior"),
        experience=F.count_if(reason == "experience"))


def watch_unique(counters: Counters, unique: DataFrame) -> DataFrame:
    """Together with the filter's ``kept`` this gives the duplicates."""
    return counters.watch("dedup", unique, n_unique=F.count(F.lit(1)))


def watch_result(counters: Counters, enriched: DataFrame) -> DataFrame:
    """Rows with a rich text, and rows by source; ``other`` holds the sources without an adapter."""
    source = F.lower(F.trim(F.coalesce(F.col("source"), F.lit(""))))
    rich = F.length(F.coalesce(F.col("description"), F.lit(""))) > RICH_TEXT
    watched = counters.watch("enrich", enriched, n_rich=F.count_if(rich), n_total=F.count(F.lit(1)))
    by_source = {name: F.count_if(source == name) for name in SOURCES}
    return counters.watch("sources", watched, **by_source, other=F.count_if(~source.isin(*SOURCES)))
