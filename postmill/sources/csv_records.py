"""Large CSV files with line breaks in quoted fields, read by many tasks.

Lines come from Spark's splittable text source, so the splits of one file are read apart. Whether a line
starts inside a quoted field follows from the lines before it: each line either keeps that state, turns it,
or sets it. Within a split a running window composes these effects; of every split one row remains, and
a second window over those rows tells in which state each split begins. Lines of one record are then put
together inside their split, and the few records that cross a split's end are joined across splits.

A quote counts only where it opens a field; in a field without quotes it is a character like any other.
What stands between a closing quote and the next comma belongs to the field. Blank lines are no records.
Where a file's first line ends in CR LF, all its CR LF are line breaks, inside of fields too and read as LF there,
as Spark's whole-file reader has it.
The first record of every file is its header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Whole fields up to the end of the line, none of them open.
CLOSED = r'^(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|)(?:,|\z))*+\z'
SPLIT = ["file", "block"]


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, line, value)``: lines with the split they come from; ``line`` ascends within a split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value",
    )


def _effects(lines: DataFrame) -> DataFrame:
    """Adds ``fixed``, the state a line ends in whatever came before, and ``turn``, 1 where it ends in the other one."""
    from_outside, from_inside = ~F.col("value").rlike(CLOSED), ~F.concat(F.lit('"'), "value").rlike(CLOSED)
    both = lines.withColumns({"_outside": from_outside.cast("int"), "_inside": from_inside.cast("int")})
    return both.withColumns({
        "fixed": F.when(F.col("_outside") == F.col("_inside"), F.col("_outside")),
        "turn": F.when((F.col("_outside") == 1) & (F.col("_inside") == 0), 1).otherwise(0),
    }).drop("_outside", "_inside")


def _with_state(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds what earlier rows do to the state: ``known``, it is that (null: none of them sets it), and ``turns``."""
    window = Window.partitionBy(*keys).orderBy(order)
    upto = rows.withColumn("upto", F.sum("turn").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    setting = F.when(F.col("fixed").isNotNull(), F.struct("fixed", "upto"))
    base = upto.withColumn("base", F.last(setting, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1)))
    turns = F.col("upto") - F.col("turn")
    return base.withColumns({"turns": turns, "known": (F.col("base.fixed") + turns - F.col("base.upto")) % 2}).drop("base")


def _split_states(lines: DataFrame) -> DataFrame:
    """``(file, block, entry, exit, crlf)``: is a quoted field open where a split begins and ends (1), and how lines end."""
    last = F.max(F.when(F.col("fixed").isNotNull(), F.struct("line", "fixed", "upto")))
    splits = lines.groupBy(*SPLIT).agg(F.sum("turn").alias("total"), last.alias("last"), F.min_by(F.endswith("value", F.lit("\r")), "line").alias("crlf")).select(
        *SPLIT, "crlf", ((F.col("last.fixed") + F.col("total") - F.col("last.upto")) % 2).alias("fixed"), (F.col("total") % 2).alias("odd")
    ).withColumn("turn", F.when(F.col("fixed").isNull(), F.col("odd")).otherwise(0))
    entry = F.coalesce("known", F.col("turns") % 2)
    return _with_state(splits, ["file"], "block").select(
        *SPLIT, entry.alias("entry"), F.coalesce("fixed", (entry + F.col("turn")) % 2).alias("exit"),
        F.first("crlf").over(Window.partitionBy("file").orderBy("block")).alias("crlf"),
    )


def _joined(order: list[str], text: str) -> Column:
    """The group's texts in order, with the line breaks that stood between them."""
    rows = F.sort_array(F.collect_list(F.struct(*order, text)))
    return F.array_join(F.transform(rows, lambda r: r[text]), "\n")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(record)``: the text of every record below a path or glob, without headers."""
    lines = _with_state(_effects(csv_lines(spark, path)), SPLIT, "line")
    inside = F.coalesce("known", (F.col("entry") + F.col("turns")) % 2) == 1
    running = Window.partitionBy(*SPLIT).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*SPLIT)
    value = F.when(F.col("crlf"), F.regexp_replace("value", r"\r\z", "")).otherwise(F.col("value"))
    placed = lines.join(_split_states(lines), SPLIT).select(
        *SPLIT, "line", value.alias("value"), "exit", F.last(F.when(~inside, F.col("line")), ignorenulls=True).over(running).alias("start"),
        F.min("line").over(whole).alias("first"),
    )
    pieces = placed.groupBy(*SPLIT, "start").agg(
        _joined(["line"], "value").alias("text"), F.any_value("exit").alias("exit"),
        ((F.col("block") == 0) & F.coalesce(F.col("start") == F.any_value("first"), F.lit(False))).alias("header"),
    )
    # A record that goes on in the next split leaves a piece in each; all others are whole.
    last = F.max("start").over(whole)
    pieces = pieces.withColumn("open", F.col("start").isNull() | ((F.col("exit") == 1) & (F.col("start") == last)))
    along = Window.partitionBy("file").orderBy("block", F.asc_nulls_first("start"))
    own = F.last(F.when(F.col("start").isNotNull(), F.struct("block", "start")), ignorenulls=True).over(along)
    crossing = pieces.where("open").withColumn("own", own).groupBy("file", "own").agg(
        _joined(["block", "start"], "text").alias("text"), F.max("header").alias("header")
    )
    found = pieces.where("NOT open").select("text", "header").unionByName(crossing.select("text", "header"))
    return found.where("NOT header").select(F.col("text").alias("record")).where("record <> ''")


def read_csv_records(spark: SparkSession, path: str, ddl: str, options: dict) -> DataFrame:
    """Records of large files under a declared schema, by position."""
    parser = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if k != "header"}
    return csv_records(spark, path).select(F.from_csv("record", ddl, parser).alias("r")).select("r.*")
