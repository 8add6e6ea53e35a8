"""Sets of numbers as bitmaps that are small enough to ship, so that wide rows are told apart where they lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.lineage import cut_lineage

# Numbers that keys are spread over: 16 MB of bits at most.
KEY_PLACES = 1 << 27
# One bitmap holds 32,768 numbers in 4 KB. More bitmaps than this are joined as Spark sees fit.
SHIPPED_BITMAPS = 1 << 16


def place(*keys: Column) -> Column:
    """A number below ``KEY_PLACES`` for a key: equal keys share it, now and then different ones do."""
    return F.pmod(F.xxhash64(*keys), F.lit(KEY_PLACES))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows with numbers of their own. They hold once the rows are written, and run on within a part."""
    return df.withColumn(name, F.monotonically_increasing_id())


def marks(numbers: DataFrame) -> DataFrame:
    """``(_bucket, _bits)`` of the numbers in the only column, written; a bit for every number that occurs."""
    n = F.col(numbers.columns[0])
    cells = numbers.where(n.isNotNull()).select(F.bitmap_bucket_number(n).alias("_bucket"), F.bitmap_bit_position(n).alias("_bit"))
    bits = cut_lineage(cells.repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits")))
    return F.broadcast(bits) if bits.count() <= SHIPPED_BITMAPS else bits


def _is_set(bits: Column, n: Column) -> Column:
    at = F.bitmap_bit_position(n).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, at % 8) == 1


def _hit(number: Column) -> Column:
    return (F.bitmap_bucket_number(number) == F.col("_bucket")) & _is_set(F.col("_bits"), number)


def marked(df: DataFrame, number: Column, found: DataFrame) -> DataFrame:
    """Rows whose number is marked."""
    return df.join(found, _hit(number), "left_semi")


def unmarked(df: DataFrame, number: Column, found: DataFrame) -> DataFrame:
    """All other rows, those without a number among them."""
    return df.join(found, _hit(number), "left_anti")


def with_mark(df: DataFrame, number: Column, found: DataFrame, name: str) -> DataFrame:
    """All rows, with a column that tells whether their number is marked."""
    rows = df.join(found, F.bitmap_bucket_number(number) == F.col("_bucket"), "left")
    return rows.withColumn(name, F.coalesce(_is_set(F.col("_bits"), number), F.lit(False))).drop("_bucket", "_bits")
