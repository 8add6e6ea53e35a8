"""Large CSV files: cut at splits, same rows as Spark's whole-file reader."""

import random

import pytest
from pyspark.sql import functions as F

from postmill.schema import EXPORT_DDL, EXPORT_TYPED_DDL
from postmill.sources import csv_records, exports

WIDTH = len(EXPORT_DDL.split(","))
PIECES = ["plain", "", " ", "a,b", 'say "hi"', '"', '""', "two\nlines", "\n", "\n\n", ',\n"x",', "ends\r\n", "Straße 日本", "7", "x" * 300]


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "512")
    yield
    for n, value in zip(names, before, strict=True):
        spark.conf.set(n, value)


def quoted(value):
    return '"' + value.replace('"', '""') + '"' if any(c in value for c in ',"\r\n') else value


def sheet(rng, rows, end="\n"):
    header = [f"c{i}" if i else 'first\n"name"' for i in range(WIDTH)]
    lines = [header] + [["r" + rng.choice(PIECES)] + ["".join(rng.choices(PIECES, k=rng.randint(1, 3))) for _ in range(WIDTH - 1)] for _ in range(rows)]
    return end.join(",".join(map(quoted, row)) for row in lines) + rng.choice(["", end])


def rows_of(df):
    return sorted(map(str, df.collect()))


def whole_files(spark, path, ddl=EXPORT_DDL):
    return spark.read.schema(ddl).options(**exports.READ_OPTIONS).csv(path)


@pytest.mark.parametrize(("seed", "end"), [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_same_rows_from_many_splits(spark, tmp_path, small_splits, seed, end):
    rng = random.Random(seed)
    for name, rows in (("a.csv", 90), ("b.csv", 40), ("only_header.csv", 0)):
        (tmp_path / name).write_bytes(sheet(rng, rows, end).encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    path = str(tmp_path)
    lines = csv_records.csv_lines(spark, path)
    assert lines.rdd.getNumPartitions() > 8
    assert lines.where(F.col("file").endswith("/a.csv")).select("block").distinct().count() > 8
    expected = whole_files(spark, path)
    assert expected.count() == 130
    assert rows_of(csv_records.read_csv_records(spark, path, EXPORT_DDL, exports.READ_OPTIONS)) == rows_of(expected)


def test_one_record_over_many_splits(spark, tmp_path, small_splits):
    rest = "," * (WIDTH - 1)
    texts = ["h" + rest, "before" + rest, quoted("long\n" * 900) + rest, quoted('"\n"' * 700) + rest, "after" + rest]
    (tmp_path / "x.csv").write_text("\n".join(texts) + "\n")
    got = csv_records.read_csv_records(spark, str(tmp_path), EXPORT_DDL, exports.READ_OPTIONS).select("title")
    assert sorted(r.title for r in got.collect()) == sorted(["before", "long\n" * 900, '"\n"' * 700, "after"])


def test_quotes_inside_plain_fields_and_blank_lines(spark, tmp_path, small_splits):
    rest = ",1" * (WIDTH - 1)
    lines = ["h" + rest, 'six" nails' + rest, "", 'a"b"c' + rest, "", '5"' + rest, "short,row", *["fill" + rest] * 40]
    (tmp_path / "x.csv").write_text("\n".join(lines))
    path = str(tmp_path)
    assert rows_of(csv_records.read_csv_records(spark, path, EXPORT_DDL, exports.READ_OPTIONS)) == rows_of(whole_files(spark, path))


def test_exports_are_read_by_split_on_request(spark, tmp_path, small_splits):
    """Both ways of reading agree, typed and untyped."""
    rng = random.Random(5)
    (tmp_path / "large").mkdir()
    (tmp_path / "large" / "part-0.csv").write_text(sheet(rng, 60))
    (tmp_path / "small").mkdir()
    (tmp_path / "small" / "part-0.csv").write_text("h" + "," * (WIDTH - 1) + "\n" + "one" + "," * (WIDTH - 1))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for name, cut in (("large", True), ("large", False), ("small", True)):
        path = str(tmp_path / name)
        read = exports.read_csv_text(spark, path, by_split=cut)
        assert ("from_csv" in plan(read)) == cut
        assert rows_of(read) == rows_of(whole_files(spark, path).fillna(""))
        assert rows_of(exports.read_csv_typed(spark, path, by_split=cut)) == rows_of(whole_files(spark, path, EXPORT_TYPED_DDL))
    both = exports.read_csv_glob(spark, str(tmp_path / "*"), by_split=True)
    assert both.count() == 61
