"""Near duplicates: rounds of copies go without the index, and decide as difflib does."""

import random
from difflib import SequenceMatcher

import pytest

from postmill.operators import earliest, fuzzy, summary

DDL = "ord long, title string, company string"


def _kept(texts, threshold):
    kept = []
    for text in texts:
        if not any(SequenceMatcher(None, text, other).ratio() >= threshold for other in kept):
            kept.append(text)
    return kept


def _copies(n):
    """Many copies of a few texts, each with a number of its own."""
    rnd = random.Random(3)
    names = ["glazier for shop windows", "harbour pilot on call", "beekeeper, two orchards", "night porter"]
    return [(i, f"{rnd.choice(names)} {i:04d}", rnd.choice(["Elm Works", "Fern & Sons"])) for i in range(n)]


def test_copies_are_dropped_without_the_index(spark, monkeypatch):
    def index(*_, **__):
        raise AssertionError("candidates were looked up")

    monkeypatch.setattr(fuzzy, "_similar_pairs", index)
    monkeypatch.setattr(fuzzy, "FIRST_BLOCK", 16)
    rows = _copies(600)
    found = fuzzy.dedup_fuzzy(spark.createDataFrame(rows, DDL).repartition(5), 0.8)
    sigs = {f"{title} {company}".lower(): o for o, title, company in rows}
    assert sorted(r["ord"] for r in found.collect()) == sorted(sigs[s] for s in _kept(list(sigs), 0.8))


def test_copies_and_distinct_texts_go_through_rounds_and_index(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "FIRST_BLOCK", 16)
    rnd = random.Random(8)
    rows = _copies(100) + [(100 + i, "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(3, 90))), "Elm") for i in range(120)]
    rows += [(300 + i, rows[i][1][:-1] + "z", rows[i][2]) for i in range(0, 220, 3)] + [(900, None, "Elm"), (901, "Elm", None), (902, None, None)]
    sigs = {}
    for o, title, company in rows:
        sigs.setdefault(" ".join(x.lower() for x in (title, company) if x is not None), o)
    wanted = sorted(sigs[s] for s in _kept(list(sigs), 0.8))
    df = spark.createDataFrame(rows, DDL)
    assert sorted(r["ord"] for r in fuzzy.dedup_fuzzy(df.repartition(3), 0.8).collect()) == wanted
    assert fuzzy.dedup_fuzzy(df.where("false"), 0.8).collect() == []


@pytest.mark.parametrize("threshold", [0.4, 0.7, 0.85])
def test_batches_decide_as_difflib(threshold, monkeypatch):
    monkeypatch.setattr(earliest, "LONG", 140)
    rnd = random.Random(21)
    text = lambda n: "".join(rnd.choice("rstu é★") for _ in range(n))
    kept = ["", "r", *(text(n) for n in (2, 30, 63, 64, 65, 128, 129, 139, 150, 230))]
    rows = ["", "t", "q" * 70]
    for _ in range(150):
        row = list(rnd.choice(kept))
        for _ in range(rnd.randrange(len(row) // 3 + 1)):
            row[rnd.randrange(len(row))] = rnd.choice("rsxy")
        rows.append("".join(row))
    wanted = [any(SequenceMatcher(None, a, b).ratio() >= threshold for b in kept) for a in rows]
    assert earliest.Kept(kept, threshold).similar(rows).tolist() == wanted
    assert not earliest.Kept([], threshold).similar(rows).any()
    distinct = list(dict.fromkeys(rows))
    assert [x for x, k in zip(distinct, earliest.first_wins(distinct, threshold), strict=True) if k] == _kept(distinct, threshold)


def test_summary_makes_its_rows_once(spark):
    df = spark.range(40).selectExpr("id AS ord", "concat('mason ', id % 4) AS title", "'Elm' AS company")
    out = summary.fuzzy_summary(df, 0.99)
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.first().asDict() == {"n_unique": 4, "n_duplicates": 36}
