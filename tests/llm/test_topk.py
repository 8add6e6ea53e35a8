"""Nearest vectors: floors, groups of queries, survivors of the bound."""

import numpy as np
import pytest

from postmill.llm import topk


def clustered(n, width, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width)) * np.linspace(2, 0.1, width)
    return centres[rng.integers(12, size=n)] + rng.normal(size=(n, width)) * 0.1


def brute(ids, whole, asked, k):
    out = {}
    for i in asked:
        score = whole @ whole[i]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), int(score[j])) for j in order]
    return out


@pytest.mark.parametrize(("group", "sample", "rows"), [(topk.GROUP_VALUES, topk.SAMPLE_ROWS, topk.BLOCK_ROWS), (60, 40, 64), (500, 3, 17)])
def test_groups_samples_and_blocks_change_nothing(spark, monkeypatch, group, sample, rows):
    """Many small groups of queries, a sample of fewer rows than asked for and small blocks give the same rows, ties included."""
    for name, value in (("GROUP_VALUES", group), ("SAMPLE_ROWS", sample), ("BLOCK_ROWS", rows)):
        monkeypatch.setattr(topk, name, value)
    vectors = np.round(clustered(600, 12), 1)
    vectors[100:140] = vectors[100]
    frame = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, floor double").repartition(3)
    whole = np.floor(1024 * vectors.astype(np.float32).astype(float)).astype(np.int64)
    got = {}
    for r in topk.top_k(frame, frame["vec_id"] % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(np.arange(600), whole, range(0, 600, 50), 5)


def test_a_floor_is_carried_from_block_to_block():
    whole = np.floor(1024 * clustered(3000, 32))
    axes = topk.principal_axes(whole[:500])
    ids = np.arange(len(whole))
    asked = topk.Asked(ids[:20], whole[:20], np.full(20, -np.inf), axes, 10)
    floors = []
    for start in range(0, 3000, 1000):
        asked.meet(topk.Block(ids[start : start + 1000], whole[start : start + 1000], axes))
        floors.append(asked.floors.copy())
    assert (floors[0] > -np.inf).all() and (floors[1] >= floors[0]).all() and (floors[2] > floors[0]).any()
    expected = brute(ids, whole.astype(np.int64), range(20), 10)
    assert {int(i): list(zip(*(x.tolist() for x in f))) for i, f in zip(asked.ids, asked.found)} == expected


def test_survivors_fall_before_half_of_the_dimensions():
    """On clustered vectors, with the sample's floor, and no candidate that could be among the best goes."""
    whole = np.floor(1024 * clustered(4000, 64))
    axes = topk.principal_axes(whole[::8])
    ids = np.arange(len(whole))
    floors = topk.first_floors(ids[:30], whole[:30], ids[::8], whole[::8], 10)
    block = topk.Block(ids, whole, axes)
    asked = topk.Asked(ids[:30], whole[:30], floors, axes, 10)
    half = []
    for i in range(30):
        seen = []
        alive = block.survivors(asked.turned[i], asked.rest[i], floors[i], seen)
        score = whole @ whole[i]
        assert set(np.flatnonzero(score >= floors[i])) <= set(alive.tolist())
        half.append(seen[64 // topk.DIMENSIONS // 2 - 1])
    assert np.mean(half) < 0.2 * len(whole)


def test_candidates_are_not_shuffled(spark, tmp_path):
    """The only exchange is that of the best rows by query."""
    frame = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id bigint, embedding array<double>")
    plan = topk.top_k(frame, frame["vec_id"] % 10 == 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(query_id" in plan
