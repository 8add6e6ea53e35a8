"""Exact nearest vectors by integer inner product: columnar branch and bound.

Components become ``floor(1024 * x)``. Candidates stay where they are read: a task gathers them in blocks, one row
per dimension inside a block, turned to principal axes, so that the first dimensions hold the most mass. Queries
come to them in groups of at most ``GROUP_VALUES`` components, one group after another. For each block of
dimensions the products of all survivors are added, and a candidate goes when even the largest product that the
remaining dimensions can give (the product of both remaining norms) leaves it below the query's floor. Survivors
are compacted before the next dimensions, and what remains is scored by its whole numbers.

A query's floor is a score that ``k`` candidates are known to reach: first among a sample of at most
``SAMPLE_ROWS`` vectors and ``SAMPLE_VALUES`` components, then among the candidates that its task has seen, carried
from block to block. The axes are fitted on the same sample. Neither changes a result: they only say how early a
candidate goes. A task returns its best of each query, and those of all tasks meet.

Ties go to the smaller id. Null vectors and vectors with null or non-finite components take no part;
shorter ones count as filled up with zeros. Rows without id can't be queries or results. Rows that
repeat an id are candidates each, except for a query of the same id. Scores beyond the range of a long
are held at its ends. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.shared import shared_path, written

SCALE = 1024
#: Most rows and components of a block of candidates.
BLOCK_ROWS = 4096
BLOCK_VALUES = 1 << 20
DIMENSIONS = 8
SAMPLE_ROWS = 16_384
SAMPLE_VALUES = 2 << 20
GROUP_VALUES = 2 << 20
SENT_ROWS = 1 << 16
LONG = 2**63 - 1
#: Share of both norms that covers the rounding of products along the turned axes.
ROUNDING = 1e-9

FOUND = "query_id bigint, vec_id bigint, score bigint"


def whole_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``(vec_id, v)`` with integer components of the vectors that take part."""
    x = F.col(vector).cast("array<double>")
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf)))
    return df.where(F.col(vec_id).isNotNull() & usable).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(c * SCALE).cast("double")).alias("v")
    )


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """One row per vector, filled up with zeros."""
    sizes = lists.value_lengths().to_numpy()
    table = np.zeros((len(lists), width))
    table[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return table


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer product: doubles where they are exact, else long, else Python's integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[-1])
    if most < 2**53:
        return a @ b
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return exact(a) @ exact(b) if a.size and b.size else np.zeros(b.shape[1:], object)


def _scores(query: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Products as longs, held at the ends of their range."""
    found = _product(query, data)
    if found.dtype == object:
        return np.array([max(-LONG - 1, min(LONG, int(s))) for s in found], np.int64)
    return found.astype(np.int64)


def _below(score: float, doubt: float) -> float:
    """A floor that is surely not above a score known within ``doubt``; none where scores are held at the lower end."""
    floor = min(score, float(LONG)) - doubt - abs(score) * 1e-12
    return floor if floor > -float(LONG) else -math.inf


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal axes as columns, those that hold the most of the sample's mass first."""
    _, axes = np.linalg.eigh(sample.T @ sample)
    return axes[:, ::-1]


def rest_norms(turned: np.ndarray) -> np.ndarray:
    """For every block of dimensions (rows) the norm that it and all later ones hold, and a last row of zeros."""
    square = np.add.reduceat(turned**2, np.arange(0, len(turned), DIMENSIONS), axis=0)
    return np.sqrt(np.vstack([np.cumsum(square[::-1], axis=0)[::-1], np.zeros((1, turned.shape[1]))]))


class Block:
    """Candidates dimension by dimension, as whole numbers and along the axes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray):
        self.ids, self.data = ids, np.ascontiguousarray(vectors.T)
        self.turned = axes.T @ self.data
        self.rest = rest_norms(self.turned)

    def survivors(self, turned: np.ndarray, rest: np.ndarray, floor: float, seen: list[int] | None = None) -> np.ndarray:
        """Places of the candidates that may reach the floor; ``seen`` takes their number after each block of dimensions."""
        alive = np.arange(len(self.ids))
        if floor == -math.inf:
            return alive
        partial, room = np.zeros(len(alive)), ROUNDING * rest[0] * self.rest[0] + 1
        for j, start in enumerate(range(0, len(turned), DIMENSIONS)):
            rows = self.turned[start : start + DIMENSIONS]
            partial = partial + turned[start : start + DIMENSIONS] @ (rows if len(alive) == len(self.ids) else rows[:, alive])
            stay = partial + rest[j + 1] * self.rest[j + 1][alive] + room >= floor
            if not stay.all():
                alive, partial, room = alive[stay], partial[stay], room[stay]
            if seen is not None:
                seen.append(len(alive))
            elif not len(alive):
                break
        return alive

    def best(self, query: np.ndarray, own_id: int, alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best of some candidates, without those of the query's own id."""
        alive = alive[self.ids[alive] != own_id]
        if not len(alive):
            return self.ids[:0], np.empty(0, np.int64)
        return first_of(self.ids[alive], _scores(query, self.data[:, alive]), k)


def first_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores, ties to smaller ids."""
    order = np.lexsort((ids, ~scores))[:k]
    return ids[order], scores[order]


def blocks(batches: Iterator[pa.RecordBatch], axes: np.ndarray) -> Iterator[Block]:
    """A task's candidates in blocks."""
    width = len(axes)
    most = max(1, min(BLOCK_ROWS, BLOCK_VALUES // width))
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def block(n: int) -> Block:
        ids, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
        held[:] = [(ids[n:], vectors[n:])]
        return Block(ids[:n], vectors[:n], axes)

    for batch in batches:
        for start in range(0, batch.num_rows, most):
            part = batch.slice(start, most)
            held.append((part.column("vec_id").to_numpy(), _matrix(part.column("v"), width)))
            if sum(len(ids) for ids, _ in held) >= most:
                yield block(most)
    n = sum(len(ids) for ids, _ in held)
    if n:
        yield block(n)


class Asked:
    """A group of queries with what a task has found for them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floors: np.ndarray, axes: np.ndarray, k: int):
        self.ids, self.vectors, self.floors, self.k = ids, vectors, floors.copy(), k
        self.turned = np.ascontiguousarray(vectors @ axes)
        self.rest = np.ascontiguousarray(rest_norms(self.turned.T).T)
        self.found: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(ids)

    def meet(self, block: Block) -> None:
        for i, own_id in enumerate(self.ids):
            alive = block.survivors(self.turned[i], self.rest[i], self.floors[i])
            ids, scores = block.best(self.vectors[i], own_id, alive, self.k)
            if not len(ids):
                continue
            before = self.found[i]
            if before is not None:
                ids, scores = first_of(np.concatenate([before[0], ids]), np.concatenate([before[1], scores]), self.k)
            self.found[i] = ids, scores
            if len(ids) == self.k:
                self.floors[i] = max(self.floors[i], _below(float(scores[-1]), 0))

    def rows(self) -> Iterator[pa.RecordBatch]:
        step = max(1, SENT_ROWS // self.k)
        for start in range(0, len(self.ids), step):
            some = [(own, *f) for own, f in zip(self.ids[start : start + step], self.found[start : start + step], strict=True) if f is not None]
            if some:
                who = np.concatenate([np.full(len(ids), own) for own, ids, _ in some])
                columns = [who, *(np.concatenate([s[c] for s in some]) for c in (1, 2))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])


def first_floors(ids: np.ndarray, vectors: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """A floor for each query: what its ``k`` best of the sample reach."""
    floors = np.full(len(ids), -math.inf)
    longest = np.linalg.norm(sample, axis=1).max(initial=0)
    for start in range(0, len(ids), 64):
        score = vectors[start : start + 64] @ sample.T
        score[ids[start : start + 64, None] == sample_ids] = -math.inf
        if score.shape[1] < k:
            continue
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        for i, s in enumerate(least, start):
            if s > -math.inf:
                floors[i] = _below(float(s), ROUNDING * float(np.linalg.norm(vectors[i])) * longest + 1)
    return floors


def _collected(df: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    table = df.toArrow().combine_chunks()
    lists = table.column("v").combine_chunks()
    return table.column("vec_id").to_numpy(), _matrix(lists if isinstance(lists, pa.Array) else lists.chunk(0), width), table


def top_k(df: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best candidates of every query."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    vectors, queries = (whole_vectors(d, vec_id, vector) for d in (df, df.where(is_query)))
    n, widest = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    n_asked = queries.count()
    path, width = shared_path(spark, "best"), max(1, widest or 0)
    spark.createDataFrame([], FOUND).write.parquet(path)
    if n_asked:
        n_sample = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // width))
        some = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(-(-n // n_sample))) == 0).limit(n_sample)
        sample_ids, sample, _ = _collected(some, width)
        axes = principal_axes(sample)
        fitted = context.broadcast((sample_ids, sample))

        def with_floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = _matrix(batch.column("v"), width)
                floors = first_floors(batch.column("vec_id").to_numpy(), own, *fitted.value, k)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors)], ["vec_id", "v", "floor"])

        groups = -(-n_asked * width // GROUP_VALUES)
        dealt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(groups))
        asked = written(queries.mapInArrow(with_floors, "vec_id bigint, v array<double>, floor double").withColumn("turn", dealt), "asked")
        fitted.destroy()
        for turn in range(groups):
            ids, own, table = _collected(asked.where(F.col("turn") == turn).drop("turn"), width)
            if not len(ids):
                continue
            sent = context.broadcast((ids, own, table.column("floor").to_numpy(), axes))

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                names, values, floors, turned_to = sent.value
                group = Asked(names, values, floors, turned_to, k)
                for block in blocks(batches, turned_to):
                    group.meet(block)
                yield from group.rows()

            vectors.mapInArrow(run, FOUND).write.mode("append").parquet(path)
            sent.destroy()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = spark.read.schema(FOUND).parquet(path)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
