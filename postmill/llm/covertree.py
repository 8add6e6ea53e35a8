"""Product-quantisation codes by Lloyd's rounds over partition-local cover trees.

Components become ``floor(1024 * x)`` and vectors are cut into ``PARTS`` equal consecutive parts. Vectors lie in
blocks of up to ``BLOCK_ROWS``, and a block has a cover tree for each part: a node covers its points within its
radius, its children within ``1 / SHRINK`` of that, and their centres lie farther apart than that. Equal points are
one leaf. Every node has the number and the sum of its points.

A round sends the codebooks (bounded: ``ENTRIES`` a part) to the blocks. The tree is read level by level. At a node
the entries farther from its centre than the nearest one plus twice its radius can't be nearest to any of its points,
by the triangle inequality, so they go; with one entry left the whole subtree is assigned and adds its sum, else the
children meet the entries left. Leaves compare exactly, ties to the lower index. So results are those of comparing
every part with every entry. Blocks and trees are made once and written; a round reads them and shuffles one row for
each entry and task.

Null vectors and vectors with null or non-finite components are dropped; shorter ones are filled up with zeros to the
longest width, which is raised to a multiple of ``PARTS``. Rows without id are kept and come last in the order that
opens the codebooks; equal ids are ordered by components. Rows that repeat count each. With fewer rows than
``ENTRIES`` the codebooks are as short. Components beyond 10^18 are held there, errors at the ends of a long. An empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.shared import written

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK_ROWS = 4096
#: How much smaller than a node's radius its children's radii are at least.
SHRINK = 1.3
#: Pairs of node and entry that are compared at once.
PAIRS = 1 << 17
MOST = 10**18
LONG = 2**63 - 1
#: Covers the rounding of distances.
SAFE = 1e-9


class Tree(NamedTuple):
    """Nodes level by level, children of one node in a row."""

    points: np.ndarray  # distinct points
    size: np.ndarray  # how many rows each stands for
    center: np.ndarray  # a point's place, per node
    radius: np.ndarray
    first: np.ndarray  # child nodes first .. last
    last: np.ndarray
    low: np.ndarray  # points low .. high of ``order`` are covered
    high: np.ndarray
    order: np.ndarray
    count: np.ndarray
    total: np.ndarray


def fitting(values: np.ndarray, width: int) -> np.ndarray:
    """The numbers in a type in which sums of squared differences of ``width`` components are exact."""
    most = int(np.abs(values).max(initial=0))
    bound = width * (2 * most) ** 2
    if bound < 2**53:
        return values.astype(np.float64)
    return values.astype(np.int64) if bound < 2**63 else values.astype(object)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact for numbers out of ``fitting``."""
    d = a - b
    if d.dtype == object:
        return (d * d).sum(axis=1) if len(d) else np.empty(0, object)
    return np.einsum("ij,ij->i", d, d)


def roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def cover_tree(values: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of a part's rows (whole numbers), and the distinct point of each row."""
    points, row_point, size = np.unique(values, axis=0, return_inverse=True, return_counts=True)
    row_point = row_point.reshape(-1)
    exact = fitting(points, points.shape[1])
    center, radius, first, last, low, high = [0], [], [0], [0], [0], [len(points)]
    order = np.arange(len(points))
    at = 0
    while at < len(center):
        lo, hi = low[at], high[at]
        own = order[lo:hi]
        away = roots(squared(exact[own], exact[center[at]][None]))
        radius.append(float(away.max()) * (1 + SAFE))
        first[at] = last[at] = len(center)
        if hi - lo > 1:
            reach = radius[at] / SHRINK
            near = away <= reach
            groups, heads, rest = [own[near]], [center[at]], own[~near]
            while len(rest):
                heads.append(rest[0])
                near = roots(squared(exact[rest], exact[rest[0]][None])) <= reach
                groups.append(rest[near])
                rest = rest[~near]
            order[lo:hi] = np.concatenate(groups)
            last[at] = len(center) + len(groups)
            ends = lo + np.cumsum([len(g) for g in groups])
            for head, end, group in zip(heads, ends.tolist(), groups, strict=True):
                center.append(int(head))
                low.append(end - len(group))
                high.append(end)
                first.append(0)
                last.append(0)
        at += 1
    low_, high_ = np.array(low), np.array(high)
    weights = size[order]
    big = int(np.abs(points).max(initial=0)) * int(size.sum()) >= 2**62
    # Sums over the covered points by running sums along ``order``.
    weighted = points[order].astype(object if big else np.int64) * weights[:, None]
    running = np.concatenate([np.zeros((1, points.shape[1]), weighted.dtype), np.cumsum(weighted, axis=0)])
    counts = np.concatenate([[0], np.cumsum(weights)])
    tree = Tree(
        points, size, np.array(center), np.array(radius), np.array(first), np.array(last), low_, high_, order,
        counts[high_] - counts[low_], running[high_] - running[low_],
    )
    return tree, row_point


def assign(tree: Tree, codebook: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], int]:
    """Nearest entry of every distinct point, the ``(nodes, entries)`` decided at once, and the comparisons made."""
    both = fitting(np.concatenate([tree.points, codebook]), codebook.shape[1])
    points, entries = both[: len(tree.points)], both[len(tree.points) :]
    code = np.empty(len(points), np.int64)
    decided: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = [(np.zeros(len(entries), np.int64), np.arange(len(entries)))]
    compared = 0
    while waiting:
        node, entry = waiting.pop()
        compared += len(node)
        square = squared(points[tree.center[node]], entries[entry])
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        lengths = np.diff(np.append(starts, len(node)))
        nodes = node[starts]
        least = np.minimum.reduceat(square, starts)
        # Entries of a node ascend, so the first of the nearest is the lowest.
        hits = np.flatnonzero(square == np.repeat(least, lengths))
        best = entry[hits[np.searchsorted(hits, starts)]]
        # Entries at the edge stay, so that rounding can't lose one.
        edge = (roots(least) + 2 * tree.radius[nodes]) * (1 + SAFE)
        keep = roots(square) * (1 - SAFE) <= np.repeat(edge, lengths)
        left = np.add.reduceat(keep.astype(np.int64), starts)
        leaf = tree.last[nodes] == tree.first[nodes]
        done = leaf | (left == 1)
        decided.append((nodes[done], best[done]))
        more = np.flatnonzero(~done)
        if not len(more):
            continue
        kept_entries = entry[keep]
        kept_ends = np.cumsum(left)
        children = tree.last[nodes[more]] - tree.first[nodes[more]]
        parents = np.repeat(more, children)
        child = np.arange(len(parents)) - np.repeat(np.cumsum(children) - children, children) + tree.first[nodes[parents]]
        sizes = left[parents]
        begin = 0
        while begin < len(child):
            total = np.cumsum(sizes[begin : begin + PAIRS])
            take = max(1, int(np.searchsorted(total, PAIRS, side="right")))
            some = slice(begin, begin + take)
            lengths_, ends_ = sizes[some], np.cumsum(sizes[some])
            from_ = np.repeat(kept_ends[parents[some]] - lengths_ - (ends_ - lengths_), lengths_) + np.arange(ends_[-1])
            waiting.append((np.repeat(child[some], lengths_), kept_entries[from_]))
            begin += take
    for nodes, best in decided:
        for a, b, e in zip(tree.low[nodes].tolist(), tree.high[nodes].tolist(), best.tolist(), strict=True):
            code[tree.order[a:b]] = e
    return code, decided, compared


def _saved(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _tree_of(loaded, part: int) -> tuple[Tree, np.ndarray]:
    return Tree(*(loaded[f"{part}{name}"] for name in Tree._fields)), loaded[f"{part}rows"]


def whole_vectors(df: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """``(vec_id, label, v)`` with whole components as decimals of the vectors that take part."""
    x = F.col(vector).cast("array<double>")
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf)))
    # Beyond 2^52 a double is whole already, and a product beyond the range is held as all large ones are.
    whole = lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c, F.lit(1e16)), F.lit(-1e16)) * SCALE), F.lit(MOST)), F.lit(-MOST))
    return df.where(usable).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.transform(x, lambda c: whole(c).cast("bigint")).alias("v")
    )


def _blocks(vectors: DataFrame, width: int, rows: int) -> DataFrame:
    """``(ids, labels, data)``: up to ``BLOCK_ROWS`` vectors of one task with their trees."""
    step = width // PARTS
    label_type = vectors.schema["label"].dataType
    schema = f"ids array<bigint>, labels array<{label_type.simpleString()}>, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, labels, lists = (table.column(c).chunk(0) for c in ("vec_id", "label", "v"))
            values = np.zeros((len(ids), width), np.int64)
            lengths = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(ids)), lengths)
            values[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy()
            arrays = {}
            for part in range(PARTS):
                tree, row_point = cover_tree(values[:, part * step : (part + 1) * step])
                arrays |= {f"{part}{name}": a for name, a in zip(Tree._fields, tree, strict=True)} | {f"{part}rows": row_point}
            whole = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), c) for c in (ids, labels)]
            return pa.RecordBatch.from_arrays([*whole, pa.array([_saved(**arrays)], pa.binary())], ["ids", "labels", "data"])

        for batch in batches:
            while batch.num_rows:
                head = batch.slice(0, BLOCK_ROWS - n)
                held.append(head)
                n += head.num_rows
                batch = batch.slice(head.num_rows)
                if n == BLOCK_ROWS:
                    yield block()
                    held, n = [], 0
        if held:
            yield block()

    # Many small partitions would give as many small trees.
    spark = vectors.sparkSession
    tasks = max(-(-rows // BLOCK_ROWS), 2 * spark.sparkContext.defaultParallelism)
    return vectors.coalesce(tasks).mapInArrow(run, schema)


SUMS = "part int, entry int, n bigint, total array<decimal(38,0)>"


def _sums(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Count and sum of the points of every entry: a row for each entry that a task met."""
    from decimal import Decimal

    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def rows(sums: dict[tuple[int, int], list]) -> pa.RecordBatch:
        keys = sorted(sums)
        total = pa.array([[Decimal(int(x)) for x in sums[k][1]] for k in keys], pa.list_(pa.decimal128(38, 0)))
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([int(sums[k][0]) for k in keys], pa.int64()), total],
            ["part", "entry", "n", "total"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for data in batch.column("data"):
                with np.load(io.BytesIO(data.as_buffer()), allow_pickle=True) as loaded:
                    for part, book in enumerate(shared.value):
                        tree, _ = _tree_of(loaded, part)
                        _, decided, _ = assign(tree, book)
                        count, total = np.zeros(len(book), np.int64), np.zeros(book.shape, tree.total.dtype)
                        for nodes, entries in decided:
                            np.add.at(count, entries, tree.count[nodes])
                            np.add.at(total, entries, tree.total[nodes])
                        for e in np.flatnonzero(count).tolist():
                            held = sums.setdefault((part, e), [0, 0])
                            held[0] += int(count[e])
                            held[1] = held[1] + total[e].astype(object)
        if sums:
            yield rows(sums)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for part, entry, n, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = sums.setdefault((part, entry), [0, 0])
                held[0] += n
                held[1] = held[1] + np.array([int(x) for x in total], object)
        if sums:
            yield rows(sums)

    # Every task sends an entry once; all rows of an entry meet in one task, one for each task before.
    return blocks.select("data").mapInArrow(run, SUMS).repartition("part", "entry").mapInArrow(merged, SUMS)


def learned(blocks: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after some rounds; entries without points stay."""
    for _ in range(rounds):
        books = [b.copy() for b in books]
        # At most ENTRIES rows a part.
        for r in _sums(blocks, books).collect():
            books[r.part][r.entry] = [int(x) // r.n for x in r.total]
    return books


def _coded(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``(vec_id, label, code, error)`` of every vector."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    label = blocks.schema["labels"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = (batch.column(c)[i].values for c in ("ids", "labels"))
                codes, error = np.empty((len(ids), PARTS), np.uint8), np.zeros(len(ids), object)
                with np.load(io.BytesIO(batch.column("data")[i].as_buffer()), allow_pickle=True) as loaded:
                    for part, book in enumerate(shared.value):
                        tree, row_point = _tree_of(loaded, part)
                        code, _, _ = assign(tree, book)
                        both = fitting(np.concatenate([tree.points, book]), book.shape[1])
                        far = squared(both[: len(code)], both[len(code) :][code])
                        codes[:, part] = code[row_point]
                        error += np.array([int(x) for x in far], object)[row_point]
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([text[k : k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)], pa.string()),
                     pa.array([min(int(e), LONG) for e in error], pa.int64())],
                    ["vec_id", "label", "code", "error"],
                )

    return blocks.mapInArrow(run, f"vec_id bigint, label {label}, code string, error bigint")


#: A label's rows meet its total in so many groups, so that a label of a third of all rows is not one task.
SALTS = 16


def encode(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of every vector that takes part."""
    vectors = whole_vectors(df, vec_id, vector, label)
    width, rows = vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*")).first()
    width = max(PARTS, -(-width // PARTS) * PARTS)
    step = width // PARTS
    opening = vectors.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    start = np.zeros((len(opening), width), np.int64)
    for i, r in enumerate(opening):
        start[i, : len(r.v)] = r.v
    books = [start[:, p * step : (p + 1) * step] for p in range(PARTS)]
    blocks = written(_blocks(vectors, width, rows), "blocks")
    books = learned(blocks, books)
    digest = sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()
    coded = written(_coded(blocks, books), "coded")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG)).cast("bigint")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    totals = coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")).withColumn("_salt", salts)
    salted = coded.withColumn("_own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(totals, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_own") == F.col("_salt"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
