"""Token ids in Huffman-coded blocks.

The file format is a table of independent blocks, sorted by ``(part, block)``, and one table of code
lengths, both Parquet:

* ``lengths``: ``(id, bits)`` for every id in use: a canonical code whose lengths come from the counts of
  all ids and never exceed ``LONGEST`` bits (package-merge). Codes are dealt in order of (length, id).
* ``blocks``: ``(part, block, start, doc_ids, no_id, counts, checkpoints, bits)``. ``start`` is the number of
  ids before the block in the whole output, ``doc_ids``, ``no_id`` and ``counts`` hold its documents'
  ids, which of them are null, and the number of token ids of each; ``bits`` is the code stream, first bit
  highest, and ``checkpoints`` the bit offset of every ``STRIDE``-th token id.

Documents lie in ascending order of doc_id (null first; ties by text), whole, several to a block. Decoding
looks up ``LONGEST`` bits at once in a table of ``2**LONGEST`` entries and runs from all checkpoints of a
block side by side.

Null and empty texts are the end id alone. Rows that repeat a document are stored each. An empty table
gives empty files. Extra columns are not stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.shared import id_bounds
from postmill.llm.wordids import word_ids
from postmill.llm.words import slices

LONGEST = 16
STRIDE = 512
BLOCK_IDS = 1 << 18
ROWS_PER_RANGE = 2_000
END_ID = 1
SLICE_BYTES = 10 << 20

TOKENS = "part int, doc_id bigint, place bigint, n_tokens bigint, ids binary"
BLOCKS = (
    "part int, block int, start bigint, doc_ids array<bigint>, no_id array<boolean>, counts array<bigint>, "
    "checkpoints array<bigint>, bits binary"
)


def code_lengths(counts: dict[int, int], longest: int = LONGEST) -> dict[int, int]:
    """Lengths of the best prefix code with no code over ``longest`` bits, by package-merge."""
    items = sorted((n, i) for i, n in counts.items() if n > 0)
    if len(items) > 1 << longest:
        raise ValueError(f"{len(items)} ids don't fit codes of {longest} bits")
    if len(items) < 2:
        return {i: 1 for _, i in items}
    weights = np.array([n for n, _ in items], dtype=np.int64)
    # rows[d]: is the j-th cheapest entry of round d a package of two entries of the round before?
    rows: list[np.ndarray] = []
    current = weights
    for _ in range(longest - 1):
        pairs = current[: len(current) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weights, pairs])
        order = np.argsort(merged, kind="stable")
        rows.append(order >= len(weights))
        current = merged[order]
    bits = np.zeros(len(weights), np.int64)
    take = 2 * len(weights) - 2
    for packaged in reversed(rows):
        inside = int(packaged[:take].sum())
        bits[: take - inside] += 1
        take = 2 * inside
    bits[:take] += 1
    return {i: int(b) for (_, i), b in zip(items, bits, strict=True)}


class Code:
    """Codes and decoding table of given lengths."""

    def __init__(self, lengths: dict[int, int], longest: int = LONGEST):
        order = sorted(lengths.items(), key=lambda x: (x[1], x[0]))
        size = max(lengths, default=0) + 1
        self.bits, self.codes = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.table_id, self.table_bits = np.zeros(1 << longest, np.uint32), np.zeros(1 << longest, np.int64)
        code, before = 0, 0
        for name, bits in order:
            code <<= bits - before
            before = bits
            self.bits[name], self.codes[name] = bits, code
            low = code << (longest - bits)
            self.table_id[low : low + (1 << (longest - bits))] = name
            self.table_bits[low : low + (1 << (longest - bits))] = bits
            code += 1
        self.longest = longest

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The code stream, and the bit offset of every ``STRIDE``-th id."""
        bits, codes = self.bits[ids], self.codes[ids]
        ends = np.cumsum(bits)
        offsets = ends - bits
        words = np.zeros(int(ends[-1] if len(ends) else 0) // 32 + 2, np.uint64)
        # A code lies in one 32-bit word or in two; sums of disjoint bits are exact in doubles.
        word, shift = offsets >> 5, 64 - (offsets & 31) - bits
        spread = codes.astype(np.uint64) << shift.astype(np.uint64)
        high = np.bincount(word, (spread >> np.uint64(32)).astype(np.float64), len(words))
        low = np.bincount(word + 1, (spread & np.uint64(0xFFFFFFFF)).astype(np.float64), len(words))
        words = (high + low).astype(np.uint64).astype(">u4")
        return words.tobytes()[: -(-int(ends[-1] if len(ends) else 0) // 8)], offsets[::STRIDE]

    def decode(self, stream: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a stream, from all checkpoints at once."""
        data = np.frombuffer(stream + bytes(4), np.uint8).astype(np.uint32)
        # Any 24 bits from a byte on, so that LONGEST bits can start at each of its bits.
        view = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
        out = np.zeros((len(checkpoints), STRIDE), np.uint32)
        at, limit = checkpoints.astype(np.int64), len(view) - 1
        mask, spare = (1 << self.longest) - 1, 24 - self.longest
        for step in range(min(STRIDE, n)):
            window = (view[np.minimum(at >> 3, limit)] >> (spare - (at & 7)).astype(np.uint32)) & mask
            out[:, step] = self.table_id[window]
            at = at + self.table_bits[window]
        return out.ravel()[:n]


def tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """``(part, doc_id, place, n_tokens, ids)`` per document; ``part`` is its range of ids, ``place`` orders equal ids."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    bounds = id_bounds(rows, "doc_id", ROWS_PER_RANGE)
    edges = np.array(bounds or [0], np.int64)
    placed = rows.select("doc_id", F.xxhash64("text").alias("place"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, offsets = encode.batch(part.column("text"))
                ends = offsets[1:]
                with_end = np.insert(ids, ends, end_id).astype("<u2" if ids.max(initial=end_id) < 1 << 16 else "<u4")
                cut = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
                # Ids of 16 bits where they fit; the number of ids tells which.
                data = pa.array([with_end[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())
                names = part.column("doc_id")
                at = np.searchsorted(edges, names.fill_null(int(edges[0])).to_numpy(), side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.maximum(at, 0), pa.int32()), names, part.column("place")] + [pa.array(np.diff(cut), pa.int64()), data],
                    ["part", "doc_id", "place", "n_tokens", "ids"],
                )

    return placed.mapInArrow(run, TOKENS)


def _ids(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def id_counts(found: DataFrame) -> dict[int, int]:
    """How often each id occurs in all documents; one row per id of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1, np.int64)
        for batch in batches:
            for data, n in zip(batch.column("ids").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
                own = np.bincount(_ids(data, n))
                if len(own) > len(counts):
                    counts = np.pad(counts, (0, len(own) - len(counts)))
                counts[: len(own)] += own
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["id", "n"])

    per_task = found.select("ids", "n_tokens").mapInArrow(run, "id bigint, n bigint")
    return {r["id"]: r["n"] for r in per_task.groupBy("id").agg(F.sum("n").alias("n")).collect()}


def encoded(found: DataFrame, lengths: dict[int, int], starts: dict[int, int]) -> DataFrame:
    """Blocks of all documents; ``starts`` holds the number of ids before each range."""
    shared = found.sparkSession.sparkContext.broadcast((lengths, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, starts = shared.value
        code = Code(lengths)
        current, number, start = None, 0, 0
        names: list[int | None] = []
        held: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal number, start, names, held
            ids = np.concatenate(held)
            stream, checkpoints = code.encode(ids)
            out = pa.RecordBatch.from_arrays([
                pa.array([current], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()),
                pa.array([[x or 0 for x in names]], pa.list_(pa.int64())), pa.array([[x is None for x in names]], pa.list_(pa.bool_())),
                pa.array([[len(x) for x in held]], pa.list_(pa.int64())), pa.array([checkpoints], pa.list_(pa.int64())), pa.array([stream], pa.binary()),
            ], ["part", "block", "start", "doc_ids", "no_id", "counts", "checkpoints", "bits"])
            number, start, names, held = number + 1, start + len(ids), [], []
            return out

        size = 0
        for batch in batches:
            for part, name, n, data in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "ids")), strict=True):
                if held and (part != current or size >= BLOCK_IDS):
                    yield block()
                    size = 0
                if part != current:
                    current, number, start = part, 0, starts[part]
                names.append(name)
                held.append(_ids(data, n))
                size += n
        if held:
            yield block()

    order = ["part", F.col("doc_id").asc_nulls_first(), "place"]
    return found.repartition("part").sortWithinPartitions(*order).mapInArrow(run, BLOCKS)


def write_ids(docs: DataFrame, tokenizer: str, path: str, work: str, end_id: int = END_ID) -> None:
    """Writes the files below ``path``; token ids are kept once in ``work`` between counting and coding."""
    spark = docs.sparkSession
    tokens(docs, tokenizer, end_id=end_id).write.option("compression", "zstd").parquet(work)
    found = spark.read.schema(TOKENS).parquet(work)
    lengths = code_lengths(id_counts(found))
    per_part = {r["part"]: r["n"] for r in found.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    starts, before = {}, 0
    for part in sorted(per_part):
        starts[part], before = before, before + per_part[part]
    spark.createDataFrame(sorted(lengths.items()), "id bigint, bits int").coalesce(1).write.parquet(f"{path}/lengths")
    encoded(found, lengths, starts).write.option("compression", "none").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document, from the files; ``ids`` are 32 bits, little-endian."""
    lengths = {r["id"]: r["bits"] for r in spark.read.parquet(f"{path}/lengths").collect()}
    shared = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                start, names, none, counts, checkpoints = (
                    batch.column(c)[i].as_py() for c in ("start", "doc_ids", "no_id", "counts", "checkpoints")
                )
                ids = code.decode(batch.column("bits")[i].as_py(), np.array(checkpoints), sum(counts)).astype("<u4")
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([
                    pa.array([None if x else n for n, x in zip(names, none, strict=True)], pa.int64()),
                    pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                    pa.array([ids[b - n : b].tobytes() for b, n in zip(ends, counts, strict=True)], pa.binary()),
                ], ["doc_id", "start", "n_tokens", "ids"])

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
