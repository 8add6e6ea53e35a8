"""Shuffling many small numeric rows as compressed column blobs.

A Spark row of a few numbers costs several times its content in a shuffle. Here a task sorts its rows by
the part of their hash and sends each part's columns as one compressed value; the receiving task gets all
values of a part together and works on whole columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

BLOBS = "part int, n int, data binary"
#: Rows that a task gathers before it packs them.
HELD_BYTES = 16 << 20

Piece = tuple[np.ndarray, list[np.ndarray]]


def parts_for(df: DataFrame) -> int:
    """Parts of a shuffle: twice its partitions, so that parts are small against a task's memory."""
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def packed(part: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of each part as one blob; rows of a part keep their order."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
    ends = np.append(first[1:], len(part))
    packer = zstandard.ZstdCompressor(level=1)
    data = [packer.compress(b"".join(c[a:b].tobytes() for c in columns)) for a, b in zip(first, ends, strict=True)]
    if len(first):
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[first].astype(np.int32)), pa.array((ends - first).astype(np.int32)), pa.array(data, pa.binary())], ["part", "n", "data"]
        )


def gathered(pieces: Iterator[Piece]) -> Iterator[pa.RecordBatch]:
    """Pieces ``(part, columns)`` of a task packed together, ``HELD_BYTES`` at a time.

    A task so sends a blob for each part, not for each piece and part.
    """
    held: list[Piece] = []
    size = 0

    def joined() -> Iterator[pa.RecordBatch]:
        parts, columns = zip(*held, strict=True)
        return packed(np.concatenate(parts), [np.concatenate(c) for c in zip(*columns, strict=True)])

    for part, columns in pieces:
        if not len(part):
            continue
        held.append((part, columns))
        size += part.nbytes + sum(c.nbytes for c in columns)
        if size >= HELD_BYTES:
            yield from joined()
            held, size = [], 0
    if held:
        yield from joined()


def unpacked(rows: list[tuple[int, bytes]], kinds: list[str]) -> list[np.ndarray]:
    """The columns of all blobs of a part."""
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    opener = zstandard.ZstdDecompressor()
    for n, data in rows:
        raw, at = opener.decompress(data), 0
        for i, kind in enumerate(kinds):
            size = np.dtype(kind).itemsize * n
            out[i].append(np.frombuffer(raw, kind, n, at))
            at += size
    return [np.concatenate(c) if c else np.empty(0, k) for c, k in zip(out, kinds, strict=True)]


def by_part(df: DataFrame, work: Callable[[list[np.ndarray]], Iterator], kinds: list[str], schema: str) -> DataFrame:
    """Brings every part's blobs together and runs ``work`` on its columns.

    ``work`` gives batches, or pieces to be packed again where the schema is ``BLOBS``.
    """

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator:
        current, held = None, []
        for batch in batches:
            for part, n, data in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "data")), strict=True):
                if part != current and held:
                    yield from work(unpacked(held, kinds))
                    held = []
                current = part
                held.append((n, data))
        if held:
            yield from work(unpacked(held, kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(results(batches)) if schema == BLOBS else results(batches)

    return df.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)
