"""Sum-of-squares packing of token ids into sequences.

Each task packs its own documents, online: a document's whole windows of ``WINDOW`` ids are closed at
once, and its rest goes where it leaves the sum over fill levels of (number of open windows)^2 smallest,
among the open windows that have room and a new one (ties: the fuller window). An array counts the open
windows of each level. Windows still open at the end, or when more than ``MOST_OPEN`` are, are cut up and
joined into full ones; the ids left over at the end fill sequences whose lengths are powers of two. So
no sequence has padding, and a task holds at most ``MOST_OPEN`` windows.

No shuffle takes place; the sequence number is the task's number and a count, so a task that runs again
gives the same rows.

Null and empty texts are the end id alone. Rows that repeat a document are packed each. An empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.wordids import word_ids
from postmill.llm.words import slices

WINDOW = 4096
MOST_OPEN = 1024
END_ID = 2
SLICE_BYTES = 10 << 20

PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
Piece = tuple[int | None, int, int, np.ndarray]  # document, start, its ids in all, ids


class Packer:
    """Windows of one task."""

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN):
        self.window, self.most_open = window, most_open
        self.levels = np.zeros(window, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """Fill level of the window that ``size`` ids go to; 0 is a new one."""
        n, full = self.levels, self.window - size
        best, change = 0, 2 * int(n[size]) + 1
        if full > 1:
            change_at = 2 * (n[size + 1 : self.window] - n[1:full]) + 2
            change_at[n[1:full] == 0] = np.iinfo(np.int64).max
            last = len(change_at) - 1 - int(np.argmin(change_at[::-1]))
            if change_at[last] <= change:
                best, change = last + 1, int(change_at[last])
        if n[full] and 1 - 2 * int(n[full]) <= change:
            best = full
        return best

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[list[Piece]]:
        """Windows that the document fills."""
        total, start = len(ids), 0
        while total - start >= self.window:
            yield [(doc, start, total, ids[start : start + self.window])]
            start += self.window
        size = total - start
        if not size:
            return
        level = self.level_for(size)
        pieces: list[Piece] = []
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        pieces.append((doc, start, total, ids[start:].copy()))
        if level + size == self.window:
            yield pieces
            return
        self.open.setdefault(level + size, []).append(pieces)
        self.levels[level + size] += 1
        self.n_open += 1
        if self.n_open > self.most_open:
            yield from self.joined()

    def joined(self) -> Iterator[list[Piece]]:
        """Cuts up all open windows into full ones; one at most stays open."""
        pieces = [p for level in sorted(self.open, reverse=True) for window in self.open[level] for p in window]
        self.levels[:], self.open, self.n_open = 0, {}, 0
        room, current = self.window, []
        for doc, start, total, ids in pieces:
            while len(ids) >= room:
                yield [*current, (doc, start, total, ids[:room])]
                start, ids, room, current = start + room, ids[room:], self.window, []
            if len(ids):
                current.append((doc, start, total, ids))
                room -= len(ids)
        if current:
            self.open, self.n_open = {self.window - room: [current]}, 1
            self.levels[self.window - room] = 1

    def rest(self) -> Iterator[list[Piece]]:
        """What is left, in full windows and then in sequences of falling powers of two."""
        yield from self.joined()
        for level, windows in self.open.items():
            sizes = [1 << b for b in range(level.bit_length() - 1, -1, -1) if level >> b & 1]
            current, room = [], sizes.pop(0)
            for doc, start, total, ids in windows[0]:
                while len(ids):
                    part, ids = ids[:room], ids[room:]
                    current.append((doc, start, total, part))
                    start, room = start + len(part), room - len(part)
                    if not room:
                        yield current
                        current, room = [], sizes.pop(0) if sizes else 0


def pack(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID,
) -> DataFrame:
    """Pieces of documents: where each lies in its document and in its sequence, with its ids (32 bits, little-endian)."""
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 40
        encode, packer = word_ids(tokenizer), Packer(window)
        rows: list[tuple] = []

        def emit(pieces: list[Piece]) -> None:
            nonlocal number
            offset = 0
            for doc, start, total, ids in pieces:
                rows.append((doc, start, len(ids), total, number, offset, ids.tobytes()))
                offset += len(ids)
            number += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.binary())], names)

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, offsets = encode.batch(part.column("text"))
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    for full in packer.add(doc, np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4")):
                        emit(full)
                    if len(rows) >= 2048:
                        yield flush()
        for full in packer.rest():
            emit(full)
        if rows:
            yield flush()

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)
