"""Removal of word windows that occur earlier in the corpus, found by recompression.

1. Every document is recompressed (``recompress``): symbols name stretches of words alike wherever they
   occur. Each window of ``WINDOW`` words has an anchor, the longest symbol that its own words fix; equal
   windows have equal anchors. Only anchors are shuffled, about one for eight words. The few windows
   without anchor are their own anchor.
2. Windows whose anchor occurs once are unique. The others are compared whole, by 96 bits of hash: the
   first by (doc_id, start) stays, the rest is covered.
3. Covered words are removed from the documents.

Before each shuffle a batch settles what it can by itself: an anchor or window that it holds many times
sends one row, so a passage that a third of all documents share sends one row per batch.

Null doc_ids come before all others. A null text has no words. Rows that repeat a doc_id are one document:
equal ones keep the same words; of two texts under one id, each is judged by its own positions. Texts
shorter than a window lose nothing. Extra columns pass through ``remove_repeats`` unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.blobs import BLOBS, Piece, by_part, gathered, parts_for
from postmill.llm.recompress import anchors, recompress
from postmill.llm.words import hashes, mix, rolling, slices, words

WINDOW = 20
SLICE_BYTES = 6 << 20

#: Anchors: name, rows it stands for (2: several), document key, place. Windows: two hashes, document, key, start.
ANCHOR_KINDS = ["<u8", "i1", "<i8", "<i4"]
WINDOW_KINDS = ["<u8", "<i4", "i1", "<i8", "<i8", "<i4"]
HIT_KINDS = ["<i8", "<i4"]
COVER_KINDS = ["<i8", "<i8", "i1", "<i4"]
HITS = "key bigint, hits array<int>"
COVERS = "key bigint, covers array<struct<doc_id: bigint, starts: array<int>>>"


class _Text:
    """Words of a batch with a wall before each document, and its windows with their anchors."""

    def __init__(self, texts: pa.Array, window: int):
        found = words(texts)
        flat = hashes(found.distinct)[found.index] if len(found.distinct) else np.empty(0, np.uint64)
        n, counts = len(found.offsets) - 1, np.diff(found.offsets)
        self.doc = np.repeat(np.arange(n), counts + 1)
        self.first = found.offsets[:-1] + np.arange(n) + 1
        self.words = np.zeros(len(flat) + n, np.uint64)
        self.wall = np.zeros(len(flat) + n, bool)
        self.wall[self.first - 1] = True
        self.words[~self.wall] = flat
        # Starts of the windows that lie in one document, and which symbol anchors each.
        end = np.repeat(self.first + counts, counts + 1)
        at = np.arange(len(self.words))
        self.starts = at[~self.wall & (at + window <= end)]
        self.symbols = recompress(self.words, self.wall)
        self.anchor = anchors(self.symbols, len(self.words), window)[self.starts]
        self.pos = (self.starts - self.first[self.doc[self.starts]]).astype(np.int64) if len(self.starts) else self.starts

    def hashed(self, window: int, seed: int = 0) -> np.ndarray:
        """A hash of every window."""
        return rolling(mix(self.words + np.uint64(seed)), window)[self.starts] if len(self.starts) else np.empty(0, np.uint64)

    def anchor_places(self) -> np.ndarray:
        """Per window where its anchor starts in the document; ``-1 - start`` of the window if it is its own."""
        if not len(self.starts):
            return np.empty(0, np.int64)
        start = self.symbols.start[self.anchor] - self.first[self.doc[self.starts]]
        return np.where(self.anchor >= 0, start, -1 - self.pos)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """All columns as ``c0, c1, ...`` after ``key``, ``doc_id`` and ``text``."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    name, body = (F.col(f"c{docs.columns.index(c)}") for c in (doc_id, text))
    rest = [c for i, c in enumerate(plain.columns) if docs.columns[i] != text]
    number = name.cast("bigint")
    return plain.select(F.xxhash64(number, body).alias("key"), number.alias("doc_id"), body.alias("text"), *rest)


def _lists(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """First place of each key in order, and the lists of its values."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return first, pa.ListArray.from_arrays(pa.array(np.append(first, len(keys)), pa.int32()), pa.array(values, pa.int32()))


def _anchors_of(part: pa.RecordBatch, window: int, parts: int) -> Piece | None:
    """Rows of the anchors of a slice; what they are worked out from goes with the call, before the next slice."""
    t = _Text(part.column("text"), window)
    if not len(t.starts):
        return None
    key = part.column("key").to_numpy()[t.doc[t.starts]]
    place = t.anchor_places()
    own = t.anchor < 0
    name = np.where(own, t.hashed(window) ^ np.uint64(1), t.symbols.name[t.anchor])
    # One row for each occurrence of an anchor, not for each window that it serves.
    once = own.copy()
    used, first = np.unique(t.anchor[~own], return_index=True)
    once[np.flatnonzero(~own)[first]] = True
    name, key, place = name[once], key[once], place[once]
    distinct, lead, n = np.unique(name, return_index=True, return_counts=True)
    count = np.full(len(name), 2, np.int8)
    count[lead] = np.minimum(n, 2)
    # Further occurrences in this batch are repeats already: they go on under names of their own.
    further = np.ones(len(name), bool)
    further[lead] = False
    name[further] = mix(name[further] + mix(key[further].view(np.uint64) + place[further].astype(np.uint64)))
    return (name % np.uint64(parts)).astype(np.int64), [name, count, key, place.astype("<i4")]


def _rows_of(of_slice: Callable[[pa.RecordBatch, int, int], Piece | None], window: int, parts: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                if (piece := of_slice(part, window, parts)) is not None:
                    yield piece
                del piece

    return lambda batches: gathered(pieces(batches))


def _to_documents(columns: list[np.ndarray], parts: int) -> Piece:
    """Rows whose first column is a document key, dealt by it."""
    return (mix(columns[0].view(np.uint64)) % np.uint64(parts)).astype(np.int64), columns


def _shared_anchors(parts: int):
    def work(columns: list[np.ndarray]) -> Iterator[Piece]:
        """Documents and places of the anchors that occur more than once."""
        name, count, key, place = columns
        order = np.argsort(name, kind="stable")
        name, count, key, place = name[order], count[order], key[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        shared = np.repeat(np.add.reduceat(count.astype(np.int64), first) > 1, np.diff(np.append(first, len(name))))
        yield _to_documents([key[shared], place[shared]], parts)

    return work


def _hit_lists(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    key, place = columns
    order = np.argsort(key, kind="stable")
    first, lists = _lists(key[order], place[order])
    yield pa.RecordBatch.from_arrays([pa.array(key[order][first]), lists], ["key", "hits"])


def _windows_of(part: pa.RecordBatch, window: int, parts: int) -> Piece | None:
    """Rows of the windows of a slice whose anchors are shared."""
    t = _Text(part.column("text"), window)
    if not len(t.starts):
        return None
    lists = part.column("hits")
    owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
    hit = (owner.astype(np.int64) << 32) + lists.flatten().to_numpy()
    shared = np.flatnonzero(np.isin((t.doc[t.starts].astype(np.int64) << 32) + t.anchor_places(), hit))
    if not len(shared):
        return None
    doc = t.doc[t.starts][shared]
    numbers = part.column("doc_id")
    rows = [
        t.hashed(window)[shared], (t.hashed(window, 1)[shared] >> np.uint64(33)).astype("<i4"),
        numbers.is_valid().to_numpy(zero_copy_only=False)[doc].astype(np.int8), numbers.fill_null(0).to_numpy()[doc],
        part.column("key").to_numpy()[doc], t.pos[shared].astype("<i4"),
    ]
    stays = ~_later(rows)
    # A window that this batch holds earlier is sent under a hash of its document: it is covered whatever
    # the others hold, and known by the odd mark.
    name = np.where(stays, rows[0], mix(rows[4].view(np.uint64)))
    known = np.where(stays, rows[2], rows[2] | np.int8(2))
    return (name % np.uint64(parts)).astype(np.int64), [rows[0], rows[1], known, *rows[3:]]


def _later(columns: list[np.ndarray]) -> np.ndarray:
    """Which windows come after an equal one by (doc_id, start); null ids come first."""
    name, extra, known, number, _, pos = columns
    if not len(name):
        return np.zeros(0, bool)
    order = np.lexsort((pos, number, known, extra, name))
    head = np.concatenate([[True], (name[order][1:] != name[order][:-1]) | (extra[order][1:] != extra[order][:-1])])
    first = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    # The same place of a repeated row is not later than itself.
    same = (number[order] == number[first]) & (known[order] == known[first]) & (pos[order] == pos[first])
    out = np.empty(len(name), bool)
    out[order] = ~same
    return out


def _covered(parts: int):
    def work(columns: list[np.ndarray]) -> Iterator[Piece]:
        """Documents and starts of windows that are not the first of their kind."""
        already = columns[2] >= 2
        later = already.copy()
        later[~already] = _later([c[~already] for c in columns])
        known, number, key, pos = (c[later] for c in columns[2:])
        yield _to_documents([key, number, known % np.int8(2), pos], parts)

    return work


def _cover_lists(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((columns[1], columns[2], columns[0]))
    key, number, known, pos = (c[order] for c in columns)
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (number[1:] != number[:-1]) | (known[1:] != known[:-1])])[: len(key)]
    inner = np.flatnonzero(new)
    starts = pa.ListArray.from_arrays(pa.array(np.append(inner, len(key)), pa.int32()), pa.array(pos, pa.int32()))
    cover = pa.StructArray.from_arrays([pa.array(number[inner], mask=known[inner] == 0), starts], ["doc_id", "starts"])
    outer = np.flatnonzero(np.concatenate([[True], key[inner][1:] != key[inner][:-1]])[: len(inner)])
    lists = pa.ListArray.from_arrays(pa.array(np.append(outer, len(inner)), pa.int32()), cover)
    yield pa.RecordBatch.from_arrays([pa.array(key[inner][outer]), lists], ["key", "covers"])


def covers(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(key, covers)``: per document the starts of its windows that occur earlier, with the doc_id they belong to."""
    parts = parts_for(keyed)
    drawn = keyed.mapInArrow(_rows_of(_anchors_of, window, parts), BLOBS)
    shared = by_part(drawn, _shared_anchors(parts), ANCHOR_KINDS, BLOBS)
    hits = by_part(shared, _hit_lists, HIT_KINDS, HITS)
    found = keyed.join(hits, "key").mapInArrow(_rows_of(_windows_of, window, parts), BLOBS)
    later = by_part(found, _covered(parts), WINDOW_KINDS, BLOBS)
    return by_part(later, _cover_lists, COVER_KINDS, COVERS)


def _kept_rows(window: int, kept_as: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                n_words, n_removed, kept = [], [], []
                columns = (part.column(c).to_pylist() for c in ("doc_id", "text", "covers"))
                for number, text, found in zip(*columns, strict=True):
                    own = (text or "").encode().split()
                    starts = [s for c in found or () if c["doc_id"] == number for s in c["starts"]]
                    stay = np.ones(len(own), bool)
                    if starts:
                        change = np.zeros(len(own) + 1, np.int64)
                        at = np.array(starts)
                        at = at[at + window <= len(own)]
                        np.add.at(change, at, 1)
                        np.add.at(change, at + window, -1)
                        stay = np.cumsum(change)[:-1] == 0
                    n_words.append(len(own))
                    n_removed.append(len(own) - int(stay.sum()))
                    kept.append(b" ".join(compress(own, stay)) if n_removed[-1] else b" ".join(own))
                names = [c for c in part.schema.names if c not in ("key", "doc_id", "text", "covers")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string()), part.column("text"), *[part.column(c) for c in names]],
                    ["doc_id", "n_words", "n_removed", kept_as, "text", *names],
                )

    return run


def cut_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, text, c0, c1, ...)``: every document with its kept words.

    The ``c`` columns are the documents' own in their order, without the text.
    """
    keyed = _keyed(docs, doc_id, text)
    schema = T.StructType([
        keyed.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()), keyed.schema["text"], *[f for f in keyed.schema if f.name[0] == "c"],
    ])
    return keyed.join(covers(keyed, window), "key", "left").mapInArrow(_kept_rows(window, "kept"), schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without repeated windows, with all their columns; ``n_chars`` follows the text.

    A document that loses nothing keeps its text as it is.
    """
    found = cut_repeats(docs, window)
    changed = F.col("n_removed") > 0
    out = []
    for i, name in enumerate(docs.columns):
        if name == "text":
            out.append(F.when(changed, F.col("kept")).otherwise(F.col("text")).alias(name))
        elif name == "n_chars":
            kind = docs.schema[i].dataType
            out.append(F.when(changed, F.char_length("kept").cast(kind)).otherwise(F.col(f"c{i}")).alias(name))
        else:
            out.append(F.col(f"c{i}").alias(name))
    return found.select(*out)
