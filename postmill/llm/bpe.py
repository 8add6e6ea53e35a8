"""Byte-level BPE: every distinct word is encoded once for the whole table.

Texts are cut into pre-tokens by JVM expressions; a run of characters that the JVM's older Unicode version doesn't know
is left to the library to cut. A block, the documents of one Arrow batch, keeps its own
list of distinct words and, per document and position, the number of the word in that list. The rows of
all lists are shuffled by word: a word's rows meet, the word is encoded once, and its ids go back to every
block that asked for it. There the positions pick them up again: the ids of a document come in order
without any row per position having been moved. Decoding joins each id with the token-byte table, whose
size the vocabulary bounds.

A hot word has one row per block, however often it occurs. Blocks are bounded by rows and by words; the
two readings of the texts (words, positions) cut them alike, which is checked by the number of words.

Null and empty texts have no ids. Rows that repeat a document are encoded each. An empty table gives no
rows. Extra columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.words import spread

BLOCK_WORDS = 4 << 20
#: Words whose ids are sent at once, and words whose positions are filled at once.
SENT_ROWS = 1 << 18
FILLED_WORDS = 1 << 19
#: Java's \\s and \\S take all Unicode white space under this flag, as the pattern's own engine does.
UNICODE = "(?U)"
#: A run without white space that holds a code point this JVM's Unicode version doesn't know, with the space before it.
#: The library may know it as a letter or a number, so such a run is one word here and the library cuts it.
UNKNOWN = r"\p{Cn}"
UNKNOWN_RUN = r"(?: |(?<!\S))\S*\p{Cn}\S*"

ASKED = "block bigint, word string, local int"
GIVEN = "block bigint, n int, data binary"
PLACES = "block bigint, n_distinct bigint, doc_ids array<bigint>, counts array<bigint>, places binary"
ENCODED = "doc_id bigint, ids binary, decoded binary"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}


def pre_tokens(docs: DataFrame, pattern: str, doc_id: str, text: str) -> DataFrame:
    value = F.coalesce(F.col(text), F.lit(""))
    # No pre-token reaches from other characters into white space, so a run can be cut apart from its text.
    found = F.when(
        value.rlike(UNKNOWN), F.regexp_extract_all(value, F.lit(f"{UNICODE}{UNKNOWN_RUN}|{pattern}"), F.lit(0))
    ).otherwise(F.regexp_extract_all(value, F.lit(UNICODE + pattern), F.lit(0)))
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), found.alias("words"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, pa.Array, np.ndarray]]:
    """Block number, document ids, words per document, distinct words, and the number of each word in them."""
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    for batch in batches:
        counts = pc.list_value_length(batch.column("words")).to_numpy()
        total, start = np.cumsum(counts, dtype=np.int64), 0
        while start < batch.num_rows:
            limit = (int(total[start - 1]) if start else 0) + BLOCK_WORDS
            stop = max(start + 1, int(np.searchsorted(total, limit, side="right")))
            part = batch.slice(start, stop - start)
            coded = part.column("words").flatten().dictionary_encode()
            index = coded.indices.to_numpy()
            # Frequent words get small numbers, which compress better.
            often = np.argsort(-np.bincount(index, minlength=len(coded.dictionary)), kind="stable")
            number_of = np.empty(len(often), np.int64)
            number_of[often] = np.arange(len(often))
            names, sizes = part.column("doc_id").to_pylist(), counts[start:stop].astype(np.int64)
            yield number, names, sizes, coded.dictionary.take(pa.array(often)), number_of[index]
            number, start = number + 1, stop


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, _, _, distinct, _ in _blocks(batches):
        n = len(distinct)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, number)), distinct, pa.array(np.arange(n, dtype=np.int32))], ["block", "word", "local"]
            )


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for number, names, counts, distinct, index in _blocks(batches):
        yield pa.RecordBatch.from_arrays([
            pa.array([number]), pa.array([len(distinct)]), pa.array([names], pa.list_(pa.int64())),
            pa.array([counts], pa.list_(pa.int64())), pa.array([packer.compress(_planes(index))]),
        ], ["block", "n_distinct", "doc_ids", "counts", "places"])


def _given(held: list[tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Per block that asked: numbers of its words, how many ids each has, and the ids, compressed together."""
    block, local = (np.concatenate([h[k] for h in held]) for k in (0, 1))
    words = [w for h in held for w in h[2]]
    before = np.cumsum([0, *[len(h[2]) for h in held]])
    index = np.concatenate([h[3] + n for h, n in zip(held, before, strict=False)])
    size = np.fromiter(map(len, words), np.int64, len(words)) // 4
    pool = np.frombuffer(b"".join(words), "<u4")
    order = np.argsort(block, kind="stable")
    block, local, index = block[order], local[order], index[order]
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    ends, packer, data = np.append(first[1:], len(block)), zstandard.ZstdCompressor(level=1), []
    for a, b in zip(first, ends, strict=True):
        own = index[a:b]
        data.append(packer.compress(_planes(local[a:b]) + _planes(size[own]) + _planes(pool[spread(size, own)[0]])))
    yield pa.RecordBatch.from_arrays(
        [pa.array(block[first]), pa.array((ends - first).astype(np.int32)), pa.array(data, pa.binary())], ["block", "n", "data"]
    )


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers byte place by byte place: the high bytes of small numbers compress to nothing."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _opened(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return _from_planes(raw[: 4 * n]), _from_planes(raw[4 * n : 8 * n]), _from_planes(raw[8 * n :])


def _read_places(data: bytes) -> np.ndarray:
    return _from_planes(zstandard.ZstdDecompressor().decompress(data))


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``(doc_id, ids, decoded)``: ids as 32-bit little-endian integers, and the bytes they decode to."""
    found = pre_tokens(docs, pattern, doc_id, text)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by word: equal words follow one another, and the first is encoded."""
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        last, ids, n_held = None, b"", 0
        held: list[tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]] = []
        for batch in batches:
            coded = batch.column("word").dictionary_encode()
            of_word = []
            for word in coded.dictionary.to_pylist():
                if word != last:
                    last, ids = word, np.array(encoding.encode_ordinary(word), "<u4").tobytes()
                of_word.append(ids)
            held.append((batch.column("block").to_numpy(), batch.column("local").to_numpy(), of_word, coded.indices.to_numpy()))
            n_held += batch.num_rows
            if n_held >= SENT_ROWS:
                yield from _given(held)
                held, n_held = [], 0
        if held:
            yield from _given(held)

    def gather(given: pa.Table, places: pa.Table) -> pa.Table:
        parts = [_opened(n, data) for n, data in zip(given.column("n").to_pylist(), given.column("data").to_pylist(), strict=True)]
        n = sum(len(p[0]) for p in parts)
        if places.num_rows != 1 or n != places.column("n_distinct")[0].as_py():
            raise ValueError("words and positions of a block don't belong together")
        local, size, pool = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(3))
        order = np.argsort(local)
        pool = pool[spread(size, order)[0]].astype("<u4")
        size = size[order]
        index = _read_places(places.column("places")[0].as_py())
        begin = np.cumsum(size) - size
        counts = np.array(places.column("counts")[0].as_py(), np.int64)
        last = np.cumsum(counts)
        table, ids_out, decoded_out, start = token_bytes(ranks_path), [], [], 0
        while start < len(counts):
            before = int(last[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(last, before + FILLED_WORDS, side="right")))
            own = index[before : int(last[stop - 1])]
            lengths = size[own]
            ends = np.cumsum(lengths)
            ids = pool[np.repeat(begin[own] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
            cut = np.concatenate([[0], ends])[np.concatenate([[0], last[start:stop] - before])]
            taken, byte_ends = spread(table.size, ids)
            decoded = table.data[taken]
            byte_cut = np.concatenate([[0], byte_ends])[cut]
            ids_out += [ids[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
            decoded_out += [decoded[a:b].tobytes() for a, b in zip(byte_cut, byte_cut[1:], strict=False)]
            start = stop
        return pa.table([
            places.column("doc_ids").combine_chunks().flatten(), pa.array(ids_out, pa.binary()), pa.array(decoded_out, pa.binary()),
        ], names=["doc_id", "ids", "decoded"])

    given = found.mapInArrow(_asked, ASKED).repartition("word").sortWithinPartitions("word").mapInArrow(give, GIVEN)
    places = found.mapInArrow(_places, PLACES)
    return given.groupBy("block").cogroup(places.groupBy("block")).applyInArrow(gather, ENCODED)


class TokenBytes:
    """The token-byte table: the bytes of id ``i`` are the ``size[i]`` bytes that follow those of the ids before it."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for word, rank in ranks.items():
            by_id[rank] = word
        self.size = np.fromiter(map(len, by_id), np.int64, len(by_id))
        self.data = np.frombuffer(b"".join(by_id), np.uint8)


_TABLES: dict[str, TokenBytes] = {}


def token_bytes(path: str) -> TokenBytes:
    if path not in _TABLES:
        _TABLES[path] = TokenBytes(path)
    return _TABLES[path]


def digests(found: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of encoded documents."""
    return found.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
