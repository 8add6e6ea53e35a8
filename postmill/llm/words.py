"""Words of whole texts as Arrow and numpy columns, used inside Spark tasks."""

from __future__ import annotations

import ctypes
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd multipliers that tell the places of a shingle apart.
_PLACE = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


class Words(NamedTuple):
    """Words of a batch: text ``i`` holds ``index[offsets[i]:offsets[i + 1]]`` into ``distinct``."""

    distinct: pa.Array
    index: np.ndarray
    offsets: np.ndarray


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Runs of characters other than space and U+0009 to U+000D; a null text has none."""
    if texts.offset:  # pyarrow lower-cases a slice of a larger array wrongly
        texts = texts.take(pa.array(np.arange(len(texts))))
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py() if len(parts) else np.zeros(1, np.int64)
    flat = parts.flatten()
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(filled)])
    coded = flat.filter(pa.array(filled)).dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy(), before[bounds])


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all bits; one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in distinct.to_pylist()), np.uint64, len(distinct))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values, by start."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += values[k : k + n] * _PLACE[k]
    return mix(total)


class Sets(NamedTuple):
    """Distinct hashes per text, ascending: text ``i`` holds ``values[offsets[i]:offsets[i + 1]]``."""

    values: np.ndarray
    offsets: np.ndarray


def shingle_sets(texts: pa.Array, width: int) -> Sets:
    """Distinct hashed shingles of ``width`` lower-cased words.

    A text with fewer words has its whole word sequence as one shingle; one without words has none.
    """
    found = words(texts, lower=True)
    n = len(found.offsets) - 1
    flat = hashes(found.distinct)[found.index] if len(found.distinct) else np.empty(0, np.uint64)
    counts = np.diff(found.offsets)
    runs = rolling(flat, width)
    out, size = [], np.zeros(n + 1, np.int64)
    for i, (start, count) in enumerate(zip(found.offsets.tolist(), counts.tolist(), strict=False)):
        if count >= width:
            own = np.sort(runs[start : start + count - width + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif count:
            own = mix(rolling(flat[start : start + count], count) + np.uint64(count))
        else:
            continue
        out.append(own)
        size[i + 1] = len(own)
    return Sets(np.concatenate(out) if out else np.empty(0, np.uint64), np.cumsum(size))


def spread(size: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of ``size`` elements that lie one after the other in a pool, the pool places of the items named by
    ``index`` in turn, and where each item's elements end."""
    begin = np.cumsum(size) - size
    lengths = size[index]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(begin[index] - (ends - lengths), lengths) + np.arange(total), ends


def give_back() -> None:
    """Memory that Arrow and the C library hold free goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int):
    """Parts of a batch whose texts hold about ``most_bytes``; a longer text is a part of its own.

    What the work on a batch has freed goes back to the system after it, as a worker lives on for later stages.
    """
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        limit = (total[start - 1] if start else 0) + most_bytes
        stop = max(start + 1, int(np.searchsorted(total, limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    give_back()
