"""Secret scan: an Aho-Corasick pass proposes places, anchored patterns are tried there only, checksums confirm.

A ``Kind`` of secret has keywords that open each of its matches. One automaton over the keywords of all kinds reads
every text once; at a hit the kind's pattern is tried at the hit's first character and nowhere else. Hits are taken
from left to right and one inside the last match is passed over, so the matches are those that a leftmost
non-overlapping search of the whole text finds. A match whose checked group is too short is dropped, but its
characters stay used. Kinds with ``check`` keep only matches whose embedded checksum is right.

``hex`` has no keyword. A run of 32 or more covers one of every 32 bytes, so those bytes are looked at, and a run is
measured only around one that is a digit.

Everything works on the UTF-8 bytes, since all patterns are ASCII; places are turned into code points for found
matches. Letters that fold to ASCII ones (the Kelvin sign) are not taken for them. The scan is a map over the rows:
no shuffle, and memory for a few megabytes of text and the longest text. Null and empty texts have no spans; repeated
rows are scanned each; an empty table gives an empty one; extra columns are neither read nor changed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.words import slices

SLICE_BYTES = 4 << 20
SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())
]))
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


class Kind(NamedTuple):
    """``least`` is the smallest size of the pattern's ``group``; ``keywords`` are lower-case openings of a match."""

    name: str
    keywords: tuple[str, ...]
    pattern: bytes
    group: int = 0
    least: int = 0
    check: Callable[[bytes], bool] | None = None


def base62(number: int, width: int) -> str:
    digits = ""
    while number:
        number, rest = divmod(number, 62)
        digits = DIGITS[rest] + digits
    return digits.rjust(width, "0")


def crc_suffix(token: bytes) -> bool:
    """Are the last six characters the CRC-32 of the 30 before them, in base 62?"""
    body, suffix = token[-36:-6], token[-6:]
    return base62(zlib.crc32(body), 6).encode() == suffix


#: Kinds by keyword. The first two are the base kinds that have one; the others carry a checksum.
KINDS = (
    Kind(
        "assign", ("password", "passwd", "secret", "token", "apikey", "api_key"),
        rb"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8,
    ),
    Kind("access", ("akia",), rb"AKIA[A-Z0-9]+", 0, 16),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), rb"gh[pousr]_[A-Za-z0-9]{36}\b", check=crc_suffix),
    Kind("npm", ("npm_",), rb"npm_[A-Za-z0-9]{36}\b", check=crc_suffix),
)
HEX = "hex"
HEX_LEAST = 32
#: Base kinds in the order that settles equal starts; other kinds follow.
BASE = ("assign", "access", HEX)

_HEX_BYTES = b"0123456789abcdef"
_HEX_RUN = re.compile(rb"[0-9a-f]+")
_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(_HEX_BYTES)] = True


def hex_runs(data: bytes, least: int = HEX_LEAST) -> Iterator[tuple[int, int]]:
    """Whole runs of at least ``least`` lower-case hexadecimal digits."""
    probes = np.flatnonzero(_IS_HEX[np.frombuffer(data, np.uint8)[least - 1 :: least]]) * least + least - 1
    end = 0
    for p in probes.tolist():
        if p < end:
            continue
        # A run that began further back would have been met at the probe before.
        low = max(end, p - least + 1)
        start = low + len(data[low:p].rstrip(_HEX_BYTES))
        end = _HEX_RUN.match(data, start).end()
        if end - start >= least:
            yield start, end


class Scanner:
    """All kinds of a scan, ready to read texts."""

    def __init__(self, kinds: Sequence[Kind]):
        self.kinds = kinds
        self.patterns = [re.compile(k.pattern) for k in kinds]
        owners: dict[str, list[int]] = {}
        for i, kind in enumerate(kinds):
            for word in kind.keywords:
                owners.setdefault(word, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for word, which in owners.items():
            self.automaton.add_word(word, (len(word), which))
        if owners:
            self.automaton.make_automaton()
        names = [*BASE, *(k.name for k in kinds if k.name not in BASE)]
        self.order = {name: i for i, name in enumerate(names)}

    def keyword_spans(self, data: bytes) -> Iterator[tuple[str, int, int]]:
        # Bytes as characters of one byte each: places stay those of the bytes, and only A-Z are lowered.
        if not len(self.automaton):
            return
        starts: dict[int, list[int]] = {}
        for last, (size, which) in self.automaton.iter(data.lower().decode("latin-1")):
            for i in which:
                starts.setdefault(i, []).append(last - size + 1)
        for i, places in starts.items():
            kind, end = self.kinds[i], 0
            for start in sorted(places):
                found = self.patterns[i].match(data, start) if start >= end else None
                if not found:
                    continue
                end = found.end()
                if len(found[kind.group]) >= kind.least and (kind.check is None or kind.check(found[0])):
                    yield kind.name, start, end

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """``(kind, start, end)`` in code points, by start, then kind."""
        found = [*self.keyword_spans(data), *((HEX, a, b) for a, b in hex_runs(data))]
        found.sort(key=lambda s: (s[1], self.order[s[0]]))
        if not found or data.isascii():
            return found
        inner = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) == 0x80)
        place = lambda p: p - int(inner[p - 1]) if p else 0
        return [(kind, place(a), place(b)) for kind, a, b in found]


@lru_cache(maxsize=8)
def _scanner(kinds: tuple[Kind, ...]) -> Scanner:
    return Scanner(kinds)


def scan(docs: DataFrame, keep: Sequence[str], text: str = "text", kinds: tuple[Kind, ...] = KINDS, name: str = "spans") -> DataFrame:
    """``keep`` columns and an array of ``(kind, start, end)`` for every row's whole text."""
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(name, SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(kinds)
        for batch in batches:
            for part in slices(batch, "_text", SLICE_BYTES):
                found = [scanner.spans(data or b"") for data in part.column("_text").cast(pa.large_binary()).to_pylist()]
                ends = np.cumsum([0, *map(len, found)])
                columns = list(zip(*[s for own in found for s in own], strict=True)) or [(), (), ()]
                flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW_SPAN, strict=True)], fields=list(_ARROW_SPAN))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], lists], [*keep, name])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def digests(found: DataFrame, spans: str = "spans") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` of scanned documents."""
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    count_of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
    counts = [count_of(kind).alias(f"n_{kind}") for kind in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans")
    )
