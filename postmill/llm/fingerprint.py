"""Document fingerprints by consistent weighted sampling.

A document's terms are its lower-cased words, weighted by how often they occur. For each of ``SAMPLES``
samples every term draws, from its hash alone, ``r`` and ``c`` from Gamma(2, 1) and ``b`` from [0, 1); with
weight ``w`` it takes ``t = floor(ln w / r + b)`` and ``ln a = ln c - r (t - b) - r``, and the term with the
smallest ``a`` gives the sample ``(term, t)``. Two documents agree in a sample with the probability of
their generalised Jaccard similarity, sum of smaller weights over sum of larger weights. A fingerprint
keeps 16 bits of each sample as hexadecimal digits.

The next document is found by ranges of ascending ids: each range carries one row more, the first of the
range after it, so no range waits for another and none is sorted in one task. Ties of ids are ordered by
text; null ids come first. Null and empty texts have no terms and the all-zero fingerprint; two such
documents are alike (1). A table of one row follows itself. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.shared import id_bounds, place_of
from postmill.llm.words import hashes, mix, words

SAMPLES = 32
ROWS_PER_RANGE = 2_000
SLICE_CHARS = 4 << 20
TABLE_TERMS = 1 << 17

_SALTS = mix(np.arange(1, 5 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(5, SAMPLES)
FOUND = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _uniform(terms: np.ndarray, kind: int) -> np.ndarray:
    """A number in (0, 1) for each term and sample."""
    x = terms[:, None] ^ _SALTS[kind]
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((x >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)


def _sample(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per weighted term and sample: ``a`` in the upper and 16 bits of the sample in the lower bits.

    Half-precision-sized numbers would tie; 32 bits of ``ln a`` as an ordered integer do not, in practice,
    and a tie falls to the smaller sample: equal texts always agree.
    """
    r = -np.log(_uniform(terms, 0) * _uniform(terms, 1))
    ln_c = np.log(-np.log(_uniform(terms, 2) * _uniform(terms, 3)))
    b = _uniform(terms, 4)
    t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + b)
    ln_a = (ln_c - r * (t - b) - r).astype(np.float32)
    raw = ln_a.view(np.uint32)
    ordered = np.where(raw >> np.uint32(31), ~raw, raw | np.uint32(0x80000000)).astype(np.uint64)
    name = mix(terms[:, None] + t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return (ordered << np.uint64(16)) | np.maximum(name, np.uint64(1))


class Sampler:
    """Signatures of texts; samples of terms with small weights are kept, up to ``TABLE_TERMS`` of them."""

    def __init__(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.rows = np.empty((0, SAMPLES), np.uint64)

    def _table(self, keys: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Samples of distinct weighted terms; ``keys`` name term and weight and ascend."""
        at = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        old = self.known[at] == keys if len(self.known) else np.zeros(len(keys), bool)
        out = np.empty((len(keys), SAMPLES), np.uint64)
        out[old] = self.rows[at[old]]
        out[~old] = _sample(terms[~old], weights[~old])
        if len(self.known) + int((~old).sum()) > TABLE_TERMS:
            self.known, self.rows = keys[:TABLE_TERMS], out[:TABLE_TERMS]
        else:
            both = np.concatenate([self.known, keys[~old]])
            order = np.argsort(both)
            self.known, self.rows = both[order], np.concatenate([self.rows, out[~old]])[order]
        return out

    def signatures(self, texts: pa.Array) -> np.ndarray:
        """16-bit samples, one row per text; zeros for a text without words."""
        found = words(texts, lower=True)
        n = len(found.offsets) - 1
        out = np.zeros((n, SAMPLES), np.uint16)
        if not len(found.index):
            return out
        terms = hashes(found.distinct)
        pair = np.repeat(np.arange(n, dtype=np.int64), np.diff(found.offsets)) * len(terms) + found.index
        pair, weight = np.unique(pair, return_counts=True)
        doc, term = pair // len(terms), pair % len(terms)
        key = mix(terms[term] + mix(weight.astype(np.uint64)))
        distinct, first, place = np.unique(key, return_index=True, return_inverse=True)
        table = self._table(distinct, terms[term[first]], weight[first])
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        step = 1 << 18
        cut = [0]
        while cut[-1] < len(starts):
            cut.append(max(cut[-1] + 1, int(np.searchsorted(starts, starts[cut[-1]] + step))))
        for low, high in zip(cut, cut[1:], strict=False):
            begin, stop = starts[low], starts[high] if high < len(starts) else len(doc)
            least = np.minimum.reduceat(table[place[begin:stop]], starts[low:high] - begin, axis=0)
            out[doc[starts[low:high]]] = (least & np.uint64(0xFFFF)).astype(np.uint16)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many characters, or all, of the one that follows."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``(part, ahead, doc_id, text)``: ranges of ascending ids, each followed by one row (``ahead``) of the next."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    bounds = id_bounds(rows, "doc_id", rows_per_range)
    last = max(0, len(bounds) - 1)
    placed = rows.withColumn("at", place_of("doc_id", bounds))
    own = F.struct(F.col("at.part").alias("part"), F.lit(False).alias("ahead"))
    before = F.struct((F.col("at.part") - 1).alias("part"), F.lit(True).alias("ahead"))
    copies = F.when(F.col("at.head") & (F.col("at.part") > 0), F.array(own, before)).otherwise(F.array(own))
    dealt = placed.select(F.explode(copies).alias("to"), "doc_id", "text").select("to.part", "to.ahead", "doc_id", "text")
    first = rows.orderBy(F.col("doc_id").asc_nulls_first(), "text").limit(1)
    around = first.select(F.lit(last).alias("part"), F.lit(True).alias("ahead"), "doc_id", "text")
    return dealt.unionByName(around).repartition("part").sortWithinPartitions(
        "part", "ahead", F.col("doc_id").asc_nulls_first(), "text"
    )


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and how near it is to that and to the next document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        waiting: list[tuple[int | None, str]] = []  # rows of one range whose follower is not here yet

        def finish(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
            """All rows but the last, which only follows."""
            texts = [t for _, t in rows]
            changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
            plain = sampler.signatures(pa.array(texts, pa.string()))
            other = sampler.signatures(pa.array(changed, pa.string()))
            return pa.RecordBatch.from_arrays([
                pa.array([i for i, _ in rows[:-1]], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array([s.astype(">u2").tobytes().hex() for s in plain[:-1]]),
                pa.array([s.astype(">u2").tobytes().hex() for s in other]),
                pa.array(likeness(plain[:-1], other)), pa.array(likeness(plain[:-1], plain[1:])),
            ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        current, closed, size = None, False, 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("part", "ahead", "doc_id", "text"))
            for part, ahead, name, value in zip(*columns, strict=True):
                if part != current:
                    current, closed, waiting, size = part, False, [], 0
                if closed:
                    continue
                waiting.append((name, value))
                size += len(value)
                closed = ahead
                if (closed or size >= SLICE_CHARS) and len(waiting) > 1:
                    yield finish(waiting)
                    waiting, size = waiting[-1:], len(value)

    return in_order(docs, doc_id, text).mapInArrow(run, FOUND)
