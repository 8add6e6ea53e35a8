"""Toxicity scores by a factorization machine over hashed terms.

A document's terms are its distinct lower-cased words, trimmed of punctuation, and the
first four and five letters of each; all are hashed into ``1 << BITS`` bins. The machine
scores a document as ``bias + sum_i w_i + sum_{i<j} <v_i, v_j>`` over its bins, squashed
to 0..1: the factors ``v`` learn pairs of terms that are toxic together only.

* Training reads labels by a join, hashes the texts where they lie and fits on a bounded
  sample: at most ``sample_rows`` labelled rows of each class, those with the smallest
  hash of the id, and at most ``sample_bins`` bins of all of them together, half for each
  class that needs it. Beyond the bounds the fit costs the same at every size.
* The machine learns bins that go with a class, alone or together with another bin. Every pair of bins in the
  sample is looked at, by tasks that take some bins each: a pair counts if its rows lean to a class more than the rows
  of either of its bins do, by a bound that holds for all pairs at once (``PAIR_ODDS``).
* A bin that no training row held has weight and factors 0: a text's unknown terms leave its score alone.
* Scoring is one pass over the texts without a shuffle; the model is ``BINS * (FACTORS + 1)``
  numbers whatever the size of the tables.

Null and empty texts have no terms and score by the bias alone. Repeated rows score alike.
Without labelled rows, or with one class only, every score is the share of toxic rows seen
(0 if none). Extra columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.shared import settle, written
from postmill.llm.words import slices, spread, words

BITS = 18
BINS = 1 << BITS
FACTORS = 4
SAMPLE_ROWS = 8_000
#: Distinct bins of all rows of the sample together: 48 MB on the driver.
SAMPLE_BINS = 12_000_000
MIN_ROWS = 3
CHI2 = 15.0
#: Chance that any pair at all is taken for one that goes with a class while it doesn't.
PAIR_ODDS = 0.05
PAIR_TASKS = 48
TRIM = ".,;:!?()[]{}<>\"'`|*_-"
STEMS = (4, 5)
SLICE_BYTES = 4 << 20


class Model(NamedTuple):
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, bins: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Score before squashing of each document; ``bins`` holds all documents' bins in turn."""
        filled = np.flatnonzero(offsets[1:] > offsets[:-1])
        out = np.full(len(offsets) - 1, self.bias)
        if len(filled):
            starts = offsets[:-1][filled]
            v = self.factors[bins]
            total = np.add.reduceat(v, starts, axis=0)
            squares = np.add.reduceat(v * v, starts, axis=0)
            linear = np.add.reduceat(self.weights[bins], starts)
            out[filled] += linear + 0.5 * (total**2 - squares).sum(axis=1)
        return out

    def scores(self, bins: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(bins, offsets), -30, 30)))


def term_bins(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bins of each text's terms, with offsets per text."""
    found = words(texts, lower=True)
    n = len(found.offsets) - 1
    if not len(found.distinct):
        return np.empty(0, np.int64), np.zeros(n + 1, np.int64)
    digest, cores = xxhash.xxh3_64_intdigest, [w.strip(TRIM) for w in found.distinct.to_pylist()]
    kinds = [(digest(w, 0), digest(w[: STEMS[0]], 1), digest(w[: STEMS[1]], 2)) for w in cores]
    per_word = (np.array(kinds, np.uint64) & np.uint64(BINS - 1)).astype(np.int64)
    out, size = [], np.zeros(n + 1, np.int64)
    seen = np.zeros(BINS, bool)
    for i in range(n):
        own = per_word[found.index[found.offsets[i] : found.offsets[i + 1]]].ravel()
        seen[own] = True
        if len(own) * 64 > BINS:
            own = np.flatnonzero(seen)
        else:
            own = np.sort(own)
            own = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
        seen[own] = False
        out.append(own)
        size[i + 1] = len(own)
    return np.concatenate(out), np.cumsum(size)


def with_bins(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``bins``, an array of the text's bins."""
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("bins", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                bins, offsets = term_bins(part.column(text))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bins, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], lists], [*keep, "bins"])

    return df.select(*keep, text).mapInArrow(run, schema)


def informative(rows: list[tuple[int, np.ndarray]], least: int = MIN_ROWS, chi2: float = CHI2) -> np.ndarray:
    """Which bins have at least ``least`` rows and a presence that goes with a class."""
    counts = np.zeros((2, BINS))
    for y, b in rows:
        counts[y, b] += 1
    size = np.bincount([y for y, _ in rows], minlength=2).astype(float)
    n, present = size.sum(), counts.sum(axis=0)
    expected = size[1] * present / max(n, 1)
    spread = expected * (1 - present / max(n, 1)) * size[0] / max(n, 1)
    return (present >= least) & ((counts[1] - expected) ** 2 >= chi2 * np.maximum(spread, 1e-9))


def _surprise(hits: np.ndarray, n: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Minus log of a bound on the chance of ``hits`` or more among ``n`` at a given share; 0 if no more than expected."""
    n, share = np.maximum(n, 1), np.clip(share, 1e-9, 1 - 1e-9)
    q = np.clip(hits / n, 1e-12, 1 - 1e-12)
    return np.where(q > share, n * (q * np.log(q / share) + (1 - q) * np.log((1 - q) / (1 - share))), 0)


#: Elements that a step of the pair search works on at once.
PAIR_CHUNK = 1 << 20


class Pairs(NamedTuple):
    """What tasks need to look for pairs: the sample's rows by class, with the bins that can be part of any."""

    flat: np.ndarray  # 32 bits, renumbered; the clean rows' bins in turn, then the toxic ones'
    sizes: np.ndarray
    clean: int  # number of clean rows
    names: np.ndarray
    counts: np.ndarray  # rows of each class that hold a bin
    least: float

    @classmethod
    def of(cls, sample: list[tuple[int, np.ndarray]]) -> Pairs:
        ordered = [b for _, b in sorted(sample, key=lambda r: r[0])]
        label = np.bincount([y for y, _ in sample], minlength=2)
        counts = np.zeros((2, BINS), np.int64)
        for y, b in sample:
            counts[y, b] += 1
        many = int((counts.sum(axis=0) > 0).sum())
        least = float(np.log(max(many, 2) ** 2 / PAIR_ODDS))
        # A pair has no more rows of a class than either bin, so a bin with too few can't be part of any.
        share = label / max(len(sample), 1)
        able = (counts * -np.log(np.clip(share, 1e-9, 1 - 1e-9))[:, None] >= least).any(axis=0)
        names = np.flatnonzero(able)
        number = np.zeros(BINS, np.int32)
        number[names] = np.arange(len(names), dtype=np.int32)
        # One row at a time: no second copy of the sample beside the filtered one.
        sizes = np.array([int(able[b].sum()) for b in ordered], np.int32)
        flat, at = np.empty(int(sizes.sum()), np.int32), 0
        for b, size in zip(ordered, sizes.tolist(), strict=True):
            flat[at : at + size] = number[b[able[b]]]
            at += size
        return cls(flat, sizes, int(label[0]), names, counts[:, names], least)

    def _rows_of(self, bins: range) -> dict[int, np.ndarray]:
        """Ascending rows of each of the bins."""
        found = []
        for start in range(0, len(self.flat), PAIR_CHUNK):
            chunk = self.flat[start : start + PAIR_CHUNK]
            found.append(np.flatnonzero(chunk % bins.step == bins.start) + start)
        at = np.concatenate(found) if found else np.empty(0, np.int64)
        row = np.searchsorted(np.cumsum(self.sizes), at, side="right")
        own = self.flat[at]
        order = np.argsort(own, kind="stable")
        row, own = row[order], own[order]
        edges = np.searchsorted(own, np.array([*bins, bins.stop]))
        return {a: row[x:y] for a, x, y in zip(bins, edges[:-1].tolist(), edges[1:].tolist(), strict=True)}

    def _met(self, rows: np.ndarray) -> np.ndarray:
        """How many of the rows hold each bin."""
        met = np.zeros(len(self.names), np.int64)
        ends = np.cumsum(self.sizes[rows], dtype=np.int64)
        start = 0
        while start < len(rows):
            limit = (int(ends[start - 1]) if start else 0) + PAIR_CHUNK
            stop = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
            met += np.bincount(self.flat[spread(self.sizes, rows[start:stop])[0]], minlength=len(met))
            start = stop
        return met

    def partners(self, bins: range) -> np.ndarray:
        """Names of those bins and their partners whose rows in common lean to a class more than either's rows do."""
        n, m = len(self.sizes), len(self.names)
        share = self.counts[1] / np.maximum(self.counts.sum(axis=0), 1)
        overall, found = (n - self.clean) / max(n, 1), np.zeros(m, bool)
        for a, own in self._rows_of(bins).items():
            cut = int(np.searchsorted(own, self.clean))
            clean, bad = self._met(own[:cut]), self._met(own[cut:])
            both = clean + bad
            at = np.flatnonzero((bad * -np.log(max(overall, 1e-9)) >= self.least) | (clean * -np.log(max(1 - overall, 1e-9)) >= self.least))
            at = at[at != a]
            high, low = (f(f(share[at], share[a]), overall) for f in (np.maximum, np.minimum))
            goes = (_surprise(bad[at], both[at], high) >= self.least) | (_surprise(clean[at], both[at], 1 - low) >= self.least)
            if goes.any():
                found[a] = True
                found[at[goes]] = True
        return self.names[found]


def paired(docs: DataFrame, rows: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Which bins go with a class together with another bin."""
    useful = np.zeros(BINS, bool)
    if len({y for y, _ in rows}) < 2:
        return useful
    spark, pairs = docs.sparkSession, Pairs.of(rows)
    shared, many = spark.sparkContext.broadcast(tuple(pairs)), len(pairs.names)
    del pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column("id").to_pylist():
                found = Pairs(*shared.value).partners(range(start, many, PAIR_TASKS))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["bin"])

    found = spark.range(0, min(PAIR_TASKS, many), 1, max(1, min(PAIR_TASKS, many))).mapInArrow(run, "bin bigint").distinct().toArrow()
    useful[found.column("bin").to_numpy()] = True
    shared.destroy()
    return useful


def fit(rows: list[tuple[int, np.ndarray]], steps: int = 2_000, rate: float = 0.1, seed: int = 7) -> Model:
    """Logistic loss, AdaGrad over shuffled mini-batches, both classes weighted to equal mass."""
    label = np.array([y for y, _ in rows], dtype=np.float64)
    share = float(label.mean()) if len(rows) else 0.0
    rng = np.random.default_rng(seed)
    if not 0 < share < 1:
        bias = -30.0 if share == 0 else 30.0
        return Model(bias, np.zeros(BINS), np.zeros((BINS, FACTORS)))
    model = Model(0.0, np.zeros(BINS), rng.normal(0, 0.01, (BINS, FACTORS)))
    bias, bias_sum = float(np.log(share / (1 - share))), 1e-6
    known = np.zeros(BINS, bool)
    for _, b in rows:
        known[b] = True
    model.factors[~known] = 0
    seen_w, seen_v = np.full(BINS, 1e-6), np.full((BINS, FACTORS), 1e-6)
    weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(max(8, steps * 64 // len(rows))):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), 64):
            pick = order[start : start + 64]
            lists = [rows[i][1] for i in pick]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            bins = np.concatenate(lists) if offsets[-1] else np.empty(0, np.int64)
            score = model._replace(bias=bias).scores(bins, offsets)
            # The step of a document is spread over its terms, so long texts don't overshoot.
            slope = (score - label[pick]) * weight[pick]
            bias_sum += float((slope.mean()) ** 2)
            bias -= rate * float(slope.mean()) / bias_sum**0.5
            if not len(bins):
                continue
            owner = np.repeat(np.arange(len(pick)), np.diff(offsets))
            v = model.factors[bins]
            total = np.zeros((len(pick), FACTORS))
            np.add.at(total, owner, v)
            touched, place = np.unique(bins, return_inverse=True)
            step_w = np.bincount(place, slope[owner], len(touched)) + 1e-5 * model.weights[touched]
            step_v = np.stack(
                [np.bincount(place, slope[owner] * (total[owner, k] - v[:, k]), len(touched)) for k in range(FACTORS)], axis=1
            ) + 1e-3 * model.factors[touched]
            seen_w[touched] += step_w**2
            seen_v[touched] += step_v**2
            model.weights[touched] -= rate * step_w / np.sqrt(seen_w[touched])
            model.factors[touched] -= 0.1 * rate * step_v / np.sqrt(seen_v[touched])
    return model._replace(bias=bias)


def sample_of(
    docs: DataFrame, labels: DataFrame, allowed: Column | None, sample_rows: int, sample_bins: int, doc_id: str, text: str, label: str
) -> list[tuple[int, np.ndarray]]:
    """``(label, bins)`` of the sample, a row for each id, label and text.

    The bounds hold after the join, so an id that many rows repeat brings no more of them. The driver chooses by keys
    of some bytes, then takes the chosen rows' bins, 32 bits each and in one copy.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    if allowed is not None:
        known = known.where(allowed)
    known = known.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).distinct()
    known = known.join(docs.select(F.col(doc_id).alias("_id")).distinct(), "_id", "left_semi")
    first = [F.xxhash64("_id"), "_id"]

    def of_each_class(df: DataFrame, *more: str) -> DataFrame:
        parts = [df.where(F.col("_label") == value).orderBy(*first, *more).limit(sample_rows) for value in (0, 1)]
        return parts[0].unionByName(parts[1])

    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_digest"))
    # At most two times sample_rows labels.
    joined = texts.join(F.broadcast(of_each_class(known)), "_id")
    found = written(with_bins(joined, "_text", ["_id", "_label", "_digest"]), "labelled")
    keys = ["_id", "_label", "_digest"]
    chosen = of_each_class(found.groupBy(*keys).agg(F.max(F.size("bins")).alias("n")), "_digest").orderBy("_label", *first, "_digest").collect()
    total = [sum(r.n for r in chosen if r._label == y) for y in (0, 1)]
    room = [max(sample_bins // 2, sample_bins - total[1 - y]) for y in (0, 1)]
    kept, used = [], [0, 0]
    for r in chosen:
        used[r._label] += r.n
        if used[r._label] <= room[r._label]:
            kept.append((r._id, r._label, r._digest))
    schema = T.StructType([found.schema[c] for c in keys])
    once = found.join(F.broadcast(docs.sparkSession.createDataFrame(kept, schema)), keys).groupBy(*keys).agg(F.first("bins").alias("bins"))
    table = once.orderBy(*first, "_label", "_digest").select("_label", "bins").toArrow()
    rows = []
    for answers, lists in zip(table.column("_label").chunks, table.column("bins").chunks, strict=True):
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        rows += [(int(y), flat[a:b]) for y, a, b in zip(answers.to_numpy(), offsets[:-1], offsets[1:], strict=True)]
    return rows


def train(
    docs: DataFrame, labels: DataFrame, allowed: Column | None = None, sample_rows: int = SAMPLE_ROWS,
    doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_bins: int = SAMPLE_BINS,
) -> Model:
    """Fits on at most ``sample_rows`` rows of each class and ``sample_bins`` bins among labelled rows that ``allowed`` admits."""
    rows = sample_of(docs, labels, allowed, sample_rows, sample_bins, doc_id, text, label)
    useful = informative(rows) | paired(docs, rows)
    few = [(y, b[useful[b]]) for y, b in rows]
    del rows
    settle(docs.sparkSession)
    return fit(few)


def _small(model: Model) -> Model:
    return model._replace(weights=model.weights.astype(np.float32), factors=model.factors.astype(np.float32))


def scored(docs: DataFrame, model: Model, keep: list[str], text: str = "text", score: str = "score") -> DataFrame:
    """``keep`` columns of every document and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(_small(model))
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            for part in slices(batch, "_text", SLICE_BYTES):
                value = machine.scores(*term_bins(part.column("_text")))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(len(keep))], pa.array(value, pa.float64())], schema.names
                )

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows whose label may be learned; the rest is held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) != 0


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document."""
    model = train(docs, labels, learnable())
    return scored(docs, model, ["doc_id"]).select(
        "doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Documents scored below the threshold, with all their columns."""
    model = train(docs, labels, learnable())
    shared = docs.sparkSession.sparkContext.broadcast(_small(model))

    @F.arrow_udf(T.DoubleType())
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            whole = pa.RecordBatch.from_arrays([batch], ["text"])
            parts = [shared.value.scores(*term_bins(part.column(0))) for part in slices(whole, "text", SLICE_BYTES)]
            yield pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

    # Only texts go to Python and only scores come back. Positions stand for names, so that none can clash.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = F.col(f"c{docs.columns.index('text')}")
    return plain.withColumn("_score", score(text)).where(F.col("_score") < threshold).drop("_score").toDF(*docs.columns)
