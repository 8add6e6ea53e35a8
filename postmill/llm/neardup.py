"""Near-duplicate documents by HyperMinHash, confirmed on full shingle sets.

1. Each document's set of hashed shingles is sketched: a shingle's hash picks one of ``REGISTERS`` buckets,
   and a bucket keeps its smallest rest as leading-zero count and ``MANTISSA`` further bits. Documents with
   equal sets become one class at once, pre-aggregated before the shuffle.
2. Bands of ``BAND`` compressed registers put classes into buckets. A pair at similarity s shares none of
   the 32 bands with probability (1 - s^4)^32: 6e-11 at 0.85, 5e-8 at 0.8.
3. Pairs are taken from buckets in two turns, the first confirmed before the second: every member with a
   hub of its bucket; then all pairs between different components that still share a bucket, inside tiles
   that return only links which join components. Only pairs whose collision-corrected Jaccard
   estimate is within ``SLACK`` (over five standard deviations) of the threshold are confirmed, and a pair
   comes from the first band it shares. A pair at the threshold is lost by bands or estimate with probability
   1.4e-8 (0.85) or 1.3e-7 (0.8). So a group of many copies costs a few pairs per member, never all
   of them, and no pair between components goes untested. Buckets of more than ``TILE`` members are dealt
   into tiles of two components' members each; nothing is capped.
4. Links are confirmed on the full sets and joined to components.

A text without words has no set and links with nothing. A text with fewer words than a shingle is one
shingle. Rows without doc_id are linked with nothing and have no component. Rows that repeat a doc_id are
judged by their own text each. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.components import components
from postmill.llm.shared import settle, written
from postmill.llm.words import mix, shingle_sets, slices

REGISTERS = 128
MANTISSA = 10
BAND = 4
BANDS = REGISTERS // BAND
EMPTY = 0xFFFF
SLACK = 0.2
HUBS = 4
TILE = 4096
SLICE_BYTES = 6 << 20
#: Expected accidental collisions of a register, times 2^MANTISSA, for sets of equal size.
ACCIDENT = 0.169919487159739

SKETCHES = "doc_id bigint, n bigint, digest binary, registers binary"


def sketch(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Registers of each set, 16 bits each: leading zeros above, mantissa below; ``EMPTY`` without elements."""
    n = len(offsets) - 1
    least = np.full(n * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    spread = mix(values ^ np.uint64(0x5851F42D4C957F2D))
    bucket = np.repeat(np.arange(n) * REGISTERS, np.diff(offsets)) + (spread & np.uint64(REGISTERS - 1)).astype(np.int64)
    np.minimum.at(least, bucket, spread >> np.uint64(11))
    filled = least != np.iinfo(np.uint64).max
    rest = least[filled]  # 53 bits, exact as a double
    zeros = 53 - np.frexp(rest.astype(np.float64))[1]
    bits = ((rest << (zeros + 1).astype(np.uint64)) & np.uint64((1 << 53) - 1)) >> np.uint64(53 - MANTISSA)
    out = np.full(n * REGISTERS, EMPTY, np.uint16)
    out[filled] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | bits.astype(np.uint16)
    return out.reshape(n, REGISTERS)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers: equal ones less those expected to be equal by accident."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=-1)
    equal = ((a == b) & (a != EMPTY)).sum(axis=-1)
    ratio = n_a / np.maximum(n_b, 1)
    by_accident = ACCIDENT / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2 * used
    return np.clip((equal - by_accident) / np.maximum(used - by_accident, 1e-9), 0, 1)


def sketches(docs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                sets = shingle_sets(part.column("text"), width)
                registers = sketch(sets.values, sets.offsets)
                raw, cut = sets.values.astype("<u8").tobytes(), (sets.offsets * 8).tolist()
                digests = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(sets.offsets), pa.int64()), pa.array(digests, pa.binary()),
                     pa.array([r.astype("<u2").tobytes() for r in registers], pa.binary())],
                    ["doc_id", "n", "digest", "registers"],
                )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, SKETCHES)


def _registers(column: pa.Array) -> np.ndarray:
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, "<u2").reshape(-1, REGISTERS)


def _band_hashes(registers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash per set and band, and which bands hold any element."""
    bands = registers.reshape(-1, BANDS, BAND).astype(np.uint64)
    packed = (bands[..., 0] << np.uint64(48)) | (bands[..., 1] << np.uint64(32)) | (bands[..., 2] << np.uint64(16)) | bands[..., 3]
    return mix(packed ^ mix(np.arange(1, BANDS + 1, dtype=np.uint64))), (bands != EMPTY).any(axis=2)


def _members(classes: DataFrame) -> DataFrame:
    """``(key, band, id, size, hub)`` of buckets with several classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, filled = _band_hashes(_registers(batch.column("registers")))
            ids = batch.column("id").to_numpy()
            row, band = np.nonzero(filled)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[row, band].view(np.int64)), pa.array(band.astype(np.int8)), pa.array(ids[row], pa.int64())], ["key", "band", "id"]
            )

    banded = classes.select("id", "registers").mapInArrow(run, "key bigint, band tinyint, id bigint")
    bucket = Window.partitionBy("key")
    return banded.select(
        "*", F.count("*").over(bucket).alias("size"),
        F.min(F.struct(F.xxhash64("id", "band").alias("h"), "id")).over(bucket)["id"].alias("hub"),
    ).where("size > 1")


def _with_estimates(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """``(a, b, likeness)`` of the pairs whose estimate reaches ``least``."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            value = estimate(
                _registers(batch.column("r_a")), _registers(batch.column("r_b")),
                batch.column("n_a").to_numpy().astype(float), batch.column("n_b").to_numpy().astype(float),
            )
            near = value >= least
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(pa.array(near)) for c in ("a", "b")] + [pa.array(value[near])], ["a", "b", "likeness"]
            )

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a bigint, b bigint, likeness double")


TILED = "key bigint, band tinyint, id bigint, part bigint, chunk int, i int, j int, n bigint, registers binary"
TILE_ORDER = ["key", "i", "j"]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table per tile from rows that come tile by tile."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, i, j = (batch.column(c).to_numpy() for c in TILE_ORDER)
        new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        if held and tuple(held[-1].column(c)[-1].as_py() for c in TILE_ORDER) != (key[0], i[0], j[0]):
            yield pa.Table.from_batches(held)
            held = []
        start = 0
        for stop in new.tolist():
            yield pa.Table.from_batches([*held, batch.slice(start, stop - start)])
            held, start = [], stop
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _pairs_of_tile(tile: pa.Table, least: float, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and estimates of the pairs between components whose first shared band is the tile's."""
    ids, part, chunk = (tile.column(c).to_numpy() for c in ("id", "part", "chunk"))
    sizes, registers = tile.column("n").to_numpy().astype(float), _registers(tile.column("registers"))
    band, across = tile.column("band")[0].as_py(), tile.column("i")[0].as_py() != tile.column("j")[0].as_py()
    hashes, filled = _band_hashes(registers)
    left, right, values = [], [], []
    # A tile of two different chunks pairs across them only: each member of the smaller with all of the other.
    ahead = chunk == chunk[0]
    if across and 2 * ahead.sum() > len(ids):
        ahead = ~ahead
    for x in np.flatnonzero(ahead) if across else range(len(ids)):
        fits = (part != part[x]) & (100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x]))
        other = np.flatnonzero(fits & (~ahead if across else ids > ids[x]))
        if not len(other):
            continue
        value = estimate(registers[x], registers[other], np.full(len(other), sizes[x]), sizes[other])
        other, value = other[value >= least], value[value >= least]
        if len(other):
            first = ((hashes[other] == hashes[x]) & filled[x]).argmax(axis=1) == band
            other, value = other[first], value[first]
            left.append(np.full(len(other), x))
            right.append(other)
            values.append(value)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(left), np.concatenate(right), np.concatenate(values)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.searchsorted(large, small)
    return int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0


def _joins_of_tile(tile: pa.Table, least: float, percent: int) -> tuple[list[int], list[int]]:
    """Confirmed links that join components, each pair of components at most once per tile."""
    a, b, value = _pairs_of_tile(tile, least, percent)
    ids, part = tile.column("id").to_pylist(), tile.column("part").to_pylist()
    sets = tile.column("values")
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    read: dict[int, np.ndarray] = {}
    u, v = [], []
    for k in np.argsort(-value, kind="stable"):
        x, y = int(a[k]), int(b[k])
        p, q = top(part[x]), top(part[y])
        if p == q:
            continue
        for z in (x, y):
            if z not in read:
                read[z] = np.frombuffer(sets[z].as_py(), "<u8")
        common = _common(read[x], read[y])
        if 100 * common >= percent * (len(read[x]) + len(read[y]) - common):
            above[max(p, q)] = min(p, q)
            u.append(ids[x])
            v.append(ids[y])
    return u, v


def _dealt(named: DataFrame) -> DataFrame:
    """``(key, band, id, part, chunk, i, j)``: members of mixed buckets, once for each tile of two chunks that they meet in.

    A component of more than ``TILE`` members has chunks of its own, which meet all chunks but each other; the smaller
    ones share chunks. So copies of one component are sent once for each chunk of others, whatever their number.
    """
    size = F.ceil(F.col("n") / TILE).cast("int")
    large = F.when(F.col("n") > TILE, F.struct("part", size.alias("chunks")))
    # Groups are counted before the shuffle, and a bucket lists its few large ones only.
    buckets = named.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.count("*").alias("parts"), F.sort_array(F.collect_list(large)).alias("large"),
        F.ceil(F.sum(F.when(F.col("n") <= TILE, F.col("n")).otherwise(0)) / TILE).cast("int").alias("shared"),
    ).where("parts > 1").drop("parts")
    upto = lambda n: F.aggregate(F.slice("large", 1, n), F.col("shared"), lambda total, x: total + x.chunks)
    placed = named.join(buckets, "key").withColumn("at", F.array_position(F.transform("large", lambda x: x.part), F.col("part")).cast("int"))
    ranged = placed.withColumn("all", upto(F.size("large"))).withColumn(
        "first", F.when(F.col("at") > 0, upto(F.greatest(F.col("at") - 1, F.lit(0)))).otherwise(0)
    ).withColumn("own", F.when(F.col("at") > 0, F.try_element_at("large", F.greatest("at", F.lit(1))).chunks).otherwise(F.col("shared")))
    chunk = ranged.withColumn("chunk", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("own"))).cast("int"))
    other = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda j: (F.col("at") == 0) | (j < F.col("first")) | (j >= F.col("first") + F.col("own")))
    tile = F.transform(other, lambda j: F.struct(F.least("chunk", j).alias("i"), F.greatest("chunk", j).alias("j")))
    return chunk.withColumn("tile", F.explode(tile)).select("key", "band", "id", "part", "chunk", "tile.i", "tile.j")


def _between(members: DataFrame, parts: DataFrame, classes: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    """``(u, v)``: confirmed links that join different components; every pair that could be one is looked at.

    Sketches first tell which members of a bucket have a likely partner in another component; only those get
    their full sets, and a tile returns the links that join components, fewer than it has members.
    """
    named = members.join(parts, "id", "left").select("key", "band", "id", F.coalesce("component", "id").alias("part"))
    dealt = _dealt(named)
    columns = ["key", "band", "id", "part", "chunk", "i", "j", "n", "registers"]
    known = dealt.join(classes.select("id", "n", "registers"), "id").select(*columns)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tiles(batches):
            a, b, _ = _pairs_of_tile(table, least, percent)
            if len(a):
                yield from table.take(pa.array(np.union1d(a, b))).combine_chunks().to_batches()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tiles(batches):
            u, v = _joins_of_tile(table, least, percent)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    together = lambda df: df.repartition(*TILE_ORDER).sortWithinPartitions(*TILE_ORDER, "id")
    found = together(known).mapInArrow(likely, TILED)
    with_sets = found.join(sets.select("id", "values"), "id").select(*columns, "values")
    return together(with_sets).mapInArrow(confirm, "u bigint, v bigint")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(u, v)``: pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("a", "b", "s_a", "s_b")]
            u, v = [], []
            for a, b, raw_a, raw_b in zip(*columns, strict=True):
                x, y = np.frombuffer(raw_a, "<u8"), np.frombuffer(raw_b, "<u8")
                common = _common(x, y)
                if 100 * common >= percent * (len(x) + len(y) - common):
                    u.append(a)
                    v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    side = lambda c: sets.select(F.col("id").alias(c), F.col("values").alias(f"s_{c}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "u bigint, v bigint")


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """``(id, values)``: full sets of the wanted classes ``(id, doc, digest)``, read from the documents that stand for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                sets = shingle_sets(part.column("text"), width)
                raw, cut = sets.values.astype("<u8").tobytes(), (sets.offsets * 8).tolist()
                values = [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(values, pa.binary()), pa.array([xxhash.xxh3_128_digest(x) for x in values], pa.binary())],
                    ["doc", "values", "digest"],
                )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    found = rows.join(wanted.select("doc").distinct(), "doc", "left_semi").mapInArrow(run, "doc bigint, values binary, digest binary")
    return found.join(wanted, ["doc", "digest"]).dropDuplicates(["id", "digest"]).select("id", "values", "digest")


def _grouped(docs: DataFrame, width: int, percent: int, doc_id: str, text: str, apart: bool) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and ``(digest, part)`` of the classes.

    Classes are named by their smallest doc_id, so one document's classes are one; or each by its own number if ``apart``.
    """
    least = percent / 100 - SLACK
    drawn = written(sketches(docs, width, doc_id, text), "sketches")
    grouped = drawn.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("doc"), F.any_value("n").alias("n"), F.any_value("registers").alias("registers")
    )
    every = written(grouped.withColumn("id", F.monotonically_increasing_id() if apart else F.col("doc")), "classes")
    members = written(_members(every), "members")
    classes = written(every.join(members.select("id").distinct(), "id", "left_semi"), "candidates")
    sets = written(_full_sets(docs, classes.select("id", "doc", "digest"), width, doc_id, text), "sets")
    settle(docs.sparkSession)

    hubs = members.where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    near = _with_estimates(hubs, classes, least)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("likeness"), "a")))
    links = written(_confirmed(best.where(F.col("rank") <= HUBS), sets, percent), "links")
    parts = written(components(links), "parts")
    settle(docs.sparkSession)
    more = _between(members, parts, classes, sets, least, percent)
    stars = parts.where("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v"))
    parts = written(components(stars.unionByName(more)), "parts")
    settle(docs.sparkSession)
    return drawn, every.select("digest", "id").join(parts, "id", "left").select("digest", F.coalesce("component", "id").alias("part"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of the documents."""
    drawn, named = _grouped(docs, width, percent, doc_id, text, False)
    return drawn.select("doc_id", "n", "digest").join(named, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("part")).otherwise(F.col("doc_id"))).alias("component_id"),
    )


def _with_digest(docs: DataFrame, width: int, text: str) -> DataFrame:
    """All columns and ``_digest``, that of the row's set."""
    schema = T.StructType([*docs.schema, T.StructField("_digest", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                sets = shingle_sets(part.column(text), width)
                raw, cut = sets.values.astype("<u8").tobytes(), (sets.offsets * 8).tolist()
                digests = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digests, pa.binary())], schema.names)

    return docs.mapInArrow(run, schema)


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near copies, of the smallest id, with all its columns; rows without id stay.

    Rows are judged by their own text, also those that repeat an id: different texts of one id stay side by side, equal
    and near ones are a group. A text without words is a copy only of an equal text of its id.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    name, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    drawn, named = _grouped(plain, width, percent, name, text, True)
    found = written(drawn.where("doc_id IS NOT NULL").select("doc_id", "n", "digest").join(named, "digest", "left"), "groups")
    kept = found.where("n > 0").groupBy("part").agg(F.min(F.struct("doc_id", "digest")).alias("kept")).select("kept.*")
    # Most ids have one text, and stay or go as a whole; only rows of the others are told apart by their sets.
    ids = found.groupBy("doc_id").agg((F.min("digest") != F.max("digest")).alias("several"), F.max("n").alias("n"))
    several = ids.where("several").select(F.col("doc_id").alias("_id"))
    gone = ids.where("NOT several AND n > 0").join(kept, "doc_id", "left_anti").select(F.col("doc_id").alias("_id"))
    rows = plain.where(F.col(name).isNotNull())
    single = rows.join(several.unionByName(gone), F.col(name) == F.col("_id"), "left_anti").withColumn("_digest", F.lit(None).cast("binary"))
    mixed = _with_digest(rows.join(several, F.col(name) == F.col("_id"), "left_semi"), width, text)
    blank = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    own = kept.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_kept"))
    match = (F.col(name) == F.col("_id")) & (F.col("_digest") == F.col("_kept"))
    rest = single.unionByName(mixed.where(~blank).join(own, match, "left_semi")).unionByName(mixed.where(blank))
    copy = Window.partitionBy(name, "_digest", F.when(blank, F.coalesce(F.concat(F.lit("t"), text), F.lit("")))).orderBy(text)
    one = rest.withColumn("_first", F.row_number().over(copy)).where("_first = 1").drop("_first", "_digest")
    return one.unionByName(plain.where(F.col(name).isNull())).toDF(*docs.columns)
