"""Merkle manifest of a dataset: postorder logs of aligned builders, proofs by closed-form places.

Every row is a leaf. The leaves of a group, in order, form a tree in which every two consecutive nodes become the
hash of their hexadecimal digests, the last one alone if their number is odd, until one node is left. The groups'
roots, in order, form a tree of the same kind, whose last node is the root of the manifest.

* **Places.** Leaves are sorted by range and numbered inside each range; the driver adds up one pair of counts a
  range. Equal rows are told apart by a number written with them, so a range never has to hold all of them.
* **Builders.** A builder owns ``1 << LEVELS`` aligned leaves of one group and appends nodes as they are completed,
  each after its children. So the node over leaves ``a .. b`` lies at ``2 a - popcount(a)``, the number of nodes that
  lie wholly before leaf ``a``, plus the size of its own subtree less one: siblings are found by arithmetic, without
  an index. The roots of the builders are the leaves of the next layer, until every group has one builder.
* **Proofs** go from the top down. A builder's row meets the one path that lies above it; its leaves take their
  siblings from its own log. A task holds a few builders (about 80 KB each) whatever the size of a group.

Rows are read once for the leaves; from there on only digests move. Logs are tables written in the shared folder.

Null fields count as ``-``; a null group is a group of its own, the first; null ids come first, equal ids by digest.
Rows that repeat are leaves each. An empty table has no proofs. Extra columns are neither read nor changed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.shared import shared_path, written

#: A builder makes this many levels at most; its row holds ``2 << LEVELS`` digests.
LEVELS = 10
#: Leaves that a range of the sort holds at most, about.
RANGE_ROWS = 1_000_000
NONE, LEFT, RIGHT = 0, 1, 2


def field(c: Column) -> Column:
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*fields: Column) -> Column:
    """Digest of a row's fields as binary."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in fields]).cast("binary"), 256))


def node(*digests: bytes) -> bytes:
    """Hexadecimal digest of hexadecimal digests."""
    return sha256(b"".join(digests)).hexdigest().encode()


def ranked(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds ``_index``, the place of a row in its group in the given order, from 0.

    The rows are a written table, so that every pass sees the same ones.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / RANGE_ROWS))
    place = T.StructType([*df.schema, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, count = (), 0
        for batch in batches:
            local = []
            for name in batch.column(group).to_pylist():
                if (name,) != current:
                    current, count = (name,), 0
                local.append(count)
                count += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64())], place.names)

    ranged = df.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    rows = written(ranged.withColumn("_part", F.spark_partition_id()).mapInArrow(number, place), "ranked")
    keys = [F.col(c) for c in (group, *order)]
    ends = rows.groupBy("_part").agg(
        F.min(F.struct(group)).alias("first"), F.max(F.struct(*keys, "_local")).alias("last")
    ).orderBy("_part").collect()
    bases, before = [], None
    for r in ends:
        base = before[1] if before and before[0] == r.first[0] else 0
        bases.append((r._part, r.first[0], base))
        alone = r.first[0] == r.last[0]
        before = (r.last[0], r.last["_local"] + 1 + (base if alone else 0))
    schema = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_first", df.schema[group].dataType), T.StructField("_base", T.LongType())])
    added = F.when(F.col(group).eqNullSafe(F.col("_first")), F.col("_base")).otherwise(0)
    return rows.join(spark.createDataFrame(bases, schema), "_part").select(*df.columns, (F.col("_local") + added).alias("_index"))


def height_of(block: int, count: int, levels: int = LEVELS) -> int:
    """Levels above the leaves of a builder; all of them where the group has other builders."""
    return levels if block or count == 1 << levels else (count - 1).bit_length()


def widths(count: int, height: int) -> list[int]:
    """Number of nodes of each level."""
    return [-(-count >> level) for level in range(height + 1)]


def completed(digests: list[bytes], height: int) -> list[bytes]:
    """All nodes over some leaves in the order in which they are completed."""
    log: list[bytes] = []
    open_nodes: list[list[bytes]] = [[] for _ in range(height + 1)]

    def put(level: int, digest: bytes) -> None:
        log.append(digest)
        open_nodes[level].append(digest)
        if level < height and len(open_nodes[level]) == 2:
            pair, open_nodes[level] = open_nodes[level], []
            put(level + 1, node(*pair))

    for digest in digests:
        put(0, digest)
    for level in range(height):
        if open_nodes[level]:
            put(level + 1, node(*open_nodes[level]))
    return log


def places(level: int, count: int) -> np.ndarray:
    """Where in a log over ``count`` leaves the nodes of a level lie."""
    first = np.arange(-(-count >> level), dtype=np.int64) << level
    size = np.zeros_like(first)
    for below in range(level + 1):
        size += -(-np.minimum(count - first, 1 << level) >> below)
    ones = np.array([int(a).bit_count() for a in first], np.int64)
    return 2 * first - ones + size - 1


def _builders(rows: DataFrame, group: T.DataType, levels: int) -> DataFrame:
    """``(grp, index, digest, doc_id, altered)`` to one row a builder with its log."""
    schema = T.StructType([
        T.StructField("grp", group), T.StructField("block", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("log", T.BinaryType()),
        T.StructField("root", T.BinaryType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("altered", T.ArrayType(T.BinaryType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def built() -> pa.RecordBatch:
            digests, ids, altered = zip(*held, strict=True)
            log = completed([d.hex().encode() for d in digests], height_of(current[1], len(held), levels))
            row = (current[0], current[1], len(held), bytes.fromhex(b"".join(log).decode()), bytes.fromhex(log[-1].decode()), list(ids), list(altered))
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], out)

        for batch in batches:
            for grp, block, *leaf_row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (grp, block) != current and held:
                    yield built()
                    held = []
                current = (grp, block)
                held.append(leaf_row)
        if held:
            yield built()

    out = pa.schema([
        ("grp", pa.string() if isinstance(group, T.StringType) else pa.int64()), ("block", pa.int64()), ("n", pa.int32()), ("log", pa.binary()),
        ("root", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("altered", pa.list_(pa.binary())),
    ])
    blocked = rows.withColumn("block", F.shiftright("index", levels)).repartition("grp", "block").sortWithinPartitions("grp", "block", "index")
    return blocked.select("grp", "block", "digest", "doc_id", "altered").mapInArrow(run, schema)


def _layers(rows: DataFrame, path: str, levels: int) -> list[DataFrame]:
    """Writes a log table for each layer until every group has one builder."""
    spark, layers = rows.sparkSession, []
    group = rows.schema["grp"].dataType
    while True:
        at = f"{path}-{len(layers)}"
        _builders(rows, group, levels).write.parquet(at)
        layers.append(spark.read.parquet(at))
        if not layers[-1].agg(F.max("block")).first()[0]:
            return layers
        nothing = (F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("altered"))
        rows = layers[-1].select("grp", F.col("block").alias("index"), F.col("root").alias("digest"), *nothing)


def path_entries(log: list[bytes], count: int, height: int) -> list[list[tuple[int, bytes]]]:
    """For each leaf of a builder its siblings from the bottom up, as (side, digest)."""
    levels = [[log[p] for p in places(level, count).tolist()] for level in range(height)]
    out = []
    for leaf_at in range(count):
        own = []
        for level, nodes in enumerate(levels):
            at = leaf_at >> level
            other = at ^ 1
            own.append((RIGHT if other > at else LEFT, nodes[other]) if other < len(nodes) else (NONE, b""))
        out.append(own)
    return out


def packed(path: list[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes([side]) + bytes.fromhex(d.decode()) for side, d in path)


def unpacked(data: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(data):
        size = 32 if data[at] else 0
        out.append((data[at], data[at + 1 : at + 1 + size].hex().encode()))
        at += 1 + size
    return out


def _logs(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[tuple[dict, list[bytes], int]]:
    """Rows of builders with the digests of their logs and their heights."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
            text = row["log"].hex().encode()
            yield row, [text[k : k + 64] for k in range(0, len(text), 64)], height_of(row["block"], row["n"], levels)


def _above(layer: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """``(grp, block, path)`` of the layer below from this layer's logs and the paths above it."""
    schema = T.StructType([layer.schema["grp"], T.StructField("block", T.LongType()), T.StructField("path", T.BinaryType())])
    kind = pa.string() if isinstance(layer.schema["grp"].dataType, T.StringType) else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, log, height in _logs(batches, levels):
            paths = [packed(p) + row["path"] for p in path_entries(log, row["n"], height)]
            first = row["block"] << levels
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["grp"]] * len(paths), kind), pa.array(range(first, first + len(paths)), pa.int64()), pa.array(paths, pa.binary())], schema.names
            )

    return _met(layer, above).select("grp", "block", "n", "log", "path").mapInArrow(run, schema)


def _met(layer: DataFrame, above: DataFrame) -> DataFrame:
    right = above.select(F.col("grp").alias("_grp"), F.col("block").alias("_block"), "path")
    return layer.join(right, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("_block")))


def _down(layers: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """Paths over the builders of the lowest layer."""
    for layer in reversed(layers[1:]):
        above = written(_above(layer, above, levels), "paths")
    return above


def prove(
    docs: DataFrame, fields: Sequence[str], altered_fields: Sequence[Column], is_altered: Column, group: str = "lang",
    doc_id: str = "doc_id", levels: int = LEVELS,
) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root)`` of every row, all hexadecimal.

    ``folded_root`` is folded from the altered row's leaf where ``is_altered``, else from the row's own, and its siblings.
    """
    spark = docs.sparkSession
    altered = F.coalesce(is_altered, F.lit(False))
    leaves = written(docs.select(
        F.col(group).cast("string").alias("grp"), F.col(doc_id).cast("bigint").alias("doc_id"), leaf(*[F.col(c) for c in fields]).alias("digest"),
        F.when(altered, leaf(*altered_fields)).alias("altered"), F.monotonically_increasing_id().alias("tie"),
    ), "leaves")
    rows = ranked(leaves, "grp", ["doc_id", "digest", "tie"]).withColumnRenamed("_index", "index")
    layers = _layers(rows, shared_path(spark, "log"), levels)
    subroots = layers[-1].select(F.lit(0).cast("bigint").alias("all"), F.col("grp").alias("name"), "root")
    tops = written(ranked(subroots, "all", ["name"]), "subroots")
    upper = _layers(tops.select(
        F.col("all").alias("grp"), F.col("_index").alias("index"), F.col("root").alias("digest"), F.col("_index").alias("doc_id"),
        F.lit(None).cast("binary").alias("altered"),
    ), shared_path(spark, "log-of-roots"), levels)
    found = upper[-1].select("root").collect()  # one row, or none from an empty table
    root = found[0].root if found else b""
    # Above the groups' roots, then above the builders of each group.
    start = upper[-1].select("grp", "block", F.lit(b"").alias("path"))
    paths = written(_above(upper[0], _down(upper, start, levels), levels), "paths")
    named = tops.join(paths.withColumnRenamed("block", "_index"), "_index").select(
        F.col("name").alias("grp"), F.lit(0).cast("bigint").alias("block"), "path"
    )
    return _proofs(_met(layers[0], _down(layers, named, levels)), tops, root, levels)


def _proofs(builders: DataFrame, tops: DataFrame, root: bytes, levels: int) -> DataFrame:
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(n, T.StringType()) for n in names[1:]]])
    top = root.hex()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, log, height in _logs(batches, levels):
            above = unpacked(row["path"])
            shared = b"".join(d for _, d in above)
            leaves = [log[p] for p in places(0, row["n"]).tolist()]
            digests, folded = [], []
            for own, altered, path in zip(leaves, row["altered"], path_entries(log, row["n"], height), strict=True):
                digests.append(sha256(b"".join(d for _, d in path) + shared).hexdigest())
                current = own if altered is None else altered.hex().encode()
                for way in (path, above):
                    for side, other in way:
                        current = node(other, current) if side == LEFT else node(current, other)
                folded.append(current.decode())
            n = row["n"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), *[pa.array(c, pa.string()) for c in (
                    [d.decode() for d in leaves], [row["subroot"].hex()] * n, [top] * n, digests, folded
                )]], names,
            )

    roots = tops.select(F.col("name").alias("_name"), F.col("root").alias("subroot"))
    full = builders.join(roots, F.col("grp").eqNullSafe(F.col("_name")))
    return full.select("block", "n", "log", "doc_ids", "altered", "path", "subroot").mapInArrow(run, schema)


def tampered(doc_id: str = "doc_id") -> Column:
    """Rows whose stored copy is changed for the check: those where 7 divides the CRC-32 of the id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 0


def proofs(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Proofs of every document against the manifest, folded from a copy with some ``n_chars`` one too high."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    out = prove(docs, fields, [more if c == "n_chars" else F.col(c) for c in fields], tampered() & F.col("n_chars").isNotNull(), levels=levels)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
