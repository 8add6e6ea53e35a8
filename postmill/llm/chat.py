"""Conversations as prefix trees: shared first turns are written once.

Template of a turn: ``<|im_start|>role`` newline ``text`` ``<|im_end|>`` newline. Inside role and text a
backslash stands before every backslash and between ``<`` and ``|``, and before every line break of a
role, so no text can hold a control string and every text can be had back.

Conversations are sorted by their turns, so those that share first turns lie side by side; a walk over
them is the depth-first walk of their prefix tree. The walk is cut into segments of a bounded number of
characters and nodes. A segment holds its tree flattened, shared turns once:

* ``text``: the turns depth first;
* ``nodes``: per turn ``(start, stop, position, loss_start, loss_stop, attends)``. ``start`` and ``stop``
  bound it in ``text``, ``position`` is the position id of its first character (characters before it in
  its own conversation), the loss mask covers ``loss_start`` to ``loss_stop`` (assistant texts), and
  ``attends`` lists the intervals of its ancestors in ``text``, neighbours merged: a character sees those
  and the earlier ones of its own node;
* ``ends``: ``(conv_id, node, last)``: the conversation runs from its root to that node, and ends there if ``last``;
* ``first_turn``, ``base``, ``before``: 0, 0 and null, or how many turns and characters come before the segment, and a
  hash of those turns.

Cutting a segment repeats the shared turns that its first conversation needs, and nothing else. Copies of
a conversation add an entry to ``ends`` only, and spread over segments like all others.

A conversation of more than ``BLOCK_TURNS`` turns or ``BLOCK_CHARS`` characters is cut into blocks where its turns
pass a multiple of either, so equal beginnings are cut alike. A block is a path like a conversation of its own, in a
segment whose conversations share all turns before it: a character also sees those, and positions count from
``base``. Turns are numbered by row; no conversation is held in one cell or gathered in one task.

A conversation's turns are ordered by turn (nulls first), then role and text. Null roles and
texts are empty. A null conv_id is a conversation of its own. Repeated rows are turns each. An empty table
gives no segments. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.shared import written

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
SEGMENT_CHARS = 1 << 20
SEGMENT_ENDS = 4096
BLOCK_TURNS = 1024
BLOCK_CHARS = 1 << 20

SEGMENTS = (
    "text string, nodes array<struct<start: bigint, stop: bigint, position: bigint, loss_start: bigint, loss_stop: bigint, "
    "attends: array<struct<start: bigint, stop: bigint>>>>, "
    "ends array<struct<conv_id: bigint, node: int, last: boolean>>, first_turn bigint, base bigint, before string"
)
READ = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)
_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\[\s\S])*)\n((?:(?!<\|)[\s\S])*)<\|im_end\|>\n")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\s\S])", r"\1", text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn in its template, and where its text starts and stops."""
    head = f"{START}{escape(role).replace(chr(10), chr(92) + chr(10))}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


NUMBERED = "known boolean, conv_id bigint, turn bigint, role string, text string, part int, idx bigint, start bigint, size bigint"


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``idx`` and ``start``, the turns and formatted characters of their conversation before them."""
    order = ["known", "conv_id", "turn", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, idx, start = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            known, conv, _, role, text = (batch.column(c).to_pylist() for c in order)
            out = []
            for own, r, t in zip(zip(known, conv, strict=True), role, text, strict=True):
                if own != last:
                    last, idx, start = own, 0, 0
                size = len(format_turn(r, t)[0])
                out.append((part, idx, start, size))
                idx, start = idx + 1, start + size
            numbers = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in order], *numbers], [*order, "part", "idx", "start", "size"])

    # A conversation may lie in several ranges: each numbers its own rows, and the ranges before it are added.
    ranged = written(rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, NUMBERED), "turns")
    above = Window.partitionBy("known", "conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = ranged.groupBy("known", "conv_id", "part").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))
    added = total.select(
        "known", "conv_id", "part", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n"), F.coalesce(F.sum("chars").over(above), F.lit(0)).alias("chars")
    )
    return ranged.join(added, ["known", "conv_id", "part"]).withColumn("idx", F.col("idx") + F.col("n")).withColumn("start", F.col("start") + F.col("chars"))


def _cut(rows: DataFrame) -> DataFrame:
    """Blocks of long conversations."""
    block = ["known", "conv_id", "by_turn", "by_char"]
    numbered = _numbered(rows).withColumn("by_turn", F.floor(F.col("idx") / BLOCK_TURNS)).withColumn("by_char", F.floor(F.col("start") / BLOCK_CHARS))
    exact = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    # Sums of hashes of numbered turns name a beginning, however its rows are spread.
    marks = numbered.groupBy(*block).agg(
        F.min("idx").alias("first_turn"), F.min("start").alias("base"), exact("idx", "role", "text").alias("x"), exact("text", "idx", "role").alias("y")
    )
    along = Window.partitionBy("known", "conv_id").orderBy("first_turn")
    above = along.rowsBetween(Window.unboundedPreceding, -1)
    named = marks.select(
        *block, "first_turn", "base", F.concat_ws(" ", F.sum("x").over(above).cast("string"), F.sum("y").over(above).cast("string")).alias("name"),
        F.lead("first_turn").over(along).isNull().alias("last"),
    )
    whole = numbered.groupBy(*block).agg(F.sort_array(F.collect_list(F.struct("idx", "role", "text"))).alias("rows"))
    return whole.join(named, block).select(
        "known", "conv_id", "first_turn", "base", F.when(F.col("first_turn") > 0, F.sha2("name", 256)).alias("before"), "last",
        F.transform("rows", lambda r: F.struct(r.role.alias("role"), r.text.alias("text"))).alias("turns"),
    )


def gathered(conversations: DataFrame) -> DataFrame:
    """``(conv_id, first_turn, base, before, last, turns)``: conversations, long ones in blocks, sorted over the whole
    table by beginning and turns; ``turns`` are ``(role, text)``."""
    key = ["known", "conv_id"]
    rows = conversations.select(
        F.col("conv_id").isNotNull().alias("known"), F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.length("role") + F.length("text")).alias("chars"))
    long = written(sizes.where((F.col("n") > BLOCK_TURNS) | (F.col("chars") > BLOCK_CHARS)).select(*key), "long")
    whole = rows.join(long, key, "left_anti").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows")).select(
        *key, F.lit(0).cast("bigint").alias("first_turn"), F.lit(0).cast("bigint").alias("base"), F.lit(None).cast("string").alias("before"), F.lit(True).alias("last"),
        F.transform("rows", lambda r: F.struct(r.role.alias("role"), r.text.alias("text"))).alias("turns"),
    )
    every = whole.unionByName(_cut(rows.join(long, key, "left_semi"))) if long.head(1) else whole
    # Hashes of all turns of a block place equal beginnings side by side.
    keyed = every.withColumn("conv_id", F.when(F.col("known"), F.col("conv_id"))).withColumn("keys", F.transform("turns", lambda t: F.xxhash64(t.role, t.text)))
    order = ["first_turn", "before", "keys", "conv_id"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "first_turn", "base", "before", "last", "turns")


class _Segment:
    def __init__(self, first_turn: int = 0, base: int = 0, before: str | None = None) -> None:
        self.first_turn, self.base, self.before = first_turn, base, before
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.ends: list[dict] = []

    def add(self, turn: tuple[str, str], above: dict | None) -> dict:
        formatted, body, stop = format_turn(*turn)
        attends = []
        if above is not None:
            attends = [dict(x) for x in above["attends"]]
            if attends and attends[-1]["stop"] == above["start"]:
                attends[-1]["stop"] = above["stop"]
            else:
                attends.append({"start": above["start"], "stop": above["stop"]})
        learned = turn[0] == LEARNED
        node = {
            "start": self.size, "stop": self.size + len(formatted),
            "position": above["position"] + above["stop"] - above["start"] if above else self.base,
            "loss_start": self.size + (body if learned else 0), "loss_stop": self.size + (stop if learned else 0),
            "attends": attends,
        }
        self.parts.append(formatted)
        self.size += len(formatted)
        self.nodes.append(node)
        return node


def segments(conversations: DataFrame) -> DataFrame:
    """The segments of the prefix trees, one row each."""
    nodes_type = pa.list_(pa.struct([
        *[(n, pa.int64()) for n in ("start", "stop", "position", "loss_start", "loss_stop")],
        ("attends", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
    ]))
    ends_type = pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32()), ("last", pa.bool_())]))

    def row(segment: _Segment) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(["".join(segment.parts)]), pa.array([segment.nodes], nodes_type), pa.array([segment.ends], ends_type),
             pa.array([segment.first_turn]), pa.array([segment.base]), pa.array([segment.before], pa.string())],
            ["text", "nodes", "ends", "first_turn", "base", "before"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, path, numbers = _Segment(), [], []  # path: the last conversation's turns, numbers: their nodes
        for batch in batches:
            ids, first, base, before, last = (batch.column(c).to_pylist() for c in ("conv_id", "first_turn", "base", "before", "last"))
            turns = batch.column("turns")
            for i, conv in enumerate(ids):
                own = [(t["role"], t["text"]) for t in turns[i].as_py()]
                place = (first[i], base[i], before[i])
                other = place != (segment.first_turn, segment.base, segment.before)
                if segment.ends and (other or segment.size >= SEGMENT_CHARS or len(segment.ends) >= SEGMENT_ENDS):
                    yield row(segment)
                    segment, path, numbers = _Segment(*place), [], []
                elif other:
                    segment = _Segment(*place)
                shared = 0
                while shared < min(len(path), len(own)) and path[shared] == own[shared]:
                    shared += 1
                path, numbers = path[:shared], numbers[:shared]
                for turn in own[shared:]:
                    segment.add(turn, segment.nodes[numbers[-1]] if numbers else None)
                    path.append(turn)
                    numbers.append(len(segment.nodes) - 1)
                segment.ends.append({"conv_id": conv, "node": numbers[-1], "last": last[i]})
        if segment.ends:
            yield row(segment)

    return gathered(conversations).mapInArrow(run, SEGMENTS)


PIECES = "conv_id bigint, first_turn bigint, last boolean, n_turns bigint, turns string, loss string, stop bigint"


def _pieces(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[tuple]:
    """What segments hold of conversations that they hold ``whole``, or else of the others: fields of ``PIECES``."""
    for batch in batches:
        for i in range(batch.num_rows):
            text, nodes, ends, first = (batch.column(c)[i].as_py() for c in ("text", "nodes", "ends", "first_turn"))
            masks = {n["start"]: (n["loss_start"], n["loss_stop"]) for n in nodes}
            read: dict[int, tuple] = {}
            for end in ends:
                if (first == 0 and end["last"]) != whole:
                    continue
                if end["node"] not in read:
                    node = nodes[end["node"]]
                    loss, turns = [], []
                    for span in [*node["attends"], node]:
                        at = span["start"]
                        while at < span["stop"]:
                            found = _TURN.match(text, at, span["stop"])
                            if not found:
                                raise ValueError("a segment holds no turn where one should start")
                            turns.append(f"{unescape(found[1])}\n{unescape(found[2])}\n")
                            low, high = masks[at]
                            loss.append(unescape(text[low:high]))
                            at = found.end()
                    length = node["position"] + node["stop"] - node["start"]
                    read[end["node"]] = (len(turns), "".join(turns), "".join(loss), length)
                yield (end["conv_id"], first, end["last"], *read[end["node"]])


def read_back(found: DataFrame) -> DataFrame:
    """Per conversation what the segments hold of it: its turns, its text under the loss mask, its length.

    Blocks of a long conversation are read in turn by one task, one block at a time: a digest has no other order.
    """
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])
    pieces = pa.schema([
        ("conv_id", pa.int64()), ("first_turn", pa.int64()), ("last", pa.bool_()), ("n_turns", pa.int64()), ("turns", pa.string()),
        ("loss", pa.string()), ("stop", pa.int64()),
    ])

    def raw(text: str) -> bytes:
        return text.encode("utf-8", "surrogatepass")

    def rows(values: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*values, strict=True), kind, strict=True)], schema=kind)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, str] = {}
            digest = lambda t, known=known: known.get(t) or known.setdefault(t, hashlib.sha256(raw(t)).hexdigest())
            out = []
            for i in range(batch.num_rows):
                out += [(c, n, digest(t), len(x), digest(x), stop) for c, _, _, n, t, x, stop in _pieces(iter([batch.slice(i, 1)]), True)]
                known.clear()
            if out:
                yield rows(out, schema)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, False):
            yield rows([piece], pieces)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, chars, turns, loss = 0, 0, hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            for i in range(batch.num_rows):
                conv, _, last, own, text, learned, stop = (batch.column(c)[i].as_py() for c in pieces.names)
                n, chars = n + own, chars + len(learned)
                turns.update(raw(text))
                loss.update(raw(learned))
                if last:
                    yield rows([(conv, n, turns.hexdigest(), chars, loss.hexdigest(), stop)], schema)
                    n, chars, turns, loss = 0, 0, hashlib.sha256(), hashlib.sha256()

    # Only segments that hold a part of a conversation are read again.
    cut = found.where((F.col("first_turn") > 0) | F.exists("ends", lambda e: ~e.last)).mapInArrow(parts, PIECES)
    ordered = cut.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn")
    return found.mapInArrow(whole, READ).unionByName(ordered.mapInArrow(joined, READ))
