"""Near-duplicate removal by text similarity, exact and without all-pairs work.

A posting is dropped when the ``title company`` text of an earlier *kept* posting
is similar enough (difflib ratio ``2M / (|a| + |b|)``). Similarity is decided by
difflib itself; the work around it only avoids comparing texts that cannot reach
the threshold, and never loses a pair that can:

* Equal texts collapse first, to the first row by position; the distinct texts are
  then numbered in order of position and text, so no two of them share a number.
* If ``a`` and ``b`` reach the threshold ``t``, their matching blocks cover
  ``M >= t(|a|+|b|)/2`` characters. Between two blocks at least one character is
  unmatched, so there are at most ``|a|+|b|-2M+1`` blocks and the texts share at
  least ``3M-(|a|+|b|)-1`` character pairs, counted with repeats. Two token lists
  with that overlap share a token in their *prefix* once the tokens are put in
  one global order, rarest first. Joining on prefix tokens is therefore lossless.
* While copies dominate, rounds need no index: the first ``FIRST_BLOCK`` undecided rows are
  decided by the rule itself, then one pass over the others drops those similar to a row
  kept from them (``earliest.py``). Rounds go on as long as each halves the rows, so all of
  them cost about as much as the first; what is left goes through the index below.
* There, rows are decided in blocks by position. A block is resolved against itself, then
  everything later that is similar to a kept row of the block is removed at once.
  Dense groups of copies so meet only the few rows kept from them. The number of
  candidate pairs of a block is counted before they are produced, and the block
  shrinks until it is small enough.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.text import let
from postmill.operators.dedup import first_per_group
from postmill.operators.earliest import Kept, common, first_wins, masks as _masks
from postmill.operators.lineage import cut_lineage, passing_steps
from postmill.operators.model import order_columns

FIRST_BLOCK = 256
BLOCK_GROWTH = 8
PAIRS_PER_ROW = 256
FREQUENT_TOKENS = 256
ROWS_PER_TASK = 20_000
ROWS_AT_ONCE = 2_048
# Above this threshold the shared character pairs give a positive bound.
PAIR_TOKEN_LIMIT = 2 / 3


@F.arrow_udf(T.BooleanType())
def _similar(pos: pa.Array, later: pa.Array, earlier: pa.Array, threshold: pa.Array, any_match: pa.Array) -> pa.Array:
    """Does each pair reach the threshold?

    With ``any_match`` one true pair per ``pos`` is enough, so pairs of a row that
    already has one are answered with false unseen.
    """
    a, b, keys = later.to_pylist(), earlier.to_pylist(), pos.to_pylist()
    verdict = [False] * len(a)
    if not a:
        return pa.array(verdict, type=pa.bool_())
    t, one_is_enough = threshold[0].as_py(), any_match[0].as_py()
    matcher, current, done = SequenceMatcher(), None, set()
    masks, prepared = {}, False
    # difflib prepares its second text once: visit pairs by it, frequent ones first.
    often = Counter(b)
    for i in sorted(range(len(b)), key=lambda i: (-often[b[i]], b[i])):
        if one_is_enough and keys[i] in done:
            continue
        if b[i] != current:
            current, prepared = b[i], False
            masks = _masks(current)
        total = len(a[i]) + len(current)
        if 2 * common(masks, len(current), a[i]) < (t - 1e-9) * total:
            continue
        if not prepared:
            matcher.set_seq2(current)
            prepared = True
        matcher.set_seq1(a[i])
        if matcher.ratio() >= t:
            verdict[i] = True
            done.add(keys[i])
    return pa.array(verdict, type=pa.bool_())


def signature() -> Column:
    return F.concat_ws(" ", F.lower(F.col("title")), F.lower(F.col("company")))


def _tokens(sig: Column, threshold: float) -> Column:
    """Hashed character pairs (or characters, for low thresholds), repeats numbered.

    A hash can only merge tokens, which raises the overlap: still lossless.
    """
    width = 2 if threshold > PAIR_TOKEN_LIMIT else 1
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(sig) - (width - 1), F.lit(1))),
        lambda i: F.substr(sig, i, F.lit(width)),
    )
    # In sorted order a repeat's number is its distance from the first equal token.
    return let(
        F.array_sort(grams),
        lambda ordered: F.transform(ordered, lambda g, i: F.xxhash64(g, i - F.array_position(ordered, g))),
    )


def _prefix_length(n_chars: Column, n_tokens: Column, threshold: float) -> Column:
    """Tokens to index so that no similar partner of any allowed length is missed."""
    shortest_total = n_chars * F.lit(2 / (2 - threshold))
    if threshold > PAIR_TOKEN_LIMIT:
        overlap = shortest_total * F.lit(1.5 * threshold - 1) - 1
    else:
        overlap = shortest_total * F.lit(threshold / 2)
    return n_tokens - F.greatest(F.ceil(overlap - F.lit(1e-6)), F.lit(1)) + 1


def _features(sigs: DataFrame, threshold: float, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(pos, sig, n, prefix)`` with prefix tokens in global order, rarest first."""
    tokens = cut(sigs.select("pos", "sig", F.length("sig").alias("n"), _tokens(F.col("sig"), threshold).alias("tokens")))
    # A bounded list: the most frequent tokens go last, all others count as rare.
    frequent = (
        tokens.select(F.explode("tokens").alias("token")).groupBy("token").count()
        .orderBy(F.desc("count"), "token").limit(FREQUENT_TOKENS).collect()
    )
    order = {row["token"]: FREQUENT_TOKENS - i for i, row in enumerate(frequent)}
    ranks = F.create_map(*[F.lit(x) for pair in order.items() for x in pair]) if order else None

    def ranked(t: Column) -> Column:
        rank = F.coalesce(F.try_element_at(ranks, t), F.lit(0)) if order else F.lit(0)
        return F.struct(rank.alias("r"), t.alias("t"))

    in_order = F.array_sort(F.transform("tokens", ranked))
    length = _prefix_length(F.col("n"), F.size("tokens"), threshold).cast("int")
    return tokens.select("pos", "sig", "n", F.transform(F.slice(in_order, F.lit(1), length), lambda s: s.t).alias("prefix"))


def _spread(rows: DataFrame, total: int) -> DataFrame:
    """Parts by row count: comparing texts costs far more than their bytes suggest."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-total // ROWS_PER_TASK)))


def _indexed(rows: DataFrame, side: str) -> DataFrame:
    return rows.select(
        F.explode(F.array_distinct("prefix")).alias("token"),
        *[F.col(c).alias(f"{side}_{c}") for c in ("pos", "sig", "n", "prefix")],
    )


def _similar_pairs(later: DataFrame, earlier: DataFrame, threshold: float, any_match: bool = False) -> DataFrame:
    """Verified ``(later, earlier)`` positions, each pair produced at one token only.

    With ``any_match`` at least one pair of every later row that has one.
    """
    total = F.col("l_n") + F.col("e_n")
    candidates = _indexed(later, "l").join(_indexed(earlier, "e"), "token").where(
        (F.col("l_pos") > F.col("e_pos"))
        & (F.least("l_n", "e_n") * 2 >= total * F.lit(threshold - 1e-9))
        & (F.try_element_at(F.array_intersect("l_prefix", "e_prefix"), F.lit(1)) == F.col("token"))
    )
    return candidates.where(_similar("l_pos", "l_sig", "e_sig", F.lit(threshold), F.lit(any_match))).select(
        F.col("l_pos").alias("later"), F.col("e_pos").alias("earlier")
    )


def _candidate_count(rows: DataFrame) -> int:
    per_token = rows.select(F.explode(F.array_distinct("prefix")).alias("token")).groupBy("token").count()
    return per_token.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0


def _next_block(undecided: DataFrame, total: int, size: int) -> tuple[DataFrame, int | None, int]:
    """Earliest rows whose candidate pairs stay within budget, with the cut position."""
    while True:
        cut = None
        block = undecided
        if size < total:
            cut = undecided.agg(F.percentile_approx("pos", F.lit(size / total), F.lit(10_000))).first()[0]
            block = undecided.where(F.col("pos") <= cut)
        if size <= FIRST_BLOCK or _candidate_count(block) <= PAIRS_PER_ROW * size:
            return block, cut, size
        size = max(min(size, total) // 4, FIRST_BLOCK)


def _resolve(block: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of the block kept by the sequential rule.

    Every round keeps the rows without an earlier open neighbour and drops their
    neighbours; pairs of dropped rows disappear. Pairs point to smaller positions,
    so some row is always free and the rounds end.
    """
    with passing_steps(block.sparkSession) as cut:
        open_pairs = cut(pairs)
        kept = block
        while not open_pairs.isEmpty():
            waiting = open_pairs.select(F.col("later").alias("earlier"))
            free = open_pairs.select("earlier").join(waiting, "earlier", "left_anti").distinct()
            dropped = cut(open_pairs.join(free, "earlier", "left_semi").select("later").distinct())
            kept = kept.join(dropped, kept["pos"] == dropped["later"], "left_anti")
            open_pairs = cut(
                open_pairs.join(dropped, "later", "left_anti").join(
                    dropped.select(F.col("later").alias("earlier")), "earlier", "left_anti"
                )
            )
        return cut_lineage(kept)


def _decided_first(undecided: DataFrame, threshold: float) -> DataFrame:
    """Of the first ``FIRST_BLOCK`` rows ``(pos, sig)``, whether each is kept. One task, for their number is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pa.Table.from_batches([*batches], schema=columns).sort_by("pos").combine_chunks().to_batches():
            sigs = rows.column("sig").to_pylist()
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(first_wins(sigs, threshold), pa.bool_())], ["pos", "sig", "kept"])

    columns = pa.schema([("pos", pa.int64()), ("sig", pa.string())])
    block = undecided.select("pos", "sig").orderBy("pos").limit(FIRST_BLOCK)
    return block.coalesce(1).mapInArrow(run, "pos bigint, sig string, kept boolean")


def _without_similar(rows: DataFrame, kept: list[str], threshold: float) -> DataFrame:
    """Rows ``(pos, sig)`` similar to none of the kept texts, which all stand before them; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Kept(kept, threshold)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                yield part.filter(pa.array(~known.similar(part.column("sig").to_pylist())))

    return rows.select("pos", "sig").mapInArrow(run, "pos bigint, sig string")


def dedup_fuzzy(df: DataFrame, threshold: float = 0.85) -> DataFrame:
    """First-wins removal of postings similar to an earlier kept posting."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    order = order_columns(df)
    signed = df.withColumn("_sig", signature())
    tie = [c for c, kind in signed.dtypes if "map<" not in kind]
    if threshold == 1:  # only equal texts are that similar
        return first_per_group(signed, [F.col("_sig")], order, tie=tie).drop("_sig")
    # Numbers rise with the range-sorted rows; written at once, they stay as they are.
    texts = signed.groupBy(F.col("_sig").alias("sig"))
    place = F.min(F.struct(*order)) if order else F.lit(0)
    sorted_sigs = texts.agg(place.alias("at")).orderBy("at", "sig")
    kept, early, size = None, [], FIRST_BLOCK
    # The rows still undecided; their table goes when the next one is written.
    with ExitStack() as table:
        undecided = table.enter_context(passing_steps(df.sparkSession))(sorted_sigs.select(F.monotonically_increasing_id().alias("pos"), "sig"))
        total = undecided.count()
        before = 2 * total
        while total and 2 * total <= before:
            block = _decided_first(undecided, threshold).collect()
            winners = [row["sig"] for row in block if row["kept"]]
            early += winners
            rest = _spread(undecided.where(F.col("pos") > block[-1]["pos"]), total)
            last = table.pop_all()
            with last:
                undecided = table.enter_context(passing_steps(df.sparkSession))(_without_similar(rest, winners, threshold))
            before, total = total, undecided.count()
        if total:
            with passing_steps(df.sparkSession) as step:
                last = table.pop_all()
                with last:
                    undecided = table.enter_context(passing_steps(df.sparkSession))(_features(_spread(undecided, total), threshold, step))
        while (total := undecided.count()) > 0:
            block, cut, size = _next_block(undecided, total, size)
            winners = _resolve(block, _similar_pairs(block, block, threshold))
            kept = winners.select("sig") if kept is None else kept.union(winners.select("sig"))
            if cut is None:
                break
            rest = undecided.where(F.col("pos") > cut)
            losers = _similar_pairs(rest, winners, threshold, any_match=True).select(F.col("later").alias("pos")).distinct()
            before = table.pop_all()
            with before:
                undecided = table.enter_context(passing_steps(df.sparkSession))(_spread(rest.join(losers, "pos", "left_anti"), total))
            size *= BLOCK_GROWTH
    found = df.sparkSession.createDataFrame(pa.table({"_sig": pa.array(early, pa.string())}))
    found = found if kept is None else found.union(kept)
    # Few rows are left by the kept texts, and only those are put in order.
    return first_per_group(signed.join(found, "_sig", "left_semi"), [F.col("_sig")], order, tie=tie).drop("_sig")
