"""Best-fit packing of documents into sequences of several permitted lengths.

Lengths are small integers, so all items of one length are alike and best fit can be
planned on their histogram: a table of at most ``max(capacities)`` rows, however many
documents there are. The plan is global and exact: items by falling length, each into the open
bin with the least room that holds it. Bins that are in the same state are
kept as runs, and one entry of the plan places a whole range of equal items into a range
of bins. Rows find their entry by length and by their rank among items of that
length; no other communication is needed.

Where no open bin has room, the bin opened is the permitted size with the least cost,
which is its price less ``worth`` for every token of room it leaves to later items. The plan is made
for several values of ``worth``, from 0 (the smallest size that fits) to more than a token's
price (large sizes), and the cheapest is taken, so all sizes are chosen
jointly. In the end every bin is downsized to the smallest permitted size that holds its contents.

A document longer than the largest size is cut into full sequences of that size and a
rest, which is packed like any other item.

Defined results: null and empty texts have no tokens and no rows in the result; equal and
repeated documents are packed one by one; rows without doc_id are packed too; ties go
to the bin opened first, and among items of a length to the one with the least hash; very long texts are cut as said, into as many
full sequences as they fill. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termforge.llm.common import cut, identified, table

#: Permitted sequence lengths.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: A sequence costs its tokens, attention that grows with their square, and a fixed share.
PER_SEQUENCE, ATTENTION = 16, 32768
#: Items that one task ranks, about, if all had the same length.
RANKED = 1 << 20
WORTHS = (0.0, 1.02, 1.05, 1.1, 1.2, 1.35, 1.6)


def price(capacity: int) -> float:
    return capacity + capacity**2 / ATTENTION + PER_SEQUENCE


def token_length(text: Column) -> Column:
    """Words and single signs."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")).cast("bigint")


@dataclass
class Plan:
    """``entries``: (length, rank from, rank to, first bin, items a bin, used before); ``bins``: (first bin, bins, used)."""

    cost: float = 0.0
    entries: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    bins: list[tuple[int, int, int]] = field(default_factory=list)


def fitted(used: int, capacities: tuple[int, ...]) -> int:
    """The smallest permitted size that holds ``used`` tokens."""
    return min(c for c in capacities if c >= used)


def plan_for(histogram: dict[int, int], capacities: tuple[int, ...], worth: float) -> Plan:
    """Best fit decreasing of ``histogram`` (length: items), opening bins at the given worth of room."""
    plan, rooms, open_runs, bins = Plan(), [], {}, 0

    def put(room: int, run: tuple[int, int, int]) -> None:
        if room not in open_runs:
            insort(rooms, room)
            open_runs[room] = []
        insort(open_runs[room], run)

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            at = bisect_left(rooms, length)
            left = count - rank
            if at < len(rooms):
                room = rooms[at]
                first, n, used = open_runs[room].pop(0)
                if not open_runs[room]:
                    del open_runs[room], rooms[at]
            else:
                size = min((c for c in capacities if c >= length), key=lambda c: (price(c) - worth * (c - length), c))
                room, first, used, n = size, bins, 0, -(-left // (size // length))
                bins += n
            per = room // length
            items = min(left, n * per)
            full, rest = divmod(items, per)
            plan.entries.append((length, rank, rank + items, first, per, used))
            touched = full + bool(rest)
            if n > touched:
                put(room, (first + touched, n - touched, used))
            if full:
                put(room - per * length, (first, full, used + per * length))
            if rest:
                put(room - rest * length, (first + full, 1, used + rest * length))
            rank += items
    plan.bins = sorted(run for runs in open_runs.values() for run in runs)
    plan.cost = sum(n * price(fitted(used, capacities)) for _, n, used in plan.bins)
    return plan


def best_plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, worths: tuple[float, ...] = WORTHS) -> Plan:
    """The cheapest plan over all worths; the least worth in a tie."""
    return min((plan_for(histogram, capacities, w) for w in worths), key=lambda p: p.cost)


_ENTRY = "length int, from_rank bigint, to_rank bigint, first_bin bigint, per int, used_before int, bin_used int, capacity int"


def entries_of(plan: Plan, capacities: tuple[int, ...]) -> pd.DataFrame:
    """The plan's entries, cut so that each one's bins end alike, with their final contents and size."""
    firsts, rows = [b[0] for b in plan.bins], []
    for length, start, stop, first, per, used in plan.entries:
        at = bisect_right(firsts, first) - 1
        while start < stop:
            run_first, n, final = plan.bins[at]
            until = min(stop, start + (run_first + n - first) * per)
            rows.append((length, start, until, first, per, used, final, fitted(final, capacities)))
            first, start, at = run_first + n, until, at + 1
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _ENTRY.split(", ")])


def _ranked(sized: DataFrame, rows: int) -> DataFrame:
    """With the rank among items of a length, in the order of a hash. Items of the commonest length are ranked by several tasks, one for
    each range of hashes, and what is in the ranges before is added; the order is the same for any number of ranges."""
    bits = max(0, (rows // RANKED).bit_length())
    sized = sized.withColumn("range", F.shiftright("mark", 64 - bits) if bits else F.lit(0).cast("bigint"))
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy("length", "range").orderBy("mark", "doc_id", "n")) - 1)
    if not bits:
        return ranked
    sizes = sized.groupBy("length", "range").count()
    before = sizes.select("length", "range", (F.sum("count").over(Window.partitionBy("length").orderBy("range")) - F.col("count")).alias("before"))
    return ranked.join(before, ["length", "range"]).withColumn("rank", F.col("rank") + F.col("before"))


def pack(docs: DataFrame, lengths: Column | None = None, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """One row for each piece: (doc_id, piece, start, length, bin_id, bin_offset, bin_used, capacity).

    ``start`` counts tokens in the document, ``bin_offset`` in the sequence.
    ``lengths`` is an expression over ``doc_id`` and ``text``; by default ``token_length``.
    """
    most = max(capacities)
    tokens = (token_length(F.col("text")) if lengths is None else lengths).cast("bigint")
    mark = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))  # written, so it stays as it is
    sized = cut(identified(docs).select("doc_id", tokens.alias("n"), mark.alias("mark")).where("n > 0"))
    sized = sized.select("doc_id", "n", "mark", (F.col("n") % most).cast("int").alias("length"))
    counts = sized.where("length > 0").groupBy("length").count()  # at most max(capacities) - 1 rows
    histogram = {r["length"]: r["count"] for r in counts.collect()}
    rows, plan = sum(histogram.values()), best_plan(histogram, capacities)
    entries = sized.sparkSession.createDataFrame(entries_of(plan, capacities), _ENTRY)
    ranked = _ranked(sized, rows)
    full = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.expr(f"n div {most} - 1")),
        lambda k: F.struct(
            k.cast("int").alias("piece"), (k * most).alias("start"), F.lit(most).alias("length"),
            F.concat_ws("-", F.lit("full"), "length", "rank", k).alias("bin_id"), F.lit(0).alias("bin_offset"),
            F.lit(most).alias("bin_used"), F.lit(most).alias("capacity"),
        ),
    )
    whole = ranked.where(F.col("n") >= most).select("doc_id", F.explode(full).alias("p")).select("doc_id", "p.*")
    rest = ranked.where("length > 0").join(entries, "length").where("rank >= from_rank AND rank < to_rank")
    nth = F.col("rank") - F.col("from_rank")
    placed = rest.select(
        "doc_id", F.expr(f"cast(n div {most} as int)").alias("piece"), (F.col("n") - F.col("length")).alias("start"), "length",
        F.concat_ws("-", F.lit("best"), F.expr("first_bin + (rank - from_rank) div per")).alias("bin_id"),
        (F.col("used_before") + (nth % F.col("per")) * F.col("length")).cast("int").alias("bin_offset"), "bin_used", "capacity",
    )
    return whole.unionByName(placed)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed."""
    return pack(table(spark, sf_dir, "documents"))
