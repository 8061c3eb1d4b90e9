"""Mixing sources to target weights by Pfair scheduling.

A source's rows form blocks of `block_rows`. With target weight w (a share of all weights, kept as a whole
number over their sum, so nothing is rounded) its k-th block is released at floor(k / w) and due at
ceil((k + 1) / w). Earliest deadline first over unit slots meets every deadline, so after any slot each
source is less than one block away from its weight, however long the table. A source that has run out leaves
its later slots unused, which keeps the others' mutual proportions.

The schedule is cut into segments of time, a task each. What has run before a cut follows from the blocks whose windows
lie about it (`run_before`), so a segment needs nothing of those before it, and the segments together are the
schedule that one task would make. A segment is no shorter than the longest window, 1 / (the least weight) slots; a task's
memory grows with the sources, not with its slots. The schedule ends with the last block of every source: its length is the
largest number of blocks over weight of a source. `mixture` makes the slots alone that it keeps.

Ranks inside a source come from cells of about `cell_rows` rows by the id's hash, so a source with a third
of all rows is split. Each cell gets the slots of its blocks as one list. Only a row a source (at most
MAX_SOURCES) reaches the driver.

Defined cases: a null source is a source of its own; null, empty and very long texts are rows like others, as texts
are not read; repeated rows each get a place; null ids are ranked like others. Sources of weight 0 or without a weight
are not placed. Blocks due at the same slot go by the source's name, rows of equal hash by id (equal in both: either
order). More than MAX_SOURCES sources are an error: every source takes part in every segment, so a task's memory grows
with them. An empty table gives no rows. Columns of the caller are kept whatever they
are called, as they live in one struct.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import partitions

BLOCK_ROWS = 16
CELL_ROWS = 1_000
MAX_SOURCES = 100_000
#: Slots of a segment at least, and segments at most: beyond these they grow longer.
SEGMENT_SLOTS, SEGMENTS = 1 << 14, 20_000
TEMPERATURE = 0.7


def shares(weights: dict[str, float]) -> tuple[dict[str, int], int]:
    """Each source's weight as a whole number, and their sum; the ratios are exact (0.3 is three tenths)."""
    ratios = {k: Fraction(repr(float(w))) for k, w in weights.items() if w and w > 0}
    common = math.lcm(*(x.denominator for x in ratios.values()))
    out = {k: int(x * common) for k, x in ratios.items()}
    least = math.gcd(*out.values()) or 1
    out = {k: n // least for k, n in out.items()}
    return out, sum(out.values())


def _due(part: int, total: int, k: int) -> int:
    """The slot before which block k of a source must have run."""
    return -(-(k + 1) * total // part)


def longest_window(parts: dict[str, int], total: int) -> int:
    return -(-total // min(parts.values())) + 1


def run_before(parts: dict[str, int], total: int, cut: int) -> dict[str, int]:
    """How many blocks of each source earliest deadline first has run before slot `cut`.

    A block due by the cut has run. Of each other source at most one block is open: released before the cut, due after
    it. Blocks due by the cut go first wherever they wait, so open blocks run in the slots that those leave free, the one due
    first before others. All blocks released more than a window's length before the cut are due by it, and no slot is
    empty: so the queue of that time is their number less the slots, and the free slots follow from there.
    """
    run = {s: n * cut // total for s, n in parts.items()}
    start = max(0, cut - longest_window(parts, total))
    first = {s: -(-n * start // total) for s, n in parts.items()}
    queue = sum(first.values()) - start
    coming = [(k * total // parts[s], s, k) for s, k in first.items() if k < run[s]]
    open_ = sorted(((run[s] * total // n, _due(n, total, run[s]), s) for s, n in parts.items() if n * cut % total), reverse=True)
    heapq.heapify(coming)
    due_by_cut, waiting = dict(run), []
    for slot in range(start, cut):
        while coming and coming[0][0] <= slot:
            _, s, k = coming[0]
            queue += 1
            if k + 1 < due_by_cut[s]:
                heapq.heapreplace(coming, ((k + 1) * total // parts[s], s, k + 1))
            else:
                heapq.heappop(coming)
        if queue:
            queue -= 1
            continue
        while open_ and open_[-1][0] <= slot:
            heapq.heappush(waiting, open_.pop()[1:])
        run[heapq.heappop(waiting)[1]] += 1
    return run


def edf(parts: dict[str, int], total: int, blocks: dict[str, int], first: int = 0, end: int | None = None) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, k, slot, release, deadline) of the first `blocks` blocks of each source, by slot, from slot `first` to before `end`.

    Of the released blocks the one due first runs; sources that have run out go on taking their slots.
    """
    run = run_before(parts, total, first)
    ready, waiting = [], []
    for s, k in run.items():
        release, due = k * total // parts[s], _due(parts[s], total, k)
        if release <= first:
            ready.append((due, s, k, release))
        else:
            waiting.append((release, due, s, k))
    heapq.heapify(ready)
    heapq.heapify(waiting)
    left, slot = sum(max(0, blocks[s] - k) for s, k in run.items()), first
    while left and (end is None or slot < end):
        while waiting and waiting[0][0] <= slot:
            release, due, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, k, release))
        due, s, k, release = heapq.heappop(ready)
        if slot >= due:
            raise AssertionError(f"block {k} of {s} misses its deadline {due}")
        if k < blocks[s]:
            left -= 1
            yield s, k, slot, release, due
        heapq.heappush(waiting, ((k + 1) * total // parts[s], _due(parts[s], total, k + 1), s, k + 1))
        slot += 1


def segments(parts: dict[str, int], total: int, blocks: dict[str, int], until: int | None = None, least: int = SEGMENT_SLOTS) -> tuple[int, int]:
    """(number of segments, slots of each) for the slots of all blocks, or for those before `until`."""
    length = max((_due(parts[s], total, n - 1) for s, n in blocks.items() if n), default=0)
    length = length if until is None else min(length, until)
    if not length:
        return 0, 0
    slots = max(least, longest_window(parts, total), -(-length // SEGMENTS))
    return -(-length // slots), slots


def _schedule(spark: SparkSession, parts: dict[str, int], total: int, blocks: dict[str, int], until: int | None, least: int) -> DataFrame:
    """(s, block, at, release, due) for every block, or for those with a slot before `until`."""
    many, slots = segments(parts, total, blocks, until, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment in batch.column(0).to_pylist():
                first = segment * slots
                end = first + slots if until is None else min(first + slots, until)
                for rows in itertools.batched(edf(parts, total, blocks, first, end), 10_000):
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(next(columns), pa.string()), *(pa.array(c, pa.int64()) for c in columns)],
                        names=["s", "block", "at", "release", "due"],
                    )

    return spark.range(0, many, 1, max(1, many)).mapInArrow(run, "s string, block long, at long, release long, due long")


def _name(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), F.col(source).cast("string")), F.lit("n"))


def mix(
    df: DataFrame, weights: dict[str | None, float] | None = None, source: str = "source", order: str = "doc_id", block_rows: int = BLOCK_ROWS,
    cell_rows: int = CELL_ROWS, length: int | None = None, whole: bool = True, segment_slots: int = SEGMENT_SLOTS,
) -> DataFrame:
    """df's columns in struct `row`, with block, release, deadline, slot, position and chosen.

    weights: by source; by default each source's row count to the power TEMPERATURE. length: slots of the
    mixture, by default as many as there are blocks; rows in later slots are not chosen. position orders rows.
    whole: place these too; else the schedule ends with the mixture, and they have no slot or are left out.
    """
    spark = df.sparkSession
    counts = df.groupBy(_name(source).alias("s")).count().limit(MAX_SOURCES + 1).collect()  # a row a source
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    there = {r["s"]: r["count"] for r in counts}
    if weights is None:
        wanted = {s: n**TEMPERATURE for s, n in there.items()}
    else:
        named = {"n" if k is None else f"s:{k}": w for k, w in weights.items()}
        wanted = {s: named[s] for s in there if named.get(s, 0) > 0}
    parts, total = shares(wanted)
    length = length if length is not None else -(-sum(there.values()) // block_rows)
    slots = _schedule(spark, parts, total, {s: -(-there[s] // block_rows) for s in parts}, None if whole else length, segment_slots)

    per_source = spark.createDataFrame([(s, -(-there[s] // cell_rows)) for s in parts], "s string, cells long")
    salt = F.xxhash64(F.col(order).cast("string"))
    place = lambda frame_: frame_.join(F.broadcast(per_source), "s").withColumn("cell", F.pmod("salt", F.col("cells")))
    narrow = place(df.select(_name(source).alias("s"), salt.alias("salt")))
    before = Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = narrow.groupBy("s", "cell").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    blocks = F.sequence(F.floor(F.col("before") / block_rows), F.floor((F.col("before") + F.col("count") - 1) / block_rows))
    timed = offsets.select("s", "cell", "before", F.explode(blocks).alias("block")).join(slots, ["s", "block"])
    timed = timed.groupBy("s", "cell").agg(
        F.min("before").alias("before"), F.min("block").alias("first"),
        F.sort_array(F.collect_list(F.struct("block", "at", "release", "due"))).alias("slots"),
    )
    rows = place(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), _name(source).alias("s"), salt.alias("salt"), F.col(order).alias("order")))
    within = Window.partitionBy("s", "cell").orderBy("salt", "order")
    ranked = rows.withColumn("within", F.row_number().over(within) - 1).join(timed, ["s", "cell"]).withColumn("rank", F.col("before") + F.col("within"))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block_rows)).withColumn("own", F.get("slots", (F.col("block") - F.col("first")).cast("int")))
    slot = F.col("own.at")
    return ranked.select(
        "row", "block", F.col("own.release").alias("release"), F.col("own.due").alias("deadline"), slot.alias("slot"),
        (slot * block_rows + F.pmod("rank", F.lit(block_rows))).alias("position"), (slot < length).alias("chosen"),
    )


def mixed_documents(df: DataFrame) -> DataFrame:
    """doc_id, source and the mixture's columns for every document."""
    out = mix(df.select("doc_id", "source"))
    return out.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "block", "release", "deadline", "slot", "position", "chosen")


def mixture(df: DataFrame, **options) -> DataFrame:
    """The chosen rows, columns unchanged, in files that follow the mixture's order."""
    chosen = mix(df, whole=False, **options).filter("chosen")
    return chosen.repartitionByRange(partitions(df.sparkSession), "position").sortWithinPartitions("position").select("row.*")
