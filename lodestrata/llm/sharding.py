"""Minimax contiguous sharding, by DataFrame functions alone.

Rows are grouped into at most `atoms` ordered atomic groups: the leading bits of a text's hash decide, so equal
texts always share a group, and the number of groups stays bounded however many rows there are. The smallest shard
capacity for which a greedy pass over the ordered group sizes needs no more than `shards` shards is found by binary
search. The sequence is cut so that no shard exceeds that capacity; where one group sets it (a text with a large
part of all bytes), the others are cut at an even share of what is left to them, not filled up to it. The search
works on one row that holds the bounded array of sizes; rows only ever meet that array as numbers of their own group.

Defined cases: a null text has size `overhead` and shares a group with other null and with empty texts, which have
that size too. Repeated rows and repeated ids each get a slot of their own; within a cell slots go by id, then by
the text's checksum (equal in both: either order). Null ids come last in their cell. Very long texts are one group
each and read once. With fewer groups than shards some shards stay empty. An empty table gives no rows. Columns of
the caller are kept whatever they are called, as the working columns live in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import stage

SHARDS = 24
ATOMS = 1 << 16
OVERHEAD = 8
CELL_ROWS = 1_000


def cut_points(sizes: Column, shards: int) -> Column:
    """Struct of the smallest feasible capacity and the first group of each shard but the first.

    sizes: array<bigint> in order. A shard takes groups while they fit; one group alone always fits, as the
    search starts at the largest size.
    """
    zero = F.lit(0).cast("long")

    def needed(capacity: Column) -> Column:
        start = F.struct(F.lit(1).cast("long").alias("n"), zero.alias("filled"))
        step = lambda a, s: F.when(
            a["filled"] + s <= capacity, F.struct(a["n"].alias("n"), (a["filled"] + s).alias("filled")),
        ).otherwise(F.struct((a["n"] + 1).alias("n"), s.alias("filled")))
        return F.aggregate(sizes, start, step, lambda a: a["n"])

    total = F.aggregate(sizes, zero, lambda a, s: a + s)
    span = F.struct(F.greatest(F.coalesce(F.array_max(sizes), zero), F.ceil(total / F.lit(shards)).cast("long")).alias("low"), F.greatest(total, zero).alias("high"))

    def halve(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("long")
        fits = needed(middle) <= shards
        return F.when(a["low"] >= a["high"], a).when(fits, F.struct(a["low"].alias("low"), middle.alias("high"))).otherwise(F.struct((middle + 1).alias("low"), a["high"].alias("high")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(62)), span, halve, lambda a: a["low"])


def even_level(sizes: Column, shards: int) -> Column:
    """Bytes of an even shard: what is left to a shard once the groups above that level have shards of their own."""
    zero = F.lit(0).cast("long")

    def next_level(level: Column) -> Column:
        start = F.struct(zero.alias("bytes"), zero.alias("n"))
        above = F.aggregate(sizes, start, lambda a, s: F.when(s > level, F.struct((a["bytes"] + s).alias("bytes"), (a["n"] + 1).alias("n"))).otherwise(a))
        total = F.aggregate(sizes, zero, lambda a, s: a + s)
        return (total - above["bytes"]) / F.greatest(F.lit(1).cast("long"), F.lit(shards) - above["n"])

    # Each step can only lower the level, and there are fewer groups above it than shards.
    rounds = F.sequence(F.lit(1), F.lit(8))
    return F.aggregate(rounds, F.lit(float("inf")), lambda level, _: F.least(level, next_level(level)))


def latest_starts(sizes: Column, capacity: Column) -> Column:
    """array: at k, the first group from which on the rest fits into k + 1 shards of this capacity."""
    begin = F.struct(F.lit(0).cast("long").alias("filled"), F.size(sizes).alias("i"), F.array().cast("array<int>").alias("starts"))
    keep = lambda a, s: F.struct((a["filled"] + s).alias("filled"), (a["i"] - 1).alias("i"), a["starts"].alias("starts"))
    cut = lambda a, s: F.struct(s.alias("filled"), (a["i"] - 1).alias("i"), F.concat(a["starts"], F.array(a["i"])).alias("starts"))
    return F.aggregate(
        F.reverse(sizes), begin, lambda a, s: F.when(a["filled"] + s <= capacity, keep(a, s)).otherwise(cut(a, s)),
        lambda a: F.concat(a["starts"], F.array(a["i"])),
    )


def between(sizes: Column, level: Column) -> Column:
    """array: bytes before the first group above the level, between the first and the second, and so on."""
    zero = F.array(F.lit(0).cast("long"))
    more = lambda a, s: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.element_at(a, -1) + s))
    return F.aggregate(sizes, zero, lambda a, s: F.when(s > level, F.concat(a, zero)).otherwise(more(a, s)))


def cuts_at(sizes: Column, capacity: Column, level: Column, starts: Column, runs: Column, shards: int) -> Column:
    """Index of the first group of every shard but the first.

    No shard exceeds the capacity. Below it a shard ends where it is nearest to an even share of its run (the
    groups between two that are above the level), and a group above the level stands alone where there is a
    shard for it. A cut is only made where the rest still fits into the shards that are left.
    """
    zero = F.lit(0).cast("long")
    first = F.element_at(runs, 1)
    # A run takes the shards that its bytes are worth; the last one takes all that are left.
    worth = lambda bytes_, last, left: F.when(last, left).otherwise(
        F.greatest(F.lit(1), F.least(left, F.round(bytes_ / F.greatest(level, F.lit(1.0))).cast("int")))
    )
    begin = F.struct(
        zero.alias("filled"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("cuts"), F.lit(shards - 1).alias("left"), F.lit(False).alias("big"),
        F.lit(1).alias("run"), first.alias("rest"), worth(first, F.size(runs) == 1, F.lit(shards)).alias("n"),
    )

    def step(a: Column, s: Column) -> Column:
        big = s > level
        even = a["rest"] / F.greatest(a["n"], F.lit(1))
        wanted = (a["filled"] > 0) & (big | a["big"] | (2 * a["filled"] + s > 2 * even))
        possible = a["i"] >= F.coalesce(F.get(starts, a["left"] - 1), F.lit(0))
        cut = (a["left"] > 0) & ((a["filled"] + s > capacity) | (wanted & possible))
        left = a["left"] - cut.cast("int")
        fresh = a["big"] & ~big  # the first group of the next run
        run = a["run"] + a["big"].cast("int")
        bytes_ = F.coalesce(F.get(runs, run - 1), zero)
        rest = F.when(fresh, bytes_).when(cut & ~a["big"], a["rest"] - a["filled"]).otherwise(a["rest"])
        n = F.when(fresh, worth(bytes_, run == F.size(runs), left + 1)).when(cut & ~a["big"], a["n"] - 1).otherwise(a["n"])
        return F.struct(
            F.when(cut, s).otherwise(a["filled"] + s).alias("filled"), (a["i"] + 1).alias("i"), F.when(
                cut, F.concat(a["cuts"], F.array(a["i"])),
            ).otherwise(a["cuts"]).alias("cuts"),
            left.alias("left"), big.alias("big"), run.alias("run"), rest.alias("rest"), n.alias("n"),
        )

    return F.aggregate(sizes, begin, step, lambda a: a["cuts"])


def assign_shards(
    df: DataFrame, text: str = "text", order: str = "doc_id", shards: int = SHARDS, atoms: int = ATOMS, overhead: int = OVERHEAD,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """df's columns in struct `row`, with shard, slot (gapless from 0 in a shard), size and text_crc32.

    Slots: groups are counted once (a partial aggregate on each task, at most `atoms` rows), large groups are
    split into cells of about `cell_rows` rows by the id's hash, and a slot is the number of rows in earlier
    cells plus the place in the cell, so neither a shard nor a group of copies is one task's work.
    """
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")
    atom = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(atoms)).cast("int")
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), size.alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), atom.alias("atom"),
        F.xxhash64(F.col(order).cast("string")).alias("salt"), F.col(order).alias("order"),
    )
    groups = df.select(size.alias("size"), atom.alias("atom")).groupBy("atom").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    listed = groups.agg(F.array_sort(F.collect_list(F.struct("atom", "bytes", "n"))).alias("groups"))
    # Staged, as the one row would otherwise be searched anew wherever its capacity is named.
    searched = stage(listed.withColumn("capacity", cut_points(F.transform("groups", lambda g: g["bytes"]), shards)), "capacity")
    # One row throughout, staged where an array expression would otherwise be worked out for each of its uses.
    sizes = F.col("sizes")
    level = stage(searched.withColumn("sizes", F.transform("groups", lambda g: g["bytes"])).withColumn("level", even_level(sizes, shards)), "level")
    fixed = stage(level.withColumns({"starts": latest_starts(sizes, F.col("capacity")), "runs": between(sizes, F.col("level"))}), "starts")
    cut = stage(fixed.withColumn("cuts", cuts_at(sizes, F.col("capacity"), F.col("level"), F.col("starts"), F.col("runs"), shards)), "cuts")
    # One row: the groups again, each with its shard, the number of its cells, and the capacity.
    shard = F.size(F.filter("cuts", lambda c: c <= F.col("i")))
    plan = cut.select("cuts", "capacity", F.posexplode("groups").alias("i", "g")).select(
        F.col("g.atom").alias("atom"), shard.alias("shard"), F.ceil(F.col("g.n") / cell_rows).cast("long").alias("cells"),
    )
    placed = rows.join(F.broadcast(plan), "atom").withColumn("cell", F.pmod("salt", F.col("cells")).cast("long"))
    narrow = df.select(
        atom.alias("atom"), F.xxhash64(F.col(order).cast("string")).alias("salt"),
    ).join(F.broadcast(plan), "atom").withColumn("cell", F.pmod("salt", F.col("cells")).cast("long"))
    counts = narrow.groupBy("shard", "atom", "cell").count()
    before = Window.partitionBy("shard").orderBy("atom", "cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("atom", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("atom", "cell").orderBy(F.col("order").asc_nulls_last(), "text_crc32")
    return placed.join(offsets, ["atom", "cell"]).select("row", "size", "text_crc32", "shard", (F.col("before") + F.row_number().over(within) - 1).alias("slot"))


def sharded_documents(df: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Digest of assign_shards: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    out = assign_shards(df.select("doc_id", "text"), shards=shards)
    return out.select(
        F.col("row.doc_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
