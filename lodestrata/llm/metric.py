"""Helpers of the vector operators: usable rows, padded matrices, equal vectors as one row, and shards that meet queries.

Inner products become distances by one more component: with M the longest row's length, a row x is (x, sqrt(M^2 - |x|^2))
and a query q is (q, 0), so |q' - x'|^2 = |q|^2 + M^2 - 2 q.x: nearest by distance is largest by inner product.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that meet a shard in one task, and queries that a task handles at once.
SHARE_QUERIES, BATCH_QUERIES = 16_384, 512
#: Most tasks of one meeting.
MOST_TASKS = 20_000


def usable(vector: Column) -> Column:
    """True where a vector is not null, not empty, and every component is there and finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow list column as rows of doubles; shorter lists are padded with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values) == len(column) * width:
        return values.astype(np.float64).reshape(len(column), width)
    length = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), length)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(length) - length, length)] = values
    return out


def lists(rows: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def once(rows: DataFrame, same: list[str], key: str, keep: int) -> DataFrame:
    """One row for each value of the columns `same`, with `ids`: its `keep` smallest keys.

    No search needs more of them: of rows with one vector, those of smaller id come first. Repeated rows count once.
    Each map task sends at most `keep` rows of a value on, so a vector that a third of all rows share is no hot key.
    """
    ranked = rows.select(*same, key).dropDuplicates().withColumn("place", F.row_number().over(Window.partitionBy(*same).orderBy(key)))
    return ranked.filter(F.col("place") <= keep).groupBy(*same).agg(F.sort_array(F.collect_list(key)).alias("ids"))


def sampled(rows: DataFrame, n: int, most: int, *columns: str) -> DataFrame:
    """About `most` of the n rows (all, if fewer), chosen by a hash of their content: the same rows in every run."""
    share = min(1.0, most / max(n, 1))
    return rows if share == 1.0 else rows.filter(F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) < int(share * (1 << 30)))


def pack(*arrays: np.ndarray) -> bytes:
    return pickle.dumps(arrays, protocol=5)


def unpack(body: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(body)


def meet(shards: DataFrame, asks: DataFrame, answer: Callable[[tuple, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str, width: int, extras: int) -> DataFrame:
    """Bring queries to the shards that they ask for: answer(shard's arrays, ask ids, vectors, extra numbers) in batches.

    shards: (shard long, body binary), one row a shard of bounded size; asks: (shard long, ask long, vector array<double>,
    extra array<double>). A shard that very many queries ask for is dealt in shares of SHARE_QUERIES, each with the
    shard's row; a task holds one shard and BATCH_QUERIES queries. Only a row a shard (its number of queries) is collected.
    """
    spark = shards.sparkSession
    counts = {r["shard"]: -(-r["count"] // SHARE_QUERIES) for r in asks.groupBy("shard").count().collect()}
    known = spark.createDataFrame(list(counts.items()), "shard long, shares int")
    tasks = min(MOST_TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(counts.values()) // 4))
    held = shards.select("shard", "body").join(F.broadcast(known), "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("part"), "body",
        F.lit(None).cast("long").alias("ask"), F.lit(None).cast("array<double>").alias("vector"), F.lit(None).cast("array<double>").alias("extra"),
    )
    asking = asks.join(F.broadcast(known), "shard").select(
        "shard", F.pmod(F.xxhash64("ask"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("part"),
        F.lit(None).cast("binary").alias("body"), "ask", "vector", "extra",
    )
    met = held.unionByName(asking).repartition(tasks, "shard", "share").sortWithinPartitions("shard", "share", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)] if len(key) else [0]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if not key[a, 2]:
                    now, shard = tuple(key[a, :2]), unpack(batch.column(3)[a].as_py())
                elif tuple(key[a, :2]) == now:
                    for lo in range(a, z, BATCH_QUERIES):
                        part = batch.slice(lo, min(BATCH_QUERIES, z - lo))
                        yield answer(shard, part.column(4).to_numpy(), matrix(part.column(5), width), matrix(part.column(6), extras))

    return met.mapInArrow(run, schema)


def best_rows(who: np.ndarray, score: np.ndarray, first_id: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each `who`: highest score, ties by smaller id."""
    order = np.lexsort((first_id, -score, who))
    who = who[order]
    start = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, np.int64)
    place = np.arange(len(who)) - np.repeat(start, np.diff(np.r_[start, len(who)]))
    return order[place < k]
