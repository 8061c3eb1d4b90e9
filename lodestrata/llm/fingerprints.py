"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch keeps the k smallest distinct shingle hashes of a text. Sketches of parts merge into the sketch
of the whole, and two sketches estimate resemblance, containment and the number of distinct shingles.

Defined cases: null counts as the empty text, whose sketch is empty; two empty sketches resemble each other fully, an
empty and a filled one not at all. Equal texts have equal sketches. Repeated rows each get a row; rows of one id follow
each other by their texts. Ids must be whole numbers; others are an error. Null ids come last, all in one range. Very long texts are sketched whole, in one piece. An
empty table gives no rows. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import shingles as S
from lodestrata.llm.common import partitions

K = 256
BITS = 48
_LOWEST = -(1 << 63)


def sketches(column: pa.Array, k: int = K) -> list[np.ndarray]:
    """Ascending 48-bit shingle hashes, k at most, for each text."""
    out: list[np.ndarray] = []
    for lo, hi, data, offsets in S.blocks(column):
        doc, value, _ = S.shingles(data, offsets)
        value = value >> np.uint64(S.HASH_BITS - BITS)
        ends = np.searchsorted(doc, np.arange(hi - lo + 1))
        out += [np.unique(value[a:b][: k + 8])[:k] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


def encode(sketch: np.ndarray) -> str:
    """Base64 of six big-endian bytes a hash, a string that equal sketches share."""
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").reshape(-1).astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets; exact while both have at most k shingles."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    twice = both[1:][both[1:] == both[:-1]]
    union = len(both) - len(twice)
    if union <= k:
        return len(twice) / union
    edge = merge(a, b, k)[-1]
    return float(np.count_nonzero(twice <= edge)) / k


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << BITS) / float(a[k - 1] + np.uint64(1))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    joint = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, joint / distinct(a, k))


def fingerprint(df: DataFrame, text: str = "text", keep: list[str] | None = None, k: int = K) -> DataFrame:
    """The columns in keep, with `fingerprint` and `n_shingles` (estimated) of the text."""
    keep = keep or []
    source = df.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches(batch.column(len(keep)), k)
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([encode(x) for x in found], pa.string()), pa.array([distinct(x, k) for x in found], pa.float64())],
                names=[*keep, "fingerprint", "n_shingles"],
            )

    fields = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep)
    return source.mapInArrow(run, f"{fields}fingerprint string, n_shingles double")


def merge_fingerprints(parts: DataFrame, key: str, fingerprint: str = "fingerprint", k: int = K, spread: int = 32) -> DataFrame:
    """One fingerprint a key from those of its parts, merged by the k smallest hashes.

    Parts of one key are first merged in `spread` shares, so a key with very many parts is not one task's work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = decode(value or "")
                held[name] = merge(held[name], new, k) if name in held else new
                if len(held) >= 4096:
                    yield _pairs(held, kind)
                    held = {}
        if held:
            yield _pairs(held, kind)

    source = parts.select(F.col(key).alias("key"), F.col(fingerprint).alias("fingerprint"))
    kind = pa.int64() if source.schema["key"].dataType.simpleString() == "bigint" else pa.string()
    source = source if kind == pa.int64() else source.withColumn("key", F.col("key").cast("string"))
    schema = source.schema
    salted = source.repartition(partitions(parts.sparkSession), "key", F.pmod(F.xxhash64("fingerprint"), F.lit(spread)))
    once = salted.sortWithinPartitions("key").mapInArrow(run, schema)
    ordered = once.repartition(partitions(parts.sparkSession), "key").sortWithinPartitions("key")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, have, begun = None, None, False
        for batch in batches:
            for x, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if begun and x == name:
                    have = merge(have, decode(value), k)
                    continue
                if begun:
                    yield _pairs({name: have}, kind)
                name, have, begun = x, decode(value), True
        if begun:
            yield _pairs({name: have}, kind)

    return ordered.mapInArrow(last, schema).withColumnRenamed("key", key)


def _pairs(held: dict, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([encode(x) for x in held.values()], pa.string())], names=["key", "fingerprint"])


def with_next(df: DataFrame, order: str, text: str) -> DataFrame:
    """Deal rows into ranges of `order`, descending, each range followed by its next row.

    Returns (bucket, own, id, text), partitioned by bucket and sorted; rows with own = false repeat the row
    that follows the range (after the last range: the first row of all). One shuffle of the texts: the range
    borders are values of the column, so the row that opens a range is known without looking for it.
    Null ids come last. Rows of equal id follow each other by their texts.
    """
    spark = df.sparkSession
    n = partitions(spark)
    wanted = 4 * n
    ids = df.select(F.coalesce(F.col(order).cast("long"), F.lit(_LOWEST)).alias("id"))
    shares = [i / wanted for i in range(1, wanted)]
    row = ids.agg(F.max("id").alias("top"), F.percentile_approx("id", shares, 10000).alias("cuts")).first()
    top = _LOWEST if row["top"] is None else row["top"]
    borders = sorted({top, *(row["cuts"] or [])}, reverse=True)
    steps = max(1, len(borders).bit_length())
    bounds = F.lit(borders)
    at = F.aggregate(
        F.array(*[F.lit(1 << s) for s in range(steps - 1, -1, -1)]),
        F.lit(0),
        lambda low, step: F.when(F.coalesce(F.get(bounds, low + step) >= F.col("id"), F.lit(False)), low + step).otherwise(low),
    )
    rows = df.select(F.coalesce(F.col(order).cast("long"), F.lit(_LOWEST)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("bucket", at)
    opens = (F.get(bounds, F.col("bucket")) == F.col("id")) & (F.col("bucket") > 0)
    places = F.array(
        F.struct(F.col("bucket").alias("bucket"), F.lit(True).alias("own")),
        F.struct(F.when(opens, F.col("bucket") - 1).alias("bucket"), F.lit(False).alias("own")),
        F.struct(F.when(F.col("id") == top, F.lit(len(borders) - 1)).alias("bucket"), F.lit(False).alias("own")),
    )
    dealt = rows.withColumn("place", F.explode(F.filter(places, lambda p: p["bucket"].isNotNull()))).select("place.bucket", "place.own", "id", "text")
    follows = F.when(F.col("own"), 0).when((F.col("bucket") == len(borders) - 1) & (F.col("id") == top), 2).otherwise(1)
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", follows, F.desc("id"), "text")


def edited_fingerprints(df: DataFrame, order: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprint each text and its edited text, and compare it with that and with the next document.

    The next document is that with the next smaller id (after the smallest: the largest). The edited text
    has the last third of the code points, rounded down, replaced by as many from the start of the next
    document. A lone row is its own next document. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            found = sketches(batch.column(3), k)
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(4)), found, strict=True))
            if held is not None:
                rows.insert(0, held)
            held = rows[-1]
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[1] and a[0] == b[0]]
            texts = [a[3][: len(a[3]) - len(a[3]) // 3] + b[3][: len(a[3]) // 3] for a, b in pairs]
            changed = sketches(pa.array(texts, pa.large_string()), k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None if a[2] == _LOWEST else a[2] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()),
                    pa.array([encode(a[4]) for a, _ in pairs], pa.string()),
                    pa.array([encode(x) for x in changed], pa.string()),
                    pa.array([resemblance(a[4], x, k) for (a, _), x in zip(pairs, changed, strict=True)], pa.float64()),
                    pa.array([resemblance(a[4], b[4], k) for a, b in pairs], pa.float64()),
                    pa.array([distinct(a[4], k) for a, _ in pairs], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles"],
            )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double"
    return with_next(df, order, text).mapInArrow(run, schema)
