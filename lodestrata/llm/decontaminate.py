"""Benchmark decontamination with a distributed positional inverted index.

`build_index` stores the postings of every training word once, as a table that serves any test set: texts are
taken in shards of a few MB, and a row is the posting list of one term in one shard, ascending positions that
count the shard's words through, with one place left free between documents. So a term in a third of all
documents is many short lists, none of which grows with the corpus, and building needs no shuffle. A directory
row a shard has its documents' keys and word counts. Terms are 64-bit hashes of words.

A search takes the test set in blocks of about BLOCK_WORDS words, whose terms and window starts are broadcast as
arrays. The lists of the asked terms meet by shard, the only shuffle; there each window's lists, shifted by the
offsets of their terms, are intersected from the rarest to the most frequent, for all windows at once and at most
STEP starts at a time. Exact phrases need every term at its offset; proximity matches need the terms within a
span, in any order.

Defined cases: null and wordless texts have no words and are never contaminated; a wordless or null item text has
no window. Rows of one item id are one item; items of null id hit words like others, but are neither counted nor
listed. Repeated documents are judged row by row, also those of equal id or null id. An item of one to twelve
words is one window of its length. Very long texts are a shard of their own and are searched whole. An empty table
on either side gives no hits. Further columns of either table, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import shingles as S
from lodestrata.llm.common import partitions, stage

WINDOW = 13
BLOCK_WORDS = 1_000_000
STEP = 2_000_000


def _binary(parts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One value for each run of an int32 array."""
    offsets = np.concatenate(([0], ends)).astype(np.int32) * np.int32(4)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(parts, np.int32))])


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(shard, term, df, places, keys, words): posting lists (keys and words null), and a directory row a shard.

    Directory rows have a null term, the documents' keys in order and their numbers of words. Stage the result:
    shards are named by task, so they are only stable once they are written.
    """
    kind = docs.select(F.col(key).alias("key")).schema["key"].dataType
    whole = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "term", "df", "places", "keys", "words"]
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, data, offsets in S.blocks(batch.column(1)):
                word, doc = S.words(data, offsets)
                counts = np.bincount(doc, minlength=hi - lo).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(0).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard]), pa.array([None], pa.int64()), pa.array([hi - lo], pa.int32()), pa.array([None], pa.binary()), keys,
                        _binary(counts, np.array([hi - lo])),
                    ], names=names
                )
                if len(word):
                    order = np.argsort(word, kind="stable")
                    term, place, owner = word[order], order + doc[order], doc[order]
                    first = np.concatenate(([True], term[1:] != term[:-1]))
                    begin = np.flatnonzero(first)
                    fresh = first | np.concatenate(([True], owner[1:] != owner[:-1]))
                    n = len(begin)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, shard)), pa.array(term[begin].view(np.int64)), pa.array(np.add.reduceat(fresh, begin, dtype=np.int32)),
                            _binary(place, np.append(begin[1:], len(place))), pa.nulls(n, keys.type), pa.nulls(n, pa.binary()),
                        ],
                        names=names,
                    )
                shard += 1

    from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

    schema = StructType(
        [
            StructField("shard", LongType()), StructField("term", LongType()), StructField("df", IntegerType()), StructField("places", BinaryType()),
            StructField("keys", ArrayType(kind)), StructField("words", BinaryType()),
        ]
    )
    return whole.mapInArrow(run, schema)


def document_frequencies(index: DataFrame) -> DataFrame:
    """(term, df, cf): documents and occurrences of each term, counted over the whole index."""
    lists = index.filter("term is not null")
    return lists.groupBy("term").agg(F.sum("df").alias("df"), F.sum((F.octet_length("places") / 4).cast("long")).alias("cf"))


@dataclass
class Windows:
    """The windows of a block of test items, as arrays.

    tokens: the items' words one after the other, as numbers into terms (ascending hashes). Of equal windows one
    stands for all: start and size in tokens, and its items between ends[i-1] and ends[i] of owners.
    """

    terms: np.ndarray
    tokens: np.ndarray
    start: np.ndarray
    size: np.ndarray
    owners: np.ndarray
    ends: np.ndarray
    names: list[str | None]


def windows_of(names: list[str | None], texts: list[str | None], width: int = WINDOW) -> Windows:
    column = pa.array([t or "" for t in texts], pa.large_string())
    parts = [S.words(data, offsets) for _, _, data, offsets in S.blocks(column)]
    firsts = [lo for lo, *_ in S.blocks(column)]
    word = np.concatenate([w for w, _ in parts]) if parts else np.zeros(0, np.uint64)
    item = np.concatenate([d + lo for (_, d), lo in zip(parts, firsts, strict=True)]) if parts else np.zeros(0, np.int64)
    terms, tokens = np.unique(word.view(np.int64), return_inverse=True)
    counts = np.bincount(item, minlength=len(texts))
    begin = np.cumsum(counts) - counts
    each = np.where(counts > 0, np.maximum(1, counts - width + 1), 0)
    own = np.repeat(np.arange(len(texts)), each)
    start = begin[own] + np.arange(len(own)) - np.repeat(np.cumsum(each) - each, each)
    size = np.minimum(counts[own], width)
    # Windows by a hash of their words and size; ties in it would need two windows of equal 64-bit hash.
    value = S.mix(size.astype(np.uint64))
    for j in range(width):
        has = j < size
        value[has] = S.mix(value[has] * np.uint64(31) + word[start[has] + j])
    _, first, same = np.unique(value, return_index=True, return_inverse=True)
    pairs = np.unique(np.stack([same.ravel(), own], 1), axis=0) if len(own) else np.zeros((0, 2), np.int64)
    ends = np.cumsum(np.bincount(pairs[:, 0], minlength=len(first)))
    return Windows(terms, tokens.ravel().astype(np.int32), start[first], size[first], pairs[:, 1], ends, names)


class Shard:
    """The posting lists of one shard for a test set's terms, and its documents."""

    def __init__(self, keys, counts: np.ndarray, n_terms: int) -> None:
        self.keys, self.counts = keys, counts
        self.begin = np.cumsum(counts.astype(np.int64) + 1) - counts - 1
        self.end = int(self.begin[-1] + counts[-1]) + 1 if len(counts) else 0
        self.held: list[tuple[int, np.ndarray]] = []
        self.n = np.zeros(n_terms, np.int64)

    def add(self, term: int, places: np.ndarray) -> None:
        self.held.append((term, places))
        self.n[term] = len(places)

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """All lists in one, by term, then place, and where each term's begins."""
        self.held.sort(key=lambda h: h[0])
        first = np.cumsum(self.n) - self.n
        return (np.concatenate([p for _, p in self.held]) if self.held else np.zeros(0, np.int32)).astype(np.int64), first

    def phrases(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of every occurrence: shifted lists intersected from the rarest on."""
        places, first = self.lists()
        lacking = np.concatenate(([0], np.cumsum(self.n[windows.tokens] == 0)))
        alive = np.flatnonzero(lacking[windows.start + windows.size] == lacking[windows.start])
        keyed = np.repeat(np.arange(len(self.n)), self.n) * self.end + places  # ascending, as the lists are
        found_w, found_p = [], []
        for size in np.unique(windows.size[alive]).tolist():
            which = alive[windows.size[alive] == size]
            terms = windows.tokens[windows.start[which][:, None] + np.arange(size)].astype(np.int64)
            order = np.argsort(self.n[terms], axis=1, kind="stable")
            anchor = terms[np.arange(len(which)), order[:, 0]]
            load = np.cumsum(self.n[anchor])
            lo = 0
            while lo < len(which):
                hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + STEP, "right")))
                n = self.n[anchor[lo:hi]]
                row = np.repeat(np.arange(lo, hi), n)
                at = places[np.repeat(first[anchor[lo:hi]], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] - order[row, 0]
                for j in range(1, size):
                    if not len(at):
                        break
                    offset = order[row, j]
                    asked = at + offset
                    wanted = terms[row, offset] * self.end + asked
                    i = np.minimum(np.searchsorted(keyed, wanted), len(keyed) - 1)
                    both = (keyed[i] == wanted) & (asked >= 0) & (asked < self.end)
                    row, at = row[both], at[both]
                inside = (at >= 0) & (at + size <= self.end)
                found_w.append(which[row[inside]])
                found_p.append(at[inside])
                lo = hi
        none = np.zeros(0, np.int64)
        return (np.concatenate(found_w), np.concatenate(found_p)) if found_w else (none, none)

    def document_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, place, "right") - 1

    def near(self, terms: list[int], span: int) -> np.ndarray:
        """Places of the rarest term around which each term occurs within `span` words of the same document."""
        held = dict(self.held)
        lists = sorted((held.get(t, np.zeros(0, np.int32)).astype(np.int64) for t in dict.fromkeys(terms)), key=len)
        at = lists[0] if lists else np.zeros(0, np.int64)
        for other in lists[1:]:
            if not len(at) or not len(other):
                return np.zeros(0, np.int64)
            i = np.searchsorted(other, at)
            ok = np.zeros(len(at), bool)
            for neighbour in (other[np.minimum(i, len(other) - 1)], other[np.maximum(i - 1, 0)]):
                ok |= (np.abs(neighbour - at) <= span) & (self.document_of(neighbour) == self.document_of(at))
            at = at[ok]
        return at


def _shards(batches: Iterator[pa.RecordBatch], terms: np.ndarray) -> Iterator[Shard]:
    """Shards from rows (shard, term, places, keys, words) in the order of shard and term, directory rows first."""
    now, shard = None, None
    for batch in batches:
        lists = batch.column(3)
        for r, (name, term, places, words) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True)):
            if shard is None or name != now:
                if shard is not None:
                    yield shard
                now, shard = name, Shard(lists[r].values, np.frombuffer(words, np.int32), len(terms))
                continue
            shard.add(int(np.searchsorted(terms, term)), np.frombuffer(places, np.int32))
    if shard is not None:
        yield shard


def _gathered(index: DataFrame, terms: np.ndarray) -> DataFrame:
    """The directory and the asked terms' lists, shards together and in order."""
    spark = index.sparkSession
    asked = spark.createDataFrame(pa.table({"term": pa.array(terms, pa.int64())})) if len(terms) else spark.createDataFrame([], "term long")
    lists = index.filter("term is not null").join(F.broadcast(asked), "term", "left_semi")  # as many as a block's words at most
    rows = lists.unionByName(index.filter("term is null")).select("shard", "term", "places", "keys", "words")
    return rows.repartition(partitions(spark), "shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())


def _key_type(index: DataFrame) -> str:
    return index.schema["keys"].dataType.elementType.simpleString()


def search(index: DataFrame, query: Windows) -> DataFrame:
    """(shard, number, key, n_words, items array<string>, hits array<int>, hit_null boolean) for every document."""
    shared = index.sparkSession.sparkContext.broadcast(query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for shard in _shards(batches, windows.terms):
            m = len(shard.counts)
            window, place = shard.phrases(windows)
            doc = shard.document_of(place)
            # Words under any occurrence: runs opened and closed along the shard's places.
            open_ = np.bincount(place, minlength=shard.end + 1) - np.bincount(
                place + windows.size[window], minlength=shard.end + 1,
            ) if len(place) else np.zeros(shard.end + 1, np.int64)
            hit = np.flatnonzero(np.cumsum(open_) > 0)
            owner = shard.document_of(hit)
            hits = _lists(hit - shard.begin[owner], np.bincount(owner, minlength=m))
            low = np.where(window > 0, windows.ends[window - 1], 0)
            n = windows.ends[window] - low
            item = windows.owners[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] if len(n) else np.zeros(0, np.int64)
            pairs = np.unique(np.repeat(doc, n) * len(windows.names) + item) if len(item) else np.zeros(0, np.int64)
            d, i = pairs // max(1, len(windows.names)), pairs % max(1, len(windows.names))
            known = np.array([windows.names[x] is not None for x in i.tolist()], bool)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(d[known], minlength=m))))
            items = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([windows.names[x] for x in i[known].tolist()], pa.string()))
            yield pa.RecordBatch.from_arrays([shard.keys, pa.array(shard.counts.astype(np.int64)), items, hits], names=["key", "n_words", "items", "hits"])

    kind = _key_type(index)
    return _gathered(index, query.terms).mapInArrow(run, f"key {kind}, n_words long, items array<string>, hits array<int>")


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(flat, pa.int32()))


def item_blocks(items: DataFrame, text: str, block_words: int) -> int:
    """Number of blocks so that each has about block_words words, from one aggregate over the test set."""
    total = items.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)))).first()[0] or 0
    return 1 + int(total) // (4 * block_words)


def find_contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(key, n_words, items array<string>, hits array<int>) a document row: occurring items and hit positions.

    A document word inside any occurrence of a window is hit.
    """
    items = items.select(item_key, item_text).dropDuplicates()  # equal rows would all be in one block
    n = item_blocks(items, item_text, block_words)
    part = F.pmod(F.xxhash64(F.col(item_key).cast("string"), F.col(item_text)), F.lit(n))
    row = F.struct(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"))
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text")) if n == 1 else docs.select(row.alias("key"), F.col(text).alias("text"))
    # Staged once: rows get their numbers when the index is written, and each block of items reads that table.
    index = stage(build_index(source, "key", "text"), "postings")
    found = []
    for b in range(n):
        rows = items.filter(part == b).select(F.col(item_key).cast("string").alias("i"), F.col(item_text).alias("t")).collect()  # one bounded block
        found.append(search(index, windows_of([r["i"] for r in rows], [r["t"] for r in rows], width)))
    if n == 1:
        return found[0].select(F.col("key").alias(key), "n_words", F.array_distinct("items").alias("items"), "hits")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    merged = every.groupBy("key").agg(
        F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
    )
    return merged.select(F.col("key.key").alias(key), "n_words", "items", "hits")


def find_near(docs: DataFrame, phrases: dict[str, str], span: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Proximity matches: (key, phrase, position) where all words of a phrase stand within span words of its rarest."""
    names = list(phrases)
    query = windows_of(names, [phrases[n] for n in names], 1)
    column = pa.array([phrases[n] for n in names], pa.large_string())
    wanted = {}
    for lo, hi, data, offsets in S.blocks(column):
        word, owner = S.words(data, offsets)
        number = np.searchsorted(query.terms, word.view(np.int64))
        for i in range(lo, hi):
            wanted[names[i]] = number[owner == i - lo].tolist()
    index = stage(build_index(docs, key, text), "postings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, query.terms):
            row, phrase, position = [], [], []
            for name, terms in wanted.items():
                at = shard.near(terms, span)
                doc = shard.document_of(at)
                row += doc.tolist()
                position += (at - shard.begin[doc]).tolist()
                phrase += [name] * len(at)
            yield pa.RecordBatch.from_arrays(
                [shard.keys.take(pa.array(row, pa.int64())), pa.array(phrase, pa.string()), pa.array(position, pa.int64())],
                names=[key, "phrase", "position"],
            )

    return _gathered(index, query.terms).mapInArrow(run, f"`{key}` {_key_type(index)}, phrase string, position long")


def contamination_digest(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (a hit, and a twentieth of the words hit)."""
    found = find_contamination(docs, items, **names)
    n_hit = F.size("hits").cast("long")
    return found.select(
        names.get("key", "doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the contaminated rows, columns unchanged; rows of one id are judged by their own texts."""
    name = F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("text"))
    judged = contamination_digest(docs.select(name.alias("__row"), F.col(text).alias("__text")), items, key="__row", text="__text")
    bad = judged.filter("contaminated").select("__row").distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), name.alias("__mine"))
    same = F.col("__mine.id").eqNullSafe(F.col("__row.id")) & F.col("__mine.text").eqNullSafe(F.col("__row.text"))
    return whole.join(bad, same, "left_anti").select("__doc.*")
