"""Keyword search over impact-ordered postings: the top k by BM25 without reading whole lists.

A term's postings are stored in blocks of falling impact, each with its largest one; impact is a posting's BM25 weight without the
idf. Buckets of terms and shares of texts grow with the corpus, so neither a file nor a task does. Beside them stand
the terms' statistics and each text's own terms. A batch of questions is answered in three steps:
1. The first block of every asked list gives some scores; the k-th best is a lower bound t of a question's k-th score.
2. Each term gets a cut, the cuts of a question adding up to at most SKIPPED * t, whole lists of frequent terms first. Blocks whose
   largest weight is not above the cut are not read. A text of the top k scores at least t minus the cuts in what is read.
3. Those texts are scored whole by their own terms.
The result is exact: the same as that of `search.bm25`, scores rounded to six decimals and ties by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import tokens
from lodestrata.operators.search import BLOCK_TEXTS, K1, B, _whole, query_blocks, top_k
from lodestrata.sources.stores import kept

#: Postings of a block; of a write task; texts of a share of a list; texts of a folder of texts' terms.
BLOCK, TASK_POSTINGS, SHARE_TEXTS, SLOT_TEXTS = 128, 2_000_000, 1_000_000, 200_000
#: Words of texts that are counted at once.
COUNTED_WORDS = 200_000
LEAST_BUCKETS, LEAST_SLOTS, MOST_TASKS = 16, 8, 20_000
#: The part of a lower bound that may be left unread.
SKIPPED = 0.5
#: Scores are rounded to six decimals, so a score this much lower can still tie.
ROUNDING = 2e-6


def impact(tf: Column, dl: Column, avgdl: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


def write_impacts(chunks: DataFrame, path: str, text: str = "text", block: int = BLOCK) -> None:
    """Write chunks (chunk_id, text) as texts, blocks, terms and about below path."""
    spark = chunks.sparkSession
    n = chunks.count()
    slots = max(LEAST_SLOTS, n // SLOT_TEXTS)
    words = tokens(F.col(text))
    listed = chunks.select("chunk_id", F.coalesce(words, F.array().cast("array<string>")).alias("t"), F.col(text).isNotNull().alias("there"))
    key = chunks.schema["chunk_id"].dataType.simpleString()
    slot = F.pmod(F.xxhash64("chunk_id"), F.lit(slots)).cast("int")
    counted = listed.mapInArrow(_counted, f"chunk_id {key}, dl long, terms array<string>, tf array<long>").withColumn("slot", slot)
    counted.repartition("slot").sortWithinPartitions("slot", "chunk_id").write.partitionBy("slot").parquet(f"{path}/texts")
    texts = spark.read.schema(counted.schema).parquet(f"{path}/texts")
    # The mean length is that of the texts that are not null, as in corpus_statistics.
    about = texts.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("total"), F.avg("dl").alias("avgdl")).first()
    total, avgdl = about["total"], about["avgdl"] or 1.0
    shares = max(1, n // SHARE_TEXTS)
    buckets = max(LEAST_BUCKETS, total // (shares * TASK_POSTINGS))
    posted = texts.select("chunk_id", "dl", F.explode(F.arrays_zip("terms", "tf")).alias("p")).select(F.col("p.terms").alias("term"), "chunk_id", F.col("p.tf").alias("tf"), "dl")
    posted = posted.withColumns({"bucket": term_bucket(F.col("term"), buckets), "share": F.pmod(F.xxhash64("chunk_id"), F.lit(shares)).cast("int"), "impact": impact(F.col("tf"), F.col("dl"), avgdl)})
    laid = posted.repartition(min(MOST_TASKS, buckets * shares), "bucket", "share").sortWithinPartitions("bucket", "share", "term", F.desc("impact"), "chunk_id")
    kind = f"bucket int, share int, term string, at int, most double, chunk_ids array<{key}>, tf array<long>, dl array<long>"
    laid.select("bucket", "share", "term", "impact", "chunk_id", "tf", "dl").mapInArrow(_cut(block), kind).write.partitionBy("bucket").parquet(f"{path}/blocks")
    blocks = spark.read.schema(kind).parquet(f"{path}/blocks")
    counts = F.aggregate("tf", F.lit(0).cast("long"), lambda s, x: s + x)
    terms = blocks.groupBy("bucket", "term").agg(F.sum(F.size("chunk_ids")).alias("df"), F.sum(counts).alias("cf"), F.max("most").alias("most"))
    terms.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/terms")
    spark.createDataFrame([(n, avgdl, buckets, slots, total)], "n long, avgdl double, buckets int, slots int, postings long").coalesce(1).write.parquet(f"{path}/about")


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts' terms once each, with their numbers; a null text has no length. Memory follows COUNTED_WORDS or the longest text, not a batch's rows."""
    for batch in (part for whole in batches for part in _of_words(whole, COUNTED_WORDS)):
        listed = batch.column(1)
        ends = listed.offsets.to_numpy()
        length = np.diff(ends)
        coded = listed.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        size = max(1, len(coded.dictionary))
        pair, times = np.unique(np.repeat(np.arange(len(batch)), length) * size + coded.indices.to_numpy(), return_counts=True)
        row = pair // size
        offsets = pa.array(np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32))
        terms = pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(pair % size)))
        absent = ~batch.column(2).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length.astype(np.int64), mask=absent), terms, pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))], names=["chunk_id", "dl", "terms", "tf"])


def _of_words(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch's rows in slices of at most `most` words; a longer text is a slice alone."""
    ends, lo = batch.column(1).offsets.to_numpy(), 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _cut(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted postings into blocks of one term; a block ends with its Arrow batch as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            if not len(batch):
                continue
            term = batch.column(2).dictionary_encode()
            code = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), term.indices.to_numpy()], 1)
            new = np.r_[True, (code[1:] != code[:-1]).any(1)]
            start = np.flatnonzero(new)
            place = np.arange(len(batch)) - np.repeat(start, np.diff(np.r_[start, len(batch)]))
            first = np.flatnonzero(place % block == 0)
            number = place[first] // block
            head = (batch.column(0)[0].as_py(), batch.column(1)[0].as_py(), batch.column(2)[0].as_py())
            if head == last:  # goes on from the batch before
                own = first < (start[1] if len(start) > 1 else len(batch))
                number[own] += at
            tail = first[first >= start[-1]]
            last, at = (batch.column(0)[-1].as_py(), batch.column(1)[-1].as_py(), batch.column(2)[-1].as_py()), int(number[len(first) - len(tail) :].max()) + 1
            offsets, took = pa.array(np.r_[first, len(batch)].astype(np.int32)), pa.array(first)
            lists = [pa.ListArray.from_arrays(offsets, batch.column(i)) for i in (4, 5, 6)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(took), batch.column(1).take(took), batch.column(2).take(took), pa.array(number.astype(np.int32)), batch.column(3).take(took), *lists],
                names=["bucket", "share", "term", "at", "most", "chunk_ids", "tf", "dl"],
            )

    return run


@dataclass
class Asked:
    """A block of questions: their ids, terms, and per asked term its questions, idf, largest weight and number of postings."""

    ids: pa.Array
    names: list[str]
    queries_of: list[np.ndarray]
    idf: np.ndarray
    most: np.ndarray
    df: np.ndarray


class Keywords:
    """A written store of postings."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        about = spark.read.parquet(f"{path}/about").first()
        self.n, self.avgdl, self.buckets, self.slots, self.postings = about["n"], about["avgdl"], about["buckets"], about["slots"], about["postings"]
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        self.terms, self.blocks, self.texts = (read(name) if self.postings else None for name in ("terms", "blocks", "texts"))

    def statistics(self) -> DataFrame:
        """(term, df, cf) of all terms."""
        return self.terms.select("term", "df", "cf") if self.postings else self.spark.createDataFrame([], "term string, df long, cf long")

    def _asked(self, part: pa.Table) -> tuple[Asked, list[int], DataFrame] | None:
        asking: dict[str, list[int]] = {}
        for q, terms in enumerate(part["terms"].to_pylist()):
            for t in terms or ():
                asking.setdefault(t, []).append(q)
        if not asking or not self.postings:
            return None
        table = self.spark.createDataFrame(pa.table({"term": sorted(asking)}))
        table = table.withColumn("bucket", term_bucket(F.col("term"), self.buckets))
        wanted = sorted({r[0] for r in table.select("bucket").distinct().collect()})
        found = self.terms.filter(F.col("bucket").isin(wanted)).join(F.broadcast(table), ["bucket", "term"]).select("term", "df", "most").orderBy("term").collect()  # a row an asked term
        if not found:
            return None
        df = np.array([r["df"] for r in found], float)
        idf = np.log(1 + (self.n - df + 0.5) / (df + 0.5))
        names = [r["term"] for r in found]
        asked = Asked(_whole(part["query_id"]), names, [np.array(asking[t]) for t in names], idf, idf * np.array([r["most"] for r in found]), df)
        numbers = self.spark.createDataFrame(pa.table({"term": names, "number": pa.array(range(len(names)), pa.int32()), "idf": idf}))
        return asked, wanted, numbers.withColumn("bucket", term_bucket(F.col("term"), self.buckets))

    def _rows(self, wanted: list[int], numbers: DataFrame, reads: Column) -> DataFrame:
        """(number, chunk_id, gain): postings of the asked terms' blocks that `reads` is true for."""
        blocks = self.blocks.filter(F.col("bucket").isin(wanted)).join(F.broadcast(numbers), ["bucket", "term"]).filter(reads)
        rows = blocks.select("number", "idf", F.explode(F.arrays_zip("chunk_ids", "tf", "dl")).alias("p"))
        gain = F.col("idf") * impact(F.col("p.tf"), F.col("p.dl"), self.avgdl)
        return rows.select("number", F.col("p.chunk_ids").alias("chunk_id"), gain.alias("gain"))

    def _summed(self, rows: DataFrame, asked: Asked, kind: str, k: int, floor: np.ndarray | None) -> DataFrame:
        """(query_id, chunk_id, score) summed over rows: the best k of each task and question, or all from a question's floor on."""
        shared = self.spark.sparkContext.broadcast((asked.ids, asked.queries_of, floor))
        key = rows.schema["chunk_id"].dataType.simpleString()

        def best(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            ids, queries_of, floor = shared.value
            table = pa.Table.from_batches(parts).combine_chunks()
            number, gain = table["number"].to_numpy(), table["gain"].to_numpy()
            coded = table["chunk_id"].combine_chunks().dictionary_encode()
            text = coded.indices.to_numpy()
            scores = np.zeros((len(ids), len(coded.dictionary)))
            order = np.argsort(number, kind="stable")
            edges = [0, *(np.flatnonzero(np.diff(number[order])) + 1).tolist(), len(order)]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                own = order[a:z]
                scores[np.ix_(queries_of[number[own[0]]], text[own])] += gain[own]
            least = floor if floor is not None else np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.zeros(len(scores))
            q, t = np.nonzero((scores >= least[:, None]) & (scores > 0))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(q)), coded.dictionary.take(pa.array(t)), pa.array(scores[q, t])], names=["query_id", "chunk_id", "score"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []
            for batch in batches:
                block = batch.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)] if len(block) else [0]
                for a, z in zip(edges[:-1], edges[1:], strict=True):
                    if held and block[a] != now:
                        yield best(held)
                        held = []
                    now = block[a]
                    held.append(batch.slice(a, z - a))
            if held:
                yield best(held)

        blocks = max(1, -(-self.n // BLOCK_TEXTS))
        tasks = min(MOST_TASKS, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), blocks // 64))
        laid = rows.select(F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int").alias("block"), "number", "chunk_id", "gain")
        return laid.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(run, f"query_id {kind}, chunk_id {key}, score double")

    def _cuts(self, asked: Asked, wanted: list[int], numbers: DataFrame, kind: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each term's cut, each question's lower bound of its k-th score, and what its cuts add up to."""
        first = self._summed(self._rows(wanted, numbers, F.col("at") == 0), asked, kind, k, None)
        last = top_k(first, ["query_id"], k, "chunk_id").filter(F.col("rank") == k).select("query_id", "score").collect()  # a row a question
        place = {v: i for i, v in enumerate(asked.ids.to_pylist())}
        bound = np.zeros(len(asked.ids))
        for r in last:
            bound[place[r["query_id"]]] = r["score"]
        terms_of: list[list[int]] = [[] for _ in bound]
        for t in np.argsort(-asked.df, kind="stable").tolist():  # longest lists first
            for q in asked.queries_of[t].tolist():
                terms_of[q].append(t)
        cut = np.full(len(asked.names), np.inf)
        for q, terms in enumerate(terms_of):
            left, rest = SKIPPED * bound[q], []
            for t in terms:
                if asked.most[t] <= left:
                    left -= asked.most[t]
                    cut[t] = min(cut[t], asked.most[t])
                else:
                    rest.append(t)
            for t in rest:
                cut[t] = min(cut[t], left / len(rest))
        skipped = np.array([cut[terms].sum() if terms else 0.0 for terms in terms_of])
        return cut, bound, skipped

    def search(self, queries: DataFrame, k: int = 12) -> DataFrame:
        """(query_id, chunk_id, score, rank): the best k texts for questions (query_id, terms array<string>)."""
        kind, found = queries.schema["query_id"].dataType.simpleString(), None
        for part in query_blocks(queries, F.array_distinct("terms").alias("terms")):
            known = self._asked(part)
            if known is None:
                continue
            asked, wanted, numbers = known
            cut, bound, skipped = self._cuts(asked, wanted, numbers, kind, k)
            rows = self._rows(wanted, self._with_cuts(numbers, cut), F.col("most") * F.col("idf") > F.col("cut"))
            some = kept(self._summed(rows, asked, kind, k, bound - skipped - ROUNDING), "keyword-candidates")
            # The k-th best of what is read is a better bound than that of the first blocks.
            spent = self.spark.createDataFrame(pa.table({"query_id": asked.ids, "skipped": skipped}), f"query_id {kind}, skipped double")
            least = top_k(some, ["query_id"], k, "chunk_id").filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
            stays = some.join(F.broadcast(spent), "query_id").join(F.broadcast(least), "query_id", "left").filter(F.col("score") >= F.coalesce(F.col("least") - F.col("skipped") - ROUNDING, F.lit(0.0)))
            hits = self._whole(stays.select("query_id", "chunk_id"), asked, kind)
            found = hits if found is None else found.unionByName(hits)
        if found is None:
            key = self.texts.schema["chunk_id"].dataType.simpleString() if self.postings else "string"
            return self.spark.createDataFrame([], f"query_id {kind}, chunk_id {key}, score double, rank int")
        return top_k(found, ["query_id"], k, "chunk_id")

    def _with_cuts(self, numbers: DataFrame, cut: np.ndarray) -> DataFrame:
        cuts = self.spark.createDataFrame(pa.table({"number": pa.array(range(len(cut)), pa.int32()), "cut": cut}))
        return numbers.join(F.broadcast(cuts), "number")

    def _whole(self, pairs: DataFrame, asked: Asked, kind: str) -> DataFrame:
        """(query_id, chunk_id, score) of pairs (query_id, chunk_id), from the texts' own terms."""
        names = {t: i for i, t in enumerate(asked.names)}
        place = {v: i for i, v in enumerate(asked.ids.to_pylist())}
        by_query: list[set[int]] = [set() for _ in range(len(asked.ids))]
        for t, own in enumerate(asked.queries_of):
            for q in own.tolist():
                by_query[q].add(t)
        shared = self.spark.sparkContext.broadcast((names, place, by_query, asked.idf))
        avgdl, key = self.avgdl, self.texts.schema["chunk_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, place, by_query, idf = shared.value
            for batch in batches:
                out: tuple[list, list, list] = ([], [], [])
                for chunk, dl, terms, tf, asks in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    gain = {names[t]: idf[names[t]] * (n * (K1 + 1) / (n + K1 * (1 - B + B * dl / avgdl))) for t, n in zip(terms, tf, strict=True) if t in names}
                    for q in asks:
                        out[0].append(q)
                        out[1].append(chunk)
                        out[2].append(round(sum(gain[t] for t in sorted(by_query[place[q]] & gain.keys())), 6))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(4).type.value_type), pa.array(out[1], batch.column(0).type), pa.array(out[2], pa.float64())], names=["query_id", "chunk_id", "score"])

        asks = pairs.groupBy("chunk_id").agg(F.collect_list("query_id").alias("asks"))  # at most the questions of a block
        asks = asks.withColumn("slot", F.pmod(F.xxhash64("chunk_id"), F.lit(self.slots)).cast("int"))
        there = self.texts.join(asks, ["slot", "chunk_id"]).select("chunk_id", "dl", "terms", "tf", "asks")
        return there.mapInArrow(run, f"query_id {kind}, chunk_id {key}, score double").filter("score > 0")

    def reading(self, queries: DataFrame, k: int = 12) -> DataFrame:
        """(term, df, read): postings of each asked term's list, and those in blocks that a search reads beyond the first ones."""
        kind, out = queries.schema["query_id"].dataType.simpleString(), None
        for part in query_blocks(queries, F.array_distinct("terms").alias("terms")):
            known = self._asked(part)
            if known is None:
                continue
            asked, wanted, numbers = known
            cut, _, _ = self._cuts(asked, wanted, numbers, kind, k)
            blocks = self.blocks.filter(F.col("bucket").isin(wanted)).join(F.broadcast(self._with_cuts(numbers, cut)), ["bucket", "term"])
            size = F.size("chunk_ids")
            one = blocks.groupBy("term").agg(F.sum(size).alias("df"), F.coalesce(F.sum(F.when((F.col("at") == 0) | (F.col("most") * F.col("idf") > F.col("cut")), size)), F.lit(0)).alias("read"))
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], "term string, df long, read long") if out is None else out
