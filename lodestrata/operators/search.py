"""Keyword and vector search over many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import tokens
from lodestrata.sources.stores import kept

K1, B = 1.2, 0.75
QUERY_BLOCK = 4096
BLOCK_TEXTS = 1000
PIECE_ROWS = 1000
#: Pairs that a task scores at a time; queries that meet in one task, at least and at most, and rows of a share.
PIECE_SCORES, LEAST_QUERIES, SHARE_QUERIES, SHARE_ROWS, MOST_TASKS = 1 << 20, 1024, 16_384, 262_144, 20_000
#: Scores are rounded to six decimals: one this much lower can still tie.
ROUNDING = 1e-6


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(term, key, tf, dl): term frequencies and the text's length in tokens, counted within each text: no shuffle."""
    kind = chunks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(1)
            ends = listed.offsets.to_numpy()
            length = np.diff(ends)
            coded = listed.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
            if not len(coded):
                continue
            terms = coded.dictionary
            pair, times = np.unique(np.repeat(np.arange(len(batch)), length) * len(terms) + coded.indices.to_numpy(), return_counts=True)
            row, code = pair // len(terms), pair % len(terms)
            yield pa.RecordBatch.from_arrays(
                [terms.take(pa.array(code)), batch.column(0).take(pa.array(row)), pa.array(times.astype(np.int64)), pa.array(length[row].astype(np.int64))],
                names=["term", key, "tf", "dl"],
            )

    listed = chunks.select(key, F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("t"))
    return listed.mapInArrow(run, f"term string, `{key}` {kind}, tf long, dl long")


def corpus_statistics(chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row: n texts and their mean length in tokens."""
    return chunks.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col(text)))).alias("avgdl"))


def bm25(queries: DataFrame, chunks: DataFrame, k: int = 12, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Top k texts for each query (query_id, terms array<string>), from the texts themselves: see bm25_postings.

    For many batches of questions store the postings instead; here every batch reads and counts all texts twice.
    """
    size = corpus_statistics(chunks, text).first()
    return bm25_postings(queries, postings(chunks, key, text), size["n"], size["avgdl"] or 1.0, k, key)


def query_blocks(queries: DataFrame, *columns) -> Iterator[pa.Table]:
    """The queries' columns in blocks of at most about QUERY_BLOCK rows, one read where they are one block.

    More are written to the shared folder first, so what they come from is not worked out again for each block.
    """
    asked = queries.select("query_id", *columns)
    first = asked.limit(QUERY_BLOCK + 1).toArrow()
    if len(first) <= QUERY_BLOCK:
        if len(first):
            yield first.combine_chunks()
        return
    asked = kept(asked, "queries")
    blocks = -(-asked.count() // QUERY_BLOCK)
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        if len(part):
            yield part.combine_chunks()


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) and column.num_chunks != 1 else column.chunk(0)


def bm25_postings(
    queries: DataFrame, index: DataFrame, n: int, avgdl: float, k: int = 12, key: str = "chunk_id",
) -> DataFrame:
    """Top k texts for each query, from postings (term, key, tf, dl): (query_id, key, score, rank).

    The asked terms' lists go once to the tasks of their texts, however many queries ask for the term. A task holds BLOCK_TEXTS texts' scores for all
    queries of a block as a matrix and gives out the best k a query. Queries come in blocks of QUERY_BLOCK. Scores
    are rounded to six decimals and ties go by key. Stored postings are searched by `impacts`.
    """
    spark = index.sparkSession
    found = None
    kind, key_kind = queries.schema["query_id"].dataType.simpleString(), index.schema[key].dataType.simpleString()
    for part in query_blocks(queries, F.array_distinct("terms").alias("terms")):
        asking: dict[str, list[int]] = {}
        for q, terms in enumerate(part["terms"].to_pylist()):
            for t in terms or ():
                asking.setdefault(t, []).append(q)
        if not asking:
            continue
        names = sorted(asking)
        asked = spark.createDataFrame(pa.table({"term": names, "at": pa.array(range(len(names)), pa.int32())}))
        lists = index.join(F.broadcast(asked), "term").select("at", key, "tf", "dl")
        counted = lists.groupBy("at").agg(F.count("*").alias("df"))
        df = {r["at"]: r["df"] for r in counted.collect()}  # a row an asked term
        idf = np.array([np.log(1 + (n - df.get(i, 0) + 0.5) / (df.get(i, 0) + 0.5)) for i in range(len(names))])
        shared = spark.sparkContext.broadcast((_whole(part["query_id"]), [np.array(asking[t]) for t in names], idf))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, queries_of, idf = shared.value
            now, held = None, []
            for batch in batches:
                block = batch.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)] if len(block) else [0]
                for a, z in zip(edges[:-1], edges[1:], strict=True):
                    if held and block[a] != now:
                        yield _best(held, ids, queries_of, idf, avgdl, k, key)
                        held = []
                    now = block[a]
                    held.append(batch.slice(a, z - a))
            if held:
                yield _best(held, ids, queries_of, idf, avgdl, k, key)

        texts = F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // BLOCK_TEXTS)))).cast("int")
        rows = lists.select(texts.alias("block"), "at", key, "tf", "dl").repartition(
            int(spark.conf.get("spark.sql.shuffle.partitions")), "block",
        ).sortWithinPartitions("block", key)
        hits = rows.mapInArrow(run, f"query_id {kind}, `{key}` {key_kind}, score double")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], f"query_id {kind}, `{key}` {key_kind}, score double, rank int")
    return top_k(found, ["query_id"], k, key)


def _best(parts: list[pa.RecordBatch], ids: pa.Array, queries_of: list[np.ndarray], idf: np.ndarray, avgdl: float, k: int, key: str) -> pa.RecordBatch:
    """The best k texts of a block for each query, those that tie with the last one too. Rows come sorted by text."""
    table = pa.Table.from_batches(parts).combine_chunks()
    at, tf, dl = (table.column(c).to_numpy() for c in ("at", "tf", "dl"))
    coded = table.column(key).combine_chunks().dictionary_encode()
    text = coded.indices.to_numpy()
    gain = idf[at] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)))
    scores = np.zeros((len(ids), len(coded.dictionary)))
    order = np.argsort(at, kind="stable")
    edges = [0, *(np.flatnonzero(np.diff(at[order])) + 1).tolist(), len(order)]
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        rows = order[a:z]
        scores[np.ix_(queries_of[at[rows[0]]], text[rows])] += gain[rows]
    scores = np.round(scores, 6)
    least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.zeros(len(scores))
    q, t = np.nonzero((scores >= least[:, None]) & (scores > 0))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(q)), coded.dictionary.take(pa.array(t)), pa.array(scores[q, t])], names=["query_id", key, "score"])


def top_k(scored: DataFrame, by: list[str], k: int, key: str, score: str = "score") -> DataFrame:
    """Highest scores in each group, ties by key, with rank from 1."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _true(table: np.ndarray) -> np.ndarray:
    """Places of the true ones in a table, row by row; eight are looked at together, as few are true."""
    flat = table.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return at[flat[at]]


class Best:
    """The best k scores of each query so far, with their keys; ties go by key, so no more than k a query stay however many rows are equal."""

    def __init__(self, n: int, k: int, least: float | np.ndarray = -np.inf) -> None:
        """least: the score that a query's rows must have."""
        self.k, self.least = k, np.array(np.broadcast_to(least, n), float)
        self.query, self.score, self.key = [], [], []
        self.size = 0

    def add(self, who: np.ndarray, scores: np.ndarray, keys: pa.Array, age: np.ndarray | None = None, born: np.ndarray | None = None) -> None:
        """scores: a row for each query in who, a column for each key; with ages, only keys born before a query are its own."""
        q, c = np.nonzero(scores >= (self.least[who] - ROUNDING)[:, None])
        if age is not None:
            older = born[c] < age[q]
            q, c = q[older], c[older]
        score, who = np.round(scores[q, c], 6), who[q]
        enough = score >= self.least[who]
        self._keep(who[enough], score[enough], keys.take(pa.array(c[enough])))

    def meet(self, who: np.ndarray, q: np.ndarray, x: np.ndarray, keys: pa.Array, age: np.ndarray | None = None, born: np.ndarray | None = None) -> None:
        """As add, for the scores of the queries q against the rows x: single precision finds the pairs that can be high enough, which alone are scored in double."""
        if not len(who) or not len(x):
            return
        length = np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1).max())
        if not (length < 1e30).all():
            self.add(who, q @ x.T, keys, age, born)
            return
        slack = (2 * q.shape[1] + 8) * 2.0**-24 * length
        low = q.astype(np.float32) @ x.astype(np.float32).T
        if age is not None and born.max() >= age.min():
            low[born[None, :] >= age[:, None]] = -np.inf
        reach = lambda least: np.maximum(least - ROUNDING - slack, -1e38).astype(np.float32)[:, None]
        at = _true(low >= reach(self.least[who]))
        if len(at) > 4 * self.k * len(who) and len(x) > self.k:
            # Of each query k of these rows score this much, so less is not among its best.
            kth = np.partition(low, len(x) - self.k, axis=1)[:, len(x) - self.k].astype(float) - slack - ROUNDING
            at = _true(low >= reach(np.maximum(self.least[who], kth)))
        row, column = np.divmod(at, len(x))
        score = np.round(np.einsum("ij,ij->i", q[row], x[column]), 6)
        enough = score >= self.least[who[row]]
        self._keep(who[row[enough]], score[enough], keys.take(pa.array(column[enough])))

    def _keep(self, query: np.ndarray, score: np.ndarray, key: pa.Array) -> None:
        self.query.append(query.astype(np.int32))
        self.score.append(score)
        self.key.append(key)
        self.size += len(query)
        if self.size > 2 * self.k * len(self.least) + PIECE_SCORES:
            self._cut()

    def _cut(self) -> None:
        query, score, key = np.concatenate(self.query), np.concatenate(self.score), pa.concat_arrays(self.key)
        order = np.lexsort((-score, query))
        query, score = query[order], score[order]
        first = np.searchsorted(query, np.arange(len(self.least)))
        full = np.diff(np.append(first, len(query))) >= self.k
        self.least[full] = score[first[full] + self.k - 1]
        tied = np.flatnonzero(full[query] & (score == self.least[query]))
        stays = (score > self.least[query]) | ~full[query]
        if len(tied):
            # Of those that tie with a query's last one, the smallest keys.
            left = self.k - np.bincount(query[stays], minlength=len(self.least))[query[tied]]
            named = pa.table({"query": query[tied], "key": key.take(pa.array(order[tied]))})
            by_key = pc.sort_indices(named, [("query", "ascending"), ("key", "ascending")]).to_numpy()
            of = query[tied][by_key]
            place = np.arange(len(of)) - np.searchsorted(of, of)
            stays[tied[by_key[place < left[by_key]]]] = True
        self.query, self.score, self.key = [query[stays]], [score[stays]], [key.take(pa.array(order[stays]))]
        self.size = int(stays.sum())

    def found(self) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
        """Number of the query, score and key of what is left; None where nothing is."""
        if not self.size:
            return None
        self._cut()
        return self.query[0], self.score[0], self.key[0]

    def rows(self, names: pa.Array) -> Iterator[pa.RecordBatch]:
        if found := self.found():
            yield pa.RecordBatch.from_arrays([names.take(pa.array(found[0])), found[2], pa.array(found[1])], names=["query_id", "chunk_id", "score"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class _Asked:
    """Queries as a matrix in the order of their ages, and the best rows for each so far."""

    def __init__(self, names: pa.Array, vectors: pa.Array, age: np.ndarray | None, k: int, threshold: float) -> None:
        order = np.arange(len(names)) if age is None else np.argsort(age, kind="stable")
        self.names, self.matrix, self.age = names.take(pa.array(order)), _matrix(vectors)[order], None if age is None else age[order]
        self.best = Best(len(names), k, threshold if threshold > 0 else -np.inf)

    def see(self, keys: pa.Array, vectors: pa.Array, born: np.ndarray | None) -> None:
        for lo in range(0, len(keys) if len(self.names) else 0, PIECE_ROWS):
            piece = slice(lo, lo + PIECE_ROWS)
            rows = _matrix(vectors.slice(lo, PIECE_ROWS))
            old = born[piece] if self.age is not None else None
            # Queries that are older than all rows of the piece see none of them.
            first = 0 if old is None else int(np.searchsorted(self.age, old.min(), side="right"))
            for a in range(first, len(self.matrix), PIECE_SCORES // PIECE_ROWS):
                z = min(len(self.matrix), a + PIECE_SCORES // PIECE_ROWS)
                self.best.meet(np.arange(a, z), self.matrix[a:z], rows, keys.slice(lo, PIECE_ROWS), None if old is None else self.age[a:z], old)

    def rows(self) -> Iterator[pa.RecordBatch]:
        return self.best.rows(self.names)


def knn(queries: DataFrame, corpus: DataFrame, k: int = 12, older_only: bool = False, threshold: float = 0.0) -> DataFrame:
    """Exact nearest neighbours by inner product: (query_id, chunk_id, score, rank).

    queries: (query_id, embedding[, seq]); corpus: (chunk_id, embedding[, seq]). At most QUERY_BLOCK queries are broadcast as a matrix that
    every task multiplies its rows by. More are shuffled, not passed through the driver: shares of the queries meet shares of the rows, a
    task for each two, which holds its queries and lets the rows go by. Either way a task scores PIECE_SCORES pairs at a time and gives out
    the best k a query. older_only: a query sees only rows of smaller seq. threshold: a least score, if above 0.
    """
    spark = corpus.sparkSession
    there = ["chunk_id", "embedding", *(["seq"] if older_only else [])]
    kind = queries.schema["query_id"].dataType.simpleString()
    out = f"query_id {kind}, chunk_id string, score double"
    asked = queries.select("query_id", *there[1:])
    block = asked.limit(QUERY_BLOCK + 1).toArrow()
    if not len(block):
        return spark.createDataFrame([], f"{out}, rank int")
    if len(block) > QUERY_BLOCK:
        return top_k(_dealt(kept(asked, "queries"), corpus.select(*there), k, threshold, out), ["query_id"], k, "chunk_id")
    shared = spark.sparkContext.broadcast((_whole(block["query_id"]), _whole(block["embedding"]), block["seq"].to_numpy() if older_only else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Asked(*shared.value, k, threshold)
        for batch in batches:
            held.see(batch.column(0), batch.column(1), batch.column(2).to_numpy() if older_only else None)
        yield from held.rows()

    return top_k(corpus.select(*there).mapInArrow(run, out), ["query_id"], k, "chunk_id")


def _dealt(asked: DataFrame, corpus: DataFrame, k: int, threshold: float, out: str) -> DataFrame:
    """Each share's best: every query once to each share of the rows, every row once to each share of the queries."""
    older_only = "seq" in corpus.columns
    n, tasks = asked.count(), 2 * asked.sparkSession.sparkContext.defaultParallelism
    row_shares = -(-max(1, corpus.count()) // SHARE_ROWS)
    query_shares = max(-(-n // SHARE_QUERIES), min(-(-n // LEAST_QUERIES), -(-tasks // row_shares)))
    share = lambda of, n: F.pmod(F.xxhash64(of), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    absent = lambda of, name: F.lit(None).cast(of.schema[name].dataType)
    seq = F.col("seq").cast("long") if older_only else F.lit(None).cast("long")
    body = F.col("embedding").cast(corpus.schema["embedding"].dataType)
    left = asked.select(every(row_shares).alias("row_share"), share("query_id", query_shares).alias("query_share"), F.lit(0).alias("part"), seq.alias("seq"), "query_id", absent(corpus, "chunk_id").alias("chunk_id"), body.alias("embedding"))
    right = corpus.select(share("chunk_id", row_shares).alias("row_share"), every(query_shares).alias("query_share"), F.lit(1).alias("part"), seq.alias("seq"), absent(asked, "query_id").alias("query_id"), "chunk_id", "embedding")
    by = ["row_share", "query_share"]
    met = left.unionByName(right).repartition(min(MOST_TASKS, 2 * row_shares * query_shares), *by).sortWithinPartitions(*by, "part", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, held = None, [], None
        for batch in batches:
            at = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            edges = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)] if len(at) else [0]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, z - a)
                if tuple(at[a, :2]) != now:
                    if held is not None:
                        yield from held.rows()
                    now, waiting, held = tuple(at[a, :2]), [], None
                if not at[a, 2]:
                    waiting.append(part)
                    continue
                if held is None:
                    whole = pa.Table.from_batches(waiting or [part.slice(0, 0)]).combine_chunks()
                    held, waiting = _Asked(_whole(whole["query_id"]), _whole(whole["embedding"]), whole["seq"].to_numpy() if older_only else None, k, threshold), []
                held.see(part.column(5), part.column(6), part.column(3).to_numpy() if older_only else None)
        if held is not None:
            yield from held.rows()

    return met.mapInArrow(run, out)


def token_filter(wanted: str, column: str):
    """All tokens of a filter value occur in the column, in any order."""
    return F.forall(tokens(F.lit(wanted)), lambda t: F.array_contains(tokens(F.col(column)), t))


def metadata_filter(metadata: DataFrame, filters: dict[str, str | None]) -> DataFrame | None:
    """Ids of the documents that satisfy every clause; None without clauses.

    title and author match by tokens, created_date, source_type and language exactly.
    """
    known = ("title", "author", "created_date", "source_type", "language")
    if unknown := set(filters) - set(known):
        raise ValueError(f"unknown filter {sorted(unknown)}")
    clauses = {k: v for k, v in filters.items() if v is not None}
    if not clauses:
        return None
    out = metadata
    for k, v in clauses.items():
        out = out.filter(token_filter(v, k) if k in ("title", "author") else F.col(k) == v)
    return out.select("document_id").distinct()


def tagged(rows: DataFrame, asked: dict[str, str | list[str] | None]) -> DataFrame:
    """Rows that satisfy every clause: a column's value, or every asked tag in its array; nulls ask nothing."""
    out = rows
    for column, value in asked.items():
        if isinstance(value, list):
            out = out.filter(F.size(F.array_except(F.array(*map(F.lit, value)), F.col(column))) == 0) if value else out
        elif value is not None:
            out = out.filter(F.col(column) == value)
    return out
