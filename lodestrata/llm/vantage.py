"""Approximate nearest neighbours by inner product: a vantage-point tree in every shard, pruned by the triangle inequality.

A tree over a bounded sample (SAMPLE vectors, by a hash of the content) deals all rows to at most CELLS cells, each cell to
shards of bounded size, and each shard builds a tree of its own rows: at a node, the rows nearer to the vantage point
than the median go inside, the others outside, and the distances' least and largest value on either side are kept. A
query first searches the cell that it falls into; the distance of its k-th row found there then selects the other cells.
Cells and leaves are left out where factor * bound > that distance, the bound being what the triangle inequality gives from
the intervals on the way down. factor 1 leaves nothing out that could matter: the search is exact. A larger factor
reads less. On vectors without structure the bounds are weak, so FACTOR is measured (README); `recall` does it anew.

Rows that take no part: null ids, and vectors that are null, empty or zero, hold a null or non-finite component, or have a squared length
beyond the doubles. Rows equal in id and vector count once, rows of several vectors under one id are all candidates, and a query never
finds rows of its own id. A shorter vector counts as padded with zeros. Ties go to the smaller id. Without usable
rows the result is empty. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm import metric
from lodestrata.llm.common import stage

SAMPLE, CELLS = 16_384, 1_024
#: Numbers in a shard's matrix, rows of a leaf; pruning factor of the query.
SHARD_VALUES, LEAF_ROWS = 1 << 20, 128
FACTOR = 5.0
#: Rounding of distances: bounds are loosened by this share of the longest row.
SLACK = 1e-7


class Tree:
    """A complete vantage-point tree in heap order: node i has children 2i + 1 (inside) and 2i + 2 (outside).

    points: the vantage points; splits: each node's median distance; spans: least and largest distance inside, then outside.
    """

    def __init__(self, points: np.ndarray, splits: np.ndarray, spans: np.ndarray) -> None:
        self.points, self.splits, self.spans = points, splits, spans
        self.depth = (len(splits) + 1).bit_length() - 1

    @classmethod
    def build(cls, rows: np.ndarray, depth: int) -> tuple[Tree, np.ndarray]:
        """The tree over rows and each row's leaf, from 0."""
        nodes = (1 << depth) - 1
        points, splits, spans = np.zeros((nodes, rows.shape[1])), np.zeros(nodes), np.zeros((nodes, 4))
        leaf = np.zeros(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            if node >= nodes:
                leaf[own] = node - nodes
                continue
            if not len(own):
                spans[node] = np.inf, -np.inf, np.inf, -np.inf
                todo += [(2 * node + 1, own), (2 * node + 2, own)]
                continue
            tried = rows[own[np.linspace(0, len(own) - 1, min(8, len(own))).astype(int)]]
            some = rows[own[np.linspace(0, len(own) - 1, min(256, len(own))).astype(int)]]
            points[node] = tried[distances(some, tried).var(0).argmax()]  # the point that tells the rows apart best
            far = distances(rows[own], points[node : node + 1])[:, 0]
            order = np.argsort(far, kind="stable")
            half = len(own) // 2
            splits[node] = far[order[half]]
            inside, outside = own[far < splits[node]], own[far >= splits[node]]
            for at, side in ((0, far[far < splits[node]]), (2, far[far >= splits[node]])):
                spans[node, at : at + 2] = (side.min(), side.max()) if len(side) else (np.inf, -np.inf)
            todo += [(2 * node + 1, inside), (2 * node + 2, outside)]
        return cls(points, splits, spans), leaf

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf that each row falls into."""
        node = np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            d = np.sqrt(np.maximum(((rows - self.points[node]) ** 2).sum(1), 0))
            node = 2 * node + 1 + (d >= self.splits[node])
        return node - len(self.splits)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """A lower bound of each query's distance to the rows of each leaf."""
        far = distances(queries, self.points) if len(self.points) else np.zeros((len(queries), 0))
        low = np.zeros((len(queries), 1))
        for level in range(self.depth):
            at = slice((1 << level) - 1, (1 << (level + 1)) - 1)
            d, s = far[:, at, None], self.spans[None, at].reshape(1, -1, 2, 2)
            own = np.maximum(s[..., 0] - d, d - s[..., 1])  # inside and outside
            low = np.maximum(low[:, :, None], own).reshape(len(queries), -1)
        return low


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def lifted(rows: np.ndarray, longest: float) -> np.ndarray:
    """Rows with the component that gives all of them one length."""
    return np.c_[rows, np.sqrt(np.maximum(longest - (rows * rows).sum(1), 0))]


def search_shard(points, splits, spans, ends, rows, queries, limit, longest, k, factor):
    """(query, row, score) of the k best rows of a shard for each query, ties by position; limit: a distance that counts already.

    The shard's rows stand leaf by leaf, ends being the leaves' ends.
    """
    tree = Tree(points, splits, spans)
    low = tree.bounds(np.c_[queries, np.zeros(len(queries))])
    length = (queries * queries).sum(1) + longest
    slack = SLACK * np.sqrt(longest + 1e-300)
    floor = np.where(np.isfinite(limit), (length - limit**2) / 2 - SLACK * length, -np.inf)  # the score that a row must reach
    top = np.full((len(queries), k), -np.inf)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def look(leaf: int, who: np.ndarray) -> None:
        a, z = ends[leaf], ends[leaf + 1]
        scores = queries[who] @ rows[a:z].T
        both = np.c_[top[who], scores]
        top[who] = np.partition(both, -k, axis=1)[:, -k:]
        floor[who] = np.maximum(floor[who], top[who].min(1) - SLACK * length[who])
        q, r = np.nonzero(scores >= floor[who][:, None])
        kept.append((who[q], r + a, scores[q, r]))

    first = low.argmin(1)
    for leaf in np.unique(first):
        look(leaf, np.flatnonzero(first == leaf))
    for leaf in np.argsort(low.mean(0)):
        if ends[leaf] < ends[leaf + 1]:
            reach = np.sqrt(np.maximum(length - 2 * floor, 0))
            who = np.flatnonzero((first != leaf) & (factor * (low[:, leaf] - slack) <= reach))
            if len(who):
                look(leaf, who)
    who, row, score = (np.concatenate(x) for x in zip(*kept, strict=True))
    stays = score >= floor[who]
    return who[stays], row[stays]


def candidates(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector) of the rows that take part."""
    v = F.col(vector)
    size = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return vectors.select(key, vector).filter(F.col(key).isNotNull() & metric.usable(v)).filter((size > 0) & (size < F.lit(float("inf"))))


class Index:
    """Shards with their trees, staged in the shared folder, and the tree of the cells."""

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, shard_values: int = SHARD_VALUES) -> None:
        """k: the most neighbours that a search will ask for."""
        self.key, self.k = key, k
        rows = stage(metric.once(candidates(vectors, key, vector).withColumnRenamed(vector, "vector"), ["vector"], key, k + 1), "vantage-rows")
        size = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        about = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.max(size).alias("longest")).first()
        self.n, self.width, self.longest = about["n"], about["width"] or 1, about["longest"] or 0.0
        self.kind = vectors.schema[key].dataType.simpleString()
        width, longest = self.width, self.longest
        most = max(LEAF_ROWS, shard_values // (width + 1))
        sample = metric.sampled(rows, self.n, SAMPLE, "vector").select("vector").toArrow()["vector"].combine_chunks()
        depth = min((CELLS - 1).bit_length(), max(0, (-(-self.n // most) - 1).bit_length()), max(0, (len(sample) // 16).bit_length() - 1))
        self.cells, _ = Tree.build(lifted(metric.matrix(sample, width), longest), depth)
        # Spans of the sample are not those of all rows: a cell is known by the split alone.
        self.cells.spans = np.stack([np.zeros_like(self.cells.splits), self.cells.splits, self.cells.splits, np.full_like(self.cells.splits, np.inf)], 1)
        cells = rows.sparkSession.sparkContext.broadcast((self.cells.points, self.cells.splits, self.cells.spans))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = Tree(*cells.value)
            for batch in batches:
                at = tree.leaves(lifted(metric.matrix(batch.column(1), width), longest))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["ids", "vector", "cell"])

        dealt = rows.select("ids", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(deal, f"ids array<{self.kind}>, vector array<double>, cell long")
        counts = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().collect()}  # a row a cell
        shares = rows.sparkSession.createDataFrame([(c, -(-n // most)) for c, n in counts.items()], "cell long, shares int")
        tasks = min(metric.MOST_TASKS, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(-(-n // most) for n in counts.values()) // 4))
        shard = F.pmod(F.xxhash64("vector"), F.col("shares")) * F.lit(CELLS) + F.col("cell")
        laid = dealt.join(F.broadcast(shares), "cell").select(shard.alias("shard"), "ids", "vector").repartition(tasks, "shard").sortWithinPartitions("shard")

        def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for own, table in groups(batches):
                x, ids = metric.matrix(table["vector"].combine_chunks(), width), table["ids"].combine_chunks()
                order = np.argsort(ids.values.take(ids.offsets[:-1]).to_numpy(zero_copy_only=False), kind="stable")  # ties by position are ties by id
                x, ids = x[order], ids.take(pa.array(order))
                depth = max(0, (-(-len(x) // LEAF_ROWS) - 1).bit_length())
                tree, leaf = Tree.build(lifted(x, longest), depth)
                order = np.argsort(leaf, kind="stable")
                ends = np.searchsorted(leaf[order], np.arange((1 << depth) + 1))
                body = metric.pack(tree.points, tree.splits, tree.spans, ends, x[order], np.asarray(ids.take(pa.array(order)).to_pylist(), dtype=object))
                yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([body], pa.binary())], names=["shard", "body"])

        self.shards = stage(laid.mapInArrow(plant, "shard long, body binary"), "vantage-shards")
        self.shares = {c: -(-n // most) for c, n in counts.items()}

    def search(self, queries: DataFrame, k: int | None = None, factor: float = FACTOR, exclude_own: bool = True) -> DataFrame:
        """(query_id, rank, key, score) for queries (query_id, vector): the k nearest rows found, nearest first."""
        k, kind, width, longest = k or self.k, queries.schema["query_id"].dataType.simpleString(), self.width, self.longest
        if k > self.k:
            raise ValueError(f"the index keeps {self.k} rows of equal vectors: build it with k={k}")
        spark = queries.sparkSession
        out = f"query_id {kind}, rank int, `{self.key}` {self.kind}, score double"
        if not self.n:
            return spark.createDataFrame([], out)
        asked = candidates(queries, "query_id", "vector").dropDuplicates().select(F.monotonically_increasing_id().alias("ask"), "query_id", F.col("vector").cast("array<double>").alias("vector"))
        asked = stage(asked, "vantage-queries")
        shares = [self.shares.get(c, 0) for c in range(1 << self.cells.depth)]
        cells = spark.sparkContext.broadcast((self.cells.points, self.cells.splits, self.cells.spans, shares))
        need = k + 1

        def route(home: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                *parts, shares = cells.value
                tree = Tree(*parts)
                for batch in batches:
                    if not len(batch):
                        continue
                    q, limit = metric.matrix(batch.column(1), width), batch.column(2).to_numpy(zero_copy_only=False)
                    low = tree.bounds(np.c_[q, np.zeros(len(q))])
                    low[:, [c for c, n in enumerate(shares) if not n]] = np.inf
                    own = low.argmin(1)
                    asks = np.zeros(low.shape, bool)
                    if home:
                        asks[np.arange(len(q)), own] = True
                    else:
                        asks = np.isfinite(low) & (factor * (low - SLACK * np.sqrt(longest)) <= limit[:, None])
                        asks[np.arange(len(q)), own] = False
                    row, cell = np.nonzero(asks)
                    times = np.array(shares)[cell]
                    row, cell = np.repeat(row, times), np.repeat(cell, times)
                    share = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((share * CELLS + cell).astype(np.int64)), batch.column(0).take(at), batch.column(1).take(at), metric.lists(limit[row][:, None])],
                        names=["shard", "ask", "vector", "extra"],
                    )

            return run

        def answer(shard, ask, vectors, extra) -> pa.RecordBatch:
            *tree, ends, rows, ids = shard
            who, row = search_shard(*tree, ends, rows, vectors, extra[:, 0], longest, need, factor)
            score = (vectors[who] * rows[row]).cumsum(1)[:, -1]  # one order of addition: equal vectors score alike
            place = np.argsort(np.argsort(np.array([i[0] for i in ids]), kind="stable"))  # by smallest id
            best = metric.best_rows(who, score, place[row], need)
            listed = pa.array([list(ids[r]) for r in row[best]], pa.list_(first_kind))
            return pa.RecordBatch.from_arrays([pa.array(ask[who[best]]), listed, pa.array(score[best])], names=["ask", "ids", "score"])

        first_kind = pa.string() if self.kind == "string" else pa.int32() if self.kind == "int" else pa.int64()
        route_kind, found_kind = "shard long, ask long, vector array<double>, extra array<double>", f"ask long, ids array<{self.kind}>, score double"

        def found(asks: DataFrame) -> DataFrame:
            hits = metric.meet(self.shards, asks, answer, found_kind, width, 1).select("ask", F.explode("ids").alias("found"), "score")
            named = hits.join(asked.select("ask", "query_id"), "ask")
            return named.filter(F.col("found") != F.col("query_id")) if exclude_own else named

        ranked = Window.partitionBy("ask").orderBy(F.desc("score"), "found")
        at_home = asked.select("ask", "vector", F.lit(float("inf")).alias("reach")).mapInArrow(route(True), route_kind)
        near = stage(found(at_home).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k), "vantage-near")
        last = near.filter(F.col("rank") == k).select("ask", F.col("score").alias("least"))
        size = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
        reach = F.coalesce(F.sqrt(F.greatest(F.lit(0.0), size + F.lit(longest) - 2 * F.col("least"))) + F.lit(SLACK) * F.sqrt(size + F.lit(longest)), F.lit(float("inf")))
        open_ = asked.join(last, "ask", "left").select("ask", "vector", reach.alias("reach"))
        rest = found(open_.mapInArrow(route(False), route_kind))
        all_ = near.drop("rank").unionByName(rest).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
        return all_.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias(self.key), "score")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each value of the first column, which come together; one group is held at a time."""
    now, held = None, []
    for batch in batches:
        key = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else [0]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            if held and key[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(key[a])
            held.append(batch.slice(a, z - a))
    if held:
        yield now, pa.Table.from_batches(held)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, factor: float = FACTOR, key: str = "vec_id", vector: str = "embedding", shard_values: int = SHARD_VALUES) -> DataFrame:
    """(query_id, rank, key, score): the k nearest other rows of each row whose whole-number id is divisible by `every`."""
    queries = vectors.filter(F.pmod(F.col(key), F.lit(every)) == 0).select(F.col(key).alias("query_id"), F.col(vector).alias("vector"))
    return Index(vectors, key, vector, k, shard_values).search(queries, k, factor)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> float:
    """The share of the exact result's rows that were found."""
    both = exact.select("query_id", key).join(found.select("query_id", key), ["query_id", key], "left_semi").count()
    return both / max(1, exact.count())
