"""Hard-negative mining through one-dimensional distance keys.

Every row goes to the nearest of a few pivots, and rows are stored sorted by (pivot, distance to it), in pages of bounded
size. A row at distance r of an anchor has a key within r of the anchor's own distance to that pivot, so a search reads
the pages whose key interval comes near enough and widens its reach, round by round, reading only the new annulus, until the
k-th row found is nearer than anything beyond the reach: then the result is exact. Inner products become distances as
in `metric`. Negatives lie in a band of scores below the positive's, so their search starts at the band's near end
and stops at its far end.

Vectors hold whole numbers as doubles; a row whose squared length is 2^53 or more takes no part, as its scores could not be
exact. Rows that take no part either: null ids, null labels, and vectors that are null, empty or hold a null or non-finite component.
Zero vectors take part. Rows equal in id, label and vector count once; rows that share an anchor's id are not its
positives. A shorter vector counts as padded with zeros. Ties go to the smaller id. Without usable rows the result is empty.
Ids and labels are whole numbers. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm import metric
from lodestrata.llm.common import stage

#: Pivots (one for PIVOT_ROWS rows, at most PIVOTS), the sample that they come from, and rows of a page (more, if there would be over PAGES).
PIVOTS, PIVOT_ROWS, SAMPLE, PAGE_ROWS, PAGES = 64, 512, 4_096, 2_048, 65_536
#: Rows within the reach of the first round; each later one without a bound takes GROWTH times as many.
FIRST_ROWS, GROWTH = 4_096, 8
#: Rounding of distances: bounds are loosened by this share of the longest row.
SLACK = 1e-7
EXACT = float(1 << 53)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def _pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Means of the sample's rows around n of them."""
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(8):
        near = _far(x, centres).argmin(1)
        for c in np.unique(near):
            centres[c] = x[near == c].mean(0)
    return centres


class Store:
    """Rows sorted by (pivot, distance) in staged pages, and the directory of the pages' key intervals."""

    def __init__(self, rows: DataFrame, keep: int, page_rows: int = PAGE_ROWS) -> None:
        """rows: (id, label, vector array<double>), those that take part; keep: the most rows of one vector and label that matter."""
        spark = rows.sparkSession
        rows = stage(metric.once(rows, ["vector", "label"], "id", keep), "annuli-rows")
        size = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
        about = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.max(size).alias("longest")).first()
        self.n, self.width, self.longest = about["n"], about["width"] or 1, about["longest"] or 0.0
        width, longest = self.width, self.longest
        sample = metric.matrix(metric.sampled(rows, self.n, SAMPLE, "vector", "label").select("vector").toArrow()["vector"].combine_chunks(), width)
        lift = lambda x: np.c_[x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))]
        self.pivots = _pivots(lift(sample), max(1, min(PIVOTS, self.n // PIVOT_ROWS, len(sample)))) if len(sample) else np.zeros((1, width + 1))
        shared = spark.sparkContext.broadcast(self.pivots)
        most = max(page_rows, -(-self.n // PAGES))

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far = _far(lift(metric.matrix(batch.column(2), width)), shared.value)
                near = far.argmin(1) if len(batch) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(far[np.arange(len(batch)), near]), *batch.columns], names=["pivot", "distance", "ids", "label", "vector"])

        kind = "pivot long, distance double, ids array<long>, label long, vector array<double>"
        tasks = min(metric.MOST_TASKS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), self.n // (8 * most)))
        first = F.col("ids")[0]
        laid = rows.select("ids", "label", "vector").mapInArrow(keyed, kind).repartitionByRange(tasks, "pivot", "distance", first).sortWithinPartitions("pivot", "distance", first)

        def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = 0

            def page(held: list[pa.RecordBatch]) -> pa.RecordBatch:
                table = pa.Table.from_batches(held).combine_chunks()
                far = table["distance"].to_numpy()
                x = metric.matrix(table["vector"].combine_chunks(), width)
                ids = table["ids"].combine_chunks()
                offsets = ids.offsets.to_numpy()
                body = metric.pack(x, table["label"].to_numpy(), ids.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0])
                at = (TaskContext.get().partitionId() << 32) + made
                one = {"shard": at, "pivot": table["pivot"][0].as_py(), "low": far[0], "high": far[-1], "n": len(table)}
                return pa.RecordBatch.from_arrays([*(pa.array([v]) for v in one.values()), pa.array([body], pa.binary())], names=[*one, "body"])

            held, size, now = [], 0, None
            for batch in batches:
                pivot = batch.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(pivot[1:] != pivot[:-1]) + 1).tolist(), len(pivot)] if len(pivot) else [0]
                for a, z in zip(edges[:-1], edges[1:], strict=True):
                    if held and pivot[a] != now:
                        yield page(held)
                        held, size, made = [], 0, made + 1
                    now = pivot[a]
                    while a < z:
                        took = min(z - a, most - size)
                        held.append(batch.slice(a, took))
                        a, size = a + took, size + took
                        if size == most:
                            yield page(held)
                            held, size, made = [], 0, made + 1
            if held:
                yield page(held)

        self.pages = stage(laid.mapInArrow(paged, "shard long, pivot long, low double, high double, n long, body binary"), "annuli-pages")
        # At most PAGES pages and one more for each pivot and write task.
        directory = self.pages.select("shard", "pivot", "low", "high", "n").toArrow()
        self.directory = tuple(directory[c].to_numpy() for c in ("shard", "pivot", "low", "high", "n"))


def search(
    store: Store, asks: DataFrame, answer: Callable, found_kind: str, best: Callable[[DataFrame], DataFrame], limits: Callable[[DataFrame], DataFrame], extras: int, first_rows: int = FIRST_ROWS
) -> DataFrame | None:
    """The best rows of every ask, exactly, by widening rounds.

    asks: (ask, vector, extra, low, high): the least and largest distance of interest. answer: see metric.meet, the distance beyond
    which nothing counts any more being the last of its extra numbers; best cuts all rows found so far to those that count; limits gives (ask, bound): the distance beyond which
    nothing counts any more, where what is found tells it.
    """
    spark = store.pages.sparkSession
    width, longest, slack = store.width, store.longest, SLACK * (store.longest + 1.0) ** 0.5
    shared = spark.sparkContext.broadcast((store.pivots, *store.directory))
    piece = max(1, (1 << 21) // max(1, len(store.directory[0])))

    def bounds(vectors: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Each page's least distance to each ask; infinite where all of the page is nearer than the ask's low."""
        pivots, _, pivot, least, largest, _ = shared.value
        far = _far(np.c_[vectors, np.zeros(len(vectors))], pivots)[:, pivot]
        bound = np.maximum(0, np.maximum(far - largest, least - far) - slack)
        bound[far + largest + slack < low[:, None]] = np.inf
        return bound

    def advance(goal: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = shared.value[5]
            for batch in batches:
                reach = np.zeros(len(batch))
                limit, low = batch.column(6).to_numpy(), batch.column(3).to_numpy()
                for a in range(0, len(batch), piece):
                    own = slice(a, a + piece)
                    bound = bounds(metric.matrix(batch.column(1).slice(a, piece), width), low[own])
                    order = np.argsort(bound, axis=1, kind="stable")
                    met = np.cumsum(rows[order] * np.isfinite(np.take_along_axis(bound, order, 1)), axis=1)
                    at = np.minimum((met < goal).sum(1), bound.shape[1] - 1)
                    enough = np.where(met[:, -1] > goal, bound[np.arange(len(bound)), order[np.arange(len(bound)), at]], np.inf)
                    reach[own] = np.where(limit[own] < batch.column(4).to_numpy()[own], limit[own], np.minimum(enough, limit[own]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reach)], names=[*state_names, "reach"])

        return run

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = shared.value[1]
        for batch in batches:
            low, seen, limit, reach = (batch.column(i).to_numpy() for i in (3, 5, 6, 7))
            extra = metric.lists(np.c_[metric.matrix(batch.column(2), extras), limit])
            for a in range(0, len(batch), piece):
                part = batch.slice(a, piece)
                bound = bounds(metric.matrix(part.column(1), width), low[a : a + piece])
                row, page = np.nonzero(np.isfinite(bound) & (bound > seen[a : a + piece, None]) & (bound <= reach[a : a + piece, None]))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(shard[page]), part.column(0).take(at), part.column(1).take(at), extra.slice(a, piece).take(at)], names=["shard", "ask", "vector", "extra"])

    state_names = ["ask", "vector", "extra", "low", "high", "seen", "limit"]
    kind = "ask long, vector array<double>, extra array<double>, low double, high double, seen double, limit double"
    state = asks.select("ask", "vector", "extra", "low", "high", F.lit(-1.0).alias("seen"), F.col("high").alias("limit"))
    found, goal = None, first_rows
    while True:
        state = stage(state.mapInArrow(advance(goal), kind + ", reach double"), "annuli-state")
        if state.isEmpty():
            return found
        hits = metric.meet(store.pages.select("shard", "body"), state.mapInArrow(route, "shard long, ask long, vector array<double>, extra array<double>"), answer, found_kind, width, extras + 1)
        found = stage(best(hits if found is None else hits.unionByName(found)), "annuli-found")
        state = state.join(limits(found), "ask", "left").select("ask", "vector", "extra", "low", "high", F.col("reach").alias("seen"), F.least("high", F.coalesce("bound", "high")).alias("limit"))
        state = state.filter((F.col("seen") < F.col("limit")) & (F.col("seen") < F.lit(float("inf"))))
        goal *= GROWTH


def whole_numbers(vectors: DataFrame, scale: float, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, vector) of the rows that take part, components being floor(scale * x)."""
    v = F.col(vector)
    rows = vectors.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & metric.usable(v))
    whole = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("vector"))
    return rows.filter(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x) < EXACT)


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, page_rows: int = PAGE_ROWS, first_rows: int = FIRST_ROWS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows, anchors: (id, label, vector array<double> of whole numbers), anchors being some of the rows. An anchor's positives are its
    first rows of the same label by inner product, and a positive's negatives the first rows of other labels whose score is
    from low to high per cent of the positive's (whole numbers below 100).
    """
    spark = rows.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    store = Store(rows, max(positives + 1, negatives), page_rows)
    if not store.n:
        return spark.createDataFrame([], out)
    width, longest = store.width, store.longest
    size = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    slack = F.lit(SLACK) * F.sqrt(F.col("base"))
    distance = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.col("base") - 2 * score))  # noqa: E731  of a row with this score
    asked = stage(anchors.select("id", "label", "vector").dropDuplicates().select(F.monotonically_increasing_id().alias("ask"), "id", "label", "vector", (size + F.lit(longest)).alias("base")), "annuli-anchors")
    own = asked.select("ask", F.col("id").alias("own"), "base")

    def floor(vectors: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The score of a row at the limit, a little loosened."""
        length = (vectors * vectors).sum(1) + longest
        with np.errstate(invalid="ignore"):
            return np.where(np.isfinite(limit), (length - limit * limit) / 2 - SLACK * length, -np.inf)[:, None]

    def same(shard, ask, vectors, extra) -> pa.RecordBatch:
        """The first rows of the ask's label, one more than asked for, as the anchor itself is among them."""
        x, label, ids, offsets = shard
        score = vectors @ x.T
        score[(label[None, :] != extra[:, :1]) | (score < floor(vectors, extra[:, -1]))] = -np.inf
        need = positives + 1
        least = np.partition(score, -need, axis=1)[:, -need] if score.shape[1] > need else np.full(len(score), -np.inf)
        who, row = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        kept = metric.best_rows(who, score[who, row], ids[offsets[row]], need)
        who, row = who[kept], row[kept]
        return pa.RecordBatch.from_arrays([pa.array(ask[who]), _lists(ids, offsets, row), pa.array(score[who, row].astype(np.int64))], names=["ask", "ids", "score"])

    ranked = Window.partitionBy("ask").orderBy(F.desc("score"), "found")

    def first_positives(hits: DataFrame) -> DataFrame:
        rows = hits.select("ask", F.explode("ids").alias("found"), "score").join(own, "ask").filter(F.col("found") != F.col("own"))
        return rows.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= positives).select("ask", F.array("found").alias("ids"), "score")

    by_score = F.desc("score"), F.col("ids")[0]

    def beyond_positives(found: DataFrame) -> DataFrame:
        last = found.withColumn("rank", F.row_number().over(Window.partitionBy("ask").orderBy(*by_score))).filter(F.col("rank") == positives)
        return last.join(own, "ask").select("ask", (distance(F.col("score")) + slack).alias("bound"))

    asks = asked.select("ask", "vector", F.array(F.col("label").cast("double")).alias("extra"), F.lit(0.0).alias("low"), F.lit(float("inf")).alias("high"))
    found = search(store, asks, same, "ask long, ids array<long>, score long", first_positives, beyond_positives, 1, first_rows)
    if found is None:
        return spark.createDataFrame([], out)
    band = F.row_number().over(Window.partitionBy("ask").orderBy(*by_score)) - 1
    pairs = found.select("ask", F.col("ids")[0].alias("positive_id"), F.col("score").alias("positive_score"), band.alias("band"))
    pairs = stage(pairs.filter(F.col("positive_score") >= 0), "annuli-positives")  # below 0 the band is empty

    def others(shard, ask, vectors, extra) -> pa.RecordBatch:
        """The first rows of other labels in each band of each ask."""
        x, label, ids, offsets = shard
        score = (vectors @ x.T).astype(np.int64)
        apart = (label[None, :] != extra[:, :1]) & (score >= floor(vectors, extra[:, -1]))
        parts = []
        for band in range(positives):
            mark = extra[:, band + 1]
            has = ~np.isnan(mark)
            goal = np.where(has, mark, 0).astype(np.int64)[:, None]
            who, row = np.nonzero(apart & has[:, None] & (low * goal <= 100 * score) & (100 * score <= high * goal))
            kept = metric.best_rows(who, score[who, row].astype(np.float64), ids[offsets[row]], negatives)
            parts.append((who[kept], np.full(len(kept), band), row[kept]))
        who, band, row = (np.concatenate(p) for p in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(ask[who]), pa.array(band.astype(np.int32)), _lists(ids, offsets, row), pa.array(score[who, row])], names=["ask", "band", "ids", "score"])

    in_band = Window.partitionBy("ask", "band").orderBy(F.desc("score"), "found")

    def first_negatives(hits: DataFrame) -> DataFrame:
        rows = hits.select("ask", "band", F.explode("ids").alias("found"), "score").withColumn("rank", F.row_number().over(in_band))
        return rows.filter(F.col("rank") <= negatives).select("ask", "band", F.array("found").alias("ids"), "score")

    def beyond_negatives(found: DataFrame) -> DataFrame:
        third = found.withColumn("rank", F.row_number().over(Window.partitionBy("ask", "band").orderBy(*by_score))).filter(F.col("rank") == negatives)
        known = pairs.join(third.select("ask", "band", "score"), ["ask", "band"], "left").join(own, "ask")
        lowest = F.coalesce(F.col("score").cast("double"), F.col("positive_score") * F.lit(low / 100))
        return known.select("ask", (distance(lowest) + slack).alias("far")).groupBy("ask").agg(F.max("far").alias("bound"))

    marks = pairs.groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct("band", F.col("positive_score").cast("double")))).alias("marks"), F.max("positive_score").alias("most"), F.min("positive_score").alias("least"))
    extra = F.array(F.col("label").cast("double"), *(F.coalesce(F.col("marks")[i], F.lit(float("nan"))) for i in range(positives)))
    bands = asked.join(marks, "ask").select(
        "ask", "vector", extra.alias("extra"), F.greatest(F.lit(0.0), distance(F.col("most") * F.lit(high / 100)) - slack).alias("low"), (distance(F.col("least") * F.lit(low / 100)) + slack).alias("high"),
    )
    found = search(store, bands, others, "ask long, band int, ids array<long>, score long", first_negatives, beyond_negatives, positives + 1, first_rows)
    if found is None:
        return spark.createDataFrame([], out)
    final = found.join(pairs, ["ask", "band"]).join(own, "ask")
    rank = F.row_number().over(Window.partitionBy("ask", "band").orderBy(*by_score))
    return final.select(F.col("own").alias("anchor_id"), "positive_id", rank.alias("rank"), F.col("ids")[0].alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _lists(ids: np.ndarray, offsets: np.ndarray, row: np.ndarray) -> pa.ListArray:
    """The id lists of the given rows."""
    length = (offsets[1:] - offsets[:-1])[row]
    ends = np.cumsum(length)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length) + np.repeat(offsets[row], length)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids[at].astype(np.int64)))


def mined(vectors: DataFrame, every: int = 50) -> DataFrame:
    """Hard negatives of an embedding table (vec_id, label, embedding): components scaled by 256 and rounded down, the label of
    ids divisible by 7 moved on by one of ten, and the rows whose id is divisible by `every` as anchors."""
    rows = whole_numbers(vectors, 256.0)
    rows = rows.withColumn("label", F.when(F.pmod("id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, rows.filter(F.pmod("id", F.lit(every)) == 0))
