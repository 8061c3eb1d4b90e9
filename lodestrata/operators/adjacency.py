"""Stored neighbours: each edge under both of its ends, in the order in which a search wants them.

A question's nodes open their own buckets, and within them the first places of their lists; no edge of another node is
sorted or added up. Where both directions of an edge exist the higher score stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators.graph import undirected
from lodestrata.operators.search import top_k

#: Edges of a bucket, the fewest and most buckets, and the places of a list that are kept.
BUCKET_EDGES, LEAST_BUCKETS, MOST_BUCKETS, PLACES = 500_000, 8, 8_192, 1_000


def write_adjacency(edges: DataFrame, path: str, score: str = "score", kind: str | None = None, places: int = PLACES) -> None:
    """Write edges (src, dst[, kind], score) as (node, kind, place, neighbour, score) by bucket of the node.

    The best `places` neighbours of a node and kind are kept, so a node that very many edges lead to is no task's burden; a search
    for more is an error.
    """
    spark = edges.sparkSession
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 2 * edges.count() // BUCKET_EDGES))
    named = edges.withColumn("kind", F.col(kind) if kind else F.lit("")).select("src", "dst", "kind", F.col(score).alias("score"))
    both = undirected(named, "score", ["kind"])
    order = Window.partitionBy("node", "kind").orderBy(F.desc("score"), "neighbour")
    listed = both.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= places)
    laid = listed.withColumn("bucket", _bucket("node", buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "node", "kind", "place")
    laid.write.partitionBy("bucket").parquet(f"{path}/neighbours")
    spark.createDataFrame([(buckets, places)], "buckets int, places int").coalesce(1).write.parquet(f"{path}/about")


def _bucket(node: str, buckets: int):
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


class Adjacency:
    def __init__(self, spark: SparkSession, path: str) -> None:
        about = spark.read.parquet(f"{path}/about").first()
        self.buckets, self.places = about["buckets"], about["places"]
        schema = "node string, neighbour string, kind string, score double, place int, bucket int"
        self.rows = spark.read.schema(schema).parquet(f"{path}/neighbours")

    def of(self, anchors: DataFrame, kinds: list[str] | None = None) -> DataFrame:
        """(query_id, node, kind, neighbour, score, place) of anchors (query_id, node), a few per question: their buckets alone are read."""
        asked = anchors.select("query_id", "node").distinct().withColumn("bucket", _bucket("node", self.buckets))
        wanted = sorted(r[0] for r in asked.select("bucket").distinct().collect())  # at most a row a bucket
        rows = self.rows.filter(F.col("bucket").isin(wanted))
        if kinds is not None:
            rows = rows.filter(F.col("kind").isin(kinds))
        return rows.join(asked, ["bucket", "node"]).select("query_id", "node", "kind", "neighbour", "score", "place")

    def neighbours(self, anchors: DataFrame, n: int, least: float = 0.0, kinds: list[str] | None = None) -> DataFrame:
        """(query_id, node, neighbour, score, rank): the best n neighbours of each anchor over the given kinds."""
        if n > self.places:
            raise ValueError(f"the stored lists hold {self.places} neighbours")
        found = self.of(anchors, kinds).filter((F.col("place") <= n) & (F.col("score") >= least))
        if kinds is not None and len(kinds) > 1:  # a neighbour by several kinds counts once
            found = found.groupBy("query_id", "node", "neighbour").agg(F.max("score").alias("score"))
        return top_k(found.select("query_id", "node", "neighbour", "score"), ["query_id", "node"], n, "neighbour")

    def by_kind(self, anchors: DataFrame, most: dict[str, int]) -> DataFrame:
        """(query_id, node, kind, neighbour, score, rank): the best of each kind, so many of each."""
        if max(most.values(), default=0) > self.places:
            raise ValueError(f"the stored lists hold {self.places} neighbours")
        limit = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])
        found = self.of(anchors, list(most)).filter(F.col("place") <= F.element_at(limit, F.col("kind")))
        return found.withColumnRenamed("place", "rank")
