"""The staged hybrid retrieval plan, for many questions at once.

Lists of the single-question form become rows with (query_id, part, pos); the order of a list is never
implied by row order. The whole plan is one DataFrame until its caller acts on it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.ids import chunk_document, chunk_page
from lodestrata.operators.adjacency import Adjacency
from lodestrata.operators.graph import TYPES, adjacent, neighbours, touching, undirected
from lodestrata.operators.impacts import Keywords
from lodestrata.operators.models import command
from lodestrata.operators.search import bm25, knn, metadata_filter, top_k
from lodestrata.operators.tools import checked_parameters
from lodestrata.sources.stores import kept
from lodestrata.sources.tables import first_by


# Fixed value: the chunks that the tool gives an answerer.
TOOL_CHUNKS = 20


@dataclass
class Settings:
    vector_k: int = 12
    keyword_k: int = 12
    vector_top: int = 6
    keyword_top: int = 6
    reranked: int = 10
    graph_a: int = 10
    graph_b: dict[str, int] = field(default_factory=lambda: dict.fromkeys(TYPES, 5))
    context: int = 2
    final: int = 25
    filters: dict[str, str | None] = field(default_factory=dict)


@dataclass
class Stores:
    """chunks(chunk_id, document_id, page_number, chunk_index, text), vectors(chunk_id, document_id, embedding),
    similar(src, dst, score), typed(src, dst, type, confidence), metadata(document_id, path, file_name, ...).

    keywords: stored postings for keyword search; without them every batch of questions counts all texts. similar and typed may be
    stored adjacency: then a question's nodes read their own lists, else every batch looks through all edges. nearest: a search through an index in place of
    the exact one, (queries, k) -> (query_id, chunk_id, score, rank); questions with filters are searched exactly.
    """

    chunks: DataFrame
    vectors: DataFrame
    similar: DataFrame | Adjacency
    typed: DataFrame | Adjacency
    metadata: DataFrame
    keywords: Keywords | None = None
    nearest: Callable[[DataFrame, int], DataFrame] | None = None


def ordered_distinct(rows: DataFrame, order: list[Column]) -> DataFrame:
    """First occurrence of each chunk of a query, and its new place from 1."""
    once = first_by(rows, ["query_id", "chunk_id"], order)
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def retrieve(queries: DataFrame, stores: Stores, settings: Settings | None = None) -> DataFrame:
    """queries (query_id, embedding, terms) -> (query_id, rank, chunk_id, document_id, page_number, document_path, text, origin, confidence)."""
    s = settings or Settings()
    allowed = metadata_filter(stores.metadata, s.filters)
    vectors = stores.vectors if allowed is None else stores.vectors.join(allowed, "document_id", "left_semi")
    by_vector = knn(queries, vectors, s.vector_k) if stores.nearest is None or allowed is not None else stores.nearest(queries, s.vector_k)
    by_word = bm25(queries, stores.chunks, s.keyword_k) if stores.keywords is None else stores.keywords.search(queries, s.keyword_k)
    if allowed is not None:  # after the top k, so fewer may remain
        inside = stores.chunks.join(allowed, "document_id", "left_semi").select("chunk_id")
        by_word = by_word.join(inside, "chunk_id", "left_semi")
        by_word = by_word.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    hits = by_vector.select("query_id", "chunk_id", F.lit(0).alias("part"), "rank", "score", F.lit("vector_search").alias("origin")).unionByName(
        by_word.select("query_id", "chunk_id", F.lit(1).alias("part"), "rank", F.lit(1.0).alias("score"), F.lit("keyword_search").alias("origin"))
    )
    # A few rows a question that several stages read: written once, so they need no memory and no end.
    hits = kept(hits, "hits")
    place = [F.col("part"), F.col("rank")]
    seeds = hits.filter(((F.col("part") == 0) & (F.col("rank") <= s.vector_top)) | ((F.col("part") == 1) & (F.col("rank") <= s.keyword_top)))
    seeds = ordered_distinct(seeds, place).select("query_id", F.col("chunk_id").alias("node"), F.col("rank").alias("seed"))

    asked = seeds.select("query_id", "node")
    near = stores.similar.neighbours(asked, s.graph_a) if isinstance(stores.similar, Adjacency) else neighbours(asked, stores.similar, s.graph_a)
    around = near.join(seeds, ["query_id", "node"])
    around = around.select("query_id", F.col("neighbour").alias("chunk_id"), "seed", F.col("rank").alias("near"), "score")
    known = stores.chunks.select("chunk_id")
    around = ordered_distinct(around.join(known, "chunk_id", "left_semi"), [F.col("seed"), F.col("near")]).filter(F.col("rank") <= s.graph_a)
    around = around.select("query_id", "chunk_id", F.lit(2).alias("part"), "rank", "score", F.lit("graph_a").alias("origin"))

    ranked = ordered_distinct(hits.unionByName(around), place).filter(F.col("rank") <= s.reranked)
    ranked = ranked.withColumn("origin", F.when(F.col("rank") == 1, "anchor").otherwise(F.col("origin"))).withColumn("part", F.lit(0))
    ranked = kept(ranked, "ranked")
    anchor = ranked.filter("rank = 1").select("query_id", "chunk_id")

    context = adjacent(anchor, stores.chunks, s.context)
    context = context.select(
        "query_id", "chunk_id", F.lit(1).alias("part"), (F.col("offset") + s.context).alias("rank"), F.lit(0.0).alias("score"),
        F.lit("context").alias("origin"),
    )
    every = ranked.unionByName(context)
    nodes = anchor.select("query_id", F.col("chunk_id").alias("node"))
    # All types at once: the best of each type, then the types in their order.
    kinds = list(s.graph_b)
    if isinstance(stores.typed, Adjacency):
        probes = stores.typed.by_kind(nodes, s.graph_b).select("query_id", F.col("kind").alias("type"), "neighbour", F.col("score").alias("confidence"), "rank")
    else:
        edges = stores.typed.filter(F.col("type").isin(kinds))
        linked = nodes.join(undirected(touching(edges, nodes.select("node")), "confidence", ["type"]), "node")
        most = F.create_map(*[F.lit(x) for kind, n in s.graph_b.items() for x in (kind, n)])
        probes = top_k(linked, ["query_id", "type"], max(s.graph_b.values(), default=0), "neighbour", "confidence").filter(F.col("rank") <= F.element_at(most, F.col("type")))
    part = F.array_position(F.array(*map(F.lit, kinds)), F.col("type")).cast("int") + 1
    every = every.unionByName(
        probes.select(
            "query_id", F.col("neighbour").alias("chunk_id"), part.alias("part"), "rank", F.col("confidence").alias("score"),
            F.concat(F.lit("probe_"), F.lower("type")).alias("origin"),
        )
    )

    final = ordered_distinct(every, place).filter(F.col("rank") <= s.final)
    texts = stores.chunks.select("chunk_id", "document_id", "page_number", "text")
    paths = stores.metadata.select("document_id", F.coalesce(F.nullif("path", F.lit("")), F.nullif("file_name", F.lit("")), F.lit("")).alias("document_path"))
    found = final.join(texts, "chunk_id", "left").withColumn("document_id", F.coalesce("document_id", chunk_document(F.col("chunk_id"))))
    out = found.join(paths, "document_id", "left")
    missing = F.concat(F.lit("[Content not available for chunk "), F.col("chunk_id"), F.lit("]"))
    return out.select(
        "query_id", "rank", "chunk_id", "document_id", F.coalesce(F.nullif("page_number", F.lit(0)), chunk_page(F.col("chunk_id")), F.lit(1)).alias("page_number"),
        F.coalesce("document_path", F.lit("")).alias("document_path"), F.coalesce("text", missing).alias("text"), "origin", F.round("score", 6).alias("confidence"),
    )


def answer_question(parameters: dict, stores: Stores, embed: Callable[[DataFrame], DataFrame], settings: Settings | None = None) -> DataFrame:
    """The retrieval tool: checked parameters of one question to its first chunks, TOOL_CHUNKS of them. max_chunks is checked, but the
    tool's own limit holds, as it does for every question.

    embed: (query_id, text) -> (query_id, embedding).
    """
    given = checked_parameters(parameters)
    spark = stores.chunks.sparkSession
    asked = command(spark.createDataFrame([(0, given["query"])], "query_id long, text string"))
    vectors = embed(asked.select("query_id", F.col("vector_query").alias("text")))
    return retrieve(asked.join(vectors, "query_id").select("query_id", "embedding", "terms"), stores, settings).filter(F.col("rank") <= TOOL_CHUNKS)
