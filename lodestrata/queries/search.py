"""Keyword and vector search, evidence graph, and the staged retrieval plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions.answers import prompts
from lodestrata.functions.ids import cache_key, chunk_document, chunk_id, chunk_index, chunk_page, document_id, point_id, prefixed
from lodestrata.functions.vectors import normalised, sigmoid
from lodestrata.operators import graph, search
from lodestrata.operators.models import predicted
from lodestrata.operators.vector_index import VectorIndex
from lodestrata.plans.incremental import Folder, added_edges
from lodestrata.plans.retrieve import Settings, Stores, ordered_distinct, retrieve
from lodestrata.queries import fixtures as X
from lodestrata.queries.registry import query
from lodestrata.sources.stores import kept, shared_folder, stored_folder
from lodestrata.sources.tables import first_by, multi_get, table

BM25 = f"""tok AS (SELECT chunk_id, {X.words_sql('text')} AS t FROM chunks),
size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
post AS (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM tok),
tf AS (SELECT term, chunk_id, dl, count(*) AS tf FROM post GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM questions),
bm AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN tf USING (term) JOIN df USING (term), size GROUP BY query_id, chunk_id),
words AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm) WHERE rank <= 12)"""
KNN = """knn AS (SELECT * FROM (SELECT query_id, chunk_id, document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT p.query_id, v.chunk_id, v.document_id, round(list_dot_product(p.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM probes p, vectors v)) WHERE rank <= 12)"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


@query(_with(X.CHUNKS, X.QUESTIONS, BM25) + "SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM words")
def j3_bm25_top12(spark: SparkSession, folder: str) -> DataFrame:
    return X.keyword_hits(spark, folder, X.questions(spark, folder))


@query(
    _with(X.CHUNKS, X.QUESTIONS, BM25.split(",\nbm ")[0])
    + "SELECT count(DISTINCT term) AS terms, CAST(sum(df) AS BIGINT) AS postings, true AS fewer FROM df WHERE term IN (SELECT term FROM asked)"
)
def j3_postings_read(spark: SparkSession, folder: str) -> DataFrame:
    """Asked terms, the postings of their lists, and whether the search reads fewer."""
    found = X.keywords(spark, folder).reading(X.questions(spark, folder))
    return found.agg(F.count("*").alias("terms"), F.sum("df").alias("postings"), (F.sum("read") < F.sum("df")).alias("fewer"))


@query(_with(X.CHUNKS, BM25.split(",\npost")[0]) + "SELECT n, round(avgdl, 6) AS avgdl FROM size")
def a20_corpus_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return search.corpus_statistics(X.chunks(spark, folder)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(_with(X.CHUNKS, BM25.split(",\nasked")[0]) + "SELECT term, df, CAST(sum(tf) AS BIGINT) AS cf FROM tf JOIN df USING (term) GROUP BY term, df")
def a20_term_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return X.keywords(spark, folder).statistics()


@query(_with(X.CHUNKS) + "SELECT chunk_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT chunk_id, " + X.words_sql("text") + " AS t FROM chunks)")
def f30_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = search.tokens(F.col("text"))
    return X.chunks(spark, folder).select("chunk_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(_with(X.VECTORS, X.PROBES, KNN) + "SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM knn")
def j1_knn_top12(spark: SparkSession, folder: str) -> DataFrame:
    return search.knn(X.probes(spark, folder), X.vectors(spark, folder))


@query(_with(X.VECTORS, X.PROBES, KNN) + "SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM knn WHERE score >= 0.3")
def p6_knn_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return search.knn(X.probes(spark, folder), X.vectors(spark, folder), threshold=0.3)


def _index(spark: SparkSession, folder: str) -> VectorIndex:
    """The folder's vectors in a stored index."""

    def build(df: DataFrame, path: str) -> None:
        VectorIndex.create(df, path).append(df, "all")

    return VectorIndex(spark, stored_folder(X.vectors(spark, folder), "cells", folder, build))


@query()
def j1_knn_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The same search through an index, wide because these vectors have no structure; j1_index_recall measures it."""
    index = _index(spark, folder)
    return index.nearest(X.probes(spark, folder), probes=round(0.8 * len(index.centres.fine)))


@query("SELECT count(*) AS n_probes, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def j1_index_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the index finds nine in ten of the nearest twelve, over all probes."""
    found = j1_knn_indexed(spark, folder).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    met = j1_knn_top12(spark, folder).join(found, ["query_id", "chunk_id"], "left")
    return met.agg(F.countDistinct("query_id").alias("n_probes"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough"))


@query(
    _with(X.VECTORS, X.PROBES, X.METADATA)
    + """SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT p.query_id, v.chunk_id, round(list_dot_product(p.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM probes p, vectors v WHERE v.document_id IN (SELECT document_id FROM meta WHERE language = 'fr'))) WHERE rank <= 12"""
)
def p3_knn_prefiltered(spark: SparkSession, folder: str) -> DataFrame:
    allowed = search.metadata_filter(X.metadata(spark, folder), {"language": "fr"})
    return search.knn(X.probes(spark, folder), X.vectors(spark, folder).join(allowed, "document_id", "left_semi"))


@query(_with(X.CHUNKS, X.QUESTIONS, X.METADATA, BM25) + "SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM words JOIN chunks USING (chunk_id) WHERE document_id IN (SELECT document_id FROM meta WHERE language = 'en')")
def p5_keyword_postfiltered(spark: SparkSession, folder: str) -> DataFrame:
    allowed = search.metadata_filter(X.metadata(spark, folder), {"language": "en"})
    there = X.chunks(spark, folder).join(allowed, "document_id", "left_semi").select("chunk_id")
    return j3_bm25_top12(spark, folder).join(there, "chunk_id", "left_semi").select("query_id", "chunk_id", "score", "rank")


@query(_with(X.METADATA) + "SELECT document_id FROM meta WHERE list_contains(" + X.words_sql("title") + ", 'src3') AND list_contains(" + X.words_sql("title") + ", 'volume') AND language = 'en'")
def p1_metadata_filter(spark: SparkSession, folder: str) -> DataFrame:
    return search.metadata_filter(X.metadata(spark, folder), {"title": "src3 Volume", "language": "en", "author": None})


RERANKED = "rr AS (SELECT query_id, chunk_id, round(1 / (1 + exp(-5 * score)), 6) AS score FROM knn)"


@query(_with(X.VECTORS, X.PROBES, KNN, RERANKED) + "SELECT query_id, chunk_id, score FROM rr")
def m2_rerank_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A query's candidates are its nearest chunks, so the pairs are as many as the search gives out."""
    pairs = j1_knn_top12(spark, folder)
    return pairs.select("query_id", "chunk_id", F.round(sigmoid(5 * F.col("score")), 6).alias("score"))


@query(_with(X.VECTORS, X.PROBES, KNN, RERANKED) + "SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM rr) WHERE rank <= 5")
def t10_rerank_top5(spark: SparkSession, folder: str) -> DataFrame:
    return search.top_k(m2_rerank_scores(spark, folder), ["query_id"], 5, "chunk_id")


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS length2 FROM embeddings")
def f44_normalised_length(spark: SparkSession, folder: str) -> DataFrame:
    unit = normalised(F.transform("embedding", lambda x: x * 3))
    return table(spark, folder, "embeddings").select("vec_id", F.round(X.dot(unit, unit), 6).alias("length2"))


@query(_with(X.VECTORS, X.SIMILAR) + "SELECT src, dst, score, CAST(rank AS INTEGER) AS rank FROM alike")
def m6_similarity_edges(spark: SparkSession, folder: str) -> DataFrame:
    return X.similar(spark, folder)


@query(_with(X.VECTORS, X.SIMILAR) + "SELECT src, dst, score, CAST(rank AS INTEGER) AS rank FROM alike")
def m6_edges_through_index(spark: SparkSession, folder: str) -> DataFrame:
    """The same edges with older chunks searched through the index, all by all: the cells that can hold a score above the threshold, exactly."""
    index = _index(spark, folder)
    nearest = lambda q, k: index.above(q, X.EDGE_THRESHOLD, k, older_only=True)
    return graph.similarity_edges(X.vectors(spark, folder), X.EDGE_CANDIDATES, X.EDGE_THRESHOLD, 10, nearest)


@query(_with(X.VECTORS, X.SIMILAR) + "SELECT src, dst, score, CAST(rank AS INTEGER) AS rank FROM alike")
def r13_edges_of_two_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The older half of the vectors, then the younger one: each batch's chunks search what is stored, nothing is built anew."""
    v = X.vectors(spark, folder)
    middle = v.agg(F.percentile_approx("seq", 0.5)).first()[0] or 0
    index = VectorIndex.create(v.filter(F.col("seq") <= middle), f"{shared_folder(spark)}/lodestrata/batches-{uuid.uuid4().hex}")
    halves = (("first", v.filter(F.col("seq") <= middle)), ("second", v.filter(F.col("seq") > middle)))
    one, two = (kept(added_edges(index, rows, name, X.EDGE_THRESHOLD, X.EDGE_CANDIDATES), "edges") for name, rows in halves)
    return one.unionByName(two)


def _measured(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as unit vectors of their measures: vectors with structure."""
    rows = table(spark, folder, "lineitem")
    parts = (F.lit(1.0), F.col("l_quantity") / 50, F.col("l_extendedprice") / 100_000, F.col("l_discount") * 10, F.col("l_tax") * 12, F.month("l_shipdate") / 12)
    return rows.select(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("chunk_id"), "l_orderkey", normalised(F.array(*parts)).cast("array<float>").alias("embedding"))


@query("SELECT count(DISTINCT concat_ws('_', l_orderkey, l_linenumber)) AS n_probes, true AS enough, true AS few FROM lineitem WHERE l_orderkey % 200 = 0")
def j1_recall_in_few_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a search of one cell in twenty finds nine in ten of the nearest twelve, over vectors with structure."""
    v = _measured(spark, folder)
    index = VectorIndex(spark, stored_folder(v, "measures", folder, lambda df, path: VectorIndex.create(df, path).append(df, "all")))
    asked = v.filter("l_orderkey % 200 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    cells = int((index.limits()[1] > 0).sum())
    probes = max(1, cells // 20)
    near = kept(index.nearest(asked, probes=probes), "near")
    # Exact: every cell that can hold a score as high as the twelfth one found.
    least = index.exact(asked, near=near).filter("rank = 12").select("query_id", F.col("score").alias("least"))
    met = near.join(least, "query_id").filter(F.col("score") >= F.col("least"))
    return met.agg(F.countDistinct("query_id").alias("n_probes"), (F.count("*") >= 0.9 * 12 * F.countDistinct("query_id")).alias("enough"), F.lit(20 * probes <= max(cells, 20)).alias("few"))


@query(_with(X.VECTORS, X.SIMILAR) + "SELECT count(*) AS n_edges, true AS enough FROM alike")
def m6_index_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Whether nine in ten similarity edges are found when the nearest cells alone are asked, all by all."""
    index = _index(spark, folder)
    nearest = lambda q, k: index.nearest(q, k, round(0.8 * len(index.centres.fine)), older_only=True)
    found = graph.similarity_edges(X.vectors(spark, folder), X.EDGE_CANDIDATES, X.EDGE_THRESHOLD, 10, nearest).select("src", "dst", F.lit(1).alias("hit"))
    met = X.stored_similar(spark, folder).join(found, ["src", "dst"], "left")
    return met.agg(F.count("*").alias("n_edges"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough"))


@query()
def r13_ingested_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Documents ingested in two batches: the archive's edges. The tests hold them against one batch and all by all."""
    docs = table(spark, folder, "documents").select("doc_id", "text", F.format_string("f%d.txt", "doc_id").alias("file_name"))
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0] or 0
    archive = Folder(spark, f"{shared_folder(spark)}/lodestrata/archive-{uuid.uuid4().hex}")
    archive.add(docs.filter(F.col("doc_id") <= middle), "first")
    archive.add(docs.filter(F.col("doc_id") > middle), "second")
    return archive.table("similar").select("src", "dst", "score", "rank")


@query(_with(X.VECTORS, X.SIMILAR, X.PAIRS) + "SELECT src, dst, relation, confidence FROM judged")
def m3_classified_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return X.judged_pairs(spark, folder)


def _stand_in():
    """A classifier in NumPy: four logits for each pair from its similarity and the numbers of its ends."""
    import numpy as np

    return lambda score, a, b: np.stack([4 * score + (a + b) % 3, 3 * score + (a + b) % 5 * 0.5, 5 * score + (a % 4) * 0.5, np.full(len(score), 1.5)], 1)


@query(_with(X.VECTORS, X.SIMILAR, X.PAIRS) + "SELECT src, dst, relation, confidence FROM judged")
def m4_batched_classification(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs classified by a model that each worker loads once, thirty pairs at a time."""
    v = X.vectors(spark, folder)
    near = search.knn(v.select(F.col("chunk_id").alias("query_id"), "embedding", "seq"), v, X.EDGE_CANDIDATES, older_only=True)
    numbered = lambda name, as_: v.select(F.col("chunk_id").alias(name), F.col("seq").alias(as_))
    pairs = near.select(F.col("query_id").alias("src"), F.col("chunk_id").alias("dst"), "score").join(numbered("src", "a"), "src").join(numbered("dst", "b"), "dst")
    judged = predicted(pairs, ["score", "a", "b"], "relations stand-in", _stand_in, "logits")
    return graph.classified(judged, F.col("logits")).select("src", "dst", "relation", "confidence")


@query(_with(X.VECTORS, X.SIMILAR, X.PAIRS, X.TYPED) + "SELECT src, dst, type, confidence, CAST(rank AS INTEGER) AS rank FROM typed")
def m7_typed_edges(spark: SparkSession, folder: str) -> DataFrame:
    return X.typed(spark, folder)


@query(_with(X.VECTORS, X.SIMILAR, X.PAIRS) + "SELECT relation, count(*) AS n, count(*) FILTER (confidence >= 0.5) AS confident FROM judged GROUP BY relation")
def a5_relation_counts(spark: SparkSession, folder: str) -> DataFrame:
    return X.stored_pairs(spark, folder).groupBy("relation").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.5).alias("confident"))


@query(_with(X.VECTORS, X.SIMILAR, X.PAIRS) + "SELECT src, dst, relation, confidence FROM judged WHERE relation <> 'unrelated' AND confidence >= 0.45")
def m5_gated_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return graph.gated(X.stored_pairs(spark, folder), 0.45)


BOTH = "both_ways AS (SELECT src AS node, dst AS neighbour, score FROM alike UNION ALL SELECT dst, src, score FROM alike), nb AS (SELECT node, neighbour, max(score) AS score FROM both_ways GROUP BY ALL)"


@query(
    _with(X.VECTORS, X.SIMILAR, BOTH)
    + "SELECT query_id, node, neighbour, score, CAST(rank AS INTEGER) AS rank FROM (SELECT v.seq AS query_id, node, neighbour, score, row_number() OVER (PARTITION BY node ORDER BY score DESC, neighbour) AS rank FROM vectors v JOIN nb ON v.chunk_id = nb.node WHERE v.seq % 20 = 0) WHERE rank <= 10"
)
def j4_graph_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    anchors = X.vectors(spark, folder).filter("seq % 20 = 0").select(F.col("seq").alias("query_id"), F.col("chunk_id").alias("node"))
    return X.similar_lists(spark, folder).neighbours(anchors, 10).select("query_id", "node", "neighbour", "score", "rank")


@query(
    _with(X.VECTORS, X.SIMILAR, X.PAIRS, X.TYPED)
    + """, both_ways AS (SELECT type, src AS node, dst AS neighbour, confidence FROM typed UNION ALL SELECT type, dst, src, confidence FROM typed), nb AS (SELECT node, neighbour, max(confidence) AS confidence FROM both_ways WHERE type IN ('CONTRADICTS', 'ELABORATES') GROUP BY ALL)
SELECT query_id, node, neighbour, confidence, CAST(rank AS INTEGER) AS rank FROM (SELECT v.seq AS query_id, node, neighbour, confidence, row_number() OVER (PARTITION BY node ORDER BY confidence DESC, neighbour) AS rank FROM vectors v JOIN nb ON v.chunk_id = nb.node WHERE v.seq % 20 = 0 AND confidence >= 0.6) WHERE rank <= 5"""
)
def j5_typed_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    anchors = X.vectors(spark, folder).filter("seq % 20 = 0").select(F.col("seq").alias("query_id"), F.col("chunk_id").alias("node"))
    found = X.typed_lists(spark, folder).neighbours(anchors, 5, 0.6, ["CONTRADICTS", "ELABORATES"])
    return found.select("query_id", "node", "neighbour", F.col("score").alias("confidence"), "rank")


@query(_with(X.VECTORS, X.SIMILAR, BOTH) + "SELECT v.chunk_id, coalesce(string_agg(neighbour, ',' ORDER BY neighbour), '') AS related, count(neighbour) AS n FROM vectors v LEFT JOIN nb ON v.chunk_id = nb.node WHERE v.seq % 20 = 0 GROUP BY v.chunk_id")
def j6_related_lists(spark: SparkSession, folder: str) -> DataFrame:
    anchors = X.vectors(spark, folder).filter("seq % 20 = 0").select("chunk_id")
    linked = anchors.join(graph.undirected(X.stored_similar(spark, folder), "score").withColumnRenamed("node", "chunk_id"), "chunk_id", "left")
    return linked.groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_list("neighbour")), ",").alias("related"), F.count("neighbour").alias("n"))


@query(_with(X.VECTORS, X.SIMILAR) + "SELECT (SELECT count(*) FROM vectors) AS vertices, (SELECT count(*) FROM alike) AS edges, round((SELECT count(*) FROM alike) / (SELECT count(*) FROM vectors), 2) AS avg_degree")
def a1_graph_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return graph.graph_statistics(X.vectors(spark, folder), X.stored_similar(spark, folder))


MERGE = """ga AS (SELECT dst AS chunk_id, max(score) AS ca FROM alike GROUP BY dst), gb AS (SELECT dst AS chunk_id, max(confidence) AS cb FROM typed GROUP BY dst),
mg AS (SELECT coalesce(ga.chunk_id, gb.chunk_id) AS chunk_id, greatest(ca, cb) AS confidence, CASE WHEN cb IS NULL THEN 'graph_a' WHEN ca IS NULL THEN 'graph_b' ELSE 'both' END AS graph_source, CASE WHEN cb IS NULL OR ca >= cb THEN 'a' ELSE 'b' END AS taken_from FROM ga FULL JOIN gb ON ga.chunk_id = gb.chunk_id)"""


def _two_graphs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return X.stored_similar(spark, folder).select(
        F.col("dst").alias("chunk_id"), F.col("score").alias("confidence"),
    ), X.stored_typed(spark, folder).select(F.col("dst").alias("chunk_id"), "confidence")


@query(_with(X.VECTORS, X.SIMILAR, X.PAIRS, X.TYPED, MERGE) + "SELECT * FROM mg")
def u4_merged_graphs(spark: SparkSession, folder: str) -> DataFrame:
    return graph.merged_graphs(*_two_graphs(spark, folder))


@query(
    _with(X.VECTORS, X.SIMILAR, X.PAIRS, X.TYPED, MERGE)
    + """SELECT count(*) AS unique_chunks, count(*) FILTER (graph_source = 'graph_a') AS a_only, count(*) FILTER (graph_source = 'graph_b') AS b_only, count(*) FILTER (graph_source = 'both') AS in_both,
  round(avg(confidence), 6) AS avg_confidence, max(confidence) AS max_confidence, min(confidence) AS min_confidence, (SELECT count(*) FROM alike) + (SELECT count(*) FROM typed) - count(*) AS duplicates FROM mg"""
)
def a10_merge_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return graph.merge_statistics(*_two_graphs(spark, folder))


@query(_with(X.VECTORS, X.SIMILAR, X.PAIRS, X.TYPED, MERGE) + "SELECT ga.chunk_id FROM ga JOIN gb USING (chunk_id)")
def u6_intersection(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _two_graphs(spark, folder)
    return a.select("chunk_id").intersect(b.select("chunk_id"))


@query(_with(X.VECTORS, X.SIMILAR, X.PAIRS, X.TYPED, MERGE) + "SELECT ga.chunk_id FROM ga WHERE chunk_id NOT IN (SELECT chunk_id FROM gb)")
def u6_difference(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _two_graphs(spark, folder)
    return a.select("chunk_id").distinct().exceptAll(b.select("chunk_id").distinct())


@query(_with(X.VECTORS, X.SIMILAR, X.CHUNKS) + "SELECT src, dst, score FROM alike WHERE src IN (SELECT chunk_id FROM vectors WHERE label < 5) AND dst IN (SELECT chunk_id FROM vectors WHERE label < 5)")
def k7_edges_with_known_ends(spark: SparkSession, folder: str) -> DataFrame:
    return graph.with_known_ends(X.stored_similar(spark, folder), X.vectors(spark, folder).filter("label < 5")).select("src", "dst", "score")


PLACED = "placed AS (SELECT chunk_id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, chunk_index, chunk_id) AS pos FROM chunks)"


@query(_with(X.CHUNKS, PLACED) + "SELECT a.seq AS query_id, p.chunk_id, CAST(p.pos - q.pos AS INTEGER) AS \"offset\" FROM chunks a JOIN placed q USING (chunk_id) JOIN placed p ON p.document_id = q.document_id AND p.pos <> q.pos AND abs(p.pos - q.pos) <= 2 WHERE a.seq % 20 = 0")
def j9_adjacent_chunks(spark: SparkSession, folder: str) -> DataFrame:
    c = X.chunks(spark, folder)
    return graph.adjacent(c.filter("seq % 20 = 0").select(F.col("seq").alias("query_id"), "chunk_id"), c, 2)


@query(_with(X.CHUNKS, PLACED) + "SELECT chunk_id, document_id, CAST(pos AS INTEGER) AS pos, string_agg(chunk_id, ',') OVER (PARTITION BY document_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around FROM placed")
def w6_windows_of_chunks(spark: SparkSession, folder: str) -> DataFrame:
    order = Window.partitionBy("document_id").orderBy("page_number", "chunk_index", "chunk_id")
    placed = X.chunks(spark, folder).select(
        "chunk_id", "document_id", F.row_number().over(order).alias("pos"),
        F.array_join(F.collect_list("chunk_id").over(order.rowsBetween(-2, 2)), ",").alias("around"),
    )
    return placed


@query(_with(X.CHUNKS) + "SELECT chunk_id, page_number, chunk_index FROM chunks WHERE document_id = 'DOC_7' ORDER BY page_number, chunk_index")
def s17_chunks_of_document(spark: SparkSession, folder: str) -> DataFrame:
    return X.chunks(spark, folder).filter("document_id = 'DOC_7'").orderBy("page_number", "chunk_index").select("chunk_id", "page_number", "chunk_index")


@query(_with(X.CHUNKS) + "SELECT chunk_id, regexp_extract(chunk_id, '^(.*)_P(\\d+)_C(\\d+)$', 1) AS document_id, CAST(regexp_extract(chunk_id, '^(.*)_P(\\d+)_C(\\d+)$', 2) AS INTEGER) AS page, CAST(regexp_extract(chunk_id, '^(.*)_P(\\d+)_C(\\d+)$', 3) AS INTEGER) AS idx FROM chunks")
def f7_parsed_chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    made = X.chunks(spark, folder).select(chunk_id(F.col("document_id"), F.col("page_number"), F.col("chunk_index")).alias("chunk_id"))
    c = F.col("chunk_id")
    return made.select("chunk_id", chunk_document(c).alias("document_id"), chunk_page(c).alias("page"), chunk_index(c).alias("idx"))


@query(
    "SELECT doc_id, 'DOC_' || substr(sha1(concat(CASE WHEN doc_id % 3 = 0 THEN 'None' ELSE printf('f%d.pdf', doc_id) END, CASE WHEN doc_id % 4 = 0 "
    "THEN 'None' ELSE '2024-01-01' END, text)), 1, 16) AS document_id FROM documents"
)
def f47_document_ids(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    name = F.when(F.col("doc_id") % 3 != 0, F.format_string("f%d.pdf", "doc_id"))
    made = F.when(F.col("doc_id") % 4 != 0, F.lit("2024-01-01"))
    return d.select("doc_id", document_id(name, made, F.col("text")).alias("document_id"))


@query(
    "SELECT doc_id, 'embedding:query:' || substr(sha256('search_query: ' || text), 1, 16) AS as_query, 'embedding:doc:' || "
    "substr(sha256('search_document: ' || text), 1, 16) AS as_document FROM documents"
)
def f48_cache_keys(spark: SparkSession, folder: str) -> DataFrame:
    once = prefixed(F.col("text"), query=True)
    return table(spark, folder, "documents").select("doc_id", cache_key(once, query=True).alias("as_query"), cache_key(once, query=False).alias("as_document"))


@query(
    _with(X.CHUNKS)
    + """, h AS (SELECT chunk_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(chunk_id)) AS d FROM chunks)
SELECT chunk_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(d, 17, 1)) - 1) % 4 + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS point_id FROM h"""
)
def f49_point_ids(spark: SparkSession, folder: str) -> DataFrame:
    return X.chunks(spark, folder).select("chunk_id", point_id(F.col("chunk_id")).alias("point_id"))


@query(_with(X.CHUNKS) + "SELECT i.chunk_id, text FROM (SELECT printf('DOC_%d_P01_C01', item_id) AS chunk_id FROM benchmark UNION ALL SELECT 'DOC_none_P01_C01') i LEFT JOIN chunks USING (chunk_id)")
def s14_multi_get(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "benchmark").select(F.format_string("DOC_%d_P01_C01", "item_id").alias("chunk_id"))
    ids = ids.unionByName(ids.limit(0).unionByName(spark.range(1).select(F.lit("DOC_none_P01_C01").alias("chunk_id"))))
    return multi_get(ids, X.chunks(spark, folder).select("chunk_id", "text"), "chunk_id")


@query(_with(X.CHUNKS, X.METADATA) + "SELECT chunk_id, document_id, coalesce(nullif(path, ''), nullif(file_name, ''), '/documents/' || document_id) AS document_path FROM chunks LEFT JOIN meta USING (document_id)")
def j7_document_paths(spark: SparkSession, folder: str) -> DataFrame:
    joined = X.chunks(spark, folder).join(X.metadata(spark, folder).select("document_id", "path", "file_name"), "document_id", "left")
    return joined.select(
        "chunk_id", "document_id",
        F.coalesce(F.nullif("path", F.lit("")), F.nullif("file_name", F.lit("")), F.concat(F.lit("/documents/"), F.col("document_id"))).alias("document_path"),
    )


@query(_with(X.METADATA) + "SELECT document_id, coalesce(nullif(file_name, ''), nullif(title, ''), document_id) AS name, CAST(0 AS BIGINT) AS size, 'ready' AS status FROM meta")
def s21_sources_listing(spark: SparkSession, folder: str) -> DataFrame:
    m = X.metadata(spark, folder)
    return m.select(
        "document_id", F.coalesce(F.nullif("file_name", F.lit("")), F.nullif("title", F.lit("")), F.col("document_id")).alias("name"),
        F.lit(0).cast("long").alias("size"), F.lit("ready").alias("status"),
    )


HITS = """hits AS (SELECT query_id, chunk_id, 0 AS part, rank, score, 'vector_search' AS origin FROM knn UNION ALL SELECT query_id, chunk_id, 1, rank, 1.0, 'keyword_search' FROM words)"""
PLAIN_PROBES = "probes AS (SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id)"
ASKED = "SELECT query_id, chunk_id, part, rank FROM hits"


def _batch(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark's questions, each with the vector of its number."""
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return X.questions(spark, folder).join(e, "query_id")


def _stores(spark: SparkSession, folder: str) -> Stores:
    """The archive's stored tables: graphs and postings are made once, not by a question's plan."""
    return Stores(X.chunks(spark, folder), X.vectors(spark, folder), X.similar_lists(spark, folder), X.typed_lists(spark, folder), X.metadata(spark, folder), X.keywords(spark, folder))


MERGED = "firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY part, rank) AS f FROM hits) WHERE f = 1)"


@query(_with(X.CHUNKS, X.VECTORS, X.QUESTIONS, PLAIN_PROBES, BM25, KNN, HITS, MERGED) + "SELECT query_id, chunk_id, origin, CAST(row_number() OVER (PARTITION BY query_id ORDER BY part, rank) AS INTEGER) AS rank FROM firsts")
def u1_merged_hits(spark: SparkSession, folder: str) -> DataFrame:
    q = _batch(spark, folder)
    v = search.knn(q, X.vectors(spark, folder)).select("query_id", "chunk_id", F.lit(0).alias("part"), "rank", F.lit("vector_search").alias("origin"))
    w = X.keyword_hits(spark, folder, q).select("query_id", "chunk_id", F.lit(1).alias("part"), "rank", F.lit("keyword_search").alias("origin"))
    return ordered_distinct(v.unionByName(w), [F.col("part"), F.col("rank")]).select("query_id", "chunk_id", "origin", "rank")


FLAGSHIP = (
    _with(X.CHUNKS, X.VECTORS, X.METADATA, X.QUESTIONS, PLAIN_PROBES, BM25, KNN, X.SIMILAR, X.PAIRS, X.TYPED, HITS, BOTH, PLACED)
    + """, sel AS (SELECT query_id, chunk_id, min(part * 100 + rank) AS seed FROM hits WHERE rank <= 6 GROUP BY ALL),
ga0 AS (SELECT s.query_id, s.seed, neighbour AS chunk_id, score, row_number() OVER (PARTITION BY s.query_id, s.chunk_id ORDER BY score DESC, neighbour) AS near FROM sel s JOIN nb ON nb.node = s.chunk_id),
ga1 AS (SELECT * FROM ga0 WHERE near <= 10 AND chunk_id IN (SELECT chunk_id FROM chunks)),
ga2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY seed, near) AS f FROM ga1) WHERE f = 1),
ga3 AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY seed, near) AS rank FROM ga2),
al AS (SELECT query_id, chunk_id, part, rank, score, origin FROM hits UNION ALL SELECT query_id, chunk_id, 2, rank, score, 'graph_a' FROM ga3 WHERE rank <= 10),
al1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY part, rank) AS f FROM al) WHERE f = 1),
top AS (SELECT * FROM (SELECT query_id, chunk_id, score, origin, row_number() OVER (PARTITION BY query_id ORDER BY part, rank) AS rank FROM al1) WHERE rank <= 10),
anc AS (SELECT query_id, chunk_id FROM top WHERE rank = 1),
ctx AS (SELECT a.query_id, p.chunk_id, p.pos - q.pos AS o FROM anc a JOIN placed q USING (chunk_id) JOIN placed p ON p.document_id = q.document_id AND p.pos <> q.pos AND abs(p.pos - q.pos) <= 2),
tb AS (SELECT type, src AS node, dst AS neighbour, confidence FROM typed UNION ALL SELECT type, dst, src, confidence FROM typed),
tn AS (SELECT type, node, neighbour, max(confidence) AS confidence FROM tb GROUP BY ALL),
gb AS (SELECT a.query_id, type, neighbour AS chunk_id, confidence, row_number() OVER (PARTITION BY a.query_id, type ORDER BY confidence DESC, neighbour) AS rank FROM anc a JOIN tn ON tn.node = a.chunk_id),
ev AS (SELECT query_id, chunk_id, 0 AS part, rank, score, CASE WHEN rank = 1 THEN 'anchor' ELSE origin END AS origin FROM top
  UNION ALL SELECT query_id, chunk_id, 1, o + 2, 0.0, 'context' FROM ctx
  UNION ALL SELECT query_id, chunk_id, CASE type WHEN 'CONTRADICTS' THEN 2 WHEN 'ELABORATES' THEN 3 ELSE 4 END, rank, confidence, 'probe_' || lower(type) FROM gb WHERE rank <= 5),
ev1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY part, rank) AS f FROM ev) WHERE f = 1),
fin AS (SELECT * FROM (SELECT query_id, chunk_id, score, origin, row_number() OVER (PARTITION BY query_id ORDER BY part, rank) AS rank FROM ev1) WHERE rank <= 25)
SELECT query_id, CAST(rank AS INTEGER) AS rank, fin.chunk_id, coalesce(chunks.document_id, regexp_extract(fin.chunk_id, '^(.*)_P', 1)) AS document_id, coalesce(page_number, CAST(regexp_extract(fin.chunk_id, '_P(\\d+)_C', 1) AS INTEGER)) AS page_number, coalesce(nullif(path, ''), nullif(file_name, ''), '') AS document_path,
  coalesce(text, '[Content not available for chunk ' || fin.chunk_id || ']') AS text, origin, round(score, 6) AS confidence FROM fin LEFT JOIN chunks USING (chunk_id) LEFT JOIN meta ON meta.document_id = coalesce(chunks.document_id, regexp_extract(fin.chunk_id, '^(.*)_P', 1))"""
)


@query(FLAGSHIP)
def m12_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    return retrieve(_batch(spark, folder), _stores(spark, folder))


@query("SELECT origin, count(*) AS n, count(DISTINCT query_id) AS n_queries, round(avg(confidence), 6) AS avg_confidence FROM (" + FLAGSHIP + ") GROUP BY origin")
def a3_origin_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return m12_retrieval(spark, folder).groupBy("origin").agg(
        F.count("*").alias("n"), F.countDistinct("query_id").alias("n_queries"), F.round(F.avg("confidence"), 6).alias("avg_confidence"),
    )


@query("SELECT query_id, CASE WHEN origin IN ('anchor', 'context', 'retrieval') THEN origin ELSE 'retrieval' END AS origin, count(*) AS n, arg_min(confidence, rank) FILTER (confidence > 0) AS first_confidence FROM (" + FLAGSHIP + ") GROUP BY ALL")
def p15_coerced_origins(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("origin").isin("anchor", "context", "retrieval"), F.col("origin")).otherwise("retrieval")
    positive = F.when(F.col("confidence") > 0, F.col("rank"))
    return m12_retrieval(spark, folder).groupBy("query_id", kind.alias("origin")).agg(F.count("*").alias("n"), F.min_by("confidence", positive).alias("first_confidence"))


_SHOWN = (
    "'--- Chunk ' || rank || ' ---' || chr(10) || 'Document: ' || CASE WHEN document_path = '' THEN 'unknown' ELSE 'http://h/api/files/' || ltrim(document_path, '/') END || chr(10) || 'Page: ' || page_number || chr(10) || 'Origin: ' || origin "
    "|| chr(10) || printf('Confidence: %.2f', confidence) || chr(10) || 'Content: ' || text || chr(10)"
)


@query(
    _with(
        "benched AS (SELECT item_id AS query_id, text AS question FROM benchmark)", "found AS (" + FLAGSHIP + ")",
        "parts AS (SELECT query_id, string_agg(" + _SHOWN + ", chr(10) ORDER BY rank) AS chunks FROM found GROUP BY query_id)",
    )
    + "SELECT query_id, 'Base.' || chr(10) || chr(10) || 'User Query: ' || question || chr(10) || chr(10) || 'Retrieved Context:' || coalesce(chr(10) || chunks, '') AS prompt FROM benched JOIN parts USING (query_id)"
)
def f23_prompts(spark: SparkSession, folder: str) -> DataFrame:
    asked = X.questions(spark, folder).select("query_id", "text")
    found = m12_retrieval(spark, folder)
    return prompts(found, asked.join(found.select("query_id").distinct(), "query_id", "left_semi"), "Base.", "http://h/")


# Vectors are filtered before the top k, keyword hits after it, closing up their ranks.
_ENGLISH = "document_id IN (SELECT document_id FROM meta WHERE language = 'en')"
FILTERED = FLAGSHIP.replace("FROM probes p, vectors v))", f"FROM probes p, (SELECT * FROM vectors WHERE {_ENGLISH}) v))").replace(
    "FROM words)", f"FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM words JOIN chunks USING (chunk_id) WHERE {_ENGLISH}))"
)


@query(FILTERED)
def filtered_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    return retrieve(_batch(spark, folder), _stores(spark, folder), Settings(filters={"language": "en"}))


@query(_with(X.CHUNKS) + "SELECT chunk_id, min(seq) AS seq FROM (SELECT CASE WHEN seq % 3 = 0 THEN 'DOC_0_P01_C01' ELSE chunk_id END AS chunk_id, seq FROM chunks) GROUP BY chunk_id")
def w4_first_occurrence(spark: SparkSession, folder: str) -> DataFrame:
    c = X.chunks(spark, folder).select(F.when(F.col("seq") % 3 == 0, "DOC_0_P01_C01").otherwise(F.col("chunk_id")).alias("chunk_id"), "seq")
    return first_by(c, ["chunk_id"], [F.col("seq")])
