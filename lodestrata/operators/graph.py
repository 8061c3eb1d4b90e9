"""Evidence graph: similarity edges, typed edges, neighbours, merges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.answers import verdict
from lodestrata.functions.vectors import first_best, softmax
from lodestrata.operators.search import knn, top_k
from lodestrata.sources.tables import first_by

CANDIDATES, THRESHOLD, TOP_N = 35, 0.6, 10
TYPES = ("CONTRADICTS", "ELABORATES", "DEPENDS_ON")
#: Label order of the classifier, and the edge that each label makes.
RELATIONS = ("contradicts", "elaborates", "depends_on", "unrelated")


def similarity_edges(
    vectors: DataFrame, candidates: int = CANDIDATES, threshold: float = THRESHOLD, top_n: int = TOP_N,
    nearest: Callable[[DataFrame, int], DataFrame] | None = None, document: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(src, dst, score, rank): for each chunk its best older chunks of other documents.

    Candidates are the nearest `candidates` older chunks; same-document ones are dropped after that, so they
    use up candidate places. The search is exact, quadratic in the chunks; for whole archives give `nearest`, a
    search of older rows through an index: (queries, k) -> (query_id, chunk_id, score, rank). document: the document of a
    chunk id, where ids tell it; else vectors hold both ends, with their document_id.
    """
    asked = vectors.select(F.col("chunk_id").alias("query_id"), "embedding", "seq")
    near = knn(asked, vectors, candidates, older_only=True) if nearest is None else nearest(asked, candidates)
    pairs = near.select(F.col("query_id").alias("src"), F.col("chunk_id").alias("dst"), "score")
    if document is not None:
        pairs = pairs.withColumns({"src_doc": document(F.col("src")), "dst_doc": document(F.col("dst"))})
    else:
        ends = vectors.select("chunk_id", "document_id")
        pairs = pairs.join(
            ends.select(F.col("chunk_id").alias("src"), F.col("document_id").alias("src_doc")), "src",
        ).join(ends.select(F.col("chunk_id").alias("dst"), F.col("document_id").alias("dst_doc")), "dst")
    kept = pairs.filter((F.col("src") != F.col("dst")) & (F.col("src_doc") != F.col("dst_doc")) & (F.col("score") >= threshold))
    return top_k(kept.select("src", "dst", "score"), ["src"], top_n, "dst")


def classified(pairs: DataFrame, logits: Column) -> DataFrame:
    """pairs with relation and confidence from four logits in the order of RELATIONS."""
    p = pairs.withColumn("__p", softmax(logits))
    return p.withColumn("relation", first_best(F.col("__p"), list(RELATIONS))).withColumn("confidence", F.round(F.array_max("__p"), 6)).drop("__p")


def gated(pairs: DataFrame, least: float) -> DataFrame:
    """Related pairs of enough confidence."""
    return pairs.filter((F.col("relation") != "unrelated") & (F.col("confidence") >= least))


def valid_candidates(candidates: DataFrame, key: str, text: str, asked: Column) -> DataFrame:
    """Candidates with an id other than the asked one's and a text that is not blank."""
    return candidates.filter(F.col(key).isNotNull() & (F.col(key) != asked) & (F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0))


REJUDGED, PROMPT_CHARS = 0.99, 400


def rejudged(pairs: DataFrame, least: float, judge: Callable[[Column, Column], Column]) -> DataFrame:
    """All pairs (id, text_a, text_b, relation, confidence) in the order of their ids, the weak ones judged again.

    judge: a column function of both texts' first 400 characters (the prompt's size) that gives a reply; only
    pairs below `least` are sent to it. A reply that names a relation decides with a confidence of 0.99, any
    other leaves the pair as it was.
    """
    weak = F.col("confidence") < least
    asked = pairs.filter(weak)
    reply = judge(F.substring("text_a", 1, PROMPT_CHARS), F.substring("text_b", 1, PROMPT_CHARS))
    said = verdict(reply, F.lit(None).cast("string"))
    again = asked.withColumn("__said", said)
    again = again.withColumn("relation", F.coalesce("__said", "relation")).withColumn(
        "confidence", F.when(F.col("__said").isNotNull(), REJUDGED).otherwise(F.col("confidence")),
    ).drop("__said")
    return pairs.filter(~weak | F.col("confidence").isNull()).unionByName(again).orderBy("id")


def typed_edges(pairs: DataFrame, least: float, per_type: int) -> DataFrame:
    """(src, dst, type, confidence, rank): the best pairs of each source and type. Pairs carry their own ids."""
    kept = gated(pairs, least).select("src", "dst", F.upper("relation").alias("type"), "confidence")
    return top_k(kept, ["src", "type"], per_type, "dst", "confidence")


def probe_hits(
    sources: DataFrame, vectors: DataFrame, probes: dict[str, Callable[[Column], Column]], k: int, least: float, nearest: Callable[[DataFrame, int], DataFrame] | None = None
) -> DataFrame:
    """(query_id, probe, o, chunk_id, score, rank): the nearest rows to each probe's form of each source (query_id, embedding).

    All forms are queries of one search, keyed by source and probe: the vectors are read once whatever the number of probes.
    nearest: a search through an index in place of the exact one, (queries, k) -> (query_id, chunk_id, score, rank).
    """
    names = F.array(*map(F.lit, probes))
    forms = F.array(*[form(F.col("embedding")).cast("array<double>") for form in probes.values()])
    asked = sources.select("query_id", F.posexplode(forms).alias("o", "embedding")).select(F.struct("query_id", "o").alias("query_id"), "embedding")
    hits = (knn(asked, vectors, k, threshold=least) if nearest is None else nearest(asked, k)).filter(F.col("score") >= least)
    o = F.col("query_id.o")
    return hits.select("query_id.query_id", F.element_at(names, o + 1).alias("probe"), o.alias("o"), "chunk_id", "score", "rank")


def probe_candidates(hits: DataFrame, documents: DataFrame, own: Column) -> DataFrame:
    """(query_id, chunk_id, probe, score): hits in other documents than the source's own, each chunk by the first probe that finds it.

    documents: (chunk_id, document_id); own: the source's document, from a hit's columns.
    """
    other = hits.join(documents.select("chunk_id", "document_id"), "chunk_id").filter(F.col("document_id") != own)
    return first_by(other, ["query_id", "chunk_id"], [F.col("o"), F.col("rank")]).select("query_id", "chunk_id", "probe", "score")


def with_known_ends(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges whose ends are both stored vertices."""
    known = vertices.select("chunk_id").distinct()
    return edges.join(known.withColumnRenamed("chunk_id", "src"), "src", "left_semi").join(known.withColumnRenamed("chunk_id", "dst"), "dst", "left_semi")


def undirected(edges: DataFrame, score: str, also: list[str] | None = None) -> DataFrame:
    """(node, neighbour, *also, score) both ways; where both directions exist the higher score stays."""
    also = also or []
    ends = F.explode(
        F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("neighbour")), F.struct(F.col("dst").alias("node"), F.col("src").alias("neighbour")))
    )
    both = edges.filter(F.col(score).isNotNull()).select(ends.alias("e"), *also, score).select("e.*", *also, score)
    return both.groupBy("node", "neighbour", *also).agg(F.max(score).alias(score))


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end among nodes (node): what a few questions need of a graph that is not stored by node."""
    known = nodes.distinct()
    by_src = edges.join(known.withColumnRenamed("node", "src"), "src", "left_semi").select(*edges.columns)
    by_dst = edges.join(known.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)
    return by_src.unionByName(by_dst)


def neighbours(anchors: DataFrame, edges: DataFrame, n: int, score: str = "score", least: float = 0.0) -> DataFrame:
    """(query_id, node, neighbour, score, rank): the best neighbours of each anchor (query_id, node)."""
    linked = anchors.join(undirected(touching(edges, anchors.select("node")), score), "node").filter(F.col(score) >= least)
    return top_k(linked, ["query_id", "node"], n, "neighbour", score)


def merged_graphs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer merge of (chunk_id, confidence) lists: the higher confidence, graph A's on ties, and the origin."""
    best = lambda d, name: d.groupBy("chunk_id").agg(F.max("confidence").alias(name))
    both = best(a, "ca").join(best(b, "cb"), "chunk_id", "full")
    source = F.when(F.col("cb").isNull(), "graph_a").when(F.col("ca").isNull(), "graph_b").otherwise("both")
    taken = F.when(F.col("cb").isNull() | (F.col("ca") >= F.col("cb")), "a").otherwise("b")
    return both.select("chunk_id", F.greatest("ca", "cb").alias("confidence"), source.alias("graph_source"), taken.alias("taken_from"))


def merge_statistics(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: sizes, duplicates removed, origins, and the confidence's mean, largest and smallest."""
    m = merged_graphs(a, b)
    given = a.select("chunk_id").unionByName(b.select("chunk_id")).agg(F.count("*").alias("given"))
    out = m.agg(
        F.count("*").alias("unique_chunks"), F.count_if(
            F.col("graph_source") == "graph_a"
        ).alias("a_only"), F.count_if(F.col("graph_source") == "graph_b").alias("b_only"),
        F.count_if(
            F.col("graph_source") == "both"
        ).alias("in_both"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.max("confidence").alias("max_confidence"), F.min("confidence").alias("min_confidence"),
    )
    return out.join(given).withColumn("duplicates", F.col("given") - F.col("unique_chunks")).drop("given")


def graph_statistics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices, edges and mean degree to two decimals (0 without vertices)."""
    v = vertices.agg(F.count("*").alias("vertices"))
    e = edges.agg(F.count("*").alias("edges"))
    return v.join(e).withColumn("avg_degree", F.coalesce(F.round(F.try_divide("edges", "vertices"), 2), F.lit(0.0)))


def adjacent(anchors: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """(query_id, chunk_id, offset): chunks at most n places from each anchor in its document, across pages."""
    place = Window.partitionBy("document_id").orderBy("page_number", "chunk_index", "chunk_id")
    known = chunks.join(anchors.join(chunks.select("chunk_id", "document_id"), "chunk_id").select("document_id").distinct(), "document_id", "left_semi")
    placed = known.select("document_id", "chunk_id", F.row_number().over(place).alias("pos"))
    at = anchors.join(placed, "chunk_id").select("query_id", "document_id", F.col("pos").alias("p0"))
    near = at.join(placed, "document_id").withColumn("offset", F.col("pos") - F.col("p0"))
    return near.filter((F.col("offset") != 0) & (F.abs("offset") <= n)).select("query_id", "chunk_id", F.col("offset").cast("int").alias("offset"))
