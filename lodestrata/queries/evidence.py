"""Predicates, probes, attribution, captions and document building."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import answers, ids, images, text, vectors
from lodestrata.operators import graph, models, search
from lodestrata.queries import fixtures as X
from lodestrata.queries.registry import query
from lodestrata.queries.search import _with
from lodestrata.sources.tables import archive_kind, first_by, table, upsert


@query(_with(X.CHUNKS, "tok AS (SELECT chunk_id, unnest(" + X.words_sql("text") + ") AS t FROM chunks), c AS (SELECT chunk_id, CAST(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS INTEGER) AS bucket, count(*) AS n FROM tok GROUP BY ALL)") + "SELECT chunk_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)), 6) AS weight FROM c")
def m1_hashed_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return models.hashed_weights(X.chunks(spark, folder))


PROBED = """pr AS (SELECT p.query_id, k.probe, k.o, list_transform(list_zip(p.embedding, range(0, 64)), lambda x: x[1]::DOUBLE + CASE WHEN x[2] % 3 = k.o THEN 0.05 ELSE 0 END) AS v FROM probes p, (VALUES ('contradiction', 0), ('expansion', 1), ('dependency', 2)) k(probe, o)),
ps AS (SELECT query_id, probe, o, chunk_id, document_id, round(list_dot_product(v, embedding::DOUBLE[]), 6) AS score FROM pr, vectors),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, probe ORDER BY score DESC, chunk_id) AS rank FROM ps) WHERE rank <= 20 AND score >= 0.2)"""


def _moved(o: int):
    return lambda v: F.transform(v, lambda x, i: x.cast("double") + F.when(i % 3 == o, 0.05).otherwise(0.0))


PROBE_FORMS = {name: _moved(o) for o, name in enumerate(("contradiction", "expansion", "dependency"))}


def _probed(spark: SparkSession, folder: str) -> DataFrame:
    """The probes' three variants against all vectors: (query_id, probe, o, chunk_id, score, rank)."""
    return graph.probe_hits(X.probes(spark, folder), X.vectors(spark, folder), PROBE_FORMS, 20, 0.2)


@query(_with(X.VECTORS, X.PROBES, PROBED) + "SELECT query_id, probe, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM pk")
def j11_probe_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    return _probed(spark, folder).select("query_id", "probe", "chunk_id", "score", "rank")


CANDIDATES = (
    "u5 AS (SELECT query_id, chunk_id, probe, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY o, rank) AS f FROM pk WHERE document_id <> printf('DOC_%d', query_id // 5)) WHERE f = 1)"
)


@query(_with(X.VECTORS, X.PROBES, PROBED, CANDIDATES) + "SELECT query_id, chunk_id, probe, score FROM u5")
def u5_probe_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Between documents only, each chunk by the first probe that finds it."""
    own = F.format_string("DOC_%d", F.floor(F.col("query_id") / 5))
    return graph.probe_candidates(_probed(spark, folder), X.vectors(spark, folder), own)


@query(
    _with(X.VECTORS, X.PROBES, PROBED, CANDIDATES)
    + """, pairs AS (SELECT query_id AS src, u5.chunk_id AS dst, score, query_id AS a, d.seq AS b FROM u5 JOIN vectors d ON d.chunk_id = u5.chunk_id),
logit AS (SELECT src, dst, [4 * score + (a + b) % 3, 3 * score + (a + b) % 5 * 0.5, 5 * score + (a % 4) * 0.5, 1.5]::DOUBLE[] AS l FROM pairs),
soft AS (SELECT src, dst, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM logit),
judged AS (SELECT src, dst, ['contradicts', 'elaborates', 'depends_on', 'unrelated'][list_position(e, list_max(e))] AS relation, round(list_max(e) / list_sum(e), 6) AS confidence FROM soft)
SELECT src, dst, type, confidence, CAST(rank AS INTEGER) AS rank FROM (SELECT src, dst, upper(relation) AS type, confidence, row_number() OVER (PARTITION BY src, relation ORDER BY confidence DESC, dst) AS rank
  FROM judged WHERE relation <> 'unrelated' AND confidence >= 0.5) WHERE rank <= 5"""
)
def m7_probe_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Graph B as it is built: probe hits, candidates, classification, gate, the best of each type."""
    c = u5_probe_candidates(spark, folder).join(X.vectors(spark, folder).select("chunk_id", F.col("seq").alias("b")), "chunk_id")
    score, a, b = F.col("score"), F.col("query_id"), F.col("b")
    pairs = c.select(a.alias("src"), F.col("chunk_id").alias("dst"), "score", a.alias("query_id"), "b")
    logits = F.array(4 * score + (a + b) % 3, 3 * score + (a + b) % 5 * 0.5, 5 * score + (a % 4) * 0.5, F.lit(1.5))
    return graph.typed_edges(graph.classified(pairs, logits), 0.5, 5)


@query(_with(X.VECTORS, X.PROBES, PROBED) + "SELECT probe, count(*) AS n, count(DISTINCT query_id) AS n_queries, round(avg(score), 6) AS avg_score FROM pk GROUP BY probe")
def a4_probe_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return _probed(spark, folder).groupBy("probe").agg(
        F.count("*").alias("n"), F.countDistinct("query_id").alias("n_queries"), F.round(F.avg("score"), 6).alias("avg_score"),
    )


@query(_with(X.CHUNKS, X.METADATA) + "SELECT seq % 20 AS answer, coalesce(string_agg(DISTINCT file_name, ',' ORDER BY file_name), '') AS sources FROM chunks LEFT JOIN (SELECT * FROM meta WHERE file_name LIKE '%.pdf') m USING (document_id) GROUP BY answer")
def j8_source_attribution(spark: SparkSession, folder: str) -> DataFrame:
    m = X.metadata(spark, folder).filter("file_name like '%.pdf'").select("document_id", "file_name")
    cited = X.chunks(spark, folder).select((F.col("seq") % 20).alias("answer"), "document_id").distinct().join(m, "document_id", "left")
    return cited.groupBy("answer").agg(F.array_join(F.array_sort(F.collect_set("file_name")), ",").alias("sources"))


@query(
    _with(X.CHUNKS)
    + "SELECT chunk_id, CAST(coalesce(nullif(CASE WHEN seq % 2 = 0 THEN 0 ELSE page_number END, 0), page_number) AS INTEGER) AS page, "
    "CASE seq % 5 WHEN 0 THEN 'contradicts' WHEN 1 THEN 'context' ELSE 'supports' END AS relation FROM chunks"
)
def p17_recovered_pages(spark: SparkSession, folder: str) -> DataFrame:
    c = X.chunks(spark, folder)
    lost = F.when(F.col("seq") % 2 == 0, 0).otherwise(F.col("page_number"))
    origin = F.element_at(F.array(*map(F.lit, ("probe_contradicts", "context", "anchor", "graph_a", "wider context"))), (F.col("seq") % 5 + 1).cast("int"))
    return c.select(
        "chunk_id", F.coalesce(F.nullif(lost, F.lit(0)), ids.chunk_page(F.col("chunk_id")), F.lit(1)).cast("int").alias("page"),
        answers.relation(origin).alias("relation"),
    )


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'video' WHEN 1 THEN 'video' WHEN 2 THEN 'photo' WHEN 3 THEN 'photo' ELSE 'report' END AS kind FROM documents")
def p20_kinds(spark: SparkSession, folder: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("a.MP4", "b.c.webm", "x.Jpg", "y.jpeg", "z.wav", "mp4.tiff"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, folder, "documents").select("doc_id", archive_kind(name).alias("kind"))


_TAGS = "[lang, source, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END]"


@query(
    "SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT p.vec_id AS query_id, v.vec_id, CAST(v.vec_id AS VARCHAR) AS chunk_id, "
    "round(list_dot_product(p.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings p, (SELECT e.vec_id, e.embedding FROM embeddings e JOIN documents ON doc_id = vec_id "
    f"WHERE list_has_all({_TAGS}, ['en', 'even'])) v WHERE p.vec_id % 20 = 0)) WHERE rank <= 12"
)
def p4_tagged_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Vector search among the rows that have every asked tag."""
    tags = F.array("lang", "source", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))
    tagged = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), tags.alias("tags"))
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("chunk_id"), "embedding").join(tagged, "vec_id")
    found = search.knn(X.probes(spark, folder), search.tagged(rows, {"tags": ["en", "even"]}))
    return found.select("query_id", F.col("chunk_id").cast("long").alias("vec_id"), "score", "rank")


_ORIGIN = "['anchor', 'relation', 'probe_supports', 'graph_a', 'probe_depends', 'context', NULL][doc_id % 7 + 1]"


@query(
    f"SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'page' WHEN {
        _ORIGIN
    } IS NULL OR {_ORIGIN} = 'graph_a' THEN 'origin' WHEN doc_id % 8 = 7 THEN 'confidence' END AS problem FROM documents"
)
def p13_validated_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with output chunks made from the documents: page, origin or confidence."""
    n = F.col("doc_id")
    origin = F.element_at(
        F.array(*[F.lit(x).cast("string") for x in ("anchor", "relation", "probe_supports", "graph_a", "probe_depends", "context", None)]),
        (n % 7 + 1).cast("int"),
    )
    problem = answers.chunk_problem((n % 10 * -1 + 8).cast("int"), origin, n % 8 / 6.0, F.col("text"))
    return table(spark, folder, "documents").select("doc_id", problem.alias("problem"))


@query("SELECT doc_id FROM documents WHERE trim(text) <> '' AND doc_id <> (SELECT max(doc_id) FROM documents) AND n_chars > 100")
def p10_valid_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates with an id, a text that is not blank, and another chunk than the one that asks."""
    d = table(spark, folder, "documents")
    asked = d.agg(F.max("doc_id").alias("asked"))
    good = graph.valid_candidates(d.filter("n_chars > 100").join(F.broadcast(asked)), "doc_id", "text", F.col("asked"))
    return good.select("doc_id")


@query(_with(X.CHUNKS) + "SELECT document_id, count(*) AS n, bool_and(p IS NULL OR (page_number, chunk_index) > (p, i)) AS in_order FROM (SELECT *, lag(page_number) OVER w AS p, lag(chunk_index) OVER w AS i FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY seq)) GROUP BY document_id")
def w11_ordered_documents(spark: SparkSession, folder: str) -> DataFrame:
    place = F.struct("page_number", "chunk_index")
    before = F.lag(place).over(Window.partitionBy("document_id").orderBy("seq"))
    c = X.chunks(spark, folder).withColumn("ok", before.isNull() | (place > before))
    return c.groupBy("document_id").agg(F.count("*").alias("n"), F.bool_and("ok").alias("in_order"))


@query(_with(X.CHUNKS) + "SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number, chunk_index) AS context FROM chunks GROUP BY document_id")
def m18_document_contexts(spark: SparkSession, folder: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("page_number", "chunk_index", "text")))
    return X.chunks(spark, folder).groupBy("document_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n\n").alias("context"))


@query(_with(X.CHUNKS) + "SELECT document_id, max(language) AS language, count(*) AS chunk_count, 'cpu' AS processing_device, string_agg(chunk_id, ',' ORDER BY page_number, chunk_index) AS chunk_sequence, CAST(coalesce(max(page_number), 1) AS VARCHAR) AS total_pages FROM chunks GROUP BY document_id")
def f58_document_records(spark: SparkSession, folder: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("page_number", "chunk_index", "chunk_id")))
    return X.chunks(spark, folder).groupBy("document_id").agg(
        F.max("language").alias("language"), F.count("*").alias("chunk_count"), F.lit("cpu").alias("processing_device"), F.array_join(F.transform(listed, lambda x: x["chunk_id"]), ",").alias("chunk_sequence"), F.coalesce(F.max("page_number"), F.lit(1)).cast("string").alias("total_pages")
    )


@query(
    "SELECT doc_id, i AS chunk_index, coalesce(nullif(p, ''), '') AS paragraph FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, "
    "generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"
)
def f64_positions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "paragraph"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("chunk_index"), "paragraph")


@query("SELECT doc_id, substr(text, 1, 1000) AS paragraph_text, 1 AS page_number, 1 AS chunk_index FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def f65_fallback_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rest = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left_anti")
    return rest.select("doc_id", F.substring("text", 1, 1000).alias("paragraph_text"), F.lit(1).alias("page_number"), F.lit(1).alias("chunk_index"))


@query(
    "SELECT vec_id, ['entailment', 'neutral', 'contradiction', 'other'][list_position(e, list_max(e))] AS label, round(list_max(e) / list_sum(e), 6) "
    "AS p FROM (SELECT vec_id, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM (SELECT vec_id, embedding[1:4]::DOUBLE[] AS l FROM "
    "embeddings))"
)
def f43_first_best_labels(spark: SparkSession, folder: str) -> DataFrame:
    p = vectors.softmax(F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")))
    return table(spark, folder, "embeddings").select("vec_id", p.alias("p")).select(
        "vec_id", vectors.first_best(F.col("p"), ["entailment", "neutral", "contradiction", "other"]).alias("label"),
        F.round(F.array_max("p"), 6).alias("p"),
    )


@query("SELECT doc_id, ['chart', 'table', 'diagram', 'figure', 'graph', 'table', 'figure'][doc_id % 7 + 1] AS image_type FROM documents")
def f18_image_types(spark: SparkSession, folder: str) -> DataFrame:
    made = ("A Chart of graphs", "Table 3 and a diagram", "the DIAGRAM and chart", "Photo plot", "graph of a figure", "table", None)
    caption = F.element_at(F.array(*[F.lit(x).cast("string") for x in made]), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, folder, "documents").select("doc_id", images.image_type(caption).alias("image_type"))


@query(
    "SELECT doc_id, n AS image, 'FIGURE ' || (doc_id + n) AS label FROM documents, (VALUES (0), (1)) t(n) WHERE (n = 0 AND doc_id % 3 <> 2) OR n = 1"
)
def j14_figure_captions(spark: SparkSession, folder: str) -> DataFrame:
    """Two placeholders before and after each whole text; the first one's caption is 2, 8 or 12 lines below it."""
    n = F.col("doc_id")
    gap = F.element_at(F.array(F.lit(2), F.lit(8), F.lit(12)), (n % 3 + 1).cast("int"))
    label = lambda i: F.concat(F.lit("\n FIGURE "), n + i, F.lit(": lines below"))
    body = F.concat(F.lit("a\n <!-- image --> "), F.repeat(F.lit("\nx"), gap), label(0), F.lit("\n"), F.col("text"), F.lit("\n<!-- image -->\ny"), label(1))
    found = table(spark, folder, "documents").select("doc_id", F.inline(images.figure_labels(body)))
    return found.select("doc_id", F.col("image").cast("int").alias("image"), "label")


@query("SELECT doc_id, i AS chunk_index, CASE WHEN i <= 2 THEN printf('0%d:01:05', doc_id % 10) ELSE '00:00:00' END AS clock FROM documents, (VALUES (1), (2), (3)) t(i)")
def j18_audio_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    """A chunk's timestamp is the one of its number in the transcript, 00:00:00 where there is none."""
    mark = F.format_string("[%02d:01:05]", F.col("doc_id") % 10)
    rows = table(spark, folder, "documents").select(
        "doc_id", F.concat(mark, F.lit(" "), F.col("text"), F.lit("\n"), mark).alias("markdown"),
        F.explode(F.sequence(F.lit(1), F.lit(3))).alias("chunk_index"),
    )
    return rows.select("doc_id", "chunk_index", text.audio_clock(F.col("markdown"), F.col("chunk_index")).alias("clock"))


ROUTES = {"water": ("river", "the", "lake"), "words": ("and", "that"), "other": ("of",)}
_COUNTS = {k: " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in ws) for k, ws in ROUTES.items()}


@query(f"SELECT item_id, CASE WHEN water = greatest(water, words, other) THEN 'water' WHEN words = greatest(water, words, other) THEN 'words' ELSE 'other' END AS route FROM (SELECT item_id, {', '.join(f'{v} AS {k}' for k, v in _COUNTS.items())} FROM benchmark)")
def f35_routed_questions(spark: SparkSession, folder: str) -> DataFrame:
    hits = {k: reduce(lambda a, b: a + b, [F.contains(F.lower("text"), F.lit(w)).cast("int") for w in ws]) for k, ws in ROUTES.items()}
    scored = F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("first"), F.lit(k).alias("k")) for i, (k, n) in enumerate(hits.items())])
    return table(spark, folder, "benchmark").select("item_id", F.array_max(scored)["k"].alias("route"))


@query(
    "SELECT count(DISTINCT source) AS n_sources, count(*) FILTER (lang = 'fr') AS n_moments, count(*) FILTER (quality = 0) AS n_conflicts FROM "
    "documents LEFT JOIN labels USING (doc_id)"
)
def a21_evidence_summary(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return d.agg(
        F.countDistinct("source").alias("n_sources"), F.count_if(F.col("lang") == "fr").alias("n_moments"),
        F.count_if(F.col("quality") == 0).alias("n_conflicts"),
    )


@query(
    "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, regexp_matches(text, '\\|[-:]+\\|') AS has_table, "
    "regexp_matches(text, '(?m)^#{1,6}\\s+') AS has_heading, regexp_matches(text, '!\\[.*?\\]\\(.*?\\)') AS has_image FROM documents"
)
def f3_structure(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), t.rlike(text.TABLE).alias("has_table"),
        t.rlike(r"(?m)^#{1,6}\s+").alias("has_heading"), t.rlike(text.IMAGE).alias("has_image"),
    )


@query("SELECT doc_id, '![c' || doc_id || '](f.png) ' || text || ' <!-- image -->' AS markdown FROM documents")
def f19_placed_images(spark: SparkSession, folder: str) -> DataFrame:
    image = F.array(F.struct(F.concat(F.lit("c"), F.col("doc_id")).alias("caption"), F.lit("f.png").alias("path")))
    body = F.concat(F.lit("<!-- image --> "), F.col("text"), F.lit(" <!-- image -->"))
    return table(spark, folder, "documents").select("doc_id", images.with_images(body, image).alias("markdown"))


@query(
    "SELECT doc_id, '![x](figures/a.png)' || chr(10) || chr(10) || '**[Image Analysis]:** cost $1 \\ ' || doc_id || chr(10) || ' ' || text || ' ![y](b.png) ![z](./figures/c.png)' || chr(10) || chr(10) || '**[Image Analysis]:** third' || chr(10) AS markdown FROM documents"
)
def f20_image_analyses(spark: SparkSession, folder: str) -> DataFrame:
    """Three images are known: one by folder and name, one without an analysis, one by ./folder and name."""
    one = lambda path, analysis: F.struct(F.lit(path).alias("path"), analysis.cast("string").alias("analysis"))
    known = F.array(
        one("/out/figures/a.png", F.concat(F.lit("cost $1 \\ "), F.col("doc_id"))), one("/out/figures/b.png", F.lit(None)),
        one("/out/figures/c.png", F.lit("third")),
    )
    body = F.concat(F.lit("![x](figures/a.png) "), F.col("text"), F.lit(" ![y](b.png) ![z](./figures/c.png)"))
    return table(spark, folder, "documents").select("doc_id", images.with_analyses(body, known).alias("markdown"))


@query(
    "SELECT doc_id, '![x](' || CASE WHEN doc_id % 2 = 0 THEN 'd\\' ELSE 'e/f/' END || 'n' || doc_id % 7 || '.png)' AS reference, CASE WHEN doc_id % 7 < 5 THEN CASE WHEN doc_id % 2 = 0 THEN 'caption d ' ELSE 'caption ' END || doc_id % 7 END AS caption FROM documents"
)
def j13_captioned_references(spark: SparkSession, folder: str) -> DataFrame:
    """Images of two folders have the same names: the folder decides where the reference has it."""
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, "d\\").otherwise("e/f/"), F.lit("n"), (F.col("doc_id") % 7).cast("string"), F.lit(".png"))
    docs = table(spark, folder, "documents").select("doc_id", F.concat(F.col("text"), F.lit(" see ![x]("), name, F.lit(") here")).alias("text"))
    known = spark.range(5).select(F.format_string("/a/n%d.png", "id").alias("path"), F.format_string("caption %d", "id").alias("caption"))
    known = known.unionByName(spark.range(5).select(F.format_string("/store/d/n%d.png", "id").alias("path"), F.format_string("caption d %d", "id").alias("caption")))
    return images.captioned_references(docs, known)


@query(
    "SELECT path, min(source) AS source, count(*) AS n FROM (SELECT 'p' || page_id % 40 AS path, 'extracted' AS source FROM pages UNION ALL SELECT 'p' "
    "|| page_id % 30, 'standalone' FROM pages UNION ALL SELECT 'p' || page_id % 60, 'ocr' FROM pages) GROUP BY path"
)
def u7_image_sources(spark: SparkSession, folder: str) -> DataFrame:
    p, out = table(spark, folder, "pages"), None
    for n, source in ((40, "extracted"), (30, "standalone"), (60, "ocr")):
        one = p.select(F.concat(F.lit("p"), F.col("page_id") % n).alias("path"), F.lit(source).alias("source"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("path").agg(F.min("source").alias("source"), F.count("*").alias("n"))


@query(
    "SELECT src, dst, type, max(confidence) AS confidence FROM (SELECT user_id % 50 AS src, event_id % 50 AS dst, CASE event_type WHEN 'click' THEN "
    "'ELABORATES' WHEN 'view' THEN 'CONTRADICTS' ELSE upper(event_type) END AS type, value AS confidence FROM events) WHERE type IN ('CONTRADICTS', "
    "'ELABORATES', 'DEPENDS_ON') GROUP BY ALL"
)
def k9_typed_edge_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of known types only; of repeated ones the highest confidence is kept, here as the version."""
    kind = F.when(F.col("event_type") == "click", "ELABORATES").when(F.col("event_type") == "view", "CONTRADICTS").otherwise(F.upper("event_type"))
    edges = table(spark, folder, "events").select(
        (F.col("user_id") % 50).alias("src"), (F.col("event_id") % 50).alias("dst"), kind.alias("type"), F.col("value").alias("confidence"),
    )
    good = edges.filter(F.col("type").isin("CONTRADICTS", "ELABORATES", "DEPENDS_ON")).withColumn("version", F.col("confidence"))
    return upsert(good.limit(0), good, ["src", "dst", "type"], "version").drop("version")


@query(_with(X.VECTORS, X.SIMILAR) + "SELECT count(*) AS n_edges, count(DISTINCT src) AS n_sources, round(avg(score), 6) AS avg_score, max(score) AS max_score, round(count(*) / count(DISTINCT src), 6) AS edges_a_source FROM alike")
def a9_edge_statistics(spark: SparkSession, folder: str) -> DataFrame:
    e = X.similar(spark, folder)
    return e.agg(
        F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_sources"), F.round(F.avg("score"), 6).alias("avg_score"),
        F.max("score").alias("max_score"), F.round(F.try_divide(F.count("*"), F.countDistinct("src")), 6).alias("edges_a_source"),
    )


@query("SELECT item_id, text AS vector_query, lower(text) AS keyword_query, CASE WHEN item_id % 2 = 0 THEN 'en' END AS language FROM benchmark WHERE item_id % 5 <> 0")
def f56_commands(spark: SparkSession, folder: str) -> DataFrame:
    """Commands to JSON and back, with words around the JSON; those without a keyword query are no commands."""
    q = table(spark, folder, "benchmark")
    filters = F.when(F.col("item_id") % 2 == 0, F.create_map(F.lit("language"), F.lit("en")))
    made = F.struct(
        F.col("text").alias("vector_query"), F.when(F.col("item_id") % 5 != 0, F.lower("text")).alias("keyword_query"),
        filters.alias("metadata_filter"), F.lit(5).alias("max_chunks"),
    )
    read = answers.parsed_command(F.concat(F.lit("So: "), answers.command_json(made), F.lit(" - done")))
    return q.select("item_id", read.alias("c")).filter("c is not null").select(
        "item_id", "c.vector_query", "c.keyword_query", F.col("c.metadata_filter")["language"].alias("language"),
    )


@query(
    "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'missing page_number' WHEN doc_id % 3 = 0 THEN 'origin' WHEN doc_id % 5 = 0 THEN 'confidence' END AS problem, text FROM documents"
)
def f57_parsed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("doc_id")
    made = F.struct(
        F.concat(F.lit("c"), n).alias("chunk_id"), F.lit("d").alias("document_id"), F.when(n % 4 != 0, 3).alias("page_number"), F.lit("/p").alias("document_path"), "text",
        F.when(n % 3 == 0, "elsewhere").otherwise("anchor").alias("origin"), F.when(n % 5 == 0, 1.5).otherwise(0.5).alias("confidence"),
    )
    read = answers.parsed_chunk(F.to_json(made))
    return table(spark, folder, "documents").select("doc_id", read.alias("r")).select("doc_id", "r.problem", "r.chunk.text")
