"""Derived tables that the queries share, as DataFrames and as SQL common table expressions.

Five consecutive doc_ids make a document of five chunks on three pages; embeddings get ids the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.ids import chunk_id
from lodestrata.functions.vectors import dot
from lodestrata.sources.tables import table

_NUMBERS = "printf('DOC_%d', {0} // 5) AS document_id, CAST(({0} % 5) // 2 + 1 AS INTEGER) AS page_number, CAST({0} % 5 + 1 AS INTEGER) AS chunk_index, printf('DOC_%d_P%02d_C%02d', {0} // 5, ({0} % 5) // 2 + 1, {0} % 5 + 1) AS chunk_id"

# Words between Unicode word boundaries, for DuckDB: its patterns lack subtraction and look-around, so letters are listed by script.
_LETTER = r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{Armenian}\p{Hebrew}\p{Arabic}\p{Devanagari}\p{Bengali}\p{Tamil}\p{Georgian}\p{Ethiopic}\p{Hangul}\x{b5}][\p{M}]*"
_MID = r"[:\x{b7}\x{387}\x{2027}.\x{2018}\x{2019}\x{2024}'']"
_DIGITS = r"\p{Nd}\p{M}*(?:[,;.\x{2018}\x{2019}\x{2024}'']\p{Nd}\p{M}*)*"
_PART = f"{_LETTER}(?:{_MID}{_LETTER})*|{_DIGITS}"
_PATTERN = rf"[\p{{Han}}\p{{Hiragana}}]\p{{M}}*|[\p{{Katakana}}\x{{30fc}}]+|\p{{Pc}}*(?:{_PART})(?:{_PART}|\p{{Pc}})*"


def words_sql(text: str) -> str:
    """The words of a text, in SQL."""
    return f"flatten(list_transform(regexp_extract_all(lower({text}), '{_PATTERN}'), lambda w: regexp_extract_all(w, '(?s).{{1,255}}')))"


CHUNKS = f"chunks AS (SELECT doc_id AS seq, {_NUMBERS.format('doc_id')}, text, lang AS language, source AS source_type FROM documents)"
VECTORS = f"vectors AS (SELECT vec_id AS seq, {_NUMBERS.format('vec_id')}, embedding, label FROM embeddings)"
METADATA = """meta AS (SELECT printf('DOC_%d', n) AS document_id, printf('Volume %d of %s', n, source) AS title, CASE WHEN n % 7 = 0 THEN NULL ELSE printf('/archive/%s/DOC_%d.md', source, n) END AS path,
  printf('Author %d', n % 11) AS author, printf('2024-%02d-%02d', n % 12 + 1, n % 28 + 1) AS created_date, source AS source_type, lang AS language, CASE WHEN n % 3 = 0 THEN '' ELSE printf('DOC_%d.pdf', n) END AS file_name
  FROM (SELECT doc_id // 5 AS n, arg_min(source, doc_id) AS source, arg_min(lang, doc_id) AS lang FROM documents GROUP BY ALL))"""
QUESTIONS = f"questions AS (SELECT item_id AS query_id, text, {words_sql('text')} AS terms FROM benchmark)"
PROBES = "probes AS (SELECT vec_id AS query_id, vec_id AS seq, embedding FROM embeddings WHERE vec_id % 20 = 0)"


def _numbered(df: DataFrame, key: str) -> DataFrame:
    n = F.col(key)
    document = F.format_string("DOC_%d", F.floor(n / 5))
    page, index = (F.floor((n % 5) / 2) + 1).cast("int"), (n % 5 + 1).cast("int")
    return df.select(
        n.alias("seq"), document.alias("document_id"), page.alias("page_number"), index.alias("chunk_index"),
        chunk_id(document, page, index).alias("chunk_id"), *[c for c in df.columns if c != key],
    )


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", F.col("lang").alias("language"), F.col("source").alias("source_type"))
    return _numbered(docs, "doc_id")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _numbered(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"), "vec_id")


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    n = F.floor(F.col("doc_id") / 5)
    docs = table(spark, folder, "documents").groupBy(n.alias("n")).agg(F.min_by("source", "doc_id").alias("source"), F.min_by("lang", "doc_id").alias("lang"))
    return docs.select(
        F.format_string("DOC_%d", "n").alias("document_id"), F.format_string("Volume %d of %s", "n", "source").alias("title"), F.when(F.col("n") % 7 != 0, F.format_string("/archive/%s/DOC_%d.md", "source", "n")).alias("path"),
        F.format_string("Author %d", F.col("n") % 11).alias("author"), F.format_string("2024-%02d-%02d", F.col("n") % 12 + 1, F.col("n") % 28 + 1).alias("created_date"),
        F.col("source").alias("source_type"), F.col("lang").alias("language"), F.when(F.col("n") % 3 == 0, "").otherwise(F.format_string("DOC_%d.pdf", "n")).alias("file_name"),
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    from lodestrata.functions.text import tokens

    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text", tokens(F.col("text")).alias("terms"))


def probes(spark: SparkSession, folder: str) -> DataFrame:
    """Every twentieth vector asks; against all vectors."""
    return table(spark, folder, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("seq"), "embedding")


# Similarity edges and typed edges, as the graph queries make them.
EDGE_THRESHOLD = 0.2
EDGE_CANDIDATES = 35
SIMILAR = f"""near AS (SELECT s.chunk_id AS src, d.chunk_id AS dst, s.document_id AS sd, d.document_id AS dd, round(list_dot_product(s.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score
  FROM vectors s JOIN vectors d ON d.seq < s.seq),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rn FROM near) WHERE rn <= {EDGE_CANDIDATES}),
alike AS (SELECT src, dst, score, rank FROM (SELECT src, dst, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM cand WHERE sd <> dd AND score >= {EDGE_THRESHOLD}) WHERE rank <= 10)"""


def near(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector's nearest older ones, all by all: (query_id, chunk_id, score, rank)."""
    from lodestrata.operators.search import knn

    v = vectors(spark, folder)
    return knn(v.select(F.col("chunk_id").alias("query_id"), "embedding", "seq"), v, EDGE_CANDIDATES, older_only=True)


def stored_near(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest older ones, searched once for all edges and pairs that are stored."""
    from lodestrata.sources.stores import stored

    return stored(vectors(spark, folder), "near", folder, lambda _, path: near(spark, folder).write.parquet(path))


def similar(spark: SparkSession, folder: str, found: DataFrame | None = None) -> DataFrame:
    """found: the nearest older ones, where they are known."""
    from lodestrata.operators.graph import similarity_edges

    return similarity_edges(vectors(spark, folder), EDGE_CANDIDATES, EDGE_THRESHOLD, 10, None if found is None else lambda asked, k: found)


#: Classifier stand-in: logits from a pair's similarity and the parity of its ends.
PAIRS = """pairs AS (SELECT c.src, c.dst, c.score, s.seq AS a, d.seq AS b FROM cand c JOIN vectors s ON s.chunk_id = c.src JOIN vectors d ON d.chunk_id = c.dst),
logit AS (SELECT src, dst, [4 * score + (a + b) % 3, 3 * score + (a + b) % 5 * 0.5, 5 * score + (a % 4) * 0.5, 1.5]::DOUBLE[] AS l FROM pairs),
soft AS (SELECT src, dst, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM logit),
judged AS (SELECT src, dst, ['contradicts', 'elaborates', 'depends_on', 'unrelated'][list_position(e, list_max(e))] AS relation, round(list_max(e) / list_sum(e), 6) AS confidence FROM soft)"""
TYPED = """typed AS (SELECT src, dst, type, confidence, rank FROM (SELECT src, dst, upper(relation) AS type, confidence, row_number() OVER (PARTITION BY src, relation ORDER BY confidence DESC, dst) AS rank
  FROM judged WHERE relation <> 'unrelated' AND confidence >= 0.5) WHERE rank <= 5)"""


def judged_pairs(spark: SparkSession, folder: str, found: DataFrame | None = None) -> DataFrame:
    """found: the nearest older ones, where they are known."""
    from lodestrata.operators.graph import classified

    v = vectors(spark, folder)
    pairs = (near(spark, folder) if found is None else found).select(F.col("query_id").alias("src"), F.col("chunk_id").alias("dst"), "score")
    pairs = pairs.join(
        v.select(F.col("chunk_id").alias("src"), F.col("seq").alias("a")), "src",
    ).join(v.select(F.col("chunk_id").alias("dst"), F.col("seq").alias("b")), "dst")
    score, a, b = F.col("score"), F.col("a"), F.col("b")
    logits: Column = F.array(4 * score + (a + b) % 3, 3 * score + (a + b) % 5 * 0.5, 5 * score + (a % 4) * 0.5, F.lit(1.5))
    return classified(pairs, logits).select("src", "dst", "relation", "confidence")


def typed(spark: SparkSession, folder: str) -> DataFrame:
    from lodestrata.operators.graph import typed_edges

    return typed_edges(judged_pairs(spark, folder), 0.5, 5)


def cosine_of(a: Column, b: Column) -> Column:
    return F.round(dot(a, b), 6)


def keywords(spark: SparkSession, folder: str):
    """The stored, impact-ordered postings of a folder's chunks."""
    from lodestrata.operators.impacts import Keywords, write_impacts
    from lodestrata.sources.stores import stored_folder

    return Keywords(spark, stored_folder(chunks(spark, folder).select("chunk_id", "text"), "impacts", folder, write_impacts))


def keyword_hits(spark: SparkSession, folder: str, asked: DataFrame) -> DataFrame:
    """The best twelve chunks for each question, from the stored postings."""
    return keywords(spark, folder).search(asked)


def stored_similar(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity edges, made once."""
    from lodestrata.sources.stores import stored

    return stored(similar(spark, folder, stored_near(spark, folder)), "similar", folder)


def stored_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Classified pairs, made once."""
    from lodestrata.sources.stores import stored

    return stored(judged_pairs(spark, folder, stored_near(spark, folder)), "pairs", folder)


def stored_typed(spark: SparkSession, folder: str) -> DataFrame:
    """Typed edges of the stored pairs, made once."""
    from lodestrata.operators.graph import typed_edges
    from lodestrata.sources.stores import stored

    return stored(typed_edges(stored_pairs(spark, folder), 0.5, 5), "typed", folder)


def similar_lists(spark: SparkSession, folder: str):
    """Similarity edges by node."""
    from lodestrata.operators.adjacency import Adjacency, write_adjacency
    from lodestrata.sources.stores import stored_folder

    return Adjacency(spark, stored_folder(stored_similar(spark, folder), "similar-lists", folder, write_adjacency))


def typed_lists(spark: SparkSession, folder: str):
    """Typed edges by node."""
    from lodestrata.operators.adjacency import Adjacency, write_adjacency
    from lodestrata.sources.stores import stored_folder

    write = lambda df, path: write_adjacency(df, path, "confidence", "type")
    return Adjacency(spark, stored_folder(stored_typed(spark, folder), "typed-lists", folder, write))
