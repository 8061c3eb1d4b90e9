"""Sources, archive pages, stores and upserts: queries over pages and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators import events, models
from lodestrata.queries import fixtures as X
from lodestrata.queries.registry import query
from lodestrata.sources import tables as S
from lodestrata.sources.keyed import KeyedTable
from lodestrata.sources.stores import shared_folder


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return S.table(spark, folder, "pages")


EXT = r"lower(regexp_extract(url, '(\.[A-Za-z0-9]+)(?:[?#].*)?$', 1))"


def _case(known: dict[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {EXT} IN ({names}) THEN '{kind}'" for kind, names in known.items()) + f" ELSE '{other}' END"


# Written by hand from the rules, not from the library's constants.
_CATEGORY = _case(
    {
        "document": "'.pdf', '.docx', '.doc', '.pptx', '.ppt', '.xlsx', '.xls', '.csv', '.html', '.htm'",
        "audio": "'.mp3', '.wav', '.m4a', '.flac'",
        "image": "'.jpg', '.jpeg', '.png', '.webp'",
    },
    "unknown",
)
_FOLDER = _case(
    {
        "PDF": "'.pdf'", "WORD": "'.docx', '.doc'", "PPT": "'.pptx', '.ppt'", "EXCEL": "'.xlsx', '.xls', '.csv'", "HTML": "'.html', '.htm'",
        "AUDIO": "'.mp3', '.wav', '.m4a', '.flac'", "IMAGES": "'.jpg', '.jpeg', '.png', '.webp'",
    },
    "OTHER",
)
_SOURCE = _case(
    {
        "pdf": "'.pdf'", "docx": "'.docx', '.doc'", "pptx": "'.pptx', '.ppt'", "xlsx": "'.xlsx', '.xls', '.csv'", "web": "'.html', '.htm'",
        "audio": "'.mp3', '.wav', '.m4a', '.flac'", "image": "'.jpg', '.jpeg', '.png', '.webp'",
    },
    "unknown",
)
#: The pages' addresses, most without an extension, with one of these put behind by number.
_ENDINGS = ("", ".md", ".PPT", ".xls", ".csv", ".docx", ".ogg", ".flac", ".webp", ".gif", ".Mp3", ".jpeg", ".txt", ".pdf", ".xlsx", ".png")
_NAMED = "named AS (SELECT page_id, url || [" + ", ".join(repr(e) for e in _ENDINGS) + "][page_id % 16 + 1] AS url FROM pages)"


def _named_pages(spark: SparkSession, folder: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("page_id") % 16 + 1).cast("int"))
    return _pages(spark, folder).select("page_id", F.concat("url", ending).alias("url"))


@query(f"WITH {_NAMED} SELECT page_id, {EXT} AS ext, {_CATEGORY} AS category, {_FOLDER} AS folder_type, {_SOURCE} AS source_type FROM named")
def s8_page_categories(spark: SparkSession, folder: str) -> DataFrame:
    url = F.col("url")
    return _named_pages(spark, folder).select(
        "page_id", text.extension(url).alias("ext"), S.category(url).alias("category"), S.folder_type(url).alias("folder_type"),
        S.source_type(url).alias("source_type"),
    )


_MIMES = ("application/msword", "text/html", "text/plain", "audio/x-m4a", "audio/ogg", "video/mp4", "image/webp", "image/gif")


@query(
    "WITH named AS (SELECT page_id, [" + ", ".join(repr(m) for m in _MIMES) + "][page_id % 8 + 1] AS mime, CASE WHEN page_id % 3 = 0 THEN 'x.wav' ELSE 'x.bin' END AS name FROM pages) "
    "SELECT page_id, CASE WHEN name = 'x.wav' THEN 'audio' WHEN mime IN ('application/msword', 'text/html') THEN 'document' WHEN mime = 'audio/x-m4a' THEN 'audio' WHEN mime = 'image/webp' THEN 'image' ELSE 'unknown' END AS category FROM named"
)
def s7_mime_categories(spark: SparkSession, folder: str) -> DataFrame:
    """The extension decides; the MIME type where it is unknown."""
    mime = F.element_at(F.array(*map(F.lit, _MIMES)), (F.col("page_id") % 8 + 1).cast("int"))
    name = F.when(F.col("page_id") % 3 == 0, "x.wav").otherwise("x.bin")
    return _pages(spark, folder).select("page_id", S.category(name, mime).alias("category"))


@query(f"WITH {_NAMED} SELECT category, count(*) AS n FROM (SELECT {_CATEGORY} AS category FROM named) GROUP BY category")
def a22_pages_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return _named_pages(spark, folder).groupBy(S.category(F.col("url")).alias("category")).agg(F.count("*").alias("n"))


@query(f"WITH {_NAMED} SELECT page_id, {EXT} IN ('.pdf', '.docx', '.pptx', '.xlsx', '.mp3', '.wav', '.jpg', '.png') AND NOT contains(url, '..') AS accepted FROM named")
def s9_upload_check(spark: SparkSession, folder: str) -> DataFrame:
    return _named_pages(spark, folder).select("page_id", S.uploadable(F.col("url")).alias("accepted"))


@query(
    r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS "
    r"paragraphs, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages"
)
def f3_page_structure(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.size(F.regexp_extract_all("html", F.lit("<p[ >]"), F.lit(0))).cast("long").alias("paragraphs"),
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
    )


# RE2 has no back references: each of the four elements is its own branch.
_PAGE_TEXT = r"""WITH cut AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<footer\b.*?</footer>|<!--.*?-->', ' ', 'g'),
  '(?i)<br\s*/?>|</(p|div|h[1-6]|li|tr|article)>', chr(10), 'g') AS t FROM pages),
bare AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(t, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM cut)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g'), '^\s+', ''), '\s+$', '') AS text FROM bare"""


@query(_PAGE_TEXT)
def s10_page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("page_id", text.html_text(F.col("html")).alias("text"))


@query("SELECT page_id, 'https://h/api/files/' || ltrim(replace(url, 'http:/', ''), '/') AS file_url FROM pages")
def f22_file_urls(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("page_id", text.file_url(F.replace("url", F.lit("http:/"), F.lit("")), "https://h/").alias("file_url"))


_SIZED = "sized AS (SELECT page_id, strlen(html) * CASE page_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1024 WHEN 3 THEN 1048576 ELSE 4294967296 END AS n FROM pages)"


@query(
    f"WITH {
        _SIZED
    } SELECT page_id, CASE WHEN n < 1024 THEN printf('%.1f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) "
    "WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824) ELSE printf('%.1f TB', n / 1099511627776) END AS size FROM sized"
)
def f36_file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    factor = F.element_at(F.array(*[F.lit(x).cast("long") for x in (1, 0, 1024, 1 << 20, 1 << 32)]), (F.col("page_id") % 5 + 1).cast("int"))
    return _pages(spark, folder).select("page_id", text.file_size(F.octet_length("html").cast("long") * factor).alias("size"))


@query("SELECT page_id, 'fig/' || page_id || '.png' AS images FROM pages")
def f17_image_paths(spark: SparkSession, folder: str) -> DataFrame:
    marked = F.concat(F.lit("![a](fig/"), F.col("page_id"), F.lit(".png) ![b](https://x/y.png) ![c](data:image/png;base64,xx)"))
    return _pages(spark, folder).select("page_id", F.array_join(text.image_paths(marked), ",").alias("images"))


UPSERT = """stored AS (SELECT doc_id, lang, source, 1 AS version FROM documents WHERE doc_id % 3 <> 0), fresh AS (SELECT doc_id, upper(lang) AS lang, source, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 2 END AS version FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)"""


def _stored(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    d = S.table(spark, folder, "documents")
    return d.filter("doc_id % 3 <> 0").select("doc_id", "lang", "source", F.lit(1).alias("version")), d.filter("doc_id % 2 = 0 or doc_id % 3 = 0").select("doc_id", F.upper("lang").alias("lang"), "source", F.when(F.col("doc_id") % 5 == 0, 0).otherwise(2).alias("version"))


@query(f"WITH {UPSERT} SELECT doc_id, lang, source, version FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY version DESC, n DESC) AS r FROM (SELECT *, 0 AS n FROM stored UNION ALL SELECT *, 1 FROM fresh)) WHERE r = 1")
def k1_upserted_documents(spark: SparkSession, folder: str) -> DataFrame:
    return S.upsert(*_stored(spark, folder), ["doc_id"], "version")


@query(f"WITH {UPSERT} SELECT doc_id, lang, source, version FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY version DESC, n DESC) AS r FROM (SELECT *, 0 AS n FROM stored UNION ALL SELECT *, 1 FROM fresh)) WHERE r = 1")
def k1_upserted_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """The same upsert into a keyed table, which rewrites the buckets of the new keys."""
    stored, fresh = _stored(spark, folder)
    return _keyed(stored, ["doc_id"], fresh).read()


def _keyed(stored: DataFrame, keys: list[str], fresh: DataFrame, version: str = "version", buckets: int | None = None) -> KeyedTable:
    path = f"{shared_folder(stored.sparkSession)}/lodestrata/keyed-{uuid.uuid4().hex}"
    table = KeyedTable.create(stored, path, keys, version, buckets)
    table.upsert(fresh)
    return table


@query(f"WITH {X.METADATA} SELECT document_id, CASE WHEN document_id LIKE '%7' THEN NULL ELSE title END AS title, path, file_name, CASE WHEN document_id LIKE '%7' THEN 2 ELSE 1 END AS version FROM meta")
def k3_metadata_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata put in again whole: a null in the new row is kept as a null."""
    meta = X.metadata(spark, folder).select("document_id", "title", "path", "file_name", F.lit(1).alias("version"))
    fresh = meta.filter("document_id like '%7'").withColumns({"title": F.lit(None).cast("string"), "version": F.lit(2)})
    return _keyed(meta, ["document_id"], fresh).read()


@query("SELECT count(*) AS n_keys, true AS only_theirs, true AS fewer FROM documents WHERE doc_id % 100 = 0")
def k1_buckets_rewritten(spark: SparkSession, folder: str) -> DataFrame:
    """Whether an upsert of one row in a hundred writes the buckets of its keys and no other."""
    docs = S.table(spark, folder, "documents").select("doc_id", "lang", F.lit(1).alias("version"))
    buckets = max(64, docs.count() // 5)
    path = f"{shared_folder(spark)}/lodestrata/keyed-{uuid.uuid4().hex}"
    table = KeyedTable.create(docs, path, ["doc_id"], "version", buckets)
    before = table.folders()
    fresh = docs.filter("doc_id % 100 = 0").withColumn("version", F.lit(2))
    written = table.upsert(fresh)
    after = table.folders()
    changed = {b for b in after if before.get(b) != after[b]}
    theirs = {r[0] for r in fresh.select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).distinct().collect()}  # at most a row a bucket
    same = spark.range(1).select(F.lit(changed == theirs and written == len(theirs)).alias("only_theirs"), F.lit(len(changed) < len(after)).alias("fewer"))
    return table.read().filter("version = 2").agg(F.count("*").alias("n_keys")).join(same)


@query(f"WITH {UPSERT} SELECT * FROM stored WHERE doc_id NOT IN (SELECT doc_id FROM fresh)")
def k10_deleted_documents(spark: SparkSession, folder: str) -> DataFrame:
    stored, fresh = _stored(spark, folder)
    return S.delete(stored, fresh, ["doc_id"])


@query(
    "WITH cache AS (SELECT DISTINCT 'embedding:doc:' || substr(sha256('search_document: ' || text), 1, 16) AS k FROM documents JOIN labels USING (doc_id)) "
    "SELECT doc_id, CASE WHEN 'embedding:doc:' || substr(sha256('search_document: ' || text), 1, 16) IN (SELECT k FROM cache) THEN 'hit' ELSE 'miss' END AS cache FROM documents"
)
def k19_cache_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of labelled documents are in the cache; a lookup goes by the key of the text."""
    d = S.table(spark, folder, "documents").select("doc_id", "text")
    known = models.cache_rows(d.join(S.table(spark, folder, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("embedding", F.array(F.lit(1.0))))
    return models.cached(d, known).select("doc_id", F.when(F.col("hit"), "hit").otherwise("miss").alias("cache"))


@query(
    "SELECT 'documents' AS store, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'pages', "
    "count(*) FROM pages UNION ALL SELECT 'conversations', count(*) FROM conversations"
)
def a2_table_counts(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for name in ("documents", "embeddings", "pages", "conversations"):
        one = S.table(spark, folder, name).agg(F.lit(name).alias("store"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {X.CHUNKS} SELECT chunk_id, text FROM chunks WHERE chunk_id = 'DOC_3_P01_C01'")
def s13_paragraph(spark: SparkSession, folder: str) -> DataFrame:
    return X.chunks(spark, folder).filter("chunk_id = 'DOC_3_P01_C01'").select("chunk_id", "text")


@query(f"WITH {X.METADATA} SELECT * FROM meta WHERE document_id = 'DOC_3'")
def s15_document_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return X.metadata(spark, folder).filter("document_id = 'DOC_3'")


@query(f"WITH {X.METADATA} SELECT document_id, title, source_type FROM meta ORDER BY document_id LIMIT 10000")
def s16_metadata_listing(spark: SparkSession, folder: str) -> DataFrame:
    """The listing's cap of 10,000 records is its contract."""
    return X.metadata(spark, folder).select("document_id", "title", "source_type").orderBy("document_id").limit(10_000)


@query(f"WITH {X.VECTORS} SELECT chunk_id, document_id, CAST(max(page_number) AS INTEGER) AS page_number FROM vectors GROUP BY ALL")
def k5_merged_vertices(spark: SparkSession, folder: str) -> DataFrame:
    v = X.vectors(spark, folder).select("chunk_id", "document_id", "page_number", F.lit(1).alias("version"))
    return S.upsert(v.filter("page_number < 3"), v.filter("page_number > 1"), ["chunk_id"], "version").select("chunk_id", "document_id", "page_number")


@query(f"WITH {X.METADATA} SELECT document_id, title FROM meta WHERE document_id NOT IN (SELECT printf('DOC_%d', item_id) FROM benchmark)")
def k10_deleted_sources(spark: SparkSession, folder: str) -> DataFrame:
    gone = S.table(spark, folder, "benchmark").select(F.format_string("DOC_%d", "item_id").alias("document_id"))
    return S.delete(X.metadata(spark, folder), gone, ["document_id"]).select("document_id", "title")


@query(
    "SELECT kind, count(*) AS n FROM (SELECT unnest(['data: token', 'data: done']) AS line, page_id FROM pages), (SELECT 1) t, LATERAL (SELECT "
    "replace(line, 'data: ', '') AS kind) GROUP BY kind"
)
def r12_event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Event-stream text cut into lines, each a JSON event."""
    body = F.concat(F.lit('data: {"type": "token", "n": '), F.col("page_id"), F.lit('}\n\ndata: {"type": "done"}\n\n: comment\n'))
    lines = _pages(spark, folder).select(F.explode(F.split(body, "\n")).alias("line")).filter("line like 'data: %'")
    event = F.from_json(F.substr(F.col("line"), F.lit(7)), "type string, n long")
    return lines.groupBy(event["type"].alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, count(*) AS n_tokens, sha256(string_agg(text, '' ORDER BY turn)) AS content FROM conversations WHERE text <> '' GROUP BY conv_id")
def r12_streamed_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation as a stream of events, cut into pieces of 61 bytes, and read back."""
    talk = S.table(spark, folder, "conversations").filter("text <> ''")
    event = F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("token").alias("type"), F.col("text").alias("content"))), F.lit("\n\n"))
    whole = talk.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", event.alias("e")))), lambda x: x["e"]), "").alias("body"))
    body = F.concat(F.col("body"), F.lit('data: {"type": "done"}\n\n: comment\n\ndata: {"type": "tok')).cast("binary")
    starts = F.sequence(F.lit(0), F.floor((F.octet_length(body) - 1) / 61).cast("int"))
    cut = whole.select("conv_id", body.alias("body"), F.posexplode(starts).alias("seq", "n")).select("conv_id", "seq", F.substr("body", F.col("n") * 61 + 1, F.lit(61)).alias("body"))
    found = events.events(events.lines(cut, "conv_id"), "type string, content string").filter("event.type = 'token'")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "event.content"))), lambda x: x["content"])
    return found.groupBy("conv_id").agg(F.count("*").alias("n_tokens"), F.sha2(F.array_join(parts, ""), 256).alias("content"))
