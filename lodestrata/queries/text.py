"""Chunking, text rules and metadata: queries over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import ids, metadata, text
from lodestrata.operators.chunking import chunked
from lodestrata.operators.markdown import to_markdown
from lodestrata.operators.models import summary
from lodestrata.queries.registry import query
from lodestrata.sources.tables import table



def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


@query(r"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS n_words FROM documents")
def f6_word_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", text.word_count(F.col("text")).alias("n_words"))


NOISY = r"noisy AS (SELECT doc_id, 'Page 5 of 10' || chr(10) || text || chr(10) || '12' || chr(10) || '- 5 -' || chr(10) || 'end' AS t FROM documents)"


@query(f"WITH {NOISY} " + r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?m)^Page \d+ of \d+$|^\d+$|^-\s*\d+\s*-$', '', 'g'), '^\s+', ''), '\s+$', '') AS clean FROM noisy")
def f1_without_noise(spark: SparkSession, folder: str) -> DataFrame:
    t = F.concat(F.lit("Page 5 of 10\n"), F.col("text"), F.lit("\n12\n- 5 -\nend"))
    return _docs(spark, folder).select("doc_id", text.without_noise(t).alias("clean"))


def _hits(words: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(contains(s, ' {w} ') AS INTEGER)" for w in words)


@query(
    "SELECT doc_id, CASE WHEN greatest(en, es, fr, de) < 3 THEN 'en' WHEN en = greatest(en, es, fr, de) THEN 'en' WHEN es = greatest(en, es, fr, de) THEN 'es' WHEN fr = greatest(en, es, fr, de) THEN 'fr' ELSE 'de' END AS language FROM (SELECT doc_id, "
    + ", ".join(f"{_hits(ws)} AS {k}" for k, ws in text.LANGUAGE_WORDS.items())
    + " FROM (SELECT doc_id, lower(substr(text, 1, 1000)) AS s FROM documents))"
)
def f12_languages(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", text.language(F.col("text")).alias("language"))


@query(
    r"SELECT doc_id, CASE WHEN len(w) > 30 THEN array_to_string(w[1:30], ' ') WHEN len(w) = 0 THEN '[Summary unavailable]' ELSE t END AS summary FROM "
    r"(SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS t, list_filter(string_split_regex(text, '\s+'), lambda x: x <> "
    r"'') AS w FROM documents)"
)
def f33_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", summary(F.col("text")).alias("summary"))


# Documents have no headings and no blank lines, so a document is one block: whole if it has at most 250 words,
# else its sentences packed greedily; the fold over sentences is a recursive query.
CHUNKER = r"""WITH RECURSIVE clean AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?m)^Page \d+ of \d+$|^\d+$|^-\s*\d+\s*-$', '', 'g'), '^\s+', ''), '\s+$', '') AS t FROM documents),
counted AS (SELECT doc_id, t, len(list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')) AS n FROM clean),
sent AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: true) AS ss FROM counted WHERE n > 250),
flat AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM sent),
sized AS (SELECT doc_id, s, i, len(list_filter(string_split_regex(s, '\s+'), lambda w: w <> '')) AS n FROM flat),
fold AS (SELECT doc_id, i, s, n AS held, 1 AS piece FROM sized WHERE i = 1
  UNION ALL SELECT z.doc_id, z.i, z.s, CASE WHEN f.held + z.n <= 250 THEN f.held + z.n ELSE z.n END, CASE WHEN f.held + z.n <= 250 THEN f.piece ELSE f.piece + 1 END FROM fold f JOIN sized z ON z.doc_id = f.doc_id AND z.i = f.i + 1),
split AS (SELECT doc_id, piece, string_agg(s, ' ' ORDER BY i) AS p, sum(n) AS n, FROM (SELECT f.*, z.n FROM fold f JOIN sized z USING (doc_id, i)) GROUP BY doc_id, piece),
every AS (SELECT doc_id, 1 AS piece, t AS p, n FROM counted WHERE n <= 250 UNION ALL SELECT doc_id, piece, p, n FROM split)
SELECT doc_id, CAST(coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 400 + 1 AS INTEGER) AS page_number, CAST(piece AS INTEGER) AS chunk_index,
  regexp_replace(regexp_replace(p, '^\s+', ''), '\s+$', '') AS paragraph_text FROM every"""


@query(CHUNKER)
def f4_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunked(_docs(spark, folder))


@query("SELECT doc_id, count(*) AS n_chunks, CAST(max(page_number) AS BIGINT) AS n_pages, CAST(max(length(paragraph_text)) AS BIGINT) AS longest FROM (" + CHUNKER + ") GROUP BY doc_id")
def w10_pages_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    c = f4_chunks(spark, folder)
    return c.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.max("page_number").cast("long").alias("n_pages"),
        F.max(F.length("paragraph_text")).cast("long").alias("longest"),
    )


def _headed(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a front page: heading, authors, date, identifiers, sections."""
    n = F.col("doc_id")
    front = F.concat(
        F.when(n % 2 == 0, F.format_string("# Report %d*\n", n)).otherwise("a short line\n"), F.lit("Authors: Ada Byron¹, B. Curie2 and C. Noether (ETH)\n"),
        F.when(n % 3 == 0, F.lit("Published: March 5, 2021\n")).when(n % 3 == 1, F.lit("on 2020-02-03 it\n")).otherwise("Date: circa 1999\n"),
        F.format_string(
            "DOI: 10.%d/abc.%d\nJournal: Annals of Things \n*Department of Deep Learning\n## Abstract\nGreat Lake Great Lake River\n## Next\nx\n",
            1000 + n, n,
        ),
    )
    return _docs(spark, folder).select("doc_id", F.concat(front, F.col("text")).alias("text"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN printf('Report %d', doc_id) ELSE 'Authors: Ada Byron¹, B. Curie2 and C. Noether (ETH)' END AS title FROM documents")
def f9_titles(spark: SparkSession, folder: str) -> DataFrame:
    return _headed(spark, folder).select("doc_id", metadata.title(F.col("text"), F.lit("a_b-c.pdf")).alias("title"))


@query("SELECT doc_id, 'Ada Byron; B. Curie; C. Noether' AS authors FROM documents")
def f10_authors(spark: SparkSession, folder: str) -> DataFrame:
    return _headed(spark, folder).select("doc_id", F.array_join(metadata.authors(F.col("text")), "; ").alias("authors"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '2021-03-05' WHEN 1 THEN '2020-02-03' ELSE '1999-01-01' END AS found FROM documents")
def f38_dates(spark: SparkSession, folder: str) -> DataFrame:
    return _headed(spark, folder).select("doc_id", metadata.found_date(F.col("text")).alias("found"))


@query(
    r"""WITH l AS (SELECT doc_id, list_slice(string_split(text, chr(10)), 1, 50 - 9) AS ls FROM documents),
n AS (SELECT doc_id, list_filter(ls, lambda x: regexp_matches(x, '(?i)University|Institute|Laboratory|College|Department')) AS hit FROM l),
c AS (SELECT doc_id, list_filter(list_transform(hit, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^[0-9*†‡§¶#]+', ''), '^\s+', ''), '\s+$', '')), lambda x: length(x) > 10) AS own FROM n)
SELECT doc_id, printf('10.%d/abc.%d', 1000 + doc_id, doc_id) AS doi, 'Annals of Things' AS journal, array_to_string(list_slice(list_concat(['Department of Deep Learning'], own), 1, 3), ', ') AS affiliations FROM c"""
)
def f15_extra_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """The made front page of nine lines stands before each whole text; the rules read their fifty lines."""
    h = _headed(spark, folder)
    return h.select(
        "doc_id", metadata.doi(F.col("text")).alias("doi"), metadata.journal(F.col("text")).alias("journal"),
        metadata.affiliations(F.col("text")).alias("affiliations"),
    )


@query(
    r"""WITH l AS (SELECT doc_id, list_concat(string_split(text, chr(10)), ['## Next', 'x']) AS ls FROM documents),
h AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: regexp_matches(x, '^#{1,6}\s+')), true) AS stop FROM l)
SELECT doc_id, array_to_string(ls[1:stop - 1], chr(10)) AS abstract FROM h"""
)
def f14_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The whole text under a heading, to the next one."""
    body = F.concat(F.lit("# Report\nfront\n## Abstract of it\n"), F.col("text"), F.lit("\n## Next\nx"))
    return _docs(spark, folder).select("doc_id", metadata.section(body, "Abstract").alias("abstract"))


_STOP = ", ".join(f"'{w}'" for w in metadata.STOP_WORDS)
KEYWORDS = rf"""WITH c AS (SELECT doc_id, regexp_replace(substr(text, 1, 1000), '[^\x00-\x7F]', '_', 'g') AS t FROM documents),
p AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(t, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b') AS l FROM c)),
f AS (SELECT doc_id, word, count(*) AS n, min(pos) AS p0 FROM p WHERE lower(word) NOT IN ({_STOP}) AND length(word) > 3 GROUP BY ALL),
f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p0) AS rank FROM f) WHERE rank <= 10),
h AS (SELECT doc_id, count(*) AS have FROM f1 GROUP BY doc_id),
w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(t), '\b[a-z]{{4,}}\b') AS l FROM c LEFT JOIN h USING (doc_id) WHERE coalesce(have, 0) < 5)),
g AS (SELECT doc_id, word, count(*) AS n, min(pos) AS p0 FROM w WHERE word NOT IN ({_STOP}) AND NOT EXISTS (SELECT 1 FROM f1 WHERE f1.doc_id = w.doc_id AND lower(f1.word) = w.word) GROUP BY ALL HAVING count(*) >= 3),
g1 AS (SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p0) + coalesce(have, 0) AS rank FROM g LEFT JOIN h USING (doc_id))
SELECT doc_id, word AS keyword, n, CAST(rank AS INTEGER) AS rank FROM (SELECT doc_id, word, n, rank FROM f1 UNION ALL SELECT doc_id, word, n, rank FROM g1 WHERE rank <= 10)"""


@query(KEYWORDS)
def f13_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return metadata.keywords(_docs(spark, folder).select("doc_id", "text"))


_PROCESSED = r"""WITH w AS (SELECT doc_id, lang, regexp_extract_all(text, '[A-Za-z]+') AS all_words FROM documents),
t AS (SELECT doc_id, lang, list_transform(list_slice(list_concat(list_slice(all_words, 1, 8), [' The ', '', 'beyond the tenth']), 1, 10), lambda x: lower(trim(x))) AS l FROM w)
SELECT doc_id, 'Report ' || doc_id AS title, 'Ann Bee; C. Dee' AS authors, CASE WHEN doc_id % 2 = 0 THEN '2021-03-05' ELSE '1999-01-01' END AS created_date, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END AS language,
  array_to_string(list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i), ',') AS tags FROM t"""


@query(_PROCESSED)
def f16_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata as a model might give it, made regular; the tags are the text's words and three more."""
    n = F.col("doc_id")
    words = F.concat(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 8), F.array(F.lit(" The "), F.lit(""), F.lit("beyond the tenth")))
    raw = F.struct(
        F.concat(F.lit("Report "), n, F.lit("*†# ")).alias("title"), F.array(
            F.lit("Ann Bee¹*"), F.lit(" C. Dee 2"), F.lit("§"),
        ).alias("authors"), F.when(n % 2 == 0, "March 5, 2021").otherwise("in 1999").alias("created_date"),
        F.when(n % 3 == 0, "english").otherwise(F.col("lang")).alias("language"), words.alias("tags"), F.create_map().cast("map<string,string>").alias("extra_metadata"),
    )
    p = metadata.processed(raw, F.lit("f.pdf"))
    return _docs(spark, folder).select("doc_id", p.alias("p")).select(
        "doc_id", "p.title", F.array_join("p.authors", "; ").alias("authors"), "p.created_date", "p.language",
        F.array_join("p.tags", ",").alias("tags"),
    )


@query(
    "SELECT doc_id, CASE WHEN source <> 'src0' THEN CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 7 END END AS page_number, CASE WHEN source = 'src0' THEN CASE WHEN doc_id % 3 = 0 THEN '00:01:02' WHEN doc_id % 4 = 0 THEN '00:00:00' ELSE '7' END END AS \"timestamp\", "
    "CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 3 END AS chunk_index, text AS paragraph_text, CASE WHEN doc_id % 6 = 0 THEN 'Chunk missing required field summary' WHEN text = '' THEN 'Chunk missing required field paragraph_text' END AS problem FROM documents"
)
def f59_normalised_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with a time for audio and a page otherwise, and what they lack."""
    n = F.col("doc_id")
    chunk = F.struct(
        F.when(n % 4 != 0, 7).alias("page_number"), F.when(n % 3 == 0, "00:01:02").alias("timestamp"), F.when(n % 5 != 0, 3).alias("chunk_index"),
        F.col("text").alias("paragraph_text"), F.when(n % 6 != 0, "s").alias("summary"),
    )
    kind = F.when(F.col("source") == "src0", "audio").otherwise(F.col("source"))
    c = _docs(spark, folder).select("doc_id", metadata.normalised_chunk(chunk, kind).alias("c"))
    return c.select("doc_id", "c.page_number", "c.timestamp", "c.chunk_index", "c.paragraph_text", "c.problem")


@query(
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'f' || doc_id ELSE 'Report' END AS title, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Ann, Bob' END AS author, coalesce(lang, 'en') AS language, "
    "CASE WHEN doc_id % 4 = 0 THEN '12' WHEN doc_id % 4 = 1 THEN '9' END AS total_pages, 'cpu' AS device, CAST(n_chars AS VARCHAR) AS chunk_count FROM documents"
)
def f58_document_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """The metadata section of a document record, with its nested defaults."""
    n = F.col("doc_id")
    raw = F.struct(
        F.when(n % 2 != 0, "Report").alias("title"), F.when(
            n % 3 != 0, F.array(F.lit("Ann"), F.lit("Bob")),
        ).alias("authors"), F.lit(None).cast("string").alias("created_date"), F.col("lang").alias("language"),
        F.array().cast("array<string>").alias("tags"), F.when(n % 4 == 0, "12").alias("total_pages"), F.when(
            n % 4 < 2, F.create_map(F.lit("total_pages"), F.lit("9")),
        ).alias("extra_metadata"),
    )
    built = metadata.document_metadata(raw, F.lit("/a/f"), F.lit("pdf"), F.concat(F.lit("f"), n), device="cpu", chunk_count=F.col("n_chars"))
    d = _docs(spark, folder).select("doc_id", built.alias("m"))
    return d.select(
        "doc_id", "m.title", "m.author", "m.language", "m.total_pages", F.col("m.extra_metadata")["processing_device"].alias("device"),
        F.col("m.extra_metadata")["chunk_count"].alias("chunk_count"),
    )


@query("SELECT source, lang, count(*) AS n, count(DISTINCT text) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY source, lang")
def s4_documents_by_group(spark: SparkSession, folder: str) -> DataFrame:
    # Distinct texts by hash: the texts themselves need not be shuffled.
    d = _docs(spark, folder).groupBy("source", "lang").agg(
        F.count("*").alias("n"), F.countDistinct(F.xxhash64("text")).alias("n_texts"), F.sum(F.length("text")).cast("long").alias("n_chars"),
    )
    return d


@query("SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def j2_labels_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j17_unlabelled(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id, 'search_query: ' || text AS q FROM documents")
def f8_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts, a third with each prefix already there and a third without one."""
    n = F.col("doc_id") % 3
    mixed = F.when(n == 0, F.concat(F.lit("search_document: "), F.col("text"))).when(n == 1, F.concat(F.lit("search_query: "), F.col("text"))).otherwise(F.col("text"))
    return _docs(spark, folder).select("doc_id", ids.prefixed(mixed, query=True).alias("q"))


# Order dates as the eight formats write them, and one that only names the year.
_DATE_FORMATS = ("yyyy-MM-dd", "yyyy/M/d", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "MM/dd/yyyy")


def _written(date, number):
    forms = [F.date_format(date, f) for f in _DATE_FORMATS]
    return F.element_at(F.array(*forms, F.concat(F.lit("some time in "), F.date_format(date, "yyyy"))), (number % (len(forms) + 1) + 1).cast("int"))


_READ = "CASE WHEN o_orderkey % 8 = 7 THEN strftime(o_orderdate, '%Y-01-01') ELSE strftime(o_orderdate, '%Y-%m-%d') END"


@query(f"SELECT o_orderkey, {_READ} AS found FROM orders")
def f37_order_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates, each read back from one of the formats."""
    return table(spark, folder, "orders").select("o_orderkey", metadata.parsed_date(_written(F.col("o_orderdate"), F.col("o_orderkey"))).alias("found"))


@query(
    f"SELECT o_orderkey, n_name || ' order ' || o_orderkey AS title, c_mktsegment || '; ' || regexp_replace(n_name, '[0-9]', '', 'g') || '; ' || r_name AS authors, {_READ} AS found, printf('10.%d/ord.%d', 1000 + c_custkey, o_orderkey) AS doi, r_name || ' Journal' AS journal "
    "FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"
)
def f9_front_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Title, authors, date, identifier and journal of a front page written from an order, its customer, nation and region."""
    t = lambda name: table(spark, folder, name)
    rows = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    page = F.concat(
        F.lit("\n# "), "n_name", F.lit(" order "), "o_orderkey", F.lit("*\n\nAuthors: "), "c_mktsegment", F.lit("¹, "), "n_name", F.lit("2 and "), "r_name", F.lit(" (r@x.org)\nPublished: "),
        _written(F.col("o_orderdate"), F.col("o_orderkey")), F.lit("\nDOI: 10."), F.col("c_custkey") + 1000, F.lit("/ord."), "o_orderkey", F.lit("\nJournal: "), "r_name", F.lit(" Journal \n## Abstract\nNone.\n"),
    )
    p = rows.select("o_orderkey", page.alias("p"))
    c = F.col("p")
    return p.select(
        "o_orderkey", metadata.title(c, F.lit("f.pdf")).alias("title"), F.array_join(metadata.authors(c), "; ").alias("authors"), metadata.found_date(c).alias("found"), metadata.doi(c).alias("doi"),
        metadata.journal(c).alias("journal"),
    )


@query("SELECT page_id, array_to_string(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), ' ') AS images FROM pages")
def f17_page_images(spark: SparkSession, folder: str) -> DataFrame:
    """The targets of markdown images in whole pages whose links were made images."""
    marked = F.regexp_replace("html", r'<a href="([^"]*)">([^<]*)</a>', "![$2]($1)")
    return table(spark, folder, "pages").select("page_id", F.array_join(text.image_paths(marked), " ").alias("images"))


# Pages hold one heading, paragraphs, line breaks and emphasis; the rest of them is left out.
_MARKDOWN = r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(replace(html, chr(10), ' '), '(?is)<!doctype[^>]*>|<head\b.*?</head>|<script\b.*?</script>|<!--.*?-->', '', 'g'), '(?is)<(nav|footer)\b.*?</(nav|footer)>', chr(10) || chr(10), 'g'),
    '(?i)<h1>', chr(10) || chr(10) || '# ', 'g'), '(?i)<br>', chr(10), 'g'), '(?i)</?(p|div|article|body|html|h1)\b[^>]*>', chr(10) || chr(10), 'g') , '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'),
  '</?b>', '', 'g'), '[ \t]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS markdown FROM pages"""


@query("SELECT page_id, regexp_replace(markdown, '^\\s+|\\s+$', '', 'g') AS markdown FROM (" + _MARKDOWN + ")")
def s10_page_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as markdown, headings kept."""
    return to_markdown(table(spark, folder, "pages"))


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    """A page for each customer with orders: a heading, a sentence, and a table of the order lines, some longer than a chunk."""
    cell = lambda tag, *values: F.concat(*[F.concat(F.lit(f"<{tag}>"), v, F.lit(f"</{tag}>")) for v in values])
    row = F.concat(F.lit("<tr>"), cell("td", F.concat_ws("-", "l_orderkey", "l_linenumber"), F.col("o_orderpriority"), F.col("l_returnflag")), F.lit("</tr>"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    lines = table(spark, folder, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    orders = lines.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_returnflag", row.alias("row")))).alias("rows"))
    head = F.lit("<tr><th>Line</th><th>Priority</th><th>Flag</th></tr>")
    body = F.concat(
        F.lit("<html><head><title>x</title></head><body><h1>Customer "), F.col("c_custkey").cast("string"), F.lit("</h1><p>Of the "), F.lower("c_mktsegment"), F.lit(" segment.</p><nav>menu</nav><h2>Orders</h2><table>"),
        head, F.array_join(F.transform("rows", lambda r: r["row"]), ""), F.lit("</table></body></html>"),
    )
    return table(spark, folder, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", body.alias("html"))


_REPORT = """lines AS (SELECT o_custkey, string_agg('| ' || l_orderkey || '-' || l_linenumber || ' | ' || o_orderpriority || ' | ' || l_returnflag || ' |', chr(10) ORDER BY l_orderkey, l_linenumber, l_returnflag) AS body FROM orders JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem) ON l_orderkey = o_orderkey GROUP BY o_custkey),
parts AS (SELECT c_custkey, '# Customer ' || c_custkey AS head, 'Of the ' || lower(c_mktsegment) || ' segment.' AS said, '| Line | Priority | Flag |' || chr(10) || '|---|---|---|' || chr(10) || body AS orders FROM customer JOIN lines ON o_custkey = c_custkey)"""


@query(f"WITH {_REPORT} SELECT c_custkey, concat_ws(chr(10) || chr(10), head, said, '## Orders', orders) AS markdown FROM parts")
def s10_report_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with headings and tables as markdown."""
    return to_markdown(_reports(spark, folder), "c_custkey")


@query(
    f"""WITH {_REPORT}, sized AS (SELECT *, len(string_split_regex(trim(orders), '\\s+')) AS n, len(string_split_regex(said, '\\s+')) AS m FROM parts),
split AS (SELECT c_custkey, 1 AS chunk_index, head || chr(10) || said AS paragraph_text FROM sized WHERE 5 + m + n > 250 UNION ALL SELECT c_custkey, 2, '## Orders' || chr(10) || chr(10) || orders FROM sized WHERE 5 + m + n > 250
  UNION ALL SELECT c_custkey, 1, head || chr(10) || said || chr(10) || chr(10) || orders FROM sized WHERE 5 + m + n <= 250)
SELECT c_custkey, CAST(1 AS INTEGER) AS page_number, CAST(chunk_index AS INTEGER) AS chunk_index, paragraph_text FROM split"""
)
def f4_report_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of those pages: a heading stays with what follows, a table that is too long is a chunk alone, whole."""
    return chunked(s10_report_markdown(spark, folder), "c_custkey", "markdown")


@query()
def f4_page_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the pages as markdown: the heading stays with its first paragraph."""
    return chunked(s10_page_markdown(spark, folder), "page_id", "markdown")
