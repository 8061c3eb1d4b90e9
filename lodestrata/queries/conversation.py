"""Sessions, answers, links: queries over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import answers
from lodestrata.operators.activity import answer_events, appended, session_titles
from lodestrata.queries.registry import query
from lodestrata.sources.tables import table


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations")


@query(
    "SELECT conv_id, CASE WHEN length(t) > 50 THEN substr(t, 1, 50) || '...' ELSE t END AS title FROM (SELECT conv_id, arg_min(text, turn) AS t FROM "
    "conversations WHERE role = 'user' GROUP BY conv_id)"
)
def w7_session_titles(spark: SparkSession, folder: str) -> DataFrame:
    return session_titles(_messages(spark, folder), "conv_id", "turn", "text", "role")


@query(
    "SELECT conv_id, count(*) AS n_messages, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, "
    "CAST(max(turn) AS BIGINT) AS last_turn FROM conversations WHERE role <> 'system' GROUP BY conv_id"
)
def a16_session_counts(spark: SparkSession, folder: str) -> DataFrame:
    role = F.col("role")
    return _messages(spark, folder).filter(role != "system").groupBy("conv_id").agg(
        F.count("*").alias("n_messages"), F.count_if(role == "user").alias("n_user"), F.count_if(role == "assistant").alias("n_assistant"),
        F.max("turn").cast("long").alias("last_turn"),
    )


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3 ORDER BY turn")
def s19_session(spark: SparkSession, folder: str) -> DataFrame:
    return _messages(spark, folder).filter("conv_id = 3").orderBy("turn").select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, max(turn) AS updated, count(*) AS n FROM conversations GROUP BY conv_id ORDER BY updated DESC, conv_id LIMIT 20")
def t7_recent_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Top-k report: the twenty most recently updated sessions."""
    return _messages(spark, folder).groupBy("conv_id").agg(F.max("turn").alias("updated"), F.count("*").alias("n")).orderBy(F.desc("updated"), "conv_id").limit(20)


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def r11_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    return _messages(spark, folder).groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("transcript")
    )


@query("SELECT conv_id, turn, CAST(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS BOOLEAN) AS changed FROM conversations")
def w9_speaker_changes(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return _messages(spark, folder).select("conv_id", "turn", (F.col("role") != before).alias("changed"))


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns with thinking, a heading, links and a tool call put in."""
    link = F.concat(
        F.lit(" <link>http://h/a"), F.col("turn").cast("string"),
        F.lit(".PNG</link> and ![x](http://h/d.pdf) [y](http://h/no.png) <link>http://h/d.pdf</link> <link>http://h/z.svg</link>"),
    )
    return _messages(spark, folder).filter("role = 'assistant'").withColumn(
        "answer", F.concat(F.lit("<think> step "), F.col("turn").cast("string"), F.lit("</think>\n\n\n\n"), F.col("text"), link),
    )


MARKED = "marked AS (SELECT conv_id, turn, '<think> step ' || turn || '</think>' || repeat(chr(10), 4) || text || ' <link>http://h/a' || turn || '.PNG</link> and ![x](http://h/d.pdf) [y](http://h/no.png) <link>http://h/d.pdf</link> <link>http://h/z.svg</link>' AS answer FROM conversations WHERE role = 'assistant')"


@query(f"WITH {MARKED} SELECT conv_id, turn, 'http://h/a' || turn || '.PNG' AS images, 'http://h/d.pdf' AS documents FROM marked")
def f21_links(spark: SparkSession, folder: str) -> DataFrame:
    a = F.col("answer")
    return _marked(spark, folder).select(
        "conv_id", "turn", F.array_join(answers.linked_images(a), ",").alias("images"),
        F.array_join(answers.linked_documents(a), ",").alias("documents"),
    )


@query(f"WITH {MARKED} SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(answer, '<think>.*?</think>', '', 'gis'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+', ''), '\\s+$', '') AS main, trim(regexp_extract(answer, '<think>(.*?)</think>', 1)) AS thinking FROM marked")
def f24_thinking(spark: SparkSession, folder: str) -> DataFrame:
    s = answers.separated(F.col("answer"))
    return _marked(spark, folder).select("conv_id", "turn", s["main"].alias("main"), s["thinking"].alias("thinking"))


_CLEAN = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(answer, '<think>.*?</think>', '', 'gis'), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '^\\s+', ''), '\\s+$', '')"
)


@query(f"WITH {MARKED} SELECT conv_id, turn, {_CLEAN} AS answer FROM marked")
def f25_cleaned_answers(spark: SparkSession, folder: str) -> DataFrame:
    """A tagged and a bare tool call are put around each answer and must go; the answer itself stays."""
    call = F.lit('{"name": "rag_retrieval", "arguments": {"query": "a {b}", "n": {"x": 1}}}')
    return _marked(spark, folder).select("conv_id", "turn", answers.cleaned(F.concat(F.lit("<tool_call>x</tool_call>"), F.col("answer"), call)).alias("answer"))


@query(
    "SELECT conv_id, turn, CAST(len(string_split_regex(trim(text), '\\s+')) AS BIGINT) AS words, regexp_matches(text, '[\\x{0900}-\\x{097F}]') AS "
    "devanagari FROM conversations WHERE trim(text) <> ''"
)
def f34_script_and_words(spark: SparkSession, folder: str) -> DataFrame:
    from lodestrata.functions.text import is_devanagari, word_count

    return _messages(spark, folder).filter("trim(text) <> ''").select(
        "conv_id", "turn", word_count(F.col("text")).alias("words"), is_devanagari(F.col("text")).alias("devanagari"),
    )


@query(
    "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS n_sessions, round(avg(length(text)), 6) AS avg_chars, CAST(max(length(text)) AS BIGINT) AS "
    "max_chars FROM conversations GROUP BY role"
)
def a2_store_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return _messages(spark, folder).groupBy("role").agg(
        F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_sessions"), F.round(F.avg(F.length("text")), 6).alias("avg_chars"),
        F.max(F.length("text")).cast("long").alias("max_chars"),
    )


@query(
    "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id % 2 = 0 UNION ALL SELECT conv_id, turn, role, text FROM conversations WHERE "
    "conv_id % 2 = 1 AND role <> 'system'"
)
def k16_appended_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of odd number are appended to the stored ones; their system turns are dropped."""
    m = _messages(spark, folder).select("conv_id", "turn", "role", "text")
    return appended(m.filter("conv_id % 2 = 0"), m.filter("conv_id % 2 = 1"))


@query(
    "WITH w AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS answer, max(turn) AS last FROM conversations GROUP BY conv_id) "
    "SELECT conv_id, answer, CAST(1 AS BIGINT) AS n_citations, CASE WHEN conv_id % 3 = 0 THEN 'error' WHEN conv_id % 3 = 1 THEN 'done' ELSE 'open' END AS state FROM w"
)
def r11_streamed_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as token events, with a citation and an end for each conversation; the answer is put together again."""
    m = _messages(spark, folder)
    tokens = m.select("conv_id", "turn", F.lit("token").alias("kind"), "text")
    ends = m.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).withColumn(
        "kind", F.when(F.col("conv_id") % 3 == 0, "error").when(F.col("conv_id") % 3 == 1, "done").otherwise("keepalive"),
    )
    cited = ends.withColumn("kind", F.lit("citation"))
    every = tokens.unionByName(ends.unionByName(cited).withColumn("text", F.lit(None).cast("string")))
    return answer_events(every, "conv_id", "turn", "kind", "text")
