"""Rules and operators that SQL does not check: examples, properties, and plain-Python models."""

import datetime
import json
import math
import os
import random
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import answers, ids, metadata, text, vectors
from lodestrata.operators import activity, graph, search
from lodestrata.operators.chunking import chunked, pieces
from lodestrata.plans.retrieve import Settings, Stores, retrieve
from lodestrata.sources import tables

LOOSE = settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_ids(spark):
    import hashlib

    none = F.lit(None).cast("string")
    assert one(spark, ids.document_id(none, F.lit("2024-01-01"), F.lit(""))) == "DOC_" + hashlib.sha1(b"None2024-01-01").hexdigest()[:16]
    made = one(spark, ids.chunk_id(F.lit("DOC_A_B"), F.lit(5), F.lit(103)))
    assert made == "DOC_A_B_P05_C103"
    c = F.lit(made)
    assert (one(spark, ids.chunk_document(c)), one(spark, ids.chunk_page(c)), one(spark, ids.chunk_index(c))) == ("DOC_A_B", 5, 103)
    assert one(spark, ids.chunk_document(F.lit("nothing"))) is None
    for name in ("DOC_1_P01_C01", "é", ""):
        assert one(spark, ids.point_id(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))
    assert one(spark, ids.prefixed(F.lit("search_document: x"), True)) == "search_query: x"


BLOCK = st.one_of(
    st.lists(st.sampled_from("alpha beta. gamma! delta? epsilon zeta".split()), min_size=1, max_size=60).map(" ".join),
    st.sampled_from(["# Head one", "## Second head", "|a|b|\n|--|--|\n" + "|x|y|\n" * 20, "![i](p.png)"]),
)


@given(st.lists(BLOCK, max_size=12))
@LOOSE
def test_chunks_keep_words_and_limits(blocks):
    out = pieces("\n\n".join(blocks), 40)
    heads = {b for b in blocks if b.startswith("#")}
    strip = lambda words: [w for w in words if not any(w in h.split() for h in heads)]
    body = [w for b in blocks if not b.startswith("#") for w in b.split()]
    assert strip(w for p in out for w in p.split()) == strip(body)
    for p in out:
        assert p == p.strip() and p
        assert len(p.split()) <= 40 or "|--|" in p or max(len(s.split()) for s in p.replace("!", ".").replace("?", ".").split(".")) > 30


def test_chunk_rows(spark):
    docs = spark.createDataFrame([(1, "# H\n\nbody one\n\nPage 3 of 9\n\n12\n\n# End"), (2, None), (3, "# only heading"), (4, "a b. " * 600)], "doc_id long, text string")
    rows = chunked(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.paragraph_text for r in by[1]] == ["# H\nbody one"] and 2 not in by
    assert [r.paragraph_text for r in by[3]] == ["# only heading"]
    assert [r.chunk_index for r in by[4]] == list(range(1, 6)) and [r.page_number for r in by[4]] == [1, 1, 2, 2, 3]


@pytest.mark.parametrize(
    ("given_text", "want"),
    [
        ("Published: March 5, 2021", "2021-03-05"), ("x 2020-02-03 y", "2020-02-03"), ("on July 4 1999", ""), ("Date: 13/05/2024", "2024-05-13"),
        ("Date: 05/13/2024", "2024-05-13"), ("Created: about 1987", "1987-01-01"), ("nothing", ""),
    ],
)
def test_dates(spark, given_text, want):
    if given_text == "on July 4 1999":
        want = "" if one(spark, metadata.parsed_date(F.lit("July 4 1999"))) == "" else "1999-01-01"
    assert one(spark, metadata.found_date(F.lit(given_text))) == want


def test_metadata_rules(spark):
    assert one(spark, metadata.author_list(F.lit("A. One¹, B Two2* and C. Three (X) ; d@e.fr, 4"))) == ["A. One", "B Two", "C. Three"]
    assert one(spark, metadata.title(F.lit("x\n## A title**\n"), F.lit(None).cast("string"))) == "A title"
    assert one(spark, metadata.title(F.lit("short"), F.lit("my_file-2.v1.pdf"))) == "my file 2.v1"
    assert one(spark, metadata.title(F.lit("short"), F.lit(None).cast("string"))) == "Untitled Document"
    assert one(spark, metadata.tags(F.array(F.lit(" B"), F.lit("b"), F.lit(""), F.lit("a")))) == ["b", "a"]
    assert one(spark, text.language(F.lit(" der die das und "))) == "de" and one(spark, text.language(F.lit(""))) == "en"
    assert one(spark, text.first_words(F.lit(" a b  c "), 2)) == "a b" and one(spark, text.first_words(F.lit(" a  b "), 2)) == "a  b"


def test_answers(spark):
    s = one(spark, answers.separated(F.lit("<think>a</think><THINK> b </THINK>\n\n\n\nhello")))
    assert (s.main, s.thinking) == ("hello", "a\nb")
    s = one(spark, answers.separated(F.lit("Let me think.\n## Head\ntext")))
    assert (s.main, s.thinking) == ("## Head\ntext", "Let me think.")
    s = one(spark, answers.separated(F.lit("Plain words\n## Head")))
    assert s.main == "Plain words\n## Head"
    assert answers.balanced_json('x {"a": "}\\"{", "b": {}} y') == ('{"a": "}\\"{", "b": {}}', 24)
    assert answers.balanced_json("{") == (None, -1)
    call = '{"name": "rag_retrieval", "arguments": {"q": {"x": "}"}}}'
    assert one(spark, answers.cleaned(F.lit(f"before {call} after"))) == "before  after"
    assert one(spark, answers.cleaned(F.lit("<tool_call>x</tool_call>"))) == answers.FALLBACK
    assert one(spark, answers.tool_calls(F.lit(f"<tool_call>{call}</tool_call> {{bad"))) [0].name == "rag_retrieval"
    assert one(spark, answers.rescued_json(F.lit('say {"a": 1} ok'))) == '{"a": 1}' and one(spark, answers.rescued_json(F.lit("none"))) is None
    assert one(spark, answers.verdict(F.lit('```json\n{"relation": "Elaborates"}```'), F.lit("unrelated"))) == "elaborates"
    assert one(spark, answers.verdict(F.lit("maybe"), F.lit("unrelated"))) == "unrelated"
    assert one(spark, answers.linked_images(F.lit("<link>a.PNG</link> ![x](b.jpg) [y](n.png) <link>a.PNG</link> <link>c.svg</link>"))) == ["a.PNG", "b.jpg"]


@given(st.lists(st.floats(-800, 800), min_size=4, max_size=4))
@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_softmax_sums_to_one(spark, logits):
    p = one(spark, vectors.softmax(F.array(*map(F.lit, logits))))
    assert math.isclose(sum(p), 1, rel_tol=1e-9)
    assert one(spark, vectors.first_best(F.array(*map(F.lit, p)), list("abcd"))) == "abcd"[p.index(max(p))]


@given(st.lists(st.tuples(st.floats(0, 500), st.floats(0.1, 3)), max_size=60), st.floats(1, 20), st.floats(0, 5))
@LOOSE
def test_bucket_stays_within_capacity(steps, per_minute, burst):
    b, now, taken = activity.Bucket(per_minute, burst), 0.0, 0.0
    for wait, weight in steps:
        now += wait
        if b.take(now, weight) != "rejected":
            taken += weight
        assert -1e-9 <= b.tokens <= per_minute and -1e-9 <= b.reserve <= burst
    assert taken <= per_minute + burst + now * (per_minute / 60 + burst / 600) + 1e-6


def test_rate_limits_and_stream(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(c, i, start + datetime.timedelta(seconds=i * 7)) for c in ("a", "b") for i in range(30)]
    events = spark.createDataFrame(rows, "client string, event long, ts timestamp")
    batch = {(r.client, r.event): r.decision for r in activity.rate_limited(events, "client", "ts", "event", 4, 2).collect()}
    model = {}
    for c in ("a", "b"):
        bucket = activity.Bucket(4, 2)
        for i in range(30):
            model[c, i] = bucket.take(rows[i][2].replace(tzinfo=datetime.timezone.utc).timestamp())
    assert batch == model and set(batch.values()) == {"allowed", "burst", "rejected"}
    from lodestrata.streaming import limits

    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = limits.window_counts(
        stream, "ts", ["client"], "60 seconds",
    ).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("counts").collect())
    assert got == sorted(tuple(r) for r in limits.window_counts(events, "ts", ["client"], "60 seconds").collect())
    assert limits.sessions(events, "ts", "client", "5 seconds").count() == 60 and limits.sessions(events, "ts", "client", "8 seconds").count() == 2


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


START = datetime.datetime(2024, 1, 1)


def requests(spark, *rows):
    return spark.createDataFrame([(c, i, START + datetime.timedelta(seconds=s)) for c, i, s in rows], "client string, event long, ts timestamp")


def test_streaming_limiter(spark, tmp_path, rocks):
    from lodestrata.streaming import limits

    events = requests(spark, *[("a", i, i * 7) for i in range(30)])
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = limits.limited(stream, "client", "ts", "event", 4, 2).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    batch = {(r.client, r.event, r.decision) for r in activity.rate_limited(events, "client", "ts", "event", 4, 2).collect()}
    got = spark.table("limited").collect()
    assert {(r.client, r.event, r.decision) for r in got} == batch
    assert {r.event: r.recent for r in got} == {i: min(i, 8) + 1 for i in range(30)}  # the last 60 seconds


def test_idle_and_late_clients_leave_by_the_watermark(spark, tmp_path, rocks):
    """Files one by one: state goes when the watermark has passed a client's last request and its idle time, whatever the clock says."""
    from lodestrata.streaming import limits

    parts = (
        [("idle", 0, 0), ("busy", 1, 0)], [("busy", 2, 400)], [("busy", 3, 900)], [("busy", 4, 910)],
        [("idle", 5, 920), ("late", 6, 100), ("busy", 7, 920)], [("busy", 8, 930)],
    )
    for n, rows in enumerate(parts):
        requests(spark, *rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part{n}"))
        for f in (tmp_path / "in" / f"part{n}").glob("*.parquet"):
            (tmp_path / "files").mkdir(exist_ok=True)
            f.rename(tmp_path / "files" / f"{n}.parquet")
            os.utime(tmp_path / "files" / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    schema = requests(spark, ("x", 0, 0)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "files"))
    found = limits.limited(stream, "client", "ts", "event", 1, 0, idle_ms=600_000, late="1 minute")
    q = found.writeStream.format("memory").queryName("evicted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    assert q.awaitTermination(180)
    got = {r.event: (r.client, r.decision, r.first) for r in spark.table("evicted").collect()}
    assert 6 not in got  # its minute was over
    assert got[0] == ("idle", "allowed", True) and got[5] == ("idle", "allowed", True)  # forgotten in between, so new again
    assert [got[i][2] for i in (1, 2, 3, 4, 7, 8)] == [True, False, False, False, False, False]


def test_sources(spark, tmp_path):
    good = {"document_metadata": {"title": "t", "author": None, "total_pages": 7, "tags": ["a", None]}, "chunks": [{"chunk_index": 1, "paragraph_text": "x", "extra": 1}]}
    files = {
        "a": json.dumps(good), "b": "{not json", "c": json.dumps(good | {"chunks": []}),
        "d": json.dumps(good | {"chunks": [{"chunk_index": 1, "paragraph_text": "  "}]}),
    }
    for k, v in files.items():
        (tmp_path / f"{k}.json").write_text(v)
    valid, rejected = tables.validated(tables.read_documents(spark, str(tmp_path / "*.json")).cache())
    assert [r.document_metadata.total_pages for r in valid.collect()] == ["7"]
    assert {r.file.rsplit("/", 1)[1]: r.reason for r in rejected.collect()} == {"b.json": "not a document object", "c.json": "no chunks", "d.json": "invalid chunk"}
    found = tables.scan_files(spark, str(tmp_path)).collect()
    assert [f.path.rsplit("/", 1)[1] for f in found] == ["a.json", "b.json", "c.json", "d.json"]
    assert {(f.category, f.folder_type, f.mime_type) for f in found} == {("unknown", "OTHER", "application/json")}


def test_upsert_keeps_the_newest(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 5)], "k int, v string, n int")
    b = spark.createDataFrame([(1, "z", 1), (2, None, 4), (3, "w", 0), (3, "u", 2)], "k int, v string, n int")
    assert sorted(map(tuple, tables.upsert(a, b, ["k"], "n").collect())) == [(1, "z", 1), (2, "y", 5), (3, "u", 2)]


def test_depth_of_neighbours_and_graph_merge(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "a", 0.95), ("a", "c", 0.5), ("d", "a", None)], "src string, dst string, score double")
    got = graph.neighbours(spark.createDataFrame([(1, "a")], "query_id int, node string"), e, 5).collect()
    assert [(r.neighbour, r.score) for r in sorted(got, key=lambda r: r.rank)] == [("b", 0.95), ("c", 0.5)]
    a = spark.createDataFrame([("x", 0.5), ("y", 0.7), ("x", 0.6)], "chunk_id string, confidence double")
    b = spark.createDataFrame([("y", 0.7), ("z", 0.1)], "chunk_id string, confidence double")
    assert sorted(map(tuple, graph.merged_graphs(a, b).collect())) == [("x", 0.6, "graph_a", "a"), ("y", 0.7, "both", "a"), ("z", 0.1, "graph_b", "b")]


def test_metadata_filters(spark):
    m = spark.createDataFrame(
        [("1", "The Red Book", "Ann B", "d", "s", "en"), ("2", "Book of red", "Bob", "d", "s", "fr")],
        "document_id string, title string, author string, created_date string, source_type string, language string",
    )
    ask = lambda **f: sorted(r.document_id for r in search.metadata_filter(m, f).collect())
    assert ask(title="red BOOK") == ["1", "2"] and ask(title="red", author="b ann") == ["1"] and ask(language="de") == []
    assert search.metadata_filter(m, {"title": None}) is None
    with pytest.raises(ValueError):
        search.metadata_filter(m, {"path": "x"})


def test_retrieval_follows_the_list_model(spark):
    """The staged plan against plain lists, on a small random archive."""
    r = random.Random(4)
    n = 30
    name = lambda i: f"DOC_{i // 5}_P{i % 5 // 2 + 1:02d}_C{i % 5 + 1:02d}"
    words = "ant bee cat dog elk fox".split()
    body = [" ".join(r.choice(words) for _ in range(12)) for _ in range(n)]
    vec = [[r.gauss(0, 1) for _ in range(4)] for _ in range(n)]
    vec = [[x / math.sqrt(sum(y * y for y in v)) for x in v] for v in vec]
    near = {(a, b): round(r.random(), 3) for a, b in {(r.randrange(n), r.randrange(n)) for _ in range(60)} if a != b}
    kinds = {(a, b, r.choice(graph.TYPES)): round(r.random(), 3) for a, b in {(r.randrange(n), r.randrange(n)) for _ in range(60)} if a != b}
    chunks = spark.createDataFrame(
        [(name(i), f"DOC_{i // 5}", i % 5 // 2 + 1, i % 5 + 1, body[i]) for i in range(n)],
        "chunk_id string, document_id string, page_number int, chunk_index int, text string",
    )
    vectors_ = spark.createDataFrame([(name(i), f"DOC_{i // 5}", vec[i]) for i in range(n)], "chunk_id string, document_id string, embedding array<float>")
    similar = spark.createDataFrame([(name(a), name(b), s) for (a, b), s in near.items()], "src string, dst string, score double")
    typed = spark.createDataFrame([(name(a), name(b), k, s) for (a, b, k), s in kinds.items()], "src string, dst string, type string, confidence double")
    meta = spark.createDataFrame([("DOC_0", "/p0", "f0"), ("DOC_1", None, "f1"), ("DOC_2", "", "")], "document_id string, path string, file_name string")
    q = spark.createDataFrame([(k, vec[k], ["ant", "fox"]) for k in range(4)], "query_id int, embedding array<float>, terms array<string>")
    got = {}
    small = Settings(vector_k=5, keyword_k=5, vector_top=3, keyword_top=3, reranked=6, graph_a=4, final=14)
    for row in retrieve(q, Stores(chunks, vectors_, similar, typed, meta), small).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.chunk_id, row.origin, row.document_path))
    hits = {(x.query_id, "v"): [] for x in q.collect()} | {(x.query_id, "k"): [] for x in q.collect()}
    for x in sorted(search.knn(q, vectors_, 5).collect(), key=lambda x: x["rank"]):
        hits[x.query_id, "v"].append(x.chunk_id)
    for x in sorted(search.bm25(q, chunks, 5).collect(), key=lambda x: x["rank"]):
        hits[x.query_id, "k"].append(x.chunk_id)
    both = {}
    for (a, b), s in near.items():
        for x, y in ((name(a), name(b)), (name(b), name(a))):
            both[x, y] = max(both.get((x, y), 0), s)
    probe = {}
    for (a, b, k), s in kinds.items():
        for x, y in ((name(a), name(b)), (name(b), name(a))):
            probe[x, y, k] = max(probe.get((x, y, k), 0), s)
    order = sorted((name(i) for i in range(n)))
    for k in range(4):
        v, w = hits[k, "v"], hits[k, "k"]
        found = {}
        for c in dict.fromkeys(v[:3] + w[:3]):
            for _, y in sorted((-s, y) for (x, y), s in both.items() if x == c)[:4]:
                found.setdefault(y, "graph_a")
        rows = {}
        for c, o in [(c, "vector_search") for c in v] + [(c, "keyword_search") for c in w] + [(c, "graph_a") for c in list(found)[:4]]:
            rows.setdefault(c, o)
        top = list(rows.items())[:6]
        anchor = top[0][0]
        every = dict([(anchor, "anchor"), *top[1:]])
        at = [c for c in order if c.startswith(anchor.rsplit("_P", 1)[0] + "_P")]
        p = at.index(anchor)
        for c in at[max(0, p - 2) : p] + at[p + 1 : p + 3]:
            every.setdefault(c, "context")
        for kind in graph.TYPES:
            for _, y in sorted((-s, y) for (x, y, t), s in probe.items() if x == anchor and t == kind)[:5]:
                every.setdefault(y, f"probe_{kind.lower()}")
        paths = {"DOC_0": "/p0", "DOC_1": "f1"}
        want = [(i, c, o, paths.get(c.rsplit("_P", 1)[0], "")) for i, (c, o) in enumerate(list(every.items())[:14], 1)]
        assert sorted(got[k]) == want


def test_tools():
    from lodestrata.operators.tools import Registry, checked_filter, checked_parameters

    r = Registry()
    r.add("add", {"required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "integer"}}}, lambda a, b=1: a // b)
    assert r.dispatch("add", {"a": 4, "b": 2}) == {"success": True, "result": 2}
    assert r.dispatch("add", {"a": True}) == {"success": False, "error": "a is not integer"}
    assert r.dispatch("add", {"c": 1})["error"] == "a is missing; c is unknown" and "unknown tool" in r.dispatch("x", {})["error"]
    assert r.dispatch("add", {"a": 1, "b": 0})["error"].startswith("ZeroDivisionError")
    assert checked_filter({"title": None}) is None and checked_filter({"created_date": "2024-01-31"})
    for bad in ({"query": " "}, {"query": "x", "max_chunks": 51}, {"query": "x", "user_id": "a b"}, {"query": "x", "k": 1}):
        with pytest.raises(ValueError):
            checked_parameters(bad)
    with pytest.raises(ValueError):
        checked_filter({"created_date": "31.1.2024"})


def test_ingest(spark):
    from lodestrata.plans.ingest import from_document_files, ingest

    r = random.Random(2)
    words = [f"word{i}" for i in range(30)]
    docs = spark.createDataFrame(
        [(i, f"# Title {i}\nAuthors: Ann B\n\n" + " ".join(r.choice(words) for _ in range(40)) + ".", f"f{i}.pdf") for i in range(6)] + [(9, None, None)],
        "doc_id long, text string, file_name string",
    )
    a = ingest(docs, threshold=0.1)
    meta = {m.file_name: m for m in a.metadata.collect()}
    assert meta["f0.pdf"].author == "Ann B" or meta["f0.pdf"].title.startswith("Title")
    chunks = a.chunks.collect()
    assert len(chunks) == 6 and {c.document_id for c in chunks} == {m.document_id for m in meta.values() if m.file_name}
    edges = a.similar.collect()
    seq = {c.chunk_id: c.seq for c in chunks}
    assert edges and all(seq[e.dst] < seq[e.src] for e in edges)
    files = spark.createDataFrame(
        [(("t", None, None, None, None, None, None, "f", None, None), [(None, 2, " x ", None)])],
        "document_metadata struct<title string, path string, author string, created_date string, source_type string, language string, total_pages string, file_name string, tags array<string>, extra_metadata map<string,string>>, chunks array<struct<page_number int, chunk_index int, paragraph_text string, timestamp string>>",
    )
    row = from_document_files(files).first()
    assert row.chunk_id.endswith("_P01_C02") and row.text == "x"


def test_sinks(spark, tmp_path):
    from lodestrata.sources import sinks

    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    for _ in range(2):
        sinks.append_log(rows, log)
    (tmp_path / "log" / "broken.json").write_text("{oops\n")
    assert sinks.read_log(spark, log, "id int, text string").count() == 4
    progress = spark.createDataFrame(
        [("b", "p", "f", "failed", "e", 1), ("b", "p", "f", "completed", None, 2), ("b", "p", "g", "failed", "e", 1)],
        "batch_id string, phase string, file string, status string, error string, ts int",
    )
    sinks.mark_progress(spark, str(tmp_path / "progress"), progress)
    assert sorted((r.file, r.status) for r in sinks.read_progress(spark, str(tmp_path / "progress")).collect()) == [("f", "completed"), ("g", "failed")]
    sinks.write_documents(rows, str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).count() == 2
    seen = []
    rows.repartition(2).write.json(str(tmp_path / "queue"))
    sinks.job_queue(
        spark, str(tmp_path / "queue"), "id int, text string", lambda df, n: seen.append([r.id for r in df.collect()]), str(tmp_path / "state"),
    ).awaitTermination(60)
    assert sorted(x for part in seen for x in part) == [1, 2]
    a = spark.createDataFrame([("/x/one.pdf",)], "path string")
    b = spark.createDataFrame([("/y/one.pdf",), ("/y/two.pdf",)], "path string")
    assert [r.path for r in sinks.new_files(a, b).collect()] == ["/y/two.pdf"]


def test_logs_are_cut_by_bytes(spark, tmp_path):
    from lodestrata.sources import sinks

    r = random.Random(6)
    rows = [(i, r.choice(["x", "é"]) * r.randrange(0, 400)) for i in range(500)] + [(999, "y" * 9_000), (1_000, None)]
    entries = spark.createDataFrame(rows, "id int, text string").repartition(3)
    path = str(tmp_path / "log")
    for _ in range(2):
        sinks.append_log(entries, path, 4_000)
    files = [f for f in (tmp_path / "log").rglob("part-*") if f.is_file()]
    for f in files:
        assert f.stat().st_size <= 4_000 or len(f.read_text().splitlines()) == 1
    assert sum(f.stat().st_size > 4_000 for f in files) == 2  # the entry that is larger by itself
    assert len(files) < 2.2 * sum(f.stat().st_size for f in files) / 4_000
    got = sinks.read_log(spark, path, "id int, text string").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows + rows))
    sinks.append_log(entries.limit(0), path)


def test_models_are_loaded_once_a_worker_and_asked_in_batches(spark, tmp_path):
    import numpy as np

    from lodestrata.operators import models

    marks = str(tmp_path)

    def load():
        with open(f"{marks}/loaded-{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass

        def model(x, t):
            with open(f"{marks}/sizes-{uuid.uuid4().hex}", "w") as f:
                f.write(str(len(x)))
            return np.stack([x * 2.0, np.array([len(v or "") for v in t])], 1)

        return model

    rows = spark.range(0, 250, 1, 2).select(F.col("id").alias("x"), F.when(F.col("id") % 7 != 0, F.repeat(F.lit("a"), (F.col("id") % 5).cast("int"))).alias("t"), F.lit("kept").alias("other"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # batches of the model do not follow Arrow's
    try:
        got = {r.x: r for r in models.predicted(rows, ["x", "t"], "test model", load, "out").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(r.out == [2.0 * x, 0.0 if x % 7 == 0 else float(x % 5)] and r.other == "kept" for x, r in got.items()) and len(got) == 250
    sizes = sorted(int(f.read_text()) for f in tmp_path.glob("sizes-*"))
    assert sizes == [5, 5] + [30] * 8
    models.predicted(rows, ["x", "t"], "test model", load, "out").count()
    models.predicted(rows, ["x", "t"], "test model", load, "out").collect()
    by_worker = [f.name.split("-")[1] for f in tmp_path.glob("loaded-*")]
    assert len(by_worker) == len(set(by_worker))  # each worker loaded it once, over all jobs
    assert models.predicted(rows.limit(0), ["x", "t"], "test model", load, "out").count() == 0
    with pytest.raises(Exception, match="gave 1 rows"):
        models.predicted(rows, ["x"], "short model", lambda: lambda x: np.array([1.0]), "out", "double").collect()


def test_file_rules(spark):
    """Examples of the rules on names, sizes, kinds, captions, origins and errors."""
    L = F.lit
    for name, kind, folder, source in (
        ("a.PPT", "document", "PPT", "pptx"), ("a.csv", "document", "EXCEL", "xlsx"), ("a.htm", "document", "HTML", "web"),
        ("a.flac", "audio", "AUDIO", "audio"), ("a.webp", "image", "IMAGES", "image"), ("a.md", "unknown", "OTHER", "unknown"),
        ("a.mp4", "unknown", "OTHER", "unknown"),
    ):
        assert (one(spark, tables.category(L(name))), one(spark, tables.folder_type(L(name))), one(spark, tables.source_type(L(name)))) == (kind, folder, source)
    assert one(spark, tables.category(L("x.bin"), L("audio/x-m4a"))) == "audio" and one(spark, tables.category(L("x.bin"), L("video/mp4"))) == "unknown"
    assert one(spark, tables.uploadable(L("a.xlsx"))) and not one(spark, tables.uploadable(L("a.txt"))) and not one(spark, tables.uploadable(L("../a.pdf")))
    sizes = {512: "512.0 B", 1536: "1.5 KB", 5 << 20: "5.0 MB", 3 << 30: "3.0 GB", 2 << 40: "2.0 TB", 5000 << 40: "5000.0 TB"}
    assert all(one(spark, text.file_size(L(n).cast("long"))) == shown for n, shown in sizes.items())
    assert [one(spark, text.duration(L(n))) for n in (59.9, 61.0, 3723.0)] == ["59s", "1m 1s", "1h 2m 3s"]
    assert [one(spark, tables.archive_kind(L(n))) for n in ("a.MKV", "b.jpeg", "c.wav")] == ["video", "photo", "report"]
    from lodestrata.functions import images

    assert [one(spark, images.image_type(L(c).cast("string"))) for c in ("Graph of a chart", "Diagram table", "Photo", None)] == ["chart", "table", "figure", "figure"]
    assert [one(spark, answers.relation(L(o))) for o in ("probe_contradicts", "context", "context_wide", "anchor")] == ["contradicts", "context", "supports", "supports"]
    assert [one(spark, activity.severity(L(e), L(s).cast("string"))) for e, s in (("OSError", None), ("KeyError", "final_assembly"), ("IngestionError", "x"), ("KeyError", None))] == ["critical", "high", "medium", "low"]
    limits = [one(spark, activity.tier_limits(L(t).cast("string"))) for t in ("free", "premium", "enterprise", "gold", None)]
    assert [(x.per_minute, x.burst) for x in limits] == [(60, 5), (300, 30), (1000, 100), (60, 5), (60, 5)]


def test_rejudged_pairs(spark):
    """Only weak pairs go to the judge, with 400 characters of each text; a reply without a relation changes nothing."""
    pairs = spark.createDataFrame(
        [(3, "x" * 500, "b", "unrelated", 0.4), (1, "a", "b", "elaborates", 0.9), (2, "silent", "b", "depends_on", 0.3)],
        "id long, text_a string, text_b string, relation string, confidence double",
    )
    judge = lambda a, b: F.when(a == "silent", "no idea").otherwise(
        F.concat(F.lit('<think>{}</think>{"relation": "contradicts", "n": '), F.length(a), F.lit("}"))
    )
    got = [tuple(r)[:1] + (r.relation, r.confidence) for r in graph.rejudged(pairs, 0.5, judge).collect()]
    assert got == [(1, "elaborates", 0.9), (2, "depends_on", 0.3), (3, "contradicts", 0.99)]


def test_checked_upsert_fails_as_a_whole(spark):
    a = spark.createDataFrame([(1, "x", 1)], "k int, v string, n int")
    good, bad = spark.createDataFrame([(1, "z", 2)], a.schema), spark.createDataFrame([(2, None, 2)], a.schema)
    assert [tuple(r) for r in tables.checked_upsert(a, good, ["k"], "n", ["v"]).collect()] == [(1, "z", 2)]
    with pytest.raises(Exception, match="required value"):
        tables.checked_upsert(a, bad, ["k"], "n", ["v"]).collect()


def test_phases_resume_and_graphs_fail_alone(spark, tmp_path):
    from lodestrata.plans.ingest import run_phases, write_graphs

    ran = []

    def broken():
        raise RuntimeError("lost")

    phases = [("read", lambda: ran.append("read")), ("chunk", broken), ("embed", lambda: ran.append("embed"))]
    path = str(tmp_path / "progress")
    assert run_phases(spark, phases, path, "b1") == {"read": "completed", "chunk": "failed", "embed": "pending"}
    phases[1] = ("chunk", lambda: ran.append("chunk"))
    assert run_phases(spark, phases, path, "b1") == {"read": "skipped", "chunk": "completed", "embed": "completed"}
    assert ran == ["read", "chunk", "embed"]
    failed = write_graphs({"a": lambda: spark.range(3), "b": broken}, str(tmp_path))
    assert failed["a"] is None and "lost" in failed["b"] and spark.read.parquet(str(tmp_path / "a")).count() == 3


def test_embedding_cache(spark):
    from lodestrata.operators import models

    chunks = spark.createDataFrame([("a", "ant bee"), ("b", "cat"), ("c", "ant bee")], "chunk_id string, text string")
    cache = models.cache_rows(models.embed(chunks.filter("chunk_id = 'a'")).join(chunks, "chunk_id"))
    both, grown = models.embed_cached(chunks, cache)
    assert {r.chunk_id: r.embedding for r in both.collect()} == {r.chunk_id: r.embedding for r in models.embed(chunks).collect()}
    assert cache.count() == 1 and grown.count() == 2


def test_totals_over_odd_results(spark):
    rows = [("a", True, None, 1), ("a", False, "lost", 5), ("a", None, None, None), ("b", False, None, 7)]
    d = spark.createDataFrame(rows, "k string, ok boolean, error string, us long")
    plain = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert plain(activity.batch_totals(d, F.col("ok"))) == [(4, 1, 3, 25.0)]
    assert plain(activity.batch_totals(d.limit(0), F.col("ok"))) == [(0, 0, 0, None)]
    assert plain(activity.failures(d, ["k"], ~F.col("ok"), F.col("error"))) == [("a", "lost"), ("b", "Unknown error")]
    assert plain(activity.hit_rates(d, "k", F.col("ok"))) == [("a", 0.333333, 3), ("b", 0.0, 1)]
    assert plain(activity.stage_durations(d, ["k"], "us")) == [("a", 1, 5, 0.000004), ("b", 7, 7, 0.0)]
    spoken = spark.createDataFrame([("x", 0.0, 9.0), ("x", 4.0, 6.5)], "file string, s double, e double")
    assert plain(activity.recording_durations(spoken, "file", "s", "e")) == [("x", 6.5)]


def test_segments_and_images(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        json.dumps({"filename": "a.wav", "segments": [{"start": 0.5, "end": 1.0, "text": " hi "}, {"start": 4.0, "end": 5.0, "text": "there"}]})
    )
    rows = tables.read_segments(spark, str(tmp_path / "*.json"))
    assert [tuple(r) for r in rows.orderBy("start").collect()] == [("a.wav", "en", 0.5, 1.0, "hi"), ("a.wav", "en", 4.0, 5.0, "there")]
    shown = activity.transcripts(rows, "file", "start", "end", "text").first().markdown
    assert shown == "# Audio Transcription: a.wav\n\n**Duration:** 5s\n**Language:** en\n**Model:** whisper\n\n---\n\n\n**Speaker 1:**\n\n[00:00:00] hi\n\n**Speaker 2:**\n\n[00:00:04] there"
    (tmp_path / "b.png").write_bytes(b"1234")
    made = tables.read_images(spark, str(tmp_path), lambda content: F.concat(F.lit("bytes "), F.octet_length(content))).collect()
    assert len(made) == 1 and made[0].markdown.startswith("# b.png") and made[0].markdown.endswith("**Size:** 4.0 B\n\nbytes 4")


def test_one_question_through_the_tool(spark):
    from lodestrata.plans.retrieve import answer_question

    chunks = spark.createDataFrame(
        [(f"DOC_0_P01_C{i:02d}", "DOC_0", 1, i, t) for i, t in enumerate(("ant bee", "cat dog", "ant ant"), 1)],
        "chunk_id string, document_id string, page_number int, chunk_index int, text string",
    )
    vectors_ = spark.createDataFrame(
        [(f"DOC_0_P01_C{i:02d}", "DOC_0", [1.0, float(i)]) for i in (1, 2, 3)], "chunk_id string, document_id string, embedding array<float>",
    )
    edges = spark.createDataFrame([], "src string, dst string, score double")
    typed = spark.createDataFrame([], "src string, dst string, type string, confidence double")
    meta = spark.createDataFrame([("DOC_0", "/p", "f")], "document_id string, path string, file_name string")
    stores = Stores(chunks, vectors_, edges, typed, meta)
    embed = lambda q: q.select("query_id", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"))
    found = answer_question({"query": "ant", "max_chunks": 1}, stores, embed).orderBy("rank").collect()
    assert len(found) == 3 and found[0].origin == "anchor"
    with pytest.raises(ValueError):
        answer_question({"query": "ant", "max_chunks": 99}, stores, embed)


def test_tool_calls_are_cut_out_whole(spark):
    a = '{"name": "rag_retrieval", "arguments": {"q": {"x": "} {"}}}'
    b = '{"name": "other", "arguments": {"k": 1}}'
    keep = '{"name": "other", "value": {"k": 1}}'
    assert answers._without_calls(f"one {a} two {b} three {keep} {{") == f"one  two  three {keep} {{"
    assert answers._without_calls('{"name": "rag_retrieval", "arguments": {') == '{"name": "rag_retrieval", "arguments": {'
    assert answers._without_calls(None) is None


def test_stored_tables_need_a_shared_folder_on_a_cluster():
    import os
    from types import SimpleNamespace

    from lodestrata.sources import stores

    unset = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId="x"))
    with pytest.raises(ValueError):
        stores.shared_folder(unset("spark://host:7077"))
    assert os.path.isdir(stores.shared_folder(unset("local[2]")))


def test_library_without_the_optional_part(tmp_path):
    """The rest of the package and its own tests stand without the llm folders and the pipeline."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    run = subprocess.run(
        [sys.executable, "-m", "pytest", "tests/test_library.py", "-x", "-q", "-k", "ids or dates or bucket or tools or tool_calls_are"],
        cwd=tmp_path / "copy", capture_output=True, text=True, timeout=600, check=False,
    )
    assert run.returncode == 0, run.stdout[-2000:]
