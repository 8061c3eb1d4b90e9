"""Impact-ordered postings against the search that counts all texts."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import impacts, search
from lodestrata.operators.impacts import Keywords, write_impacts
from lodestrata.plans.retrieve import Settings, Stores, retrieve


def corpus(spark, n=600, seed=3):
    """Frequent and rare words, one word in a third of all texts very often, copies, empty and null texts, ties."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = []
    for i in range(n):
        text = " ".join(r.choices(words, weights, k=r.randrange(3, 60)))
        rows.append((f"c{i:04}", text + " hot" * (i % 7 + 1) if i % 3 == 0 else text))
    rows += [(f"d{i:04}", rows[5][1]) for i in range(30)] + [("e1", ""), ("e2", None), ("e3", "!!!"), ("e4", "lonely")]
    return spark.createDataFrame(rows, "chunk_id string, text string").repartition(3)


def questions(spark):
    rows = [(1, ["w0", "w1", "w2"]), (2, ["hot", "w7"]), (3, ["lonely"]), (4, ["w250", "w0", "hot", "w13"]), (5, []), (6, None), (7, ["nowhere"]), (8, ["w3", "w3", "w40"])]
    return spark.createDataFrame(rows, "query_id int, terms array<string>")


def hits(rows):
    return {(r.query_id, r.chunk_id, r.score, r.rank) for r in rows.collect()}


@pytest.mark.parametrize("block", [4, 128])
def test_the_best_are_those_of_the_whole_search(spark, tmp_path, block):
    texts, asked = corpus(spark), questions(spark)
    write_impacts(texts, str(tmp_path / "k"), block=block)
    store = Keywords(spark, str(tmp_path / "k"))
    for k in (1, 12, 1000):
        assert hits(store.search(asked, k)) == hits(search.bm25(asked, texts, k))
    counted = search.postings(texts).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    assert {tuple(r) for r in store.statistics().collect()} == {tuple(r) for r in counted.collect()}


def test_many_questions_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    texts, asked = corpus(spark, 100), questions(spark)
    write_impacts(texts, str(tmp_path / "k"), block=8)
    assert hits(Keywords(spark, str(tmp_path / "k")).search(asked, 5)) == hits(search.bm25(asked, texts, 5))


def test_blocks_fall_in_impact_and_are_skipped(spark, tmp_path):
    r = random.Random(1)
    rows = [(f"c{i:05}", " ".join(["the"] * r.choice([1, 1, 1, 2, 9]) + [f"w{r.randrange(4000)}" for _ in range(r.randrange(4, 40))])) for i in range(4_000)]
    texts = spark.createDataFrame(rows, "chunk_id string, text string")
    write_impacts(texts, str(tmp_path / "k"), block=16)
    store = Keywords(spark, str(tmp_path / "k"))
    blocks = store.blocks.filter("term = 'the'").orderBy("at").collect()
    assert [b.at for b in blocks] == list(range(len(blocks))) and sum(len(b.chunk_ids) for b in blocks) == 4_000
    assert all(a.most >= b.most for a, b in zip(blocks, blocks[1:], strict=False))
    asked = spark.createDataFrame([(1, ["the", "w1", "w2"]), (2, ["the"])], "query_id int, terms array<string>")
    one = asked.filter("query_id = 1")
    assert hits(store.search(asked)) == hits(search.bm25(asked, texts))
    read = {r.term: (r.df, r.read) for r in store.reading(one).collect()}
    assert read["the"][0] == 4_000 and read["the"][1] <= 16  # the frequent word's list is not read beyond its first block
    assert read["w1"][0] == read["w1"][1]
    alone = store.reading(asked.filter("query_id = 2")).first()
    assert alone.read < alone.df


def test_empty_stores(spark, tmp_path):
    for name, rows in (("a", []), ("b", [("x", None), ("y", "")])):
        write_impacts(spark.createDataFrame(rows, "chunk_id string, text string"), str(tmp_path / name))
        store = Keywords(spark, str(tmp_path / name))
        assert store.search(questions(spark)).collect() == [] and store.statistics().collect() == [] and store.reading(questions(spark)).collect() == []


def test_a_list_goes_on_over_batches():
    import pyarrow as pa

    term, most = ["a"] * 5 + ["b"] * 2, [9.0, 8, 7, 6, 5, 3, 2]
    rows = [pa.array([0] * 7, pa.int32()), pa.array([0] * 7, pa.int32()), pa.array(term), pa.array(most), pa.array([f"c{i}" for i in range(7)]), pa.array([1] * 7), pa.array([2] * 7)]
    whole = pa.RecordBatch.from_arrays(rows, names=["bucket", "share", "term", "impact", "chunk_ids", "tf", "dl"])
    for cuts in ([7], [3, 4], [1, 1, 5], [5, 2], [6, 1]):
        parts, at = [], 0
        for c in cuts:
            parts.append(whole.slice(at, c))
            at += c
        got = pa.Table.from_batches(impacts._cut(2)(iter(parts))).to_pylist()
        assert [c for g in got for c in g["chunk_ids"]] == [f"c{i}" for i in range(7)]
        for t in "ab":
            own = [g for g in got if g["term"] == t]
            assert [g["at"] for g in own] == list(range(len(own))) and [g["most"] for g in own] == [most[int(g["chunk_ids"][0][1:])] for g in own]
            assert all(len(g["chunk_ids"]) <= 2 for g in own)


def test_retrieval_with_and_without_stored_postings(spark, tmp_path):
    names = lambda i: f"DOC_{i // 5}_P01_C{i % 5 + 1:02d}"
    texts = [r.text for r in corpus(spark, 60).orderBy("chunk_id").collect()]
    chunks = spark.createDataFrame([(names(i), f"DOC_{i // 5}", 1, i % 5 + 1, t) for i, t in enumerate(texts)], "chunk_id string, document_id string, page_number int, chunk_index int, text string")
    vectors = spark.createDataFrame([(names(i), f"DOC_{i // 5}", [1.0, float(i)]) for i in range(60)], "chunk_id string, document_id string, embedding array<float>")
    similar = spark.createDataFrame([(names(3), names(9), 0.8)], "src string, dst string, score double")
    typed = spark.createDataFrame([(names(59), names(9), "ELABORATES", 0.8)], "src string, dst string, type string, confidence double")
    meta = spark.createDataFrame([("DOC_0", "/p0", "f0")], "document_id string, path string, file_name string")
    asked = questions(spark).withColumn("embedding", F.array(F.lit(0.0), F.lit(1.0)))
    write_impacts(chunks.select("chunk_id", "text"), str(tmp_path / "k"))
    few = Settings(vector_k=3)
    with_ = retrieve(asked, Stores(chunks, vectors, similar, typed, meta, Keywords(spark, str(tmp_path / "k"))), few).collect()
    without = retrieve(asked, Stores(chunks, vectors, similar, typed, meta), few).collect()
    assert sorted(map(str, with_)) == sorted(map(str, without)) and any(r.origin == "keyword_search" for r in with_)


WORDS = {
    "Don't panic": ["don't", "panic"],
    "pi is 3.14, not 1,000.5": ["pi", "is", "3.14", "not", "1,000.5"],
    "foo_bar _x __ a-b": ["foo_bar", "_x", "a", "b"],
    "U.S.A. e.g. end.Start": ["u.s.a", "e.g", "end.start"],
    "user@example.com http://x.org/a": ["user", "example.com", "http", "x.org", "a"],
    "漢字ひら カタカナー 한국어": ["漢", "字", "ひ", "ら", "カタカナー", "한국어"],
    "a1 1a 1.a a.1": ["a1", "1a", "1", "a", "a", "1"],
    "it’s naïve café STRASSE": ["it’s", "naïve", "café", "strasse"],
    "x" * 600: ["x" * 255, "x" * 255, "x" * 90],
    "'quoted' \"text\" -- 🎉": ["quoted", "text"],
    "": [],
}


def test_words_follow_the_published_boundaries(spark):
    from lodestrata.functions.text import tokens

    got = spark.createDataFrame([(k,) for k in WORDS], "t string").select("t", tokens(F.col("t")).alias("w")).collect()
    assert {r.t: r.w for r in got} == WORDS
    assert spark.createDataFrame([(None,)], "t string").select(tokens(F.col("t")).alias("w")).first().w is None


def test_words_of_long_runs(spark):
    from lodestrata.functions.text import tokens

    for text in ("aB3." * 50_000, "a." * 100_000, "1," * 50_000, "_" * 100_000 + "a", "'" * 100_000):
        got = spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t")).alias("w")).first().w
        assert sum(map(len, got)) <= len(text) and all(w for w in got)
