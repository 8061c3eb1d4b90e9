"""Stored neighbours against those worked out from all edges, and probes as one search."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.vectors import normalised
from lodestrata.operators import adjacency, graph, search
from lodestrata.operators.adjacency import Adjacency, write_adjacency


def edges(spark, n=400, seed=2):
    """Both directions, repeats, ties, null scores, and a node that a third of all edges lead to."""
    r = random.Random(seed)
    rows = [("hub" if r.random() < 0.33 else f"n{r.randrange(40)}", f"n{r.randrange(60)}", r.choice(graph.TYPES), r.choice([None, 0.5, 0.5, round(r.random(), 3)])) for _ in range(n)]
    return spark.createDataFrame([*rows, *rows[:20]], "src string, dst string, type string, score double")


def anchors(spark):
    return spark.createDataFrame([(1, "hub"), (2, "n3"), (2, "n4"), (3, "nobody"), (4, None), (5, "n3"), (5, "n3")], "query_id int, node string")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).distinct().collect()), key=str)


def test_stored_lists_are_those_of_all_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(adjacency, "BUCKET_EDGES", 50)
    e, asked = edges(spark), anchors(spark)
    write_adjacency(e, str(tmp_path / "plain"))
    plain = Adjacency(spark, str(tmp_path / "plain"))
    columns = ["query_id", "node", "neighbour", "score"]
    for n, least in ((1, 0.0), (5, 0.4), (100, 0.0)):
        want = graph.neighbours(asked.distinct(), e, n, "score", least)
        assert rows(plain.neighbours(asked, n, least), *columns, "rank") == rows(want, *columns, "rank") != []
    write_adjacency(e, str(tmp_path / "typed"), "score", "type")
    typed = Adjacency(spark, str(tmp_path / "typed"))
    kinds = ["CONTRADICTS", "ELABORATES"]
    want = graph.neighbours(asked.distinct(), e.filter(F.col("type").isin(kinds)), 4)
    assert rows(typed.neighbours(asked, 4, 0.0, kinds), *columns, "rank") == rows(want, *columns, "rank")
    both = asked.distinct().join(graph.undirected(e, "score", ["type"]), "node")
    for kind, n in (("CONTRADICTS", 2), ("DEPENDS_ON", 7)):
        want = search.top_k(both.filter(F.col("type") == kind), ["query_id", "node", "type"], n, "neighbour")
        got = typed.by_kind(asked, {"CONTRADICTS": 2, "DEPENDS_ON": 7}).filter(F.col("kind") == kind)
        assert rows(got, *columns, "rank") == rows(want, *columns, "rank")


def test_only_asked_buckets_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(adjacency, "BUCKET_EDGES", 20)
    write_adjacency(edges(spark), str(tmp_path / "a"))
    stored = Adjacency(spark, str(tmp_path / "a"))
    plan = stored.neighbours(anchors(spark).filter("query_id = 1"), 3)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("\n")[0]
    assert stored.buckets > 8


def test_lists_are_kept_to_their_places(spark, tmp_path):
    write_adjacency(edges(spark), str(tmp_path / "a"), places=3)
    stored = Adjacency(spark, str(tmp_path / "a"))
    assert stored.rows.filter("node = 'hub'").count() == 3
    with pytest.raises(ValueError, match="3 neighbours"):
        stored.neighbours(anchors(spark), 4)
    write_adjacency(edges(spark).limit(0), str(tmp_path / "none"))
    assert Adjacency(spark, str(tmp_path / "none")).neighbours(anchors(spark), 3).count() == 0


def test_probes_are_one_search(spark, monkeypatch):
    r = random.Random(3)
    v = spark.createDataFrame([(f"c{i}", [r.gauss(0, 1) for _ in range(4)]) for i in range(80)], "chunk_id string, v array<double>").select("chunk_id", normalised(F.col("v")).alias("embedding"))
    sources = v.limit(7).select(F.col("chunk_id").alias("query_id"), "embedding")
    shift = lambda by: lambda e: F.transform(e, lambda x: x + by)
    forms = {"near": lambda e: e, "up": shift(0.2), "down": shift(-0.3)}
    got = graph.probe_hits(sources, v, forms, 6, 0.1)
    want = set()
    for o, (name, form) in enumerate(forms.items()):
        hits = search.knn(sources.select("query_id", form(F.col("embedding")).alias("embedding")), v, 6).filter("score >= 0.1")
        want |= {(h.query_id, name, o, h.chunk_id, h.score, h["rank"]) for h in hits.collect()}
    assert {(h.query_id, h.probe, h.o, h.chunk_id, h.score, h["rank"]) for h in got.collect()} == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    monkeypatch.setattr(search, "QUERY_BLOCK", 5)
    assert {(h.query_id, h.probe, h.o, h.chunk_id, h.score, h["rank"]) for h in graph.probe_hits(sources, v, forms, 6, 0.1).collect()} == want
