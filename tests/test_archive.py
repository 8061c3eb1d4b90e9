"""The vector index and archives that grow by batches, against exact search and against one batch."""

import glob
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import graph, search
from lodestrata.operators import vector_index as V
from lodestrata.plans.incremental import Folder, added_edges, numbered
from lodestrata.queries import fixtures as X


def clustered(spark, n=900, clusters=12, width=10, seed=1, same=0.0):
    """Unit vectors around a few directions, chunk by chunk, five chunks a document; a share of them equal."""
    r = np.random.default_rng(seed)
    middle = r.normal(size=(clusters, width))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    x = middle[r.integers(0, clusters, n)] + 0.08 * r.normal(size=(n, width))
    x[r.random(n) < same] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(f"D{i // 5}_P01_C{i % 5 + 1:02}", f"D{i // 5}", i, [float(c) for c in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "chunk_id string, document_id string, seq long, embedding array<float>").repartition(4)


def found(rows):
    return {(r.query_id, r.chunk_id, r.score, r.rank) for r in rows.collect()}


def test_index_recall(spark, tmp_path):
    folder = "/root/testdata/sf0.1"
    v, q = X.vectors(spark, folder), X.probes(spark, folder)
    index = V.VectorIndex.create(v, str(tmp_path / "i"))
    index.append(v, "all")
    assert index.rows().count() == v.count() == index.limits()[1].sum()
    exact = {(r.query_id, r.chunk_id) for r in search.knn(q, v).collect()}
    near = {(r.query_id, r.chunk_id) for r in index.nearest(q, probes=round(0.8 * len(index.centres.fine)), rescored=24).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    assert index.nearest(q.limit(0)).count() == 0
    # Vectors with structure: one cell in twenty.
    c = clustered(spark, 3_000, 30)
    index = V.VectorIndex.create(c, str(tmp_path / "c"), cells=80)
    index.append(c, "all")
    asked = c.filter("seq % 20 = 0").select(F.col("seq").alias("query_id"), "embedding")
    exact = {(r.query_id, r.chunk_id) for r in search.knn(asked, c, 10).collect()}
    near = {(r.query_id, r.chunk_id) for r in index.nearest(asked, 10, probes=4).collect()}
    assert len(exact & near) / len(exact) >= 0.9


@pytest.mark.parametrize("same", [0.0, 0.4])
def test_search_above_is_exact(spark, tmp_path, same, monkeypatch):
    monkeypatch.setattr(V, "SHARE_ROWS", 50)  # large cells are dealt in shares
    monkeypatch.setattr(V, "SHARE_QUERIES", 40)
    v = clustered(spark, same=same)
    index = V.VectorIndex.create(v, str(tmp_path / "i"))
    index.append(v, "all")
    asked = v.select(F.col("chunk_id").alias("query_id"), "embedding", "seq")
    for older in (False, True):
        assert found(index.above(asked, 0.7, 15, older)) == found(search.knn(asked, v, 15, older, threshold=0.7))
    radius, n = index.limits()
    routed = index._route(asked, n, radius, None, 0.7, False).count()
    assert routed < 0.5 * asked.count() * (n > 0).sum()  # most cells cannot hold such a score


def test_two_batches_give_the_edges_of_one(spark, tmp_path):
    v = clustered(spark)
    one = {tuple(r) for r in graph.similarity_edges(v, 35, 0.7, 10).collect()}
    index = V.VectorIndex.create(v.filter("seq < 600"), str(tmp_path / "i"))
    got = set()
    for name, part in (("a", v.filter("seq < 600")), ("b", v.filter("seq >= 600 and seq < 610")), ("c", v.filter("seq >= 610"))):
        got |= {tuple(r) for r in added_edges(index, part, name, 0.7, document=lambda c: F.regexp_extract(c, "^(.*)_P", 1)).collect()}
    assert got == one and len(one) > 1_000
    with pytest.raises(ValueError, match="already"):
        index.append(v, "a")


def test_a_batch_reads_only_the_cells_it_asks_for(spark, tmp_path):
    v = clustered(spark)
    path = str(tmp_path / "i")
    index = V.VectorIndex.create(v, path)
    index.append(v, "a")
    first = v.filter("seq = 0")
    asked = first.select(F.col("chunk_id").alias("query_id"), "embedding", "seq")
    want = found(index.above(asked, 0.8, 20))
    radius, n = index.limits()
    cells = {r.cell for r in index._route(asked, n, radius, None, 0.8, False).collect()}
    coarse = {c // index.centres.block for c in cells}
    files = index.rows(sorted(cells)).inputFiles()
    assert len(coarse) < len(glob.glob(f"{path}/cells/batch=a/coarse=*"))
    for other in glob.glob(f"{path}/cells/batch=a/coarse=*"):
        if int(other.rsplit("=", 1)[1]) not in coarse:
            shutil.rmtree(other)
    assert found(index.above(asked, 0.8, 20)) == want and len(want) > 5 and files


def test_centres(spark):
    x = np.repeat(np.array([[1.0, 0], [0, 1], [5, 5]]), 10, 0)
    got = V.means(x, 5)
    assert {tuple(r) for r in got[~np.isnan(got[:, 0])]} == {(1.0, 0.0), (0.0, 1.0), (5.0, 5.0)}
    assert (V.closest(x, got) == np.repeat(V.closest(x[::10], got), 10)).all()
    assert np.isnan(V.means(np.zeros((0, 3)), 2)).all()
    equal = spark.createDataFrame([(f"c{i}", [0.6, 0.8]) for i in range(50)], "chunk_id string, embedding array<float>")
    c = V.train(equal)
    assert (~np.isnan(c.fine[:, 0])).sum() >= 1 and (c.cells(np.array([[0.6, 0.8]])) == 0).all()


def test_index_without_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "chunk_id string, embedding array<float>, seq long")
    index = V.VectorIndex.create(empty, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")
    assert index.above(asked, 0.1, 5).count() == 0 and index.nearest(asked).count() == 0 and index.rows() is None
    index.append(empty, "none")
    assert index.above(asked, 0.1, 5).count() == 0 and index.nearest(asked).count() == 0


def documents(spark, lo, hi):
    r = random.Random(8)
    words = [f"word{i}" for i in range(12)]
    rows = [(i, f"# Title {i}\n\n" + " ".join(r.choice(words) for _ in range(300 if i % 4 else 20)) + ".", f"f{i}.pdf") for i in range(40)]
    return spark.createDataFrame(rows[lo:hi], "doc_id long, text string, file_name string")


def test_archive_grows_by_batches(spark, tmp_path):
    one = Folder(spark, str(tmp_path / "one"))
    one.add(documents(spark, 0, 40), "all", threshold=0.5)
    two = Folder(spark, str(tmp_path / "two"))
    two.add(documents(spark, 0, 25), "a", threshold=0.5)
    before = {f: open(f, "rb").read() for f in glob.glob(f"{two.path}/**/*.parquet", recursive=True)}
    two.add(documents(spark, 20, 40), "b", threshold=0.5)  # five of them are stored
    for table, columns in (("chunks", ["document_id", "chunk_id", "page_number", "chunk_index", "text", "seq"]), ("similar", ["src", "dst", "score", "rank"]), ("metadata", ["document_id", "title", "chunk_sequence"])):
        of = lambda a: sorted(map(str, a.table(table).select(*columns).collect()))  # noqa: B023, E731
        assert of(one) == of(two) and of(one)
    assert all(open(f, "rb").read() == b for f, b in before.items())  # nothing stored is written again
    seq = [r.seq for r in two.table("chunks").orderBy("seq").collect()]
    assert seq == list(range(len(seq)))
    with pytest.raises(ValueError, match="already"):
        two.add(documents(spark, 0, 1), "b")


def test_a_broken_batch_is_run_again(spark, tmp_path, monkeypatch):
    from lodestrata.plans import incremental

    archive, whole = Folder(spark, str(tmp_path / "a")), Folder(spark, str(tmp_path / "b"))
    archive.add(documents(spark, 0, 10), "a", threshold=0.5)

    def lost(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(incremental, "similarity_edges", lost)
        with pytest.raises(RuntimeError, match="lost"):
            archive.add(documents(spark, 10, 20), "b", threshold=0.5)
    assert [b for b, _ in archive.batches()] == ["a"] and archive.table("chunks").filter("batch = 'b'").count() == 0
    with pytest.raises(ValueError, match="broken off"):
        archive.add(documents(spark, 20, 30), "c", threshold=0.5)
    archive.add(documents(spark, 10, 20), "b", threshold=0.5)
    whole.add(documents(spark, 0, 20), "all", threshold=0.5)
    edges = lambda a: {tuple(r) for r in a.table("similar").select("src", "dst", "score", "rank").collect()}
    assert edges(archive) == edges(whole) and edges(whole)


def test_numbers_without_gaps(spark):
    rows = spark.createDataFrame([(i % 7, f"x{i}") for i in range(200)], "a long, b string").repartition(5)
    got = numbered(rows, ["a", "b"], 10).collect()
    want = sorted((r.a, r.b) for r in rows.collect())
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.seq)] == want
    assert sorted(r.seq for r in got) == list(range(10, 210))
    assert numbered(rows.limit(0), ["a"]).count() == 0


def test_exact_search_and_what_it_moves(spark, tmp_path):
    v = clustered(spark, 500, same=0.3)
    index = V.VectorIndex.create(v, str(tmp_path / "i"), cells=30)
    index.append(v, "all")
    asked = v.filter("seq % 10 = 0").select(F.col("chunk_id").alias("query_id"), "embedding", "seq")
    assert found(index.exact(asked, 7)) == found(search.knn(asked, v, 7))
    radius, n, norm = index._limits()
    # Every cell is asked, all in one block, which gives out the best k a query: no row a query and cell.
    met = index._meet(asked, V.Reach(n, radius, norm, probes=30), 7, 60, False)
    assert met.groupBy("query_id").count().agg(F.max("count")).first()[0] == 7
