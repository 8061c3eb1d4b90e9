"""The step that the vector searches share: the best k a query, in bounded memory."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import search


def test_ties_leave_k_rows_a_query():
    best = search.Best(3, 4)
    keys = [f"c{i:05d}" for i in np.random.default_rng(1).permutation(30_000)]
    for lo in range(0, len(keys), 1_000):
        best.add(np.arange(3), np.full((3, 1_000), 0.5), pa.array(keys[lo : lo + 1_000]))
    best._cut()
    assert best.size == 12
    (rows,) = best.rows(pa.array(["a", "b", "c"]))
    assert sorted(rows.column(1).to_pylist()[:4]) == ["c00000", "c00001", "c00002", "c00003"]


@pytest.mark.parametrize("older", [False, True])
def test_shuffled_queries_find_what_broadcast_ones_do(spark, monkeypatch, older):
    r = np.random.default_rng(2)
    rows = [(f"c{i}", np.round(r.normal(size=4), 1).tolist(), i // 3) for i in range(400)]
    rows += [(f"d{i}", [0.5, 0.5, 0.5, 0.5], 7 * i) for i in range(60)]  # copies
    v = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, seq long")
    asked = v.select(F.col("chunk_id").alias("query_id"), "embedding", "seq")
    names, x, age = [r[0] for r in rows], np.array([r[1] for r in rows], np.float32).astype(float), np.array([r[2] for r in rows])
    score = np.round(x @ x.T, 6)
    want = set()
    for i, name in enumerate(names):
        near = sorted((-score[i, j], names[j]) for j in range(len(names)) if (not older or age[j] < age[i]) and score[i, j] >= 0.1)[:5]
        want |= {(name, key, -s, n) for n, (s, key) in enumerate(near, 1)}
    tell = lambda: {tuple(r) for r in search.knn(asked, v, 5, older, 0.1).select("query_id", "chunk_id", "score", "rank").collect()}
    assert tell() == want
    for name, value in (("QUERY_BLOCK", 100), ("SHARE_QUERIES", 90), ("SHARE_ROWS", 150), ("PIECE_SCORES", 2_000)):
        monkeypatch.setattr(search, name, value)
    # Queries go to the tasks by a shuffle, none through the driver.
    monkeypatch.setattr(search, "query_blocks", None)
    assert tell() == want
