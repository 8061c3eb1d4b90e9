"""Vectors that meet in a task: single precision leaves no pair out, and a search of the nearest cells takes their best rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import search
from lodestrata.operators import vector_index as V
from tests.test_archive import clustered, found


@pytest.mark.parametrize("size", [1.0, 1e-9, 1e6, 1e200])
@pytest.mark.parametrize("older", [False, True])
def test_meet_finds_what_add_finds(size, older):
    r = np.random.default_rng(4)
    q, x = r.normal(size=(37, 9)) * size, r.normal(size=(501, 9))
    x[r.random(501) < 0.3] = x[0]
    x[7] = x[3] * (1 + 1e-9)
    keys = pa.array([f"c{i:03}" for i in r.permutation(501)])
    age, born = r.integers(0, 600, 37), np.sort(r.integers(0, 600, 501))
    for least in (-np.inf, 0.5 * size) if size >= 1 else (-np.inf,):
        one, two = search.Best(37, 5, least), search.Best(37, 5, least)
        for lo in range(0, 501, 100):
            ages = (age, born[lo : lo + 100]) if older else ()
            one.add(np.arange(37), q @ x[lo : lo + 100].T, keys.slice(lo, 100), *ages)
            two.meet(np.arange(37), q, x[lo : lo + 100], keys.slice(lo, 100), *ages)
        rows = lambda best: sorted(zip(best[0].tolist(), best[2].to_pylist(), np.round(best[1] / size, 5).tolist(), strict=True))
        got, want = two.found(), one.found()
        assert rows(got) == rows(want) and len(want[0]) > 50


def test_first_rows_do_not_all_wait():
    """Of a query's first rows those that cannot be among its best are not kept: all 1,000 were, before."""
    r = np.random.default_rng(5)
    q, x = r.normal(size=(50, 8)), r.normal(size=(1_000, 8))
    best = search.Best(50, 12)
    best.meet(np.arange(50), q, x, pa.array([f"c{i:04}" for i in range(1_000)]))
    assert 50 * 12 <= best.size < 50 * 20
    kept = best.found()
    assert sorted(zip(kept[0].tolist(), kept[2].to_pylist(), strict=True)) == sorted((i, f"c{j:04}") for i in range(50) for j in np.argsort(-(q[i] @ x.T))[:12])


@pytest.mark.parametrize("older", [False, True])
def test_nearest_takes_the_best_of_its_cells(spark, tmp_path, older, monkeypatch):
    """All cells asked: the result is the exact one, though cells that hold no better row are left out. Ranking by codes missed some."""
    monkeypatch.setattr(V, "SHARE_ROWS", 150)
    v = clustered(spark, same=0.1)
    index = V.VectorIndex.create(v, str(tmp_path / "i"))
    index.append(v, "all")
    asked = v.select(F.col("chunk_id").alias("query_id"), "embedding", "seq")
    assert found(index.nearest(asked, 9, 10_000, older_only=older)) == found(search.knn(asked, v, 9, older))
