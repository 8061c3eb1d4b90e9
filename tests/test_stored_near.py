"""Stored edges and stored pairs come from one all-pairs search."""

from lodestrata.operators import search
from lodestrata.queries import fixtures as X


def test_stored_edges_and_pairs_share_one_search(spark, monkeypatch):
    from lodestrata.sources import stores

    folder, times = "/root/testdata/sf0.001", []
    want = [sorted(map(tuple, f(spark, folder).collect())) for f in (X.similar, X.judged_pairs)]
    stores.forget_stored()
    knn = search.knn
    monkeypatch.setattr(search, "knn", lambda *a, **k: times.append(1) or knn(*a, **k))
    assert [sorted(map(tuple, f(spark, folder).collect())) for f in (X.stored_similar, X.stored_pairs)] == want
    assert len(times) == 1
