"""Counting a batch's words takes memory by the words counted at once, not by the batch."""

import numpy as np
import pyarrow as pa

from lodestrata.operators import impacts


def test_batches_are_counted_in_slices(monkeypatch):
    texts = [["a", "b", "a"], [], None, ["c"] * 12, ["b"], ["a", "c"], [], ["d"]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(8)), pa.array([t or [] for t in texts], pa.list_(pa.string())), pa.array([t is not None for t in texts])], names=["chunk_id", "t", "there"],
    )
    sizes, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, **given: sizes.append(len(x)) or unique(x, **given))
    monkeypatch.setattr(impacts, "COUNTED_WORDS", 4)
    out = [r for b in impacts._counted(iter([batch.slice(0, 3), batch.slice(3)])) for r in b.to_pylist()]
    assert [r["chunk_id"] for r in out] == list(range(8))
    for text, r in zip(texts, out, strict=True):
        assert r["dl"] == (None if text is None else len(text))
        assert dict(zip(r["terms"], r["tf"], strict=True)) == {w: text.count(w) for w in text or ()}
    assert max(sizes) == 12 and sorted(sizes)[-2] <= 4  # a longer text alone
