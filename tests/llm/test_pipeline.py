"""The pipeline's stages against plain Python, each on what its predecessor kept."""

import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline
from lodestrata.llm import mixing, quality, sharding, weighted_minhash
from lodestrata.llm.common import stage

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, FOLDER), name.replace(" ", "-"))
        out.append(docs)
    return out


def test_columns(steps):
    for before, after in zip(steps, steps[1:], strict=False):
        assert after.columns[: len(before.columns)] == before.columns
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert steps[-1].columns == [*steps[0].columns, "shard", "slot"]


def test_quality_stage(spark, steps):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    kept = {r.doc_id for r in steps[1].collect()}
    scored = {r.doc_id: r.predicted for r in quality.score_documents(steps[0], labels).collect()}
    assert kept == {k for k, v in scored.items() if v}
    known = {r.doc_id: r.quality for r in labels.collect()}
    agree = sum((d in kept) == bool(q) for d, q in known.items())
    assert agree >= 0.97 * len(known)


def test_near_dedup_stage(steps):
    rows = steps[1].collect()
    grams = {}
    for r in rows:
        w = words(r.text)
        grams[r.doc_id] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    up = {r.doc_id: r.doc_id for r in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    text = {r.doc_id: r.text for r in rows}
    ids = sorted(up)
    n = Counter(g for c in grams.values() for g in c)
    weight = {g: weighted_minhash.idf_weight(k / len(rows)) for g, k in n.items()}
    total = lambda c: sum(weight[g] * k for g, k in c.items())
    for i, a in enumerate(ids):
        for b in ids[:i]:
            alike = text[a] == text[b]
            if not alike and grams[a] and grams[b]:
                alike = total(grams[a] & grams[b]) >= 0.8 * total(grams[a] | grams[b])
            if alike and top(a) != top(b):
                up[max(top(a), top(b))] = min(top(a), top(b))
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted({top(x) for x in ids})


def test_decontamination_stage(spark, steps):
    windows = {}
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = words(r.text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(len(w[i : i + 13]), set()).add(tuple(w[i : i + 13]))
    keep = []
    for r in steps[2].collect():
        w, hit = words(r.text), set()
        for n, known in windows.items():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit.update(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            keep.append(r.doc_id)
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted(keep)
    assert len(keep) < steps[2].count()


def test_mixing_stage(steps):
    """Earliest deadline first over plain integers, block by block, without frames that repeat."""
    n = Counter(r.source for r in steps[3].collect())
    size, total = mixing.BLOCK_ROWS, sum(n.values())
    blocks, frame = mixing.shares({f"s:{k}": v**mixing.TEMPERATURE for k, v in n.items()})
    length = -(-total // size)
    taken = Counter()
    for t in range(length):
        due = [(-(-(taken[s] + 1) * frame // p), s) for s, p in blocks.items() if taken[s] * frame // p <= t]
        if due:
            taken[min(due)[1]] += 1
    want = {s[2:]: min(n[s[2:]], k * size) for s, k in taken.items()}
    got = Counter(r.source for r in steps[4].collect())
    assert dict(got) == {k: v for k, v in want.items() if v}
    assert {r.doc_id for r in steps[4].collect()} <= {r.doc_id for r in steps[3].collect()}


def test_sharding_stage(steps):
    rows = steps[5].collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in steps[4].collect())
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own))) and s < sharding.SHARDS
    load = Counter()
    for r in rows:
        load[r.shard] += len((r.text or "").encode()) + 8
    assert max(load.values()) <= sum(load.values()) / sharding.SHARDS + max(len((r.text or "").encode()) + 8 for r in rows)


def test_run_repeats(spark, steps):
    digest = lambda rows: hashlib.sha256(repr(sorted((r.doc_id, r.shard, r.slot) for r in rows)).encode()).hexdigest()
    assert digest(corpus_pipeline.run(spark, FOLDER).collect()) == digest(steps[-1].collect())


ODD = "doc_id long, text string, lang string, source string, n_chars long, __doc string, row string, score double, label long, term long"


def test_stages_take_odd_rows(spark):
    """Nulls, empty texts, repeated rows, clashing columns and an empty table pass every stage."""
    good = " ".join(f"the quiet river number {i} runs along the green hill and the old town" for i in range(9))
    rows = [(1, good), (1, good), (2, good + " now"), (3, None), (None, good.replace("river", "lake")), (4, ""), (5, "one two"), (None, None), (6, "wort " * 40_000)]
    docs = spark.createDataFrame([(i, t, "en", None if i == 5 else "s", None, "d", "r", 0.1, 7, 8) for i, t in rows], ODD).repartition(3)
    for table in (docs, docs.limit(0)):
        for name, function in corpus_pipeline.STAGES:
            out = function(spark, table, FOLDER)
            if function is not corpus_pipeline.sharding_stage:
                assert out.columns == table.columns, name
            n = out.count()
            assert n <= table.count() and (table is docs or n == 0), name
    kept = corpus_pipeline.near_dedup_stage(spark, docs, FOLDER).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 6), (True, 0), (True, 0)]
    assert corpus_pipeline.sharding_stage(spark, docs, FOLDER).count() == len(rows)


def test_columns_named_as_the_results_are_replaced(spark):
    rows = [(i, f"text number {i} of the hill", "en", "s", 1, 40 + i, "old", 0.5) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, SLOT string, row double")
    out = corpus_pipeline.sharding_stage(spark, docs, FOLDER)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "shard", "slot"]
    assert out.count() == 9 and out.filter("shard >= 40").count() == 0
    assert corpus_pipeline.sharding_stage(spark, docs.limit(0), FOLDER).count() == 0
