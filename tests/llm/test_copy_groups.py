"""A group of copies counts as one document in the shingles' frequencies, so its near copies are found however large it is."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm import weighted_minhash
from tests.llm.test_shingle_weights import grams


def test_near_copies_of_a_large_group_are_found(spark):
    r = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    body = [" ".join(base)]
    for i in range(60):
        w = list(base)
        for at in (r.randrange(8, 55), r.randrange(65, 112)):
            w[at] = f"e{i}x{at}"
        body.append(" ".join(w))
    group = len(body)
    body += [" ".join(f"u{i}y{j}" for j in range(40)) for i in range(140)]
    d = spark.createDataFrame(list(enumerate(body)), "doc_id long, text string")
    want = {i: 0 if i < group else i for i in range(len(body))}
    assert {x.doc_id: x.class_id for x in weighted_minhash.near_duplicates(d, copies_once=True).collect()} == want
    kept = {x.doc_id for x in weighted_minhash.drop_near_duplicates(d, copies_once=True).collect()}
    assert kept == {0, *range(group, len(body))}
    by_rows = {x.class_id for x in weighted_minhash.near_duplicates(d).collect() if x.doc_id < group}
    assert len(by_rows) > 1  # where each copy counts, they are missed


def test_passages_of_different_texts_still_weigh_less(spark):
    """As in test_frequencies_of_few_documents_decide: nine texts that are no copies share a passage."""
    run = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    shared, left, right = run("s", 94), run("l", 14), run("r", 14)
    body = [shared + " " + run("e", 9), shared + " " + run("f", 9), run("p", 112) + " " + left, run("p", 112) + " " + right]
    body += [f"{run(f'x{i}y', 400)} {shared} {run(f'z{i}y', 30)} {left} {run(f'v{i}y', 30)} {right}" for i in range(7)]
    body += [run(f"u{i}y", 20) for i in range(200 - len(body))]
    d = spark.createDataFrame(list(enumerate(body)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in weighted_minhash.near_duplicates(d, bands=60, rows=1, copies_once=True).collect()}
    assert got == {i: 2 if i == 3 else i for i in range(len(body))}


def test_groups_are_counted_once_whatever_the_blocks(spark, monkeypatch):
    r = random.Random(9)
    lines = [" ".join(f"w{r.randrange(2_000)}" for _ in range(9)) for _ in range(60)]
    body = [" ".join(r.choice(lines) for _ in range(r.randrange(1, 7))) for _ in range(120)] + ["one two", "one two", None, "..."]
    df = spark.createDataFrame(list(enumerate(body)), "doc long, text string").select(F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("node"), "doc", "text")
    node = {x.doc: x.node for x in df.collect()}
    label = {node[i]: min(node[j] for j in range(i % 4, 60, 4)) for i in range(60)} | {node[120]: node[120]}
    groups = spark.createDataFrame(list(label.items()), "node long, label long")
    names = [("null", i) if node[i] is None else (label[node[i]] if node[i] in label else ("own", i)) for i in node]
    of = {}
    for i, t in enumerate(body):
        for g in grams(t) if t and t != "..." else ():
            of.setdefault(g, set()).add(names[i])
    docs = len(set(names))
    none, unit = spark.sparkContext.broadcast(weighted_minhash.Idf(np.zeros(0, np.uint64), np.zeros(0))), weighted_minhash.idf_weight(1 / docs)
    for size in (2_000, 1 << 20):
        monkeypatch.setattr(weighted_minhash, "ASKED_BYTES", size)
        got = {x.doc: x for x in weighted_minhash._sign(df, none, 2, 1, groups).collect()}
        assert len(got) == len(body)
        for i in range(122):
            want = sorted(n * weighted_minhash.idf_weight(len(of[g]) / docs) / unit for g, n in Counter(grams(body[i])).items())
            assert np.allclose(sorted(got[i].weights), want)


def test_groups_of_texts(spark):
    """Copies and near copies are in one group; texts that share a passage, wordless and null ones are in none."""
    base = [f"b{i}" for i in range(200)]
    near = [" ".join(f"n{i}" if j == 20 * i + 7 else w for j, w in enumerate(base)) for i in range(8)]
    body = [" ".join(base), *near, "one two three", "one two three", " ".join(base[:60] + [f"c{i}" for i in range(200)]), "...", None, ""]
    rows = spark.createDataFrame([(t,) for t in body], "text string").select(F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("node"), "text")
    found = {x.node: x.label for x in weighted_minhash.copy_groups(rows).collect()}
    node = {x.text: x.node for x in rows.collect()}
    assert set(found) == {node[t] for t in body[:10]}
    assert len({found[node[t]] for t in body[:9]}) == 1 and found[node["one two three"]] == node["one two three"]
