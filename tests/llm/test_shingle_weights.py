"""Every shingle weighs by its own document frequency, also those of few documents."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm import weighted_minhash

WORD = re.compile(r"[0-9a-z]+")


def grams(text):
    w = WORD.findall(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_idf_falls_with_every_document():
    n = np.arange(1, 1_001)
    assert (np.diff(weighted_minhash.idf_weight(n / 1_000)) < 0).all()


def test_weights_are_exact_counts_whatever_the_blocks(spark, monkeypatch):
    r = random.Random(8)
    lines = [" ".join(f"w{r.randrange(2_000)}" for _ in range(9)) for _ in range(60)]
    body = [" ".join(r.choice(lines) for _ in range(r.randrange(1, 7))) for _ in range(120)] + ["one two", "one two"]
    df = spark.createDataFrame([*enumerate(body), (900, None), (901, "...")], "doc long, text string").select(F.xxhash64("text").alias("node"), "doc", "text")
    frequency = Counter(g for t in body for g in grams(t))
    docs, unit = len(body) + 2, weighted_minhash.idf_weight(1 / (len(body) + 2))
    none = spark.sparkContext.broadcast(weighted_minhash.Idf(np.zeros(0, np.uint64), np.zeros(0)))
    for size in (2_000, 1 << 20):
        monkeypatch.setattr(weighted_minhash, "ASKED_BYTES", size)
        got = {x.doc: x for x in weighted_minhash._sign(df, none, 2, 1).collect()}
        assert len(got) == docs and not got[900].bands and not got[901].bands
        for i, t in enumerate(body):
            want = sorted(n * weighted_minhash.idf_weight(frequency[g] / docs) / unit for g, n in grams(t).items())
            assert np.allclose(sorted(got[i].weights), want) and abs(got[i].weight - sum(want)) < 1e-9


def test_frequencies_of_few_documents_decide(spark):
    """Shingles in 2 to 9 of 200 documents weigh less than those of one, so they decide about 0.8 both ways."""
    run = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    shared, left, right = run("s", 94), run("l", 14), run("r", 14)
    body = [shared + " " + run("e", 9), shared + " " + run("f", 9)]  # rare edits of a passage of nine documents
    body += [run("p", 112) + " " + left, run("p", 112) + " " + right]  # rare passage, edits of nine documents
    body += [f"{run(f'x{i}y', 400)} {shared} {run(f'z{i}y', 30)} {left} {run(f'v{i}y', 30)} {right}" for i in range(7)]
    body += [run(f"u{i}y", 20) for i in range(200 - len(body))]
    n = Counter(g for t in body for g in grams(t))
    weigh = {g: float(weighted_minhash.idf_weight(k / len(body))) for g, k in n.items()}

    def alike(a, b, w):
        total = lambda c: sum(w[g] * k for g, k in c.items())
        a, b = grams(body[a]), grams(body[b])
        return total(a & b) / total(a | b)

    plain = dict.fromkeys(n, 1)
    assert alike(0, 1, weigh) < 0.8 <= alike(0, 1, plain) and alike(2, 3, plain) < 0.8 <= alike(2, 3, weigh)
    d = spark.createDataFrame(list(enumerate(body)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in weighted_minhash.near_duplicates(d, bands=60, rows=1).collect()}
    assert got == {i: 2 if i == 3 else i for i in range(len(body))}
