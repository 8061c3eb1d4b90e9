"""Nearest neighbours, hard negatives and token alignment against brute force, on small tables with odd rows."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import alignment, annuli, metric, vantage
from lodestrata.llm.queries import OP13, QUERIES, tokenizer_path

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, ids string, vector string, ask int, shard int, score double"
NAN, INF = float("nan"), float("inf")


def rows():
    """Clusters, copies in number, equal scores, vectors that take no part, repeated rows and shorter ones."""
    r = np.random.default_rng(3)
    middle = r.normal(size=(6, 8))
    x = (middle[r.integers(0, 6, 700)] + 0.3 * r.normal(size=(700, 8))).astype(np.float32)
    x[::3] = x[0]  # a third of all rows are one vector
    x[301:320] = np.roll(np.eye(8, dtype=np.float32)[0], 2)
    out = [(i, v.tolist(), int(i % 5), "x", "y", i, 1, 0.5) for i, v in enumerate(x.tolist() and x)]
    out[40] = (40, None, 1, *out[40][3:])
    out[41] = (41, [0.0] * 8, 1, *out[41][3:])
    out[42] = (42, [1.0] * 7 + [NAN], 1, *out[42][3:])
    out[43] = (43, [1.0] * 7 + [None], 1, *out[43][3:])
    out[44] = (44, [INF] + [1.0] * 7, 1, *out[44][3:])
    out[45] = (45, [0.5, -0.5, 0.25], 1, *out[45][3:])
    out[46] = (46, [], 1, *out[46][3:])
    out[47] = (47, out[47][1], None, *out[47][3:])
    out[100] = (100, out[100][1], None, *out[100][3:])
    out[60] = (60, None, 1, *out[60][3:])
    return [*out, out[5], out[20], (None, out[7][1], 2, *out[7][3:]), out[0]]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def usable(v, zero=False):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and (zero or any(v))


def padded(v, scale=None):
    x = np.zeros(8)
    x[: len(v)] = np.array(v, np.float32).astype(float)
    return x if scale is None else np.floor(scale * x)


def nearest_by_hand(k=20, every=20):
    kept = {(r[0], tuple(r[1])): padded(r[1]) for r in rows() if r[0] is not None and usable(r[1])}
    out = {}
    for (i, _), q in kept.items():
        if i % every == 0:
            out[i] = sorted((-(q * x).cumsum()[-1], j) for (j, _), x in kept.items() if j != i)[:k]
    return out


@pytest.mark.parametrize("shard_values", [2_000, 1 << 20])
def test_factor_one_is_exact(table, shard_values):
    found = vantage.nearest(table, factor=1.0, shard_values=shard_values).collect()
    want = nearest_by_hand()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert {q: [j for _, j in v] for q, v in got.items()} == {q: [j for _, j in v] for q, v in want.items()}
    for q, v in got.items():
        assert np.allclose([s for s, _ in v], [s for s, _ in want[q]], atol=0, rtol=1e-12)
    assert all(r.rank >= 1 for r in found) and set(found[0].asDict()) == {"query_id", "rank", "vec_id", "score"}


def test_larger_factor_reads_less_and_finds_most(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    exact, found = vantage.nearest(table, factor=1.0), vantage.nearest(table)
    assert exact.count() == found.count() == 100 * 20
    assert vantage.recall(found, exact) >= 0.95
    assert vantage.recall(exact, exact) == 1.0


def test_tree_bounds_hold():
    r = np.random.default_rng(1)
    x = r.normal(size=(900, 5))
    tree, leaf = vantage.Tree.build(x, 4)
    q = r.normal(size=(50, 5))
    low, far = tree.bounds(q), vantage.distances(q, x)
    assert (low[:, leaf] <= far + 1e-9).all()
    assert (tree.leaves(x) != leaf).sum() <= len(tree.splits)  # a row at the split itself may fall to either side
    assert (low > 0).any()


def test_search_of_few_or_no_rows(spark, table):
    none = table.filter("vec_id < 0")
    assert vantage.nearest(none).collect() == []
    few = vantage.nearest(table.filter("vec_id in (20, 21, 22)")).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(20, 21), (20, 22)]
    with pytest.raises(ValueError, match="k=30"):
        vantage.Index(table, k=5).search(table.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), k=30)


def test_search_by_names(spark):
    r = np.random.default_rng(0)
    made = spark.createDataFrame([(f"n{i:03}", [float(c) for c in r.normal(size=4)]) for i in range(300)], "name string, v array<double>")
    index = vantage.Index(made, "name", "v", k=5, shard_values=1_000)
    found = index.search(made.select(F.col("name").alias("query_id"), F.col("v").alias("vector")), factor=1.0).collect()
    x = {a.name: np.array(a.v) for a in made.collect()}
    for name in ("n000", "n123"):
        want = [j for _, j in sorted((-(x[name] @ x[j]), j) for j in x if j != name)[:5]]
        assert [q.name for q in sorted((q for q in found if q.query_id == name), key=lambda q: q.rank)] == want


def mined_by_hand(every=50):
    kept = {}
    for i, v, label, *_ in rows():
        if i is not None and label is not None and usable(v, zero=True):
            kept[i, (label + 1) % 10 if i % 7 == 0 else label, tuple(v)] = padded(v, 256)
    out = set()
    for (i, label, _), a in kept.items():
        if i % every:
            continue
        scored = [(-int(a @ x), j, other) for (j, other, _), x in kept.items()]
        for s, j, _ in sorted(t for t in scored if t[2] == label and t[1] != i)[:5]:
            band = sorted(t for t in scored if t[2] != label and 50 * -s <= 100 * -t[0] <= 95 * -s)[:3]
            out |= {(i, j, rank, k, -s, -t) for rank, (t, k, _) in enumerate(band, 1)}
    return out


@pytest.mark.parametrize("sizes", [(16, 8), (2_048, 4_096)])
def test_mined_negatives(table, sizes):
    whole = annuli.whole_numbers(table, 256.0).withColumn("label", F.when(F.pmod("id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    got = annuli.hard_negatives(whole, whole.filter("id % 50 = 0"), page_rows=sizes[0], first_rows=sizes[1]).collect()
    want = mined_by_hand()
    assert len(got) == len(want) and len(want) > 30
    assert {tuple(r) for r in got} == want
    assert {tuple(r) for r in annuli.mined(table).collect()} == want


def test_mining_of_odd_tables(spark, table):
    assert annuli.mined(table.filter("vec_id < 0")).collect() == []
    assert annuli.mined(table.filter("vec_id = 50")).collect() == []  # no positives
    assert annuli.mined(table.withColumn("label", F.lit(1))).filter("negative_id is null").collect() == []
    large = spark.createDataFrame([(50, [4e5, 1.0], 1), (51, [4e6, 1.0], 1), (52, [1e30, 1.0], 2)], "vec_id long, embedding array<double>, label int")
    assert annuli.whole_numbers(large, 256.0).count() == 0  # beyond exact scores


def test_mined_query_follows_sql(spark):
    got = QUERIES["op13_hard_negatives"](spark, FOLDER).collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    assert {tuple(r) for r in got} == set(c.execute(OP13).fetchall()) and got


def test_store_is_sorted_by_key(table):
    store = annuli.Store(annuli.whole_numbers(table, 256.0), 6, page_rows=16)
    shard, pivot, low, high, n = store.directory
    assert (low <= high).all() and n.max() <= 16 and n.sum() == store.n
    order = np.lexsort((low, pivot))
    same = pivot[order][1:] == pivot[order][:-1]
    assert (high[order][:-1][same] <= low[order][1:][same]).all()


def test_vectors_that_take_part(spark):
    made = spark.createDataFrame([(1, [1.0, None]), (2, None), (3, []), (4, [NAN]), (5, [-INF]), (6, [0.0])], "i int, v array<double>")
    assert [r.i for r in made.filter(metric.usable(F.col("v"))).collect()] == [6]


TEXTS = ["", None, "one two three", "one two three", "Hello, world! naïve café", "a▁b", "<|endoftext|> and <s> stay text", " ", "\x00\n\t  漢字 🎉🎉 ", "x" * 3_000, "ΑΒΓ don't 3.14 foo_bar"]


def texts():
    r = random.Random(2)
    words = "the quick brown-fox jumps over lazy dogs ünïcode 12345 Zq7pL0 isn't".split()
    return [*TEXTS, *(" ".join(r.choice(words) for _ in range(r.randrange(1, 90))) for _ in range(60)), " ".join(r.choice(words) for _ in range(30_000))]


def aligned_by_hand(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    left, right = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    left.encode_special_tokens = True
    names, of = {i: t for t, i in left.get_vocab().items()}, alignment.byte_of_character()
    found, links = [], Counter()
    for text in texts:
        own = []
        if text:
            a, b = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
            pieces = [right.id_to_piece(i) for i in b]
            bytes_a = [bytes(of[c] for c in names[i]) for i in a]
            bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                spans = []
                for kind, ids, parts in ((0, a, bytes_a), (1, b, bytes_b)):
                    at = 0
                    for i, p in zip(ids, parts, strict=True):
                        spans.append((kind, at, at + len(p), i))
                        at += len(p)
                own = spans
        one, two = [s for s in own if not s[0]], [s for s in own if s[0]]
        pairs, j0 = [], 0
        for s in one:
            while two[j0][2] <= s[1]:
                j0 += 1
            j = j0
            while j < len(two) and two[j][1] < s[2]:
                pairs.append((s[3], two[j][3]))
                j += 1
        cuts = sorted({s[2] for s in one} & {s[2] for s in two})
        groups = [(",".join(str(s[3]) for s in one if lo < s[2] <= hi), ",".join(str(s[3]) for s in two if lo < s[2] <= hi)) for lo, hi in zip([0, *cuts], cuts, strict=False)] if len(cuts) < 2_000 else None
        links.update(pairs)
        found.append((one, two, cuts, pairs, groups))
    most = Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    out = []
    for one, two, cuts, pairs, groups in found:
        written = None if groups is None else ";".join("|".join(g) for g in groups)
        out.append((len(one), len(two), len(cuts), len(pairs), sum(links[p] == most[p[1]] for p in pairs), sum(links[p] for p in pairs), written))
    return out, links, most


@pytest.mark.parametrize("block_bytes", [1_000, 16 << 20])
def test_alignment(spark, block_bytes):
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    given = texts()
    rows = [(i if i % 9 else None, t, i, "x", 0, "p") for i, t in enumerate(given)] + [(3, given[3], 3, "x", 0, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int, block string, links int, pairs string").repartition(2)
    whole = alignment.Aligned(docs, *paths, block_bytes=block_bytes)
    got = whole.documents().collect()
    want, links, most = aligned_by_hand([r[1] for r in rows])
    digest = lambda w: "" if not w[0] else hashlib.sha256(w[6].encode()).hexdigest() if w[6] is not None else None
    expected = Counter((r[0], *w[:6]) for r, w in zip(rows, want, strict=True))
    assert Counter(tuple(r)[:7] for r in got) == expected
    known = Counter((r[0], digest(w)) for r, w in zip(rows, want, strict=True) if digest(w) is not None)
    assert not known - Counter((r.doc_id, r.groups_sha256) for r in got)
    pairs = whole.pairs().collect()
    assert {(r.a_id, r.b_id): r.links for r in pairs} == dict(links)
    assert all(r.best == (r.links == most[r.b_id]) for r in pairs)
    written = alignment.alignments(docs, *paths).collect()
    assert not Counter((r[0], w[6]) for r, w in zip(rows, want, strict=True) if w[0] and w[6] is not None) - Counter((r.doc_id, r.groups) for r in written)
    assert alignment.aligned_documents(docs.filter("at < 0"), *paths).collect() == []


def test_union_find_gives_components():
    r = np.random.default_rng(4)
    for n, m in ((1, 0), (50, 30), (400, 380), (300, 900)):
        u, v = r.integers(0, n, m), r.integers(0, n, m)
        got = alignment.union_find(n, u, v)
        label = list(range(n))
        for _ in range(n):
            for a, b in zip(u, v, strict=True):
                label[a] = label[b] = min(label[a], label[b])
        assert got.tolist() == label
