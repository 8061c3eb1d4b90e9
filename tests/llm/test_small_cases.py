"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns: each operator on small tables."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import chat, decontaminate, fingerprints, mixing, quality, secrets, sharding, token_counts, warc, weighted_minhash
from lodestrata.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, row string, score double"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def texts():
    r = random.Random(5)
    make = lambda n: " ".join(r.choice("alpha beta gamma delta épsilon zeta eta theta 12 x9".split()) + str(r.randrange(40)) for _ in range(n))
    base = make(120)
    near = base.replace(base.split()[60], "changed", 1)
    long = make(30_000)
    return [base, base, near, None, None, "", "", "one two", "one two", "!!! ???", make(50), make(300), long, make(5), base + " tail", "ΣΑΣ İ <|endoftext|> end"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None, i, "r", 0.5) for i, t in enumerate(texts())]
    rows += [rows[0], rows[3], (None, "no id here", "en", "s0", 1, 1, "r", 0.5), (7, "another text under one id", "en", "s1", 1, 1, "r", 0.5)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shingle_hashing_follows_words():
    import numpy as np
    import pyarrow as pa

    from lodestrata.llm import shingles as S

    body = [t or "" for t in texts()]
    found = []
    for lo, hi, data, offsets in S.blocks(pa.array(texts(), pa.string())):
        doc, value, times = S.shingles(data, offsets)
        found += [dict(zip(value[doc == i].tolist(), times[doc == i].tolist(), strict=True)) for i in range(hi - lo)]
    known = {}
    for text, own in zip(body, found, strict=True):
        w = WORD.findall(low(text))
        grams = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
        assert sorted(grams.values()) == sorted(own.values())
        for g in grams:
            known.setdefault(g, set())
    assert len({h for own in found for h in own}) == len(known)
    assert np.uint64(1) << np.uint64(S.HASH_BITS) > max(h for own in found for h in own)


def test_near_duplicates(docs, empty):
    out = weighted_minhash.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add(r.class_id)
    assert by[0] == by[1] == by[2] == by[14] == {0}
    assert by[5] == by[6] == {5} and by[8] == {7} and by[7] == {7}
    assert by[3] == {3} and by[4] == {4}
    assert weighted_minhash.near_duplicates(empty).count() == 0
    kept = weighted_minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[0] == 1 and ids[1] == ids[2] == ids[6] == ids[8] == 0
    assert ids[7] == 2 and ids[3] == 2 and ids[4] == 1 and ids[None] == 1
    assert weighted_minhash.drop_near_duplicates(empty).count() == 0


def test_spanning_links_match_pairs():
    import numpy as np

    r = random.Random(3)
    sets = []
    for i in range(60):
        if i % 3 or not sets:
            v = np.unique(np.array([r.randrange(4000) for _ in range(60)], np.uint64))
            sets.append((v, np.array([r.choice([1.0, 1.0, 2.5]) for _ in v])))
        else:
            v, w = r.choice(sets)
            drop = r.randrange(len(v))
            sets.append((np.delete(v, drop), np.delete(w, drop)))
    links = weighted_minhash.spanning_links(sets, list(range(60)), 0.8)
    up = list(range(60))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(60):
        for b in range(a):
            if weighted_minhash.weighted_jaccard(sets[a], sets[b]) >= 0.8:
                up[top(a)] = top(b)
    want = {frozenset(i for i in range(60) if top(i) == t) for t in map(top, range(60))}
    up = list(range(60))
    for a, b in links:
        assert weighted_minhash.weighted_jaccard(sets[a], sets[b]) >= 0.8
        up[top(a)] = top(b)
    assert {frozenset(i for i in range(60) if top(i) == t) for t in map(top, range(60))} == want


def test_chains_in_one_bucket(spark):
    """A-B and B-C are alike, A-C not: every pair of a bucket counts, also where neither text leads it."""
    import numpy as np

    rows = []
    for i in range(40):
        w = [f"w{i}x{j}" for j in range(104)]
        w2 = [f"p{i}x{j}" for j in range(10)] + w[10:]
        rows += [" ".join(w), " ".join(w2), " ".join(w2[:-10] + [f"q{i}x{j}" for j in range(10)])]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    named = d.select(F.xxhash64("text").alias("node"), F.col("doc_id").alias("doc"), "text")
    none = spark.sparkContext.broadcast(weighted_minhash.Idf(np.zeros(0, np.uint64), np.zeros(0)))
    key = {r.doc: r.bands[0] for r in weighted_minhash._sign(named, none, 1, 1).collect()}
    node = {r.doc: r.node for r in named.select("doc", "node").collect()}
    want, led = {}, 0
    for a in range(0, 120, 3):
        up = {x: x for x in range(a, a + 3)}
        for x, y in ((a, a + 1), (a + 1, a + 2)):
            if key[x] == key[y]:
                up = {z: up[x] if t == up[y] else t for z, t in up.items()}
        want |= up
        led += len({key[x] for x in up}) == 1 and min(up, key=node.get) != a + 1
    assert led > 5
    assert {r.doc_id: r.class_id for r in weighted_minhash.near_duplicates(d, bands=1, rows=1).collect()} == want


def test_units_hold_every_pair_of_two_classes(spark, monkeypatch):
    """A family of edited texts around 0.8, one bucket, tiny blocks: the same classes as all pairs give."""
    r = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    body = []
    for _ in range(40):
        w = list(base)
        for _ in range(r.choice((0, 1, 1, 2, 3))):
            w[r.randrange(len(w))] = f"x{r.randrange(30)}"
        body.append(" ".join(w))
    d = spark.createDataFrame(list(enumerate(body)), "doc_id long, text string")
    grams = [Counter(tuple(t.split()[i : i + 5]) for i in range(56)) for t in body]
    frequency = Counter(g for c in grams for g in c)
    weigh = {g: weighted_minhash.idf_weight(n / len(body)) for g, n in frequency.items()}
    total = lambda c: sum(weigh[g] * n for g, n in c.items())
    up = list(range(len(body)))
    top = lambda x: x if up[x] == x else top(up[x])
    for i in range(len(body)):
        for j in range(i):
            if total(grams[i] & grams[j]) >= 0.8 * total(grams[i] | grams[j]) - 1e-9 and top(i) != top(j):
                up[max(top(i), top(j))] = min(top(i), top(j))
    want = {frozenset(i for i in range(len(body)) if top(i) == c) for c in map(top, range(len(body)))}
    for rows in (3, 512):
        monkeypatch.setattr(weighted_minhash, "BLOCK_ROWS", rows)
        found = {x.doc_id: x.class_id for x in weighted_minhash.near_duplicates(d, bands=60, rows=1).collect()}
        assert {frozenset(i for i in found if found[i] == c) for c in found.values()} == want


def test_weighted_samples_estimate_similarity():
    import numpy as np

    g = np.random.default_rng(2)
    v = np.unique(g.integers(0, 1 << 50, 400, dtype=np.uint64))
    wa, wb = g.choice([0.5, 1.0, 2.0, 3.0], len(v)), g.choice([0.5, 1.0, 2.0, 3.0], len(v))
    sampler = weighted_minhash.Sampler(2000, 1)
    a = sampler.signatures(np.array([0]), v, wa)[0]
    b = sampler.signatures(np.array([0]), v, wb)[0]
    assert abs((a == b).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.04


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_sharding(spark, docs, empty, shards):
    out = sharding.assign_shards(docs, shards=shards)
    rows = out.collect()
    assert len(rows) == docs.count()
    where, sizes = {}, Counter()
    for r in rows:
        body = (r.row.text or "").encode()
        assert r.size == len(body) + 8 and r.text_crc32 == zlib.crc32(body)
        where.setdefault(r.row.text or "", set()).add(r.shard)
        sizes[r.shard] += r.size
    assert all(len(s) == 1 for s in where.values()) and max(sizes) < shards
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    # The capacity is the smallest: checked by trying all in a plain loop over the same ordered groups.
    atom = F.pmod(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), F.lit(sharding.ATOMS))
    groups = [r.b for r in docs.groupBy(atom.alias("a")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8).alias("b")).orderBy("a").collect()]

    def needed(c):
        n, held = 1, 0
        for g in groups:
            n, held = (n, held + g) if held + g <= c else (n + 1, g)
        return n

    lo, hi = max(groups), sum(groups)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if needed(mid) <= shards else (mid + 1, hi)
    assert max(sizes.values()) == lo or max(sizes.values()) <= lo and needed(max(sizes.values())) <= shards
    assert sharding.assign_shards(empty, shards=shards).count() == 0


def test_slots_of_a_split_group(spark):
    d = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    rows = sharding.assign_shards(d, shards=4, cell_rows=50).collect()
    for s in range(4):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))


def test_fingerprints(docs, empty):
    rows = fingerprints.edited_fingerprints(docs).collect()
    assert len(rows) == docs.count()
    given = [(r.doc_id if r.doc_id is not None else -(1 << 63), r.text or "") for r in docs.collect()]
    given.sort(key=lambda x: (-x[0], x[1].encode()))
    want = Counter()
    for i, (n, t) in enumerate(given):
        after = given[(i + 1) % len(given)][1]
        k = len(t) // 3
        e = t[: len(t) - k] + after[:k]
        want[(None if n == -(1 << 63) else n, len(t), hashlib.sha256(e.encode()).hexdigest())] += 1
    assert want == Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[0].fingerprint == by[1].fingerprint != by[2].fingerprint
    assert by[5].fingerprint == "" and by[5].near_edited == 1.0
    assert fingerprints.edited_fingerprints(empty).count() == 0


def test_sketches_merge_and_estimate(spark, docs):
    import numpy as np
    import pyarrow as pa

    body = texts()[12]
    half = len(body) // 2
    whole, a, b = fingerprints.sketches(pa.array([body, body[:half], body[half:]]))
    assert 0.9 < np.isin(fingerprints.merge(a, b), whole).mean() <= 1
    w = WORD.findall(low(body))
    true = len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    assert abs(fingerprints.distinct(whole) / true - 1) < 0.25
    assert fingerprints.containment(a, whole) > 0.9
    assert (fingerprints.decode(fingerprints.encode(whole)) == whole).all()
    parts = fingerprints.fingerprint(docs, keep=["lang", "doc_id"])
    merged = {r.lang: r.fingerprint for r in fingerprints.merge_fingerprints(parts, "lang").collect()}
    want = np.zeros(0, np.uint64)
    for r in parts.collect():
        want = fingerprints.merge(want, fingerprints.decode(r.fingerprint))
    assert merged == {"en": fingerprints.encode(want)}


def test_decontamination(spark, docs, empty):
    w = WORD.findall(low(texts()[11]))
    items = [("b", " ".join(w[40:70])), ("a", "ONE, two"), ("c", None), ("d", "..."), ("e", "nowhere to be found at all"), ("f", texts()[0])]
    bench = spark.createDataFrame(items, "item_id string, text string")

    def expected(text):
        doc = WORD.findall(low(text or ""))
        hit, own = set(), set()
        for name, t in items:
            it = WORD.findall(low(t or ""))
            wins = [it[i : i + 13] for i in range(max(1, len(it) - 12))] if it else []
            for x in wins:
                for i in range(len(doc) - len(x) + 1):
                    if doc[i : i + len(x)] == x:
                        hit |= set(range(i, i + len(x)))
                        own.add(name)
        return len(doc), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(doc)

    want = Counter((r.doc_id, *expected(r.text)) for r in docs.collect())
    for block in (decontaminate.BLOCK_WORDS, 60):
        got = Counter(tuple(r) for r in decontaminate.contamination_digest(docs, bench, block_words=block).collect())
        assert got == want
    assert decontaminate.contamination_digest(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination_digest(docs, bench.limit(0)).collect())
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((r.doc_id, r.text) for r in docs.collect() if not expected(r.text)[4])
    near = decontaminate.find_near(docs, {"p": "two one", "q": "gamma1 beta2", "none": "nowhere one"}, 3).collect()
    assert {r.doc_id for r in near if r.phrase == "p"} == {7, 8} and not [r for r in near if r.phrase == "none"]
    for r in near:
        w = [WORD.findall(low(t)) for t in texts() if t]
        ends = {"p": {"two", "one"}, "q": {"gamma1", "beta2"}}[r.phrase]
        assert any(r.position < len(x) and x[r.position] in ends and ends <= set(x[max(0, r.position - 3) : r.position + 4]) for x in w)


def test_decontamination_items_without_and_of_one_id(spark):
    """Null ids hit but are not counted; rows of one id are one item; windows do not cross documents."""
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha"), (3, "beta gamma")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(None, "alpha beta"), ("x", "gamma"), ("x", "delta"), ("y", "alpha beta")], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.contamination_digest(docs, bench).collect()}
    digest = lambda ids: hashlib.sha256(ids.encode()).hexdigest()
    assert got == {1: (4, 4, 2, digest("x,y")), 2: (1, 0, 0, digest("")), 3: (2, 1, 1, digest("x"))}


def test_index_holds_every_word(spark, docs):
    import numpy as np

    index = decontaminate.stage(decontaminate.build_index(docs), "postings")
    counted = decontaminate.document_frequencies(index).agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.count("*").alias("n")).first()
    words_ = [WORD.findall(low(r.text or "")) for r in docs.collect()]
    assert counted.cf == sum(map(len, words_)) and counted.df == sum(len(set(w)) for w in words_) and counted.n == len({x for w in words_ for x in w})
    lists = [np.frombuffer(r.places, np.int32) for r in index.filter("term is not null").collect()]
    assert all((np.diff(p) > 0).all() for p in lists)


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    for chunk in (token_counts.CHUNK, 7):
        rows = token_counts.token_counts(docs.filter("length(text) < 5000 or text is null"), tokenizer_path(), keep=["doc_id", "text"], chunk=chunk).collect()
        assert len(rows) == docs.filter("length(text) < 5000 or text is null").count()
        for r in rows:
            assert r.n_tokens == len(lib.encode(r.text or "", add_special_tokens=False).ids)
            assert r.n_bytes == len((r.text or "").encode())
    assert token_counts.over_limit(docs, tokenizer_path()).filter("over_limit").count() == 1
    assert token_counts.over_limit(empty, tokenizer_path()).count() == 0


def test_transducer_agrees_with_library():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(tokenizer_path()), token_counts.TokenCounter(open(tokenizer_path(), encoding="utf-8").read())
    r = random.Random(1)
    pool = "abcdefghijklmnopqrstuvwxyzABCÉéßñİΣσςıſK0123456789 '’s  ́\x1c\x85_-.,!?中文字𐍈😀<|>"
    for _ in range(3000):
        t = "".join(r.choice(pool) for _ in range(r.randrange(60)))
        maps = [own.chunk_map(t[i : i + 7]) for i in range(0, max(1, len(t)), 7)]
        left = maps[0]
        for m in maps[1:]:
            left = own.compose(left, m)
        right = maps[-1]
        for m in maps[-2::-1]:
            right = own.compose(m, right)
        want = len(lib.encode(t, add_special_tokens=False).ids)
        assert own.text(t) == own.finish(left) == own.finish(right) == want


def test_secrets(spark, docs, empty):
    r = random.Random(9)
    key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    cases = [
        ('é password = "abcdefabcdef12"', 1, 0, 0), (
            "API_KEY:'short' token: abcdefghijkl", 1, 0, 0,
        ), ("AKIAABCDEFGHIJKLMN and AKIA12", 0, 1, 0), ("x0123456789abcdef0123y deadbeef", 0, 0, 1),
        (None, 0, 0, 0), ("", 0, 0, 0), ("ſecret: abcdefghijkl", 0, 0, 0), ("TOKEN=0123456789abcdef", 1, 0, 1), (f"the auth header was {key} then", 0, 0, 0), ("the auth header was document.getElementById2 then", 0, 0, 0),
    ]
    d = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")
    for row, c in zip(secrets.scan(d, keep=["doc_id"]).orderBy("doc_id").collect(), cases, strict=True):
        assert (row.n_assign, row.n_access, row.n_hex) == c[1:]
        text, found = c[0] or "", []
        for k, (name, p, least) in enumerate(
            (
                ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
                ("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16),
            )
        ):
            found += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(p, text) if len(m.group(2 if k == 0 else 0)) >= least]
        assert row.base_sha256 == hashlib.sha256(",".join(x[2] for x in sorted(found)).encode()).hexdigest()
        if c[0] and key in c[0]:
            assert row.spans == f"novel:{c[0].index(key)}:{c[0].index(key) + 40}"
        else:
            assert row.n_novel == 0
    assert secrets.scan(empty, keep=["doc_id"]).count() == 0
    assert secrets.scan(docs, keep=["doc_id"]).count() == docs.count()


def test_even_shards_beside_a_hot_text(spark):
    """One text with 30 % of the bytes fills a shard; the others share the rest evenly, not greedily."""
    r = random.Random(8)
    small = ["".join(r.choice("abcdefgh ") for _ in range(r.randrange(60, 140))) for _ in range(2000)]
    rows = [(i, t) for i, t in enumerate(small)] + [(9999, "z" * int(sum(map(len, small)) * 3 / 7))]
    out = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = sorted(x.b for x in out)
    rest = sum(sizes[:-1]) / 23
    assert len(sizes) == 24 and 0.85 * rest < sizes[0] and sizes[-2] < 1.15 * rest


def test_novel_strings_against_brute_force():
    """Every string in context, whole, on both sides, by a plain loop over the definition."""
    r = random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    key = lambda n, of: "".join(r.choice(of) for _ in range(n))
    made = [
        "the", "auth", "token", "credential", "is", "=", "\n", "# api key", "straightforwardly", "é", "Bearer", "secret: abcdefabcdef12",
        "document.getElementById2", "x" * 70, "getElementByIdAndClassName", "AbCdEfGhIjKlMnOp",
    ]
    for _ in range(150):
        text = " ".join(r.choice([*made, key(40, letters + "0123456789"), key(60, letters), "my_token/" + key(30, letters + "0123456789")]) for _ in range(r.randrange(1, 14)))
        base = secrets.base_spans(text)
        words_ = [m.span() for m in secrets.CONTEXT.finditer(text)]
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_=.-]{12,}", text):
            a, b = m.span()
            around = any(y <= a <= y + 40 for _, y in words_) or any(b <= x <= b + 40 and "\n" not in text[b:x] for x, _ in words_)
            spans = [(a, b)]
            if not around:
                cut = sorted((x, y) for x, y in words_ if x < b and y > a)
                edges = [a] + [e for w in cut for e in w] + [b]
                spans = [(x, y) for x, y in zip(edges[::2], edges[1::2], strict=True) if y - x >= 12] if cut else []
            for x, y in spans:
                free = not any(p < y and x < q for p, _, q in base)
                pairs = [(c, d) for c, d in zip(text[x:y], text[x + 1 : y], strict=False) if c.isalpha() and d.isalpha()]
                mixed = len(pairs) >= 11 and sum(c.islower() != d.islower() for c, d in pairs) >= 0.3 * len(pairs)
                if free and (mixed or re.search("[0-9]|[A-Za-z]{32}", text[x:y])) and secrets.novelty(text, x, y) >= secrets.NOVELTY:
                    want.append((x, "novel", y))
        assert secrets.novel_spans(text, base) == want


def test_long_and_lettered_secrets():
    r = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    long, alone = "".join(r.choice(letters + "0123456789") for _ in range(5000)), "".join(r.choice(letters) for _ in range(60))
    forty = long[:40]
    for text, spans in (
        (f"credential is {long} end", [(14, 5014)]), (f"auth placeholder-word {forty} x", [(22, 62)]), (f"bearer {alone}", [(7, 67)]), (f'x = "{forty}"  # api key', []),
        ("auth AbCdEfGhIjKlMnOpQrStUvWxYz", [(5, 31)]), ("bearer abC/dEfGhQwRtY+uIoPasDfGhJkLzXcVbNmQwErTyUiOpAsDfGh/jK", [(7, 61)]),
        ("the token document.getElementByIdAndClassName and auth docs/Authentication/OverviewPage.html", []),
        (f'x = "{forty}"  # api_key', [(5, 45)]), (
            "notwithstanding token straightforwardly tokenization of internationalization", [],
        ), (f'credential_rotation_policy = "{forty}"', [(30, 70)]),
    ):
        assert [(a, b) for a, _, b in secrets.novel_spans(text, secrets.base_spans(text))] == spans


def test_mixing(spark, docs, empty):
    out = mixing.mix(docs, block_rows=2).collect()
    assert len(out) == docs.count() and len({r.position for r in out}) == len(out)
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, None: 0.05}
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("elt(id % 8 + 1, 'a','a','a','a','b','b','c',null)").alias("source"))
    rows = mixing.mix(d, weights, block_rows=4, cell_rows=100).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.slot, (r.row.source, set()))[1].add(r.block)
        assert r.release <= r.slot < r.deadline
    blocks, frame = mixing.shares({"n" if k is None else f"s:{k}": w for k, w in weights.items()})
    end = min(max(s for s, (k, _) in slots.items() if k == name) for name in weights)
    done = Counter()
    for t in range(end):
        if t in slots:
            done[slots[t][0]] += 1
        for name in weights:
            assert abs(done[name] - (t + 1) * blocks["n" if name is None else f"s:{name}"] / frame) < 1
    assert mixing.mixed_documents(empty).count() == 0
    assert mixing.mixture(docs).columns == docs.columns
    again = {(r.row.doc_id, r.position) for r in mixing.mix(d, weights, block_rows=4, cell_rows=100).collect()}
    assert again == {(r.row.doc_id, r.position) for r in rows}


def test_mixing_keeps_target_weights_over_many_slots(spark):
    """Thirds are no whole number of 1024ths, and 0.0001 is less than one: 6,000 blocks, each by its own weight."""
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("elt(id % 3 + 1, 'a', 'b', 'c')").alias("source"))
    d = d.unionByName(spark.createDataFrame([(6000, "d")], "doc_id long, source string"))
    weights = {"a": 0.3333, "b": 0.3333, "c": 0.3333, "d": 0.0001}
    done = Counter()
    for r in sorted(mixing.mix(d, weights, block_rows=1, cell_rows=100).collect(), key=lambda r: r.slot):
        done[r.row.source] += 1
        for name in "abc" if r.slot < 5900 else "":  # until the first runs out
            assert abs(done[name] - (r.slot + 1) * weights[name]) < 1.001
    assert done == {"a": 2000, "b": 2000, "c": 2000, "d": 1}


def test_segments_of_a_mixture_are_the_whole_schedule():
    """What has run before any cut is what one pass over all slots has run; segments from there make the same slots."""
    import random

    rnd = random.Random(3)
    for _ in range(25):
        weights = {f"s{i}": rnd.choice((rnd.random(), rnd.randint(1, 9) / 10, 0.02 + rnd.random() ** 4)) for i in range(rnd.randint(1, 15))}
        parts, total = mixing.shares(weights)
        blocks = {s: rnd.randint(0, 15) for s in parts}
        whole = list(mixing.edf(parts, total, dict.fromkeys(parts, 10**9), 0, 900))
        for cut in rnd.sample(range(900), 12):
            done = Counter(s for s, *_ in whole[:cut])
            assert mixing.run_before(parts, total, cut) == {s: done[s] for s in parts}
        own = list(mixing.edf(parts, total, blocks))
        size = rnd.randint(20, 200)
        end = max((r[2] for r in own), default=-1) + 1
        assert own == [r for t in range(0, end, size) for r in mixing.edf(parts, total, blocks, t, t + size)]
        many, slots = mixing.segments(parts, total, blocks, None, 7)
        assert many * slots >= end and (not many or slots >= total / min(parts.values()))
        assert sum(blocks.values()) == len(own)


def test_mixture_of_many_segments(spark):
    d = spark.range(5000).select(F.col("id").alias("doc_id"), F.expr("elt(id % 8 + 1, 'a','a','a','a','b','b','c',null)").alias("source"))
    weights = {"a": 0.2, "b": 0.3, "c": 0.15, None: 0.05}
    options = {"weights": weights, "block_rows": 4, "cell_rows": 100}
    placed = lambda **more: sorted((r.position, r.row.doc_id, r.chosen) for r in mixing.mix(d, **options, **more).filter("slot is not null").collect())
    whole = placed(segment_slots=10**9)
    assert placed(segment_slots=1) == whole and len(whole) == 5000
    kept = [x for x in whole if x[2]]
    assert placed(segment_slots=50, whole=False) == kept and 0 < len(kept) < 5000
    assert sorted(r.doc_id for r in mixing.mixture(d, **options, segment_slots=50).collect()) == sorted(x[1] for x in kept)


def test_a_tiny_weight_with_many_rows(spark):
    """Two million slots before the last block; the mixture makes its own 26 alone."""
    d = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("if(id < 320, 'a', 'b')").alias("source"))
    weights = {"a": 1.0, "b": 0.000001}
    parts, total = mixing.shares({"s:a": 1.0, "s:b": 0.000001})
    assert mixing.segments(parts, total, {"s:a": 20, "s:b": 5}, 25)[0] == 1
    assert {r.source for r in mixing.mixture(d, weights=weights).collect()} == {"a"}


def test_warc(spark):
    import base64

    trap = "<p>WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n</p>"
    pages = [
        (1, "http://a", "same"), (2, "http://b\r\nX: y", "same"), (3, None, trap), (4, "u", None), (5, "u", ""), (6, "u", "é" * 50_000),
        (7, "u", trap), (8, "u", "WARC/1.1\r\n"), (2, "http://b", "same"), (None, "u", "same"),
    ]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    rows = warc.archive_round_trip(d).collect()
    assert len(rows) == len(pages)
    largest = {}
    for n, _, h in pages:
        largest[h or ""] = max(largest.get(h or "", -1), n if n is not None else -1)
    want = Counter()
    for n, _, h in pages:
        body = (h or "").encode()
        first = n == largest[h or ""]
        want[(n, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else largest[h or ""])] += 1
    assert Counter(tuple(r) for r in rows) == want
    alone = warc.archive_round_trip(d, least=10**6).collect()
    assert {r.record_type for r in alone} == {"response"} and len(alone) == len(pages)
    assert warc.archive_round_trip(d.limit(0)).count() == 0


def test_warc_chain_across_splits(spark, tmp_path):
    pages = spark.range(300).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url"),
        F.concat(F.repeat(F.lit("x"), (F.col("id") * 7 % 900).cast("int")), F.lit("WARC/1.1\r\n"), F.col("id").cast("string")).alias("html"),
    )
    warc.write_archives(pages.coalesce(1), str(tmp_path / "w"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        rows = warc.read_archives(spark, str(tmp_path / "w")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.page_id for r in rows) == list(range(300)) and all(r.digest_matches for r in rows)


CALLS = "conversation long, id string, after string, name string, arguments string"
RESULTS = "conversation long, id string, content string"


def test_chat(spark):
    calls = [
        (1, "a", None, "ask", '{"turn": 1, "prompt": "x"}'), (1, "b", "a", "ask", '{"prompt": "", "turn": 1.0}'), (1, "c", "b", "ask", "{bad"),
        (2, "p", "q", "ask", None), (2, "q", "p", "other", "{}"), (2, "r", "q", "ask", "{}"), (3, None, None, "ask", "{}"),
        (1, "a", None, "ask", '{"turn": 1, "prompt": "x"}'),
    ]
    results = [(1, "a", "done"), (1, "zz", "lost"), (1, "b", None), (1, "a", "done")]
    rows = chat.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), chat.SCHEMAS).collect()
    out = {x.id: x for x in rows if x.state != "repeat"}
    assert len(rows) == 10 and len(out) == 8
    assert [x.id for x in rows if x.state == "repeat"] == ["a", "a"]
    assert [out[k].depth for k in "abc"] == [0, 1, 2] and out["p"].depth is None
    assert {k: x.state for k, x in out.items()} == {
        "a": "linked", "b": "linked", "c": "missing", "p": "cycle", "q": "cycle", "r": "cycle", None: "missing", "zz": "orphan",
    }
    assert out["a"].valid and out["b"].problems == "$.prompt: length 0" and out["c"].problems == "not JSON" and out["q"].problems == "unknown tool"
    assert out["a"].line == '{"after":[],"call":{"arguments":{"prompt":"x","turn":1},"name":"ask"},"depth":0,"id":"a","position":0,"result":"done","state":"linked"}'
    deep = spark.range(500).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id % 2 = 0, 'user', 'assistant')").alias("role"),
        F.col("id").cast("string").alias("text"), F.lit("x").alias("state"), F.lit(1).alias("key"),
    )
    found = {x.id: x for x in chat.format_conversations(deep).collect()}
    assert len(found) == 250 and all(x.state == "linked" and x.depth == x.position == int(k.split("-")[1]) // 2 for k, x in found.items())
    assert chat.format_conversations(deep.limit(0)).count() == 0


def test_chat_takes_any_arguments(spark):
    """Text that is not JSON, too deep, too large or not Unicode neither ends the job nor is lost."""
    given_ = [
        '{"a": NaN}', '{"a": 1e400}', '{"a": -Infinity}', '{"prompt": "\\ud800", "turn": 1}', "[" * 200_000, "", '"' + "x" * 2_000_000 + '"',
        "1" * 5000, '{"turn": 1' + "0" * 400 + ', "prompt": "x"}', "[" * 900 + "]" * 900,
    ]
    calls = [(1, str(i), None, "ask", a) for i, a in enumerate(given_)]
    results = [(1, "0", "x" * 1_000_000), (None, "0", "of no conversation"), (2, None, None), (1, "1", "")]
    rows = chat.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), chat.SCHEMAS).collect()
    out = {x.id: x for x in rows if x.conversation == 1}
    assert len(out) == len(given_) and len(rows) == len(given_) + 2
    for i in (0, 1, 2, 4, 5, 7):
        assert not out[str(i)].valid and json.loads(out[str(i)].line)["call"]["arguments"] == given_[i]
    assert out["3"].valid and "\\ud800" in out["3"].line and out["8"].valid
    assert out["6"].problems == "$: not object" and out["4"].problems in ("nested too deeply", "not JSON")
    assert len(json.loads(out["0"].line)["result"]) == 1_000_000 and json.loads(out["1"].line)["result"] == ""
    assert {(x.conversation, x.id, x.state) for x in rows if x.conversation != 1} == {(None, "0", "orphan"), (2, None, "orphan")}


@pytest.mark.parametrize("seed", range(3))
def test_chat_against_brute_force(spark, seed):
    """Random call graphs of several conversations that share identifiers, with cycles, repeats and lost results."""
    r = random.Random(seed)
    calls, results = [], []
    for conv in (1, 2, None):
        ids = [f"i{k}" for k in range(25)]
        for k, name in enumerate(ids):
            earlier = r.sample(ids[:k], min(k, r.choice((0, 1, 1, 1, 2, 3))))
            after = earlier + (["nowhere"] if r.random() < 0.1 else []) + ([r.choice(ids)] if r.random() < 0.04 else [])
            calls.append((conv, name, after, "ask", '{"turn":%d,"prompt":"x"}' % k))
            if r.random() < 0.1:
                calls.append((conv, name, [], "ask", '{"turn":%d,"prompt":"y"}' % k))
            results += [(conv, name, f"done {conv} {k} {n}") for n in range(r.choice((0, 1, 1, 1, 2)))]
        results.append((conv, "lost", "x"))
    calls.append((1, None, ["i0"], "ask", "{}"))
    r.shuffle(calls)
    c = spark.createDataFrame(calls, "conversation long, id string, after array<string>, name string, arguments string").repartition(3)
    got = chat.link_tool_calls(c, spark.createDataFrame(results, RESULTS), chat.SCHEMAS, cell_rows=4).collect()

    best = {}
    for conv, name, after, tool, arguments in calls:
        if name is not None:
            row = (sorted(set(after)), tool, arguments)
            best[conv, name] = min(best.get((conv, name), row), row)
    answer = {}
    for conv, name, content in results:
        answer[conv, name] = min(answer.get((conv, name), content), content)

    def depth(node, seen=()):
        if node in seen:
            return None
        found = [depth((node[0], p), (*seen, node)) for p in best[node][0] if (node[0], p) in best]
        return None if None in found else 1 + max(found, default=-1)

    want = Counter()
    for node, (after, _, _) in best.items():
        d = depth(node)
        want[*node, d, "cycle" if d is None else "linked" if node in answer else "missing", answer.get(node)] += 1
    want.update((*node, None, "orphan", content) for node, content in answer.items() if node not in best)
    spare = len([1 for x in calls if x[1] is not None]) - len(best) + len(results) - len(answer)
    main = [x for x in got if x.state != "repeat" and x.id is not None]
    assert Counter((x.conversation, x.id, x.depth, x.state, json.loads(x.line)["result"]) for x in main) == want
    assert sum(x.state == "repeat" for x in got) == spare and sum(x.id is None for x in got) == 1
    for conv in (1, 2, None):
        own = sorted((x.position, x.depth, x.id) for x in main if x.conversation == conv and x.depth is not None)
        assert [p for p, _, _ in own] == list(range(len(own))) and [d for _, d, _ in own] == sorted(d for _, d, _ in own)
        place = {name: p for p, _, name in own}
        assert all(place[p] < place[name] for name in place for p in best[conv, name][0] if p in place)


def test_quality(spark, docs, empty):
    good = " ".join(["The whole river and lake were calm, and the small boats came home before night."] * 3)
    bad = " ".join(["BUY!!! NOW$$$ ***CHEAP*** ###"] * 8)
    rows = [(i, (good if i % 2 else bad) + f" {i}", i % 2) for i in range(300)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1, rows[1][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(1, 1), (None, 1), (5000, 0)], "doc_id long, quality int")
    out = quality.score_documents(d, labels).collect()
    assert len(out) == 303
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id < 300:
            assert r.predicted == r.doc_id % 2
    assert len({r.score for r in out if r.doc_id == 1}) == 1
    assert quality.score_documents(docs, labels.limit(0)).filter("score <> 1").count() == 0
    assert quality.score_documents(empty.select("doc_id", "text"), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_gated_attention_by_plain_loops():
    """Forward pass bag by bag and passage by passage; gradients against differences of the loss."""
    import math

    import numpy as np

    r = np.random.default_rng(3)
    x = r.normal(size=(9, quality.FEATURES)).astype(np.float32)
    first = np.array([0, 1, 4, 9])
    net = quality.GatedAttention(x.mean(0), x.std(0) + 1e-3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    p = net.p
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        rows = [np.tanh(np.clip((v - net.mean) / net.scale, -6, 6) @ p["W"] + p["b"]) for v in x[a:b]]
        gate = [math.exp(sum(p["w"][j] * math.tanh(h @ p["V"][:, j]) / (1 + math.exp(-(h @ p["U"][:, j]))) for j in range(quality.ATTENTION))) for h in rows]
        z = sum(g * h for g, h in zip(gate, rows, strict=True)) / sum(gate)
        assert math.isclose(net.forward(x, first)["score"][i], 1 / (1 + math.exp(-(z @ p["c"] + p["d"][0]))), rel_tol=1e-6)
    label, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    loss = lambda: -(weight * (label * np.log(s := net.forward(x, first)["score"]) + (1 - label) * np.log(1 - s))).sum() / weight.sum()
    grads = net.gradients(net.forward(x, first), first, label, weight)
    for name, g in grads.items():
        flat = p[name].reshape(-1)
        for at in r.choice(len(flat), min(6, len(flat)), replace=False):
            held, step = flat[at], 1e-5
            flat[at] = held + step
            up = loss()
            flat[at] = held - step
            down = loss()
            flat[at] = held
            assert abs((up - down) / (2 * step) - g.reshape(-1)[at]) < 2e-4


def test_quality_learns_from_every_passage_and_any_id(spark):
    """A text of a hundred passages counts in full; ids are strings; held-out labels are met."""
    good = "The whole river and lake were calm, and the small boats came home before night. "
    bad = "BUY!!! NOW$$$ ***CHEAP*** ### "
    rows = [(f"id-{i}", (good * 13 * 100 if i == 4 else good * 6) if i % 2 else bad * 20, i % 2) for i in range(200)]
    d = spark.createDataFrame(
        [(i, t, 0.5, "x") for i, t, _ in rows] + [("long", (bad * 35 + good) * 100, 0.5, "x")],
        "doc_id string, text string, score double, __label string",
    )
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id string, quality int")
    out = {r.doc_id: r for r in quality.score_documents(d, labels).collect()}
    held = [i for i, _, _ in rows if out[i].held_out]
    assert held and all(out[i].predicted == q for i, _, q in rows)
    sizes = [r["n"] for r in quality._sample(d, labels, "doc_id", "text", "quality", 50, 300).join(d.selectExpr("doc_id as __key", "greatest(1, floor((length(text) + 512) / 1024)) as n"), "__key").collect()]
    assert 0 < len(sizes) <= 50 and sum(sizes) <= 300


def test_held_out_accuracy_on_the_test_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    met = quality.score_documents(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert len(met) > 50 and sum(r.predicted == r.quality for r in met) / len(met) >= 0.95


def test_near_duplicates_with_text_ids(spark, docs):
    named = docs.select(F.concat(F.lit("k"), "doc_id").alias("doc_id"), "text")
    by_number = {r.doc_id: r.class_id for r in weighted_minhash.near_duplicates(docs.filter("doc_id is not null and doc_id <> 7")).collect()}
    by_name = {r.doc_id: r.class_id for r in weighted_minhash.near_duplicates(named.filter("doc_id is not null and doc_id <> 'k7'")).collect()}
    groups = lambda found: {frozenset(str(i).strip("k") for i in found if found[i] == c) for c in found.values()}
    assert groups(by_number) == groups(by_name)
    assert weighted_minhash.drop_near_duplicates(named).columns == ["doc_id", "text"]


def test_shared_folder_is_no_local_one_on_a_cluster():
    from types import SimpleNamespace

    from lodestrata.llm import common

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        common.shared_dir(cluster)


def test_fingerprints_against_brute_force(spark):
    """Edited texts, sketches' likeness and counts against the sets of all shingles, on the whole small table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)

    def grams(text):
        w = WORD.findall(low(text))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    found = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    off = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        own, r = grams(t), found[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for got, other in ((r.near_edited, grams(edited)), (r.near_next, grams(after))):
            want = likeness(own, other)
            if len(own | other) <= fingerprints.K:
                assert abs(got - want) < 1e-9
            else:
                off.append(abs(got - want))
        assert r.n_shingles == len(own) if len(own) < fingerprints.K else abs(r.n_shingles / len(own) - 1) < 0.35
    assert off and max(off) < 0.15 and sum(off) / len(off) < 0.03


def test_staged_tables_can_be_cleared(spark, tmp_path):
    from types import SimpleNamespace

    from lodestrata.llm import common

    (tmp_path / "lodestrata" / "x").mkdir(parents=True)
    common.clear_staged(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: str(tmp_path)), sparkContext=spark.sparkContext))
    assert not (tmp_path / "lodestrata").exists() and tmp_path.exists()


def test_unset_shared_folder_is_one_temporary_folder_on_a_local_master():
    import os
    from types import SimpleNamespace

    from lodestrata.llm import common

    local = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="local[2]", applicationId="x"))
    assert common.shared_dir(local) == common.shared_dir(local) and os.path.isdir(common.shared_dir(local))


SCHEMA_CASES = [
    ({"enum": [1]}, [1, 1.0], [True, "1", [1]]),
    ({"const": 0}, [0, 0.0], [False, None]),
    ({"const": {"a": [1, {"b": True}]}}, [{"a": [1, {"b": True}]}], [{"a": [1, {"b": 1}]}, {"a": [True, {"b": True}]}, {}]),
    ({"pattern": "^a$"}, ["a", 5], ["zz", "ba"]),
    ({"minimum": 1, "maximum": 3}, [1, 3, "x"], [0, 3.5]),
    ({"exclusiveMinimum": 1, "exclusiveMaximum": 3}, [2, 1.1], [1, 3, 5]),
    ({"multipleOf": 0.1}, [0.3, 1, 0], [0.25]),
    ({"multipleOf": 3}, [9, 0, "x"], [10]),
    ({"uniqueItems": True}, [[1, "1", True], []], [[1, 1.0], [{"a": 1}, {"a": 1}]]),
    ({"items": {"type": "integer"}, "minItems": 1, "maxItems": 2}, [[1], [1, 2.0]], [[], [1, 2, 3], [1.5], [True]]),
    ({"type": ["null", "number"]}, [None, 1, 2.5], [True, "1"]),
    ({"type": "integer"}, [1, 2.0], [True, 1.5, "1"]),
    ({"minLength": 2, "maxLength": 3}, ["ab", "äöü"], ["a", "abcd"]),
    ({"required": ["a"], "properties": {"a": {"type": "string"}}, "additionalProperties": {"type": "boolean"}}, [{"a": "x"}, {"a": "x", "b": False}], [{}, {"a": 1}, {"a": "x", "b": 1}]),
    ({"additionalProperties": False, "minProperties": 0, "maxProperties": 1}, [{}], [{"a": 1}]),
    ({"minProperties": 1}, [{"a": 1}], [{}]),
    ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, [1, 2], [0, 3]),
    ({"anyOf": [{"type": "string"}, {"minimum": 5, "type": "number"}]}, ["x", 6], [4, None]),
    ({"oneOf": [{"multipleOf": 2}, {"multipleOf": 3}]}, [2, 3, 4], [6, 5]),
    ({"not": {"type": "null"}}, [1], [None]),
    ({"items": False}, [[]], [[1]]),
    (True, [1, None], []),
    (False, [], [1, None]),
    ({"title": "t", "format": "email", "description": "x"}, ["nothing"], []),
]


@pytest.mark.parametrize(("schema", "good", "bad"), SCHEMA_CASES)
def test_schema_keywords(schema, good, bad):
    chat.checked_schema(schema)
    assert [v for v in good if chat.violations(v, schema)] == []
    assert [v for v in bad if not chat.violations(v, schema)] == []


@pytest.mark.parametrize(
    "schema",
    [
        {"type": "date"}, {"$ref": "#/x"}, {"properties": {"a": {"typ": "string"}}}, {"items": [{"type": "string"}]}, {"pattern": "("}, {"multipleOf": 0}, {"minimum": "1"}, {"minLength": True},
        {"anyOf": [{"dependentRequired": {}}]}, 5, {"additionalProperties": {"if": {}}}, {"type": ["string", "integr"]},
    ],
)
def test_schemas_that_are_not_checked_are_refused(spark, schema):
    with pytest.raises(ValueError):
        chat.checked_schema(schema)
    calls = spark.createDataFrame([("c", "1", None, "tool", "{}")], "conversation string, id string, after string, name string, arguments string")
    with pytest.raises(ValueError):
        chat.link_tool_calls(calls, spark.createDataFrame([], "conversation string, id string, content string"), {"tool": schema})


def test_proposals_do_not_grow_with_the_parts(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(5_000)]
    common = "these very common words stand in many of all the texts"
    texts = [" ".join(r.choices(words, k=60)) + (" " + common if i % 4 == 0 else "") for i in range(1_000)]
    made = {}
    for parts in (1, 100, 1_000):
        df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts)
        found, docs = weighted_minhash.proposed(df, 0.05)
        made[parts] = {x.value for x in found.collect()}
        assert docs == 1_000 and len(made[parts]) < 300
        idf = weighted_minhash._frequent(df, 0.05)
        assert len(idf.values) == 7 and (idf.weights < 1).all()
    assert made[1] <= made[100] <= made[1_000]
    assert weighted_minhash.proposed(df.limit(0), 0.05)[1] == 0


def test_equal_benchmark_rows_count_once(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta end"), (2, "other words")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "beta gamma delta")] * 2_000 + [("b", "nothing of it")], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.find_contamination(docs, items, block_words=60).collect()}
    assert got[1]["items"] == ["a"] and got[2]["items"] == [] and sorted(got[1].hits) == [1, 2, 3]
