"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

Each text is a weighted set of five-word shingles, weight = tf * idf. The idf is the root of ln(1 + documents / document
frequency), so it falls with every further document that has the shingle; frequencies are exact counts of all shingles
over all rows, or, with copies_once, over groups of copies. Consistent weighted samples, banded, propose candidates; every candidate
is verified by the exact weighted Jaccard similarity of the whole texts (at least `similarity`).

Frequencies are counted in blocks of texts: a block sends each shingle that it has once, with its number of documents, to
one of COUNTERS counters, which sends back the sum over all blocks. No shingle is a row, and a frequent one is as many
numbers as there are blocks.

Where rows count, the copies of a text make what they share common and so weigh their edits against them: the larger a group, the
fewer of its near copies are found. With copies_once a group counts as one document: what its members share weighs as in one text, and
passages that different texts repeat still weigh less. Groups (see copy_groups) come from short sketches; a block sends a shingle with
the groups of its copies, and a counter counts each group once.

Work stays linear in a group's size: copies of one text are one node; a bucket's members are compared with
the bucket's leader only, and those that are not in its class after that go on with a new leader; leaders
with many members are salted. A bucket that still holds more than one class after ROUNDS leaders is compared
inside tasks with all its members, those of the leaders' classes too, through an inverted list over the
bucket's texts (in blocks of BLOCK_ROWS texts), which give out only the links that join two classes. So
no pair of a bucket is left unjudged but within one class, and no pairs are shuffled.

Classes are the connected components of the verified links, found by label propagation with pointer jumping
over staged tables. Nodes are 64-bit hashes of texts.

With BANDS x ROWS samples a pair of similarity 0.8 shares no band with a chance of 3 in 100,000.

Defined cases: null and wordless texts are never near-duplicates; wordless texts that are equal share a class, as
other equal texts do; null texts are each a class by themselves. Repeated rows each get a row. Ids may be of any type
with an order; a class is named by its smallest one, and null ids come before all others. Ties between leaders go by
the text's hash. Very long texts are compared whole. An empty table gives no rows. Further columns, whatever their
names, are not read, and drop_near_duplicates keeps them as they are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import shingles as S
from lodestrata.llm.common import partitions, stage

SIMILARITY = 0.8
BANDS, ROWS = 20, 4
COMMON = 0.05
ROUNDS = 2
BLOCK_WEIGHT, BLOCK_ROWS = 1_000_000, 256
SALT_ROWS = 256
#: Bytes of text in a block that asks for its shingles' frequencies, and the counters that the shingles are dealt to by their leading bits.
ASKED_BYTES, COUNTERS = 2 << 20, 1 << 10
BUCKET_ROWS = 250
#: Minima of a sketch, those of a band, and the share of them that members of a group have in common with its leader, at least.
MINIMA, BAND_MINIMA, GROUPED = 64, 4, 0.5
CANDIDATES = 1_000_000
CELLS = 1 << 17
#: Shingles that a task holds before it proposes from them.
PART_SHINGLES = 1_000_000
TABLE = 1 << 16

#: ln a is kept as a 16-bit number between these bounds; the samples' order is all that counts.
_LOW, _HIGH = -26.0, 6.0


class Sampler:
    """Consistent weighted samples with random variables from a table of TABLE fixed triples (r, ln c, beta)."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS) -> None:
        g = np.random.default_rng(20_240_607)
        self.r = g.gamma(2.0, 1.0, TABLE)
        self.ln_c = np.log(g.gamma(2.0, 1.0, TABLE))
        self.beta = g.random(TABLE)
        self.odd = g.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.bands, self.rows = bands, rows
        # For weight 1, t is 0 and ln a = ln c - r (1 - beta).
        self.unit = self._rank(self.ln_c - self.r * (1 - self.beta))
        # t is 0, and the sample that of weight 1, for all ln w from low up to high.
        self.low, self.high = (-self.r * self.beta).astype(np.float32), (self.r * (1 - self.beta)).astype(np.float32)

    @staticmethod
    def _rank(ln_a: np.ndarray) -> np.ndarray:
        return np.clip((ln_a - _LOW) * (65535 / (_HIGH - _LOW)), 0, 65535).astype(np.uint64) << np.uint64(48)

    def signatures(self, first: np.ndarray, value: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """A row of band keys for each set; first: where the sets begin (none is empty)."""
        ln_w = np.log(weight)
        below, above = np.flatnonzero(weight < 1), np.flatnonzero(weight > 1)
        ln_below, ln_above = ln_w[below].astype(np.float32), ln_w[above].astype(np.float32)
        name = value >> np.uint64(S.HASH_BITS - 48)
        folded = value ^ (value >> np.uint64(23))
        samples = np.empty((len(first), self.bands * self.rows), np.uint64)
        for k, odd in enumerate(self.odd):
            at = (folded * odd) >> np.uint64(48)
            key = self.unit[at] | name
            other = np.concatenate((below[ln_below < self.low[at[below]]], above[ln_above >= self.high[at[above]]]))
            if len(other):
                i = at[other]
                t = np.floor(ln_w[other] / self.r[i] + self.beta[i])
                ln_a = self.ln_c[i] - self.r[i] * (t - self.beta[i]) - self.r[i]
                moved = S.mix(value[other] + t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)
                key[other] = self._rank(ln_a) | np.where(t == 0, name[other], moved)
            samples[:, k] = np.minimum.reduceat(key, first) & np.uint64((1 << 48) - 1)
        keys = samples.reshape(len(first), self.bands, self.rows)
        out = np.full((len(first), self.bands), 0, np.uint64)
        for j in range(self.rows):
            out = S.mix(out * np.uint64(31) + keys[:, :, j] + np.arange(self.bands, dtype=np.uint64))
        return out


class Idf:
    """Weights of some shingles, as idf_weight gives them; _frequent makes one of a table's common shingles."""

    def __init__(self, values: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(values)
        self.values, self.weights = values[order], weights[order]

    def __call__(self, value: np.ndarray) -> np.ndarray | float:
        if not len(self.values):
            return 1.0
        i = np.minimum(np.searchsorted(self.values, value), len(self.values) - 1)
        return np.where(self.values[i] == value, self.weights[i], 1.0)


def idf_weight(frequency: float | np.ndarray, common: float = COMMON) -> float | np.ndarray:
    """Falls with every frequency: above 1 below the share `common` of the documents, about a half for a shingle in all.

    The root damps it: of two copies of one text the shared shingles are in more documents than those of the edit, so an
    undamped logarithm weighs edits against copies.
    """
    return np.sqrt(np.log1p(1 / frequency) / math.log1p(1 / common))


def proposed(texts: DataFrame, common: float) -> tuple[DataFrame, int]:
    """(value): the shingles that can be in the share `common` of the documents, none of them left out; and the number of documents.

    A shingle that is this frequent overall is so in some part of the rows, so each task proposes what is frequent in a part of its
    own. A small part proposes nearly all that it has; therefore tasks also count documents by the shingle's low bits. A cell of these counts is at
    least as large as that of any shingle in it, and only proposals of cells that reach the share over all rows stay, whatever the
    number and size of the parts. At most CELLS cells are broadcast.
    """
    mask = CELLS - 1

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, size, held = 0, 0, []
        cells = np.zeros(CELLS, np.int64)

        def rows(value: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(n.astype(np.int64))], names=["value", "n"])

        def flush() -> pa.RecordBatch:
            value = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            at = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, np.int64)
            keep = np.diff(np.append(at, len(value))) >= common * docs
            return rows(value[at][keep], np.zeros(keep.sum()))

        total = 0
        for batch in batches:
            for lo, hi, data, offsets in S.blocks(batch.column(0)):
                _, value, _ = S.shingles(data, offsets)
                held.append(value)
                cells += np.bincount((value & np.uint64(mask)).astype(np.int64), minlength=CELLS)
                docs, size, total = docs + hi - lo, size + len(value), total + hi - lo
                if size > PART_SHINGLES:
                    yield flush()
                    docs, size, held = 0, 0, []
        if docs:
            yield flush()
        some = np.flatnonzero(cells)
        yield rows(np.append(-2 - some, -1), np.append(cells[some], total))  # below -1: a cell; -1: documents

    found = stage(texts.mapInArrow(parts, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")), "frequent")
    docs = found.filter("value = -1").select("n").first()
    docs = docs["n"] if docs else 0
    large = found.filter((F.col("value") < -1) & (F.col("n") >= common * docs)).select((-2 - F.col("value")).alias("cell"))
    values = found.filter("value >= 0").select("value", F.col("value").bitwiseAND(F.lit(mask)).alias("cell"))
    return stage(values.join(F.broadcast(large), "cell", "left_semi").select("value"), "proposed"), docs


def _frequent(texts: DataFrame, common: float) -> Idf:
    """Exact document frequencies of all shingles in at least the share `common` of the documents: those proposed, counted over all rows.

    There are at most (shingles a document) / common frequent ones, whatever the number of documents.
    """
    found, docs = proposed(texts, common)
    values = found.count()
    runs = -(-values // CANDIDATES)
    kept: list[tuple[int, int]] = []
    for i in range(runs):  # one, unless texts hold a great many shingles
        share = found.filter(F.pmod(F.xxhash64("value"), F.lit(runs)) == i).select("value").collect()
        asked = texts.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in share], np.uint64)))

        def count(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            wanted = asked.value
            times = np.zeros(len(wanted), np.int64)
            for batch in batches:
                for _, _, data, offsets in S.blocks(batch.column(0)):
                    _, value, _ = S.shingles(data, offsets)
                    at = np.minimum(np.searchsorted(wanted, value), len(wanted) - 1)
                    times += np.bincount(at[wanted[at] == value], minlength=len(wanted))
            seen = np.flatnonzero(times)
            yield pa.RecordBatch.from_arrays([pa.array(wanted[seen].astype(np.int64)), pa.array(times[seen])], names=["value", "n"])

        counted = texts.mapInArrow(count, "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))
        kept += [(r["value"], r["n"]) for r in counted.filter(F.col("n") >= common * docs).collect()]
    return Idf(np.array([v for v, _ in kept], np.uint64), np.array([idf_weight(n / docs, common) for _, n in kept], np.float64))


def _shingles_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, times) of all the texts, by text, then shingle."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for lo, _, data, offsets in S.blocks(texts):
        doc, value, times = S.shingles(data, offsets)
        found.append((doc + lo, value, times))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def copy_groups(rows: DataFrame) -> DataFrame:
    """(node, label): the group of each text in rows (node, text) that has copies or near copies; other texts are not listed.

    A sketch holds the minima of MINIMA hashes of a text's shingles. Texts that share a band of them are held against the smallest node
    there and join it where the share GROUPED of the minima agree; groups are the connected components. No text is shuffled.
    """
    odd = np.random.default_rng(20_240_608).integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in S.blocks(batch.column(1)):
                doc, value, _ = S.shingles(data, offsets)
                first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
                least = np.empty((len(first), MINIMA), np.uint64)
                folded = S.mix(value)
                for k, by in enumerate(odd if len(first) else ()):
                    least[:, k] = np.minimum.reduceat(folded * by, first)
                ends = np.arange(len(first) + 1) * MINIMA
                nodes = batch.column(0).slice(lo, hi - lo).take(pa.array(doc[first]))
                yield pa.RecordBatch.from_arrays([nodes, _lists(S.mix(least).astype(np.uint16).view(np.int16).ravel(), ends)], names=["node", "sketch"])

    # A sketch follows from its text, so of a node's rows any one will do.
    sketched = rows.filter("text is not null").select("node", "text").mapInArrow(run, "node long, sketch array<short>")
    sketches = stage(sketched.groupBy("node").agg(F.count("*").alias("n"), F.first("sketch").alias("sketch")), "sketches")
    bands = F.array(*[F.xxhash64(F.lit(i), F.slice("sketch", i + 1, BAND_MINIMA)) for i in range(0, MINIMA, BAND_MINIMA)])
    spots = sketches.select("node", F.explode(bands).alias("bucket"))
    heads = spots.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1").drop("n")
    pairs = stage(spots.join(heads, "bucket").filter("node != leader").select("leader", F.col("node").alias("member")).distinct(), "sketch-pairs")
    # A leader's sketch goes once to each share of its members.
    shares = pairs.groupBy("leader").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("shares"))
    led = shares.join(sketches.select(F.col("node").alias("leader"), F.col("sketch").alias("own")), "leader")
    led = led.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    salted = pairs.join(shares, "leader").withColumn("salt", F.pmod(F.xxhash64("member"), F.col("shares")).cast("int")).drop("shares")
    met = salted.join(sketches.select(F.col("node").alias("member"), "sketch"), "member").join(led, ["leader", "salt"])
    agree = F.size(F.filter(F.zip_with("own", "sketch", lambda a, b: a == b), lambda x: x))
    labels = components(met.filter(agree >= math.ceil(GROUPED * MINIMA)).select(F.col("leader").alias("a"), F.col("member").alias("b")))
    return stage(sketches.select("node", "n").join(labels, "node", "left").filter("n > 1 or label is not null").select("node", F.coalesce("label", "node").alias("label")), "copy-groups")


def frequencies(homes: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """(block, counter, seen): for the texts of homes (block, text and others), the document frequencies of each block's distinct shingles in ascending order.

    copies (block, node, label): texts of homes that count as one document for each label, in whatever blocks they are.
    Shingles of one counter share their leading bits; the 40 bits below go there as 8 and 32.
    """
    rest = S.HASH_BITS - (COUNTERS.bit_length() - 1)

    def ask(block: int, texts: pa.Table, copies: pa.Table | None) -> pa.Table:
        doc, shingle, _ = _shingles_of(texts.column("text"))
        value, at = np.unique(shingle, return_inverse=True)
        counts, grouped = np.ones(len(texts), bool), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if copies is not None and len(copies):
            known, first = np.unique(copies.column("node").to_numpy(), return_index=True)
            node = texts.column("node").to_numpy()
            place = np.minimum(np.searchsorted(known, node), len(known) - 1)
            counts = known[place] != node
            label = copies.column("label").to_numpy()[first][place]
            theirs = ~counts[doc]
            pair = np.stack((at[theirs], label[doc[theirs]]), 1)
            pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
            grouped = pair[np.r_[True, (pair[1:] != pair[:-1]).any(1)][: len(pair)]].T
        n = np.bincount(at, counts[doc], len(value)).astype(np.int32)
        ends = np.searchsorted(value, np.arange(COUNTERS + 1, dtype=np.uint64) << np.uint64(rest))
        some = np.flatnonzero(np.diff(ends))
        ends = np.append(ends[some], len(value))
        of = np.searchsorted(grouped[0], ends)
        out = {
            "counter": pa.array(some.astype(np.int32)),
            "block": pa.array(np.full(len(some), block, np.int64)),
            "high": _lists((value >> np.uint64(32)).astype(np.uint8).view(np.int8), ends),
            "low": _lists(value.astype(np.uint32).view(np.int32), ends),
            "n": _lists(n, ends),
        }
        if copies is not None:
            out |= {"at": _lists((grouped[0] - np.repeat(ends[:-1], np.diff(of))).astype(np.int32), of), "label": _lists(grouped[1], of)}
        return pa.table(out)

    def count(asked: pa.Table) -> pa.Table:
        flat = lambda c: asked.column(c).combine_chunks().flatten().to_numpy()
        value = (flat("high").view(np.uint8).astype(np.uint64) << np.uint64(32)) | flat("low").view(np.uint32)
        distinct, at = np.unique(value, return_inverse=True)
        total = np.bincount(at, flat("n"), len(distinct)).astype(np.int64)
        ends = np.append(0, np.cumsum(asked.column("low").combine_chunks().value_lengths().to_numpy()))
        if "label" in asked.column_names:
            place = at[flat("at") + np.repeat(ends[:-1], asked.column("at").combine_chunks().value_lengths().to_numpy())]
            label = flat("label")
            order = np.lexsort((label, place))
            place, label = place[order], label[order]
            once = np.r_[True, (place[1:] != place[:-1]) | (label[1:] != label[:-1])][: len(place)]
            total += np.bincount(place[once], minlength=len(distinct))
        return pa.table({"block": asked.column("block"), "counter": asked.column("counter"), "seen": _lists(total.astype(np.int32)[at], ends)})

    # All columns go along, as the caller reads them in the same way: the texts are shuffled once for both.
    kind = "counter int, block long, high array<byte>, low array<int>, n array<int>"
    if copies is None:
        alone = lambda key, texts: ask(key[0].as_py(), texts, None)
        asked = homes.groupBy("block").applyInArrow(alone, kind)
    else:
        beside = lambda key, texts, copies: ask(key[0].as_py(), texts, copies)
        asked = homes.groupBy("block").cogroup(copies.groupBy("block")).applyInArrow(beside, f"{kind}, at array<int>, label array<long>")
    return asked.groupBy("counter").applyInArrow(count, "block long, counter int, seen array<int>")


def _sign(rows: DataFrame, idf, bands: int, rows_: int, groups: DataFrame | None = None) -> DataFrame:
    """(node, doc, bands, weight, weights) for rows (node, doc, text); no bands for a text without words.

    weights: of the text's shingles, in the order of S.shingles; weight: their sum. A shingle weighs what idf says, or by its
    frequency in these rows if idf does not know it, in units of the weight of a shingle that one document has. groups (node, label):
    texts that count as one document for each label.
    """
    size = rows.agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).alias("bytes")).first()
    docs, blocks = size["docs"], max(1, -(-(size["bytes"] or 0) // ASKED_BYTES))
    block = F.pmod(F.xxhash64("node", "doc"), F.lit(blocks))
    copies = None
    if groups is not None:
        theirs = stage(rows.filter("text is not null").select("node", block.alias("block")).join(groups, "node"), "copies")
        many = theirs.agg(F.count("*").alias("rows"), F.count_distinct("label").alias("groups")).first()
        docs, copies = docs - many["rows"] + many["groups"], theirs.distinct()
    homes = rows.filter("text is not null").select(block.alias("block"), "node", "doc", "text").repartition(max(partitions(rows.sparkSession), blocks // 16), "block")

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        sampler = Sampler(bands, rows_)
        doc, value, times = _shingles_of(texts.column("text"))
        seen = counts.sort_by("counter").column("seen").combine_chunks().flatten().to_numpy()
        known, idf_of = idf.value, idf_weight(seen / docs)
        distinct = np.unique(value)
        if len(known.values):
            common = np.isin(distinct, known.values)
            idf_of[common] = known(distinct[common])
        weight = times * (idf_of / idf_weight(1 / docs))[np.searchsorted(distinct, value)]
        ends = np.searchsorted(doc, np.arange(len(texts) + 1))
        has = np.diff(ends) > 0
        keys = np.concatenate(_in_slices(sampler, ends[:-1][has], value, weight)) if has.any() else np.zeros((0, bands), np.uint64)
        return pa.table({
            "node": texts.column("node"), "doc": texts.column("doc"), "bands": _lists(keys.view(np.int64).ravel(), np.append(0, np.cumsum(has * bands))),
            "weight": pa.array(np.bincount(doc, weight, len(texts))), "weights": _lists(weight, ends),
        })

    kind = rows.schema["doc"].dataType.simpleString()
    signed = homes.groupBy("block").cogroup(frequencies(homes, copies).groupBy("block")).applyInArrow(run, f"node long, doc {kind}, bands array<long>, weight double, weights array<double>")
    without = rows.filter("text is null").select("node", "doc", F.array().cast("array<long>").alias("bands"), F.lit(0.0).alias("weight"), F.array().cast("array<double>").alias("weights"))
    return signed.unionByName(without)


def _in_slices(sampler: Sampler, first: np.ndarray, value: np.ndarray, weight: np.ndarray, most: int = 1 << 16) -> list[np.ndarray]:
    """Signatures for slices that fit the processor's cache."""
    out, i, ends = [], 0, np.append(first, len(value))
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        a, b = ends[i], ends[j]
        out.append(sampler.signatures(first[i:j] - a, value[a:b], weight[a:b]))
        i = j
    return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets (ascending values, weights): sum of minima over sum of maxima."""
    total = a[1].sum() + b[1].sum()
    if not total:
        return 0.0
    i = np.searchsorted(a[0], b[0])
    i[i == len(a[0])] = 0
    both = a[0][i] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    least = np.minimum(a[1][i[both]], b[1][both]).sum()
    return float(least / (total - least))


def _weighted_sets(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shingles, weights) of each row of a batch with columns text and weights."""
    _, value, _ = _shingles_of(batch.column("text"))
    weights = batch.column("weights")
    ends = np.append(0, np.cumsum(weights.value_lengths().to_numpy()))
    flat = weights.flatten().to_numpy()
    return [(value[a:b], flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (leader, member) whose texts are similar enough.

    A leader's text is sent once to each of its shares of SALT_ROWS members, ahead of the members' texts.
    """
    spark = pairs.sparkSession
    shares = pairs.groupBy("leader").agg(F.ceil(F.count("*") / SALT_ROWS).alias("shares"))
    salted = pairs.join(shares, "leader").withColumn("salt", F.pmod(F.xxhash64("member"), F.col("shares")).cast("int"))
    members = salted.join(texts, F.col("member") == F.col("node")).select("leader", "salt", F.lit(1).alias("part"), "member", "text", "weights")
    heads = shares.withColumn("salt", F.explode(F.sequence(F.lit(0), (F.col("shares") - 1).cast("int")))).join(texts, F.col("leader") == F.col("node"))
    heads = heads.select("leader", "salt", F.lit(0).alias("part"), F.col("leader").alias("member"), "text", "weights")
    both = heads.unionByName(members).repartition(partitions(spark), "leader", "salt").sortWithinPartitions("leader", "salt", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            leaders, members = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            parts = batch.column(2).to_pylist()
            a, b = [], []
            for leader, member, part, own in zip(leaders, members, parts, _weighted_sets(batch), strict=True):
                if not part:
                    head = own
                elif weighted_jaccard(head, own) >= similarity:
                    a.append(leader)
                    b.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["leader", "member"])

    return both.mapInArrow(run, "leader long, member long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component, for every node in links (a, b).

    Each round a node takes the smallest label around it, then its label's label. A round's table is staged,
    so nothing is recomputed when an executor is lost; rounds grow with the logarithm of the diameter on
    paths and end after two or three on the stars that leaders make.
    """
    edges = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct(), "edges")
    labels = stage(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = stage(lower.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        labels = after.select("node", "label")
        if after.filter("was != label").isEmpty():
            return labels


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, idf: Idf | None = None, copies_once: bool = False) -> DataFrame:
    """One row a document: (doc_id, node, label, class_id).

    All shingles weigh by their frequency in df, but for those that idf names (frequent ones of a larger table, say). copies_once: a
    group of copies and near copies counts as one document in it.

    node: hash of the text; label: smallest node of the class (both null for a null text). class_id: smallest
    doc_id of the class; where an id is repeated with other texts, two classes may have the same.
    """
    spark = df.sparkSession
    source = df.select(F.when(F.col(text).isNotNull(), F.xxhash64(text)).alias("node"), F.col(key).alias("doc"), F.col(text).alias("text"))
    known = spark.sparkContext.broadcast(idf or Idf(np.zeros(0, np.uint64), np.zeros(0)))
    signed = stage(_sign(source, known, bands, rows, copy_groups(source) if copies_once else None), "signatures")
    nodes = signed.filter("node is not null").groupBy("node").agg(F.min(F.struct("bands", "weight")).alias("s")).select("node", "s.bands", "s.weight")
    spots = nodes.filter("size(bands) > 0").select(
        "node", "weight", F.posexplode("bands").alias("band", "key"),
    ).select("node", "weight", F.xxhash64("band", "key").alias("bucket"))
    # A bucket of many members is dealt in shares of BUCKET_ROWS; what is one row a bucket goes to each share.
    shared = spots.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("shares"))
    dealt = spots.join(shared, "bucket").withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int"))
    whole = left = stage(dealt.withColumn("label", F.col("node")), "buckets")
    # One row of each text, by its smallest id: copies of a text, however many, are not sent to its node's task.
    chosen = signed.groupBy("node").agg(F.min(F.struct("doc", "weights")).alias("s")).join(left.select("node").distinct(), "node", "left_semi")
    owned = lambda rows: rows.withColumn("owner", F.xxhash64("node", "doc"))  # noqa: E731  a null id has a hash too
    weights = owned(chosen.select("node", "s.doc", "s.weights")).select("owner", "node", "weights")
    texts = owned(source).join(weights, ["owner", "node"]).dropDuplicates(["owner", "node"])
    texts = stage(texts.select("node", "text", "weights"), "candidates")

    found: DataFrame | None = None
    labels: DataFrame | None = None
    for _ in range(ROUNDS):
        if left.isEmpty():
            break
        # The smallest node leads; the rest of the bucket, but for what is in its class by now, is held against it.
        led = left.join(_each_share(left, F.min("node").alias("leader")), ["bucket", "share"]).filter("node != leader")
        links = _verify(stage(led.select("leader", F.col("node").alias("member")).distinct(), "pairs"), texts, similarity)
        found = stage(links if found is None else found.unionByName(links), "links")
        labels = components(found.select(F.col("leader").alias("a"), F.col("member").alias("b")))
        named = _named(left, labels)
        first = _each_share(named, F.min(F.struct("node", "label")).alias("head"))
        left = stage(_open(named.join(first, ["bucket", "share"]).filter("label != head.label").drop("head")), "buckets")
    if found is not None:
        # Leaders judged only their own pairs: every member of a bucket of two classes or more is compared.
        mixed = stage(_open(_named(whole, labels)), "buckets")
        if not mixed.isEmpty():
            found = stage(found.unionByName(_rest(mixed, texts, similarity)), "links")
            labels = components(found.select(F.col("leader").alias("a"), F.col("member").alias("b")))

    rows_out = signed.select("node", "doc")
    alone = rows_out.filter("node is null").select(F.col("doc").alias(key), "node", F.col("node").alias("label"), F.col("doc").alias("class_id"))
    smallest = rows_out.filter("node is not null").groupBy("node").agg(F.min("doc").alias("doc"))
    if labels is None:
        by_node = smallest.select("node", F.col("node").alias("label"), F.col("doc").alias("class_id"))
    else:
        named = stage(smallest.join(labels, "node", "left").select("node", "doc", F.coalesce("label", "node").alias("label")), "classes")
        by_node = named.join(named.groupBy("label").agg(F.min("doc").alias("class_id")), "label").select("node", "label", "class_id")
    known = rows_out.filter("node is not null").join(by_node, "node").select(F.col("doc").alias(key), "node", "label", "class_id")
    return known.unionByName(alone)


def _each_share(rows: DataFrame, *values) -> DataFrame:
    """Aggregates of each bucket, repeated for each of its shares."""
    found = rows.groupBy("bucket").agg(F.max("shares").alias("shares"), *values)
    return found.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The buckets' rows with the labels that their nodes have by now."""
    return rows.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _open(rows: DataFrame) -> DataFrame:
    """The rows of the buckets that hold more than one class."""
    several = _each_share(rows, F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("bucket", "share")
    return rows.join(several, ["bucket", "share"])


def spanning_links(sets: list[tuple[np.ndarray, np.ndarray]], labels: list[int], similarity: float) -> list[tuple[int, int]]:
    """Links of enough similarity that join the sets' classes: a spanning forest, by position.

    One inverted list over all sets gives a set's overlaps with all others at once. The sets of the largest
    class are not looked up: each other set meets them.
    """
    value = np.concatenate([v for v, _ in sets])
    weight = np.concatenate([w for _, w in sets])
    owner = np.repeat(np.arange(len(sets)), [len(v) for v, _ in sets])
    order = np.argsort(value, kind="stable")
    value, weight, owner = value[order], weight[order], owner[order]
    total = np.array([w.sum() for _, w in sets])
    largest = np.array(labels) == Counter(labels).most_common(1)[0][0]
    up = {x: x for x in labels}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for i, (own, w) in enumerate(sets):
        if largest[i]:
            continue
        low, high = np.searchsorted(value, own), np.searchsorted(value, own, "right")
        n = high - low
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        both = np.bincount(owner[at], np.minimum(weight[at], np.repeat(w, n)), len(sets))
        alike = both >= similarity * (total + total[i] - both)
        alike[i:] &= largest[i:]
        for j in np.flatnonzero(alike).tolist():
            if (x := top(labels[i])) != (y := top(labels[j])):
                up[max(x, y)] = min(x, y)
                out.append((j, i))
    return out


def _rest(left: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (leader, member) that join the classes in the buckets, whatever the leaders' rounds missed.

    A bucket's members are compared with each other inside a task, so pairs are never rows. A bucket's largest
    class and the others are cut into blocks of at most about BLOCK_ROWS texts and BLOCK_WEIGHT shingles; a unit is
    a block of the largest class with one of the others, or two of the others. Members of the largest class need
    no comparison with each other, so a class of any size is sent once for each block of the others.
    """
    sums = left.groupBy("bucket", "label").agg(F.max("shares").alias("shares"), F.count("*").alias("n"), F.sum("weight").alias("w"))
    heads = sums.groupBy("bucket").agg(F.max("shares").alias("shares"), F.max(F.struct("n", "label", "w")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    blocks = lambda n, w: F.greatest(F.lit(1), F.ceil(n / BLOCK_ROWS), F.ceil(w / BLOCK_WEIGHT)).cast("int")
    heads = heads.select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("top.label").alias("top"),
        blocks(F.col("top.n"), F.col("top.w")).alias("large"), blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("apart"),
    )
    largest = F.col("label") == F.col("top")
    owned = left.join(heads, ["bucket", "share"]).withColumn("own", F.pmod(F.xxhash64("node"), F.when(largest, F.col("large")).otherwise(F.col("apart"))).cast("int"))
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    unit = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    across = F.when(largest, F.transform(up_to("apart"), lambda j: unit(F.col("own"), j))).otherwise(F.transform(up_to("large"), lambda i: unit(i, F.col("own"))))
    others = F.transform(F.filter(up_to("apart"), lambda x: ~largest & (x != F.col("own"))), lambda x: unit(-1 - F.least("own", x), F.greatest("own", x)))
    units = owned.select("bucket", F.explode(F.concat(across, others)).alias("u"), "node", "label").select("bucket", "u.i", "u.j", "node", "label")
    rows = units.join(texts, "node").repartition(partitions(left.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = None
        nodes, labels, sets = [], [], []

        def close() -> pa.RecordBatch:
            found = spanning_links(sets, labels, similarity) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([nodes[a] for a, _ in found], pa.int64()), pa.array([nodes[b] for _, b in found], pa.int64())], names=["leader", "member"],
            )

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "node", "label")), strict=True)
            for (bucket, i, j, node, label), own in zip(keys, _weighted_sets(batch), strict=True):
                if (bucket, i, j) != unit:
                    if sets:
                        yield close()
                    unit, nodes, labels, sets = (bucket, i, j), [], [], []
                nodes.append(node)
                labels.append(label)
                sets.append(own)
        if sets:
            yield close()

    return rows.mapInArrow(run, "leader long, member long")


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", copies_once: bool = False) -> DataFrame:
    """df with one row of each class: that of its smallest doc_id. Columns unchanged; null texts all stay."""
    found = near_duplicates(df, key, text, copies_once=copies_once).filter("label is not null").groupBy("label", F.col(key).alias("id"), "node").agg(F.count("*").alias("n"))
    first = F.struct(F.col("id").isNull(), "id", "node", "n")
    kept = stage(found.groupBy("label").agg(F.min(first).alias("k")).select("k.id", "k.node", "k.n"), "kept")
    whole = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__doc"), F.xxhash64(text).alias("__node"), F.col(key).alias("__id"),
        F.col(text).isNull().alias("__null"),
    )
    chosen = whole.filter("not __null").join(kept, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__node") == F.col("node")), "left_semi")
    if not kept.filter("n > 1").isEmpty():  # repeated rows: one of them
        chosen = chosen.groupBy("__id", "__node").agg(F.first("__doc").alias("__doc"))
    return chosen.select("__doc.*").unionByName(whole.filter("__null").select("__doc.*"))
