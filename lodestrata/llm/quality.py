"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages (about PASSAGE bytes of its text each, all of it, none left out). Each passage
is encoded as vector x of surface statistics: shares of byte classes, of class successions, word lengths,
word repeats and distinct words. The network is h = tanh(W x + b) for each passage, gated attention
a = softmax(w . (tanh(V h) * sigmoid(U h))), z = sum a h, score = sigmoid(c . z + d), learned from document
labels only. Labels, language, source and id are never inputs of a score.

Encoding and scoring run in Spark tasks over every document. The weights are fitted on the driver, on a sample of
labelled rows bounded by documented parameters: in the order of a hash of the id, rows of at most ROW_PASSAGES
passages are taken as long as they are SAMPLE rows and PASSAGES passages at most. Every passage of a taken row is
used; its statistics vectors are what leaves the executors, so what reaches the driver does not grow.

Defined cases: null counts as the empty text, one passage of zeros, and is scored like any other. Equal texts score
alike; very long ones are scored whole. Ids may be of any type; they match labels by their text form. Repeated rows
each get a row; labels of a repeated id are averaged, and in training an id counts once. Rows or labels without an
id are not trained on; ties in the order of hashes go by id. Without usable labels of both kinds every score is 1.0
or 0.0, as the only label there is (1.0 without any). An empty table gives no rows. Further columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm import shingles as S

PASSAGE = 1024
SAMPLE = 12_000
PASSAGES = 48_000
ROW_PASSAGES = 4_000
HIDDEN = 32
ATTENTION = 16
THRESHOLD = 0.3

#: Byte classes: 0 lower, 1 upper, 2 digit, 3 space, 4 line break, 5 .,;:'-, 6 !?, 7 |, 8 brackets and quotes, 9 other symbols, 10 non-ASCII, 11 control
CLASSES = 12
_CLASS = np.full(256, 11, np.uint8)
_CLASS[0x21:0x7F] = 9
_CLASS[0x61:0x7B] = 0
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x20, 0x09]] = 3
_CLASS[[0x0A, 0x0D]] = 4
_CLASS[[ord(c) for c in ".,;:'-"]] = 5
_CLASS[[ord(c) for c in "!?"]] = 6
_CLASS[ord("|")] = 7
_CLASS[[ord(c) for c in "()[]{}<>\""]] = 8
_CLASS[0x80:] = 10
FEATURES = CLASSES + CLASSES * CLASSES + 8


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage vectors of a block of texts, and the first passage number of each text (and the end)."""
    n = len(offsets) - 1
    length = np.diff(offsets)
    pieces = np.maximum(1, (length + PASSAGE // 2) // PASSAGE)
    first = np.concatenate(([0], np.cumsum(pieces)))
    owner = np.repeat(np.arange(n), pieces)
    k = np.arange(len(owner)) - first[owner]
    begin = offsets[owner] + k * length[owner] // pieces[owner]
    m = len(owner)
    if not len(data):
        return np.zeros((m, FEATURES), np.float32), first
    kind = _CLASS[data]
    size = np.diff(np.append(begin, len(data)))
    passage = np.repeat(np.arange(m), size)
    shares = np.bincount(passage * CLASSES + kind, minlength=m * CLASSES).reshape(m, CLASSES)
    same = passage[1:] == passage[:-1]
    steps = (passage[1:] * (CLASSES * CLASSES) + kind[:-1].astype(np.int64) * CLASSES + kind[1:])[same]
    steps = np.bincount(steps, minlength=m * CLASSES * CLASSES).reshape(m, -1)
    size = np.maximum(size, 1)[:, None]
    out = np.empty((m, FEATURES), np.float32)
    out[:, :CLASSES] = shares / size
    out[:, CLASSES : CLASSES * (CLASSES + 1)] = steps / size
    out[:, -8:] = _word_statistics(data, offsets, begin, m)
    return out, first


def _word_statistics(data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, m: int) -> np.ndarray:
    """By passage: log word count, mean and deviation of word length, shares of words equal to the one and the two before, of distinct words, of the most frequent word, of one-letter words."""
    out = np.zeros((m, 8))
    value, _ = S.words(data, offsets)
    if not len(value):
        return out
    inside = S._FOLD[data] != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] = inside[cuts]
    at = np.flatnonzero(starts)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cuts - 1] = inside[cuts - 1]
    length = np.flatnonzero(ends) + 1 - at
    passage = np.searchsorted(begin, at, "right") - 1
    count = np.bincount(passage, minlength=m)
    safe = np.maximum(count, 1)
    mean = np.bincount(passage, length, m) / safe
    square = np.bincount(passage, length.astype(np.float64) ** 2, m) / safe
    again = np.concatenate(([False], (value[1:] == value[:-1]) & (passage[1:] == passage[:-1])))
    later = np.concatenate(([False, False], (value[2:] == value[:-2]) & (passage[2:] == passage[:-2])))[: len(value)]
    key = np.sort((passage.astype(np.uint64) << np.uint64(40)) | (value >> np.uint64(24)))
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    times = np.diff(np.append(new, len(key)))
    of = (key[new] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(m)
    np.maximum.at(most, of, times)
    out[:, 0] = np.log1p(count) / 5
    out[:, 1] = mean / 10
    out[:, 2] = np.sqrt(np.maximum(square - mean**2, 0)) / 10
    out[:, 3] = np.bincount(passage, again, m) / safe
    out[:, 4] = np.bincount(passage, later, m) / safe
    out[:, 5] = np.bincount(of, minlength=m) / safe
    out[:, 6] = most / safe
    out[:, 7] = np.bincount(passage, length == 1, m) / safe
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class GatedAttention:
    """The network; parameters live in a dict of arrays."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean.astype(np.float32), scale.astype(np.float32)
        self.p = {
            "W": r.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": r.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
            "U": r.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "w": r.normal(0, ATTENTION**-0.5, ATTENTION), "c": r.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        """x: passages; first: the bags' first passages and the end. Every bag has a passage."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
        a = e / np.add.reduceat(e, first[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, first[:-1])
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag, "score": _sigmoid(z @ p["c"] + p["d"])}

    def gradients(self, f: dict, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict:
        p = self.p
        out = ((f["score"] - label) * weight / weight.sum()).astype(np.float32)
        dz = out[:, None] * p["c"]
        dh = f["a"][:, None] * dz[f["bag"]]
        da = (f["h"] * dz[f["bag"]]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, first[:-1])[f["bag"]])
        dt, dg = de[:, None] * p["w"] * f["g"], de[:, None] * p["w"] * f["t"]
        dt, dg = dt * (1 - f["t"] ** 2), dg * f["g"] * (1 - f["g"])
        dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {
            "W": f["x"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ out,
            "d": out.sum(keepdims=True),
        }


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 4e-3, decay: float = 1e-4) -> GatedAttention:
    """Adam on the log loss, in a fixed order of fixed batches: equal samples give equal weights."""
    every = np.concatenate(bags)
    net = GatedAttention(every.mean(0), every.std(0) + 1e-3)
    r = np.random.default_rng(11)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, total = 0, epochs * -(-len(bags) // batch)
    for _ in range(epochs):
        order = r.permutation(len(bags))
        for lo in range(0, len(order), batch):
            chosen = order[lo : lo + batch]
            first = np.concatenate(([0], np.cumsum([len(bags[i]) for i in chosen])))
            f = net.forward(np.concatenate([bags[i] for i in chosen]), first)
            grads = net.gradients(f, first, labels[chosen], np.ones(len(chosen)))
            step += 1
            now = rate * 0.5 * (1 + np.cos(np.pi * step / total))
            for k, v in grads.items():
                v = v + decay * net.p[k] * (net.p[k].ndim > 1)
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                net.p[k] = (net.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(key: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int, passages: int) -> DataFrame:
    """(__key, __label) of the rows to fit on."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.avg(label).alias("__label"))
    usable = known.filter(~held_out(key)).select(F.col(key).cast("string").alias("__key"), "__label")
    chosen = usable.orderBy(F.xxhash64("__key"), "__key").limit(2 * sample)  # some have no document
    pieces = F.greatest(F.lit(1), F.floor((F.coalesce(F.octet_length(text), F.lit(0)) + PASSAGE // 2) / PASSAGE))
    sized = docs.select(F.col(key).cast("string").alias("__key"), pieces.alias("__n")).join(F.broadcast(chosen), "__key").groupBy("__key").agg(F.max("__n").alias("__n"), F.first("__label").alias("__label"))
    order = Window.orderBy(F.xxhash64("__key"), "__key")  # over the bounded sample alone
    placed = sized.filter(F.col("__n") <= ROW_PASSAGES).withColumn("__sum", F.sum("__n").over(order)).withColumn("__rank", F.row_number().over(order))
    return placed.filter((F.col("__sum") <= passages) & (F.col("__rank") <= sample)).select("__key", "__label")


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE,
    passages: int = PASSAGES,
) -> GatedAttention | float:
    """Fit on the sample of labelled documents that are not held out; a constant if there is one label only."""
    chosen = _sample(docs, labels, key, text, label, sample, passages)
    rows = docs.select(F.col(key).cast("string").alias("__key"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = []
            for _, _, data, offsets in S.blocks(batch.column(1)):
                x, first = encode(data, offsets)
                vectors += [x[a:b].astype(np.float32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(vectors, pa.binary())], names=["key", "label", "x"])

    # A repeated document enters once: of equal ids the row of most passages, so the bounds hold.
    encoded = rows.select("__key", "__text", "__label").mapInArrow(run, "key string, label double, x binary")
    found = encoded.groupBy("key").agg(F.max(F.struct(F.octet_length("x").alias("n"), "x", "label")).alias("v")).select("key", "v.x", "v.label").orderBy("key").toPandas()
    if found.empty or found.label.round().nunique() < 2:
        return float(found.label.mean().round()) if len(found) else 1.0
    bags = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x in found.x]
    return fit(bags, found.label.to_numpy(np.float32))


def score(docs: DataFrame, net: GatedAttention | float, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep, then the score of each whole text."""
    keep = [*(keep or [])]
    source = docs.select(*keep, F.col(text).alias("__text"))
    k = len(keep)
    if isinstance(net, float):
        return source.select(*keep, F.lit(net).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for _, _, data, offsets in S.blocks(batch.column(k)):
                x, first = encode(data, offsets)
                scores.append(shared.value.forward(x, first)["score"].astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(k)), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())],
                names=[*keep, "score"],
            )

    fields = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep)
    return source.mapInArrow(run, f"{fields}score double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    found = score(docs, train(docs, labels), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score below the threshold, columns unchanged."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), "text")
    return score(whole, train(docs, labels), keep=["__doc"]).filter(F.col("score") >= threshold).select("__doc.*")
