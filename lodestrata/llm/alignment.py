"""Cross-tokenizer alignment: minimal groups of tokens that cover the same bytes, and how often token pairs overlap.

Both tokenizers cut the same bytes, a space and the text. Tokens of A and of B whose byte ranges overlap are the edges of a
bipartite graph; union-find gives its connected components, which are exactly the minimal groups: a group ends where a token
of each ends. The members of a group expand its links, all overlapping pairs of token occurrences. Texts are aligned in
blocks of BLOCK_BYTES; a block keeps each of its id pairs once, pairs are counted over all blocks, and the counts go back
to the blocks by pair, so a pair that every text holds costs a row a block, not a row a text.

A text that is null or empty, or whose tokens' bytes joined differ from a space and the text in either tokenizer (a
text with U+2581, say), has no tokens: zeros, and an empty string for its groups. Special tokens' strings inside texts are plain text. Repeated
rows, equal ids and null ids each stay rows of their own. A text longer than a block is a block alone, whole. An empty table gives
an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import stage

#: Bytes of text that are tokenized and aligned at once, and that share a list of pairs.
PIECE_BYTES, BLOCK_BYTES = 1 << 19, 16 << 20
#: Words whose tokens a worker keeps, the longest of them in characters, and how many new ones are encoded in a row.
MEMO_WORDS, MEMO_CHARS, RUN_WORDS = 500_000, 40, 256
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")

_loaded: dict[str, tuple] = {}


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write a byte as the character of its number where that prints, else as the next from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def cut_at_spaces(tokenizer) -> bool:
    """Whether a space between two characters that are no white space always begins a new word of the tokenizer, as the byte-level pattern has it."""
    own = json.loads(tokenizer.to_str())
    cut, model = own["pre_tokenizer"] or {}, own["model"]
    byte_level = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    return byte_level and model["type"] == "BPE" and not model.get("dropout") and own["normalizer"] is None and all(t["special"] for t in own["added_tokens"])


def _edge(c: str) -> bool:
    return "!" <= c <= "~" or c.isalnum()


class Words:
    """The ids of a space and each text, where the tokenizer cuts at spaces: a word that was met before is not encoded again.

    A word with white space or anything uncommon at an end, or an empty one (two spaces), is encoded together with its neighbours. New
    words are encoded RUN_WORDS at a time; the tokens' bytes tell where each ends.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], length: np.ndarray) -> None:
        self.encode, self.length = encode, length
        self.memo: dict[str, list[int]] = {}

    def __call__(self, texts: list[str]) -> list[list[int]]:
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        known = self.memo
        laid = [t.split(" ") for t in texts]
        fresh = {w for w in chain.from_iterable(laid) if w not in known}
        plain = [w for w in fresh if w and len(w) <= MEMO_CHARS and _edge(w[0]) and _edge(w[-1])]
        known.update(zip(plain, self._apart(plain), strict=True))
        rare = fresh.difference(plain)
        if rare:  # not kept: long words, and runs of words
            laid = [_with_neighbours(words, rare) if not rare.isdisjoint(words) else words for words in laid]
            runs = list({w for w in chain.from_iterable(laid) if w not in known})
            known = _Both(zip(runs, self.encode([" " + w for w in runs]), strict=True), known)
        return [list(chain.from_iterable([known[w] for w in words])) for words in laid]

    def _apart(self, words: list[str]) -> Iterator[list[int]]:
        """The ids of each word."""
        groups = [words[i : i + RUN_WORDS] for i in range(0, len(words), RUN_WORDS)]
        for group, ids in zip(groups, self.encode(["".join([" " + w for w in group]) for group in groups]), strict=True):
            ends = np.cumsum(self.length[ids])
            wanted = np.cumsum([1 + len(w.encode()) for w in group])
            at = np.searchsorted(ends, wanted)
            if at[-1] < len(ends) and np.array_equal(ends[at], wanted):
                cuts = (at + 1).tolist()
                yield from (ids[lo:hi] for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True))
            else:  # a token that stands for other bytes
                yield from self.encode([" " + w for w in group])


class _Both(dict):
    """Those of some texts, and else the kept ones."""

    def __init__(self, own, kept: dict) -> None:
        super().__init__(own)
        self.kept = kept

    def __missing__(self, word: str) -> list[int]:
        return self.kept[word]


def _with_neighbours(words: list[str], joined: set[str]) -> list[str]:
    """The words, but those of `joined` in one run with the words on both sides."""
    out, open_ = [], False
    for w in words:
        if out and (open_ or w in joined):
            out[-1].append(w)
        else:
            out.append([w])
        open_ = w in joined
    return [" ".join(run) for run in out]


class Tokens:
    """A tokenizer as a list of ids a text, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        if path.endswith(".json"):
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            own.no_truncation()
            own.no_padding()
            known, of = own.get_vocab(), byte_of_character()
            self.bytes = [b""] * (max(known.values()) + 1)
            for token, i in known.items():
                self.bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
            encode = lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]
            length = np.array([len(b) for b in self.bytes], np.int64)
            self.encode = Words(encode, length) if cut_at_spaces(own) else lambda texts: encode([" " + t for t in texts])
        else:
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
            self.bytes = []
            for i in range(own.get_piece_size()):
                piece = own.id_to_piece(i)
                one = BYTE_PIECE.fullmatch(piece)
                self.bytes.append(bytes([int(one[1], 16)]) if one else piece.replace("▁", " ").encode())
            self.encode = lambda texts: own.encode(texts, num_threads=1)
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.names = np.array([str(i) for i in range(len(self.bytes))], dtype=object)
        self.mid, self.bar, self.end = (self.names + ",", self.names + "|", self.names + ";")


def loaded(path: str) -> Tokens:
    """The tokenizer of a file, read once a worker."""
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, for n nodes and edges (u, v).

    Roots of one edge are joined, the larger under the smaller, for all edges at once; paths are halved until they are flat.
    """
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        open_ = parent[u] != parent[v]
        u, v = u[open_], v[open_]
    return parent


class Piece:
    """The alignment of some texts, laid one after the other: ids of both sides, links, groups.

    a, b: ids; a_text, b_text: whose text they are of; link_a, link_b: positions of linked tokens, in order; group: of each A
    and then each B token, from 0 over the piece; counts a text: n_a, n_b, n_groups, n_links.
    """

    def __init__(self, texts: list[str], left: Tokens, right: Tokens) -> None:
        given = [i for i, t in enumerate(texts) if t]
        self.n = len(texts)
        body = [texts[i] for i in given]
        ids_a, ids_b = left.encode(body) if body else [], right.encode(body) if body else []
        kept = []
        for i, t, x, y in zip(given, body, ids_a, ids_b, strict=True):
            whole = b" " + t.encode()
            if b"".join([left.bytes[k] for k in x]) == whole and b"".join([right.bytes[k] for k in y]) == whole:
                kept.append((i, x, y))
        flat = lambda side: np.concatenate([np.array(k[side], np.int64) for k in kept]) if kept else np.zeros(0, np.int64)
        text = np.array([k[0] for k in kept], np.int64)
        self.a, self.b = flat(1), flat(2)
        self.a_text = np.repeat(text, np.array([len(k[1]) for k in kept], np.int64)) if kept else text
        self.b_text = np.repeat(text, np.array([len(k[2]) for k in kept], np.int64)) if kept else text
        end_a, end_b = np.cumsum(left.length[self.a]), np.cumsum(right.length[self.b])
        # Tokens of B from the one that holds A's first byte to the one that holds its last.
        first = np.searchsorted(end_b, end_a - left.length[self.a], "right")
        last = np.searchsorted(end_b, end_a, "left")
        times = last - first + 1
        self.link_a = np.repeat(np.arange(len(self.a)), times)
        self.link_b = np.arange(len(self.link_a)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
        root = union_find(len(self.a) + len(self.b), self.link_a, self.link_b + len(self.a))
        is_root = np.zeros(len(root), bool)
        is_root[root] = True
        self.group = (np.cumsum(is_root) - 1)[root]  # a group's smallest member is its first A token
        tally = lambda of: np.bincount(of, minlength=self.n)
        self.n_a, self.n_b, self.n_links = tally(self.a_text), tally(self.b_text), tally(self.a_text[self.link_a])
        self.n_groups = tally(self.a_text[np.flatnonzero(is_root)])

    def groups(self, left: Tokens, right: Tokens) -> list[str]:
        """Each text's groups as a1,a2|b1;a3|b2,b3; the empty string for a text without tokens."""
        n, m = len(self.a), len(self.b)
        group_a, group_b = self.group[:n], self.group[n:]
        groups = int(group_a[-1]) + 1 if n else 0
        last_a, last_b = np.ones(n, bool), np.ones(m, bool)
        last_a[:-1], last_b[:-1] = group_a[1:] != group_a[:-1], group_b[1:] != group_b[:-1]
        before_b = np.r_[0, np.cumsum(np.bincount(group_b, minlength=groups))]
        before_a = np.r_[0, np.cumsum(np.bincount(group_a, minlength=groups))]
        out = np.empty(n + m, dtype=object)
        out[np.arange(n) + before_b[group_a]] = np.where(last_a, left.bar[self.a], left.mid[self.a])
        out[np.arange(m) + before_a[group_b + 1]] = np.where(last_b, right.end[self.b], right.mid[self.b])
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(out[lo:hi].tolist())[:-1] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about `most` bytes; a longer text is a run alone."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    lo = total = 0
    for i, s in enumerate(size.tolist()):
        if total and total + s > most:
            yield lo, i
            lo, total = i, 0
        total += s
    if len(size):
        yield lo, len(size)


def alignments(docs: DataFrame, left: str, right: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, groups): every text's groups, written out as a1,a2|b1;a3|b2,b3."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = loaded(left), loaded(right)
        for batch in batches:
            for lo, hi in pieces(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                p = Piece(part.column(1).to_pylist(), a, b)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (p.n_a, p.n_b, p.n_groups, p.n_links)), pa.array(p.groups(a, b), pa.string())], names=[key, "n_a", "n_b", "n_groups", "n_links", "groups"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups string")


class Aligned:
    """All texts aligned, staged by blocks: a block's texts with their links as positions in the block's list of id pairs."""

    def __init__(self, docs: DataFrame, left: str, right: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> None:
        self.key, self.kind = key, docs.schema[key].dataType.simpleString()
        self.right_size = right_size = len(loaded(right).bytes)
        kind = self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b = loaded(left), loaded(right)
            made, held, size = 0, [], 0
            for batch in batches:
                for lo, hi in pieces(batch.column(1)):
                    part = batch.slice(lo, hi - lo)
                    held.append(_counted(part, Piece(part.column(1).to_pylist(), a, b), a, b))
                    size += part.column(1).nbytes
                    if size >= block_bytes:
                        yield _block(held, made)
                        made, held, size = made + 1, [], 0
            if held:
                yield _block(held, made)

        def _counted(part: pa.RecordBatch, p: Piece, a: Tokens, b: Tokens) -> tuple:
            """Keys, counts, digests, and each text's pairs with their times, by text."""
            pair = p.a[p.link_a] * right_size + p.b[p.link_b]
            room = len(a.bytes) * right_size
            found, times = np.unique(p.a_text[p.link_a] * room + pair, return_counts=True)
            digests = [hashlib.sha256(g.encode()).hexdigest() if n else "" for g, n in zip(p.groups(a, b), p.n_a.tolist(), strict=True)]
            return part.column(0), np.stack([p.n_a, p.n_b, p.n_groups, p.n_links]), digests, np.bincount(found // room, minlength=p.n), found % room, times

        def _block(held: list[tuple], made: int) -> pa.RecordBatch:
            keys, counts, digests, own, pair, times = zip(*held, strict=True)
            listed, at = np.unique(np.concatenate(pair), return_inverse=True)
            times = np.concatenate(times)
            total = np.bincount(at, times, minlength=len(listed)).astype(np.int64)
            counts = np.concatenate(counts, 1)
            # Positions rise within a text, so their differences are small numbers that compress well.
            own = np.concatenate(own)
            start = np.cumsum(own) - own
            steps = np.diff(at, prepend=0).astype(np.int32)
            some = start[own > 0]
            steps[some] = at[some]
            one = {
                "block": pa.array([(TaskContext.get().partitionId() << 32) + made]), "keys": _list(pa.concat_arrays(keys)), "counts": _list(pa.array(counts.ravel())),
                "digests": _list(pa.array(sum(digests, []), pa.string())), "pairs": _list(pa.array(listed)), "totals": _list(pa.array(total)),
                "links": pa.array([b"".join(_squeezed(x) for x in (own.astype(np.int32), steps, np.minimum(times, 255).astype(np.uint8), times[times >= 255].astype(np.int64)))], pa.binary()),
            }
            return pa.RecordBatch.from_arrays(list(one.values()), names=list(one))

        schema = f"block long, keys array<{kind}>, counts array<long>, digests array<string>, pairs array<long>, totals array<long>, links binary"
        self.blocks = stage(docs.select(key, text).mapInArrow(run, schema), "alignment-blocks")

    def pair_counts(self) -> DataFrame:
        """(pair, links): each id pair's links in all texts; pair is A's id * (number of B's ids) + B's id."""
        return self.blocks.select(F.explode(F.arrays_zip("pairs", "totals")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.totals").alias("total")).groupBy("pair").agg(F.sum("total").alias("links"))

    def pairs(self) -> DataFrame:
        """(a_id, b_id, links, best): best where no other pair of the B id has more links."""
        counts = stage(self.pair_counts(), "alignment-pairs")
        b = F.pmod("pair", F.lit(self.right_size))
        most = counts.groupBy(b.alias("b_id")).agg(F.max("links").alias("most"))  # at most a row an id of B's vocabulary
        named = counts.select(F.floor(F.col("pair") / F.lit(self.right_size)).cast("long").alias("a_id"), b.alias("b_id"), "pair", "links")
        return named.join(F.broadcast(most), "b_id").select("a_id", "b_id", "links", (F.col("links") == F.col("most")).alias("best"), "pair")

    def documents(self) -> DataFrame:
        """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row a text."""
        known = self.pairs().select("pair", F.when(F.col("best"), -F.col("links")).otherwise(F.col("links")).alias("signed"))  # negative: the B id's best
        asked = self.blocks.select(F.col("block").alias("asking"), F.posexplode("pairs").alias("at", "pair"))
        told = asked.join(known, "pair").select("asking", "at", "signed")
        key, kind = self.key, self.kind

        def finish(_, left: pa.Table, right: pa.Table) -> pa.Table:
            signed = np.zeros(len(right), np.int64)
            signed[right["at"].to_numpy()] = right["signed"].to_numpy()
            row = {name: left[name][0] for name in ("keys", "counts", "digests", "links")}
            counts = row["counts"].values.to_numpy().reshape(4, -1)
            own, steps, times, large = _spread(row["links"].as_py())
            times = times.astype(np.int64)
            times[times == 255] = large
            text = np.repeat(np.arange(len(own)), own)
            start = np.cumsum(own) - own
            run = np.cumsum(steps, dtype=np.int64)
            at = run - np.repeat(np.r_[0, run][start], own)
            value = signed[at]
            best, total = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            np.add.at(best, text, np.where(value < 0, times, 0))
            np.add.at(total, text, np.abs(value) * times)
            return pa.table({key: row["keys"].values, **{n: counts[i] for i, n in enumerate(("n_a", "n_b", "n_groups", "n_links"))}, "n_best": best, "count_sum": total, "groups_sha256": row["digests"].values})

        out = f"`{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
        heavy = self.blocks.select("block", "keys", "counts", "digests", "links")
        return heavy.groupBy("block").cogroup(told.groupBy("asking")).applyInArrow(finish, out)


def _list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers as a compressed part: element type, count, size, data."""
    data = pa.compress(values.tobytes(), codec="zstd", asbytes=True) if len(values) else b""
    return values.dtype.str.encode().ljust(4) + np.array([len(values), len(data)], np.int64).tobytes() + data


def _spread(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind = np.dtype(data[at : at + 4].decode().strip())
        n, size = np.frombuffer(data, np.int64, 2, at + 4).tolist()
        at += 20
        body = pa.decompress(data[at : at + size], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True) if n else b""
        out.append(np.frombuffer(body, kind).copy())
        at += size
    return out


def aligned_documents(docs: DataFrame, left: str, right: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every text's groups, links, and corpus-wide counts of its links: see Aligned.documents."""
    return Aligned(docs, left, right, key, text, block_bytes).documents()
