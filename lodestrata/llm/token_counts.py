"""Token counts by a compiled finite-state transducer.

A byte-pair vocabulary is compiled into a deterministic transducer over bytes. Its transitions carry the
change in the number of emitted tokens, which may be negative where a byte lets earlier tokens merge. A state
is a node of the trie automaton of all tokens (the longest tail of the input that begins a token) and, for
each place in that tail, the token that the encoding of the input up to there ends with; that is all a later
byte can depend on. States and transitions are made when first reached and kept, so the table holds what the
texts use; between two pieces a table of STATES states is emptied, so memory is bounded. The last byte of a piece is a symbol of its own, as the vocabulary's tokens end words.

Texts of more than CHUNK code points are cut into chunks in one pass, and the chunks are dealt over all tasks. ASCII
white space resets the transducer, so a chunk's map is one of two kinds: (whole,) for a chunk without white space, or
(head, count, tail): whatever state it is entered in, only the head is read in that state, and it is left in that of
the tail. The open ends are kept as text, not as states, since the normaliser and the splitting pattern in front of
the transducer need it. Maps compose associatively; they are composed in LEVELS rounds of FAN neighbours at a time, a
parallel prefix scan of which only the last value, a text's count, is wanted. A single word of many chunks is put
together by its last task.

Words are normalised as the tokenizer file says (NFC, lower case) and split by its pattern. Special strings inside a
text are one token each, the library's default. The file's content is broadcast, so executors need not see its path.

Defined cases: null counts as empty, with no tokens; an empty table gives no rows; repeated rows each get a row; equal
texts have equal counts. Columns to keep may have any name but those of the result; further columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import partitions

CHUNK = 1 << 16
FAN, LEVELS = 64, 3
LIMIT = 2048
MEMO = 400_000
STATES = 200_000
SPACE = " \t\n\v\f\r"
_SPLIT = re.compile(f"[{SPACE}]+")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + extra)
            extra += 1
    return [names[b] for b in range(256)]


class CountTransducer:
    """Counts the tokens of pieces, byte by byte, for a byte-pair vocabulary with word-end tokens."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)): i for i, m in enumerate(model["merges"])}
        self.names = _byte_symbols()
        self.symbols = {name: (name,) for name in self.names} | {name + self.end: (name + self.end,) for name in self.names}
        for a, b in self.rank:
            if a in self.symbols and b in self.symbols:
                self.symbols[a + b] = self.symbols[a] + self.symbols[b]
        self.fits: dict[tuple[str, str], bool] = {}
        self.prefixes: set[tuple] = {()}
        self.tokens: dict[tuple, str] = {}
        for token, parts in self.symbols.items():
            if self.merged(parts) == [token]:
                self.tokens[parts] = token
                self.prefixes.update(parts[:i] for i in range(1, len(parts) + 1))
        self.reset()

    def reset(self) -> None:
        """Start with the state before a piece alone: its empty tail, no last token."""
        # A state: the tail (longest suffix of the input that begins a token) and the last token at each of its places.
        self.states: dict[tuple, int] = {((), (None,)): 0}
        self.keys: list[tuple] = [((), (None,))]
        self.moves: list[dict[int, tuple[int, int]]] = [{}]
        self.counts: list[tuple[int, ...]] = [(0,)]
        self.fits.clear()

    def merged(self, parts: tuple) -> list[str]:
        """The encoding of a symbol sequence: lowest-ranked pair first, leftmost among equals."""
        out = list(parts)
        while len(out) > 1:
            best = min(range(len(out) - 1), key=lambda i: (self.rank.get((out[i], out[i + 1]), 1 << 60), i))
            pair = (out[best], out[best + 1])
            if pair not in self.rank:
                break
            i, new = 0, []
            while i < len(out):
                if i + 1 < len(out) and (out[i], out[i + 1]) == pair:
                    new.append(pair[0] + pair[1])
                    i += 2
                else:
                    new.append(out[i])
                    i += 1
            out = new
        return out

    def follows(self, a: str | None, b: str) -> bool:
        """Whether b can stand right after a in an encoding."""
        if a is None:
            return True
        known = self.fits.get((a, b))
        if known is None:
            known = self.fits[a, b] = self.merged(self.symbols[a] + self.symbols[b]) == [a, b]
        return known

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        """Next state and emitted-token change for a symbol: a byte, or 256 + the last byte of a piece."""
        tail, last = self.keys[state]
        relative = self.counts[state]
        name = self.names[symbol] if symbol < 256 else self.names[symbol - 256] + self.end
        longer = (*tail, name)
        for size in range(len(longer), 0, -1):
            token = self.tokens.get(longer[len(longer) - size :])
            at = len(last) - size
            if token is not None and self.follows(last[at], token):
                break
        else:
            raise ValueError(f"no token for {name!r}")
        emitted = relative[at] + 1
        size = next(n for n in range(len(longer), -1, -1) if longer[len(longer) - n :] in self.prefixes)
        new_last, new_counts = (*last, token)[len(last) - size :], (*relative, emitted)[len(last) - size :]
        # Counts are kept relative to the present place, so equal futures are one state.
        key = (longer[len(longer) - size :], new_last, tuple(c - emitted for c in new_counts))
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.keys)
            self.keys.append((key[0], key[1]))
            self.counts.append(key[2])
            self.moves.append({})
        self.moves[state][symbol] = found = (to, emitted - relative[-1])
        return found

    def count(self, piece: bytes) -> int:
        """Tokens of one piece: the sum over the transitions that it takes."""
        if len(self.keys) >= STATES or len(self.fits) >= 4 * STATES:
            self.reset()
        moves, state, total = self.moves, 0, 0
        for symbol in (*piece[:-1], piece[-1] + 256):
            step = moves[state].get(symbol)
            if step is None:
                step = self.move(state, symbol)
            state, change = step
            total += change
        return total


class TokenCounter:
    """Counts for words (white-space-free strings) and chunks; source: the tokenizer file's content."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["model"]["type"] != "BPE":
            raise ValueError("not a lower-casing byte-pair file with word ends")
        self.transducer = CountTransducer(spec)
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], regex.V0)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = [s[:2] for s in special]
        self.memo: dict[str, int] = {}

    def _plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = "".join(c.lower() for c in text)
        else:
            text = text.lower()
        return sum(self.transducer.count(m.encode()) for m in self.pattern.findall(text))

    def word(self, word: str) -> int:
        if self.special and any(m in word for m in self.marks) and (found := self.special.findall(word)):
            return len(found) + sum(map(self._plain, self.special.split(word)))
        return self._plain(word)

    def words(self, words: list[str]) -> int:
        memo, total = self.memo, 0
        for w in words:
            n = memo.get(w)
            if n is None:
                if len(w) > 256:
                    n = self.word(w)
                else:
                    if len(memo) >= MEMO:
                        memo.clear()
                    n = memo[w] = self.word(w)
            total += n
        return total

    def chunk_map(self, text: str) -> tuple:
        """(whole,) or (head, count, tail); the count is that of the words strictly inside."""
        parts = _SPLIT.split(text)
        if len(parts) == 1:
            return (text,)
        return parts[0], self.words([w for w in parts[1:-1] if w]), parts[-1]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two chunks in turn; associative."""
        if len(a) == 1 and len(b) == 1:
            return (a[0] + b[0],)
        if len(a) == 1:
            return a[0] + b[0], b[1], b[2]
        if len(b) == 1:
            return a[0], a[1], a[2] + b[0]
        seam = a[2] + b[0]
        return a[0], a[1] + (self.words([seam]) if seam else 0) + b[1], b[2]

    def finish(self, m: tuple) -> int:
        ends = [w for w in (m if len(m) == 1 else (m[0], m[2])) if w]
        return (m[1] if len(m) == 3 else 0) + self.words(ends)

    def text(self, text: str) -> int:
        return self.words(text.split()) if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") else self.words([w for w in _SPLIT.split(text) if w])


def token_counts(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """The columns in keep, with n_bytes and n_tokens of every text.

    Texts of one chunk are counted where they are read, without a shuffle. Only the chunks of longer ones are dealt.
    """
    keep = keep or []
    with open(path, encoding="utf-8") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(*keep, F.octet_length(whole).cast("long").alias("__bytes"), whole.alias("__text"))
    long = F.char_length("__text") > chunk
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(source.value)
        for batch in batches:
            counts = [counter.text(t) for t in batch.column(k + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k + 1)), pa.array(counts, pa.int64())], names=[*keep, "n_bytes", "n_tokens"])

    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    short = rows.filter(~long).mapInArrow(run, f"{fields}n_bytes long, n_tokens long")
    return short.unionByName(_in_chunks(rows.filter(long), source, keep, chunk))


MAP = "whole boolean, head string, count long, tail string"


def _in_chunks(rows: DataFrame, source, keep: list[str], chunk: int) -> DataFrame:
    """token_counts of texts (keep, __bytes, __text) of more than one chunk."""
    spark = rows.sparkSession
    # Rows get their numbers before they are cut and dealt; what is kept of a row goes with its first chunk.
    held = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("__bytes").alias("bytes"))
    named = rows.select(F.monotonically_increasing_id().alias("row"), held.alias("held"), "__text")
    kind = named.schema["held"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, t in enumerate(batch.column(2)):
                body = t.as_py()
                parts = [body[i : i + chunk] for i in range(0, len(body), chunk)]
                n = len(parts)
                first = pa.concat_arrays([batch.column(1).slice(r, 1), pa.nulls(n - 1, batch.column(1).type)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[r].as_py()] * n, pa.int64()), pa.array(range(n), pa.int64()), first, pa.array(parts, pa.string())],
                    names=["row", "no", "held", "part"],
                )

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(source.value)
        for batch in batches:
            yield _maps(batch, [counter.chunk_map(p) for p in batch.column(3).to_pylist()])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(source.value)
        for batch in batches:
            out = []
            for listed in batch.column(3).to_pylist():
                maps = [(m["head"],) if m["whole"] else (m["head"], m["count"], m["tail"]) for m in listed]
                out.append(reduce(counter.compose, maps))
            yield _maps(batch, out)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(source.value)
        for batch in batches:
            maps = zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True)
            counts = [counter.finish((head,) if whole else (head, n, tail)) for whole, head, n, tail in maps]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["held", "n_tokens"])

    schema = f"row long, no long, held {kind}, {MAP}"
    dealt = named.mapInArrow(cut, f"row long, no long, held {kind}, part string").repartition(partitions(spark), "row", "no")
    maps = dealt.mapInArrow(mapped, schema)
    for _ in range(LEVELS):
        one = F.struct("no", "whole", "head", "count", "tail")
        near = maps.groupBy("row", F.floor(F.col("no") / FAN).alias("next")).agg(
            F.first("held", ignorenulls=True).alias("held"), F.array_sort(F.collect_list(one)).alias("maps"),
        )
        maps = near.select("row", F.col("next").alias("no"), "held", "maps").mapInArrow(composed, schema)
    out = maps.select("held", "whole", "head", "count", "tail").mapInArrow(finished, f"held {kind}, n_tokens long")
    return out.select(*[F.col(f"held.k{i}").alias(c) for i, c in enumerate(keep)], F.col("held.bytes").alias("n_bytes"), "n_tokens")


def _maps(batch: pa.RecordBatch, maps: list[tuple]) -> pa.RecordBatch:
    """Rows (row, no, held) of a batch with their maps."""
    whole = [len(m) == 1 for m in maps]
    columns = [
        pa.array(whole), pa.array([m[0] for m in maps], pa.string()),
        pa.array([0 if w else m[1] for w, m in zip(whole, maps, strict=True)], pa.int64()),
        pa.array(["" if w else m[2] for w, m in zip(whole, maps, strict=True)], pa.string()),
    ]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *columns], names=["row", "no", "held", "whole", "head", "count", "tail"])


_counters: dict[str, TokenCounter] = {}


def _counter(source: str) -> TokenCounter:
    """One compiled transducer a Python worker and file."""
    if source not in _counters:
        _counters[source] = TokenCounter(source)
    return _counters[source]


def over_limit(df: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document."""
    return token_counts(df, path, keep=["doc_id"]).withColumn("over_limit", F.col("n_tokens") > limit)
