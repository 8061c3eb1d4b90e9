"""Secret scanning: fixed patterns, and novelty against a primed zstandard compressor.

Patterns find assignments, access keys and long hexadecimal runs. Besides, each string of CANDIDATE characters in a
sensitive context is measured, whole, by its marginal compressed bytes: how much longer the surrounding text
becomes, compressed with a dictionary of common identifiers, when the string is put in. Identifiers and repeats
cost little; keys do not compress. The context is a credential word that ends at most REACH characters before the
string or begins at most REACH after it on the same line. A string without such a word around it that holds
credential words itself is cut at them, and its parts are measured. So each character is measured at most twice.

Strings whose marginal bytes reach NOVELTY a character are reported as `novel` if they have a digit, LETTERS letters in a
row, or letters that change between the cases as in random ones: CHANGES of the pairs of neighbouring letters or more.
Rare words of prose reach the measure too, so shorter strings of letters that keep to one case, or change as words and
joined names do, are left out. Surroundings are SURROUNDING characters on either side.

Spans are in code points, end exclusive. Defined cases: null counts as the empty text, which has no spans; an empty
table gives no rows; repeated rows each get a row. Equal texts have equal spans; spans of one start are ordered by
kind as listed. Very long texts and strings are read whole. Columns to keep may have any name but those of the
result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
SURROUNDING = 160
NOVELTY = 0.55
LEVEL = 3

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.-]{{{LEAST},}}")
CONTEXT = re.compile(r"pass(?:word|wd|phrase)?|secret|token|api_?key|credential|private_?key|bearer|auth", re.IGNORECASE | re.ASCII)
REACH = 40
LETTERS, CHANGES = 32, 0.3
_TELLING = re.compile(rf"[0-9]|[A-Za-z]{{{LETTERS}}}")
_PAIR, _CHANGE = re.compile(r"(?=[A-Za-z]{2})"), re.compile(r"(?=[a-z][A-Z]|[A-Z][a-z])")

# Identifiers that are common in code and configuration next to credentials.
IDENTIFIERS = (
    "access_key access_token account address api_key apikey application authorization aws_access_key_id "
    "aws_secret_access_key base64 bearer bucket callback certificate class client_id client_secret config "
    "connection const content-type cookie credential credentials database def default development digest "
    "document.getElementById domain email encoding encryption endpoint environment export false function "
    "getenv header headers hostname http https import import os index.html instance int key lambda localhost "
    "login localhost:8080 message method module namespace null number object oauth options os.environ "
    "package parameter passphrase passwd password path port private_key process.env production public_key "
    "query redirect_uri refresh_token region request response return root schema secret secret_key self "
    "server service session session_id settings signature ssh-rsa static str string struct test timeout "
    "token true undefined update url user user_id username utf-8 value var variable version void www.example.com"
)

_tools: tuple[zstandard.ZstdCompressor] | None = None


def _compressor() -> zstandard.ZstdCompressor:
    """One a Python worker, primed with the identifiers."""
    global _tools
    if _tools is None:
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        _tools = (zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False),)
    return _tools[0]


def novelty(text: str, start: int, end: int) -> float:
    """Marginal compressed bytes a character of text[start:end] in its surroundings."""
    before, after = text[max(0, start - SURROUNDING) : start], text[end : end + SURROUNDING]
    size = lambda s: len(_compressor().compress(s.encode()))
    return (size(before + text[start:end] + after) - size(before + after)) / (end - start)


def telling(text: str, start: int, end: int) -> bool:
    """Whether a string looks other than words and names do."""
    if _TELLING.search(text, start, end):
        return True
    own = text[start:end]
    pairs, changes = len(_PAIR.findall(own)), len(_CHANGE.findall(own))
    return pairs >= LEAST - 1 and changes >= CHANGES * pairs


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind as listed."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def _clear_of(base: list[tuple[int, str, int]]) -> Callable[[int, int], bool]:
    """Whether a span touches none of the base spans."""
    merged: list[list[int]] = []
    for a, _, b in base:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]

    def clear(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return i == 0 or merged[i - 1][1] <= a

    return clear


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Strings in a sensitive context, in order."""
    words = [m.span() for m in CONTEXT.finditer(text)]
    if not words:
        return
    starts, ends = [a for a, _ in words], [b for _, b in words]
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        i, j = bisect_right(ends, a), bisect_left(starts, b)
        before = i > 0 and a - ends[i - 1] <= REACH
        after = j < len(words) and starts[j] - b <= REACH and "\n" not in text[b : starts[j]]
        if before or after:
            yield a, b
            continue
        if i == j:
            continue
        # Credential words inside: what stands between them, the first of which may begin before the string.
        edges = [a, *(x for span in words[i:j] for x in span), b]
        for x, y in zip(edges[::2], edges[1::2], strict=True):
            if y - x >= LEAST:
                yield x, y


def novel_spans(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Incompressible strings in a sensitive context, apart from the base spans."""
    clear = _clear_of(base)
    return [(a, "novel", b) for a, b in candidates(text) if clear(a, b) and telling(text, a, b) and novelty(text, a, b) >= NOVELTY]


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep, with n_assign, n_access, n_hex, n_novel, base_sha256 and spans."""
    keep = keep or []
    source = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for value in batch.column(k):
                body = value.as_py()
                base = base_spans(body)
                every = sorted(base + novel_spans(body, base), key=lambda s: (s[0], KINDS.index(s[1])))
                for n, kind in zip(counts, KINDS, strict=True):
                    n.append(sum(s[1] == kind for s in every))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(k)), *(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=[*keep, "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"],
            )

    fields = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep)
    return source.mapInArrow(run, f"{fields}n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")
