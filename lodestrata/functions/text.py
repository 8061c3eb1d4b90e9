"""Text columns: words, tokens, noise, language, paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes of the published word-break rules (Unicode Standard Annex 29).
_BY_CHARACTER = r"\p{IsHan}\p{IsHiragana}"
_KATAKANA = r"\p{IsKatakana}\u3031-\u3035\u30a0\u30fc\uff70"
_UNSPACED = r"\p{IsThai}\p{IsLao}\p{IsMyanmar}\p{IsKhmer}"
_LETTER = rf"[\p{{L}}\p{{Nl}}&&[^{_BY_CHARACTER}{_KATAKANA}{_UNSPACED}]]"
_MARK = r"[\p{M}\p{Cf}&&[^\u200b]]"
_CONNECTOR = r"[\p{Pc}\u202f]"
_IN_LETTERS = r"[:\u00b7\u0387\u055f\u05f4\u2027\ufe13\ufe55\uff1a.\u2018\u2019\u2024\ufe52\uff07\uff0e']"
_IN_NUMBERS = r"[,;\u037e\u0589\u060c\u060d\u066c\u07f8\u2044\ufe10\ufe14\ufe50\ufe54\uff0c\uff1b.\u2018\u2019\u2024\ufe52\uff07\uff0e']"
LONGEST_TOKEN = 255

# A word is a run of letters, digits and connectors with a letter or a digit in it, carried on by a sign between two letters or two
# digits. Runs and their continuations are bounded, so no text makes the matcher recurse far; longer ones are cut, as by the rule.
_RUN = rf"[a-z0-9[{_LETTER}{_MARK}{_CONNECTOR}\p{{Nd}}]]"
_BETWEEN = rf"(?<=[{_LETTER}{_MARK}]){_IN_LETTERS}(?={_LETTER})|(?<=\p{{Nd}}){_IN_NUMBERS}(?=\p{{Nd}})"
_WORD = rf"{_CONNECTOR}{{0,{LONGEST_TOKEN - 1}}}[a-z0-9[{_LETTER}\p{{Nd}}]]{_RUN}{{0,{LONGEST_TOKEN - 1}}}(?:(?:{_BETWEEN}){_RUN}{{1,{LONGEST_TOKEN}}}){{0,{LONGEST_TOKEN // 2}}}"
TOKEN = rf"{_WORD}|[{_BY_CHARACTER}]{_MARK}*|[{_KATAKANA}][{_KATAKANA}{_MARK}]{{0,{LONGEST_TOKEN - 1}}}|[{_UNSPACED}][{_UNSPACED}{_MARK}]{{0,{LONGEST_TOKEN - 1}}}"

# Patterns of running lines, headings, tables and images.
NOISE = (r"(?m)^Page \d+ of \d+$", r"(?m)^\d+$", r"(?m)^-\s*\d+\s*-$")
HEADING = r"(?m)^(#{1,6})\s+(.+)$"
TABLE = r"\|[-:]+\|"
IMAGE = r"!\[.*?\]\(.*?\)"

# Stop words by language, in the order in which ties are settled.
LANGUAGE_WORDS = {
    "en": ("the", "and", "is", "are", "was", "were", "this", "that"),
    "es": ("el", "la", "los", "las", "de", "que", "es", "en"),
    "fr": ("le", "la", "les", "de", "et", "est", "dans", "que"),
    "de": ("der", "die", "das", "und", "ist", "sind", "ein", "eine"),
}


def tokens(text: Column) -> Column:
    """Standard analysis: the words between Unicode word boundaries in lower case, none left out.

    "don't", "3.14" and "foo_bar" are one word each, "a-b" is two, an ideograph or a hiragana is a word alone; signs and emoji are none. A
    word of more than 255 characters is cut into pieces of as many.
    """
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    """Words between white space; none for a blank text."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def without_noise(text: Column) -> Column:
    """Page numbers and running lines removed, then stripped."""
    return F.regexp_replace(reduce(lambda c, p: F.regexp_replace(c, p, ""), NOISE, text), r"^\s+|\s+$", "")


def language(text: Column, sample: int = 1000) -> Column:
    """Language with most stop words in the first characters; English where none reaches three."""
    low = F.lower(F.substring(text, 1, sample))
    hits = {k: reduce(lambda a, b: a + b, [F.when(F.contains(low, F.lit(f" {w} ")), 1).otherwise(0) for w in ws]) for k, ws in LANGUAGE_WORDS.items()}
    best = F.greatest(*hits.values())
    chosen = F.when(best < 3, "en")
    for k, n in hits.items():
        chosen = chosen.when(n == best, k)
    return chosen.otherwise("en")


def first_words(text: Column, n: int = 30) -> Column:
    """The stripped text, or its first n words where it has more."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > n, F.array_join(F.slice(words, 1, n), " ")).otherwise(F.regexp_replace(text, r"^\s+|\s+$", ""))


def clock(seconds: Column) -> Column:
    """HH:MM:SS of a number of seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60)


def audio_clock(markdown: Column, chunk_index: Column) -> Column:
    """The [HH:MM:SS] of a transcript with the chunk's number, from 1; 00:00:00 where there is none."""
    marks = F.regexp_extract_all(markdown, F.lit(r"\[(\d{2}:\d{2}:\d{2})\]"), F.lit(1))
    return F.coalesce(F.get(marks, chunk_index - 1), F.lit("00:00:00"))


def short_clock(seconds: Column) -> Column:
    """m:ss of a number of seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def file_size(size: Column) -> Column:
    """The size in the largest unit of which it has one, B to TB, with one decimal."""
    units = ("B", "KB", "MB", "GB", "TB")
    shown = lambda i: F.format_string(f"%.1f {units[i]}", F.bround(size / float(1024**i), 1))
    return reduce(lambda out, i: out.when(size < 1024 ** (i + 1), shown(i)), range(1, 4), F.when(size < 1024, shown(0))).otherwise(shown(4))


def duration(seconds: Column) -> Column:
    """1h 2m 3s, 2m 3s or 3s."""
    s = F.floor(seconds).cast("long")
    hours, minutes, rest = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return F.when(
        hours > 0, F.format_string("%dh %dm %ds", hours, minutes, rest),
    ).when(minutes > 0, F.format_string("%dm %ds", minutes, rest)).otherwise(F.format_string("%ds", rest))


def file_url(path: Column, base: str) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/api/files/"), F.regexp_replace(path, "^/+", ""))


def image_paths(markdown: Column) -> Column:
    """Targets of markdown images, without web and data addresses."""
    found = F.regexp_extract_all(markdown, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))
    return F.filter(F.transform(found, F.trim), lambda p: ~p.rlike("(?i)^(https?://|data:)"))


def is_devanagari(text: Column) -> Column:
    return text.rlike("[ऀ-ॿ]")


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)(?:[?#].*)?$", 1))


def html_text(html: Column) -> Column:
    """Visible text of an HTML page: scripts, styles, comments and tags out, the common entities decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style|nav|footer)\b.*?</\1>|<!--.*?-->", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|h[1-6]|li|tr|article)>", "\n"), r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" *\n[ \n]*", "\n"), r"^\s+|\s+$", "")
