"""Identity rules: document, chunk, cache and point ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_ID = r"^(.*)_P(\d+)_C(\d+)$"
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def document_id(file_name: Column, created_date: Column, title: Column) -> Column:
    """DOC_ and the first 16 digits of the SHA-1 of the three fields; a null reads `None`."""
    parts = [F.coalesce(c.cast("string"), F.lit("None")) for c in (file_name, created_date, title)]
    return F.concat(F.lit("DOC_"), F.substring(F.sha1(F.concat(*parts).cast("binary")), 1, 16))


def chunk_id(document: Column, page: Column, index: Column) -> Column:
    return F.format_string("%s_P%02d_C%02d", document, page, index)


def chunk_document(chunk: Column) -> Column:
    return F.nullif(F.regexp_extract(chunk, CHUNK_ID, 1), F.lit(""))


def chunk_page(chunk: Column) -> Column:
    return F.regexp_extract(chunk, CHUNK_ID, 2).try_cast("int")


def chunk_index(chunk: Column) -> Column:
    return F.regexp_extract(chunk, CHUNK_ID, 3).try_cast("int")


def prefixed(text: Column, query: bool) -> Column:
    """Embedding prefix: added once, and switched where the other one is there (F8)."""
    own, other = ("search_query: ", "search_document: ") if query else ("search_document: ", "search_query: ")
    return F.when(text.startswith(own), text).when(
        text.startswith(other), F.concat(F.lit(own), F.substring(text, F.lit(len(other) + 1), F.length(text))),
    ).otherwise(F.concat(F.lit(own), text))


def cache_key(text: Column, query: bool) -> Column:
    kind = "query" if query else "doc"
    return F.concat(F.lit(f"embedding:{kind}:"), F.substring(F.sha2(prefixed(text, query).cast("binary"), 256), 1, 16))


def point_id(chunk: Column) -> Column:
    """Name-based UUID, version 5, in the DNS namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), chunk.cast("binary")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
