"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing uses Spark's text sink: a row is one record, and the line separator is the CR LF CR LF that ends
every WARC record, so any store that Spark writes to takes the archives.

Reading splits the files at the version line, wherever it stands, payloads included. Each piece is a
candidate; its header gives the offset at which the next record must begin. Pointer jumping over a file's
candidates, from the file's start, keeps just the reachable ones, so a version line inside a payload is
never taken for a record. Payloads stay in the tasks that read them: only offsets, header fields and digests
are shuffled, and only the pieces of a payload that contains a version line are put together again.

Defined cases: a null payload is empty; null ids and addresses have no header line and read back as null;
line breaks in an address are percent-encoded. Of records with equal payloads the one with the largest id is
the response (rows that repeat it are responses too); if no id is known, all are. Empty and very long payloads are
records like others, and each is read whole by one task. An empty table gives no archive rows. Further columns of the
pages, whatever their names, are not written.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import stage, stage_path

VERSION = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BROADCAST_ROWS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_sha1: Column) -> Column:
    """Base 32 of a 40-digit hexadecimal string: four runs of 40 bits, eight characters each."""
    out = []
    for i in range(0, 40, 10):
        run = F.conv(F.substring(hex_sha1, i + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(ALPHABET), F.shiftright(run, s).bitwiseAND(31).cast("int") + 1, F.lit(1)) for s in range(35, -1, -5)]
    return F.concat(*out)


def _record_id(page: Column, digest: Column) -> Column:
    name = F.sha1(F.concat_ws(":", page.cast("string"), digest))
    part = lambda a, n: F.substring(name, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def records(pages: DataFrame, page: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """One text row a record, without the line breaks that end it.

    Payloads meet by digest: groups are reduced to their largest id before the join, and only groups of two
    or more take part, so a payload that a third of the rows share is one row on that side. Up to
    BROADCAST_ROWS such groups are broadcast, which leaves the payloads where they are.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(page).cast("long").alias("page"), F.regexp_replace(F.regexp_replace(F.col(url), "\r", "%0D"), "\n", "%0A").alias("url"),
        body.alias("body"), F.sha1(body.cast("binary")).alias("sha1"), F.octet_length(body).cast("long").alias("bytes"),
    )
    narrow = pages.select(F.col(page).cast("long").alias("page"), F.sha1(body.cast("binary")).alias("sha1"), F.octet_length(body).alias("bytes"))
    groups = narrow.filter(F.col("bytes") >= least).groupBy("sha1").agg(F.max("page").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    groups = stage(groups, "payloads")
    # Few shared payloads go to the pages; many meet them by digest.
    rows = rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups, "sha1", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    digest = base32(F.col("sha1"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    return rows.select(
        F.concat(
            F.lit(VERSION), line(
                "WARC-Type", F.when(revisit, "revisit").otherwise("response"),
            ), line("WARC-Record-ID", _record_id(F.col("page"), digest)), line("WARC-Date", F.lit(DATE)),
            line("WARC-Target-URI", F.col("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), line("Page-ID", F.col("page").cast("string")),
            F.when(
                revisit,
                F.concat(
                    line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("first"), digest)),
                    line("Refers-To-Page-ID", F.col("first").cast("string")), line("Payload-Length", F.col("bytes").cast("string")),
                ),
            ).otherwise(F.lit("")),
            line("Content-Type", F.lit("text/html; charset=utf-8")), line(
                "Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string")),
            ), F.lit("\r\n"), F.when(revisit, F.lit("")).otherwise(F.col("body")),
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, **options) -> None:
    records(pages, **options).write.option("lineSep", BREAK).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The files cut at every version line: (file, block, n, value), n ascending within a block of a file."""
    raw = spark.read.option("lineSep", VERSION).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")


def _offsets(pieces: DataFrame, extra: list[str]) -> DataFrame:
    """(file, start, length, *extra): where in the file the version line before each piece begins; -size for the first piece."""
    size = len(VERSION)
    within = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    run = pieces.withColumn("inside", F.coalesce(F.sum(F.col("length") + size).over(within), F.lit(0)))
    blocks = pieces.groupBy("file", "block").agg(F.sum(F.col("length") + size).alias("bytes"))
    base = blocks.select(
        "file", "block",
        F.coalesce(F.sum("bytes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    )
    return run.join(base, ["file", "block"]).select("file", (F.col("base") + F.col("inside") - size).alias("start"), "length", *extra)


def _reachable(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pointer jumping over one file's candidates (start, next): those that the chain from offset 0 reaches."""
    pdf = pdf.sort_values("start", kind="stable").reset_index(drop=True)
    start, after, end = pdf["start"].to_numpy(np.int64), pdf["next"].to_numpy(np.int64), int(pdf["size"].iloc[0])
    m = len(start)
    jump = np.searchsorted(start, after)
    hit = (jump < m) & (start[np.minimum(jump, m - 1)] == after)
    sound = hit | (after == end)
    jump = np.where(hit, jump, m)
    jump = np.append(jump, m)
    reached = np.zeros(m + 1, bool)
    reached[0] = m > 0 and start[0] == 0
    for _ in range(max(1, m.bit_length())):
        reached[jump[reached]] = True
        jump = jump[jump]
    keep = reached[:m] & sound
    return pdf.loc[keep, ["file", "start", "next"]]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, digest_matches) of every record."""
    head = F.substring_index("value", BREAK, 1)
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?im)^{name}: *([^\r\n]*)", 1), F.lit(""))
    size = len(VERSION)
    parsed = _pieces(spark, path).withColumn("head", head).withColumn("length", F.octet_length("value").cast("long"))
    parsed = parsed.withColumn("head_bytes", (F.octet_length("head") + 4).cast("long")).withColumn("content", field("Content-Length").try_cast("long"))
    whole = F.col("head_bytes") + F.col("content") <= F.col("length")
    body = F.substring(F.col("value").cast("binary"), (F.col("head_bytes") + 1).cast("int"), F.col("content").cast("int"))
    fields = {
        "type": field("WARC-Type"), "page": field("Page-ID").try_cast("long"), "url": field("WARC-Target-URI"),
        "digest": F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", ""), "refers": field("Refers-To-Page-ID").try_cast("long"),
        "original": field("Payload-Length").try_cast("long"), "sha1": F.when(whole, F.sha1(body)),
    }
    narrow = parsed.select("file", "block", "n", "length", "head_bytes", "content", *[v.alias(k) for k, v in fields.items()])
    found = stage(_offsets(narrow, ["head_bytes", "content", *fields]), "pieces")

    after = F.col("start") + size + F.col("head_bytes") + F.col("content") + len(BREAK)
    sizes = found.groupBy("file").agg(F.max(F.col("start") + size + F.col("length")).alias("size"))
    candidates = found.filter("start >= 0 and content is not null").select("file", "start", after.alias("next")).join(sizes, "file")
    chain = candidates.groupBy("file").applyInPandas(_reachable, "file string, start long, next long")
    kept = found.join(chain, ["file", "start"])
    if not (broken := stage(kept.filter("sha1 is null").select("file", "start", "next", "head_bytes", "content"), "broken")).isEmpty():
        kept = kept.join(_joined(spark, path, broken), ["file", "start"], "left").withColumn("sha1", F.coalesce("sha1", "sha1_joined"))
    revisit = F.col("type") == "revisit"
    own = base32(F.col("sha1"))
    return kept.select(
        F.col("page").alias("page_id"), "url", F.col("type").alias("record_type"), F.when(revisit, F.col("original")).otherwise(F.col("content")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(own).alias("payload_digest"), F.when(revisit, F.col("refers")).alias("refers_to"), F.when(~revisit, own == F.col("digest")).alias("digest_matches"),
    )


def _joined(spark: SparkSession, path: str, broken: DataFrame) -> DataFrame:
    """(file, start, sha1_joined) of records whose payload holds version lines: their pieces put together.

    A piece belongs to the last broken record that has begun before it in its file, if that has not ended: found in
    one ordered pass over each file with such records.
    """
    pieces = _pieces(spark, path).withColumn("length", F.octet_length("value").cast("long"))
    placed = _offsets(pieces.join(broken.select("file").distinct(), "file", "left_semi"), ["value"])
    begins = broken.select("file", "start", F.struct(F.col("start").alias("record"), "next", "head_bytes", "content").alias("begins"))
    so_far = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    owned = placed.join(begins, ["file", "start"], "left").withColumn("of", F.last("begins", ignorenulls=True).over(so_far))
    inside = owned.filter(F.col("start") < F.col("of.next")).select("file", "start", "value", "of.record", "of.head_bytes", "of.content")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda p: p["value"]), VERSION)
    whole = inside.groupBy("file", "record", "head_bytes", "content").agg(text.alias("text"))
    body = F.substring(F.col("text").cast("binary"), (F.col("head_bytes") + 1).cast("int"), F.col("content").cast("int"))
    return whole.select("file", F.col("record").alias("start"), F.sha1(body).alias("sha1_joined"))


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages' archives to the shared folder and read them back: the digest of every record."""
    spark = pages.sparkSession
    path = stage_path(spark, "warc")
    write_archives(pages.select("page_id", "url", "html"), path, least=least)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
