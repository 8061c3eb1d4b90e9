"""Event lines of streamed answers, put together from network pieces that are cut anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces whose line ends are summed in one go.
RUN = 65_536


def lines(pieces: DataFrame, stream: str = "stream", seq: str = "seq", body: str = "body") -> DataFrame:
    """(stream, line_no, line): the whole lines of each stream's pieces (stream, seq long, body string or binary) in the order of seq.

    A piece ends its predecessors' open line at its first line end and leaves one open after its last; the number of line
    ends before a piece, a running sum of numbers over runs of pieces and then within them, says which line its
    fragments are of. So only fragments of lines that several pieces hold are brought together, whatever the length of a line or of a
    stream. Characters that a cut parts are whole again. What follows a stream's last line end is not a line. Null pieces are empty.
    """
    # A character for each byte, so that a cut within a character does no harm.
    text = F.decode(F.coalesce(F.col(body).cast("binary"), F.lit(b"")), "ISO-8859-1")
    cut = pieces.select(F.col(stream).alias("__s"), F.col(seq).cast("long").alias("__i"), F.split(text, "\n", -1).alias("__f"))
    cut = cut.withColumns({"__ends": (F.size("__f") - 1).cast("long"), "__run": F.floor(F.col("__i") / RUN)})
    runs = cut.groupBy("__s", "__run").agg(F.sum("__ends").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__s").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("__s", "__run", F.coalesce(before, F.lit(0)).alias("__start"))
    within = F.sum("__ends").over(Window.partitionBy("__s", "__run").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1))
    ends = cut.select("__s", "__i", "__run", "__ends").withColumn("__within", F.coalesce(within, F.lit(0)))
    at = ends.join(runs, (ends["__run"] == runs["__run"]) & ends["__s"].eqNullSafe(runs["__s"])).select(ends["__s"].alias("__t"), ends["__i"].alias("__j"), (F.col("__start") + F.col("__within")).alias("__first"))
    placed = cut.join(at, (cut["__i"] == at["__j"]) & cut["__s"].eqNullSafe(at["__t"])).select("__s", "__i", "__ends", "__first", F.posexplode("__f").alias("__k", "__x"))
    placed = placed.withColumn("__line", F.col("__first") + F.col("__k"))
    decoded = lambda c: F.make_valid_utf8(F.encode(c, "ISO-8859-1").cast("string"))
    inner = (F.col("__k") > 0) & (F.col("__k") < F.col("__ends"))  # a line that begins and ends in its piece
    whole = placed.filter(inner).select("__s", "__line", F.col("__x").alias("__text"))
    parts = placed.filter(~inner).groupBy("__s", "__line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__x"))), lambda p: p["__x"]), "").alias("__text"),
        F.max(F.col("__k") < F.col("__ends")).alias("__ended"),
    )
    every = whole.unionByName(parts.filter("__ended").drop("__ended"))
    return every.select(F.col("__s").alias(stream), F.col("__line").alias("line_no"), decoded(F.col("__text")).alias("line"))


def payload(line: Column) -> Column:
    """The data of an event line, or null."""
    bare = F.regexp_replace(line, r"^\s+|\s+$", "")
    return F.when(F.startswith(bare, F.lit("data:")), F.nullif(F.regexp_replace(F.substr(bare, F.lit(6)), r"^\s+|\s+$", ""), F.lit("")))


def events(rows: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """rows with `event`, the object that their line carries; lines without one, and those that are not whole JSON, are left out."""
    parsed = F.from_json(payload(F.col(line)), f"{schema}, __broken string", {"columnNameOfCorruptRecord": "__broken"})
    names = [part.split()[0].strip("`:") for part in schema.split(",")]
    out = rows.withColumn("__event", parsed).filter(F.col("__event").isNotNull() & F.col("__event.__broken").isNull())
    return out.withColumn("event", F.struct(*[F.col(f"__event.{n}").alias(n) for n in names])).drop("__event")
