"""Readers, classification of files, keyed upserts and deletes."""

from __future__ import annotations

import mimetypes
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.text import extension, file_size

TEXT, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()

CHUNK_INPUT = T.StructType(
    [T.StructField("page_number", INT), T.StructField("chunk_index", INT), T.StructField("paragraph_text", TEXT), T.StructField("timestamp", TEXT)]
)
METADATA = T.StructType(
    [T.StructField(c, TEXT) for c in ("title", "path", "author", "created_date", "source_type", "language", "total_pages", "file_name")]
    + [T.StructField("tags", T.ArrayType(TEXT)), T.StructField("extra_metadata", T.MapType(TEXT, TEXT))]
)
DOCUMENT = T.StructType([T.StructField("document_metadata", METADATA), T.StructField("chunks", T.ArrayType(CHUNK_INPUT)), T.StructField("_corrupt_record", TEXT)])

# Extensions by category, their archive folders and source types, MIME types, and what uploads may be.
CATEGORIES = {
    "document": (".pdf", ".docx", ".doc", ".pptx", ".ppt", ".xlsx", ".xls", ".csv", ".html", ".htm"),
    "audio": (".mp3", ".wav", ".m4a", ".flac"),
    "image": (".jpg", ".jpeg", ".png", ".webp"),
}
FOLDERS = {
    "PDF": (".pdf",),
    "WORD": (".docx", ".doc"),
    "PPT": (".pptx", ".ppt"),
    "EXCEL": (".xlsx", ".xls", ".csv"),
    "HTML": (".html", ".htm"),
    "AUDIO": (".mp3", ".wav", ".m4a", ".flac"),
    "IMAGES": (".jpg", ".jpeg", ".png", ".webp"),
}
SOURCE_TYPES = {
    "pdf": (".pdf",),
    "docx": (".docx", ".doc"),
    "pptx": (".pptx", ".ppt"),
    "xlsx": (".xlsx", ".xls", ".csv"),
    "web": (".html", ".htm"),
    "audio": (".mp3", ".wav", ".m4a", ".flac"),
    "image": (".jpg", ".jpeg", ".png", ".webp"),
}
MIME_CATEGORIES = {
    "document": (
        "application/pdf",
        "application/msword",
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
        "application/vnd.ms-powerpoint",
        "application/vnd.openxmlformats-officedocument.presentationml.presentation",
        "application/vnd.ms-excel",
        "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
        "text/csv",
        "text/html",
    ),
    "audio": ("audio/mpeg", "audio/mp3", "audio/wav", "audio/x-wav", "audio/mp4", "audio/x-m4a", "audio/flac"),
    "image": ("image/jpeg", "image/png", "image/webp"),
}
UPLOADS = (".pdf", ".docx", ".pptx", ".xlsx", ".mp3", ".wav", ".jpg", ".png")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Document files, one JSON object each, with their path; files that don't parse keep their text in _corrupt_record."""
    raw = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return raw.select("*", F.col("_metadata.file_path").alias("file"))


def validated(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid documents, and the others with the reason."""
    chunk_bad = F.exists(
        "chunks",
        lambda c: c["chunk_index"].isNull() | (c["chunk_index"] < 1) | (F.coalesce(c["page_number"], F.lit(1)) < 1) | (
            F.length(F.trim(F.coalesce(c["paragraph_text"], F.lit("")))) == 0
        ),
    )
    reason = (
        F.when(F.col("_corrupt_record").isNotNull() | F.col("document_metadata").isNull(), "not a document object")
        .when(F.coalesce(F.size("chunks"), F.lit(0)) < 1, "no chunks")
        .when(chunk_bad, "invalid chunk")
    )
    judged = documents.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def scan_files(spark: SparkSession, path: str, recursive: bool = True, pattern: str = "*") -> DataFrame:
    """Files of a folder by path, with size, MIME type, category and archive folder; contents are not read.

    One row a file, in the order of their paths (a listing, not the files' data).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(path)
    name = F.col("path")
    mime = mime_type(name)
    return files.select(
        "path", "length", "modificationTime", mime.alias("mime_type"), category(name, mime).alias("category"),
        folder_type(name).alias("folder_type"),
    ).orderBy("path")


def _by_extension(name: Column, known: dict[str, tuple[str, ...]], other: str) -> Column:
    ext = extension(name)
    out = F.when(F.lit(False), "")
    for kind, extensions in known.items():
        out = out.when(ext.isin(*extensions), kind)
    return out.otherwise(other)


def mime_type(name: Column) -> Column:
    """MIME type that the platform's table gives for the extension, or null."""
    known = F.create_map(*[F.lit(x) for pair in sorted(mimetypes.types_map.items()) for x in pair])
    return F.try_element_at(known, extension(name))


def category(name: Column, mime: Column | None = None) -> Column:
    """By extension, else by the MIME type, else unknown."""
    found = _by_extension(name, CATEGORIES, "unknown")
    if mime is None:
        return found
    other = F.when(F.lit(False), "")
    for kind, types in MIME_CATEGORIES.items():
        other = other.when(mime.isin(*types), kind)
    return F.when(found != "unknown", found).otherwise(other.otherwise("unknown"))


def folder_type(name: Column) -> Column:
    """Archive folder of a file, OTHER for unknown extensions."""
    return _by_extension(name, FOLDERS, "OTHER")


def source_type(name: Column) -> Column:
    """Source type of a file, unknown for unknown extensions."""
    return _by_extension(name, SOURCE_TYPES, "unknown")


SEGMENTS = "filename string, duration_seconds double, language string, segments array<struct<start double, end double, text string>>"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, language, start, end, text) of recognised speech: a JSON file a recording, a row a segment."""
    raw = spark.read.schema(SEGMENTS).option("multiLine", True).json(path)
    rows = raw.select(F.coalesce("filename", F.col("_metadata.file_name")).alias("file"), F.coalesce("language", F.lit("en")).alias("language"), F.inline("segments"))
    return rows.select("file", "language", "start", "end", F.trim("text").alias("text"))


def read_images(spark: SparkSession, path: str, describe: Callable[[Column], Column]) -> DataFrame:
    """(path, markdown) of a folder's images: a model's description of each one's bytes under its name and size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(category(F.col("path")) == "image")
    name = F.substring_index("path", "/", -1)
    head = F.concat(F.lit("# "), name, F.lit("\n\n![Image]("), F.col("path"), F.lit(")\n\n**Size:** "), file_size(F.col("length")), F.lit("\n\n"))
    return files.select("path", F.concat(head, F.coalesce(describe(F.col("content")), F.lit(""))).alias("markdown"))


def uploadable(name: Column) -> Column:
    """Whether an upload of this name is taken: a known extension and no way out of its folder."""
    return extension(name).isin(*UPLOADS) & ~F.contains(name, F.lit(".."))


def archive_kind(name: Column) -> Column:
    """video, photo or report, by the name's ending."""
    return F.when(name.rlike(r"(?i)\.(mp4|mkv|mov|webm)$"), "video").when(name.rlike(r"(?i)\.(jpe?g|png|webp)$"), "photo").otherwise("report")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Both tables' rows with one row a key: the one of highest version, new before stored on ties.

    One shuffle on the keys; the largest version is taken by a partial aggregate, so a key that is written
    very often is not sorted in one task.
    """
    rest = [c for c in stored.columns if c not in keys]
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "__new")).alias("__row"))
    return newest.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*stored.columns)


def checked_upsert(stored: DataFrame, new: DataFrame, keys: list[str], version: str, required: list[str]) -> DataFrame:
    """upsert, all or nothing: the job fails if a new row lacks a key or a required value."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in (*keys, *required)])
    problem = F.concat(F.lit("row without a required value: "), F.to_json(F.struct(*keys)))
    return upsert(stored, new.filter(F.when(missing, F.raise_error(problem).cast("boolean")).otherwise(True)), keys, version)


def delete(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(gone.select(*keys).distinct(), keys, "left_anti")


def multi_get(ids: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Each asked id, in the given columns, with the stored row or nulls."""
    return ids.join(stored, key, "left")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row a key by an order: the first-occurrence dedup of ordered lists."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
