"""Writers: document files, logs, progress, and the job queue's stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def write_documents(documents: DataFrame, path: str) -> None:
    """Document objects as JSON lines, nulls kept."""
    documents.write.option("ignoreNullFields", False).mode("overwrite").json(path)


#: Bytes of a log file.
LOG_BYTES = 50 << 20


def append_log(entries: DataFrame, path: str, bytes_a_file: int = LOG_BYTES) -> None:
    """Log entries as JSON lines, nulls left out, in files of at most bytes_a_file, but for an entry that is larger by itself.

    Each task adds up the encoded sizes of its entries, in their order, and begins a new file before the one that would go over.
    """
    run = uuid.uuid4().hex

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file, held, n = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            files = []
            for size in pc.binary_length(batch.column(0)).to_pylist():
                if held and held + size + 1 > bytes_a_file:
                    file, held = file + 1, 0
                held += size + 1
                files.append(f"{run}-{part:06}-{file:06}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.string()), pa.array(range(n, n + len(batch)), pa.int64())], names=["value", "file", "n"])
            n += len(batch)

    lines = entries.select(F.to_json(F.struct(*entries.columns)).alias("value")).mapInArrow(packed, "value string, file string, n long")
    lines.sortWithinPartitions("file", "n").select("value", "file").write.mode("append").partitionBy("file").text(path)


def read_log(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Log entries, broken lines left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)


def mark_progress(spark: SparkSession, path: str, results: DataFrame) -> None:
    """Append (batch_id, phase, file, status, error, ts) rows."""
    results.select("batch_id", "phase", "file", "status", "error", "ts").write.mode("append").parquet(path)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Latest status of each file and phase: a later success removes a failure."""
    last = F.max_by(F.struct("status", "error"), F.col("ts")).alias("last")
    return spark.read.parquet(path).groupBy("batch_id", "phase", "file").agg(last).select("batch_id", "phase", "file", "last.status", "last.error")


def new_files(archived: DataFrame, found: DataFrame) -> DataFrame:
    """Found files that the archive lacks, by name."""
    name = F.substring_index("path", "/", -1)
    return found.withColumn("name", name).join(archived.select(name.alias("name")).distinct(), "name", "left_anti").drop("name")


def job_queue(
    spark: SparkSession, path: str, schema: StructType | str, process: Callable[[DataFrame, int], None], checkpoint: str, files_a_batch: int = 1,
) -> StreamingQuery:
    """Jobs are files put into a folder; each micro-batch hands the oldest ones to process, in order, once."""
    jobs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)
    return jobs.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
