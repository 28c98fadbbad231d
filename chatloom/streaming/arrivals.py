"""Exports that arrive: a stream of files, converted batch by batch.

An adapter is column expressions and a few passes over a table, so a stream is converted as a sequence of tables: Spark's file
source lists what is new (its schema is known without reading), and each micro-batch goes through ``convert_files``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from chatloom.sources.registry import Converted, convert_files

#: The schema of the files that a stream of binary files gives.
BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_files(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """A stream of the files (source_id, path, content) in a folder, at most so many in a batch."""
    rows = spark.readStream.schema(BINARY).option("maxFilesPerTrigger", most).format("binaryFile").load(path)
    return rows.selectExpr("path as source_id", "path", "content")


def convert_arrivals(files: DataFrame, folder: str, checkpoint: str, only_present: bool = True, **options) -> StreamingQuery:
    """Convert a stream of files (source_id, path, content), with the options of ``convert_files``, below ``folder``.

    Messages and status of a batch are a folder named after its number. A batch that is run again after a failure writes that
    folder anew, so nothing is there twice. ``only_present``: the query ends with what is there when it starts.
    """

    def convert(batch: DataFrame, number: int) -> None:
        found = convert_files(batch, **options)
        for name in ("messages", "status"):
            getattr(found, name).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    writer = files.writeStream.foreachBatch(convert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if only_present else writer).start()


def converted_arrivals(spark: SparkSession, folder: str) -> Converted:
    """What such a query has written so far."""
    return Converted(*(spark.read.parquet(f"{folder}/{name}").drop("batch") for name in ("messages", "status")))
