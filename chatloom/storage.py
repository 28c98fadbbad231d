"""Writing intermediate tables to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _own_folder() -> str:
    made = tempfile.mkdtemp(prefix="chatloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset on one machine a temporary folder takes its place, on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found.rstrip("/") if found else _own_folder()


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    _made.append(f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


_made: list[str] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is written to the shared folder inside the block is deleted at its end, so write what is to stay before that.

    A result reads what was written on its way: run the pipeline inside the block, and write its tables or packs in it too.
    """
    begin = len(_made)
    try:
        yield
    finally:
        for path in _made[begin:]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        del _made[begin:]


def written(df: DataFrame) -> DataFrame:
    """``df`` written out and read back, so that what it cost is not paid again and a lost executor loses nothing."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: Column | int, limit: int = 32 << 20) -> DataFrame:
    """``df`` (a written table) to be broadcast if its rows, of so many bytes each, are within the limit; else as it is."""
    size = df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df
