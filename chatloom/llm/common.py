"""What the corpus operators share: reading tables, and cutting lineage with a written table."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it, in regular-expression form.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_dir() -> str:
    made = tempfile.mkdtemp(prefix="chatloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, as in tests on one machine, a temporary folder takes its place; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found.rstrip("/") if found else _own_dir()


def new_dir(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: no lineage, and no loss with an executor."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Delete a table that ``cut`` wrote and nothing reads any more."""
    _delete(df.sparkSession, df.inputFiles()[0].rpartition("/")[0])


_written: list[str] = []


@contextmanager
def temporary(spark: SparkSession):
    """Tables that ``cut`` writes inside the block are deleted at its end, so write what is to stay before that.

    An operator's result reads such tables: a caller who runs it inside the block and writes it elsewhere leaves nothing.
    """
    begin = len(_written)
    try:
        yield
    finally:
        for path in _written[begin:]:
            _delete(spark, path)
        del _written[begin:]


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores before them where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def with_row_key(df: DataFrame, label: str = "rows") -> tuple[DataFrame, str]:
    """``df`` written out with a column that numbers its rows, and that column's name: a doc_id may repeat or be null."""
    (name,) = unused(df, "row")
    return cut(df.withColumn(name, F.monotonically_increasing_id()), label), name


def broadcast_if_small(df: DataFrame, row_bytes: Column | int, limit: int = 32 << 20) -> DataFrame:
    """``df`` (a written table) to be broadcast if its rows, of so many bytes each, are within the limit; else as it is."""
    return F.broadcast(df) if (df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0) <= limit else df


def thinned(df: DataFrame, most: int, *keys: str | Column) -> DataFrame:
    """``df`` thinned out to about ``most`` rows by a hash of ``keys``, the same whatever the partitions; all of a smaller one.

    A sort with a limit takes that many rows from each task, so it follows this where there may be many tasks.
    """
    n = df.count()
    return df if n <= most else df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 32)) < int(most / n * (1 << 32)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a plain expression would be computed wherever it is named."""
    return F.transform(F.array(value), body)[0]


def vocabulary(name: str) -> str:
    """Where the installed package of public tokenizers keeps a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
