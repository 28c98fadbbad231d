"""Calls to a provider that survive: what has been answered is on disk, and is never asked again.

A ledger is a folder of Parquet files, (key, reply, error) each, where a key is the hash of all that is sent. Before a call
the ledger is read; only requests without a reply go out, equal ones once. Requests are dealt out to small tasks whose files
join the ledger as each task ends, so a job that dies leaves what its tasks were told, and the next one asks for the rest. A
call that fails is tried a bounded number of times; then its error is a row, and no other call is lost for it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.storage import new_folder

LEDGER = "key string, reply string, error string"
#: Requests of a task, and times that a call is tried.
TASK_CALLS, ATTEMPTS = 20, 3


def request_key(system: Column, user: Column) -> Column:
    return F.sha2(F.concat(F.length(system).cast("string"), F.lit(":"), system, user), 256)


def _told(spark: SparkSession, folder: str) -> DataFrame:
    """(key, reply, error): one row for each key, a reply if there is one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.schema(LEDGER).parquet(folder)
    return rows.groupBy("key").agg(F.min("reply").alias("reply"), F.max("error").alias("error"))


def answered(requests: DataFrame, provider: Callable[[], object], folder: str | None = None, attempts: int = ATTEMPTS, wait: float = 0.0, method: str = "chat") -> DataFrame:
    """``requests`` (with ``system`` and ``user``, texts that are not null) with ``reply`` and ``error`` in place of them: the
    provider's reply, or why there is none after ``attempts`` tries, ``wait`` seconds apart and doubling.

    ``folder`` is the ledger; without one it is this call's own, and is nothing to come back to. Calls are made when this is
    called. An error of an earlier run is not an answer: such a request is asked again.
    """
    spark = requests.sparkSession
    folder = folder or new_folder(spark, "ledger")
    keyed = requests.withColumn("_key", request_key(F.col("system"), F.col("user")))
    known = _told(spark, folder).where("reply is not null").select(F.col("key").alias("_key"))
    new = keyed.select("_key", "system", "user").dropDuplicates(["_key"]).join(known, "_key", "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for pdf in batches:
            rows = []
            for key, system, user in zip(pdf["_key"], pdf["system"], pdf["user"], strict=True):
                reply = error = None
                for k in range(attempts):
                    try:
                        reply, error = getattr(model, method)(system, user), None
                        break
                    except Exception as e:  # noqa: BLE001 - whatever a provider throws is its answer
                        error = f"{type(e).__name__}: {e}"
                        if wait and k + 1 < attempts:
                            time.sleep(wait * 2**k)
                rows.append((key, reply if reply is not None or error else "", error))
            yield pd.DataFrame(rows, columns=["key", "reply", "error"], dtype=object)

    count = new.count()
    if count:
        tasks = -(-count // TASK_CALLS)
        # Version 2: a task's file is in the folder when the task ends, and not first when all have ended.
        told = new.repartition(tasks, "_key").mapInPandas(ask, LEDGER)
        told.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("append").parquet(folder)
    found = _told(spark, folder).select(F.col("key").alias("_key"), "reply", F.when(F.col("reply").isNull(), F.col("error")).alias("error"))
    return keyed.drop("system", "user").join(found, "_key", "left").drop("_key")
