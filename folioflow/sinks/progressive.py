"""Results that arrive bit by bit, of requests that may be asked anew or cancelled meanwhile: a ``foreachBatch`` sink and what reads it.

A request is asked in generations, each of which makes the ones before stale.  Every micro-batch is written to a folder of its own name,
which a replayed batch replaces, so a row that is sent again after a failure is there once.  Requests and cancellations are
rows appended beside the results.  What is stale or cancelled when a batch comes is not written; what becomes so later is hidden by
``results`` at once and removed by ``sweep``.  All of it is joined by request; nothing but numbers of batches reaches the driver.

Layout under ``path``: ``asked`` (``request, generation, cancelled``) and ``rows/batch=<number>``.

Defined results
    rows without request or generation     dropped: they answer nothing
    never asked                            the newest generation that has results counts
    asked anew, no results yet             nothing: the older generation is stale already
    cancelled                              nothing of that generation; the one before stays stale
    repeated rows inside a batch           kept as they are
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import pinned

_OWN = "__r_"


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def ask(requests: DataFrame, path: str, request: str = "request", generation: str = "generation", cancelled: bool = False) -> None:
    """Note that generations of requests were asked or, with ``cancelled``, given up; noting one twice changes nothing."""
    rows = requests.select(F.col(request).alias("request"), F.col(generation).cast("long").alias("generation"), F.lit(cancelled).alias("cancelled"))
    rows.where("request is not null and generation is not null").write.mode("append").parquet(f"{path}/asked")


def _asked(spark: SparkSession, path: str) -> DataFrame | None:
    files, where = _folder(spark, f"{path}/asked")
    return spark.read.parquet(f"{path}/asked") if files.exists(where) else None


def _live(rows: DataFrame, asked: DataFrame | None, request: str, generation: str) -> DataFrame:
    """Rows of the newest generation of each request, unless it is cancelled."""
    rows = rows.where(F.col(request).isNotNull() & F.col(generation).isNotNull())
    known = rows.select(F.col(request).alias(_OWN + "q"), F.col(generation).cast("long").alias(_OWN + "g"), F.lit(False).alias(_OWN + "c"))
    if asked is not None:
        known = known.unionByName(asked.select(F.col("request").alias(_OWN + "q"), F.col("generation").alias(_OWN + "g"), F.col("cancelled").alias(_OWN + "c")))
    # Of equal generations the greater is the cancelled one, so one maximum says both.
    newest = known.groupBy(_OWN + "q").agg(F.max(F.struct(_OWN + "g", _OWN + "c")).alias(_OWN + "n"))
    newest = newest.where(~F.col(f"{_OWN}n.{_OWN}c")).select(_OWN + "q", F.col(f"{_OWN}n.{_OWN}g").alias(_OWN + "g"))
    return rows.join(newest, (F.col(request) == F.col(_OWN + "q")) & (F.col(generation).cast("long") == F.col(_OWN + "g")), "left_semi")


def sink(path: str, request: str = "request", generation: str = "generation") -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: one folder a batch, replaced if the batch is replayed."""

    def write(batch: DataFrame, number: int) -> None:
        _live(batch, _asked(batch.sparkSession, path), request, generation).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    return write


def results(spark: SparkSession, path: str, request: str = "request", generation: str = "generation") -> DataFrame:
    """What stands now, with the number of the ``batch`` that brought it."""
    return _live(spark.read.parquet(f"{path}/rows"), _asked(spark, path), request, generation)


def sweep(spark: SparkSession, path: str, request: str = "request", generation: str = "generation") -> None:
    """Remove from storage what ``results`` hides; the sink must be at rest.  A sweep that was cut short is made good by the next."""
    before = {r.batch for r in spark.read.parquet(f"{path}/rows").select("batch").distinct().collect()}
    live = pinned(results(spark, path, request, generation))
    left = {r.batch for r in live.select("batch").distinct().collect()}
    live.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/rows")
    for number in before - left:
        files, where = _folder(spark, f"{path}/rows/batch={number}")
        files.delete(where, True)
