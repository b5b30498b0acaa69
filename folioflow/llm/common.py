"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import pickle
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the ASCII control characters tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.  Only a local master may do without: there a temporary folder stands in."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Has the driver collect what nothing refers to any more: Spark then removes the shuffle files of steps that are checkpointed, which else lie on disk until the driver's heap fills."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def files_removed(spark: SparkSession) -> Iterator[None]:
    """While this lasts, Spark removes the shuffle files of each action on data frames made here as the action ends.

    For applications, as it sets the session and puts it back: steps that end in a checkpoint never read those files
    again, and what still refers to them keeps them from ``release``.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: So many keys of few bytes are broadcast at most.
SENT = 500_000


def sent(keys: DataFrame) -> DataFrame:
    """``keys``, written to the shared folder, marked for broadcast if they are at most ``SENT`` rows; beyond, a join deals both sides by key."""
    kept = checkpointed(keys)
    return F.broadcast(kept) if kept.count() <= SENT else kept


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow array of texts without nulls, not copied, and where each begins and the last ends."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), places


#: Rows of text that a Python worker of the registered queries gets at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Has Arrow batches hold ``BATCH_ROWS`` rows, where the session has Spark's own default of 10,000.

    For applications (the registered queries, the pipeline) to call once, as it sets the session; operators never do.
    Workers keep a batch of texts, its result and both their Arrow forms; the smaller batch bounds all four.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def shared(df: DataFrame, value: object):
    """A function that gives ``value`` in any task: broadcast once, with its classes, so executors need no copy of this package.

    A worker keeps what it has unpacked until it calls ``forget``.
    """
    sent, held = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get():
        if not held:
            held.append(pickle.loads(sent.value))
        return held[0]

    get.forget = held.clear
    return get


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by a key over the session's full number of shuffle partitions.

    For few small rows that are about to become many: adaptive execution would merge
    them into one task by what they weigh before.  The key is hashed once more, else
    the deal would be dropped as one the rows already have.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(key))


#: Pieces of a long text that an excerpt is made of.
PIECES = 16


def excerpt(text: Column, chars: int) -> Column:
    """A text of up to so many characters whole, of a longer one ``PIECES`` pieces from evenly spread places, that long together."""
    size = max(1, chars // PIECES)
    step = (F.length(text) - size) / (PIECES - 1)
    parts = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring(text, (i * step).cast("int") + 1, F.lit(size)))
    return F.when(F.length(text) > chars, F.array_join(parts, "\n")).otherwise(text)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
