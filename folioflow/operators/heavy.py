"""Heavy hitters of each context: space-saving counters in the form that merges.

A sketch holds at most ``k`` counters of a context and an error: what was taken off all of them alike to stay within ``k``.  An
item's true count lies between its counter and its counter plus the error, and the error is at most n / (k + 1) of the n items seen, so
every item with a larger share is held.  Sketches merge by adding counters and cutting back to ``k``, and the bounds stand however
rows are dealt and in whatever order sketches meet.

Tasks sketch what they read; sketches are dealt by context and a salt, merged, dealt by context and merged again.  A task reads
them sorted by context and holds one context's at a time, so no context, however hot, is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters that a task holds before it sends them on; tasks over which the sketches of one context are dealt first.
HELD, SALTS = 500_000, 32
#: Rows and bytes that a task counts at once.
ROWS, BYTES = 500_000, 32 << 20
_SCHEMA = "context string, items array<string>, counts array<long>, error long, n long"


class Sketch:
    """At most ``k`` counters once cut."""

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}
        self.error = self.n = 0

    def add(self, items: list[str], counts: list[int], error: int, n: int) -> None:
        for item, count in zip(items, counts, strict=True):
            self.counts[item] = self.counts.get(item, 0) + count
        self.error += error
        self.n += n

    def cut(self, k: int) -> None:
        if len(self.counts) > k:
            off = int(np.partition(np.fromiter(self.counts.values(), np.int64, len(self.counts)), len(self.counts) - k - 1)[len(self.counts) - k - 1])
            self.counts = {item: c - off for item, c in self.counts.items() if c > off}
            self.error += off


def _rows(sketches: dict[str | None, Sketch], k: int) -> Iterator[pa.RecordBatch]:
    for s in sketches.values():
        s.cut(k)
    made = list(sketches.items())
    for i in range(0, len(made), 1000):
        part = made[i : i + 1000]
        yield pa.RecordBatch.from_arrays([
            pa.array([c for c, _ in part], pa.string()), pa.array([list(s.counts) for _, s in part], pa.list_(pa.string())), pa.array([list(s.counts.values()) for _, s in part], pa.list_(pa.int64())),
            pa.array([s.error for _, s in part], pa.int64()), pa.array([s.n for _, s in part], pa.int64()),
        ], ["context", "items", "counts", "error", "n"])


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches gathered to tables of ``ROWS`` rows or ``BYTES``: the more rows are counted at once, the fewer items are left to add one by one."""
    now: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        now.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= ROWS or size >= BYTES:
            yield pa.Table.from_batches(now)
            now, rows, size = [], 0, 0
    if now:
        yield pa.Table.from_batches(now)


def _sketched(k: int):
    """Sketches of what a task reads: ``context``, ``item``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, Sketch] = {}
        for table in _tables(batches):
            found = table.group_by(["context", "item"]).aggregate([([], "count_all")]).sort_by("context")
            contexts, items, counts = (found[x].to_pylist() for x in ("context", "item", "count_all"))
            first = 0
            for last in range(1, len(contexts) + 1):
                if last == len(contexts) or contexts[last] != contexts[first]:
                    s = held.setdefault(contexts[first], Sketch())
                    s.add(items[first:last], counts[first:last], 0, sum(counts[first:last]))
                    if len(s.counts) > 8 * k:
                        s.cut(k)
                    first = last
            if sum(len(s.counts) for s in held.values()) > HELD:
                yield from _rows(held, k)
                held = {}
        yield from _rows(held, k)

    return run


def _merged(k: int):
    """Sketches of the same context, which come one after the other, as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, some = Sketch(), None, False
        for batch in batches:
            for row in batch.to_pylist():
                if some and row["context"] != at:
                    yield from _rows({at: now}, k)
                    now = Sketch()
                at, some = row["context"], True
                now.add(row["items"], row["counts"], row["error"], row["n"])
                now.cut(k)
        if some:
            yield from _rows({at: now}, k)

    return run


def heavy_hitters(df: DataFrame, context: str, item: str, k: int) -> DataFrame:
    """``context``, ``item``, ``least`` and ``most`` (bounds of its count) and ``n`` (items of the context) of every counter that is left.

    Every item with more than n / (k + 1) of a context's items is there.  Null items do not count; a null context is one of its own; an empty table is empty.
    """
    rows = df.where(F.col(item).isNotNull()).select(F.col(context).cast("string").alias("context"), F.col(item).cast("string").alias("item"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketches = rows.mapInArrow(_sketched(k), _SCHEMA).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = sketches.repartition(parts, "context", "salt").sortWithinPartitions("context").drop("salt").mapInArrow(_merged(k), _SCHEMA)
    whole = some.repartition(parts, "context").sortWithinPartitions("context").mapInArrow(_merged(k), _SCHEMA)
    pairs = F.explode(F.arrays_zip("items", "counts")).alias("x")
    return whole.select("context", pairs, "error", "n").select("context", F.col("x.items").alias("item"), F.col("x.counts").alias("least"), (F.col("x.counts") + F.col("error")).alias("most"), "n")


def verified_hitters(df: DataFrame, context: str, item: str, k: int) -> DataFrame:
    """Items with more than n / (k + 1) of a context's items: ``context``, ``item``, ``count``, ``n`` and ``bounded``, whether the sketch's bounds hold.

    The sketch names candidates, at most k a context; a second look at the rows counts these alone, summed map-side.
    """
    found = heavy_hitters(df, context, item, k)
    rows = df.where(F.col(item).isNotNull()).select(F.coalesce(F.col(context).cast("string"), F.lit("")).alias("c"), F.col(context).isNull().alias("none"), F.col(item).cast("string").alias("i"))
    asked = found.select(F.coalesce("context", F.lit("")).alias("c"), F.col("context").isNull().alias("none"), F.col("item").alias("i"), "context", "least", "most", "n")
    counts = rows.join(asked.select("c", "none", "i"), ["c", "none", "i"], "left_semi").groupBy("c", "none", "i").agg(F.count("*").alias("count"))
    met = counts.join(asked, ["c", "none", "i"]).where(F.col("count") * (k + 1) > F.col("n"))
    return met.select("context", F.col("i").alias("item"), "count", "n", F.col("count").between(F.col("least"), F.col("most")).alias("bounded"))
