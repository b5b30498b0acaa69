"""Streams whose state is bounded: stores that forget what was used longest ago, ratios of two streams.

``lru``, ``blame`` and ``listening`` keep, for each group, at most ``keep`` items in a map state and clear a group that has been idle
for ``idle`` of event time by a timer.  The state of a query is bounded by groups in use, not by what has ever been seen.  They need the
state store that keeps maps, which an application chooses: ``spark.sql.streaming.stateStore.providerClass`` set to ``ROCKSDB``.

Defined results
    order                rows of a group and trigger count in order of time, then item, then their other columns; rows of a later trigger when they come
    late rows            older than the watermark: dropped by Spark before they reach the state
    null time            never passes the watermark: dropped; a null group or item is one of its own
    ties in last use     the greater item stays
    repeated rows        count as often as they come
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.state import listening_step

#: Class of the state store that these need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _processor(item_type: str, fields: list[str], start: tuple, step: Callable, keep: int, idle_ms: int) -> StatefulProcessor:
    names = [f.split()[0] for f in fields]

    class Store(StatefulProcessor):
        """A map of item to its numbers and its last use, and a timer at the last use of all and ``idle_ms``."""

        def init(self, handle) -> None:
            self.handle = handle
            self.items = handle.getMapState("items", f"item {item_type}", ", ".join([*fields, "used bigint"]))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            rows = pd.concat(list(rows))
            rows = rows.sort_values([c for c in rows.columns if c != "group_key"], kind="stable")
            changed = {}
            for item, used, x in zip(rows["item_key"], rows["used_ms"], rows["step_value"], strict=True):
                item = None if pd.isna(item) else item
                if item not in changed:
                    held = self.items.getValue((item,)) if self.items.containsKey((item,)) else None
                    changed[item] = (held[:-1], held[-1]) if held else (start, -1)
                numbers, before = changed[item]
                changed[item] = step(numbers, x), max(int(used), before)
            for item, (numbers, used) in changed.items():
                self.items.updateValue((item,), (*numbers, used))
            # At most ``keep`` and what one trigger brings stand here.
            by_use = sorted(((v[-1], k[0] is not None, k[0], v) for k, v in self.items.iterator()), key=lambda e: e[:3])
            gone = by_use[: max(0, len(by_use) - keep)]
            for _, _, item, _ in gone:
                self.items.removeKey((item,))
            out = {e[2] for e in gone}
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(by_use[-1][0] + idle_ms)
            yield self.made(key, [(i, *n, u, "kept") for i, (n, u) in changed.items() if i not in out] + [(i, *v[:-1], u, "evicted") for u, _, i, v in gone])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            rows = [(k[0], *v, "expired") for k, v in self.items.iterator()]
            self.items.clear()
            yield self.made(key, rows)

        def made(self, key, rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["item", *names, "used", "state"])
            out["used"] = pd.to_datetime(out["used"], unit="ms")
            out.insert(0, "group", [key[0]] * len(out))
            return out

        def close(self) -> None:
            pass

    return Store()


def _bounded(stream: DataFrame, group: str, item: str, at: str, x: Column, fields: list[str], start: tuple, step: Callable, keep: int, idle: str, late: str) -> DataFrame:
    types = dict(stream.dtypes)
    idle_ms = int(stream.sparkSession.sql(f"SELECT INTERVAL {idle} AS i").first().i.total_seconds() * 1000)
    timed = stream.withWatermark(at, late).select(F.col(group).alias("group_key"), F.unix_millis(F.col(at)).alias("used_ms"), F.col(item).alias("item_key"), x.alias("step_value"), F.col(at).alias("event_time"))
    schema = f"group {types[group]}, item {types[item]}, {', '.join(fields)}, used timestamp, state string"
    return timed.where(F.col("used_ms").isNotNull()).groupBy("group_key").transformWithStateInPandas(_processor(types[item], fields, start, step, keep, idle_ms), schema, "update", "eventTime")


def lru(stream: DataFrame, group: str, item: str, at: str, keep: int, idle: str = "30 days", late: str = "1 hour") -> DataFrame:
    """Uses of the ``keep`` items that each group used last: ``group, item, uses, used, state`` of what a trigger changed; state is kept, evicted or expired."""
    return _bounded(stream, group, item, at, F.lit(1), ["uses bigint"], (0,), lambda n, x: (n[0] + 1,), keep, idle, late)


def blame(stream: DataFrame, group: str, item: str, at: str, rewound: str, candidates: str, keep: int, idle: str = "30 days", late: str = "1 hour") -> DataFrame:
    """Blame of each item, as ``operators.state.blame`` sums it, in millionths: ``group, item, blame, used, state``."""
    step = F.when(F.col(rewound), F.least(F.lit(1.0), F.lit(3.0) / F.col(candidates))).otherwise(-0.1)
    return _bounded(stream, group, item, at, F.round(step * 1_000_000).cast("long"), ["blame bigint"], (0,), lambda n, x: (max(0, n[0] + int(x)),), keep, idle, late)


def listening(stream: DataFrame, group: str, item: str, at: str, rewound: str, keep: int, idle: str = "30 days", late: str = "1 hour") -> DataFrame:
    """Decayed counts of rewinds and chunks heard: ``group, item, rewinds, heard, used, state``."""
    return _bounded(stream, group, item, at, F.col(rewound), ["rewinds double", "heard double"], (0.0, 0.0), lambda n, x: tuple(map(float, listening_step(n[0], n[1], bool(x)))), keep, idle, late)


def calibrated(service: DataFrame, device: DataFrame, key: str, at: str, value: str, width: str = "1 day", late: str = "1 hour", **bounds) -> DataFrame:
    """The calibrated ratio of two streams, window by window: ``key, window, ratio``.

    Either side is summed by window of event time under a watermark of its own; sums of closed windows meet in a join of streams, whose
    state goes when the slower watermark passes the window.  Rows come in any order until their window closes.
    """
    sides = []
    for stream in (service, device):
        timed = stream.withWatermark(at, late).where(F.col(value).isNotNull())
        means = timed.groupBy(key, F.window(at, width).alias("window")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
        sides.append(means.select(F.struct(key, "window").alias("__k"), "window", "mean", "n"))
    # The window stands beside the key so that Spark sees the event time the join is on.
    left, right = sides[0], sides[1].withColumnsRenamed({"window": "__w", "__k": "__k2", "mean": "__m2", "n": "__n2"})
    met = left.join(right, (F.col("__k") == F.col("__k2")) & (F.col("window") == F.col("__w")))
    return met.select(F.col(f"__k.{key}").alias(key), "window", _ratio(**bounds).alias("ratio"))


def _ratio(least: int = 6, low: float = 0.70, high: float = 1.45) -> Column:
    """The rule of ``operators.state.calibrated_ratio`` over both sides in one row."""
    ratio = F.greatest(F.lit(low), F.least(F.lit(high), F.try_divide(F.col("mean"), F.col("__m2"))))
    return F.when((F.col("n") >= least) & (F.col("__n2") >= least) & (F.col("__m2") != 0), ratio).otherwise(1.0)
