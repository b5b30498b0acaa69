"""Adaptive statistics over streams, step for step as ``operators.state`` folds them in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import ema_step, health_step, vote_step


def _folded(stream: DataFrame, key: str, order: list[str], read: str, result: str, state: str, start: tuple, step, show) -> DataFrame:
    """A keyed fold over each trigger's rows in order; one updated row a key and trigger.

    Order holds inside a trigger; a row that comes in a later trigger than a younger one counts when it comes.  The state of a
    key is a few numbers and is kept for as long as the query lives.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else start
        rows = pd.concat(list(frames)).sort_values(order)[read]
        for x in rows.array:
            now = step(now, x)
        held.update(now)
        yield pd.DataFrame([(k[0], *show(now))], columns=[x.split()[0] for x in result.split(", ")])

    return stream.groupBy(key).applyInPandasWithState(run, result, state, "update", GroupStateTimeout.NoTimeout)


def ema(stream: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Running mean with strays dropped: ``key, mean, n``."""
    kind = dict(stream.dtypes)[key]

    def step(now, x):
        if x is None or x != x:
            return now
        mean, n = ema_step(None if now[1] == 0 else now[0], now[1], float(x))
        return mean, n

    return _folded(stream, key, order, value, f"{key} {kind}, mean double, n long", "mean double, n long", (0.0, 0), step, lambda s: s)


def votes(stream: DataFrame, key: str, order: list[str], form: str) -> DataFrame:
    kind = dict(stream.dtypes)[key]
    return _folded(stream, key, order, form, f"{key} {kind}, form string, votes long", "form string, votes long", ("", 0), lambda s, x: vote_step(s[0] if s[1] else None, s[1], x), lambda s: s)


def decayed_health(stream: DataFrame, key: str, order: list[str], success: str) -> DataFrame:
    kind = dict(stream.dtypes)[key]
    show = lambda s: (*s, (s[0] + 2) / (s[0] + s[1] + 3))
    return _folded(stream, key, order, success, f"{key} {kind}, ok double, fail double, health double", "ok double, fail double", (0.0, 0.0), lambda s, x: health_step(s[0], s[1], bool(x)), show)


def windowed_rms(stream: DataFrame, at: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Root mean square of tumbling event-time windows; rows later than the watermark allows are dropped."""
    timed = stream.withWatermark(at, late)
    return timed.groupBy(F.window(at, width)).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.count("*").alias("n"))
