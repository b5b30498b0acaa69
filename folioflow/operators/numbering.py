"""Counters of nested lists from running windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of a list.
LEVELS = 9


def list_counters(df: DataFrame, keys: list[str], order: list[str], level: str, starts: str, out: str = "counters") -> DataFrame:
    """``df`` with the counters of all levels at each row, an array of ``LEVELS``.

    A row of level L moves that counter on and takes back all deeper ones.  A counter that has not moved since then begins with the
    start of the row that moves it first; until it moves, the row's own start stands for it.  ``keys`` name a counter set, ``order`` the
    place in it, ``starts`` an array of ``LEVELS`` numbers, null or missing ones being 1.  Levels out of bounds count as 0.

    The counter of L is a running count of rows of L less what it was at the last row of a higher level, so three running windows
    over one deal of the rows do it for all levels; they hold one row of a list at a time.

    Defined results: null keys are a set of their own, null levels count as 0, ties in ``order`` are taken in any order, an empty table is empty.
    """
    at = F.when(F.col(level).between(0, LEVELS - 1), F.col(level)).otherwise(0).cast("int")
    start = lambda k: F.coalesce(F.try_element_at(F.col(starts), F.lit(k + 1)), F.lit(1)).cast("long")
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = range(LEVELS)
    each = lambda name, made: {f"__{name}{k}": made(k) for k in levels}
    rows = df.withColumn("__at", at).withColumns(each("seen", lambda k: F.sum((F.col("__at") == k).cast("long")).over(upto)))
    rows = rows.withColumns(each("back", lambda k: F.coalesce(F.last(F.when(F.col("__at") < k, F.col(f"__seen{k}")), ignorenulls=True).over(upto), F.lit(0).cast("long")) if k else F.lit(0).cast("long")))
    first = lambda k: F.when((F.col("__at") == k) & (F.col(f"__seen{k}") - F.col(f"__back{k}") == 1), start(k))
    rows = rows.withColumns(each("first", lambda k: F.last(first(k), ignorenulls=True).over(upto)))
    moved = lambda k: F.col(f"__seen{k}") - F.col(f"__back{k}")
    counters = F.array(*(F.when(moved(k) > 0, F.col(f"__first{k}") + moved(k) - 1).otherwise(start(k)) for k in levels))
    return rows.withColumn(out, counters).select(*df.columns, out)


def decimal_label(counters: Column, level: Column) -> Column:
    """Numbers of the levels down to a row's own, parted by dots."""
    return F.array_join(F.slice(counters, F.lit(1), level.cast("int") + 1).cast("array<string>"), ".")


def pattern_label(counters: Column, pattern: Column) -> Column:
    """A pattern with ``%1`` to ``%9`` replaced by the numbers of the levels."""
    return reduce(lambda text, k: F.replace(text, F.lit(f"%{k + 1}"), F.get(counters, F.lit(k)).cast("string")), range(LEVELS), pattern)
