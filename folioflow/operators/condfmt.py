"""Conditional-format rules.

Whole-range facts (bounds, averages, thresholds, counts of equal texts) are computed
as small aggregates and joined back, never by a window over an unpartitioned table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import value_at

OPERATORS = ("lessThan", "lessThanOrEqual", "equal", "notEqual", "greaterThanOrEqual", "greaterThan", "between", "notBetween")


def cell_is(v: Column, operator: str, a: float | str, b: float | None = None) -> Column:
    """The comparators; ``between`` takes its bounds in either order, text compares without case."""
    if isinstance(a, str):
        same = F.lower(v) == a.lower()
        return {"equal": same, "notEqual": ~same}[operator]
    if operator in ("between", "notBetween"):
        hit = v.between(min(a, b), max(a, b))
        return hit if operator == "between" else ~hit
    return {
        "lessThan": v < a, "lessThanOrEqual": v <= a, "equal": v == a, "notEqual": v != a, "greaterThanOrEqual": v >= a, "greaterThan": v > a,
    }[operator]


def text_rule(v: Column, kind: str, text: str) -> Column:
    low, t = F.lower(v), text.lower()
    return {"containsText": low.contains(t), "notContainsText": ~low.contains(t), "beginsWith": low.startswith(t), "endsWith": low.endswith(t)}[kind]


def is_blank(v: Column) -> Column:
    return v.isNull() | (F.trim(v.cast("string")) == "")


def is_error(v: Column) -> Column:
    return F.coalesce(v.startswith("#"), F.lit(False))


def duplicates(df: DataFrame, column: str, out: str = "duplicate") -> DataFrame:
    """Whether a value's text occurs more than once."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg((F.count("*") > 1).alias(out))
    return df.join(counts, column, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def top(df: DataFrame, column: str, rank: int, percent: bool = False, bottom: bool = False, out: str = "hit") -> DataFrame:
    """The first ``rank`` values, or per cent of them, ties with the last one included."""
    if percent:  # a share of the table is no bounded top-k
        edge = value_at(df, column, max(1, df.where(F.col(column).isNotNull()).count() * rank // 100), descending=not bottom)
    else:
        order = F.col(column).asc() if bottom else F.col(column).desc()
        edge = df.where(F.col(column).isNotNull()).select(column).orderBy(order).limit(rank).agg((F.max if bottom else F.min)(column)).first()[0]
    if edge is None:
        return df.withColumn(out, F.lit(False))
    return df.withColumn(out, F.coalesce(F.col(column) <= edge if bottom else F.col(column) >= edge, F.lit(False)))


def above_average(df: DataFrame, column: str, above: bool = True, equal: bool = False, out: str = "hit") -> DataFrame:
    mean = df.agg(F.avg(F.col(column).cast("decimal(18,4)")).cast("double")).first()[0]
    v = F.col(column)
    hit = F.lit(False) if mean is None else ((v >= mean if equal else v > mean) if above else (v <= mean if equal else v < mean))
    return df.withColumn(out, F.coalesce(hit, F.lit(False)))


def stop_value(df: DataFrame, column: str, kind: str, value: float | None = None) -> float | None:
    """Where a colour stop or bar end lies: min, max, num, percent, or percentile (nearest rank)."""
    if kind == "num":
        return value
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n:
        return None
    if kind in ("min", "max"):
        return low if kind == "min" else high
    if kind == "percent":
        return low + (high - low) * value / 100
    return value_at(df, column, int((n - 1) * value / 100 + 0.5) + 1)


def fraction(v: Column, low: float, high: float) -> Column:
    """Place between two ends, kept within 0 and 1."""
    if high == low:
        return F.lit(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - F.lit(low)) / F.lit(high - low)))


def mix(place: Column, colours: list[tuple[int, int, int]]) -> Column:
    """The colour at a place between two or three stops, as RRGGBB."""
    spans = len(colours) - 1
    scaled = place * spans
    span = F.least(F.floor(scaled), F.lit(spans - 1)).cast("int")
    inner = scaled - span
    out = []
    for channel in range(3):
        a = F.element_at(F.array(*(F.lit(float(c[channel])) for c in colours)), span + 1)
        b = F.element_at(F.array(*(F.lit(float(c[channel])) for c in colours)), span + 2)
        out.append(F.lpad(F.hex(F.floor(a + (b - a) * inner + 0.5).cast("long")), 2, "0"))
    return F.concat(*out)


def data_bar(df: DataFrame, column: str, out: str = "bar") -> DataFrame:
    """Bar lengths from the smaller of zero and the least value to the greatest."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    return df.withColumn(out, fraction(F.col(column), min(0.0, low), high))


def winner(hits: list[tuple[int, Column, str]]) -> Column:
    """The format of the hit rule with the lowest priority number."""
    chain = None
    for _, condition, style in sorted(hits, key=lambda h: h[0]):
        chain = F.when(condition, style) if chain is None else chain.when(condition, style)
    return chain if chain is not None else F.lit(None).cast("string")
