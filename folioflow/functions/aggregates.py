"""Spreadsheet aggregates with their own answers for empty ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import DIV0, NA, NUM, checked


def money(x: Column) -> Column:
    """An exact addend, so that a total does not depend on the order of rows."""
    return x.cast("decimal(18,4)")


def total(x: Column) -> Column:
    """SUM: zero for an empty range."""
    return F.coalesce(F.sum(x), F.lit(0))


def average(x: Column) -> Column:
    return checked(F.avg(x), (F.count(x) == 0, DIV0))


def minimum(x: Column) -> Column:
    return F.coalesce(F.min(x), F.lit(0))


def maximum(x: Column) -> Column:
    return F.coalesce(F.max(x), F.lit(0))


def count_a(x: Column) -> Column:
    return F.count(F.when(x.isNotNull() & (x.cast("string") != ""), 1))


def count_blank(x: Column) -> Column:
    return F.count(F.when(x.isNull() | (x.cast("string") == ""), 1))


def median(x: Column) -> Column:
    return checked(F.median(x), (F.count(x) == 0, NUM))


def stdev(x: Column) -> Column:
    return checked(F.stddev_samp(x), (F.count(x) < 2, DIV0))


def large(x: Column, k: int) -> Column:
    """The k-th largest of a group; for a whole large table use ``operators.ranking.kth``."""
    return checked(F.get(F.sort_array(F.collect_list(x), asc=False), k - 1), (F.count(x) < k, NUM))


def small(x: Column, k: int) -> Column:
    return checked(F.get(F.sort_array(F.collect_list(x)), k - 1), (F.count(x) < k, NUM))


def rank_in(x: Column, better: Column, found: Column) -> Column:
    """One more than the values strictly better than ``x``."""
    return checked(better + 1, (~found, NA))


def sum_product(*factors: Column) -> Column:
    product = factors[0]
    for f in factors[1:]:
        product = product * f
    return F.coalesce(F.sum(product), F.lit(0))


def sum_if(condition: Column, x: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, x)), F.lit(0))


def average_if(condition: Column, x: Column) -> Column:
    inside = F.when(condition, x)
    return checked(F.avg(inside), (F.count(inside) == 0, DIV0))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def text_join(x: Column, order: Column, delimiter: str) -> Column:
    """Texts in the order of ``order``, ties by text."""
    pairs = F.sort_array(F.collect_list(F.struct(order.alias("o"), x.alias("x"))))
    return F.array_join(F.transform(pairs, lambda p: p.x), delimiter)
