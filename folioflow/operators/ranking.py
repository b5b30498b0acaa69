"""Ranks, k-th values and newest-first stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import running_sum


#: Up to so many places a task keeps the first values itself.
FEW = 1000


def kth(df: DataFrame, column: str, k: int, largest: bool = True) -> DataFrame:
    """LARGE or SMALL over a whole table.  One row, null if there are fewer than ``k`` values.

    The first few places are a bounded top-k.  Beyond, equal values are counted, and the counts summed by ranges of values,
    so no task holds the rows before a place.
    """
    values, least = df.where(F.col(column).isNotNull()).select(column), F.min if largest else F.max
    if k <= FEW:
        first = values.orderBy(F.col(column).desc() if largest else F.col(column).asc()).limit(k)
        return first.agg(F.count("*").alias("n"), least(column).alias("v")).select(F.when(F.col("n") == k, F.col("v")).alias("value"))
    reached = running_sum(values.groupBy(column).agg(F.count("*").alias("__n")), column, "__n", "__upto", descending=largest).where(F.col("__upto") >= k)
    return reached.agg((F.max if largest else F.min)(column).alias("value"))


def kth_by(df: DataFrame, groups: list[str], column: str, k: int, largest: bool = True) -> DataFrame:
    """LARGE or SMALL in every group, no row for groups of fewer values: ``groups``, ``value``.  Tasks keep ``k`` rows a group before the shuffle."""
    order = F.col(column).desc() if largest else F.col(column).asc()
    ranked = df.where(F.col(column).isNotNull()).select(*groups, column).withColumn("__k", F.row_number().over(Window.partitionBy(*groups).orderBy(order)))
    return ranked.where(F.col("__k") <= k).where(F.col("__k") == k).select(*groups, F.col(column).alias("value"))


def rank_by_value(df: DataFrame, column: str, ascending: bool = False, out: str = "rank") -> DataFrame:
    """RANK: ties share the best rank.  Counted by distinct value, so equal values meet once, and summed by ranges of values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    ranked = running_sum(counts, column, "__n", "__upto", descending=not ascending)
    ranked = ranked.select(column, (F.col("__upto") - F.col("__n") + 1).cast("long").alias(out))
    return df.join(ranked, column, "left")


def recent(df: DataFrame, key: str, at: str, keep: int = 30) -> DataFrame:
    """The newest entry of every key, the newest first, at most ``keep``."""
    newest = df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), F.col(at)).alias("__r"))
    return newest.select(key, "__r.*").orderBy(F.col(at).desc(), key).limit(keep)


def recents_json(entries: DataFrame) -> DataFrame:
    """The list of recent entries as one JSON text, the newest first; ``recent`` bounds it."""
    fields = [c for c in entries.columns if c != "lastOpened"]
    items = F.sort_array(F.collect_list(F.struct("lastOpened", *fields)), asc=False)
    return entries.agg(F.to_json(items).alias("json"))


def toggled(marks: DataFrame, key: str, page: str) -> DataFrame:
    """Bookmarks after every toggle: those met an odd number of times."""
    return marks.groupBy(key, page).count().where("count % 2 = 1").select(key, page)


def top_words(words: DataFrame, n: int, word: str = "word") -> DataFrame:
    """The most frequent words, ties in order of word."""
    return words.groupBy(word).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), word).limit(n)


def pick_best(df: DataFrame, group: str, score: str, take: str) -> DataFrame:
    """The candidate of highest score in every group."""
    return df.groupBy(group).agg(F.max_by(take, score).alias(take), F.max(score).alias(score))
