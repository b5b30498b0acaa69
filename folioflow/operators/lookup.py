"""Spreadsheet lookups as joins: the first exact match, or the nearest key below or above."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import pinned

#: Keys that a nearest-key lookup searches in place.
CUTS = 64


def _below(value: Column, ends: list) -> Column:
    """How many of the ascending ``ends`` are not above ``value``: a tree of comparisons, its depth the logarithm of their number."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < F.lit(ends[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return F.when(value.isNull(), F.lit(0)).otherwise(tree(0, len(ends)))


def fold(key: Column) -> Column:
    """What equality of texts compares."""
    return F.lower(key)


def first_rows(table: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key, keys compared without case."""
    text = dict(table.dtypes)[key] == "string"
    k = fold(F.col(key)) if text else F.col(key)
    others = [c for c in table.columns if c != order]
    return table.groupBy(k.alias("__key")).agg(F.min_by(F.struct(*others), F.col(order)).alias("__row"), F.min(order).alias("__pos"))


def exact(left: DataFrame, table: DataFrame, look: str, key: str, order: str, take: dict[str, str], default: Column | None = None) -> DataFrame:
    """VLOOKUP, HLOOKUP (of an unpivoted table), MATCH and XLOOKUP with exact keys.

    ``take`` maps new columns to columns of the table; ``__pos`` names the position.  A
    miss is null, or ``default``.
    """
    found = first_rows(table, key, order)
    look_key = fold(F.col(look)) if dict(left.dtypes)[look] == "string" else F.col(look)
    # Whether to broadcast is left to the size that adaptive execution measures.
    joined = left.withColumn("__look", look_key).join(found, F.col("__look") == F.col("__key"), "left")
    out = {}
    for name, source in take.items():
        value = F.col("__pos") if source == "__pos" else F.col("__row")[source]
        out[name] = F.when(F.col("__key").isNull(), default).otherwise(value) if default is not None else value
    return joined.withColumns(out).drop("__look", "__key", "__row", "__pos")


def nearest(left: DataFrame, table: DataFrame, look: str, key: str, take: dict[str, str], above: bool = False) -> DataFrame:
    """The row with the greatest key not above ``look`` (or the least key not below, with ``above``).

    Of equal keys the least row counts.  A few keys are searched in place.  Otherwise the
    distinct look-ups and the keys alone are dealt by ranges; a range takes the last key of those
    before along.  Rows of either side then meet by equal values only.
    """
    sign = -1 if above else 1
    keyed = table.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*table.columns)).alias("__row"))
    keyed = keyed.select((F.col(key) * sign).alias("__k"), "__row")
    rows = left.withColumn("__x", F.col(look) * sign)
    if keyed.limit(CUTS + 1).count() <= CUTS:
        holder = [r["__k"] for r in keyed.select("__k").orderBy("__k").collect()]
        n = _below(F.col("__x"), holder)
        numbered = keyed.withColumn("__i", F.row_number().over(Window.orderBy("__k")))  # at most CUTS rows
        joined = rows.withColumn("__n", n).join(F.broadcast(numbered), F.col("__n") == F.col("__i"), "left")
        return joined.withColumns({n: F.col("__row")[s] for n, s in take.items()}).drop("__x", "__n", "__i", "__k", "__row")
    kind = keyed.schema["__k"].dataType
    asked = rows.where("__x is not null").select(F.col("__x").alias("__o")).distinct().withColumn("__key", F.lit(None).cast(kind))
    both = asked.withColumn("__side", F.lit(1)).unionByName(keyed.select(F.col("__k").alias("__o"), F.col("__k").alias("__key"), F.lit(0).alias("__side")))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pinned(both.repartitionByRange(parts, "__o").withColumn("__part", F.spark_partition_id()))
    upto = Window.partitionBy("__part").orderBy("__o", "__side").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy("__part").agg(F.max("__key").alias("__end"))  # one row a range
    carried = ends.select("__part", F.max("__end").over(before).alias("__far"))
    near = both.withColumn("__near", F.last("__key", ignorenulls=True).over(upto)).where("__side = 1").join(F.broadcast(carried), "__part")
    near = near.select(F.col("__o").alias("__asked"), F.coalesce("__near", "__far").alias("__found"))
    joined = rows.join(near, F.col("__x") == F.col("__asked"), "left").join(keyed, F.col("__found") == F.col("__k"), "left")
    return joined.withColumns({n: F.col("__row")[s] for n, s in take.items()}).drop("__x", "__asked", "__found", "__k", "__row")


def index(table: DataFrame, order: str, row: int, column: str) -> DataFrame:
    """INDEX: the value of a column at a position, no row if out of bounds."""
    return table.where(F.col(order) == row).select(F.col(column).alias("value"))


def transposed(table: DataFrame, name: str, value: str) -> DataFrame:
    """A one-row table as rows of name and value, for HLOOKUP."""
    cells = F.array(*(F.struct(F.lit(i + 1).alias("pos"), F.lit(c).alias(name), F.col(c).cast("string").alias(value)) for i, c in enumerate(table.columns)))
    return table.select(F.inline(cells))


def covered_by(cells: DataFrame, ranges: DataFrame, row: str = "r", col: str = "c", block: int = 64) -> DataFrame:
    """Range join: each cell with each range ``r1, r2, c1, c2`` that holds it.

    Ranges are dealt to blocks of rows, so the join is on equal keys and never a product.
    """
    low, high = F.floor(F.col("r1") / block), F.floor(F.col("r2") / block)
    dealt = ranges.withColumn("__block", F.explode(F.sequence(low, high)))
    inside = F.col(row).between(F.col("r1"), F.col("r2")) & F.col(col).between(F.col("c1"), F.col("c2"))
    return cells.withColumn("__block", F.floor(F.col(row) / block)).join(dealt, "__block").where(inside).drop("__block")


def without_covered(cells: DataFrame, merges: DataFrame, row: str = "r", col: str = "c") -> DataFrame:
    """Cells that stay when ranges are merged: the anchors, and whatever no range holds."""
    hidden = covered_by(cells, merges, row, col).where(~((F.col(row) == F.col("r1")) & (F.col(col) == F.col("c1")))).select(row, col).distinct()
    return cells.join(hidden, [row, col], "left_anti")


def closure(parents: DataFrame, child: str, parent: str) -> DataFrame:
    """Every ancestor of a node with its distance, a cycle walked once: ``node, ancestor, depth``.  Goes on until no chain grows.

    Each level is made once, from the one before, and parents are never sent through the driver to all tasks: they are as many as nodes.
    """
    step = parents.select(F.col(child).alias("p_child"), F.col(parent).alias("p_parent")).where(F.col(parent).isNotNull())
    level = parents.select(F.col(child).alias("node"), F.col(child).alias("ancestor"), F.lit(0).alias("depth"), F.array(F.col(child)).alias("path"))
    step = pinned(step)
    out, d = [level], 0
    while True:
        d += 1
        level = level.join(step.hint("merge"), level.ancestor == step.p_child).where(~F.array_contains("path", F.col("p_parent")))
        level = pinned(level.select("node", F.col("p_parent").alias("ancestor"), F.lit(d).alias("depth"), F.concat("path", F.array("p_parent")).alias("path")))
        if level.isEmpty():
            break
        out.append(level)
    return reduce(DataFrame.unionByName, (x.select("node", "ancestor", "depth") for x in out))
