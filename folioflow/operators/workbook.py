"""Operators over cells of many workbooks: shared formulas expanded, links and comments placed, grids, types."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..formula.formats import format_value
from ..formula.references import restructure, shift
from .lookup import covered_by


def expand_shared(cells: DataFrame) -> DataFrame:
    """Children of shared formulas with the master's formula moved to their place."""
    keys = ["path", "sheet"]
    masters = cells.where("f is not null").select(*keys, F.col("r").alias("shared_row"), F.col("c").alias("shared_col"), F.col("f").alias("__master"))
    joined = cells.join(masters, [*keys, "shared_row", "shared_col"], "left")

    def moved(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for master, dr, dc in batches:
            yield pd.Series([None if m is None else shift(m, int(a), int(b)) for m, a, b in zip(master, dr, dc, strict=True)], dtype=object)

    made = F.pandas_udf(moved, StringType())("__master", F.coalesce(F.col("r") - F.col("shared_row"), F.lit(0)), F.coalesce(F.col("c") - F.col("shared_col"), F.lit(0)))
    return joined.withColumn("f", F.coalesce("f", made)).select(*cells.columns)


def restructured(cells: DataFrame, sheet: str, axis: str, at: int, count: int) -> DataFrame:
    """Cells after rows or columns came in or went: places moved, formulas rewritten."""

    def rewritten(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for f, own in batches:
            yield pd.Series([None if x is None else restructure(x, sheet, s, axis, at, count) for x, s in zip(f, own, strict=True)], dtype=object)

    place = "r" if axis == "row" else "c"
    here = F.lower("sheet") == sheet.lower()
    kept = cells if count >= 0 else cells.where(~(here & F.col(place).between(at, at - count - 1)))
    moved = F.when(here & (F.col(place) >= at), F.col(place) + count).otherwise(F.col(place)).cast("int")
    return kept.withColumns({place: moved, "f": F.pandas_udf(rewritten, StringType())("f", "sheet")})


def shown_values(df: DataFrame, value: str, code: str, out: str = "shown", dialect: str = "viewer") -> DataFrame:
    """Numbers as their formats show them."""

    def show(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for v, c in batches:
            yield pd.Series([None if x is None or x != x else format_value(float(x), k or "General", dialect) for x, k in zip(v, c, strict=True)], dtype=object)

    return df.withColumn(out, F.pandas_udf(show, StringType())(F.col(value), F.col(code)))


def used_range(cells: DataFrame) -> DataFrame:
    return cells.groupBy("path", "sheet").agg(F.max("r").alias("rows"), F.max("c").alias("cols"), F.count("*").alias("cells"))


def viewer_caps(cells: DataFrame, rows: int = 10_000, cols: int = 256, most: int = 200_000) -> DataFrame:
    """What a viewer shows of a workbook: a limit that is the feature."""
    inside = cells.where((F.col("r") <= rows) & (F.col("c") <= cols))
    w = Window.partitionBy("path").orderBy("sheet_idx", "r", "c")
    return inside.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def linked(cells: DataFrame, links: DataFrame) -> DataFrame:
    """Cells with the hyperlink whose range holds them."""
    return covered_by(cells, links)


def row_table(cells: DataFrame) -> DataFrame:
    """Ragged rows of texts, gaps between columns filled with empty texts."""
    text = F.coalesce("s", F.col("n").cast("string"), F.col("b").cast("string"), "e", F.lit(""))
    rows = cells.groupBy("path", "sheet", "r").agg(F.map_from_entries(F.collect_list(F.struct("c", text.alias("v")))).alias("m"), F.max("c").alias("last"))
    return rows.select("path", "sheet", "r", F.transform(F.sequence(F.lit(1), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))).alias("fields"))
