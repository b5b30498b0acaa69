"""Blocks as HTML, natively."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.textops import html_escape


def block_html(kind: Column, level: Column, text: Column) -> Column:
    """An element for a heading, list item or paragraph."""
    body = F.replace(html_escape(text), F.lit("\n"), F.lit("<br>"))
    n = F.least(F.greatest(F.coalesce(level, F.lit(1)), F.lit(1)), F.lit(6)).cast("string")
    return (
        F.when(kind == "HEADING", F.concat(F.lit("<h"), n, F.lit(">"), body, F.lit("</h"), n, F.lit(">")))
        .when(kind == "LIST_ITEM", F.concat(F.lit("<li>"), body, F.lit("</li>")))
        .otherwise(F.concat(F.lit("<p>"), body, F.lit("</p>")))
    )
