"""The criteria language of SUMIF, COUNTIF and the like, compiled to predicates.

A criterion is a number, a boolean, or text with an optional operator.  A number
meets numbers and booleans.  Text compares without case; ``*`` and ``?`` are
wildcards for equality, ``~`` escapes them.  A number after an operator compares
numerically, and text that looks like a number is read as one except for ``<>``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

_SPLIT = re.compile(r"(<=|>=|<>|<|>|=)?(.*)", re.S)
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?%?")
_NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number_in(text: str) -> float | None:
    """The number that a criterion's right side is, if it is one."""
    bare = text.strip()
    if not _NUMBER.fullmatch(bare):
        return None
    return float(bare[:-1]) / 100 if bare.endswith("%") else float(bare)


def wildcard_pattern(text: str) -> str | None:
    """A regular expression for text with wildcards, None if it has none."""
    out, i, wild = [], 0, False
    while i < len(text):
        c = text[i]
        if c == "~" and i + 1 < len(text) and text[i + 1] in "*?~":
            i += 1
            out.append(re.escape(text[i]))
            wild = True
        elif c in "*?":
            out.append(".*" if c == "*" else ".")
            wild = True
        else:
            out.append("\\" + c if c in "\\.^$|()[]{}+" else c)
        i += 1
    return "".join(out) if wild else None


def _compare(op: str, a: Column, b: Column) -> Column:
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "=": a == b, "<>": a != b}[op]


def criterion(column: Column, kind, rule: str | float | bool) -> Column:
    """Whether cells of a column of type ``kind`` meet ``rule``; never null."""
    numeric, boolean, text = isinstance(kind, NumericType), isinstance(kind, BooleanType), isinstance(kind, StringType)
    if isinstance(rule, bool):
        rule = float(rule)
    if isinstance(rule, (int, float)):
        hit = column.cast("double") == float(rule) if numeric or boolean else F.lit(False)
        return F.coalesce(hit, F.lit(False))
    op, right = _SPLIT.fullmatch(rule).groups()
    op = op or "="
    number = number_in(right)
    if number is not None:
        if op == "<>":
            # Whatever is not that number differs from it, blanks and text too.
            same = column.cast("double") == number if numeric or boolean else F.lit(False)
            return ~F.coalesce(same, F.lit(False))
        value = column.cast("double") if numeric or boolean else F.when(column.rlike(_NUMERIC_TEXT), F.trim(column).try_cast("double")) if text else F.lit(None).cast("double")
        return F.coalesce(_compare(op, value, F.lit(number)), F.lit(False))
    shown = F.lower(column.cast("string"))
    if right == "":
        blank = column.isNull() | (column.cast("string") == "")
        return blank if op == "=" else ~blank if op == "<>" else F.lit(False)
    low = right.lower()
    if op in ("=", "<>"):
        pattern = wildcard_pattern(low)
        hit = shown.rlike(f"(?s)^{pattern}$") if pattern is not None else shown == low
        hit = F.coalesce(hit, F.lit(False))
        return hit if op == "=" else ~hit
    return F.coalesce(_compare(op, shown, F.lit(low)), F.lit(False)) if text else F.lit(False)


def column_criterion(df, name: str, rule: str | float | bool) -> Column:
    return criterion(F.col(name), df.schema[name].dataType, rule)
