"""Error values beside values.

A checked result is a struct ``(v, e)``: ``e`` holds an error code and then ``v`` is
null.  A blank is a null ``v`` without a code, so errors are never taken for blanks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The error codes of spreadsheets.
NA, REF, VALUE, DIV0, NAME, NUM, NULL = "#N/A", "#REF!", "#VALUE!", "#DIV/0!", "#NAME?", "#NUM!", "#NULL!"
CODES = (NA, REF, VALUE, DIV0, NAME, NUM, NULL)


def checked(value: Column, *faults: tuple[Column, str]) -> Column:
    """``value``, or the code of the first fault that holds."""
    code = F.lit(None).cast("string")
    for condition, name in reversed(faults):
        code = F.when(condition, F.lit(name)).otherwise(code)
    return F.struct(F.when(code.isNull(), value).alias("v"), code.alias("e"))


def value_of(result: Column) -> Column:
    return result["v"]


def error_of(result: Column) -> Column:
    return result["e"]


def if_error(result: Column, other: Column) -> Column:
    """The value, or ``other`` where there is an error."""
    return F.when(result["e"].isNotNull(), other).otherwise(result["v"])


def if_na(result: Column, other: Column) -> Column:
    return F.when(result["e"] == NA, other).otherwise(result["v"])


def shown(result: Column) -> Column:
    """A result as text, its code if it is an error."""
    return F.coalesce(result["e"], result["v"].cast("string"))
