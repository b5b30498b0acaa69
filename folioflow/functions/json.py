"""Lenient accessors of JSON members: every kind of value is taken for what is asked, with a default for the rest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _member(value: Column, key: str) -> Column:
    """A member of a variant object; null where there is none."""
    return F.try_variant_get(value, f"$.{key}", "variant")


def _kind(member: Column) -> Column:
    return F.schema_of_variant(member)


def text(value: Column, key: str) -> Column:
    """A member as text: whole numbers without a point, other numbers and truth values as they are written; null without one."""
    member = _member(value, key)
    number = F.try_variant_get(member, "$", "double")
    whole = (number == F.rint(number)) & (F.abs(number) < 1e15)
    numeric = _kind(member).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)")
    return F.when(numeric & whole, number.cast("long").cast("string")).otherwise(F.try_variant_get(member, "$", "string"))


def number(value: Column, key: str, default: float = 0.0) -> Column:
    """A member as a number: truth values are 1 and 0, texts are read; the default for what is no number."""
    member = _member(value, key)
    kind = _kind(member)
    said = F.when(kind == "BOOLEAN", F.try_variant_get(member, "$", "boolean").cast("double")).when(kind == "STRING", F.trim(F.try_variant_get(member, "$", "string")).try_cast("double"))
    return F.coalesce(said, F.when(~kind.isin("BOOLEAN", "STRING"), F.try_variant_get(member, "$", "double")), F.lit(float(default)))


def integer(value: Column, key: str, default: int = 0) -> Column:
    """The number, rounded half up."""
    return F.floor(number(value, key, default) + 0.5).cast("int")


def flag(value: Column, key: str) -> Column:
    """A member as a truth value: numbers but zero and texts but '', '0' and 'false' are true; false without one."""
    member = _member(value, key)
    kind, said = _kind(member), F.try_variant_get(member, "$", "string")
    on = F.when(kind == "BOOLEAN", F.try_variant_get(member, "$", "boolean")).when(kind == "STRING", ~said.isin("", "0", "false")).otherwise(F.try_variant_get(member, "$", "double") != 0)
    return F.coalesce(on, F.lit(False))
