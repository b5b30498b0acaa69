"""Facts about a physical plan, for tests and tuning."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df: DataFrame) -> Counter:
    """How often each operator occurs in the plan."""
    found = (re.match(r"[\s:+-]*(?:\*\(\d+\) )?([A-Z]\w+)", line) for line in plan_text(df).splitlines())
    return Counter(m[1] for m in found if m)


def shuffles(df: DataFrame) -> int:
    return plan_text(df).count("Exchange hashpartitioning") + plan_text(df).count("Exchange SinglePartition") + plan_text(df).count("Exchange rangepartitioning")


def read_columns(df: DataFrame) -> list[str]:
    """Columns that the scans read."""
    return sorted({c.split("#")[0] for s in re.findall(r"FileScan \w+ \[([^\]]*)\]", plan_text(df)) for c in s.split(",") if c})


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", plan_text(df))
