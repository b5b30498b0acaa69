"""How a query and its SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Register:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(sql: str, digits: int = 2) -> str:
    """SQL of half-away-from-zero rounding as ``functions.numeric.round_`` does it."""
    s = f"{10.0**digits}::DOUBLE"
    return f"(sign({sql}) * floor(abs({sql}) * {s} + 1e-12 + 0.5) / {s})"
