from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)``; without SQL only its rows can be checked."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def fix(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Floating results to six places by way of a decimal, so that sums added up in another order
    cannot fall on the other side of a half; the SQL side does the same."""
    return df.withColumns(
        {c: F.round(F.col(f"`{c}`").cast("decimal(38,10)"), places).cast("double") for c in columns}
    )


def r(expr: str, name: str | None = None) -> str:
    text = f"round(({expr})::decimal(38,10), 6)::double"
    return f'{text} AS "{name}"' if name else text
