"""Looking up a small table from a large one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabeval.session import settled

BROADCAST_ROWS = 100_000


def lookup(df: DataFrame, table: DataFrame, keys: list[str], limit: int = BROADCAST_ROWS, how: str = "inner") -> DataFrame:
    """Inner (or left) join with a table of statistics per key.

    Spark estimates an aggregate by what it was computed from and would shuffle the large side. So
    the table is settled and counted: it is broadcast up to ``limit`` rows, and beyond that joined
    the ordinary way, where adaptive execution splits skewed keys.
    """
    table = settled(table)
    small = table.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(table) if small else table, keys, how)
