"""Ordered computations (running totals, ranks) without putting a whole group on one task.

``Window.orderBy`` alone pulls everything to one task and ``partitionBy(key)`` pulls a hot key to
one task. Here rows are cut into ranges of the sort key, each (key, range) is handled by itself,
and the ranges before it enter as an offset taken from one small row per (key, range).

The range edges come from a bounded sample, as Spark's own range partitioner does it. They decide
only how work is spread; every row is used and results do not depend on them.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabeval.session import settled

SAMPLE_PER_RANGE = 20
SMALLEST_SAMPLE = 10_000
RANGES_PER_PARTITION = 8  # more ranges than tasks: even shares, short windows
MOST_RANGES = 20_000  # by default, since the edges are one literal; ``most`` or ``ranges`` go beyond

ORDERED_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType)

_FUNCTIONS = {"sum": F.sum, "max": F.max, "min": F.min}


def _flagged(df: DataFrame, name: str) -> bool:
    """Whether a column can be missing and so gets a flag in front of its sort key."""
    field = df.schema[name]
    return field.nullable or isinstance(field.dataType, (T.DoubleType, T.FloatType))


def sort_keys(df: DataFrame, order: list[str]) -> list[Column]:
    """Columns whose ascending order is the wanted one, missing values last.

    ``order`` holds ``"name"`` or ``"name desc"``; descending needs a numeric column.
    """
    keys = []
    for item in order:
        name, _, direction = item.partition(" ")
        field = df.schema[name]
        value = F.col(name)
        if not isinstance(field.dataType, ORDERED_TYPES):
            raise ValueError(f"cannot order by {name}: neither a number nor text")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
        if direction == "desc":
            if not isinstance(field.dataType, T.NumericType):
                raise ValueError(f"descending order needs a number: {name}")
            value = -value
        if _flagged(df, name):
            keys.append(F.isnull(value).cast("int"))
            filler = F.lit("") if isinstance(field.dataType, T.StringType) else F.lit(0).cast(field.dataType)
            value = F.coalesce(value, filler)
        keys.append(value)
    return [k.alias(f"_k{i}") for i, k in enumerate(keys)]


def key_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_k")]


def _struct_number(names: list[str], schema: T.StructType, edges: list[tuple]) -> Column:
    """How many edges lie below the row's key, by binary search over one literal array."""
    n = len(edges)
    text = json.dumps([dict(zip(names, e)) for e in edges])
    literal = F.from_json(F.lit(text), T.ArrayType(schema))
    steps = [1 << i for i in reversed(range(n.bit_length()))]
    row = F.struct(*names)

    def step(at, width):
        hit = (at + width <= n) & (F.get(literal, at + width - 1) < row)
        return F.when(hit, at + width).otherwise(at)

    return F.aggregate(F.lit(steps), F.lit(0), step)


@dataclass(frozen=True)
class Ranges:
    """Edges that cut an order into ranges, and what their sample told about the rows."""

    order: list[str]
    edges: list[tuple]
    rows: int
    sampled: int
    repeated: int

    def mostly_distinct(self) -> bool:
        """Whether equal keys are so rare that collapsing them first would not pay.

        From the repeats among the sampled rows: k draws from c equally likely keys repeat about
        k*k/2c times, and collapsing pays from two rows per key on.
        """
        return self.repeated == 0 or self.rows < self.sampled**2 / self.repeated

    def number(self, df: DataFrame) -> DataFrame:
        """Add the sort keys ``_k*`` and the range number ``_range``, which rises with the order."""
        keyed = df.select("*", *sort_keys(df, self.order))
        if not self.edges:
            return keyed.withColumn("_range", F.lit(0))
        names = key_names(keyed)
        lead = self._leading(keyed, names)
        if lead is not None:
            flag, value = lead
            at = names.index(value)
            splits = [float("-inf"), *[float(e[at]) for e in self.edges], float("inf")]
            ranged = Bucketizer(splits=splits, inputCol="_lead", outputCol="_cell", handleInvalid="keep").transform(
                keyed.withColumn("_lead", F.col(value).cast("double"))
            )
            cell = F.col("_cell").cast("int")
            if flag:
                cell = F.when(F.col(flag) == 1, len(self.edges) + 1).otherwise(cell)
            # Never missing, and said so: else joins on the range would filter on it a second time.
            return ranged.withColumn("_range", F.coalesce(cell, F.lit(0))).drop("_lead", "_cell")
        schema = T.StructType([T.StructField(n, keyed.schema[n].dataType) for n in names])
        return keyed.withColumn("_range", F.coalesce(_struct_number(names, schema, self.edges), F.lit(0)))

    def _leading(self, keyed: DataFrame, names: list[str]) -> tuple[str | None, str] | None:
        """The first ordering column, if it is a number and tells all edges apart by itself.

        Then a compiled search over it is enough. Heavy equal values or many missing ones make
        edges that agree in it, and the following columns must cut them.
        """
        first = self.order[0].partition(" ")[0]
        if not isinstance(keyed.schema[first].dataType, T.NumericType):
            return None
        flag = "_k0" if _flagged(keyed, first) else None
        value = "_k1" if flag else "_k0"
        at = names.index(value)
        picks = [float(e[at]) for e in self.edges]
        if len(set(picks)) < len(picks) or any(math.isinf(p) for p in picks):
            return None
        if flag and any(e[0] for e in self.edges):
            return None
        return flag, value


def find_ranges(
    df: DataFrame, order: list[str], ranges: int | None = None, keys: list[str] = (), most: int = MOST_RANGES
) -> Ranges:
    """Edges at even steps of a sample whose size depends on the number of ranges, not of rows.

    Repeats in the sample are counted over ``keys`` and the order together.
    """
    spark = df.sparkSession
    if ranges is None:
        ranges = min(RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), most)
    found = df.select(*keys, *sort_keys(df, order))
    wanted = max(ranges * SAMPLE_PER_RANGE, SMALLEST_SAMPLE)
    n = found.count()
    sample = [tuple(r) for r in (found.sample(wanted / n, seed=7) if n > 2 * wanted else found).collect()]
    rows = sorted(r[len(keys):] for r in sample)
    picks = {rows[len(rows) * i // ranges] for i in range(1, ranges)} if rows else set()
    return Ranges(order, sorted(picks), n, len(sample), len(sample) - len(set(sample)))


def with_ranges(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """The rows with their sort keys and range numbers."""
    return find_ranges(df, order, ranges).number(df)


def whole_key(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Keys that a join on equality keeps: as they are, or as one struct ``_whole`` if any can be missing.

    A struct is never missing itself and its missing fields equal one another, in grouping, windows
    and joins alike, so one exchange serves them all.
    """
    if not any(df.schema[k].nullable for k in keys):
        return df, list(keys)
    return df.withColumn("_whole", F.struct(*[F.col(f"`{k}`") for k in keys])), ["_whole"]


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, tuple[str, Column | str]],
    before: bool = False,
    totals: bool = False,
    ranges: int | None = None,
    settle: bool = False,
) -> DataFrame:
    """Running sum, max or min per key in the given order.

    ``values`` maps a new column to ``(function, input)``. With ``before`` the row itself is left
    out. With ``totals`` each sum also gets ``<name>_total`` over its whole key. ``order`` should
    end in a column that makes it total.

    ``df`` is read for the edges, the range totals and the rows. That is cheap where it is a scan;
    with ``settle`` a table with much work behind it is computed once and kept.
    """
    df = settled(df) if settle else df
    kept = df.columns
    df, keys = whole_key(df, keys)
    cut = with_ranges(df, order, ranges)
    names = key_names(cut)
    inputs = {n: F.col(v) if isinstance(v, str) else v for n, (_, v) in values.items()}
    fn = {n: _FUNCTIONS[f] for n, (f, _) in values.items()}

    small = cut.groupBy(*keys, "_range").agg(*[fn[n](inputs[n]).alias(f"_t_{n}") for n in values])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = small.select(
        *keys,
        "_range",
        *[fn[n](f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in values],
        *([fn[n](f"_t_{n}").over(whole).alias(f"{n}_total") for n in values] if totals else []),
    )

    inside = (
        Window.partitionBy(*keys, "_range")
        .orderBy(*names)
        .rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    )
    local = cut.select("*", *[fn[n](inputs[n]).over(inside).alias(f"_l_{n}") for n in values])
    # Without keys there is one offset per range, and the number of ranges is bounded.
    joined = local.join(offsets if keys else F.broadcast(offsets), [*keys, "_range"])

    def merge(n):
        o, l = F.col(f"_o_{n}"), F.col(f"_l_{n}")
        if values[n][0] == "sum":
            return F.coalesce(o + l, l, o, F.lit(0))
        return F.greatest(o, l) if values[n][0] == "max" else F.least(o, l)

    extra = [f"{n}_total" for n in values] if totals else []
    return joined.select(*[F.col(f"`{c}`") for c in kept], *[merge(n).alias(n) for n in values], *extra)


def number_rows(
    df: DataFrame, keys: list[str], order: list[str], name: str = "rank", start: int = 1, ranges: int | None = None,
    settle: bool = False,
) -> DataFrame:
    """Consecutive numbers per key in the given order, like ``row_number`` but spread over tasks."""
    counted = running(df, keys, order, {name: ("sum", F.lit(1))}, ranges=ranges, settle=settle)
    return counted.withColumn(name, (F.col(name) + (start - 1)).cast("bigint"))
