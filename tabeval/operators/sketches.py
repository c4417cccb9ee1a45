"""Quantile sketches that are kept, merged and asked later.

Where ``quantiles`` gives the exact answer from the rows, a sketch answers from a few kilobytes a group with
a stated error, and the sketches of parts (days, files) make the sketch of the whole: only a new part is
read. Merged sketches can also be the brackets of the exact pass, which then needs no scan for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabeval.functions import present

SIZE = 800  # items a sketch keeps at its top level


def rank_error(size: int = SIZE) -> float:
    """By how much of a group's rows a quantile's rank may be off, with a probability of 0.99."""
    return 2.296 / size**0.9021


def sketched(df: DataFrame, keys: list[str], values: list[str], size: int = SIZE) -> DataFrame:
    """Rows ``(keys, feature, n, sketch)``: one sketch per group and value column, partly aggregated before the
    shuffle. Missing values (NULL, NaN, infinities) are skipped; a group without values has no row."""
    some = [F.struct(F.lit(v).alias("feature"), present(F.col(v).cast("double")).alias("_v")) for v in values]
    long = df.select(*keys, F.inline(F.array(*some))).filter(F.col("_v").isNotNull())
    sketch = F.kll_sketch_agg_double("_v", F.lit(size))
    return long.groupBy(*keys, "feature").agg(F.count("*").alias("n"), sketch.alias("sketch"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of parts put together per ``keys`` and feature; the error is that of one sketch."""
    whole = F.kll_merge_agg_double("sketch")
    return sketches.groupBy(*keys, "feature").agg(F.sum("n").alias("n"), whole.alias("sketch"))


def quantile_at(sketch, p: float | Column) -> Column:
    """The value whose rank is the share ``p`` of the rows."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(p) if isinstance(p, float) else p)


def sketched_quantiles(sketches: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    """Rows ``(keys, feature, p, n, quantile)``, each quantile a value of the data."""
    rows = [F.struct(F.lit(float(p)).alias("p"), quantile_at("sketch", float(p)).alias("quantile")) for p in probabilities]
    return sketches.select(*keys, "feature", "n", F.inline(F.array(*rows))).select(*keys, "feature", "p", "n", "quantile")


def sketched_shares(sketches: DataFrame, keys: list[str], cuts: list[float]) -> DataFrame:
    """Rows ``(keys, feature, cut, n, share)``: the share of the values up to each cut, itself included."""
    rows = [
        F.struct(F.lit(float(c)).alias("cut"), F.kll_sketch_get_rank_double("sketch", F.lit(float(c))).alias("share"))
        for c in cuts
    ]
    return sketches.select(*keys, "feature", "n", F.inline(F.array(*rows))).select(*keys, "feature", "cut", "n", "share")
