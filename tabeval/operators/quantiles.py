"""Exact quantiles per group with linear interpolation.

``percentile`` keeps every distinct value of a group in one task. Here a sketch gives each wanted
rank a narrow bracket; one more scan counts the values outside the brackets and keeps the distinct
values inside, which is all that is shuffled. If a sketch was off and a rank falls outside its
bracket, a further scan looks there: the sketch decides the cost, never the answer.

The two or three small tables on the way (a few numbers per group, the values inside the brackets)
are checkpointed, so that no scan is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabeval.operators.joins import lookup
from tabeval.operators.ordered import running
from tabeval.operators.sketches import quantile_at, rank_error
from tabeval.session import settled

ACCURACY = 2000


def _slot(value: Column, cuts: list[Column]) -> Column:
    """Place among the cuts, rising with the value: even between two cuts, odd exactly on one."""
    below, upto = F.lit(0), F.lit(0)
    for c in cuts:
        below = below + F.coalesce((c < value).cast("int"), F.lit(0))
        upto = upto + F.coalesce((c <= value).cast("int"), F.lit(0))
    return below + upto


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: list[float], accuracy: int = ACCURACY,
    margin: float | None = None, sketches: DataFrame | None = None,
) -> DataFrame:
    """Rows ``(keys, p, n, quantile)``; missing values are skipped, a group without values has no row.

    ``accuracy`` is that of the sketch, ``margin`` the half width of a bracket as a share of the group.
    Merged sketches per ``keys`` from ``sketches.py`` (column ``sketch``, kept from earlier scans) save the scan
    for the brackets; ``margin`` is then their rank error. Sketches that are out of date or missing cost time, not
    the answer.
    """
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if margin is None:
        margin = 2.0 / accuracy if sketches is None else 2.0 * rank_error()
    probabilities = [float(p) for p in probabilities]
    places = [min(max(p + s * margin, 0.0), 1.0) for p in probabilities for s in (-1, 1)]
    if sketches is None:
        sketch = data.groupBy(*keys).agg(F.percentile_approx("_v", places, accuracy).alias("_cuts"))
    else:
        sketch = sketches.select(*keys, F.array(*[quantile_at("sketch", p) for p in places]).alias("_cuts"))
    cut = lookup(data, sketch, keys, how="inner" if sketches is None else "left") if keys else data.withColumn("_cuts", settled(sketch).scalar())
    edges = [F.get("_cuts", F.lit(i)) for i in range(len(places))]
    inside = F.lit(False)
    for low, high in zip(edges[::2], edges[1::2]):
        inside = inside | F.coalesce(F.col("_v").between(low, high), F.lit(False))
    slotted = cut.select(*keys, "_v", _slot(F.col("_v"), edges).alias("_slot"), inside.alias("_inside"))
    # Values outside the brackets are only counted; missing here stands for all of them in the slot.
    kept = F.when(F.col("_inside"), F.col("_v"))
    counts = settled(slotted.groupBy(*keys, "_slot", kept.alias("_value")).agg(F.count("*").alias("_m")))

    placed = running(counts, keys, ["_slot", "_value"], {"_end": ("sum", "_m")}, totals=True)
    position = (F.col("_end_total") - 1) * F.col("p")
    wanted = settled(
        placed.withColumn("p", F.explode(F.lit(probabilities)))
        .withColumn("_side", F.explode(F.lit([0, 1])))
        .withColumn("_rank", F.when(F.col("_side") == 0, F.floor(position)).otherwise(F.ceil(position)))
        .filter((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_m")))
        .select(
            *keys, "_slot", "_value", "p", "_side", F.col("_end_total").alias("n"),
            (F.col("_rank") - (F.col("_end") - F.col("_m"))).alias("_at"),
        )
    )
    found = wanted.filter(F.col("_value").isNotNull())
    missed = wanted.filter(F.col("_value").isNull())
    if not missed.isEmpty():
        found = found.unionByName(_look_again(slotted, keys, missed).select(*found.columns))

    low = F.max(F.when(F.col("_side") == 0, F.col("_value")))
    high = F.max(F.when(F.col("_side") == 1, F.col("_value")))
    at = (F.col("n") - 1) * F.col("p")
    return found.groupBy(*keys, "p").agg(
        F.max("n").alias("n"), (low + (high - low) * F.max(at - F.floor(at))).alias("quantile")
    )


def _look_again(slotted: DataFrame, keys: list[str], missed: DataFrame) -> DataFrame:
    """Order the values of the slots that hold a rank outside every bracket."""
    slots = missed.select(*keys, "_slot").distinct()
    values = settled(
        slotted.filter(~F.col("_inside"))
        .join(slots, [*keys, "_slot"], "left_semi")
        .groupBy(*keys, "_slot", "_v")
        .agg(F.count("*").alias("_m"))
    )
    placed = running(values, [*keys, "_slot"], ["_v"], {"_end": ("sum", "_m")})
    hit = (F.col("_at") < F.col("_end")) & (F.col("_at") >= F.col("_end") - F.col("_m"))
    return missed.drop("_value").join(placed, [*keys, "_slot"]).filter(hit).withColumn("_value", F.col("_v"))
