"""Scalar building blocks, all plain Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c) -> Column:
    """The value where it is finite, NULL for NaN, infinities and NULL (NaN sorts above infinity)."""
    c = col(c)
    return F.when(F.abs(c) < F.lit(INF), c)


def hash32(c) -> Column:
    """Portable hash in [0, 2^32): the first 8 hex digits of the md5 of the printed value."""
    return F.conv(F.substring(F.md5(col(c).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")


def unit_hash(c) -> Column:
    return hash32(c) / F.lit(4294967296.0)


def decide(score, threshold: float = 0.5) -> Column:
    """Label 1 only strictly above the threshold. A missing score (NULL or NaN) is not above it: label 0.

    Spark sorts NaN above all numbers, so it is taken out before the comparison.
    """
    score = col(score)
    return F.coalesce(F.when(~F.isnan(score), score > F.lit(threshold)), F.lit(False)).cast("int")


def ratio(num, den) -> Column:
    """num/den, 0 for a zero denominator."""
    return F.coalesce(F.try_divide(col(num).cast("double"), col(den).cast("double")), F.lit(0.0))


def standardise(c, mean, std) -> Column:
    """Centre and divide by the spread; a constant column is only centred."""
    std = col(std)
    return (col(c) - col(mean)) / F.when(std == 0, F.lit(1.0)).otherwise(std)


def log_loss(y, p) -> Column:
    """Cross-entropy of one row, each logarithm held at -100 or above."""
    y, p = col(y), col(p)

    def clamped(x):
        return F.when(x > 0, F.greatest(F.log(x), F.lit(-100.0))).otherwise(F.lit(-100.0))

    return -(y * clamped(p) + (1 - y) * clamped(1 - p))


def list_text(a) -> Column:
    """[64, 32] the way a list is printed."""
    return F.concat(F.lit("["), F.array_join(col(a).cast("array<string>"), ", "), F.lit("]"))


def mlp_parameters(layers, inputs) -> Column:
    """Parameters of a network: weights, biases and two normalisation values per hidden unit, one output."""
    start = F.struct(col(inputs).cast("bigint").alias("prev"), F.lit(0).cast("bigint").alias("total"))
    return F.aggregate(
        col(layers),
        start,
        lambda acc, n: F.struct(
            n.cast("bigint").alias("prev"),
            (acc["total"] + (acc["prev"] + 1) * n + 2 * n).cast("bigint").alias("total"),
        ),
        lambda acc: acc["total"] + acc["prev"] + 1,
    )


def round_even(c, places: int = 4) -> Column:
    return F.bround(col(c), places)


def fixed_text(c, places: int) -> Column:
    """A number with fixed decimals; a value exactly half way goes to the even digit.

    The formatter alone would take it up. Only short binary fractions can lie exactly half way.
    """
    c = col(c)
    short = c * 1048576 == F.floor(c * 1048576)
    return F.when(c.isNotNull(), F.format_string(f"%.{places}f", F.when(short, F.bround(c, places)).otherwise(c)))


def float_text(c) -> Column:
    """A double the way a script prints it: 0.0, 0.5, 1e-05, 1e+16; decimals from 1e-4 up to below 1e16.

    The digits are those of the Java runtime, which before version 19 now and then has one too many.
    """
    text = col(c).cast("double").cast("string")
    parts = F.split(text, "E")
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    power = F.try_element_at(parts, F.lit(2)).cast("int")
    mantissa = F.regexp_replace(F.get(parts, F.lit(0)), r"^-|\.0$", "")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    whole = F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0"))
    rest = F.substring(digits, power + 2, F.length(digits))
    large = F.concat(whole, F.lit("."), F.when(rest == "", F.lit("0")).otherwise(rest))
    written = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    plain = F.when(power.between(-4, -1), small).when(power.between(0, 15), large).otherwise(written)
    return F.when(power.isNull(), text).otherwise(F.concat(sign, plain))


def file_stem(name) -> Column:
    """Checkpoint name of a model: lower case, blanks to underscores."""
    return F.replace(F.lower(col(name)), F.lit(" "), F.lit("_"))


def json_array(values, ddl: str) -> Column:
    """A long constant array as one folded literal instead of one expression per element."""
    import json

    return F.from_json(F.lit(json.dumps(values)), f"array<{ddl}>")
