"""Document fingerprints: the k smallest hashes of a text's distinct five-word shingles.

Words are runs of anything but white space; a text with fewer words is one shingle, one without
words has none. A hash is the first 40 bits of the MD5 of the shingle, its words joined by single
spaces, as 10 hex digits, so that texts sort like numbers and any engine computes the same. Sketches of parts merge
into the sketch of the whole. All of it is built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabeval.llm.common import written

K = 64
SHINGLE = 5
DIGITS = 10
SPAN = float(16**DIGITS)
MERGE = 64


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """A hash per place; places repeat."""

    def over(found: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(1), F.size(found) - (width - 1)),
            lambda i: F.substring(F.md5(F.concat_ws(" ", *[F.get(found, i + (k - 1)) for k in range(width)])), 1, DIGITS),
        )
        few = F.when(F.size(found) > 0, F.array(F.substring(F.md5(F.array_join(found, " ")), 1, DIGITS)))
        return F.when(F.size(found) >= width, many).otherwise(F.coalesce(few, F.array().cast("array<string>")))

    # One evaluation of the words, bound by the lambda.
    return F.transform(F.array(words(text)), over)[0]


def bottom_k(hashes: Column, k: int = K) -> Column:
    """The k smallest distinct hashes, ascending. Also merges: of an array of all parts' hashes."""
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, width: int = SHINGLE) -> Column:
    return bottom_k(shingle_hashes(text, width), k)


def merge(one: Column, other: Column, k: int = K) -> Column:
    return bottom_k(F.concat(one, other), k)


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = F.conv(F.element_at(s, -1), 16, 10).cast("double")
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) * SPAN / (top + 1))


def _shared(one: Column, other: Column, k: int) -> tuple[Column, Column]:
    """Of the k smallest hashes of the union: how many, and how many lie in both."""
    both = F.array(F.struct(merge(one, other, k).alias("u"), F.array_intersect(one, other).alias("i")))
    counted = F.transform(both, lambda b: F.struct(F.size(b["u"]).alias("n"), F.size(F.array_intersect(b["u"], b["i"])).alias("c")))[0]
    return counted["n"], counted["c"]


def resemblance(one: Column, other: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1; exact for sets of fewer than k shingles together. Two empty
    sketches are alike: 1."""
    n, c = _shared(one, other, k)
    return F.when(n == 0, F.lit(1.0)).otherwise(c / n)


def containment(one: Column, other: Column, k: int = K) -> Column:
    """Estimated share of the first set that lies in the second; an empty set lies in every set."""
    union = distinct_count(merge(one, other, k), k)
    share = resemblance(one, other, k) * union / distinct_count(one, k)
    return F.when(F.size(one) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def merged(df: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per key from any number of parts; a tree of merges, ``MERGE`` parts in each.

    The parts of a hot key are spread over tasks first; a key's sketch never passes k hashes.
    Missing keys form a group of their own.
    """
    parts = written(df.select(*keys, F.col(column).alias("_part")), "parts")
    most = parts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        groups = -(-most // MERGE)
        spread = (F.rand(seed=most) * groups).cast("long") if groups > 1 else F.lit(0).cast("long")
        parts = parts.withColumn("_to", spread).groupBy(*keys, "_to")
        parts = written(parts.agg(bottom_k(F.flatten(F.collect_list("_part")), k).alias("_part")).drop("_to"), "parts")
        most = groups
    return parts.withColumnRenamed("_part", column)


def with_next(df: DataFrame, order: list[str], columns: list[str], derived: dict[str, Callable] = {}) -> DataFrame:
    """Adds ``next``, a struct of ``columns`` of the row that follows in the order; after the last the first.

    ``derived`` adds columns made from the given ones, to the rows and to ``next``; each is computed
    once per row. Rows are windowed range by range. What follows the last row of a range is the first row of the
    next range that has any, looked up in a table of one row per range.
    """
    from tabeval.operators.ordered import find_ranges, key_names

    cut = find_ranges(df.select(*order), order).number(df)
    names = key_names(cut)
    extend = {n: f(*[F.col(c) for c in columns]) for n, f in derived.items()}
    item = F.struct(*columns, *derived)
    inside = Window.partitionBy("_range").orderBy(*names, *columns)
    rows = cut.withColumns(extend).withColumn("_next", F.lead(item).over(inside))
    firsts = cut.groupBy("_range").agg(F.min(F.struct(*names, *columns)).alias("_f"))
    firsts = firsts.select(F.col("_range").alias("_at"), *[F.col("_f")[c].alias(c) for c in columns]).withColumns(extend)
    firsts = written(firsts.select("_at", item.alias("_item")), "firsts")
    numbers = written(firsts.select("_at"), "ranges")
    whole = Window.orderBy("_at")  # one small number per range
    numbers = numbers.select(
        "_at", F.coalesce(F.lead("_at").over(whole), F.first("_at").over(whole)).alias("_following")
    )
    after = numbers.join(firsts.withColumnRenamed("_at", "_following"), "_following").select(
        F.col("_at").alias("_range"), F.col("_item").alias("_after")
    )
    ends = rows.filter("_next is null").join(after, "_range").withColumn("_next", F.col("_after")).drop("_after")
    return rows.filter("_next is not null").unionByName(ends).withColumnRenamed("_next", "next").drop("_range", *names)
