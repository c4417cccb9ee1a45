"""Exact duplicates: two passes of a Bloom filter find the rows that may repeat; only those shuffle.

First pass: every partition counts the hashes of its texts in cells that stop at two; the parts are
merged segment by segment. Second pass: a row with a cell that was hit once only has no equal and
passes straight through. The others, the true repeats and a few chance hits, are grouped by the
full SHA-256 of the text.

Missing texts count as empty; all texts that are empty after the deletion of white space are equal.
Missing ids sort after all others. An empty table gives an empty result. Whole rows travel inside a
struct, so columns of any name are safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabeval.llm import bloom
from tabeval.llm.common import SPACE_CHARACTERS, met, text_of, written


def text_key(text: str = "text") -> Column:
    """SHA-256 of the text without white space, as lower-case hex."""
    return F.sha2(F.translate(text_of(text), SPACE_CHARACTERS, ""), 256)


def _rank(length: Column, ident: Column) -> Column:
    """Smallest for the row that stays: most code points, then smallest id, missing ids last."""
    return F.struct((-length).alias("l"), F.isnull(ident).alias("m"), ident.alias("i"))


def duplicate_groups(df: DataFrame, ident: str = "doc_id", text: str = "text", most_bits: int = bloom.MOST_BITS) -> DataFrame:
    """One row per row: id, id of the row that stays, size of the group, whether it stays, hash.

    Rows of a repeated id are told apart by their length; those that share length and id too are told
    apart by nothing, in this digest all of them stay. ``deduplicate`` keeps exactly one row of each group.
    """
    rows = written(
        df.select(
            F.col(ident).alias("doc_id"), F.length(text_of(text)).alias("length"), text_key(text).alias("text_sha256")
        ),
        "keys",
    )
    probed = bloom.with_maybe(rows, "text_sha256", bloom.repeat_filter(rows, "text_sha256", most_bits), "maybe")
    repeats = written(probed.filter("maybe").drop("maybe"), "repeats")
    groups = written(
        repeats.groupBy("text_sha256").agg(
            F.min(_rank(F.col("length"), F.col("doc_id"))).alias("best"), F.count("*").alias("group_size")
        ),
        "groups",
    )
    grouped = met(repeats, groups.withColumn("n_rows", F.col("group_size")), "text_sha256", "n_rows").select(
        "doc_id", F.col("best.i").alias("keep_id"), "group_size",
        _rank(F.col("length"), F.col("doc_id")).eqNullSafe(F.col("best")).alias("kept"), "text_sha256",
    )
    single = probed.filter("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    return single.unionByName(grouped)


def deduplicate(df: DataFrame, ident: str = "doc_id", text: str = "text", most_bits: int = bloom.MOST_BITS) -> DataFrame:
    """The rows that stay, with all their columns. Of rows that agree in everything one stays."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), text_key(text).alias("key"))
    bitmap = bloom.repeat_filter(written(rows.select("key"), "keys"), "key", most_bits)
    probed = bloom.with_maybe(rows, "key", bitmap, "maybe")
    rank = _rank(F.length(F.coalesce(F.col(f"row.`{text}`"), F.lit(""))), F.col(f"row.`{ident}`"))
    best = probed.filter("maybe").groupBy("key").agg(F.min_by("row", rank).alias("row")).select("row.*")
    return probed.filter("not maybe").select("row.*").unionByName(best)
