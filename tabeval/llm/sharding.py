"""Shards by jump consistent hashing: no ring table, and growth moves only what the new shard takes.

A key walks along the shard numbers. At shard b it draws a number r in (0, 1] that depends on key
and b alone and jumps to floor((b + 1) / r); the last shard before the end is its place. Adding a
shard changes only walks whose last jump now ends on the new one.

Draws are the first 32 bits of MD5 of ``key:b``. A missing key is the text ``null``. Everything is a
built-in expression. Rows with equal keys go to the same shard and get slots of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabeval.llm.common import text_of, written
from tabeval.operators.ordered import number_rows

#: A walk over n shards makes about ln(n) + 0.6 jumps. One with more than this many, less likely
#: than 1e-40 even for millions of shards, stops where it is; growth still moves rows only into new shards.
MOST_JUMPS = 64


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a key, from 0 to ``shards`` - 1."""
    name = F.coalesce(key.cast("string"), F.lit("null"))

    def step(state: Column, _: Column) -> Column:
        at = state["next"]
        draw = F.conv(F.substring(F.md5(F.concat(name, F.lit(":"), at.cast("string"))), 1, 8), 16, 10).cast("double")
        to = F.floor((at + 1).cast("double") * F.lit(4294967296.0) / (draw + 1)).cast("long")
        return F.when(at < shards, F.struct(at.alias("last"), to.alias("next"))).otherwise(state)

    start = F.struct(F.lit(0).cast("long").alias("last"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, MOST_JUMPS))), start, step, lambda s: s["last"].cast("int"))


def assign(df: DataFrame, shards: int, ident: str = "doc_id", text: str = "text", more: int = 1) -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes and 16 more), text_crc32, law, shard, slot, grown_shard.

    Slots number a shard's rows from 0 in the order of id, hash and size, missing ids last. They are
    counted range by range, so a shard's rows need not meet in one task.
    """
    body = F.encode(text_of(text), "utf-8")
    rows = df.select(
        F.col(ident).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"), jump_shard(F.col(ident), shards).alias("shard"),
        jump_shard(F.col(ident), shards + more).alias("grown_shard"),
    )
    return number_rows(written(rows, "shards"), ["shard"], ["doc_id", "text_crc32", "size"], name="slot", start=0)
