"""Number formats, text functions and time stamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabeval.functions import file_stem, fixed_text
from tabeval.queries import frames as fr
from tabeval.queries.registry import query


@query(
    "f2_number_formats",
    """SELECT l_suppkey, format('{:.4f}', avg(l_discount)) AS four, format('{:.3f}', avg(l_quantity)) AS three,
      format('{:.1f}', avg(l_extendedprice)) AS one, format('{:.2f}%', 100 * avg(l_tax)) AS percent,
      format('{:,}', sum(l_partkey)::bigint) AS thousands FROM lineitem GROUP BY l_suppkey""",
)
def number_formats(spark, d):
    rows = fr.table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.avg("l_discount").alias("a"), F.avg("l_quantity").alias("b"), F.avg("l_extendedprice").alias("c"),
        F.avg("l_tax").alias("t"), F.sum("l_partkey").alias("s"),
    )
    return rows.select(
        "l_suppkey",
        fixed_text("a", 4).alias("four"),
        fixed_text("b", 3).alias("three"),
        fixed_text("c", 1).alias("one"),
        F.concat(fixed_text(F.col("t") * 100, 2), F.lit("%")).alias("percent"),
        F.format_number("s", 0).alias("thousands"),
    )


@query(
    "f3_text_functions",
    """SELECT p_partkey, replace(lower(p_name), ' ', '_') AS stem, contains(p_name, 'ring') AS has_ring,
      upper(p_type[1]) || lower(p_type[2:]) AS capital FROM part""",
)
def text_functions(spark, d):
    return fr.table(spark, d, "part").select(
        "p_partkey",
        file_stem("p_name").alias("stem"),
        F.col("p_name").contains("ring").alias("has_ring"),
        F.initcap("p_type").alias("capital"),
    )


@query("f9_iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS at FROM events")
def iso_time(spark, d):
    return fr.table(spark, d, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at")
    )
