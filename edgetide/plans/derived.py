"""Graphs derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.operators.steps import assign_step
from edgetide.session import table


def seconds(c: str) -> Column:
    """Whole seconds since 1970 of a timestamp without a zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def g_trade(spark: SparkSession, d: str) -> DataFrame:
    """Customers to suppliers, by shipping date."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", seconds("l_shipdate").alias("ts"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst"), "ts")


def g_part(spark: SparkSession, d: str) -> DataFrame:
    """Parts to suppliers."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst"), seconds("l_shipdate").alias("ts"))


def g_hop(spark: SparkSession, d: str) -> DataFrame:
    """Each event's user to the next event's; a join on neighbouring steps in place of a window over all rows."""
    steps = assign_step(table(spark, d, "events").select("ts", "event_id", "user_id"), ("ts", "event_id"))
    after = steps.select((F.col("step") - 1).alias("step"), F.col("user_id").alias("dst"))
    return steps.join(after, "step").select(F.col("user_id").alias("src"), "dst", seconds("ts").alias("ts"))


def g_user_k(spark: SparkSession, d: str) -> DataFrame:
    """Users to property values; an error deletes."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(F.col("user_id").alias("src"), (k + 1_000_000).alias("dst"), seconds("ts").alias("ts"), F.when(F.col("event_type") == "error", 1).otherwise(0).cast("byte").alias("op"))


def g_links(spark: SparkSession, d: str) -> DataFrame:
    """Pages to the targets of their links, as keys."""
    return table(spark, d, "pages").select(F.col("page_id").alias("page"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target"))


#: The same graphs in DuckDB's SQL.
SQL = {
    "g_trade": "select o.o_custkey::bigint as src, (1000000 + l.l_suppkey)::bigint as dst, epoch_us(l.l_shipdate) // 1000000 as ts from orders o join lineitem l on o.o_orderkey = l.l_orderkey",
    "g_part": "select l_partkey::bigint as src, (1000000 + l_suppkey)::bigint as dst, epoch_us(l_shipdate) // 1000000 as ts from lineitem",
    "g_hop": "select * from (select user_id::bigint as src, lead(user_id) over (order by ts, event_id)::bigint as dst, epoch_us(ts) // 1000000 as ts from events) where dst is not null",
    "g_user_k": "select user_id::bigint as src, (1000000 + regexp_extract(props, '\"k\": *([0-9]+)', 1)::bigint)::bigint as dst, epoch_us(ts) // 1000000 as ts, case when event_type = 'error' then 1 else 0 end as op from events",
    "g_links": "select page_id as page, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) as target from pages",
}
