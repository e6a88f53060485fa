"""Algorithms on one snapshot of pairs (u, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from edgetide.operators.components import connected_components
from edgetide.session import checkpoint


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each distinct pair."""
    pairs = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    return pairs.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.a", "e.b")


def static_bfs(edges: DataFrame, src: int, max_rounds: int = 100_000) -> DataFrame:
    """(v, distance) of every vertex that src reaches; one join a hop, over the frontier only."""
    both = checkpoint(symmetric(edges))
    front = edges.sparkSession.range(1).select(F.lit(src).cast("long").alias("a"), F.lit(0).alias("distance"))
    seen = front
    for h in range(1, max_rounds):
        front = checkpoint(both.join(front.select("a"), "a").select(F.col("b").alias("a")).distinct().join(seen, "a", "left_anti").withColumn("distance", F.lit(h)))
        if front.isEmpty():
            break
        seen = checkpoint(seen.unionAll(front))
    else:
        raise RuntimeError(f"distances did not settle in {max_rounds} rounds")
    return seen.select(F.col("a").alias("v"), "distance")


def component_sizes(edges: DataFrame) -> DataFrame:
    """(root, size) of the components of two or more vertices."""
    return connected_components(edges).groupBy("root").agg(F.count("*").alias("size"))


def static_cc(edges: DataFrame, n: int) -> DataFrame:
    """One row over the ids 0 to n - 1: components with isolated ids, components of two or more, and the largest size."""
    found = component_sizes(edges).agg(F.count("*").alias("non_empty_components"), F.coalesce(F.sum("size"), F.lit(0)).alias("held"), F.coalesce(F.max("size"), F.lit(1 if n else 0)).alias("max_component_size"))
    return found.select((F.lit(n) - F.col("held") + F.col("non_empty_components")).alias("component_count"), "non_empty_components", "max_component_size")


def coreness(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(v, core): the fixed point of each vertex's h-index over its neighbours' values, from its degree on."""
    both = checkpoint(symmetric(edges))
    now = checkpoint(both.groupBy("a").agg(F.count("*").alias("h")))
    for _ in range(max_rounds):
        # Of equal values only the number counts, so a hub's window runs over distinct values, not neighbours.
        values = both.join(now.select(F.col("a").alias("b"), "h"), "b").groupBy("a", "h").agg(F.count("*").alias("n"))
        above = values.withColumn("at_least", F.sum("n").over(W.partitionBy("a").orderBy(F.desc("h")).rowsBetween(W.unboundedPreceding, 0)))
        index = above.groupBy("a").agg(F.max(F.least("at_least", "h")).alias("h"))
        new = checkpoint(index.join(now.withColumnRenamed("h", "old"), "a"))
        now = new.select("a", "h")
        if new.where("h <> old").isEmpty():
            break
    else:
        raise RuntimeError(f"coreness did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("v"), F.col("h").alias("core"))


def static_kcore(edges: DataFrame, n: int) -> DataFrame:
    """One row over the ids 0 to n - 1: mean (whole), largest and quartile coreness; isolated ids have 0."""
    hist = coreness(edges).groupBy("core").agg(F.count("*").alias("n"))
    held = hist.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("held"))
    full = hist.unionAll(held.select(F.lit(0).cast("long").alias("core"), (F.lit(n) - F.col("held")).alias("n"))).groupBy("core").agg(F.sum("n").alias("n")).where("n > 0")
    run = full.withColumn("upto", F.sum("n").over(W.orderBy("core").rowsBetween(W.unboundedPreceding, 0)))  # a row a distinct coreness
    at = lambda share: F.min(F.when(F.col("upto") > int(share * n), F.col("core")))
    return run.agg(F.expr(f"coalesce(sum(core * n), 0) div {max(n, 1)}").alias("avg_coreness"), F.coalesce(F.max("core"), F.lit(0)).alias("max_coreness"), at(0.25).alias("p25_coreness"), at(0.5).alias("p50_coreness"), at(0.75).alias("p75_coreness"))
