"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.session import checkpoint


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 64) -> DataFrame:
    """(node, root): each endpoint with the least node id that it is linked to.

    Every round hangs neighbours on local minima (large stars, then small ones),
    so the number of rounds grows with the logarithm of the diameter. Minima are
    aggregated before the shuffle; a hub's edges meet only its one minimum in a
    join that adaptive execution may split. Each round is checkpointed.
    """
    now = checkpoint(edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a <> b").distinct())
    state = _state(now)
    for _ in range(max_rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        now = checkpoint(small)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free hash of them."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0)), F.coalesce(F.sum(F.expr("xxhash64(b, a) % 1000003")), F.lit(0))).first())
