"""Random graphs as logs; every draw is a hash of its row's number and the seed, so a recomputed partition is the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def draw(seed: int, *names: str | Column) -> Column:
    """A uniform number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *names), 11) / F.lit(float(1 << 53))


def gen_rmat(spark: SparkSession, n: int, m: int, a: float = 0.5, b: float = 0.1, c: float = 0.1, seed: int = 0) -> DataFrame:
    """m edges over at least n ids, each placed by one quadrant draw a bit; times are the rows' numbers."""
    bits = max(1, (max(n, 2) - 1).bit_length())
    rows = spark.range(m).select(F.col("id").alias("ts"), F.transform(F.sequence(F.lit(1), F.lit(bits)), lambda i: draw(seed, "id", i)).alias("r"))
    down = F.aggregate("r", F.lit(0).cast("long"), lambda x, r: x * 2 + F.when(r >= a + b, 1).otherwise(0))
    right = F.aggregate("r", F.lit(0).cast("long"), lambda x, r: x * 2 + F.when(((r >= a) & (r < a + b)) | (r >= a + b + c), 1).otherwise(0))
    return rows.select(down.alias("src"), right.alias("dst"), "ts")


def gen_er(spark: SparkSession, n: int, p: float = 0.01, seed: int = 0) -> DataFrame:
    """Each directed pair, self pairs included, with probability p; times are uniform.

    Only the pairs that occur are made: each source's gaps between chosen
    destinations are geometric, so the work is in proportion to the result.
    """
    if p <= 0 or n <= 0:
        return spark.createDataFrame([], "src long, dst long, ts long")
    if p >= 1:
        pairs = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("dst"))
    else:
        most = int(n * p + 12 * (n * p * (1 - p)) ** 0.5 + 24)
        gap = lambda i: F.floor(F.log(F.lit(1.0) - draw(seed, "id", i)) / F.log(F.lit(1.0 - p))).cast("long") + 1
        gaps = F.transform(F.sequence(F.lit(1), F.lit(most)), gap)
        places = F.aggregate(gaps, F.struct(F.lit(-1).cast("long").alias("at"), F.array().cast("array<long>").alias("out")), lambda acc, g: F.when(acc["at"] + g >= n, F.struct(F.lit(n).cast("long").alias("at"), acc["out"].alias("out"))).otherwise(F.struct((acc["at"] + g).alias("at"), F.array_append(acc["out"], acc["at"] + g).alias("out"))), lambda acc: acc["out"])
        pairs = spark.range(n).select(F.col("id").alias("src"), F.explode(places).alias("dst"))
    return pairs.select("src", "dst", F.floor(draw(seed + 1, "src", "dst") * max(1, int(n * n * p))).cast("long").alias("ts"))


def gen_ws(spark: SparkSession, n: int, k: int = 40, beta: float = 0.1, seed: int = 0) -> DataFrame:
    """A ring of n ids, each linked to its k next ones; an edge's end is drawn anew with probability beta."""
    ring = spark.range(n * k).select(F.expr(f"id div {k}").alias("src"), F.expr(f"(id div {k} + id % {k} + 1) % {n}").alias("near"), F.col("id").alias("ts"))
    far = F.floor(draw(seed + 1, "ts") * n).cast("long")
    return ring.select("src", F.when(draw(seed, "ts") < beta, far).otherwise(F.col("near")).alias("dst"), "ts")


def fixture(spark: SparkSession, n: int, ids: int, seed: int = 0) -> DataFrame:
    """A random update log for tests: deletion and insertion by turns."""
    return spark.range(n).select(F.floor(draw(seed, "id") * ids).cast("long").alias("src"), F.floor(draw(seed + 1, "id") * ids).cast("long").alias("dst"), F.floor(draw(seed + 2, "id") * n).cast("long").alias("ts"), F.round(draw(seed + 3, "id") * 100, 3).alias("weight"), ((F.col("id") + 1) % 2).cast("byte").alias("op"))
