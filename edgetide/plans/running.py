"""Running sums and maxima over dense report numbers, and maxima over intervals of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BLOCK = 4096


def running(reports: DataFrame, sums: tuple[str, ...] = (), maxima: tuple[str, ...] = (), key: str = "k") -> DataFrame:
    """`reports` with the named columns accumulated in the order of `key`.

    Accumulation is within blocks of report numbers first; only one row a block
    meets in the window over blocks, so no task orders all reports.
    """
    cut = reports.withColumn("_block", F.floor(F.col(key) / BLOCK))
    inside = W.partitionBy("_block").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    totals = cut.groupBy("_block").agg(*(F.sum(c).alias(f"_of_{c}") for c in sums), *(F.max(c).alias(f"_of_{c}") for c in maxima))
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select("_block", *(F.coalesce(F.sum(f"_of_{c}").over(before), F.lit(0)).alias(f"_of_{c}") for c in sums), *(F.max(f"_of_{c}").over(before).alias(f"_of_{c}") for c in maxima))
    done = cut.join(carried, "_block")
    done = done.withColumns({c: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_of_{c}") for c in sums} | {c: F.greatest(F.max(c).over(inside), F.col(f"_of_{c}")) for c in maxima})
    return done.drop("_block", *(f"_of_{c}" for c in (*sums, *maxima)))


def interval_max(intervals: DataFrame, reports: DataFrame, value: str, levels: int = 40) -> DataFrame:
    """(k, value): for each report the largest value of the intervals [k0, k1) that hold it.

    An interval is covered by at most two aligned blocks of each power of two,
    and a report looks up its own block of each: equi-joins only.
    """
    pieces = intervals.where("k0 < k1").select("k0", "k1", value, F.expr("explode(sequence(0, length(bin(k1 - k0)) - 1))").alias("lv"))
    # At each level: the block that starts the rest from the left, and the one that ends it, where they are odd.
    lo, hi = F.expr("(k0 + shiftleft(1L, lv) - 1) div shiftleft(1L, lv)"), F.expr("k1 div shiftleft(1L, lv)")
    blocks = pieces.withColumns({"lo": lo, "hi": hi}).where("lo < hi")
    cover = blocks.select("lv", value, F.explode(F.array_compact(F.array(F.when(F.col("lo") % 2 == 1, F.col("lo")), F.when(F.col("hi") % 2 == 1, F.col("hi") - 1)))).alias("block")).groupBy("lv", "block").agg(F.max(value).alias(value))
    asked = reports.select("k", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("lv")).withColumn("block", F.expr("k div shiftleft(1L, lv)"))
    return asked.join(cover, ["lv", "block"]).groupBy("k").agg(F.max(value).alias(value))
