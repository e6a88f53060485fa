"""Dictionary encoding: external keys to dense ids by several rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.operators.steps import assign_step

RULES = ("first_seen_concat", "first_seen_interleaved", "sorted")


def vertices(log: DataFrame, rule: str = "first_seen_interleaved", start: int = 0, row: str = "row") -> DataFrame:
    """(id, key, degree): ids from `start` on, by first appearance or by the key's order.

    first_seen_concat looks through all sources, then all destinations;
    first_seen_interleaved goes row by row; `row` gives the rows' order.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}; there are {', '.join(RULES)}")
    place = {"first_seen_concat": lambda side: F.struct(F.lit(side).cast("long").alias("a"), F.col(row).cast("long").alias("b")), "first_seen_interleaved": lambda side: F.struct(F.col(row).cast("long").alias("a"), F.lit(side).cast("long").alias("b")), "sorted": lambda side: F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))}[rule]
    ends = log.select(F.explode(F.array(F.struct(F.col("src").alias("key"), place(0).alias("at")), F.struct(F.col("dst").alias("key"), place(1).alias("at")))).alias("e"))
    keys = ends.groupBy("e.key").agg(F.min("e.at").alias("at"), F.count("*").alias("degree"))
    numbered = assign_step(keys.select("key", "degree", "at.a", "at.b"), ("a", "b", "key"), "no")
    return numbered.select((F.col("no") - 1 + start).alias("id"), "key", "degree")


def encode(log: DataFrame, rule: str = "first_seen_interleaved", start: int = 0, row: str = "row") -> tuple[DataFrame, DataFrame]:
    """The log with ids for keys, and the dictionary. Both ends are looked up by equi-joins."""
    known = vertices(log, rule, start, row)
    by = lambda c: known.select(F.col("key").alias(c), F.col("id").alias(f"{c}_id"))
    ids = log.join(by("src"), "src").join(by("dst"), "dst").drop("src", "dst").withColumnsRenamed({"src_id": "src", "dst_id": "dst"})
    return ids.select("src", "dst", *(c for c in log.columns if c not in ("src", "dst"))), known
