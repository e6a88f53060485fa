"""A snapshot's graph and what is asked of it: counts, degrees, and functions over neighbours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class GraphView:
    """An undirected graph of distinct pairs (u, v), u < v; every answer is a lazy frame."""

    pairs: DataFrame

    @classmethod
    def at(cls, relation: DataFrame, step: int) -> GraphView:
        """The graph after `step` rows, from arrivals (u, v, step) or intervals (u, v, s0, e0)."""
        alive = F.col("step") <= step if "step" in relation.columns else (F.col("s0") <= step) & (F.col("e0").isNull() | (F.col("e0") > step))
        return cls(relation.where(alive).select("u", "v"))

    def neighbours(self, of: list[int] | None = None) -> DataFrame:
        """(v, w): every vertex, or each of `of`, with each of its neighbours."""
        ends = self.pairs
        if of is not None:  # both ends are compared at the scan, before rows are doubled
            ends = ends.where(F.col("u").isin(of) | F.col("v").isin(of))
        both = ends.select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("v").alias("w")), F.struct(F.col("v").alias("v"), F.col("u").alias("w")))).alias("e")).select("e.v", "e.w")
        return both if of is None else both.where(F.col("v").isin(of))

    def map_neighbours(self, value: Column, of: list[int] | None = None, name: str = "value") -> DataFrame:
        """(v, w, value): an expression over v and its neighbour w, in place of a call for each."""
        return self.neighbours(of).select("v", "w", value.alias(name))

    def count_neighbours(self, condition: Column, of: list[int] | None = None) -> DataFrame:
        """(v, count): how many neighbours w meet a condition over v and w; counted before the shuffle."""
        return self.neighbours(of).groupBy("v").agg(F.count_if(condition).alias("count"))

    def degrees(self) -> DataFrame:
        return self.neighbours().groupBy("v").agg(F.count("*").alias("degree"))

    def summary(self) -> DataFrame:
        """One row: nodes that have an edge, edges, average degree (edges over nodes) and the largest degree."""
        d = self.degrees().agg(F.count("*").alias("num_nodes"), F.expr("coalesce(sum(degree), 0) div 2").alias("num_edges"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"))
        return d.select("num_nodes", "num_edges", F.try_divide(F.col("num_edges").cast("double"), "num_nodes").alias("average_degree"), "max_degree")
