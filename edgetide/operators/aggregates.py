"""Counts, histograms and diagnoses of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def both_ends(log: DataFrame) -> DataFrame:
    """Every row's two ends as column `w`, in one pass."""
    return log.select(F.explode(F.array("src", "dst")).alias("w"))


def num_vertices(log: DataFrame) -> DataFrame:
    return both_ends(log).distinct().agg(F.count("*").alias("num_vertices"))


def num_unique_edges(log: DataFrame) -> DataFrame:
    return log.select("src", "dst").distinct().agg(F.count("*").alias("num_unique_edges"))


def total_updates(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("total_updates"))


def degrees(log: DataFrame, end: str) -> DataFrame:
    return log.groupBy(F.col(end).alias("v")).agg(F.count("*").alias("degree"))


def total_degree(log: DataFrame) -> DataFrame:
    """Events in and out of each vertex."""
    return both_ends(log).groupBy(F.col("w").alias("v")).agg(F.count("*").alias("degree"))


def largest(counts: DataFrame, prefix: str) -> DataFrame:
    """The largest degree and its vertex; of equal ones the least id."""
    return counts.agg(F.max(F.struct("degree", (-F.col("v")).alias("v"))).alias("m")).select(F.col("m.degree").alias(f"max_{prefix}_degree"), (-F.col("m.v")).alias(f"max_{prefix}_vertex"))


def vertex_roles(log: DataFrame) -> DataFrame:
    """Each vertex with its counts as source and as destination."""
    return log.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).groupBy("e.v").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def graph_type(log: DataFrame) -> DataFrame:
    """One row: vertices by role, bipartite, star and parallel-edge reports.

    `is_star` compares a vertex's events with the other vertices' number, so
    repeated edges break it; `is_star_simple` does so on distinct edges.
    """
    roles = vertex_roles(log)
    total = F.col("out_degree") + F.col("in_degree")
    by_vertex = roles.agg(
        F.count_if(F.col("out_degree") > 0).alias("num_sources"),
        F.count_if(F.col("in_degree") > 0).alias("num_destinations"),
        F.count_if((F.col("out_degree") > 0) & (F.col("in_degree") > 0)).alias("overlap"),
        F.count("*").alias("num_vertices"),
        F.coalesce(F.max("out_degree"), F.lit(0)).alias("max_out_degree"),
        F.coalesce(F.max("in_degree"), F.lit(0)).alias("max_in_degree"),
        F.coalesce(F.max(total), F.lit(0)).alias("max_total_degree"),
    )
    pairs = log.groupBy("src", "dst").agg(F.count("*").alias("n"))
    by_pair = pairs.agg(F.count("*").alias("unique_edges"), F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count_if(F.col("n") > 1).alias("parallel_pairs"), F.coalesce(F.max("n"), F.lit(0)).alias("max_parallel"))
    simple = pairs.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("w")).groupBy("w").agg(F.count("*").alias("d")).agg(F.coalesce(F.max("d"), F.lit(0)).alias("max_simple"))
    one = by_vertex.crossJoin(F.broadcast(by_pair)).crossJoin(F.broadcast(simple))  # single rows
    return one.select(
        "num_sources", "num_destinations", "overlap", "num_vertices", "max_out_degree", "max_in_degree", "max_total_degree", "unique_edges", "events", "parallel_pairs", "max_parallel",
        (F.col("overlap") == 0).alias("is_bipartite"),
        ((F.col("num_vertices") > 1) & (F.col("max_total_degree") == F.col("num_vertices") - 1) & (F.col("events") == F.col("num_vertices") - 1)).alias("is_star"),
        ((F.col("num_vertices") > 1) & (F.col("max_simple") == F.col("num_vertices") - 1) & (F.col("unique_edges") == F.col("num_vertices") - 1)).alias("is_star_simple"),
        percent(F.col("parallel_pairs"), F.col("unique_edges")).alias("parallel_pct"),
    )


def percent(x, y):  # noqa: ANN001, ANN201
    """100 x / y; 0 where y is 0."""
    return F.when(y == 0, 0.0).otherwise(F.lit(100.0) * x / y)


def parallel_edges(log: DataFrame) -> DataFrame:
    """(src, dst, n) of the pairs with more than one event."""
    return log.groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1")


def symmetry(log: DataFrame) -> DataFrame:
    """One row: directed pairs, self loops, pairs in both directions and in one, and their share. One shuffle by unordered pair."""
    pairs = log.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.bit_or(F.when(F.col("src") == F.col("dst"), 4).when(F.col("src") < F.col("dst"), 1).otherwise(2)).alias("d"))
    one = pairs.agg(F.count_if(F.col("d") == 4).alias("self_loops"), F.count_if(F.col("d") == 3).alias("both_directions"), F.count_if(F.col("d").isin(1, 2)).alias("one_way"))
    return one.select((F.col("self_loops") + 2 * F.col("both_directions") + F.col("one_way")).alias("directed_pairs"), "self_loops", "both_directions", "one_way", percent(F.col("both_directions"), F.col("both_directions") + F.col("one_way")).alias("symmetric_pct"), (F.col("one_way") == 0).alias("fully_symmetric"))


def reverse_pairs(log: DataFrame, there: bool = True) -> DataFrame:
    """Directed pairs whose reverse occurs, or doesn't."""
    pairs = log.select("src", "dst").distinct()
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return pairs.join(back, ["src", "dst"], "left_semi" if there else "left_anti")


def unique_timestamps(logs: DataFrame, by: str = "file") -> DataFrame:
    """Distinct timestamps of each file; counted in two steps, so one file's rows are spread."""
    return logs.select(by, "ts").distinct().groupBy(by).agg(F.count("ts").alias("unique_timestamps"))


def edge_count_hist(log: DataFrame, least: int = 9) -> DataFrame:
    """(updates, count): directed pairs by their number of updates, from 0 to the largest or `least`, with no gaps."""
    found = log.groupBy("src", "dst").agg(F.count("*").alias("updates")).groupBy("updates").agg(F.count("*").alias("count"))
    dense = found.agg(F.greatest(F.coalesce(F.max("updates"), F.lit(0)), F.lit(least)).alias("top")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("updates"))
    return dense.join(found, "updates", "left").select("updates", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def update_fraction(log: DataFrame) -> DataFrame:
    """(repeats, pairs, updates, edges): directed pairs by their number of updates, with the totals."""
    found = log.groupBy("src", "dst").agg(F.count("*").alias("repeats")).groupBy("repeats").agg(F.count("*").alias("pairs"))
    totals = found.agg(F.sum(F.col("repeats") * F.col("pairs")).alias("updates"), F.sum("pairs").alias("edges"))
    return found.crossJoin(F.broadcast(totals))


def node_update_counts(log: DataFrame) -> DataFrame:
    return both_ends(log).groupBy(F.col("w").alias("v")).agg(F.count("*").alias("updates"))


def top_k(counts: DataFrame, by: str, n: int) -> DataFrame:
    """The n vertices with the most; of equal ones the larger id first."""
    return counts.orderBy(F.desc(by), F.desc("v")).limit(n)


def random_nodes(log: DataFrame, n: int, seed: int) -> DataFrame:
    """n ids drawn from 0 to the largest id."""
    top = log.agg(F.max(F.greatest("src", "dst")).alias("top"))
    return log.sparkSession.range(n).crossJoin(F.broadcast(top)).select(F.floor(F.rand(seed) * (F.col("top") + 1)).cast("long").alias("v"))


def degree_percentiles(counts: DataFrame, shares: tuple[float, ...] = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """(share, degree): the degree at place floor(share * n) of all in order.

    Places are found in the histogram of degrees, not in a sorted list of
    vertices; the window runs over distinct degrees.
    """
    hist = counts.groupBy("degree").agg(F.count("*").alias("n"))
    run = hist.withColumn("upto", F.sum("n").over(W.orderBy("degree").rowsBetween(W.unboundedPreceding, 0)))
    total = hist.agg(F.sum("n").alias("total"))
    asked = total.select("total", F.explode(F.array(*map(F.lit, shares))).alias("share")).withColumn("at", F.floor(F.col("share") * F.col("total")))
    return run.join(F.broadcast(asked), F.col("upto") > F.col("at")).groupBy("share").agg(F.min("degree").alias("degree"))


def pow2_hist(counts: DataFrame, by: str) -> DataFrame:
    """(bucket, count): values by their highest set bit; 0 stays 0."""
    bucket = F.when(F.col(by) <= 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftleft(1L, length(bin({by})) - 1)"))
    return counts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("count"))


def year_range_counts(rows: DataFrame, by: str, year: str = "year") -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("count"), F.min(year).alias("min_year"), F.max(year).alias("max_year"))


def node_uses(paths: DataFrame) -> DataFrame:
    """(node, uses) of nodes used more than once by the paths of column `nodes`: ends count two, others one."""
    each = paths.select(F.size("nodes").alias("n"), F.posexplode("nodes").alias("i", "node"))
    return each.groupBy("node").agg(F.sum(F.when((F.col("i") == 0) | (F.col("i") == F.col("n") - 1), 2).otherwise(1)).alias("uses")).where("uses > 1")


def vertex_union(log: DataFrame) -> DataFrame:
    return log.select(F.col("src").alias("v")).union(log.select(F.col("dst").alias("v"))).distinct()


def vertex_intersect(log: DataFrame) -> DataFrame:
    return log.select(F.col("src").alias("v")).intersect(log.select(F.col("dst").alias("v")))


def multiset_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, removed, added): how many more of each there are on either side."""
    a, b = before.groupBy(key).agg(F.count("*").alias("a")), after.groupBy(key).agg(F.count("*").alias("b"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return both.select(key, F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("removed"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("added")).where("removed + added > 0")
