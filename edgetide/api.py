"""The public calls: convert a log to the packed format, read it, analyze it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.functions.scalars import op_parse
from edgetide.operators import reports as R
from edgetide.operators.dictionary import encode
from edgetide.operators.steps import arrivals, assign_step, edge_intervals, limit_first_n, shuffle_signal, shuffle_update, signal_to_windowed
from edgetide.plans.registry import APPEND, DYNAMIC, SNAPSHOT
from edgetide.session import checkpoint
from edgetide.sources.packed import read_bin, write_bin
from edgetide.sources.packed import read_header as _header
from edgetide.sources.text import read_csv, read_graph


def read_header(spark: SparkSession, path: str) -> dict:
    """A packed log's eight header fields, types by name."""
    return _header(spark, path).as_dict()


def convert(spark: SparkSession, source: DataFrame | str, output: str, *, directed: bool = True, signal: bool = False, vertex_id_type: str = "uint32", timestamp_type: str = "uint32", weight_type: str = "none", src_col: str = "src", dst_col: str = "dst", timestamp_col: str = "timestamp", weight_col: str = "weight", info_col: str = "info", sep: str | None = None) -> dict:
    """Write a table or delimited file as a packed log with dense ids and return its header.

    Rows keep their order. A missing column of a type that is asked for is an
    error, so the header never misstates the row width.
    """
    raw = read_csv(spark, source, sep, (src_col, dst_col, timestamp_col, info_col)) if isinstance(source, str) else source
    wanted = {"src": src_col, "dst": dst_col} | ({"ts": timestamp_col} if timestamp_type != "none" else {}) | ({"weight": weight_col} if weight_type != "none" else {}) | ({} if signal else {"op": info_col})
    if missing := [c for c in wanted.values() if c not in raw.columns]:
        raise ValueError(f"no column {', '.join(missing)}")
    rows = raw.select(*(F.col(f"`{c}`").alias(n) for n, c in wanted.items())).withColumn("at", F.monotonically_increasing_id())
    numbered = assign_step(rows, ("at",), "row").drop("at")
    casts = {"ts": F.col("ts").cast("double" if timestamp_type.startswith("float") else "long"), "weight": F.col("weight").cast("double" if weight_type.startswith("float") else "long"), "op": op_parse(F.col("op"))}
    typed = numbered.withColumns({k: v for k, v in casts.items() if k in numbered.columns})
    log, _ = encode(typed, "first_seen_concat")
    return write_bin(log, output, directed=directed, signal=signal, vertex_id_type=vertex_id_type, timestamp_type=timestamp_type, weight_type=weight_type, order=["row"]).as_dict()


@dataclass
class AnalysisResult:
    """Lazy frames: the time series, the snapshots (None if not asked for), and the histogram of distance updates (append-only)."""

    dynamic: DataFrame
    static: DataFrame | None
    bfs_hist: DataFrame | None


def analyze(spark: SparkSession, source: DataFrame | str, *, print_freq: int = 1000, static_algorithm_count: int = 0, src: int = 1, max_updates: int = -1, window_size: int = 0, edges_shuffle: bool = False, seed: int = 0, metrics: tuple[str, ...] = ("cc", "tc", "bfs")) -> AnalysisResult:
    """Statistics of a log every `print_freq` updates, and of `static_algorithm_count` snapshots.

    A signal log without a window is append-only; with one, and for update
    logs, edges come and go.
    """
    log = read_graph(spark, source) if isinstance(source, str) else source
    if "row" in log.columns:
        log = limit_first_n(log, max_updates)
    elif max_updates > 0:
        numbered = assign_step(log.withColumn("at", F.monotonically_increasing_id()), ("at",), "row")
        log = numbered.where(F.col("row") <= max_updates).drop("at")
    updates = "op" in log.columns and not log.where("op <> 0").isEmpty()
    if edges_shuffle:
        log = shuffle_update(log, seed) if updates else shuffle_signal(log, seed)
    if window_size > 0 and not updates:
        log, updates = signal_to_windowed(log, window_size), True
    steps = checkpoint(assign_step(log.select("src", "dst", "ts", *(["op"] if updates else []))))
    n = R.total_steps(steps)
    points = checkpoint(R.reports(steps, print_freq))
    params = {"src": src}
    if updates:
        relation = checkpoint(edge_intervals(steps))
        series, plugins = R.dynamic_stats(relation, points, print_freq, n), DYNAMIC
    else:
        relation = checkpoint(arrivals(steps))
        series, plugins = R.append_stats(relation, points, print_freq), APPEND
    if not updates and "bfs" in metrics:
        params["distances"] = checkpoint(R.append_bfs(relation, src))  # the series and the histogram both read it
    for name in metrics:
        if m := plugins.get(name):
            series = series.join(m.of(relation, points, print_freq, n, params).select("k", *m.columns), "k")
    return AnalysisResult(series.drop("k"), _snapshots(steps, relation, updates, static_algorithm_count, n, params), R.bfs_update_hist(params["distances"], relation) if "distances" in params else None)


def _snapshots(steps: DataFrame, relation: DataFrame, updates: bool, count: int, n: int, params: dict) -> DataFrame | None:
    """A row for each snapshot; there are as many as asked for, so the loop is over them and not over data."""
    if count <= 0 or n == 0:
        return None
    period = max(1, n // count)
    ids = steps.agg(F.max(F.greatest("src", "dst"))).first()[0] + 1
    out = None
    for at in range(period, n + 1, period):
        edges = relation.where((F.col("s0") <= at) & (F.col("e0").isNull() | (F.col("e0") > at))) if updates else relation.where(F.col("step") <= at)
        row = steps.where(F.col("step") == at).select(F.col("step").alias("timestep"), F.col("ts").alias("timestamp"))
        for m in SNAPSHOT.values():
            row = row.crossJoin(F.broadcast(m.of(edges.select("u", "v"), ids, params)))  # single rows
        out = row if out is None else out.unionByName(row)
    return out


def sweep(spark: SparkSession, source: DataFrame | str, windows: tuple[int, ...] = (10, 100, 1000, 10_000, 100_000, 1_000_000, 10_000_000), seed: int = 0, **options) -> dict[tuple[bool, int], AnalysisResult]:  # noqa: ANN003
    """`analyze` over true and shuffled times and all windows, 0 being append-only."""
    return {(shuffled, w): analyze(spark, source, window_size=w, edges_shuffle=shuffled, seed=seed, **options) for shuffled in (False, True) for w in (0, *windows)}


def compare_runs(runs: dict[str, DataFrame], column: str, by: str = "timestep") -> DataFrame:
    """(by, run, value) of one column over several runs, up to the least of their last points."""
    parts = [df.select(F.col(by), F.lit(name).alias("run"), F.col(column).cast("double").alias("value")) for name, df in runs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    limit = out.groupBy("run").agg(F.max(by).alias("m")).agg(F.min("m").alias("m"))
    return out.join(F.broadcast(limit), F.col(by) <= F.col("m")).drop("m")


__all__ = ["AnalysisResult", "analyze", "compare_runs", "convert", "read_bin", "read_header", "sweep"]
