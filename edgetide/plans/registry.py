"""Metrics as plug-ins: functions of a snapshot, or of the log's relations and report points."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.operators import reports as R
from edgetide.operators import static


@dataclass
class DeltaMetric:
    """A time series: `of(relation, points, print_freq, n_steps, params)` returns k and `columns`."""

    columns: tuple[str, ...]
    of: Callable[..., DataFrame]


@dataclass
class SnapshotMetric:
    """One row of `columns` from the pairs of a snapshot: `of(edges, n, params)`."""

    columns: tuple[str, ...]
    of: Callable[..., DataFrame]


def _bfs(arrivals: DataFrame, points: DataFrame, pf: int, n: int, params: dict) -> DataFrame:
    found = params.get("distances")
    return R.bfs_max_distance(R.append_bfs(arrivals, params.get("src", 1)) if found is None else found, points, pf, -(-n // pf))


APPEND: dict[str, DeltaMetric] = {
    "cc": DeltaMetric(("component_count", "max_component_size"), lambda a, p, pf, n, x: R.append_components(a, p, pf)),
    "tc": DeltaMetric(("num_triangles",), lambda a, p, pf, n, x: R.append_triangles(a, p, pf)),
    "bfs": DeltaMetric(("max_distance_from_src",), _bfs),
}
DYNAMIC: dict[str, DeltaMetric] = {
    "cc": DeltaMetric(("component_count", "max_component_size"), lambda i, p, pf, n, x: R.dynamic_components(i, p, pf, n)),
    "tc": DeltaMetric(("num_triangles",), lambda i, p, pf, n, x: R.dynamic_triangles(i, p, pf, n)),
}
SNAPSHOT: dict[str, SnapshotMetric] = {
    "bfs": SnapshotMetric(("max_distance_from_src",), lambda e, n, x: static.static_bfs(e, x.get("src", 1)).agg(F.coalesce(F.max("distance"), F.lit(0)).alias("max_distance_from_src"))),
    "cc": SnapshotMetric(("component_count", "non_empty_components", "max_component_size"), lambda e, n, x: static.static_cc(e, n)),
    "kcore": SnapshotMetric(("avg_coreness", "max_coreness", "p25_coreness", "p50_coreness", "p75_coreness"), lambda e, n, x: static.static_kcore(e, n)),
}
