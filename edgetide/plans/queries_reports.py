"""Queries of time series, snapshots and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide import api
from edgetide.operators import reports as R
from edgetide.operators import static
from edgetide.operators import steps as ST
from edgetide.operators.graph import GraphView
from edgetide.operators.orientation import degeneracy_orientation, edge_orientation
from edgetide.plans.catalog_tools import ARRIVALS, COLLAPSED, INTERVALS, SU, S, over, registrar, reports_sql, windowed_sql
from edgetide.plans.derived import g_hop, g_part, g_trade, g_user_k, seconds
from edgetide.session import checkpoint, table

QUERIES, ORACLE_SQL, query = registrar()
Sp, Df = SparkSession, DataFrame
PF, HOUR = 1000, 3600
WINDOW = 6 * HOUR


def _append(spark: Sp, log: Df) -> tuple[Df, Df, Df, int]:
    steps = ST.assign_step(log)
    return steps, checkpoint(ST.arrivals(steps)), checkpoint(R.reports(steps, PF)), R.total_steps(steps)


def _dynamic(spark: Sp, log: Df) -> tuple[Df, Df, Df, int]:
    steps = ST.assign_step(log)
    return steps, checkpoint(ST.edge_intervals(steps)), checkpoint(R.reports(steps, PF)), R.total_steps(steps)


NODES = ("ends as (select step, u as w, src from a union all select step, v, src from a)", "fv as (select w, min(step) as step from ends group by 1)", "deg as (select step, w, src, row_number() over (partition by w order by step) as d from ends)")
TRI = "tri as (select greatest(x.step, y.step, z.step) as step, count(*) as c from a x join a y on x.v = y.u join a z on z.u = x.u and z.v = y.v group by 1)"
BASIC = """rep.endp as timestep, (select ts from s where step = rep.st) as timestamp,
    (select count(*) from fv where step <= endp) as num_nodes, (select count(*) from a where step <= endp) as num_edges,
    (select count(*) from a where step <= endp)::double / nullif((select count(*) from fv where step <= endp), 0) as average_degree,
    coalesce((select max(d) from deg where w = src and step <= endp), 0) as max_degree,
    coalesce((select max(d) from deg where step <= endp), 0) as max_degree_true,
    (select count(*) from a where step between st and endp) as new_edges"""


def _append_sql(graph: str, columns: str, *parts: str) -> str:
    return over(graph, f"select {columns} from rep", S, ARRIVALS, reports_sql(PF), *parts)


@query(_append_sql("g_hop", BASIC + ", coalesce((select sum(c) from tri where step <= endp), 0)::bigint as num_triangles", *NODES, TRI))
def graph_statistics(spark: Sp, d: str) -> Df:
    """The flagship: nodes, edges, degrees, new edges and triangles of the hop graph over time."""
    _, a, points, n = _append(spark, g_hop(spark, d))
    base = R.append_stats(a, points, PF)
    return base.join(R.append_triangles(a, points, PF).select("k", "num_triangles"), "k").drop("k")


@query(_append_sql("g_trade", BASIC, *NODES))
def running_stats(spark: Sp, d: str) -> Df:
    _, a, points, n = _append(spark, g_trade(spark, d))
    return R.append_stats(a, points, PF).drop("k")


@query(_append_sql("g_hop", "endp as timestep, coalesce((select sum(c) from tri where step <= endp), 0)::bigint as num_triangles", TRI))
def append_tc(spark: Sp, d: str) -> Df:
    _, a, points, _ = _append(spark, g_hop(spark, d))
    return R.append_triangles(a, points, PF).drop("k")


@query(over("g_hop", "select step as closed, count(*) as triangles from (select greatest(x.step, y.step, z.step) as step from a x join a y on x.v = y.u join a z on z.u = x.u and z.v = y.v) group by 1", S, ARRIVALS))
def triangle_join(spark: Sp, d: str) -> Df:
    return R.triangles(ST.arrivals(ST.assign_step(g_hop(spark, d)))).groupBy(F.col("s0").alias("closed")).agg(F.count("*").alias("triangles"))


SYM = "sym as (select rep.k, u, v from rep join a on a.step <= rep.endp union select rep.k, v, u from rep join a on a.step <= rep.endp)"
LABELS = "lab(k, v, l) as (select distinct k, u, u from sym union select lab.k, sym.v, lab.l from lab join sym on sym.k = lab.k and sym.u = lab.v where lab.l < sym.v)"
ROOTS = "roots as (select k, v, least(v, min(l)) as r from lab group by 1, 2)"


@query(_append_sql("g_hop", "endp as timestep, (select count(distinct r) from roots where roots.k = rep.k) as component_count, coalesce((select max(c) from (select count(*) as c from roots where roots.k = rep.k group by r)), 0) as max_component_size", SYM, LABELS, ROOTS))
def append_cc(spark: Sp, d: str) -> Df:
    _, a, points, _ = _append(spark, g_hop(spark, d))
    return R.append_components(a, points, PF).drop("k")


#: Components by spreading the least id, round by round; graphs here are a few hops wide.
LEAST_ROUNDS = 24


def least_labels(pairs: str, key: str = "0") -> tuple[str, str]:
    """Parts that end in `roots` (k, v, r) for the pairs (k, u, v) of a select."""
    return (
        f"sym as (select distinct * from (select {key}::bigint as k, u, v from ({pairs}) union all select {key}::bigint, v, u from ({pairs})))",
        f"spread(i, k, v, r) as (select 0, k, u, u from sym group by k, u union all (select i + 1, k, v, min(r) from (select s.i, s.k, s.v, s.r from spread s where s.i < {LEAST_ROUNDS} union all select s.i, s.k, e.v, s.r from spread s join sym e on e.k = s.k and e.u = s.v where s.i < {LEAST_ROUNDS}) group by 1, 2, 3))",
        f"roots as (select k, v, r from spread where i = {LEAST_ROUNDS})",
    )


SIZES = "(select count(distinct r) from roots where roots.k = rep.k) as component_count, coalesce((select max(c) from (select count(*) as c from roots where roots.k = rep.k group by r)), {}) as max_component_size"


@query(_append_sql("g_trade", "endp as timestep, " + SIZES.format(0), *least_labels("select rep.k, u, v from rep join a on a.step <= rep.endp", "k")))
def append_cc_trade(spark: Sp, d: str) -> Df:
    """As append_cc, on the larger graph."""
    _, a, points, _ = _append(spark, g_trade(spark, d))
    return R.append_components(a, points, PF).drop("k")


BFS_PARTS = (
    "both_ends as (select u, v, step from a union all select v, u, step from a)",
    # The earliest step by which v is within h hops: hops are few, so walks are tried by their number.
    "walk(h, v, b) as (select 0, 1::bigint, 0::bigint union all (select h1, v, min(b) from (select w.h + 1 as h1, e.v, greatest(w.b, e.step) as b from walk w join both_ends e on e.u = w.v where w.h < 12 union all select h + 1, v, b from walk where h < 12) group by 1, 2))",
    "first as (select v, h, b from (select *, lag(b) over (partition by v order by h) as pb from walk) where pb is null or b < pb)",
)


@query(_append_sql("g_hop", "endp as timestep, coalesce((select max(h) from (select v, min(h) as h from walk where b <= endp group by v)), 0)::bigint as max_distance_from_src", *BFS_PARTS[:2]))
def append_bfs(spark: Sp, d: str) -> Df:
    _, a, points, n = _append(spark, g_hop(spark, d))
    return R.bfs_max_distance(R.append_bfs(a, 1), points, PF, -(-n // PF)).drop("k")


@query(over("g_hop", "select coalesce(n, 0) as size, count(*) as count from a left join (select b as step, count(*) as n from first where h > 0 group by 1) f on f.step = a.step group by 1", S, ARRIVALS, *BFS_PARTS))
def bfs_update_hist(spark: Sp, d: str) -> Df:
    _, a, _, _ = _append(spark, g_hop(spark, d))
    return R.bfs_update_hist(R.append_bfs(a, 1), a)


@query(over("g_hop", "select v, min(b) as step, min(h)::int as hops from walk group by v", S, ARRIVALS, *BFS_PARTS[:2]))
def frontier_join(spark: Sp, d: str) -> Df:
    """When each vertex is first reached from 1, and by how few hops in the end."""
    bfs = R.append_bfs(ST.arrivals(ST.assign_step(g_hop(spark, d))), 1)
    return bfs.groupBy("v").agg(F.min("b").alias("step"), F.max("h").alias("m"), F.min("h").alias("hops")).drop("m")


# Graphs with deletions

ALIVE = "s0 <= endp and (e0 is null or e0 > endp)"
DYN_NODES = f"alive as (select k, u, v from rep join iv on {ALIVE})", "ends as (select k, u as w from alive union all select k, v from alive)", "deg as (select k, w, count(*) as d from ends group by 1, 2)"
DYN = """endp as timestep, (select ts from s where step = rep.st) as timestamp, (select count(*) from deg where deg.k = rep.k) as num_nodes, (select count(*) from alive where alive.k = rep.k) as num_edges,
    (select count(*) from alive where alive.k = rep.k)::double / nullif((select count(*) from deg where deg.k = rep.k), 0) as average_degree,
    coalesce((select max(d) from deg where deg.k = rep.k), 0) as max_degree, (select count(*) from iv where s0 between st and endp) as new_edges"""
DYN_TRI = "tri as (select greatest(x.s0, y.s0, z.s0) as s0, x.e0 as ex, y.e0 as ey, z.e0 as ez, least(coalesce(x.e0, 9000000000), coalesce(y.e0, 9000000000), coalesce(z.e0, 9000000000)) as e0 from iv x join iv y on x.v = y.u join iv z on z.u = x.u and z.v = y.v)"
WINDOWED = (*windowed_sql(WINDOW), "s as (select row_number() over (order by ts, op desc, src, dst) as step, * from wu)", COLLAPSED, INTERVALS, reports_sql(PF))


@query(over("g_hop", f"select {DYN}, (select count(*) from tri where s0 < e0 and {ALIVE}) as num_triangles from rep", *WINDOWED, *DYN_NODES, DYN_TRI))
def graph_statistics_remove(spark: Sp, d: str) -> Df:
    """The hop graph with lives of six hours: all counts over time."""
    _, iv, points, n = _dynamic(spark, ST.signal_to_windowed(g_hop(spark, d), WINDOW))
    base = R.dynamic_stats(iv, points, PF, n)
    return base.join(R.dynamic_triangles(iv, points, PF, n).select("k", "num_triangles"), "k").drop("k")


@query(over("g_user_k", f"select {DYN} from rep", SU, COLLAPSED, INTERVALS, reports_sql(PF), *DYN_NODES))
def alive_asof(spark: Sp, d: str) -> Df:
    _, iv, points, n = _dynamic(spark, g_user_k(spark, d))
    return R.dynamic_stats(iv, points, PF, n).drop("k")


@query(over("g_hop", f"select endp as timestep, (select count(*) from tri where s0 < e0 and {ALIVE}) as num_triangles from rep", *WINDOWED, DYN_TRI))
def dynamic_tc(spark: Sp, d: str) -> Df:
    _, iv, points, n = _dynamic(spark, ST.signal_to_windowed(g_hop(spark, d), WINDOW))
    return R.dynamic_triangles(iv, points, PF, n).drop("k")


DYN_SYM = f"sym as (select k, u, v from rep join iv on {ALIVE} union select k, v, u from rep join iv on {ALIVE})"


@query(over("g_hop", "select endp as timestep, (select count(distinct r) from roots where roots.k = rep.k) as component_count, coalesce((select max(c) from (select count(*) as c from roots where roots.k = rep.k group by r)), 1) as max_component_size from rep", *windowed_sql(HOUR), *WINDOWED[3:], DYN_SYM, LABELS, ROOTS))
def dynamic_cc(spark: Sp, d: str) -> Df:
    _, iv, points, n = _dynamic(spark, ST.signal_to_windowed(g_hop(spark, d), HOUR))
    return R.dynamic_components(iv, points, PF, n).drop("k")


@query(over("g_hop", "select k, r as root, count(*) as size from roots group by 1, 2", *windowed_sql(HOUR), *WINDOWED[3:], DYN_SYM, LABELS, ROOTS))
def dynamic_cc_example(spark: Sp, d: str) -> Df:
    """Sizes of all components at each report."""
    _, iv, points, n = _dynamic(spark, ST.signal_to_windowed(g_hop(spark, d), HOUR))
    return R.dynamic_component_sizes(iv, points, PF, n)


ALIVE_WINDOWS = [HOUR, 86_400, 30 * 86_400]


def _alive_sql(graph: str) -> str:
    columns = ", ".join(f"(select count(*) from (select distinct src, dst from t where t.i <= r.i and t.ts + {w} > r.ts)) as w{w}" for w in ALIVE_WINDOWS)
    return over(graph, f"select label as timestep, ts as timestamp, {columns}, (select count(*) from (select distinct src, dst from t where t.i <= r.i)) as total from r", S, "t as (select step - 1 as i, src, dst, ts from s)", f"r as (select i, ts, i as label from t where i % {PF} = 0 and i > 0 union all select i, ts, i + 1 from t where i = (select max(i) from t))")


@query(_alive_sql("g_hop"))
def alive_windows(spark: Sp, d: str) -> Df:
    return R.alive_windows(ST.assign_step(g_hop(spark, d)), ALIVE_WINDOWS, PF)


@query(_alive_sql("g_trade"))
def edge_alive(spark: Sp, d: str) -> Df:
    return R.alive_windows(ST.assign_step(g_trade(spark, d)), ALIVE_WINDOWS, PF)


@query()
def edge_alive_updates(spark: Sp, d: str) -> Df:
    """With deletions; checked against a replay in the tests."""
    return R.alive_windows_updates(ST.assign_step(g_user_k(spark, d)), ALIVE_WINDOWS, PF)


@query(_alive_sql("g_hop").replace("select label as timestep", "select timestep, w3600::double / total as f3600, w86400::double / total as f86400 from (select label as timestep", 1) + ")")
def alive_fraction(spark: Sp, d: str) -> Df:
    from edgetide.functions.scalars import alive_fraction as share

    alive = R.alive_windows(ST.assign_step(g_hop(spark, d)), ALIVE_WINDOWS, PF)
    return alive.select("timestep", share(F.col("w3600"), F.col("total")).alias("f3600"), share(F.col("w86400"), F.col("total")).alias("f86400"))


TRACKED = [1, 2, 3]


@query(_append_sql("g_hop", "endp as timestep, " + ", ".join(f"(select count(*) from a where step <= endp and (u = {v} or v = {v})) as n{v}" for v in TRACKED)))
def degree_series(spark: Sp, d: str) -> Df:
    return R.degree_series(ST.assign_step(g_hop(spark, d)), TRACKED, PF)


@query()
def node_statistics(spark: Sp, d: str) -> Df:
    """Degrees of the five most updated nodes over time."""
    from edgetide.operators import aggregates as A

    steps = ST.assign_step(g_hop(spark, d))
    top = [r.v for r in A.top_k(A.node_update_counts(steps), "updates", 5).collect()]  # five rows
    return R.degree_series(steps, top, PF)


# Snapshots

PAIRS = "p as (select distinct least(src, dst) as u, greatest(src, dst) as v from e where src <> dst)"
P_SYM = "sym as (select u, v from p union all select v, u from p)"


def _pairs(log: Df) -> Df:
    return ST.canonicalize(ST.drop_self_loops(log)).select("u", "v").distinct()


@query(over("g_hop", "select v, min(h)::int as distance from walk group by 1", PAIRS, P_SYM, "walk(v, h) as (select 1::bigint, 0 union select sym.v, h + 1 from walk join sym on sym.u = walk.v where h < 12)"))
def static_bfs(spark: Sp, d: str) -> Df:
    return static.static_bfs(_pairs(g_hop(spark, d)), 1)


ONE_LAB = "lab(v, l) as (select distinct u, u from sym union select sym.v, lab.l from lab join sym on sym.u = lab.v where lab.l < sym.v)", "roots as (select v, least(v, min(l)) as r from lab group by 1)"


@query(over("g_hop", "select (m + 1 - n + c)::bigint as component_count, c as non_empty_components, x as max_component_size from (select max(greatest(src, dst)) as m from e), (select count(*) as n, count(distinct r) as c from roots), (select max(c) as x from (select count(*) as c from roots group by r))", PAIRS, P_SYM, *ONE_LAB))
def static_cc(spark: Sp, d: str) -> Df:
    log = g_hop(spark, d)
    n = log.agg(F.max(F.greatest("src", "dst"))).first()[0] + 1
    return static.static_cc(_pairs(log), n)


@query(over("g_part", "select r as root, count(*) as size from roots group by 1", PAIRS, *least_labels("select u, v from p")))
def component_sizes(spark: Sp, d: str) -> Df:
    """Of the part graph."""
    return static.component_sizes(_pairs(g_part(spark, d)))


CORE = (
    PAIRS, P_SYM,
    "core(i, v, h) as (select 0, u, count(*) from sym group by u union all (select i + 1, v, max(least(r, h)) from (select c.i, sym.u as v, c.h, row_number() over (partition by sym.u order by c.h desc) as r from core c join sym on sym.v = c.v where c.i < 40) group by 1, 2))",
    "last as (select v, h from core where i = (select max(i) from core))",
)


@query(over("g_hop", "select v, h as core from last", *CORE))
def coreness(spark: Sp, d: str) -> Df:
    return static.coreness(_pairs(g_hop(spark, d)))


@query(over("g_hop", "select (coalesce(list_sum(l), 0)::bigint // n)::bigint as avg_coreness, list_max(l) as max_coreness, l[floor(0.25 * n)::bigint + 1] as p25_coreness, l[floor(0.5 * n)::bigint + 1] as p50_coreness, l[floor(0.75 * n)::bigint + 1] as p75_coreness from (select list(coalesce(h, 0) order by coalesce(h, 0)) as l, count(*) as n from range(0, (select max(greatest(src, dst)) + 1 from e)) t(id) left join last on last.v = id)", *CORE))
def static_kcore(spark: Sp, d: str) -> Df:
    log = g_hop(spark, d)
    n = log.agg(F.max(F.greatest("src", "dst"))).first()[0] + 1
    return static.static_kcore(_pairs(log), n)


@query()
def static_schedule(spark: Sp, d: str) -> Df:
    """All snapshot metrics at two points of the hop graph."""
    return api.analyze(spark, g_hop(spark, d), print_freq=PF, static_algorithm_count=2, metrics=()).static


@query()
def orientation_statistics(spark: Sp, d: str) -> Df:
    """A replay by its nature."""
    steps = ST.assign_step(g_hop(spark, d))
    n = steps.agg(F.max(F.greatest("src", "dst"))).first()[0] + 1
    return edge_orientation(steps, n, PF)


@query(name="edge_orientation")
def edge_orientation_trade(spark: Sp, d: str) -> Df:
    """As orientation_statistics, over the trade graph."""
    steps = ST.assign_step(g_trade(spark, d))
    n = steps.agg(F.max(F.greatest("src", "dst"))).first()[0] + 1
    return edge_orientation(steps, n, PF)


@query(over("g_hop", "select case when (x.h, p.u) < (y.h, p.v) then p.u else p.v end as src, case when (x.h, p.u) < (y.h, p.v) then p.v else p.u end as dst from p join last x on x.v = p.u join last y on y.v = p.v", *CORE))
def orientation_scalable(spark: Sp, d: str) -> Df:
    return degeneracy_orientation(_pairs(g_hop(spark, d)))


WINDOWED_CC = over("g_hop", f"select endp as timestep, {SIZES.format(1)} from rep", *WINDOWED, *least_labels(f"select rep.k, u, v from rep join iv on {ALIVE}", "k"))


@query(f"select * from ({ORACLE_SQL['graph_statistics_remove']}) join ({WINDOWED_CC}) using (timestep)")
def analyze_windowed(spark: Sp, d: str) -> Df:
    """The public call, with all metrics, on windowed hops."""
    return api.analyze(spark, g_hop(spark, d), print_freq=PF, window_size=WINDOW).dynamic


@query(f"select * from ({ORACLE_SQL['graph_statistics']}) join ({ORACLE_SQL['append_cc']}) using (timestep) join ({ORACLE_SQL['append_bfs']}) using (timestep)")
def analyze_append(spark: Sp, d: str) -> Df:
    """The public call, with all metrics, on hops that stay."""
    return api.analyze(spark, g_hop(spark, d), print_freq=PF).dynamic


@query(f"select window_size::bigint as window_size, timestep, num_edges, new_edges from (select 0 as window_size, timestep, num_edges, new_edges from ({ORACLE_SQL['graph_statistics']}) union all select {WINDOW}, timestep, num_edges, new_edges from ({ORACLE_SQL['graph_statistics_remove']}))")
def sweep(spark: Sp, d: str) -> Df:
    """Runs over windows, the true order of times; the shuffled runs have no SQL and are left to the tests."""
    runs = api.sweep(spark, g_hop(spark, d), windows=(WINDOW,), print_freq=PF, metrics=())
    rows = [r.dynamic.select(F.lit(w).cast("long").alias("window_size"), "timestep", "num_edges", "new_edges") for (shuffled, w), r in runs.items() if not shuffled]
    return rows[0].unionAll(rows[1])


@query(over("g_hop", "select e.rep_k as timestep, e.run, e.value from (select endp as rep_k, 'hop' as run, (select count(*) from a where step <= endp)::double as value from rep union all select endp, 'again', (select count(*) from a where step <= endp)::double from rep) e", S, ARRIVALS, reports_sql(PF)))
def compare_runs(spark: Sp, d: str) -> Df:
    _, a, points, _ = _append(spark, g_hop(spark, d))
    stats = checkpoint(R.append_stats(a, points, PF))
    return api.compare_runs({"hop": stats, "again": stats}, "num_edges")


GRAPH_AT = 5000
AT = f"sym as (select u as v, v as w from a where step <= {GRAPH_AT} union all select v, u from a where step <= {GRAPH_AT})"


def _graph(spark: Sp, d: str) -> GraphView:
    return GraphView.at(ST.arrivals(ST.assign_step(g_hop(spark, d))), GRAPH_AT)


@query(over("g_hop", "select v, w, (v * w)::bigint as value from sym where v in (1, 2, 3)", S, ARRIVALS, AT))
def graph_map_neighbours(spark: Sp, d: str) -> Df:
    return _graph(spark, d).map_neighbours(F.col("v") * F.col("w"), [1, 2, 3])


@query(over("g_hop", "select v, count(*) filter (w > v) as count from sym group by v", S, ARRIVALS, AT))
def graph_count_neighbours(spark: Sp, d: str) -> Df:
    return _graph(spark, d).count_neighbours(F.col("w") > F.col("v"))


@query(over("g_hop", "select count(*) as num_nodes, (coalesce(sum(n), 0) // 2)::bigint as num_edges, (coalesce(sum(n), 0) // 2)::double / nullif(count(*), 0) as average_degree, coalesce(max(n), 0) as max_degree from (select v, count(*) as n from sym group by v)", S, ARRIVALS, AT))
def graph_summary(spark: Sp, d: str) -> Df:
    return _graph(spark, d).summary()


# Streams


def _stream(spark: Sp, d: str) -> Df:
    rows = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    k = F.get_json_object("props", "$.k").cast("long")
    return rows.select(F.col("user_id").alias("src"), (k + 1_000_000).alias("dst"), seconds("ts").alias("ts"))


@query(over("g_user_k", "select distinct least(src, dst) as u, greatest(src, dst) as v from e where src <> dst"))
def stream_first_arrival(spark: Sp, d: str) -> Df:
    from edgetide.streaming.incremental import first_arrival, run_to_end

    return run_to_end(first_arrival(_stream(spark, d)), "append", "u long, v long")


@query(over("g_user_k", "select src, dst, min(ts) as start, max(ts) + 86400 as end, count(*) as events from y group by src, dst, island", "x as (select src, dst, ts, case when lag(ts) over (partition by src, dst order by ts) + 86400 < ts then 1 else 0 end as cut from e)", "y as (select *, sum(cut) over (partition by src, dst order by ts) as island from x)"))
def stream_window_ttl(spark: Sp, d: str) -> Df:
    from edgetide.streaming.incremental import run_to_end, session_windows

    return run_to_end(session_windows(_stream(spark, d), 86_400), "complete", "src long, dst long, start long, end long, events long")


@query(over("g_user_k", "select src, dst, op, ts from wu", *windowed_sql(86_400)))
def stream_alive(spark: Sp, d: str) -> Df:
    from edgetide.streaming.incremental import run_to_end, ttl_updates

    return run_to_end(ttl_updates(_stream(spark, d), 86_400), "append", "src long, dst long, op int, ts long")


@query(over("g_user_k", "select 0::bigint as batch, count(*) as updates, count(distinct (src, dst)) as num_edges from e"))
def stream_batch_stats(spark: Sp, d: str) -> Df:
    from edgetide.streaming.incremental import batch_stats

    return batch_stats(_stream(spark, d))


@query("""with e as (select event_id % 4 as part, user_id::bigint as src, (user_id * 7 % 60)::bigint as dst from events), b(batch) as (values (0::bigint), (1), (2), (3))
    select batch, (select count(*) from e where part <= batch) as updates, (select count(distinct (least(src, dst), greatest(src, dst))) from e where part <= batch and src <> dst) as num_edges from b""")
def stream_batch_stats_many(spark: Sp, d: str) -> Df:
    """Four micro-batches of a graph that isn't bipartite: pairs come back in later batches, in either direction."""
    from edgetide.sources.paths import shared_path
    from edgetide.streaming.incremental import batch_stats

    folder = shared_path(spark, "stream-in")
    rows = table(spark, d, "events").select("event_id", F.col("user_id").cast("long").alias("src"), (F.col("user_id") * 7 % 60).cast("long").alias("dst"))
    for part in range(4):  # a file a batch, in the order of their times
        rows.where(F.col("event_id") % 4 == part).select("src", "dst").coalesce(1).write.mode("append").parquet(folder)
    return batch_stats(spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 1).parquet(folder))
