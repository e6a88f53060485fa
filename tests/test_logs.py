"""Log operators and reports against a replay of the log, edge by edge."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from edgetide import api
from edgetide.operators import aggregates as A
from edgetide.operators import reports as R
from edgetide.operators import static
from edgetide.operators import steps as ST
from edgetide.operators.orientation import degeneracy_orientation, edge_orientation
from edgetide.plans.running import interval_max, running

F1 = [(1, 2, 10), (2, 3, 20), (3, 1, 30), (1, 2, 40), (4, 4, 45), (2, 1, 50), (4, 5, 60), (5, 3, 70)]
F2 = [(1, 2, 0, 10), (2, 3, 0, 20), (1, 2, 1, 25), (3, 1, 0, 30), (2, 3, 1, 35), (1, 2, 0, 40), (3, 1, 1, 45), (4, 4, 0, 45), (2, 1, 0, 50), (1, 2, 1, 55), (4, 4, 1, 60), (4, 5, 0, 60), (2, 1, 1, 65), (5, 3, 0, 70)]


def signal(spark, rows=F1):
    return spark.createDataFrame(rows, "src long, dst long, ts long")


def log(seed, n=160, ids=14, deletes=False):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(ids), rnd.randrange(ids), rnd.randrange(n // 3)) for _ in range(n)]
    return [(*r, int(rnd.random() < 0.4)) for r in rows] if deletes else rows


def parts(edges):
    """Component sizes of a set of pairs."""
    near = defaultdict(set)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    seen, sizes = set(), []
    for x in near:
        if x not in seen:
            stack, size = [x], 0
            seen.add(x)
            while stack:
                y = stack.pop()
                size += 1
                for z in near[y] - seen:
                    seen.add(z)
                    stack.append(z)
            sizes.append(size)
    return sizes, near


def distances(near, src):
    out, front = {src: 0}, [src]
    while front:
        front = [z for y in front for z in near[y] if z not in out and not out.update({z: out[y] + 1})]
    return out


def replay(rows, pf, deletes=False, src=1):
    """Statistics rows of a sequential run."""
    rows = sorted(rows, key=(lambda r: (r[2], -r[3], r[0], r[1])) if deletes else (lambda r: (r[2], r[0], r[1])))
    edges, deg, top, out = set(), Counter(), 0, []
    for at in range(0, len(rows), pf):
        new = 0
        for r in rows[at : at + pf]:
            e = (min(r[0], r[1]), max(r[0], r[1]))
            if e[0] == e[1]:
                continue
            if deletes and r[3]:
                if e in edges:
                    edges.discard(e)
                    deg[e[0]] -= 1
                    deg[e[1]] -= 1
            elif e not in edges:
                edges.add(e)
                deg[e[0]] += 1
                deg[e[1]] += 1
                new += 1
                top = max(top, deg[r[0]])
        sizes, near = parts(edges)
        tri = sum(len(near[u] & near[v]) for u, v in edges) // 3
        out.append({"timestep": min(at + pf, len(rows)), "timestamp": rows[at][2], "num_nodes": len(near), "num_edges": len(edges), "max_degree": max(deg.values(), default=0) if deletes else top, "new_edges": new, "component_count": len(sizes), "max_component_size": max(sizes, default=1 if deletes else 0), "num_triangles": tri} | ({} if deletes else {"max_distance_from_src": max(distances(near, src).values())}))
    return out


def frame_rows(df, like):
    return sorted(({k: r[k] for k in like[0]} for r in df.collect()), key=lambda r: r["timestep"])


def test_hand_made_append_log(spark):
    got = api.analyze(spark, signal(spark), print_freq=4)
    rows = sorted(got.dynamic.collect(), key=lambda r: r.timestep)
    assert [(r.timestep, r.timestamp, r.num_nodes, r.num_edges, r.max_degree, r.new_edges, r.component_count, r.max_component_size, r.num_triangles, r.max_distance_from_src, r.average_degree) for r in rows] == [(4, 10, 3, 3, 2, 3, 1, 3, 1, 1, 1.0), (8, 45, 5, 5, 2, 2, 1, 5, 1, 3, 1.0)]
    assert rows[1].max_degree_true == 3
    assert {r["size"]: r["count"] for r in got.bfs_hist.collect()} == {0: 1, 1: 3, 2: 1}


def test_hand_made_diagnoses(spark):
    s = signal(spark)
    assert {r.updates: r["count"] for r in A.edge_count_hist(s).collect() if r["count"]} == {1: 6, 2: 1}
    assert tuple(A.symmetry(s).first()) == (7, 1, 1, 4, 20.0, False)
    t = A.graph_type(s).first()
    assert (t.num_sources, t.num_destinations, t.overlap, t.is_bipartite) == (5, 5, 5, False)
    alive = R.alive_windows(ST.assign_step(s), [15, 30], 3)
    assert sorted(map(tuple, alive.collect())) == [(3, 40, 2, 3, 3), (6, 60, 2, 4, 6), (8, 70, 2, 4, 7)]
    pairs = ST.canonicalize(ST.drop_self_loops(s)).select("u", "v").distinct()
    assert tuple(static.static_cc(pairs, 6).first()) == (2, 1, 5)
    assert tuple(static.static_kcore(pairs, 6).first()) == (1, 2, 1, 2, 2)


def test_hand_made_windows(spark):
    got = ST.signal_to_windowed(signal(spark), 15)
    assert sorted((r.ts, -r.op, r.src, r.dst) for r in got.collect()) == sorted((t, -o, a, b) for a, b, o, t in F2)
    res = api.analyze(spark, signal(spark), print_freq=5, window_size=15)
    rows = sorted(res.dynamic.collect(), key=lambda r: r.timestep)
    assert [(r.timestep, r.timestamp, r.num_nodes, r.num_edges, r.max_degree, r.new_edges, r.num_triangles, r.component_count, r.max_component_size) for r in rows] == [(5, 10, 2, 1, 1, 3, 0, 1, 2), (10, 40, 0, 0, 0, 1, 0, 0, 1), (14, 60, 3, 2, 2, 2, 0, 1, 3)]
    assert rows[1].average_degree is None


@pytest.mark.parametrize("seed", range(3))
def test_append_replay(spark, seed):
    rows = log(seed)
    want = replay(rows, 25)
    assert frame_rows(api.analyze(spark, signal(spark, rows), print_freq=25).dynamic, want) == want


@pytest.mark.parametrize("seed", range(3))
def test_dynamic_replay(spark, seed):
    rows = log(seed, deletes=True)
    want = replay(rows, 25, deletes=True)
    df = spark.createDataFrame(rows, "src long, dst long, ts long, op int").selectExpr("src", "dst", "ts", "cast(op as byte) op")
    assert frame_rows(api.analyze(spark, df, print_freq=25).dynamic, want) == want


def replay_alive(rows, windows, pf, deletes):
    rows = sorted(rows, key=(lambda r: (r[2], -r[3], r[0], r[1])) if deletes else (lambda r: (r[2], r[0], r[1])))
    count, due, total, out = [Counter() for _ in windows], [[] for _ in windows], set(), []
    for i, r in enumerate(rows):
        pair, ts = r[:2], r[2]
        for j, w in enumerate(windows):
            if deletes and r[3]:
                count[j][pair] = max(0, count[j][pair] - 1)
            else:
                count[j][pair] += 1
                due[j].append((ts + w, pair))
            while due[j] and due[j][0][0] <= ts:
                _, p = due[j].pop(0)
                count[j][p] = max(0, count[j][p] - 1)
        if not (deletes and r[3]):
            total.add(pair)
        if (i % pf == 0 and i > 0) or i == len(rows) - 1:
            row = [sum(v > 0 for v in c.values()) for c in count]
            if i % pf == 0 and i > 0:
                out.append((i, ts, *row, len(total)))
            if i == len(rows) - 1:
                out.append((i + 1, ts, *row, len(total)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_alive_windows_replay(spark, seed):
    rows = log(seed, ids=6)
    got = R.alive_windows(ST.assign_step(signal(spark, rows)), [3, 10, 1000], 20)
    assert sorted(map(tuple, got.collect())) == replay_alive(rows, [3, 10, 1000], 20, False)
    rows = log(seed, ids=6, deletes=True)
    df = spark.createDataFrame(rows, "src long, dst long, ts long, op int")
    got = R.alive_windows_updates(ST.assign_step(df), [3, 10, 1000], 20)
    assert sorted(map(tuple, got.collect())) == replay_alive(rows, [3, 10, 1000], 20, True)


def test_empty_log(spark):
    none = signal(spark, [])
    assert api.analyze(spark, none).dynamic.count() == 0
    assert A.num_vertices(none).first()[0] == 0 and A.graph_type(none).count() == 1
    assert ST.signal_to_windowed(none, 5).count() == 0 and R.alive_windows(ST.assign_step(none), [5], 10).count() == 0


def test_running_over_many_blocks(spark):
    df = spark.range(20_000).selectExpr("id + 1 as k", "id % 7 as a", "(id * 7919) % 10007 as b")
    rows = sorted(running(df, ("a",), ("b",)).select("k", "a", "b").collect())
    total = top = 0
    for i, (k, a, b) in enumerate(rows):
        total, top = total + i % 7, max(top, i * 7919 % 10007)
        assert (k, a, b) == (i + 1, total, top)


def test_interval_max(spark):
    rnd = random.Random(1)
    spans = [(a := rnd.randrange(1, 60), a + rnd.randrange(0, 60), rnd.randrange(100)) for _ in range(50)]
    got = {r.k: r.x for r in interval_max(spark.createDataFrame(spans, "k0 long, k1 long, x long"), spark.range(1, 130).withColumnRenamed("id", "k"), "x", 8).collect()}
    for k in range(1, 130):
        assert got.get(k) == max((x for a, b, x in spans if a <= k < b), default=None)


def test_rank_in_group_with_hot_key(spark):
    df = spark.range(5000).selectExpr("id as s", "if(id % 3 = 0, 1, id % 50) as w")
    rows = ST.rank_in_group(df, "w", "s", "d", block=100).collect()
    seen = Counter()
    for r in sorted(rows, key=lambda r: r.s):
        seen[r.w] += 1
        assert r.d == seen[r.w]


def test_coreness_and_bfs_and_components(spark):
    rows = log(5, n=220, ids=40)
    edges = {(min(a, b), max(a, b)) for a, b, _ in rows if a != b}
    df = spark.createDataFrame(sorted(edges), "u long, v long")
    sizes, near = parts(edges)
    left, core, k = {v: set(n) for v, n in near.items()}, {}, 0
    while left:
        low = [v for v in left if len(left[v]) <= k]
        if not low:
            k += 1
            continue
        for v in low:
            core[v] = k
            for u in left.pop(v):
                left.get(u, set()).discard(v)
    assert {r.v: r.core for r in static.coreness(df).collect()} == core
    assert {r.v: r.distance for r in static.static_bfs(df, 1).collect()} == distances(near, 1)
    assert sorted(r["size"] for r in static.component_sizes(df).collect()) == sorted(sizes)
    assert max(Counter(r.src for r in degeneracy_orientation(df).collect()).values()) <= max(core.values()) * 3


def test_long_path_components(spark):
    df = spark.range(3000).selectExpr("id * 7919 % 3001 as u", "(id + 1) * 7919 % 3001 as v")
    assert [r["size"] for r in static.component_sizes(df).collect()] == [3001]


def test_orientation_keeps_edges(spark):
    rows = log(3, n=300, ids=20)
    got = sorted(map(tuple, edge_orientation(ST.assign_step(signal(spark, rows)), 20, 50).collect()))
    assert [g[0] for g in got] == list(range(0, 300, 50)) and all(a[1] <= b[1] for a, b in zip(got, got[1:], strict=False)) and got[-1][2] >= 9


def test_shuffles(spark):
    base = signal(spark, log(1))
    a, b = ST.shuffle_signal(base, 5), base.agg({"ts": "max"}).first()[0]
    assert a.count() == 160 and a.agg({"ts": "max"}).first()[0] <= b
    df = spark.createDataFrame(log(1, deletes=True), "src long, dst long, ts long, op int")
    ops = defaultdict(list)
    for r in sorted(ST.shuffle_update(df, 5).collect(), key=lambda r: r.ts):
        ops[r.src, r.dst].append(r.op)
    assert all(sum(o) == len(o) // 2 for o in ops.values())


def test_sweep_and_snapshots(spark):
    res = api.sweep(spark, signal(spark), windows=(15,), print_freq=4, metrics=("tc",), static_algorithm_count=2)
    assert set(res) == {(s, w) for s in (False, True) for w in (0, 15)}
    last = max(res[False, 0].static.collect(), key=lambda r: r.timestep)
    assert (last.timestep, last.component_count, last.max_component_size, last.max_distance_from_src, last.max_coreness) == (8, 2, 5, 3, 2)


def test_max_updates_takes_rows_as_stored(spark):
    rows = api.analyze(spark, signal(spark, F1[::-1]).coalesce(1), print_freq=10, max_updates=2, metrics=()).dynamic.collect()
    assert (rows[0].timestep, rows[0].num_edges) == (2, 2)


def test_neighbours_of_a_hot_key(spark):
    df = spark.range(4000).selectExpr("id * 3 as s", "if(id % 3 = 0, 1, id % 40) as w")
    got = sorted(map(tuple, ST.with_neighbours(df, ["w"], "s", {"p": "s"}, {"n": "s"}, width=100).collect()))
    rows = sorted((r.s, r.w) for r in df.collect())
    last, want = {}, {}
    for s, w in rows:
        want[s] = [w, last.get(w), None]
        if w in last:
            want[last[w]][2] = s
        last[w] = s
    assert got == [(s, *want[s]) for s, _ in rows]


def test_rounds_that_do_not_settle_raise(spark):
    path = spark.range(12).selectExpr("id as u", "id + 1 as v", "id as step")
    for run in (lambda: static.static_bfs(path, 0, 3), lambda: static.coreness(path, 2), lambda: R.append_bfs(path, 0, 3)):
        with pytest.raises(RuntimeError, match="did not settle"):
            run()


@pytest.mark.parametrize("print_freq", [1, 3, 7, 50, 1000])
def test_components_by_blocks_of_reports(spark, print_freq):
    """Counts and largest sizes against a search of each report's graph; lives of all lengths, also to the end."""
    rnd = random.Random(print_freq)
    n = 200
    rows = []
    for _ in range(90):
        u, v = rnd.sample(range(30), 2)
        s0 = rnd.randrange(1, n + 1)
        e0 = rnd.choice([None, min(n + 1, s0 + rnd.choice([1, 2, 5, 40, 150]))])
        rows.append((min(u, v), max(u, v), s0, e0))
    rows = list({(u, v): (u, v, s, e) for u, v, s, e in rows}.values())
    iv = spark.createDataFrame(rows, "u long, v long, s0 long, e0 long")
    points = spark.createDataFrame([(k + 1, min((k + 1) * print_freq, n)) for k in range(-(-n // print_freq))], "k long, endp long")
    got = {r.timestep: (r.component_count, r.max_component_size) for r in R.dynamic_components(iv, points, print_freq, n).collect()}
    for (k, endp) in [tuple(r) for r in points.collect()]:
        edges = [(u, v) for u, v, s, e in rows if s <= endp and (e is None or e > endp)]
        groups: list[set] = []
        for u, v in edges:
            hit = [g for g in groups if u in g or v in g]
            groups = [g for g in groups if g not in hit] + [set().union({u, v}, *hit)]
        assert got[endp] == (len(groups), max(map(len, groups), default=1)), k


def test_one_search_for_series_and_histogram(spark, monkeypatch):
    """`analyze` finds the distances once."""
    from edgetide import api

    calls = []
    plain = R.append_bfs
    monkeypatch.setattr(R, "append_bfs", lambda *a, **k: calls.append(1) or plain(*a, **k))
    log = spark.createDataFrame([(1, 2, 10), (2, 3, 20), (3, 1, 30), (4, 5, 40)], "src long, dst long, ts long")
    result = api.analyze(spark, log, print_freq=2)
    assert [r.max_distance_from_src for r in result.dynamic.orderBy("timestep").collect()] == [2, 1]
    assert result.bfs_hist.count() > 0 and len(calls) == 1


def test_offsets_as_a_table(spark, monkeypatch):
    """Beyond a bound of partitions their offsets are joined; the order is the same."""
    rows = spark.range(500).selectExpr("id % 37 as src", "id % 11 as dst", "id * 7 % 101 as ts").repartition(7)
    plain = sorted(map(tuple, ST.assign_step(rows).collect()))
    monkeypatch.setattr(ST, "FEW_PARTITIONS", 0)
    made = ST.assign_step(rows)
    assert made.columns == ["src", "dst", "ts", "step"] and sorted(map(tuple, made.collect())) == plain


def test_graph_view_of_intervals(spark):
    from pyspark.sql import functions as F

    from edgetide.operators.graph import GraphView

    iv = spark.createDataFrame([(1, 2, 1, None), (2, 3, 2, 6), (1, 3, 7, None)], "u long, v long, s0 long, e0 long")
    for step, edges in ((1, {(1, 2)}), (5, {(1, 2), (2, 3)}), (6, {(1, 2)}), (9, {(1, 2), (1, 3)})):
        g = GraphView.at(iv, step)
        both = {(a, b) for e in edges for a, b in (e, e[::-1])}
        assert {tuple(r) for r in g.neighbours().collect()} == both and {tuple(r) for r in g.neighbours([2]).collect()} == {x for x in both if x[0] == 2}
        assert {r.v: r["count"] for r in g.count_neighbours(F.col("w") > 2).collect()} == {v: sum(w > 2 for a, w in both if a == v) for v, _ in both}
        assert g.summary().first().num_edges == len(edges)
    assert tuple(GraphView.at(iv, 0).summary().first()) == (0, 0, None, 0)
