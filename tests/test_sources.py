"""Formats, dictionaries, generators, scalar functions, pipelines and streams."""

from __future__ import annotations

import random
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from edgetide import api
from edgetide.functions import roads, scalars
from edgetide.model import CODES, Header
from edgetide.operators.dictionary import encode, vertices
from edgetide.plans import pipelines as P
from edgetide.sources import generators, packed, raw, text
from edgetide.streaming import incremental as inc

ROWS = [(0, 1, 100, 1.5, 0), (1, 2, 200, 2.0, 0), (2, 3, 300, 3.0, 0), (0, 3, 250, 0.0, 1)]


@pytest.mark.parametrize("vid,ts,weight,signal", [("uint8", "uint16", "none", True), ("uint16", "uint32", "float64", False), ("uint32", "none", "uint32", True), ("uint64", "int64", "float32", False), ("uint32", "float32", "int8", False)])
def test_packed_round_trip(spark, tmp_path, vid, ts, weight, signal):
    df = spark.createDataFrame(ROWS, "src long, dst long, ts long, weight double, op int")
    path = str(tmp_path / "log.bin")
    head = packed.write_bin(df.drop("op") if signal else df, path, vertex_id_type=vid, timestamp_type=ts, weight_type=weight, order=["ts", "src"])
    assert api.read_header(spark, path)["vertex_id_type"] == vid and (head.num_vertices, head.num_unique_edges, head.total_updates) == (4, 4, 4)
    assert (tmp_path / "log.bin").stat().st_size == 32 + 4 * head.row_bytes
    got = sorted(map(tuple, packed.read_bin(spark, path).collect()))
    want = []
    for i, (a, b, t, w, o) in enumerate(sorted(ROWS, key=lambda r: r[2])):
        w = 1.0 if weight == "none" else float(int(w)) if "int" in weight else w
        want.append((i, a, b, i if ts == "none" else t, w, 0 if signal else o))
    assert got == want


def test_packed_layout_and_insert_code(spark, tmp_path):
    path = tmp_path / "hand.bin"
    head = Header(3, 2, 2, False, CODES["uint32"], CODES["uint16"], True, CODES["none"])
    path.write_bytes(head.pack() + struct.pack("<IIHB", 7, 8, 5, 1) + struct.pack("<IIHB", 8, 9, 6, 0))
    assert [r.op for r in packed.read_bin(spark, str(path)).orderBy("row").collect()] == [1, 0]
    assert [r.op for r in packed.read_bin(spark, str(path), insert_code=1).orderBy("row").collect()] == [0, 1]
    (tmp_path / "short").write_bytes(b"x" * 31)
    with pytest.raises(ValueError, match="32 bytes"):
        api.read_header(spark, str(tmp_path / "short"))
    with pytest.raises(Exception, match="exceeds"):
        packed.write_bin(spark.createDataFrame([(1, 300, 0)], "src long, dst long, ts long"), str(tmp_path / "big.bin"), vertex_id_type="uint8")
    (tmp_path / "odd").write_bytes(b"x" * 13)
    with pytest.raises(ValueError):
        packed.read_legacy(spark, str(tmp_path / "odd"), "legacy12")


def test_empty_packed(spark, tmp_path):
    path = str(tmp_path / "none.bin")
    packed.write_bin(spark.createDataFrame([], "src long, dst long, ts long"), path)
    assert packed.read_bin(spark, path).count() == 0


def test_convert(spark, tmp_path):
    (tmp_path / "s.txt").write_text("src dst timestamp\nalice bob 1\nbob carol 2\nalice carol 3\n")
    out = str(tmp_path / "s.bin")
    head = api.convert(spark, str(tmp_path / "s.txt"), out, signal=True)
    assert (head["num_vertices"], head["num_unique_edges"], head["total_updates"], head["signal"]) == (3, 3, 3, True)
    assert [(r.src, r.dst, r.ts) for r in packed.read_bin(spark, out).orderBy("row").collect()] == [(0, 1, 1), (1, 2, 2), (0, 2, 3)]
    df = spark.createDataFrame([(0, 1, 100, 1.5, "insert"), (0, 1, 400, 0.0, "DEL")], "src long, dst long, timestamp long, weight double, info string")
    api.convert(spark, df, str(tmp_path / "u.bin"), weight_type="float64")
    assert [r.op for r in packed.read_bin(spark, str(tmp_path / "u.bin")).orderBy("row").collect()] == [0, 1]
    with pytest.raises(ValueError, match="no column"):
        api.convert(spark, df.drop("weight"), str(tmp_path / "x.bin"), weight_type="float64")


def test_text_formats(spark, tmp_path):
    (tmp_path / "e").write_text("1 2 3\n\n 4\t5 6\n")
    assert sorted(map(tuple, text.read_graph(spark, str(tmp_path / "e")).collect())) == [(1, 2, 3), (4, 5, 6)]
    (tmp_path / "h.csv").write_text("src,dst,timestamp\na,b,1\n")
    assert tuple(text.read_csv(spark, str(tmp_path / "h.csv"), ",").first()) == ("a", "b", "1")
    (tmp_path / "n.csv").write_text("1,2,3\n4,5,6\n")
    assert text.read_csv(spark, str(tmp_path / "n.csv"), ",").columns[:3] == ["src", "dst", "timestamp"]
    (tmp_path / "adj").write_text("AdjacencyGraph\n3\n3\n0\n2\n2\n1\n2\n0\n")
    assert sorted((r.src, r.dst) for r in text.read_adj(spark, str(tmp_path / "adj")).collect()) == [(0, 1), (0, 2), (2, 0)]
    (tmp_path / "bad").write_text("AdjacencyGraph\n3\n3\n0\n")
    with pytest.raises(ValueError):
        text.read_adj(spark, str(tmp_path / "bad"))
    (tmp_path / "u.csv").write_text("3,2,3\n1,2,5,insert\n1,2,6,modify\n1,2,7,delete,2.5\n")
    head, log = text.read_updates_csv(spark, str(tmp_path / "u.csv"))
    assert head["num_vertices"] == 3 and [(r.ts, r.op) for r in log.orderBy("ts").collect()] == [(5, 0), (7, 1)]
    (tmp_path / "w.csv").write_text("3,2,3\n1,2,5,remove\n")
    with pytest.raises(Exception, match="unknown operation"):
        text.read_updates_csv(spark, str(tmp_path / "w.csv"))[1].collect()
    with pytest.raises(ValueError):
        text.read_graph(spark, "x", "nothing")


def test_dictionaries(spark):
    df = spark.createDataFrame([("c", "a", 0), ("b", "c", 1)], "src string, dst string, row long")
    ids = lambda rule: {r.key: r.id for r in vertices(df, rule).collect()}
    assert ids("first_seen_concat") == {"c": 0, "b": 1, "a": 2}
    assert ids("first_seen_interleaved") == {"c": 0, "a": 1, "b": 2}
    assert ids("sorted") == {"a": 0, "b": 1, "c": 2}
    log, known = encode(df, "sorted")
    assert sorted(map(tuple, log.collect())) == [(1, 2, 1), (2, 0, 0)] and {r.key: r.degree for r in known.collect()}["c"] == 2
    with pytest.raises(ValueError):
        vertices(df, "other")


def test_generators_are_repeatable(spark):
    for make in (lambda: generators.gen_rmat(spark, 64, 500, seed=3), lambda: generators.gen_er(spark, 50, 0.2, seed=3), lambda: generators.gen_ws(spark, 50, 4, 0.3, seed=3)):
        a = sorted(map(tuple, make().collect()))
        assert a == sorted(map(tuple, make().repartition(3).collect())) and a
    assert generators.gen_er(spark, 10, 1.0).count() == 100 and generators.gen_er(spark, 10, 0.0).count() == 0


def one(spark, expr, schema, value):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first().r


def test_scalars(spark):
    f = lambda e, v, kind="string": one(spark, e(F.col("x")), f"x {kind}", v)
    assert f(scalars.parse_ymdhm, "202401020304") == 1704164640 and f(scalars.parse_ymdhm, "bad") is None
    assert f(scalars.parse_iso_z, "2024-01-02T03:04:05Z") == 1704164645
    assert f(scalars.parse_git_date, "2024-01-02 03:04:05 -0130") == 1704164645 + 5400
    assert f(scalars.wiki_links, "x [[A|b]] [[A#c]] [[#d]] [[B]] [[br\noken]]") == ["A", "B"]
    assert f(scalars.hex_to_int, "0x5f5e100") == 100_000_000
    assert [f(scalars.op_parse, v) for v in ("1", "Delete", "del", "insert", "0")] == [1, 1, 1, 0, 0]
    assert f(scalars.dataset_name, "/a/b/c.d.bin") == "c.d" and f(scalars.in_namespace, "Talk:x") and not f(scalars.in_namespace, "Talks: x")
    assert f(lambda c: scalars.json_num(c, "a"), '{"a": 3}') == 3.0 and f(lambda c: scalars.json_num(c, "a"), '{"a": "z"}') is None


def test_road_rules(spark):
    kind = "x array<struct<key:string,value:string>>"
    a = lambda *tags: one(spark, roads.access(F.col("x")), kind, list(tags))
    ok = lambda *tags: one(spark, roads.accessible(roads.access(F.col("x"))), kind, list(tags))
    assert a(("highway", "residential"), ("oneway", "yes"))["car_backward"] == "forbidden"
    assert a(("foot", "no"), ("highway", "primary"))["foot"] == "allowed" and a(("highway", "primary"), ("foot", "no"))["foot"] == "forbidden"
    assert not ok(("building", "yes")) and ok(("railway", "rail")) and not ok()
    assert a(("cycleway", "opposite"))["bike_backward"] == "allowed" and a(("cycleway", "other"))["bike_forward"] == "lane"


def test_history_and_merge(spark):
    t = {"highway": "residential"}
    ways = spark.createDataFrame([(1, 1, 10, True, [1, 2, 3], t), (1, 2, 20, True, [1, 2], t), (2, 1, 15, True, [2, 1], t), (1, 3, 30, False, [1, 2], t), (2, 2, 40, True, [2, 1], {"building": "yes"})], "id long, version long, timestamp long, visible boolean, nodes array<long>, tags map<string,string>")
    cuts = spark.createDataFrame([(2,)], "node long")
    assert sorted(map(tuple, P.history(ways, cuts).collect())) == [(1, 2, 10, 0), (1, 2, 40, 1), (2, 3, 10, 0), (2, 3, 20, 1)]
    edges = spark.createDataFrame([(i, i + 1, "a" if i < 5 else "b", 1.0) for i in range(8)], "u long, v long, props string, length double")
    uses = spark.createDataFrame([(i, 4) for i in range(1, 8)] + [(0, 2), (8, 2)], "node long, uses int")
    got = sorted((min(r.u, r.v), max(r.u, r.v), r.props, r.length) for r in P.merge_intersections(edges, uses).collect())
    assert got == [(0, 5, "a", 5.0), (5, 8, "b", 3.0)]


def test_merge_of_an_ascending_chain(spark):
    n = 300
    edges = spark.range(n).selectExpr("id as u", "id + 1 as v", "'a' as props", "1D as length")
    uses = spark.range(1, n).selectExpr("id as node", "4 as uses")
    assert [(min(r.u, r.v), max(r.u, r.v), r.length) for r in P.merge_intersections(edges, uses).collect()] == [(0, n, float(n))]


def test_paper_pipelines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("#index10\n#* One\n#@A;B;C\n#t2001\n#%11\n#index11\n#* Two\n#@B\n#t1890\n")
    logs = P.aminer(raw.read_tagged_text(spark, str(tmp_path / "a.txt")))
    assert sorted(map(tuple, logs["coauthor"].collect())) == [(1, 2, 2001), (1, 3, 2001), (2, 3, 2001)]
    assert sorted(map(tuple, logs["reference"].collect())) == [(10, 11, 2001)] and logs["articles"].count() == 2 and logs["authors"].count() == 3
    (tmp_path / "o.json").write_text('{"id":"p","year":2000,"venue_id":"v","authors":[{"id":"a","org_id":"o"},{"id":"","org_id":"x"},{"id":"b"}],"references":["q",""]}\n{"id":"","year":2000}\n{"id":"z","year":0}\n')
    logs = P.oag(raw.read_jsonl(spark, str(tmp_path / "o.json"), raw.PAPER))
    assert {k: sorted(map(tuple, v.collect())) for k, v in logs.items() if k != "counts"} == {"coauthor": [("a", "b", 2000)], "reference": [("p", "q", 2000)], "publication": [("p", "a", 2000), ("p", "b", 2000)], "venue": [("p", "v", 2000)], "organisation": [("a", "o", 2000)]}
    papers = spark.createDataFrame([(1, 2000, 0), (1, 2001, 1)], "corpusid long, year long, row long")
    cites = spark.createDataFrame([(1, 5), (2, 6), (1, None)], "citingcorpusid long, citedcorpusid long")
    assert list(map(tuple, P.semantic_scholar(papers, cites).collect())) == [(1, 5, 2001)]


def test_git_and_wiki_pipelines(spark, tmp_path):
    (tmp_path / "log").write_text("h1|Ann|2024-01-02 03:04:05 +0000\na.c\nb.c\n\nh2|Bob|2024-01-03 03:04:05 +0000\n\nh3|Ann|2024-01-04 03:04:05 +0000\nb.c\nd.c\n")
    log, ids = P.git(raw.read_gitlog(spark, str(tmp_path / "log")))
    assert {r.key: r.id for r in ids.collect()} == {"Ann": 0, "a.c": 1, "b.c": 2, "Bob": 3, "d.c": 4}
    assert sorted(map(tuple, log.collect())) == [(0, 1, 1704164645), (0, 2, 1704164645), (0, 2, 1704337445), (0, 4, 1704337445)]
    page = "<m><page><title>T</title><revision><timestamp>2024-01-01T00:00:00Z</timestamp><text>[[A]] [[Talk:B]]</text></revision><revision><timestamp>2024-01-02T00:00:00Z</timestamp><text>[[C]]</text></revision></page></m>"
    (tmp_path / "w.xml").write_text(page)
    got = P.wikipedia(raw.read_xml(spark, str(tmp_path / "w.xml"), "page", raw.WIKI_PAGE))
    assert sorted((r.target, r.op, r.ts) for r in got.collect()) == [("A", 0, 1704067200), ("A", 1, 1704153600), ("C", 0, 1704153600)]


def test_streams_over_several_files(spark, tmp_path):
    for i, rows in enumerate([[(1, 2, 10), (2, 1, 11), (1, 2, 30)], [(3, 4, 40), (1, 2, 100)]]):
        spark.createDataFrame(rows, "src long, dst long, ts long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("src long, dst long, ts long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert inc.run_to_end(inc.first_arrival(stream()), "append", "u long, v long").count() == 2
    stats = inc.batch_stats(stream()).orderBy("batch").collect()
    assert (stats[-1].updates, stats[-1].num_edges) == (5, 2)
    spans = inc.run_to_end(inc.session_windows(stream(), 20, "1000 seconds"), "complete", "src long, dst long, start long, end long, events long")
    assert sorted(map(tuple, spans.where("src = 1").collect())) == [(1, 2, 10, 50, 2), (1, 2, 100, 120, 1)]


def test_haversine(spark):
    r = spark.range(1).select(scalars.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("r")).first().r
    assert abs(r - 3.141592653589793 * 6_378_100) < 1


def test_packed_stretches_are_whole(spark, tmp_path):
    """Many partitions write one file; nothing else stays in its folder, and a broken row leaves no file."""
    from edgetide.sources.packed import read_bin, write_bin

    rows = [(i % 17, (i * 7) % 23, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "src long, dst long, ts long").repartition(13)
    path = f"{tmp_path}/log.bin"
    head = write_bin(df, path, signal=True)
    assert (head.total_updates, head.num_vertices, head.num_unique_edges) == (5000, 23, len({r[:2] for r in rows}))
    assert [tuple(r) for r in read_bin(spark, path).orderBy("row").select("src", "dst", "ts").collect()] == sorted(rows, key=lambda r: (r[2], r[0], r[1]))
    assert [p.name for p in tmp_path.iterdir()] == ["log.bin"]
    broken = df.unionAll(spark.createDataFrame([(1 << 40, 0, 1)], df.schema))
    with pytest.raises(Exception, match="exceeds the range"):
        write_bin(broken, f"{tmp_path}/other.bin", signal=True)
    assert [p.name for p in tmp_path.iterdir()] == ["log.bin"]


def great_circle(a, b, radius):
    import math

    (x, y), (p, q) = a, b
    h = math.sin(math.radians(p - x) / 2) ** 2 + math.cos(math.radians(x)) * math.cos(math.radians(p)) * math.sin(math.radians(q - y) / 2) ** 2
    return 2 * radius * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_weighted_history(spark):
    """An insertion weighs its path's length, a deletion nothing; a path over an unknown node is left out."""
    t = {"highway": "residential"}
    at = {1: (0.0, 0.0), 2: (0.0, 1.0), 3: (1.0, 1.0), 4: (2.0, 1.0)}
    nodes = spark.createDataFrame([(i, *p) for i, p in at.items()], "id long, lat double, lon double")
    ways = spark.createDataFrame([(1, 1, 10, True, [1, 2, 3], t), (1, 2, 20, True, [1, 3], t), (2, 1, 15, True, [3, 9, 4], t), (2, 2, 30, True, [3, 4], t)], "id long, version long, timestamp long, visible boolean, nodes array<long>, tags map<string,string>")
    cuts = spark.createDataFrame([(1,), (3,), (4,)], "node long")
    got = sorted((r.u, r.v, r.ts, r.op, round(r.weight, 3)) for r in P.history(ways, cuts, nodes).collect())
    d = lambda *ids: round(sum(great_circle(at[a], at[b], 6_378_100.0) for a, b in zip(ids, ids[1:], strict=False)), 3)
    # The pair (1, 3) keeps its one user when its way is drawn anew.
    assert got == [(1, 3, 10, 0, d(1, 2, 3)), (3, 4, 30, 0, d(3, 4))]
    assert [(r.op, r.weight) for r in P.history(ways.withColumn("visible", F.expr("not (id = 1 and version = 2)")), cuts, nodes).where("v = 3").orderBy("ts").collect()] == [(0, pytest.approx(d(1, 2, 3), abs=1e-2)), (1, 0.0)]


@pytest.mark.parametrize("merge", [False, True])
def test_crossings_and_numbered_history(spark, merge):
    """Two ways that meet at their ends are one road when merged; vertices are numbered as they appear."""
    t, u = {"highway": "residential"}, {"highway": "motorway"}
    ways = spark.createDataFrame([(1, 1, 10, True, [7, 8, 9], t), (2, 1, 20, True, [9, 5], t), (3, 1, 30, True, [5, 4], u), (4, 1, 40, False, [4, 3], t)], "id long, version long, timestamp long, visible boolean, nodes array<long>, tags map<string,string>")
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in range(1, 10)], "id long, lat double, lon double")
    cuts = {r.node for r in P.crossings(ways, merge).collect()}
    assert cuts == ({7, 5, 4} if merge else {7, 9, 5, 4})
    log, ids = P.osm_history(nodes, ways, weighted=True, merge=merge)
    assert {r.key: r.id for r in ids.collect()} == {7: 0, 9: 1, 5: 2, 4: 3}
    assert [(r.src, r.dst, r.ts, r.op) for r in log.orderBy("ts").collect()] == [(0, 1, 10, 0), (2, 1, 20, 0), (3, 2, 30, 0)]
    assert all(r.weight > 100_000 for r in log.collect())


def test_static_roads(spark, tmp_path):
    """Points and weighted adjacency as files; an edge to an unknown node is an error."""
    nodes = spark.createDataFrame([(30, 1.0, 0.0), (10, 0.0, 0.0), (20, 0.5, 0.5)], "id long, lon double, lat double")
    edges = spark.createDataFrame([(30, 10, 2e5), (10, 20, 1e5), (10, 30, 1.5e5)], "source long, target long, length double")
    points, pairs, ratios = P.osm_static(nodes, edges)
    assert sorted(map(tuple, pairs.collect())) == [(0, 1, 1e5), (0, 2, 1.5e5), (2, 0, 2e5)]
    text.write_points(points, f"{tmp_path}/coords")
    lines = lambda folder: [x for p in sorted((tmp_path / folder).glob("part*")) for x in p.read_text().split("\n") if x]
    assert lines("coords") == ["pbbs_sequencePoint2d", "0.0 0.0", "0.5 0.5", "1.0 0.0"]
    text.write_weighted_adj(pairs, f"{tmp_path}/graph", 3)
    assert lines("graph") == ["WeightedAdjacencyGraph", "3", "3", "0", "2", "2", "1", "2", "0", "100000.0", "150000.0", "200000.0"]
    straight = great_circle((0.0, 0.0), (0.0, 1.0), 6_371_007.181)
    assert ratios.first().most == pytest.approx(max(straight / 1.5e5, great_circle((0.0, 0.0), (0.5, 0.5), 6_371_007.181) / 1e5))
    with pytest.raises(Exception, match="no place"):
        P.osm_static(nodes, edges.unionAll(spark.createDataFrame([(10, 99, 1.0)], edges.schema)))[1].collect()


def test_packed_json_lines(spark, tmp_path):
    """The same lines as gz, bz2, zst and xz, alone and together; broken lines give nulls, empty ones nothing."""
    import bz2
    import gzip
    import lzma

    import zstandard

    lines = "".join(f'{{"author":"a{i}","subreddit":"r{i % 3}","created_utc":{i}}}\n' for i in range(25_000)).encode()
    want = {(f"a{i}", f"r{i % 3}", i) for i in range(25_000)}
    paths = []
    for name, pack in (("gz", gzip.compress), ("bz2", bz2.compress), ("zst", zstandard.compress), ("xz", lzma.compress)):
        paths.append(f"{tmp_path}/c.json.{name}")
        (tmp_path / f"c.json.{name}").write_bytes(pack(lines))
        assert {tuple(r) for r in raw.read_jsonl(spark, paths[-1], raw.COMMENT).collect()} == want
    assert raw.read_jsonl(spark, paths, raw.COMMENT).count() == 100_000
    (tmp_path / "odd.json.xz").write_bytes(lzma.compress(b'{"author":"x"}\r\n\nbroken\n{"author":"y"}'))
    assert [r.author for r in raw.read_jsonl(spark, f"{tmp_path}/odd.json.xz", raw.COMMENT).collect()] == ["x", None, "y"]


def test_late_rows(spark, tmp_path):
    """A row that is older than the watermark when it comes changes no closed span; one within the delay does."""
    schema = "src long, dst long, ts long"
    # The watermark that makes a row late is the one that the batch before began with.
    batches = [[(1, 2, 100), (3, 4, 100)], [(1, 2, 10_000)], [(7, 8, 10_000)], [(1, 2, 105), (3, 4, 9_950)], [(5, 6, 30_000)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = inc.run_to_end(inc.session_windows(stream, 50, "100 seconds"), "append", "src long, dst long, start long, end long, events long")
    # 105 comes when spans before 9,900 are closed; 9,950 is late by less than the delay.
    assert sorted(map(tuple, got.collect())) == [(1, 2, 100, 150, 1), (1, 2, 10_000, 10_050, 1), (3, 4, 100, 150, 1), (3, 4, 9_950, 10_000, 1), (7, 8, 10_000, 10_050, 1)]


def test_ttl_updates_over_batches(spark, tmp_path):
    """As a replay by pair, null ends included; the state is a row a bucket, not a row a pair."""
    schema, window, rng = "src long, dst long, ts long", 20, random.Random(4)
    rows = [(rng.choice([None, *range(90)]), rng.choice([None, 5, 6]), rng.randint(100, 400)) for _ in range(2500)]
    rows = sorted(rows, key=lambda r: r[2]) + [(i, -i, 400) for i in range(10, 5_010)] + [(0, 0, 411)]
    for i in range(0, len(rows), 1000):
        spark.createDataFrame(rows[i : i + 1000], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = []
    query = inc.ttl_updates(stream, window, "10 seconds").writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(lambda b, _: got.extend(map(tuple, b.collect()))).start()
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    want, last = [], {}
    for src, dst, t in rows:
        before = last.get((src, dst))
        if before is not None and before + window < t:
            want.append((src, dst, 1, before + window))
        if before is None or before + window < t:
            want.append((src, dst, 0, t))
        last[src, dst] = t
    want += [(*pair, 1, t + window) for pair, t in last.items() if t + window < 411 - 10]
    assert Counter(got) - Counter(want) == Counter(want) - Counter(got) == Counter()
    assert 0 < max(states) <= 4096
