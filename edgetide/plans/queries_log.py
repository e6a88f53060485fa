"""Queries on logs: predicates, joins, aggregates, windows, orders, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.functions import roads, scalars
from edgetide.operators import aggregates as A
from edgetide.operators import steps as ST
from edgetide.operators.dictionary import vertices
from edgetide.plans import pipelines as P
from edgetide.plans.catalog_tools import ARRIVALS, COLLAPSED, INTERVALS, SU, S, over, registrar, windowed_sql
from edgetide.plans.derived import SQL, g_hop, g_links, g_part, g_trade, g_user_k, seconds
from edgetide.session import table

QUERIES, ORACLE_SQL, query = registrar()
HOUR, DAY = 3600, 86_400
Sp, Df = SparkSession, DataFrame


# Predicates and projections


@query(over("g_hop", "select src, dst, ts from e where src <> dst"))
def drop_self_loops(spark: Sp, d: str) -> Df:
    return ST.drop_self_loops(g_hop(spark, d))


@query(over("g_hop", "select least(src, dst) as u, greatest(src, dst) as v, ts from e"))
def canonicalize_pair(spark: Sp, d: str) -> Df:
    return ST.canonicalize(g_hop(spark, d)).select("u", "v", "ts")


@query(over("g_user_k", "select src, dst, ts from e where op = 0"))
def filter_ops(spark: Sp, d: str) -> Df:
    return g_user_k(spark, d).where("op = 0").select("src", "dst", "ts")


@query("select event_id as row, user_id::bigint as src from events where event_id < 500")
def limit_first_n(spark: Sp, d: str) -> Df:
    """The operator's own bound: the first rows as stored."""
    return ST.limit_first_n(table(spark, d, "events").select(F.col("event_id").alias("row"), F.col("user_id").alias("src")), 500)


@query("select o_orderpriority as src, o_orderstatus as dst, count(*) as n from orders where coalesce(o_orderpriority, '') <> '' and coalesce(o_orderstatus, '') <> '' and o_orderpriority <> o_orderstatus group by 1, 2")
def drop_null_or_equal(spark: Sp, d: str) -> Df:
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("src"), F.col("o_orderstatus").alias("dst"))
    return rows.where("coalesce(src, '') <> '' and coalesce(dst, '') <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("select event_id, event_type from events where event_type not in ('error', 'view')")
def drop_bots(spark: Sp, d: str) -> Df:
    return table(spark, d, "events").select("event_id", "event_type").where(~F.col("event_type").isin("error", "view"))


@query("select title, count(*) as n from (select case when page_id % 3 = 0 then 'Talk:' || url when page_id % 3 = 1 then 'Talks ' || url else 'User talk:x' end as title from pages) where not (title like 'Talk:%' or title like 'User talk:%') group by 1")
def drop_namespace_prefix(spark: Sp, d: str) -> Df:
    titled = table(spark, d, "pages").select(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Talk:"), "url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("Talks "), "url")).otherwise("User talk:x").alias("title"))
    return titled.where(~scalars.in_namespace(F.col("title"))).groupBy("title").agg(F.count("*").alias("n"))


@query("select user_id::varchar as src, regexp_extract(props, '\"k\": *([0-9]+)', 1) as dst, epoch_us(date_trunc('minute', ts)) // 1000000 as ts from events where event_type <> 'error'")
def drop_none_str(spark: Sp, d: str) -> Df:
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("user"), F.when(F.col("event_type") == "error", "None").otherwise(F.get_json_object("props", "$.k")).alias("x1"), *(F.lit("None").alias(c) for c in ("x2", "x3", "x4")), F.date_format("ts", "yyyyMMddHHmm").alias("time"))
    return P.bluesky(rows)


@query("select o_orderkey as id, year(o_orderdate)::bigint as year from orders where o_orderkey <> 0 and o_orderstatus <> 'F'")
def drop_missing_year_id(spark: Sp, d: str) -> Df:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "F", F.year("o_orderdate").cast("long")).alias("year")).where("id is not null and id <> 0 and year is not null")


@query("select event_id, regexp_extract(props, '\"k\": *([0-9]+)', 1)::double as k from events")
def has_numeric_field(spark: Sp, d: str) -> Df:
    return table(spark, d, "events").where(scalars.has_numeric_field(F.col("props"), "k")).select("event_id", scalars.json_num(F.col("props"), "k").alias("k"))


@query("select event_type, count(*) as n from events where event_type <> 'view' group by 1")
def skip_modify(spark: Sp, d: str) -> Df:
    return table(spark, d, "events").where("event_type <> 'view'").groupBy("event_type").agg(F.count("*").alias("n"))


@query("select l_partkey as \"src\", l_suppkey as \"dst\", epoch_us(l_shipdate) // 1000000 as \"ts\" from lineitem")
def column_select(spark: Sp, d: str) -> Df:
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("SRC_ID"), F.col("l_suppkey").alias("DST_ID"), seconds("l_shipdate").alias("TIMESTAMP"))
    return P.btc(rows)


@query("""select page_id, (page_id % 5) in (0, 1, 3) as open, case page_id % 5 when 0 then 'allowed' when 1 then 'forbidden' else 'forbidden' end as foot from pages""")
def road_accessible(spark: Sp, d: str) -> Df:
    """Access levels of ways made of page numbers: a residential street, a motorway, a bare building, a railway, a footway closed to all."""
    kind = F.col("page_id") % 5
    tag = lambda k, v: F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))
    tags = F.when(kind == 0, F.array(tag("highway", "residential"))).when(kind == 1, F.array(tag("highway", "motorway"), tag("oneway", "yes"))).when(kind == 2, F.array(tag("building", "yes"))).when(kind == 3, F.array(tag("railway", "rail"))).otherwise(F.array(tag("highway", "footway"), tag("foot", "no"), tag("bicycle", "no")))
    levels = table(spark, d, "pages").select("page_id", roads.access(tags).alias("a"))
    # A footway closed to feet and wheels still had its backward bike level set from the forward one.
    return levels.select("page_id", roads.accessible(F.col("a")).alias("open"), F.col("a.foot").alias("foot"))


# Joins


@query("select l_suppkey::bigint as src, epoch_us(o_orderdate) // 1000000 as ts, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by 1, 2")
def join_block_time(spark: Sp, d: str) -> Df:
    blocks = table(spark, d, "orders").select(F.col("o_orderkey").alias("block"), F.concat(F.lit("0x"), F.hex(seconds("o_orderdate"))).alias("hex_time"))
    times = blocks.select("block", scalars.hex_to_int(F.col("hex_time")).alias("ts"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("block"), F.col("l_suppkey").alias("src")).join(times, "block").groupBy("src", "ts").agg(F.count("*").alias("n"))


@query("select l_orderkey as src, l_partkey as dst, year(o_orderdate)::bigint as ts from lineitem join orders on l_orderkey = o_orderkey")
def join_citation_year(spark: Sp, d: str) -> Df:
    papers = table(spark, d, "orders").select(F.col("o_orderkey").alias("corpusid"), F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderkey").alias("row"))
    return P.semantic_scholar(papers, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("citingcorpusid"), F.col("l_partkey").alias("citedcorpusid")))


ENDS = "ends as (select k, min(place) as place, count(*) as degree from ({}) group by 1)"
LINK_ROWS = "r as (select row_number() over (order by page, target) as row, 'p' || page as src, target as dst from e)"


def _link_rows(spark: Sp, d: str) -> Df:
    links = g_links(spark, d).select("page", "target")
    return ST.assign_step(links, ("page", "target"), "row").select("row", F.concat(F.lit("p"), F.col("page").cast("string")).alias("src"), F.col("target").alias("dst"))


def _ids_sql(place: str, start: int = 0) -> str:
    return over("g_links", f"select row_number() over (order by a, b, k) - 1 + {start} as id, k as key, degree from ends", LINK_ROWS, f"ends as (select k, min(a) as a0, min((a, b)) as ab, min((a, b))[1] as a, min((a, b))[2] as b, count(*) as degree from ({place}) group by k)")


@query(_ids_sql("select src as k, 0 as a, row as b from r union all select dst, 1, row from r"))
def ids_first_seen_concat(spark: Sp, d: str) -> Df:
    return vertices(_link_rows(spark, d), "first_seen_concat")


@query(_ids_sql("select src as k, row as a, 0 as b from r union all select dst, row, 1 from r"))
def ids_first_seen_interleaved(spark: Sp, d: str) -> Df:
    return vertices(_link_rows(spark, d), "first_seen_interleaved")


@query(over("g_hop", "select row_number() over (order by place) - 1 as id, k as key, degree from ends", S, ENDS.format("select src as k, 2 * step as place from s union all select dst, 2 * step + 1 from s")))
def ids_time_sorted(spark: Sp, d: str) -> Df:
    return vertices(ST.assign_step(g_hop(spark, d), name="row"), "first_seen_interleaved")


@query(_ids_sql("select src as k, 0 as a, 0 as b from r union all select dst, 0, 0 from r"))
def ids_sorted(spark: Sp, d: str) -> Df:
    return vertices(_link_rows(spark, d), "sorted")


@query("select k as \"key\", row_number() over (order by no, i) as id from (select l_suppkey as k, min((l_orderkey, i))[1] as no, min((l_orderkey, i))[2] as i from (select l_orderkey, l_suppkey, row_number() over (partition by l_orderkey order by l_suppkey) as i from (select distinct l_orderkey, l_suppkey from lineitem)) group by 1)")
def ids_authors_from_1(spark: Sp, d: str) -> Df:
    papers = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("no")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("authors"))
    return P.author_ids(papers)


GIT_KEYS = "select 'c' || o_custkey as key, o_orderkey as a, -1 as b from orders union all select 'p' || l_partkey, l_orderkey, row_number() over (partition by l_orderkey order by l_partkey) - 1 from (select distinct l_orderkey, l_partkey from lineitem join orders on l_orderkey = o_orderkey)"


@query(f"select key, row_number() over (order by a, b) - 1 as id from (select key, min((a, b))[1] as a, min((a, b))[2] as b from ({GIT_KEYS}) group by key)")
def ids_author_then_files(spark: Sp, d: str) -> Df:
    return P.git(_commits(spark, d))[1]


def _commits(spark: Sp, d: str) -> Df:
    files = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_set("l_partkey")), lambda x: F.concat(F.lit("p"), x.cast("string"))).alias("files"))
    orders = table(spark, d, "orders").join(files, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select(F.col("o_orderkey").alias("commit"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("author"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0130")).alias("date"), F.coalesce("files", F.array().cast("array<string>")).alias("files"))


@query(over("g_user_k", "select row_number() over (order by place) - 1 as id, k as key, degree from ends", SU, COLLAPSED, ENDS.format("select u as k, 2 * step as place from c union all select v, 2 * step + 1 from c")))
def ids_node_indexer(spark: Sp, d: str) -> Df:
    """Ids as updates are emitted."""
    kept = ST.collapse_ops(ST.assign_step(g_user_k(spark, d)))
    return vertices(kept.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("step").alias("row")), "first_seen_interleaved")


@query(over("g_links", "select a.id as src, b.id as dst, count(*) as n from r join ids a on r.src = a.key join ids b on r.dst = b.key group by 1, 2", LINK_ROWS, "ids as (select key, row_number() over (order by key) - 1 as id from (select src as key from r union select dst from r))"))
def dict_encode_join(spark: Sp, d: str) -> Df:
    from edgetide.operators.dictionary import encode

    return encode(_link_rows(spark, d), "sorted")[0].groupBy("src", "dst").agg(F.count("*").alias("n"))


def _places(spark: Sp, d: str) -> tuple[Df, Df]:
    """Suppliers as nodes with made-up places, and each order's suppliers as a path."""
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 90).cast("double").alias("lat"), (F.col("s_suppkey") % 170).cast("double").alias("lon"))
    paths = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("nodes"))
    return nodes, paths


PATHS = "p as (select l_orderkey as id, l_suppkey as node, row_number() over (partition by l_orderkey order by l_suppkey) - 1 as i, count(*) over (partition by l_orderkey) as n from (select distinct l_orderkey, l_suppkey from lineitem))"


@query("with p as (select distinct l_orderkey, l_suppkey from lineitem) select s_suppkey as id, (s_suppkey % 90)::double as lat, count(*) as n from p join supplier on l_suppkey = s_suppkey group by 1, 2")
def join_osm_nodes(spark: Sp, d: str) -> Df:
    nodes, paths = _places(spark, d)
    return paths.select(F.explode("nodes").alias("id")).join(nodes, "id").groupBy("id", "lat").agg(F.count("*").alias("n"))


HAVERSINE = "2 * 6378100.0 * atan2(sqrt(h), sqrt(1.0 - h))"


@query(f"""with {PATHS}, q as (select id, i, node % 90 as lat, node % 170 as lon, lag(node % 90) over (partition by id order by i) as lat0, lag(node % 170) over (partition by id order by i) as lon0 from p),
    t as (select id, i, sin(radians(lat - lat0) / 2) ** 2 + cos(radians(lat0)) * cos(radians(lat)) * sin(radians(lon - lon0) / 2) ** 2 as h from q)
    select id, round(sum(case when i > 0 then {HAVERSINE} else 0.0 end) / 1000)::bigint as km from t group by 1""")
def path_length(spark: Sp, d: str) -> Df:
    nodes, paths = _places(spark, d)
    return P.path_length(paths, nodes, "id").select("id", F.round(F.col("length") / 1000).cast("long").alias("km"))


@query(f"with {PATHS} select node, sum(case when i = 0 or i = n - 1 then 2 else 1 end)::bigint as uses from p group by 1 having sum(case when i = 0 or i = n - 1 then 2 else 1 end) > 1")
def node_uses(spark: Sp, d: str) -> Df:
    return A.node_uses(_places(spark, d)[1])


@query(f"""with {PATHS}, m as (select *, case when node % 3 = 0 and i > 0 and i < n - 1 then 1 else 0 end as cut from p), x as (select *, sum(cut) over (partition by id order by i) as seg from m),
    y as (select id, seg as segment, i, node from x union all select id, seg - 1, i, node from x where cut = 1)
    select id, segment::bigint as segment, string_agg(node, ',' order by i) as nodes from y group by 1, 2 having count(*) > 1""")
def segment_split(spark: Sp, d: str) -> Df:
    _, paths = _places(spark, d)
    cuts = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("node"))
    return P.segment_split(paths, cuts).select("id", F.col("segment").cast("long").alias("segment"), F.array_join(F.transform("nodes", lambda x: x.cast("string")), ",").alias("nodes"))


@query("select min(r) as least, max(r) as most, round(avg(r), 9) as mean from (select l_extendedprice / l_quantity as r from lineitem)")
def ratio_stats(spark: Sp, d: str) -> Df:
    r = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, d, "lineitem").agg(F.min(r).alias("least"), F.max(r).alias("most"), F.round(F.avg(r), 9).alias("mean"))


@query(over("g_hop", "select distinct a.src, a.dst from e a where exists (select 1 from e b where b.src = a.dst and b.dst = a.src)"))
def reverse_pair(spark: Sp, d: str) -> Df:
    return A.reverse_pairs(g_hop(spark, d))


@query(over("g_hop", "select distinct src as v from e where src in (select dst from e)"))
def overlap_src_dst(spark: Sp, d: str) -> Df:
    log = g_hop(spark, d)
    return log.select(F.col("src").alias("v")).distinct().join(log.select(F.col("dst").alias("v")), "v", "left_semi")


# Aggregates


@query(over("g_trade", "select count(*) as num_vertices from (select src from e union select dst from e)"))
def num_vertices(spark: Sp, d: str) -> Df:
    return A.num_vertices(g_trade(spark, d))


@query(over("g_trade", "select count(*) as num_unique_edges from (select distinct src, dst from e)"))
def num_unique_edges(spark: Sp, d: str) -> Df:
    return A.num_unique_edges(g_trade(spark, d))


@query(over("g_trade", "select count(*) as total_updates from e"))
def total_updates(spark: Sp, d: str) -> Df:
    return A.total_updates(g_trade(spark, d))


@query(over("g_trade", "select src as v, count(*) as degree from e group by 1"))
def out_degree(spark: Sp, d: str) -> Df:
    return A.degrees(g_trade(spark, d), "src")


@query(over("g_trade", "select max(degree) as max_in_degree, min(v) filter (degree = m) as max_in_vertex from (select *, max(degree) over () as m from (select dst as v, count(*) as degree from e group by 1))"))
def in_degree(spark: Sp, d: str) -> Df:
    return A.largest(A.degrees(g_trade(spark, d), "dst"), "in")


@query(over("g_hop", "select v, count(*) as degree from (select src as v from e union all select dst from e) group by 1"))
def total_degree(spark: Sp, d: str) -> Df:
    return A.total_degree(g_hop(spark, d))


def _type_sql(graph: str) -> str:
    return over(
        graph,
        """select ns as num_sources, nd as num_destinations, ov as overlap, nv as num_vertices, mo as max_out_degree, mi as max_in_degree, mt as max_total_degree, ue as unique_edges, ev as events, pp as parallel_pairs, mp as max_parallel,
        ov = 0 as is_bipartite, nv > 1 and mt = nv - 1 and ev = nv - 1 as is_star, nv > 1 and ms = nv - 1 and ue = nv - 1 as is_star_simple, 100.0::double * pp / ue as parallel_pct from x, y, z""",
        "r as (select v, sum(o)::bigint as o, sum(i)::bigint as i from (select src as v, 1 as o, 0 as i from e union all select dst, 0, 1 from e) group by 1)",
        "x as (select count(*) filter (o > 0) as ns, count(*) filter (i > 0) as nd, count(*) filter (o > 0 and i > 0) as ov, count(*) as nv, max(o) as mo, max(i) as mi, max(o + i) as mt from r)",
        "p as (select src, dst, count(*) as n from e group by 1, 2)",
        "y as (select count(*) as ue, sum(n)::bigint as ev, count(*) filter (n > 1) as pp, max(n) as mp from p)",
        "z as (select max(c) as ms from (select w, count(*) as c from (select src as w from p union all select dst from p where src <> dst) group by 1))",
    )


@query(_type_sql("g_trade"))
def graph_type(spark: Sp, d: str) -> Df:
    return A.graph_type(g_trade(spark, d))


@query(_type_sql("g_hop"))
def check_graph_type(spark: Sp, d: str) -> Df:
    return A.graph_type(g_hop(spark, d))


@query(over("g_part", "select src, dst, count(*) as n from e group by 1, 2 having count(*) > 1"))
def parallel_edges(spark: Sp, d: str) -> Df:
    return A.parallel_edges(g_part(spark, d))


SYMMETRY = "select (sl + 2 * bd + ow)::bigint as directed_pairs, sl as self_loops, bd as both_directions, ow as one_way, case when bd + ow = 0 then 0.0 else 100.0 * bd / (bd + ow) end::double as symmetric_pct, ow = 0 as fully_symmetric from (select count(*) filter (m = 4) as sl, count(*) filter (m = 3) as bd, count(*) filter (m in (1, 2)) as ow from (select least(src, dst), greatest(src, dst), bit_or(case when src = dst then 4 when src < dst then 1 else 2 end) as m from e group by 1, 2))"


@query(over("g_hop", SYMMETRY))
def symmetry(spark: Sp, d: str) -> Df:
    return A.symmetry(g_hop(spark, d))


@query(over("g_trade", SYMMETRY))
def check_symmetric(spark: Sp, d: str) -> Df:
    return A.symmetry(g_trade(spark, d))


@query("select file, count(distinct ts) as unique_timestamps from (select 'trade' as file, ts from (" + SQL["g_trade"] + ") union all select 'hop', ts from (" + SQL["g_hop"] + ")) group by 1")
def unique_timestamps(spark: Sp, d: str) -> Df:
    logs = g_trade(spark, d).select(F.lit("trade").alias("file"), "ts").unionAll(g_hop(spark, d).select(F.lit("hop").alias("file"), "ts"))
    return A.unique_timestamps(logs)


@query(over("g_part", "select u as updates, count(n) as count from range(0, (select greatest(9, max(n)) + 1 from p)) t(u) left join p on p.n = u group by 1", "p as (select src, dst, count(*) as n from e group by 1, 2)"))
def edge_count_hist(spark: Sp, d: str) -> Df:
    return A.edge_count_hist(g_part(spark, d))


@query(over("g_user_k", "select n as repeats, count(*) as pairs, (select count(*) from e) as updates, (select count(*) from p) as edges from p group by 1", "p as (select src, dst, count(*) as n from e group by 1, 2)"))
def update_fraction(spark: Sp, d: str) -> Df:
    return A.update_fraction(g_user_k(spark, d))


@query(over("g_user_k", "select v, count(*) as updates from (select src as v from e union all select dst from e) group by 1"))
def node_update_counts(spark: Sp, d: str) -> Df:
    return A.node_update_counts(g_user_k(spark, d))


@query("select o_orderstatus as status, count(*) as count, min(year(o_orderdate)) as min_year, max(year(o_orderdate)) as max_year from orders group by 1".replace("min(year(o_orderdate))", "min(year(o_orderdate))::int").replace("max(year(o_orderdate))", "max(year(o_orderdate))::int"))
def year_range_counts(spark: Sp, d: str) -> Df:
    return A.year_range_counts(table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year")), "status")


@query(over("g_trade", "select q as share, (list_sort(l))[floor(q * n)::bigint + 1] as degree from (select list(c) as l, count(*) as n from (select src, count(*) as c from e group by 1)), (select unnest([0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99])::double as q)"))
def degree_percentiles(spark: Sp, d: str) -> Df:
    return A.degree_percentiles(A.degrees(g_trade(spark, d), "src"))


@query(over("g_hop", "select (1::bigint << floor(log2(c))::bigint) as bucket, count(*) as count from (select src, dst, count(*) as c from e group by 1, 2) group by 1"))
def pow2_bucket_hist(spark: Sp, d: str) -> Df:
    return A.pow2_hist(g_hop(spark, d).groupBy("src", "dst").agg(F.count("*").alias("c")), "c")


# Orders and sets


@query(over("g_trade", "select row_number() over (order by ts, src, dst) as step, src, dst, ts from e"))
def assign_step(spark: Sp, d: str) -> Df:
    return ST.assign_step(g_trade(spark, d)).select("step", "src", "dst", "ts")


@query(over("g_user_k", "select row_number() over (order by ts, op desc, src, dst) as step, src, dst, ts, op from e"))
def sort_by_time(spark: Sp, d: str) -> Df:
    return ST.assign_step(g_user_k(spark, d)).select("step", "src", "dst", "ts", F.col("op").cast("int").alias("op"))


@query(over("g_part", "select ts, count(*) as n from e group by 1"))
def bucket_sort_time(spark: Sp, d: str) -> Df:
    """Rows by second: what a counting sort fills its buckets with."""
    return g_part(spark, d).groupBy("ts").agg(F.count("*").alias("n")).orderBy("ts")


TOP = "select v, n from (select v, count(*) as n from (select src as v from {0} union all select dst from {0}) group by 1) order by n desc, v desc limit 10"


@query(over("g_user_k", TOP.format("e").replace("select v, n from", "select v, n as updates from", 1)))
def topk_update(spark: Sp, d: str) -> Df:
    """The operator's own bound: the ten most updated."""
    return A.top_k(A.node_update_counts(g_user_k(spark, d)), "updates", 10)


@query(over("g_hop", "select v, count(*) as degree from (select u as v from p union all select v from p) group by 1 order by 2 desc, 1 desc limit 10", "p as (select distinct least(src, dst) as u, greatest(src, dst) as v from e where src <> dst)"))
def topk_degree(spark: Sp, d: str) -> Df:
    """The operator's own bound: the ten of highest degree."""
    pairs = ST.canonicalize(ST.drop_self_loops(g_hop(spark, d))).select(F.col("u").alias("src"), F.col("v").alias("dst")).distinct()
    return A.top_k(A.total_degree(pairs), "degree", 10)


@query()
def random_nodes(spark: Sp, d: str) -> Df:
    """A sampling operator."""
    return A.random_nodes(g_hop(spark, d), 10, 7)


@query(over("g_links", "select key, count(*) as degree from (select 'p' || page as key from e union all select target from e) group by 1"))
def mapping_by_degree(spark: Sp, d: str) -> Df:
    return vertices(_link_rows(spark, d)).select("key", "degree").orderBy(F.desc("degree"), "key")


@query()
def shuffle_signal(spark: Sp, d: str) -> Df:
    return ST.shuffle_signal(g_hop(spark, d), 7)


@query()
def shuffle_update(spark: Sp, d: str) -> Df:
    return ST.shuffle_update(g_user_k(spark, d), 7)


@query(over("g_hop", "select 10::bigint as drawn, true as inside from e limit 1"))
def random_nodes_drawn(spark: Sp, d: str) -> Df:
    """What holds of any draw, which may repeat an id: as many as asked for, from 0 to the largest id."""
    log = g_hop(spark, d)
    top = log.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return A.random_nodes(log, 10, 7).agg(F.count("*").alias("drawn"), F.bool_and(F.col("v").between(0, top)).alias("inside"))


@query(over("g_hop", "select src, dst, count(*) as n, true as inside from e group by 1, 2"))
def shuffle_signal_kept(spark: Sp, d: str) -> Df:
    """What holds of any draw: every pair keeps its rows, and all times lie between the second and the last one."""
    log = g_hop(spark, d)
    low = log.select("ts").orderBy("ts").limit(2).agg(F.max("ts")).first()[0]
    high = log.agg(F.max("ts")).first()[0]
    return ST.shuffle_signal(log, 7).groupBy("src", "dst").agg(F.count("*").alias("n"), F.bool_and(F.col("ts").between(low, high)).alias("inside"))


@query(over("g_user_k", "select least(src, dst) as src, greatest(src, dst) as dst, count(*) as n, ((count(*) + 1) // 2)::bigint as inserts from e where src <> dst group by 1, 2"))
def shuffle_update_kept(spark: Sp, d: str) -> Df:
    """What holds of any draw: every unordered pair keeps its rows, and inserts and deletes take turns from an insert on."""
    return ST.shuffle_update(g_user_k(spark, d), 7).groupBy("src", "dst").agg(F.count("*").alias("n"), F.count_if(F.col("op") == 0).alias("inserts"))


@query("select count(distinct user_id) as inputs, count(distinct user_id) as h64, true as h32_in_range from events")
def hash_spread(spark: Sp, d: str) -> Df:
    """What holds of a hash: no two of few inputs collide in 64 bits, and 32 bits are unsigned."""
    h = table(spark, d, "events").select("user_id", scalars.hash64(F.col("user_id")).alias("h64"), scalars.hash32(F.col("user_id")).alias("h32"))
    return h.agg(F.count_distinct("user_id").alias("inputs"), F.count_distinct("h64").alias("h64"), F.bool_and(F.col("h32").between(0, (1 << 32) - 1)).alias("h32_in_range"))


@query(over("g_trade", "select src as u, string_agg(dst::varchar, ',' order by dst) as neighbours from (select distinct src, dst from e) group by 1"))
def sort_adjacency(spark: Sp, d: str) -> Df:
    lists = g_trade(spark, d).groupBy(F.col("src").alias("u")).agg(F.array_sort(F.collect_set("dst")).alias("n"))
    return lists.select("u", F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("neighbours"))


@query(over("g_trade", "select src as v from e union select dst from e"))
def vertex_union(spark: Sp, d: str) -> Df:
    return A.vertex_union(g_trade(spark, d))


@query(over("g_hop", "select src as v from e intersect select dst from e"))
def vertex_intersect(spark: Sp, d: str) -> Df:
    return A.vertex_intersect(g_hop(spark, d))


@query(over("g_hop", "select distinct src, dst from e"))
def pair_dedup(spark: Sp, d: str) -> Df:
    return g_hop(spark, d).select("src", "dst").dropDuplicates(["src", "dst"])


@query(over("g_links", "select target from (select target from e where page % 2 = 0 except select target from e where page % 2 = 1)"))
def link_except(spark: Sp, d: str) -> Df:
    links = g_links(spark, d)
    return links.where("page % 2 = 0").select("target").subtract(links.where("page % 2 = 1").select("target"))


@query("select src, dst, ts from (" + SQL["g_trade"] + ") union all select src, dst, ts from (" + SQL["g_part"] + ")")
def log_concat(spark: Sp, d: str) -> Df:
    return g_trade(spark, d).unionByName(g_part(spark, d))


@query("with a as (select l_suppkey as s, count(*) as n from lineitem where l_returnflag = 'R' group by 1), b as (select l_suppkey as s, count(*) as n from lineitem where l_returnflag = 'A' group by 1) select coalesce(a.s, b.s) as s, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) as removed, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) as added from a full join b on a.s = b.s where coalesce(a.n, 0) <> coalesce(b.n, 0)")
def multiset_diff(spark: Sp, d: str) -> Df:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), "l_returnflag")
    return A.multiset_diff(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A'"), "s")


# Windows


@query(over("g_hop", "select u, v, step, src from a", S, ARRIVALS))
def first_arrival(spark: Sp, d: str) -> Df:
    return ST.arrivals(ST.assign_step(g_hop(spark, d)))


@query(over("g_user_k", "select u, v, step, op from c", SU, COLLAPSED))
def lag_collapse(spark: Sp, d: str) -> Df:
    return ST.collapse_ops(ST.assign_step(g_user_k(spark, d))).select("u", "v", "step", F.col("op").cast("int").alias("op"))


@query(over("g_user_k", "select u, v, s0, e0 from iv", SU, COLLAPSED, INTERVALS))
def op_to_interval(spark: Sp, d: str) -> Df:
    return ST.edge_intervals(ST.assign_step(g_user_k(spark, d)))


@query(over("g_hop", "select src, dst, op, ts from wu", *windowed_sql(6 * HOUR)))
def signal_to_windowed(spark: Sp, d: str) -> Df:
    return ST.signal_to_windowed(g_hop(spark, d), 6 * HOUR).withColumn("op", F.col("op").cast("int"))


@query(over("g_hop", "select src, dst, op, ts from wu", "c as (select least(src, dst) as src, greatest(src, dst) as dst, ts from e)", *windowed_sql(DAY, "c")))
def signal_to_windowed_canonical(spark: Sp, d: str) -> Df:
    return ST.signal_to_windowed(g_hop(spark, d), DAY, canonicalize_before_window=True).withColumn("op", F.col("op").cast("int"))


@query("""with r as (select o_custkey as c, o_orderkey as o, list_distinct(list(l_suppkey)) as l from orders join lineitem on l_orderkey = o_orderkey group by 1, 2), w as (select c, o, l, coalesce(lag(l) over (partition by c order by o), []) as old from r),
    d as (select c, o, unnest(list_filter(l, lambda x: not list_contains(old, x))) as s, 0 as op from w union all select c, o, unnest(list_filter(old, lambda x: not list_contains(l, x))), 1 from w) select c, o, s, op from d""")
def revision_diff(spark: Sp, d: str) -> Df:
    """A customer's orders as revisions, their suppliers as links."""
    from pyspark.sql.window import Window as W

    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o")).agg(F.collect_set("l_suppkey").alias("l"))
    both = rows.withColumn("old", F.coalesce(F.lag("l").over(W.partitionBy("c").orderBy("o")), F.array().cast("array<long>")))
    each = F.explode(F.concat(F.transform(F.array_except("l", "old"), lambda x: F.struct(x.alias("s"), F.lit(0).alias("op"))), F.transform(F.array_except("old", "l"), lambda x: F.struct(x.alias("s"), F.lit(1).alias("op")))))
    return both.select("c", "o", each.alias("e")).select("c", "o", "e.s", "e.op")


# Scalar functions


@query("select code, name, size, integer_type, op from (values (0, 'NONE', 0, true, 'INSERT'), (10, 'UINT8', 1, true, null), (11, 'UINT16', 2, true, null), (12, 'UINT32', 4, true, null), (13, 'UINT64', 8, true, null), (20, 'INT8', 1, true, null), (21, 'INT16', 2, true, null), (22, 'INT32', 4, true, null), (23, 'INT64', 8, true, null), (30, 'FLOAT32', 4, false, null), (31, 'FLOAT64', 8, false, null), (1, null, null, null, 'DELETE')) t(code, name, size, integer_type, op)")
def fmt_type(spark: Sp, d: str) -> Df:
    """Names, sizes and kinds of the type codes, and names of operations."""
    codes = spark.createDataFrame([(c,) for c in (0, 10, 11, 12, 13, 20, 21, 22, 23, 30, 31, 1)], "code int")
    c = F.col("code")
    return codes.select("code", scalars.fmt_type(c).alias("name"), scalars.type_size(c).alias("size"), scalars.is_integer_type(c).alias("integer_type"), scalars.op_name(c).alias("op"))


@query("select event_id, epoch_us(date_trunc('minute', ts)) // 1000000 as a, epoch_us(ts) // 1000000 as b, epoch_us(ts) // 1000000 - 5400 as c, epoch_us(ts) // 1000000 - epoch_us(timestamp '2018-12-31 00:00:00') // 1000000 as e from events")
def parse_times(spark: Sp, d: str) -> Df:
    """Minutes, ISO times, times with an offset, and seconds since the end of 2018."""
    rows = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyyMMddHHmm").alias("m"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("s"))
    return rows.select("event_id", scalars.parse_ymdhm(F.col("m")).alias("a"), scalars.parse_iso_z(F.concat(F.translate("s", " ", "T"), F.lit("Z"))).alias("b"), scalars.parse_git_date(F.concat("s", F.lit(" +0130"))).alias("c"), scalars.seconds_since(F.col("s")).alias("e"))


@query("select event_id, user_id::bigint as v from events")
def hex_to_int(spark: Sp, d: str) -> Df:
    return table(spark, d, "events").select("event_id", scalars.hex_to_int(F.concat(F.lit("0x"), F.hex("user_id"))).alias("v"))


@query("select doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, '\\[\\[(.*?)\\]\\]', 1), lambda x: regexp_extract(x, '^[^|#]*')), lambda x: x <> ''))), ';') as links from (select doc_id, regexp_replace(text, '([A-Z][a-z]+) ([a-z]+)', '[[\\1|x]] [[\\2#y]]', 'g') as t from documents)")
def wiki_links(spark: Sp, d: str) -> Df:
    marked = F.regexp_replace("text", "([A-Z][a-z]+) ([a-z]+)", "[[$1|x]] [[$2#y]]")
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(scalars.wiki_links(marked)), ";").alias("links"))


@query("select doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, ',', ';'), ';'), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') as parts from documents")
def split_semicolon(spark: Sp, d: str) -> Df:
    return table(spark, d, "documents").select("doc_id", F.array_join(scalars.split_semicolon(F.translate("text", ",", ";")), "|").alias("parts"))


@query("with t as (select s_suppkey, sin(radians((s_suppkey % 90) / 2.0)) ** 2 + cos(radians(s_suppkey % 90)) * sin(radians((s_suppkey % 170) / 2.0)) ** 2 as h from supplier) select s_suppkey, round(2 * 6371007.181 * atan2(sqrt(h), sqrt(1.0 - h)))::bigint as metres from t")
def haversine(spark: Sp, d: str) -> Df:
    zero = F.lit(0.0)
    return table(spark, d, "supplier").select("s_suppkey", F.round(scalars.haversine(zero, zero, F.col("s_suppkey") % 90, F.col("s_suppkey") % 170, 6371007.181)).cast("long").alias("metres"))


@query("select event_type, case when event_type in ('error') then 1 else 0 end as op, count(*) as n from events group by 1, 2")
def op_parse(spark: Sp, d: str) -> Df:
    word = F.when(F.col("event_type") == "error", " Delete ").otherwise("insert")
    return table(spark, d, "events").groupBy("event_type", scalars.op_parse(word).cast("int").alias("op")).agg(F.count("*").alias("n"))


@query("select page_id, regexp_extract(regexp_replace(url, '\\?.*$', '') || '.bin', '([^/]+?)(\\.[^./]*)?$', 1) as name from pages")
def dataset_name(spark: Sp, d: str) -> Df:
    return table(spark, d, "pages").select("page_id", scalars.dataset_name(F.concat(F.regexp_replace("url", r"\?.*$", ""), F.lit(".bin"))).alias("name"))


@query("select user_id::bigint as v, count(*)::double / nullif(count(*) filter (event_type = 'error'), 0) as avg_degree, 100.0 * count(*) filter (event_type = 'error') / count(*) as pct, make_timestamp(min(epoch_us(ts)) // 1000000 * 1000000) as first from events group by 1".replace("100.0 * count(*) filter (event_type = 'error') / count(*)", "(100.0 * count(*) filter (event_type = 'error') / count(*))::double"))
def ratios(spark: Sp, d: str) -> Df:
    """Average degrees, percentages and dates."""
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("v")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e"), F.min(seconds("ts")).alias("t"))
    return g.select("v", scalars.avg_degree(F.col("n"), F.col("e")).alias("avg_degree"), A.percent(F.col("e"), F.col("n")).alias("pct"), scalars.epoch_to_date(F.col("t")).cast("timestamp_ntz").alias("first"))


@query()
def hashes(spark: Sp, d: str) -> Df:
    """Integer hashes; theirs are this engine's own."""
    return table(spark, d, "events").select("event_id", scalars.hash64(F.col("user_id")).alias("h64"), scalars.hash32(F.col("user_id")).alias("h32"))


# Scalar functions and programs one by one

CODES = "(values (0, 0, true), (10, 1, true), (11, 2, true), (12, 4, true), (13, 8, true), (20, 1, true), (21, 2, true), (22, 4, true), (23, 8, true), (30, 4, false), (31, 8, false)) t(code, size, whole)"


def _codes(spark: Sp) -> Df:
    return spark.createDataFrame([(c,) for c in (0, 10, 11, 12, 13, 20, 21, 22, 23, 30, 31)], "code int")


@query(f"select code, size from {CODES}")
def type_size(spark: Sp, d: str) -> Df:
    return _codes(spark).select("code", scalars.type_size(F.col("code")).alias("size"))


@query(f"select code, whole from {CODES}")
def is_integer_type(spark: Sp, d: str) -> Df:
    return _codes(spark).select("code", scalars.is_integer_type(F.col("code")).alias("whole"))


@query(over("g_user_k", "select case op when 0 then 'INSERT' else 'DELETE' end as name, count(*) as n from e group by 1"))
def op_name(spark: Sp, d: str) -> Df:
    return g_user_k(spark, d).groupBy(scalars.op_name(F.col("op")).alias("name")).agg(F.count("*").alias("n"))


def _time_text(spark: Sp, d: str, pattern: str) -> Df:
    return table(spark, d, "events").select("event_id", F.date_format("ts", pattern).alias("t"))


@query("select event_id, epoch_us(date_trunc('minute', ts)) // 1000000 as s from events")
def parse_ymdhm(spark: Sp, d: str) -> Df:
    return _time_text(spark, d, "yyyyMMddHHmm").select("event_id", scalars.parse_ymdhm(F.col("t")).alias("s"))


@query("select event_id, epoch_us(ts) // 1000000 as s from events")
def parse_iso_z(spark: Sp, d: str) -> Df:
    return _time_text(spark, d, "yyyy-MM-dd'T'HH:mm:ss'Z'").select("event_id", scalars.parse_iso_z(F.col("t")).alias("s"))


@query("select event_id, epoch_us(ts) // 1000000 + 9000 as s from events")
def parse_git_date(spark: Sp, d: str) -> Df:
    return _time_text(spark, d, "yyyy-MM-dd HH:mm:ss").select("event_id", scalars.parse_git_date(F.concat("t", F.lit(" -0230"))).alias("s"))


@query("select event_id, (epoch_us(ts) - epoch_us(timestamp '2018-12-31 00:00:00')) // 1000000 as s from events")
def seconds_since(spark: Sp, d: str) -> Df:
    return _time_text(spark, d, "yyyy-MM-dd HH:mm:ss").select("event_id", scalars.seconds_since(F.col("t")).alias("s"))


@query("select event_id, make_timestamp(epoch_us(ts) // 1000000 * 1000000) as t from events")
def epoch_to_date(spark: Sp, d: str) -> Df:
    return table(spark, d, "events").select("event_id", scalars.epoch_to_date(seconds("ts")).cast("timestamp_ntz").alias("t"))


@query(over("g_hop", "select (select count(distinct (src, dst)) from e)::double / (select count(*) from (select src from e union select dst from e)) as degree"))
def avg_degree(spark: Sp, d: str) -> Df:
    log = g_hop(spark, d)
    one = A.num_unique_edges(log).crossJoin(F.broadcast(A.num_vertices(log)))  # single rows
    return one.select(scalars.avg_degree(F.col("num_unique_edges"), F.col("num_vertices")).alias("degree"))


@query(over("g_part", "select 100.0::double * count(*) filter (n > 1) / count(*) as pct from (select count(*) as n from e group by src, dst)"))
def pct(spark: Sp, d: str) -> Df:
    pairs = g_part(spark, d).groupBy("src", "dst").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("x"), F.count("*").alias("y"))
    return pairs.select(A.percent(F.col("x"), F.col("y")).alias("pct"))


@query("select event_id, regexp_extract(props, '\"k\": *([0-9]+)', 1)::double as k from events")
def json_num(spark: Sp, d: str) -> Df:
    return table(spark, d, "events").select("event_id", scalars.json_num(F.col("props"), "k").alias("k"))


@query()
def hash64(spark: Sp, d: str) -> Df:
    return table(spark, d, "events").select("event_id", scalars.hash64(F.col("user_id")).alias("h"))


@query()
def hash32(spark: Sp, d: str) -> Df:
    return table(spark, d, "events").select("event_id", scalars.hash32(F.col("user_id")).alias("h"))


def _levels(spark: Sp, d: str, *keys: str) -> Df:
    tag = lambda k, v: F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))
    tags = F.when(F.col("page_id") % 2 == 0, F.array(tag("highway", "secondary"), tag("cycleway", "opposite_lane"))).otherwise(F.array(tag("highway", "trunk"), tag("junction", "roundabout"), tag("busway", "lane")))
    return table(spark, d, "pages").select("page_id", roads.access(tags).alias("a")).select("page_id", *(F.col(f"a.{k}").alias(k) for k in keys))


@query("select page_id, case page_id % 2 when 0 then 'secondary' else 'trunk' end as car_forward, case page_id % 2 when 0 then 'allowed' else 'busway' end as bike_forward, case page_id % 2 when 0 then 'lane' else 'forbidden' end as bike_backward from pages")
def tag_rules(spark: Sp, d: str) -> Df:
    return _levels(spark, d, "car_forward", "bike_forward", "bike_backward")


@query("select page_id, case page_id % 2 when 0 then 'secondary' else 'forbidden' end as car_backward, 'forbidden' as train from pages")
def normalize(spark: Sp, d: str) -> Df:
    """Levels that no tag names: the backward one follows the forward one, others are forbidden."""
    return _levels(spark, d, "car_backward", "train")


@query(over("g_trade", "select u as updates, count(n) as count from range(0, (select greatest(9, max(n)) + 1 from p)) t(u) left join p on p.n = u group by 1", "p as (select src, dst, count(*) as n from e group by 1, 2)"))
def edge_statistics(spark: Sp, d: str) -> Df:
    return A.edge_count_hist(g_trade(spark, d))


@query("select 'part' as file, count(distinct ts) as unique_timestamps from (" + SQL["g_part"] + ") union all select 'user', count(distinct ts) from (" + SQL["g_user_k"] + ")")
def count_timestamps(spark: Sp, d: str) -> Df:
    return A.unique_timestamps(g_part(spark, d).select(F.lit("part").alias("file"), "ts").unionAll(g_user_k(spark, d).select(F.lit("user").alias("file"), "ts")))
