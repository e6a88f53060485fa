"""Queries of sources, sinks, generators and dataset pipelines: each writes what the driver tables give and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide import api
from edgetide.operators import steps as ST
from edgetide.operators.dictionary import vertices
from edgetide.plans import pipelines as P
from edgetide.plans.catalog_tools import over, registrar
from edgetide.plans.derived import SQL, g_hop, g_links, g_part, g_trade, g_user_k, seconds
from edgetide.session import checkpoint, table
from edgetide.sources import generators, packed, raw, text
from edgetide.sources.paths import shared_path

QUERIES, ORACLE_SQL, query = registrar()
Sp, Df = SparkSession, DataFrame
LOG = "select src, dst, ts, count(*) as n from e group by 1, 2, 3"


def counted(log: Df) -> Df:
    return log.groupBy("src", "dst", "ts").agg(F.count("*").alias("n"))


def _packed(spark: Sp, log: Df, **types) -> str:  # noqa: ANN003
    path = shared_path(spark, "log") + ".bin"
    packed.write_bin(checkpoint(log), path, **types)
    return path


# The packed format

HEADER = "select (select count(*) from (select src from e union select dst from e)) as num_vertices, (select count(*) from (select distinct src, dst from e)) as num_unique_edges, (select count(*) from e) as total_updates, true as signal, 'uint32' as vertex_id_type, 'uint32' as timestamp_type, true as directed, 'none' as weight_type"


@query(over("g_trade", HEADER))
def src_header(spark: Sp, d: str) -> Df:
    head = api.read_header(spark, _packed(spark, g_trade(spark, d)))
    return spark.createDataFrame([head], "num_vertices long, num_unique_edges long, total_updates long, signal boolean, vertex_id_type string, timestamp_type string, directed boolean, weight_type string")


@query(over("g_trade", HEADER))
def summary(spark: Sp, d: str) -> Df:
    return src_header(spark, d)


@query(over("g_trade", LOG))
def src_bin(spark: Sp, d: str) -> Df:
    return counted(packed.read_bin(spark, _packed(spark, g_trade(spark, d))))


@query(over("g_user_k", "select row_number() over (order by ts, src, dst) - 1 as row, ts from e"))
def src_bin_col(spark: Sp, d: str) -> Df:
    """One column of a log with 64-bit ids, decoded alone; rows keep their order."""
    return packed.read_bin(spark, _packed(spark, g_user_k(spark, d), vertex_id_type="uint64", timestamp_type="int64"), columns=["row", "ts"])


@query(over("g_user_k", "select src, dst, ts, op, count(*) as n from e group by 1, 2, 3, 4"))
def snk_bin(spark: Sp, d: str) -> Df:
    log = packed.read_bin(spark, _packed(spark, g_user_k(spark, d).withColumn("weight", F.lit(2.5)), weight_type="float64"))
    return log.where("weight = 2.5").groupBy("src", "dst", "ts", F.col("op").cast("int").alias("op")).agg(F.count("*").alias("n"))


@query(over("g_hop", "select row_number() over (order by ts, src, dst) - 1 as row, src, dst, ts from e"))
def print_rows(spark: Sp, d: str) -> Df:
    return packed.read_bin(spark, _packed(spark, g_hop(spark, d)), columns=["row", "src", "dst", "ts"])


def _legacy(spark: Sp, log: Df, layout: str) -> Df:
    path = shared_path(spark, layout)
    packed.write_legacy(checkpoint(log), path, layout, ["ts", "src", "dst"])
    return packed.read_legacy(spark, path, layout)


@query(over("g_part", LOG))
def src_legacy12(spark: Sp, d: str) -> Df:
    return counted(_legacy(spark, g_part(spark, d), "legacy12"))


@query(over("g_user_k", "select src, dst, ts, op, count(*) as n from e group by 1, 2, 3, 4"))
def src_legacy16(spark: Sp, d: str) -> Df:
    return _legacy(spark, g_user_k(spark, d), "legacy16").groupBy("src", "dst", "ts", F.col("op").cast("int").alias("op")).agg(F.count("*").alias("n"))


@query(over("g_links", "select count(*) as total_updates, (select count(*) from (select 'p' || page from e union select target from e)) as num_vertices, (select count(*) from (select distinct page, target from e)) as num_unique_edges from e"))
def convert(spark: Sp, d: str) -> Df:
    links = g_links(spark, d).select(F.concat(F.lit("p"), F.col("page").cast("string")).alias("src"), F.col("target").alias("dst"))
    head = api.convert(spark, links, shared_path(spark, "converted") + ".bin", signal=True, timestamp_type="none")
    return spark.createDataFrame([(head["total_updates"], head["num_vertices"], head["num_unique_edges"])], "total_updates long, num_vertices long, num_unique_edges long")


# Text


def _edges(spark: Sp, log: Df, sep: str = "\t") -> str:
    path = shared_path(spark, "edges")
    text.write_edges(log, path, sep)
    return path


@query(over("g_trade", LOG))
def src_edges(spark: Sp, d: str) -> Df:
    return counted(text.read_edges(spark, _edges(spark, g_trade(spark, d))))


@query(over("g_hop", LOG))
def snk_text_edges(spark: Sp, d: str) -> Df:
    return counted(text.read_graph(spark, _edges(spark, g_hop(spark, d), " "), "edges"))


@query(over("g_hop", "select 'u' || src as key, count(*) as degree from (select src from e union all select dst from e) group by 1"))
def src_edges_str(spark: Sp, d: str) -> Df:
    named = g_hop(spark, d).select(F.concat(F.lit("u"), "src").alias("src"), F.concat(F.lit("u"), "dst").alias("dst"), "ts")
    return text.read_edges_str(spark, _edges(spark, named))[1].select("key", "degree")


@query(over("g_part", "select row_number() over (order by v) - 1 as id, v as key, count(*) as degree from (select src as v from e union all select dst from e) group by v"))
def src_text_u32(spark: Sp, d: str) -> Df:
    """Ids by rank of the numeric keys."""
    return vertices(text.read_edges(spark, _edges(spark, g_part(spark, d))), "sorted")


@query(over("g_hop", "select dst as src, src as dst, ts from e"))
def src_columns(spark: Sp, d: str) -> Df:
    path = shared_path(spark, "columns")
    lines = g_hop(spark, d).select(F.concat_ws(" ", F.lit("x"), "src", "dst", "ts").alias("value"))
    lines.unionAll(spark.createDataFrame([("% a comment",)], "value string")).write.text(path)
    return text.read_columns(spark, path, 2, 1, 3).select(F.col("src").cast("long"), F.col("dst").cast("long"), "ts")


@query(over("g_hop", "select src, dst, ts from e"))
def src_csv(spark: Sp, d: str) -> Df:
    path = shared_path(spark, "csv")
    g_hop(spark, d).coalesce(1).write.csv(path, header=True)
    return text.read_csv(spark, path, ",").select(*(F.col(c).cast("long") for c in ("src", "dst", "ts")))


@query(over("g_hop", "select src, dst, ts from e"))
def src_dataframe(spark: Sp, d: str) -> Df:
    return g_hop(spark, d)


@query(over("g_user_k", "select src, dst, ts, op from e where op = 0"))
def src_updates_csv(spark: Sp, d: str) -> Df:
    """Deletions of the source are written as modifications, which are skipped."""
    path = shared_path(spark, "updates")
    lines = g_user_k(spark, d).select(F.concat_ws(",", "src", "dst", "ts", F.when(F.col("op") == 0, "insert").otherwise("modify")).alias("value"))
    lines.unionAll(spark.createDataFrame([("9,9,9",)], "value string")).write.text(path)
    return text.read_updates_csv(spark, path)[1].select("src", "dst", "ts", F.col("op").cast("int").alias("op"))


@query("select distinct l_partkey as src, l_suppkey as dst from lineitem")
def src_adj(spark: Sp, d: str) -> Df:
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    n = pairs.agg(F.max(F.greatest("src", "dst"))).first()[0] + 1
    path = shared_path(spark, "adj")
    text.write_adj(pairs, path, n)
    return text.read_graph(spark, path, "adj").select("src", "dst")


@query("select l_orderkey, l_partkey from lineitem")
def src_parquet(spark: Sp, d: str) -> Df:
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey")


@query(over("g_part", "select src as u, dst as v, n from (select src, dst - 1000000 as dst, count(*) as n from e group by 1, 2)"))
def snk_pbbs(spark: Sp, d: str) -> Df:
    """Pairs written as a weighted adjacency list; its parts are read back by their places."""
    pairs = g_part(spark, d).groupBy(F.col("src").alias("u"), (F.col("dst") - 1_000_000).alias("v")).agg(F.count("*").alias("w"))
    pairs = checkpoint(pairs)
    n, m = pairs.agg(F.max(F.greatest("u", "v")) + 1, F.count("*")).first()
    path = shared_path(spark, "weighted")
    text.write_weighted_adj(pairs, path, n)
    no = ST.assign_step(text.ordered_lines(spark, path), text.LINE_ORDER, "no").select((F.col("no") - 4).alias("no"), F.col("value").try_cast("long").alias("x")).where("no >= 0")
    starts = no.where(F.col("no") < n).select(F.col("no").alias("u"), F.col("x").alias("s"))
    ends = starts.select((F.col("u") - 1).alias("u"), F.col("s").alias("e"))
    spread = starts.join(ends, "u", "left").select("u", "s", F.coalesce("e", F.lit(m)).alias("e")).where("s < e").select("u", F.explode(F.sequence("s", F.col("e") - 1)).alias("k"))
    far = no.where((F.col("no") >= n) & (F.col("no") < n + m)).select((F.col("no") - n).alias("k"), F.col("x").alias("v"))
    weight = no.where(F.col("no") >= n + m).select((F.col("no") - n - m).alias("k"), F.col("x").alias("n"))
    return spread.join(far, "k").join(weight, "k").select("u", "v", "n")


@query(over("g_hop", "select case when ts % 2 = 0 then 'even' else 'odd' end as file, count(*) as n from e group by 1"))
def src_multi_file(spark: Sp, d: str) -> Df:
    log = checkpoint(g_hop(spark, d))
    folders = {"even": _edges(spark, log.where("ts % 2 = 0")), "odd": _edges(spark, log.where("ts % 2 = 1"))}
    name = F.when(F.col("path").contains(folders["even"].rsplit("/", 1)[-1]), "even").otherwise("odd")
    return spark.read.text(list(folders.values())).select(F.col("_metadata.file_path").alias("path")).groupBy(name.alias("file")).agg(F.count("*").alias("n"))


@query(over("g_hop", "select 'hop' as name, count(*) as updates from e union all select 'part', count(*) from (" + SQL["g_part"] + ")"))
def batch_convert(spark: Sp, d: str) -> Df:
    """Each of a folder's logs packed; a loop over files, not rows."""
    rows = []
    for name, log in (("hop", g_hop(spark, d)), ("part", g_part(spark, d))):
        head = packed.write_bin(text.read_edges(spark, _edges(spark, log)), shared_path(spark, name) + ".bin")
        rows.append((name, head.total_updates))
    return spark.createDataFrame(rows, "name string, updates long")


@query(over("g_hop", "select kind, n from (select 'edges' as kind, count(*) as n from e union all select 'bin', count(*) from e union all select 'rmat', 5000 union all select 'ws', 4000)"))
def graph_source(spark: Sp, d: str) -> Df:
    """The dispatcher, by name and by format."""
    log = checkpoint(g_hop(spark, d))
    found = {"edges": text.read_graph(spark, _edges(spark, log)), "bin": text.read_graph(spark, _packed(spark, log)), "rmat": text.read_graph(spark, "", "rmat", n=1000, m=5000), "ws": text.read_graph(spark, "", "ws", n=100, k=40)}
    out = None
    for kind, df in found.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@query(over("g_hop", "select count(*) as n, sum(dst)::bigint as total from e"))
def src_compressed(spark: Sp, d: str) -> Df:
    """The same log through gzip and bzip2."""
    log = checkpoint(g_hop(spark, d))
    a, b = shared_path(spark, "gz"), shared_path(spark, "bz2")
    log.where("src % 2 = 0").write.csv(a, sep="\t", compression="gzip")
    log.where("src % 2 = 1").write.csv(b, sep="\t", compression="bzip2")
    return text.read_edges(spark, [a, b]).agg(F.count("*").alias("n"), F.sum("dst").alias("total"))


@query(over("g_hop", "select least(src, dst) as u, greatest(src, dst) as v, count(*) as n from e group by 1, 2"))
def snk_stats_csv(spark: Sp, d: str) -> Df:
    path = shared_path(spark, "stats")
    ST.canonicalize(g_hop(spark, d)).groupBy("u", "v").agg(F.count("*").alias("n")).write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="u long, v long, n long")


@query(over("g_part", "select n as size, count(*) as count from (select src, dst, count(*) as n from e group by 1, 2) group by 1"))
def snk_hist(spark: Sp, d: str) -> Df:
    path = shared_path(spark, "hist")
    g_part(spark, d).groupBy("src", "dst").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("count")).coalesce(1).write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="size long, count long")


@query(over("g_hop", "select row_number() over (order by v) - 1 as id, v as key from (select src as v from e union select dst from e)"))
def snk_mapping(spark: Sp, d: str) -> Df:
    path = shared_path(spark, "mapping")
    vertices(g_hop(spark, d), "sorted").select("id", "key").write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="id long, key long")


# Generators


@query("select 20000 as n, true as in_range, true as skewed")
def gen_rmat(spark: Sp, d: str) -> Df:
    log = generators.gen_rmat(spark, 1000, 20_000, seed=1)
    return log.agg(F.count("*").cast("int").alias("n"), F.bool_and((F.col("src") < 1024) & (F.col("dst") < 1024) & (F.col("src") >= 0)).alias("in_range"), (F.count_if(F.col("src") < 512) > 11_000).alias("skewed"))


@query("select true as in_range, true as near, true as simple")
def gen_er(spark: Sp, d: str) -> Df:
    log = generators.gen_er(spark, 1000, 0.01, seed=1)
    return log.agg(F.bool_and((F.col("src") < 1000) & (F.col("dst") < 1000)).alias("in_range"), F.count("*").between(9_000, 11_000).alias("near"), (F.count("*") == F.count_distinct("src", "dst")).alias("simple"))


@query("select 40000 as n, true as near")
def gen_ws(spark: Sp, d: str) -> Df:
    log = generators.gen_ws(spark, 1000, 40, 0.1, seed=1)
    return log.agg(F.count("*").cast("int").alias("n"), F.count_if((F.col("dst") - F.col("src") + 1000) % 1000 > 40).between(3_000, 4_500).alias("near"))


@query("with p as (select distinct l_partkey as s, l_suppkey as t from lineitem) select count(*) * 2 as n from p")
def adj_rmat(spark: Sp, d: str) -> Df:
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    path = shared_path(spark, "adj")
    text.write_adj(pairs, path, pairs.agg(F.max(F.greatest("src", "dst"))).first()[0] + 1)
    return text.read_graph(spark, path, "adj_rmat").agg(F.count("*").alias("n"))


@query("select 1000 as n, 500 as deletions")
def gen_fixture(spark: Sp, d: str) -> Df:
    return generators.fixture(spark, 1000, 256).agg(F.count("*").cast("int").alias("n"), F.sum("op").cast("int").alias("deletions"))


# Dataset pipelines, over raw files made of the driver tables


def _papers(spark: Sp, d: str) -> Df:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"), F.array_sort(F.collect_set("l_partkey")).alias("p"))
    return table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("no"), F.year("o_orderdate").cast("long").alias("year"), "o_custkey", "s", "p")


LINES = "x as (select o_orderkey as no, year(o_orderdate)::bigint as year, o_custkey, list_sort(list_distinct(list(l_suppkey))) as s, list_sort(list_distinct(list(l_partkey))) as p from orders join lineitem on l_orderkey = o_orderkey group by 1, 2, 3)"
PAIRS_OF = "select unnest(s) as a, year, no from x"


@query(f"with {LINES}, y as ({PAIRS_OF}) select 'coauthor' as log, count(*) as n, sum(a.a * b.a)::bigint as total from y a join y b on a.no = b.no and a.a < b.a union all select 'reference', count(*), sum(q)::bigint from (select unnest(p) as q from x) union all select 'publication', count(*), sum(a)::bigint from y union all select 'venue', count(*), sum(o_custkey)::bigint from x union all select 'organisation', count(*), sum(a % 7)::bigint from y")
def pipeline_oag(spark: Sp, d: str) -> Df:
    path = shared_path(spark, "oag")
    authors = F.transform("s", lambda s: F.struct(s.cast("string").alias("id"), (s % 7).cast("string").alias("org_id")))
    _papers(spark, d).select(F.col("no").cast("string").alias("id"), "year", F.col("o_custkey").cast("string").alias("venue_id"), authors.alias("authors"), F.transform("p", lambda x: x.cast("string")).alias("references")).write.json(path)
    logs = P.oag(raw.read_jsonl(spark, path, raw.PAPER))
    value = {"coauthor": F.col("src").cast("long") * F.col("dst").cast("long")}
    out = None
    for name in ("coauthor", "reference", "publication", "venue", "organisation"):
        one = logs[name].agg(F.count("*").alias("n"), F.sum(value.get(name, F.col("dst").cast("long"))).alias("total")).select(F.lit(name).alias("log"), "n", "total")
        out = one if out is None else out.unionAll(one)
    return out


@query(f"with {LINES}, y as ({PAIRS_OF}), k as (select no, unnest(s) as a, year from x), r as (select no, unnest(p) as q, year from x) select log, src, dst, ts, count(*) as n from (select 'coauthor' as log, least(a.a, b.a)::varchar as src, greatest(a.a, b.a)::varchar as dst, k.year as ts from y a join y b on a.no = b.no and a.a < b.a join k on k.no = a.no and k.a = a.a union all select 'reference', no::varchar, q::varchar, year from r union all select 'publication', no::varchar, a::varchar, year from k union all select 'venue', no::varchar, o_custkey::varchar, year from x union all select 'organisation', a::varchar, (a % 7)::varchar, year from k) group by 1, 2, 3, 4")
def pipeline_oag_rows(spark: Sp, d: str) -> Df:
    """All five logs, row by row."""
    path = shared_path(spark, "oagrows")
    authors = F.transform("s", lambda s: F.struct(s.cast("string").alias("id"), (s % 7).cast("string").alias("org_id")))
    _papers(spark, d).select(F.col("no").cast("string").alias("id"), "year", F.col("o_custkey").cast("string").alias("venue_id"), authors.alias("authors"), F.transform("p", lambda x: x.cast("string")).alias("references")).write.json(path)
    logs = P.oag(raw.read_jsonl(spark, path, raw.PAPER))
    out = None
    for name in ("coauthor", "reference", "publication", "venue", "organisation"):
        one = logs[name].select(F.lit(name).alias("log"), "src", "dst", "ts")
        out = one if out is None else out.unionAll(one)
    number = lambda f: f(F.col("src").cast("long"), F.col("dst").cast("long")).cast("string")
    pair = F.col("log") == "coauthor"  # its ends come in the order of the authors' list
    ends = out.select("log", F.when(pair, number(F.least)).otherwise(F.col("src")).alias("src"), F.when(pair, number(F.greatest)).otherwise(F.col("dst")).alias("dst"), "ts")
    return ends.groupBy("log", "src", "dst", "ts").agg(F.count("*").alias("n"))


@query("select user_id::varchar as author, regexp_extract(props, '\"k\": *([0-9]+)', 1) as subreddit, epoch_us(ts) // 1000000 as created_utc from events")
def src_jsonl(spark: Sp, d: str) -> Df:
    path = shared_path(spark, "comments")
    table(spark, d, "events").select(F.col("user_id").cast("string").alias("author"), F.get_json_object("props", "$.k").alias("subreddit"), seconds("ts").alias("created_utc")).write.json(path, compression="bzip2")
    return raw.read_jsonl(spark, path, raw.COMMENT)


@query("select key, count(*) as degree from (select 'u/' || user_id as key from events where user_id % 10 <> 0 union all select 'r/' || regexp_extract(props, '\"k\": *([0-9]+)', 1) from events where user_id % 10 <> 0) group by 1")
def pipeline_reddit(spark: Sp, d: str) -> Df:
    author = F.when(F.col("user_id") % 20 == 0, "[deleted]").when(F.col("user_id") % 10 == 0, "AutoModerator").otherwise(F.col("user_id").cast("string"))
    return P.reddit(table(spark, d, "events").select(author.alias("author"), F.get_json_object("props", "$.k").alias("subreddit"), seconds("ts").alias("created_utc"), F.col("event_id").alias("row")))[1].select("key", "degree")


@query(f"with {LINES} select count(*) as n, sum(case when no % 2 = 0 then 1 else 0 end)::bigint as even from x")
def src_xml(spark: Sp, d: str) -> Df:
    folder = _articles(spark, d)
    return raw.read_xml(spark, folder, "article", raw.ARTICLE).agg(F.count("*").alias("n"), F.sum(F.when(F.substring_index("title", " ", -1).cast("long") % 2 == 0, 1).otherwise(0)).alias("even"))


def _articles(spark: Sp, d: str) -> str:
    folder = shared_path(spark, "dblp")
    authors = F.array_join(F.transform("s", lambda s: F.concat(F.lit("<author>A"), s.cast("string"), F.lit("</author>"))), "")
    xml = F.concat(F.lit("<article>"), authors, F.lit("<title>On "), F.col("no").cast("string"), F.lit("</title><year>"), F.col("year").cast("string"), F.lit("</year></article>"))
    _rooted(spark, _papers(spark, d).select(xml.alias("value")), "dblp").write.text(folder)
    return folder


def _rooted(spark: Sp, lines: Df, root: str) -> Df:
    """One file's lines within a root element."""
    edges = spark.createDataFrame([(f"<{root}>", 0), (f"</{root}>", 2)], "value string, at int")
    return edges.unionAll(lines.withColumn("at", F.lit(1))).repartition(1).sortWithinPartitions("at").select("value")


@query(f"with {LINES}, y as ({PAIRS_OF}) select a.year as ts, count(*) as n from y a join y b on a.no = b.no and a.a < b.a group by 1")
def pipeline_dblp(spark: Sp, d: str) -> Df:
    return P.dblp(raw.read_xml(spark, _articles(spark, d), "article", raw.ARTICLE))["coauthor"].groupBy("ts").agg(F.count("*").alias("n"))


@query(f"with {LINES}, y as ({PAIRS_OF}) select 'A' || a.a as a, 'A' || b.a as b, a.year as ts, count(*) as n from y a join y b on a.no = b.no and a.a < b.a group by 1, 2, 3")
def pipeline_dblp_rows(spark: Sp, d: str) -> Df:
    """Coauthors by name, row by row."""
    logs = P.dblp(raw.read_xml(spark, _articles(spark, d), "article", raw.ARTICLE))
    logs = {k: checkpoint(v) for k, v in logs.items() if k in ("coauthor", "authors")}
    name = lambda c, n: logs["authors"].select(F.col("id").alias(c), F.col("name").alias(n))
    named = logs["coauthor"].join(name("src", "a"), "src").join(name("dst", "b"), "dst")
    number = lambda c: F.substring(c, 2, 20).cast("long")
    return named.select(F.when(number("a") < number("b"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(number("a") < number("b"), F.col("b")).otherwise(F.col("a")).alias("b"), "ts").groupBy("a", "b", "ts").agg(F.count("*").alias("n"))


def _tagged(spark: Sp, d: str) -> str:
    folder = shared_path(spark, "tagged")
    name = F.array_join(F.transform("s", lambda s: F.concat(F.lit("A"), s.cast("string"))), ";")
    refs = F.array_join(F.transform("p", lambda p: F.concat(F.lit("#%"), p.cast("string"))), "\n")
    block = F.concat(F.lit("#index"), F.col("no").cast("string"), F.lit("\n#* On things\n#@"), name, F.lit("\n#t"), F.col("year").cast("string"), F.lit("\n"), refs, F.lit("\n"))
    _papers(spark, d).orderBy("no").select(block.alias("value")).coalesce(1).write.text(folder)
    return folder


@query(f"with {LINES} select no, len(s)::int as authors, len(p)::int as refs, year::varchar as year from x")
def src_tagged_text(spark: Sp, d: str) -> Df:
    rows = raw.read_tagged_text(spark, _tagged(spark, d))
    return rows.select(F.col("index").cast("long").alias("no"), F.size("authors").alias("authors"), F.size("refs").alias("refs"), "year")


@query(f"with {LINES}, y as ({PAIRS_OF}) select 'coauthor' as log, count(*) as n from y a join y b on a.no = b.no and a.a < b.a union all select 'bigraph', count(*) from y union all select 'reference', count(*) from (select unnest(p) from x) union all select 'authors', count(distinct a) from y union all select 'articles', count(*) from x")
def pipeline_aminer(spark: Sp, d: str) -> Df:
    logs = P.aminer(raw.read_tagged_text(spark, _tagged(spark, d)))
    out = None
    for name in ("coauthor", "bigraph", "reference", "authors", "articles"):
        one = logs[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("log"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@query(f"with {LINES} select 'c' || o_custkey as author, count(*) as commits, sum(len(p))::bigint as files from x group by 1")
def src_gitlog(spark: Sp, d: str) -> Df:
    commits = raw.read_gitlog(spark, _gitlog(spark, d))
    return commits.groupBy("author").agg(F.count("*").alias("commits"), F.sum(F.size("files")).alias("files"))


def _gitlog(spark: Sp, d: str) -> str:
    folder = shared_path(spark, "gitlog")
    files = F.array_join(F.transform("p", lambda p: F.concat(F.lit("src/"), p.cast("string"), F.lit(".c"))), "\n")
    head = F.concat(F.lit("h"), F.col("no").cast("string"), F.lit("|c"), F.col("o_custkey").cast("string"), F.lit("|"), F.col("year").cast("string"), F.lit("-06-01 12:00:00 +0200\n"))
    _papers(spark, d).orderBy("no").select(F.concat(head, files, F.lit("\n")).alias("value")).write.text(folder)
    return folder


@query(f"with {LINES} select epoch_us(make_timestamp(year, 6, 1, 10, 0, 0.0)) // 1000000 as ts, sum(len(p))::bigint as n from x group by 1")
def pipeline_git(spark: Sp, d: str) -> Df:
    return P.git(raw.read_gitlog(spark, _gitlog(spark, d)))[0].groupBy("ts").agg(F.count("*").alias("n"))


@query("select user_id::varchar as src, regexp_extract(props, '\"k\": *([0-9]+)', 1) as dst, count(*) * 2 as n from events group by 1, 2")
def pipeline_bluesky(spark: Sp, d: str) -> Df:
    k = F.get_json_object("props", "$.k")
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("user"), k.alias("x1"), F.lit("None").alias("x2"), k.alias("x3"), F.lit("None").alias("x4"), F.date_format("ts", "yyyyMMddHHmm").alias("time"))
    return P.bluesky(rows).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("select l_orderkey as src, l_suppkey as dst, epoch_us(l_shipdate) // 1000000 as ts, l_quantity::bigint as weight from lineitem")
def pipeline_btc(spark: Sp, d: str) -> Df:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("SRC_ID"), F.col("l_suppkey").alias("DST_ID"), seconds("l_shipdate").alias("TIMESTAMP"), F.col("l_quantity").cast("long").alias("VALUE_SATOSHI"))
    return P.btc(rows, value=True)


@query("select key, count(*) as degree from (select 'c' || o_custkey as key from orders join lineitem on l_orderkey = o_orderkey union all select 's' || l_suppkey from orders join lineitem on l_orderkey = o_orderkey) group by 1")
def pipeline_ethereum(spark: Sp, d: str) -> Df:
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    transactions = lines.select(F.col("o_orderkey").alias("block"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("sender"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("receiver"), F.monotonically_increasing_id().alias("row"))
    blocks = table(spark, d, "orders").select(F.col("o_orderkey").alias("block"), F.hex(seconds("o_orderdate")).alias("hex_time"))
    return P.ethereum(transactions, blocks)[1].select("key", "degree")


@query("with f as (select 'A' || user_id % 40 as o, case when user_id % 3 = 0 then '' else 'A' || event_id % 40 end as t from events) select key, count(*) as degree from (select o as key from f where t <> '' and o <> t union all select t from f where t <> '' and o <> t) group by 1")
def pipeline_flights(spark: Sp, d: str) -> Df:
    rows = table(spark, d, "events").select(F.concat(F.lit("A"), (F.col("user_id") % 40).cast("string")).alias("origin"), F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("A"), (F.col("event_id") % 40).cast("string"))).alias("destination"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("firstseen"), F.col("event_id").alias("row"))
    return P.flights(rows)[1].select("key", "degree")


@query("""with r as (select o_custkey as c, o_orderkey as o, list_distinct(list(l_suppkey)) as l from orders join lineitem on l_orderkey = o_orderkey group by 1, 2), w as (select c, o, l, coalesce(lag(l) over (partition by c order by o), []) as old from r),
    d as (select unnest(list_filter(l, lambda x: not list_contains(old, x))) as s, 0 as op from w union all select unnest(list_filter(old, lambda x: not list_contains(l, x))), 1 from w) select 'S' || s as target, op, count(*) as n from d where s % 5 <> 0 group by 1, 2""")
def pipeline_wikipedia(spark: Sp, d: str) -> Df:
    """Customers as pages, their orders as revisions; every fifth supplier is a talk page."""
    name = lambda s: F.when(s % 5 == 0, F.concat(F.lit("Talk:S"), s.cast("string"))).otherwise(F.concat(F.lit("S"), s.cast("string")))
    links = F.array_join(F.transform("s", lambda s: F.concat(F.lit("see [["), name(s), F.lit("#top|it]] "))), "")
    revision = F.concat(F.lit("<revision><timestamp>"), F.col("year").cast("string"), F.lit("-01-01T00:00:00Z</timestamp><text>"), links, F.lit("</text></revision>"))
    pages = _papers(spark, d).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("no", revision.alias("r")))).alias("r"))
    folder = shared_path(spark, "wiki")
    lines = pages.select(F.concat(F.lit("<page><title>C"), F.col("o_custkey").cast("string"), F.lit("</title>"), F.array_join(F.transform("r", lambda x: x["r"]), ""), F.lit("</page>")).alias("value"))
    _rooted(spark, lines, "mediawiki").write.text(folder)
    found = P.wikipedia(raw.read_xml(spark, folder, "page", raw.WIKI_PAGE))
    return found.groupBy("target", F.col("op").cast("int").alias("op")).agg(F.count("*").alias("n"))


@query("select r_regionkey, r_name from region")
def pipeline_taxi(spark: Sp, d: str) -> Df:
    target = shared_path(spark, "taxi")
    P.taxi(spark, f"{d}/region.parquet", target)
    return spark.read.csv(target, header=True, schema="r_regionkey int, r_name string")


def _roads(spark: Sp, d: str) -> tuple[Df, Df]:
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 90).cast("double").alias("lat"), (F.col("s_suppkey") % 170).cast("double").alias("lon"))
    ways = _papers(spark, d).select(F.col("o_custkey").alias("id"), F.col("no").alias("version"), F.col("year").alias("timestamp"), (F.col("no") % 7 != 0).alias("visible"), F.col("s").alias("nodes"), F.create_map(F.lit("highway"), F.lit("residential")).alias("tags"))
    return nodes, ways


@query("select count(*) as nodes, (select count(distinct o_orderkey) from orders join lineitem on l_orderkey = o_orderkey) as ways, sum((s_suppkey % 90)::double) as lat from supplier")
def src_osm(spark: Sp, d: str) -> Df:
    folder = shared_path(spark, "osm")
    nodes, ways = _roads(spark, d)
    nodes.write.parquet(f"{folder}/nodes")
    ways.write.parquet(f"{folder}/ways")
    found, paths = raw.read_osm(spark, folder)
    both = found.agg(F.count("*").alias("nodes"), F.sum("lat").alias("lat"))
    return both.crossJoin(F.broadcast(paths.agg(F.count("*").alias("ways"))))  # single rows


@query("select count(*) as n, sum(s_suppkey)::bigint as total from supplier")
def src_osm_csv(spark: Sp, d: str) -> Df:
    folder = shared_path(spark, "osmcsv")
    nodes = _roads(spark, d)[0]
    nodes.select("id", "lon", "lat").write.csv(f"{folder}/nodes.csv", header=True)
    nodes.select(F.col("id").cast("string").alias("id"), F.col("id").alias("source"), (F.col("id") + 1).alias("target"), F.lit(1.0).alias("length")).write.csv(f"{folder}/edges.csv", header=True)
    found, edges = raw.read_osm_csv(spark, folder)
    return found.join(edges, found["id"] == edges["source"]).agg(F.count("*").alias("n"), F.sum("source").alias("total"))


RADIUS = "6371007.181"


@query(f"""with p as (select s_suppkey as id, row_number() over (order by s_suppkey) - 1 as k, (s_suppkey % 170)::double as lon, (s_suppkey % 90)::double as lat from supplier),
    x as (select a.k as u, b.k as v, 1e9 + l_orderkey as w, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2 as h
        from (select l_suppkey as s, l_partkey % 7 + 1 as t, max(l_orderkey) as l_orderkey from lineitem group by 1, 2) join p a on a.id = s join p b on b.id = t)
    select 'pairs' as part, count(*) as n, sum(u * 31 + v)::bigint as total from x union all select 'points', count(*), sum(k * id)::bigint from p
    union all select 'lines', (select 3 + 2 * count(*) from x) + (select count(*) from p) + 1 + (select count(*) from p), (select sum(v) from x)::bigint
    union all select 'ratio', count(*), round(max(2 * {RADIUS} * atan2(sqrt(h), sqrt(1.0 - h)) / w) * 1e6)::bigint from x""")
def pipeline_osm_static(spark: Sp, d: str) -> Df:
    """Nodes and edges as CSV to a point file and a weighted adjacency, read back as lines."""
    folder = shared_path(spark, "osmstatic")
    _roads(spark, d)[0].select("id", "lon", "lat").write.csv(f"{folder}/nodes.csv", header=True)
    lines = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 7 + 1).alias("target")).agg(F.max("l_orderkey").alias("o"))
    lines.select(F.col("o").cast("string").alias("id"), "source", "target", (F.col("o") + 1e9).alias("length")).write.csv(f"{folder}/edges.csv", header=True)
    points, pairs, ratios = P.osm_static(*raw.read_osm_csv(spark, folder))
    points, pairs = checkpoint(points), checkpoint(pairs)
    n = points.count()
    text.write_points(points, f"{folder}/coords")
    text.write_weighted_adj(pairs, f"{folder}/graph", n)
    part = lambda name, df, total: df.agg(F.count("*").alias("n"), total.cast("long").alias("total")).select(F.lit(name).alias("part"), "n", "total")
    written = spark.read.text([f"{folder}/coords", f"{folder}/graph"])
    out = part("pairs", pairs, F.sum(F.col("u") * 31 + F.col("v"))).unionAll(part("points", points, F.sum(F.col("k") * F.col("id"))))
    out = out.unionAll(part("lines", written, F.lit(0)).select("part", "n", F.lit(pairs.agg(F.sum("v")).first()[0]).alias("total")))
    return out.unionAll(ratios.select(F.lit("ratio").alias("part"), F.lit(pairs.count()).alias("n"), F.round(F.col("most") * 1e6).cast("long").alias("total")))


@query(f"with {LINES}, y as (select no, year, unnest(p) as q from x) select 1 + no as src, q as dst, year as ts, count(*) as n from y where no % 5 <> 0 group by 1, 2, 3")
def pipeline_semantic_scholar(spark: Sp, d: str) -> Df:
    """Papers and citations as JSON lines; a paper of every five is unknown."""
    folder = shared_path(spark, "scholar")
    papers = _papers(spark, d)
    papers.where("no % 5 <> 0").select((F.col("no") + 1).alias("corpusid"), "year", F.lit("t").alias("title")).write.json(f"{folder}/papers", compression="gzip")
    papers.select((F.col("no") + 1).alias("citingcorpusid"), F.explode("p").alias("citedcorpusid")).write.json(f"{folder}/citations", compression="gzip")
    known = raw.read_jsonl(spark, f"{folder}/papers", "corpusid long, year long").withColumn("row", F.monotonically_increasing_id())
    return counted(P.semantic_scholar(known, raw.read_jsonl(spark, f"{folder}/citations", "citingcorpusid long, citedcorpusid long")))


@query()
def pipeline_osm_dynamic(spark: Sp, d: str) -> Df:
    """Weighted, merged and numbered history of the made-up ways; checked against a replay in the tests."""
    nodes, ways = _roads(spark, d)
    return P.osm_history(nodes, ways, weighted=True, merge=True)[0].select("src", "dst", "ts", F.col("op").cast("int").alias("op"), F.round("weight", 3).alias("weight"))


HISTORY = f"""with {LINES}, t as (select o_custkey as id, no as version, year as ts, lead(no) over w as nv, lead(year) over w as nts from x window w as (partition by o_custkey order by no)),
    path as (select o_custkey as id, no as version, unnest(s) as node, unnest(range(0, len(s))) as i, len(s) as n from x where no % 7 <> 0),
    m as (select *, case when node % 3 = 0 and i > 0 and i < n - 1 then 1 else 0 end as cut from path),
    g as (select *, sum(cut) over (partition by id, version order by i) as seg from m),
    y as (select id, version, seg, i, node from g union all select id, version, seg - 1, i, node from g where cut = 1),
    ends as (select id, version, arg_min(node, i) as a, arg_max(node, i) as b from y group by id, version, seg having count(*) > 1),
    counted as (select id, version, least(a, b) as u, greatest(a, b) as v, count(*) as n from ends group by 1, 2, 3, 4),
    moves as (select id, version, ts, u, v, n as by_n from counted join t using (id, version) union all select id, nv, nts, u, v, -n from counted join t using (id, version) where nv is not null),
    diff as (select id, version, ts, u, v, sum(by_n) as by_n from moves group by 1, 2, 3, 4, 5 having sum(by_n) <> 0),
    users as (select *, sum(by_n) over (partition by u, v order by ts, id, version) as users from diff)
    select u, v, ts, case when users > 0 then 0 else 1 end as op from users where (users - by_n = 0) <> (users = 0)"""


@query(HISTORY)
def history_extract(spark: Sp, d: str) -> Df:
    """Road segments over all versions of the ways."""
    cuts = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("node"))
    return P.history(_roads(spark, d)[1], cuts).select("u", "v", "ts", F.col("op").cast("int").alias("op"))


@query()
def merge_intersections(spark: Sp, d: str) -> Df:
    """Chains of supplier ids contracted to their ends; checked on small chains in the tests."""
    ids = table(spark, d, "supplier").select(F.col("s_suppkey").alias("u"))
    edges = ids.select("u", (F.col("u") + 1).alias("v"), F.expr("(u div 10)").alias("props"), F.lit(1.0).alias("length"))
    uses = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg((2 * F.count("*")).alias("uses"))
    return P.merge_intersections(edges, uses)


def _with_random(spark: Sp, d: str, kind: str) -> Df:
    pairs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 97).alias("dst"))
    path = shared_path(spark, "adj")
    text.write_adj(pairs, path, pairs.agg(F.max(F.greatest("src", "dst"))).first()[0] + 1)
    return text.read_graph(spark, path, kind)


SMALL = "with p as (select distinct l_suppkey as s, l_partkey % 97 as t from lineitem), c as (select count(*) as m, max(greatest(s, t)) + 1 as n from p)"


@query(f"{SMALL} select true as near from c")
def adj_er(spark: Sp, d: str) -> Df:
    """The file's edges and about as many random ones."""
    pairs = table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey") % 97).distinct().agg(F.count("*").alias("m"))
    made = _with_random(spark, d, "adj_er").agg(F.count("*").alias("x"))
    return made.crossJoin(F.broadcast(pairs)).select(F.col("x").between(1.8 * F.col("m"), 2.2 * F.col("m")).alias("near"))  # single rows


@query(f"{SMALL} select (m + n * greatest(1, m // n))::bigint as n from c")
def adj_ws(spark: Sp, d: str) -> Df:
    return _with_random(spark, d, "adj_ws").agg(F.count("*").alias("n"))


@query(f"with {LINES} select no, 'c' || o_custkey as author, len(p)::int as files from x")
def commit_block(spark: Sp, d: str) -> Df:
    """Files under the commit line before them."""
    return raw.read_gitlog(spark, _gitlog(spark, d)).select(F.substring("hash", 2, 20).cast("long").alias("no"), "author", F.size("files").alias("files"))
