"""Dataset pipelines: from raw records to logs."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from edgetide.functions.roads import access, accessible
from edgetide.functions.scalars import haversine, hex_to_int, in_namespace, parse_git_date, parse_iso_z, parse_ymdhm, seconds_since, wiki_links
from edgetide.operators.aggregates import node_uses
from edgetide.operators.dictionary import encode
from edgetide.operators.steps import assign_step


def pairs_in(items: Column) -> Column:
    """All pairs (a, b) of an array's items, a before b."""
    n = F.size(items)
    return F.flatten(F.transform(items, lambda x, i: F.transform(F.slice(items, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def author_ids(papers: DataFrame, start: int = 1) -> DataFrame:
    """(key, id) of the names in column `authors`, by first appearance over papers in the order of `no`."""
    names = papers.select("no", F.posexplode("authors").alias("i", "key")).groupBy("key").agg(F.min(F.struct("no", "i")).alias("at"))
    return assign_step(names.select("key", "at.no", "at.i"), ("no", "i"), "n").select("key", (F.col("n") - 1 + start).alias("id"))


def _with_author_ids(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = author_ids(papers)
    each = papers.select("no", "year", F.posexplode("authors").alias("i", "key")).join(ids, "key")
    return each.groupBy("no", "year").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda x: x["id"]).alias("ids")), ids


def aminer(papers: DataFrame) -> dict[str, DataFrame]:
    """Coauthor, article to author and reference logs of tagged blocks, and the author and article names; years 1900 to 2029."""
    dated = papers.withColumn("year", F.col("year").try_cast("long")).where("year between 1900 and 2029")
    with_ids, _ = _with_author_ids(papers.withColumn("year", F.col("year").try_cast("long")))
    with_ids = with_ids.where("year between 1900 and 2029")
    named = dated.select("no", "index")
    return {
        "coauthor": with_ids.select(F.explode(pairs_in(F.col("ids"))).alias("p"), "year").select(F.col("p.a").alias("src"), F.col("p.b").alias("dst"), F.col("year").alias("ts")),
        "bigraph": with_ids.select("no", F.explode("ids").alias("dst"), "year").join(named, "no").select(F.col("index").cast("long").alias("src"), "dst", F.col("year").alias("ts")),
        "reference": dated.select(F.col("index").cast("long").alias("src"), F.explode("refs").alias("r"), F.col("year").alias("ts")).select("src", F.col("r").cast("long").alias("dst"), "ts"),
        "authors": author_ids(papers).select("id", F.col("key").alias("name")),
        "articles": papers.where("title is not null").select(F.col("index").alias("id"), "title"),
    }


def dblp(articles: DataFrame) -> dict[str, DataFrame]:
    """Coauthor and article to author logs; records without year and author are skipped, articles numbered from 1."""
    kept = articles.where("year is not null or size(author) > 0").withColumn("at", F.monotonically_increasing_id())
    papers = assign_step(kept.select("at", F.coalesce("author", F.array().cast("array<string>")).alias("authors"), F.col("year").try_cast("long").alias("year"), F.coalesce("title", F.lit("null")).alias("title")), ("at",), "no")
    with_ids, ids = _with_author_ids(papers)
    with_ids = with_ids.where("year between 1900 and 2029")
    return {
        "coauthor": with_ids.select(F.explode(pairs_in(F.col("ids"))).alias("p"), "year").select(F.col("p.a").alias("src"), F.col("p.b").alias("dst"), F.col("year").alias("ts")),
        "bigraph": with_ids.select(F.col("no").alias("src"), F.explode("ids").alias("dst"), F.col("year").alias("ts")),
        "authors": ids.select("id", F.col("key").alias("name")),
        "articles": papers.select(F.col("no").alias("id"), "title"),
    }


def oag(papers: DataFrame) -> dict[str, DataFrame]:
    """Coauthor, reference, publication, venue and organisation logs of papers with an id and a year, and counts."""
    given = lambda c: c.isNotNull() & (c != "")
    kept = papers.where(given(F.col("id")) & F.col("year").isNotNull() & (F.col("year") != 0)).withColumn("known", F.filter(F.coalesce("authors", F.array().cast("array<struct<id:string,org_id:string>>")), lambda a: given(a["id"])))
    edge = lambda a, b: (F.col(a).alias("src"), F.col(b).alias("dst"), F.col("year").alias("ts"))
    each = kept.select("id", "year", F.explode("known").alias("a"))
    return {
        "coauthor": kept.select("year", F.explode(pairs_in(F.transform("known", lambda a: a["id"]))).alias("p")).select(*edge("p.a", "p.b")),
        "reference": kept.select("id", "year", F.explode("references").alias("r")).where(given(F.col("r"))).select(*edge("id", "r")),
        "publication": each.select(*edge("id", "a.id")),
        "venue": kept.where(given(F.col("venue_id"))).select(*edge("id", "venue_id")),
        "organisation": each.where(given(F.col("a.org_id"))).select(*edge("a.id", "a.org_id")),
        "counts": kept.agg(F.count("*").alias("papers"), F.min("year").alias("min_year"), F.max("year").alias("max_year")),
    }


def semantic_scholar(papers: DataFrame, citations: DataFrame) -> DataFrame:
    """Citations with the citing paper's year; of repeated papers the last one by `row` counts, unmatched citations go."""
    years = papers.where("corpusid is not null and year is not null").groupBy("corpusid").agg(F.max_by("year", "row").alias("year"))
    known = citations.where("citingcorpusid is not null and citedcorpusid is not null")
    return known.join(years, F.col("citingcorpusid") == F.col("corpusid")).select(F.col("citingcorpusid").alias("src"), F.col("citedcorpusid").alias("dst"), F.col("year").alias("ts"))


def bluesky(rows: DataFrame) -> DataFrame:
    """(src, dst, ts): a user with each of four others that is not the word None; rows without a right time go."""
    dated = rows.withColumn("ts", parse_ymdhm(F.col("time"))).where("ts is not null")
    return dated.select(F.col("user").alias("src"), F.explode(F.array("x1", "x2", "x3", "x4")).alias("dst"), "ts").where("dst <> 'None'")


def btc(rows: DataFrame, value: bool = False) -> DataFrame:
    """Transfers with their time, and their value on request."""
    return rows.select(F.col("SRC_ID").alias("src"), F.col("DST_ID").alias("dst"), F.col("TIMESTAMP").alias("ts"), *([F.col("VALUE_SATOSHI").alias("weight")] if value else []))


def ethereum(transactions: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transactions with their block's time, senders and receivers numbered by first appearance; and the dictionary."""
    times = blocks.select("block", hex_to_int(F.col("hex_time")).alias("ts"))
    return encode(transactions.join(times, "block").select(F.col("sender").alias("src"), F.col("receiver").alias("dst"), "ts", "row"), "first_seen_interleaved")


def flights(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flights between two known, different airports in seconds since the end of 2018, by time; airports numbered by first appearance."""
    kept = rows.where("coalesce(origin, '') <> '' and coalesce(destination, '') <> '' and origin <> destination").select(F.col("origin").alias("src"), F.col("destination").alias("dst"), seconds_since(F.substring("firstseen", 1, 19)).alias("ts"), "row")
    return encode(kept, "first_seen_interleaved")


def git(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst, ts) of authors and files; a commit's author is numbered before its files; and the dictionary."""
    each = commits.select("commit", "author", "date", F.posexplode("files").alias("i", "file"))
    keys = commits.select(F.col("author").alias("key"), "commit", F.lit(-1).alias("i")).unionAll(each.select(F.col("file").alias("key"), "commit", "i"))
    first = keys.groupBy("key").agg(F.min(F.struct("commit", "i")).alias("at"))
    ids = assign_step(first.select("key", "at.commit", "at.i"), ("commit", "i"), "n").select("key", (F.col("n") - 1).alias("id"))
    src, dst = ids.select(F.col("key").alias("author"), F.col("id").alias("src")), ids.select(F.col("key").alias("file"), F.col("id").alias("dst"))
    return each.join(src, "author").join(dst, "file").select("src", "dst", parse_git_date(F.col("date")).alias("ts")), ids


def reddit(comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst, ts) of users and communities, without deleted users and the moderator bot; numbered by first appearance, a user and a community of one name apart."""
    kept = comments.where(~F.col("author").isin("[deleted]", "AutoModerator"))
    return encode(kept.select(F.concat(F.lit("u/"), "author").alias("src"), F.concat(F.lit("r/"), "subreddit").alias("dst"), F.col("created_utc").alias("ts"), "row"), "first_seen_interleaved")


def wikipedia(pages: DataFrame) -> DataFrame:
    """(title, target, op, ts): links that each revision adds (0) or removes (1) against the one before it."""
    revisions = pages.select("title", F.posexplode("revision").alias("i", "r")).select("title", "i", parse_iso_z(F.col("r.timestamp")).alias("ts"), wiki_links(F.coalesce("r.text", F.lit(""))).alias("links"))
    before = F.coalesce(F.lag("links").over(W.partitionBy("title").orderBy("i")), F.array().cast("array<string>"))
    both = revisions.withColumn("old", before)
    changes = both.select("title", "ts", F.explode(F.concat(F.transform(F.array_except("links", "old"), lambda x: F.struct(x.alias("target"), F.lit(0).alias("op"))), F.transform(F.array_except("old", "links"), lambda x: F.struct(x.alias("target"), F.lit(1).alias("op"))))).alias("c"))
    out = changes.select(F.trim("title").alias("title"), "c.target", F.col("c.op").cast("byte").alias("op"), "ts").where("title <> '' and target <> ''")
    return out.where(~in_namespace(F.col("title")) & ~in_namespace(F.col("target")))


def taxi(spark, source: str, target: str) -> None:  # noqa: ANN001
    """Parquet trips to CSV."""
    spark.read.parquet(source).write.csv(target, header=True)


# Roads


def path_length(paths: DataFrame, nodes: DataFrame, key: str, radius: float = 6_378_100.0) -> DataFrame:
    """(key, length) of paths of node ids in column `nodes`; a path with an unknown node is left out."""
    steps = paths.select(key, F.posexplode("nodes").alias("i", "node_id")).join(nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id", "left")
    w = W.partitionBy(key).orderBy("i")
    pairs = steps.withColumns({"lat0": F.lag("lat").over(w), "lon0": F.lag("lon").over(w)})
    part = F.when(F.col("i") > 0, haversine(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"), radius)).otherwise(0.0)
    return pairs.groupBy(key).agg(F.sum(part).alias("length"), F.count_if(F.col("lat").isNull()).alias("missing")).where("missing = 0").drop("missing")


def segment_split(paths: DataFrame, cuts: DataFrame, key: str = "id") -> DataFrame:
    """(key, segment, nodes): paths cut at the nodes of `cuts` (column `node`); a cut node ends one segment and starts the next."""
    marked = paths.select(key, F.size("nodes").alias("n"), F.posexplode("nodes").alias("i", "node")).join(cuts.select("node", F.lit(True).alias("cut")), "node", "left")
    inner = F.when(F.coalesce("cut", F.lit(False)) & (F.col("i") > 0) & (F.col("i") < F.col("n") - 1), 1).otherwise(0)
    w = W.partitionBy(key).orderBy("i")
    numbered = marked.withColumn("inner", inner).withColumn("segment", F.sum("inner").over(w.rowsBetween(W.unboundedPreceding, 0)))
    both = numbered.select(key, "i", "node", F.explode(F.when(F.col("inner") == 1, F.array(F.col("segment") - 1, F.col("segment"))).otherwise(F.array("segment"))).alias("segment"))
    return both.groupBy(key, "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "node"))), lambda x: x["node"]).alias("nodes")).where("size(nodes) > 1")


def merge_intersections(edges: DataFrame, uses: DataFrame) -> DataFrame:
    """(u, v, props, length): edges joined at nodes used by just two edge ends of equal properties, until none is left.

    In a round, a node merges if its hash is the least among the mergeable
    ones next to it, so no edge takes part in two merges. The hash changes each
    round, so about a third of a chain's nodes merge, however they are numbered;
    the least hash of all always merges, so the rounds come to an end.
    """
    from edgetide.session import checkpoint

    now = checkpoint(edges.select("u", "v", "props", "length"))
    inner = uses.where("uses = 4").select(F.col("node").alias("x"))
    for k in count():
        ends = now.withColumn("e", F.xxhash64("u", "v", "props", "length")).select("e", "props", "length", F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("far")), F.struct(F.col("v").alias("x"), F.col("u").alias("far")))).alias("p")).select("e", "props", "length", "p.x", "p.far")
        meets = ends.join(inner, "x", "left_semi").groupBy("x").agg(F.count("*").alias("n"), F.count_distinct("props").alias("kinds"), F.min(F.struct("far", "e", "length")).alias("a"), F.max(F.struct("far", "e", "length")).alias("b"), F.first("props").alias("props"))
        ready = meets.where("n = 2 and kinds = 1 and a.far <> b.far and a.far <> x and b.far <> x and a.e <> b.e")
        ready = ready.withColumn("rank", F.struct(F.xxhash64("x", F.lit(k)).alias("hash"), "x"))
        claims = ready.select("rank", F.explode(F.array("a.e", "b.e")).alias("e")).groupBy("e").agg(F.min("rank").alias("least"))
        wins = ready.join(claims.select(F.col("e").alias("ea"), F.col("least").alias("la")), F.col("a.e") == F.col("ea")).join(claims.select(F.col("e").alias("eb"), F.col("least").alias("lb")), F.col("b.e") == F.col("eb")).where("la = rank and lb = rank")
        wins = checkpoint(wins.select(F.col("a.far").alias("u"), F.col("b.far").alias("v"), "props", (F.col("a.length") + F.col("b.length")).alias("length"), F.array("a.e", "b.e").alias("gone")))
        if wins.isEmpty():
            return now
        gone = wins.select(F.explode("gone").alias("e"))
        now = checkpoint(now.withColumn("e", F.xxhash64("u", "v", "props", "length")).join(gone, "e", "left_anti").drop("e").unionByName(wins.drop("gone")))


def final_ways(ways: DataFrame) -> DataFrame:
    """(id, nodes, access) of each way's last version, if it is visible, accessible and has two nodes."""
    last = ways.groupBy("id").agg(F.max_by(F.struct(*(c for c in ways.columns if c != "id")), "version").alias("w")).select("id", "w.*")
    known = last.where("visible").withColumn("access", access(F.map_entries("tags")))
    return known.where(accessible(F.col("access")) & (F.size("nodes") > 1)).select("id", "nodes", "access")


def crossings(ways: DataFrame, merge: bool = False) -> DataFrame:
    """(node): where the final ways are cut; with `merge`, without nodes that two edges of equal access meet at alone."""
    kept = final_ways(ways)
    uses = node_uses(kept)
    cuts = uses.select("node")
    if not merge:
        return cuts
    pieces = segment_split(kept, cuts).join(kept.select("id", F.col("access").cast("string").alias("props")), "id")
    edges = pieces.select(F.element_at("nodes", 1).alias("u"), F.element_at("nodes", -1).alias("v"), "props", F.col("segment").cast("double").alias("length"))
    return merge_intersections(edges, uses).select(F.explode(F.array("u", "v")).alias("node")).distinct()


def history(ways: DataFrame, cuts: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(u, v, ts, op): the segments that each version of a way adds or removes, while their pair's number of users goes from or to none.

    With `nodes` (id, lat, lon) an insertion has a weight, the length of the
    version's shortest path between the two, and a deletion a weight of 0;
    paths that hold a node without a place are left out.
    """
    open_ = ways.withColumn("path", F.when(F.col("visible") & accessible(access(F.map_entries("tags"))), F.col("nodes")).otherwise(F.array().cast("array<long>")))
    versions = open_.withColumn("key", F.struct("id", "version"))
    pieces = segment_split(versions.select("key", F.col("path").alias("nodes")), cuts, "key").withColumn("piece", F.struct("key", "segment"))
    pieces = pieces.join(path_length(pieces.select("piece", "nodes"), nodes, "piece"), "piece") if nodes is not None else pieces.withColumn("length", F.lit(1.0))
    cut = pieces.select("key", F.struct(F.least(F.element_at("nodes", 1), F.element_at("nodes", -1)).alias("u"), F.greatest(F.element_at("nodes", 1), F.element_at("nodes", -1)).alias("v")).alias("s"), "length")
    # Versions that have a segment, each with its count there and the counts of all versions around it: no maps of a whole way.
    counted = cut.groupBy("key", "s").agg(F.count("*").alias("n"), F.min("length").alias("length"))
    turns = versions.select("id", "version", "timestamp", "key")
    after = turns.withColumn("next", F.lead(F.struct("version", "timestamp")).over(W.partitionBy("id").orderBy("version")))
    lives = counted.join(after, "key")
    comes = lives.select("id", "version", "timestamp", "s.u", "s.v", F.col("n").alias("by"), "length")
    goes = lives.where("next is not null").select("id", F.col("next.version").alias("version"), F.col("next.timestamp").alias("timestamp"), "s.u", "s.v", (-F.col("n")).alias("by"), F.lit(None).cast("double").alias("length"))
    diff = comes.unionByName(goes).groupBy("id", "version", "timestamp", "u", "v").agg(F.sum("by").alias("by"), F.min("length").alias("length")).where("by <> 0")
    w = W.partitionBy("u", "v").orderBy("timestamp", "id", "version")
    users = diff.withColumn("users", F.sum("by").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("was", F.col("users") - F.col("by"))
    weight = [] if nodes is None else [F.when(F.col("users") > 0, F.col("length")).otherwise(0.0).alias("weight")]
    return users.where("(was = 0) <> (users = 0)").select("u", "v", F.col("timestamp").alias("ts"), F.when(F.col("users") > 0, 0).otherwise(1).cast("byte").alias("op"), *weight)


def osm_history(nodes: DataFrame, ways: DataFrame, weighted: bool = False, merge: bool = False) -> tuple[DataFrame, DataFrame]:
    """A road network's log (src, dst, ts, op[, weight]) over all versions of its ways, vertices numbered by first appearance; and the dictionary."""
    found = history(ways, crossings(ways, merge), nodes if weighted else None)
    rows = assign_step(found, ("ts", "u", "v", "op"), "row").withColumnsRenamed({"u": "src", "v": "dst"})
    return encode(rows, "first_seen_interleaved")


def osm_static(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points (k, id, lon, lat) numbered by id, weighted pairs (u, v, w) by number, and the ratios of straight distance to length.

    `edges` are (source, target, length); an end without a place is an error.
    """
    points = assign_step(nodes.select("id", "lon", "lat"), ("id",), "n").select((F.col("n") - 1).alias("k"), "id", "lon", "lat")
    end = lambda c, n: points.select(F.col("id").alias(c), F.col("k").alias(n), F.struct("lat", "lon").alias(f"{n}_at"))
    placed = edges.select("source", "target", "length").join(end("source", "u"), "source", "left").join(end("target", "v"), "target", "left")
    told = lambda c: F.coalesce(c, F.raise_error(F.lit("an edge's end has no place")).cast("long")).alias(c)
    pairs = placed.select(told("u"), told("v"), F.col("length").alias("w"), "u_at", "v_at")
    ratio = haversine(F.col("u_at.lat"), F.col("u_at.lon"), F.col("v_at.lat"), F.col("v_at.lon"), 6_371_007.181) / F.col("w")
    ratios = pairs.select(F.when(F.col("w") != 0, ratio).alias("r")).agg(F.min("r").alias("least"), F.max("r").alias("most"), F.avg("r").alias("mean"))
    return points, pairs.select("u", "v", "w"), ratios
