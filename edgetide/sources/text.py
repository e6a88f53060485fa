"""Text logs: edges, columns, delimited files, adjacency lists, strict update files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.operators.dictionary import encode
from edgetide.sources.packed import read_bin, read_legacy


#: The order of lines: files by name, and within a file as they stand, however it was split.
LINE_ORDER = ("file", "block", "at")


def ordered_lines(spark: SparkSession, path: str | list[str], line_sep: str | None = None) -> DataFrame:
    """Lines (value) with LINE_ORDER; a task reads a block of a file in its order."""
    reader = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def _tokens(spark: SparkSession, path: str | list[str], comment: str | None = None) -> DataFrame:
    lines = spark.read.text(path).withColumn("line", F.trim(F.regexp_replace("value", r"[\t\r]", " "))).where("line <> ''")
    if comment:
        lines = lines.where(~F.col("line").startswith(comment))
    return lines.select(F.split("line", r"\s+").alias("t"))


def read_edges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`src dst ts` with numeric ids; white space between them."""
    return _tokens(spark, path).select(*(F.get("t", F.lit(i)).cast("long").alias(c) for i, c in enumerate(("src", "dst", "ts"))))


def read_edges_str(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """`key key ts`; keys become dense ids by first appearance, row by row. Returns the log and its dictionary."""
    raw = _tokens(spark, path).select(F.get("t", F.lit(0)).alias("src"), F.get("t", F.lit(1)).alias("dst"), F.get("t", F.lit(2)).cast("long").alias("ts"))
    return encode(raw.withColumn("row", F.monotonically_increasing_id()), "first_seen_interleaved")


def read_columns(spark: SparkSession, path: str | list[str], src: int, dst: int, ts: int | None = None, comment: str = "%") -> DataFrame:
    """Chosen columns of a text of N columns; lines that begin with the comment mark are skipped."""
    at = lambda i: F.get("t", F.lit(i))
    return _tokens(spark, path, comment).select(at(src).alias("src"), at(dst).alias("dst"), *([at(ts).cast("long").alias("ts")] if ts is not None else []))


def read_csv(spark: SparkSession, path: str, sep: str | None = None, names: tuple[str, ...] = ("src", "dst", "timestamp", "info")) -> DataFrame:
    """A delimited file. Its first line is a header if its first field is no number; else columns are named by position. No `sep`: white space."""
    first = spark.read.text(path).first()
    if first is None:
        return spark.createDataFrame([], ", ".join(f"{n} string" for n in names))
    split = r"\s+" if sep is None else "\\Q" + sep + "\\E"
    fields = first.value.strip().split(sep)
    try:
        float(fields[0])
        header, columns = False, [names[i] if i < len(names) else f"c{i}" for i in range(len(fields))]
    except ValueError:
        header, columns = True, [f.strip() for f in fields]
    if sep is not None and len(sep) == 1:
        return spark.read.csv(path, header=header, sep=sep).toDF(*columns)
    rows = spark.read.text(path).where(F.trim("value") != "")
    if header:
        rows = rows.where(F.col("value") != first.value)
    return rows.select(F.split(F.trim("value"), split).alias("t")).select(*(F.get("t", F.lit(i)).alias(c) for i, c in enumerate(columns)))


def read_adj(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """An adjacency list: the word AdjacencyGraph, n, m, n offsets, m destinations. Times are drawn from 0 to m.

    Lines are numbered by a distributed pass; an edge's source is found by
    spreading each vertex's range of places, not by a range join.
    """
    from edgetide.operators.steps import assign_step

    lines = ordered_lines(spark, path).where(F.trim("value") != "")
    numbered = assign_step(lines, LINE_ORDER, "no").select((F.col("no") - 1).alias("no"), F.trim("value").alias("value"))
    head = {r.no: r.value for r in numbered.where("no < 3").collect()}
    if head.get(0) != "AdjacencyGraph":
        raise ValueError("not an adjacency list")
    n, m = int(head[1]), int(head[2])
    if numbered.count() != n + m + 3:
        raise ValueError("an adjacency list of the wrong length")
    offsets = numbered.where((F.col("no") >= 3) & (F.col("no") < n + 3)).select((F.col("no") - 3).alias("src"), F.col("value").cast("long").alias("o"))
    ends = offsets.select((F.col("src") - 1).alias("src"), F.col("o").alias("e"))
    spread = offsets.join(ends, "src", "left").select("src", F.col("o"), F.coalesce("e", F.lit(m)).alias("e")).where("o < e").select("src", F.explode(F.sequence("o", F.col("e") - 1)).alias("place"))
    targets = numbered.where(F.col("no") >= n + 3).select((F.col("no") - n - 3).alias("place"), F.col("value").cast("long").alias("dst"))
    drawn = F.floor(F.abs(F.xxhash64(F.lit(seed), "place") % F.lit(m + 1))).cast("long")
    return spread.join(targets, "place").select("src", "dst", drawn.alias("ts"))


def read_updates_csv(spark: SparkSession, path: str | list[str]) -> tuple[dict, DataFrame]:
    """A first line `V,E,N`, then `u,v,ts,insert|delete|modify[,weight]`; modify is skipped, anything else out of range is an error."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), ",").alias("t"))
    head = rows.where(F.size("t") == 3).first()
    if head is None:
        raise ValueError("no header line")
    v, e, n = map(int, head.t)
    at = lambda i: F.get("t", F.lit(i))
    number = lambda i, name: F.coalesce(at(i).try_cast("long"), F.raise_error(F.concat(F.lit(f"bad {name}: "), F.coalesce(at(i), F.lit("none")))).cast("long"))
    in_range = lambda c: F.when((c >= 0) & (c < 1 << 32), c).otherwise(F.raise_error(F.lit("a value beyond unsigned 32 bits")).cast("long"))
    op = F.when(F.lower(at(3)) == "insert", 0).when(F.lower(at(3)) == "delete", 1).when(F.lower(at(3)) == "modify", 2).otherwise(F.raise_error(F.lit("an unknown operation")).cast("int"))
    log = rows.where(F.size("t") != 3).select(in_range(number(0, "source")).alias("src"), in_range(number(1, "destination")).alias("dst"), in_range(number(2, "time")).alias("ts"), op.cast("byte").alias("op"), at(4).try_cast("double").alias("weight"))
    return {"num_vertices": v, "num_unique_edges": e, "total_updates": n}, log.where("op <> 2")


def read_graph(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:  # noqa: A002, ANN003
    """A log by its format; by its name where none is given: `...bin` is packed, others are edges."""
    from edgetide.sources import generators

    kind = format or ("edges_bin" if path.endswith("bin") else "edges")
    if kind == "edges":
        return read_edges(spark, path)
    if kind == "edges_bin":
        return read_bin(spark, path, **options)
    if kind in ("legacy12", "legacy16"):
        return read_legacy(spark, path, kind)
    if kind == "adj":
        return read_adj(spark, path, **options)
    if kind in ("adj_rmat", "adj_er", "adj_ws"):
        base = read_adj(spark, path)
        n, m = (base.selectExpr("max(greatest(src, dst)) + 1", "count(*)").first() or (0, 0))
        made = {"adj_rmat": lambda: generators.gen_rmat(spark, n, m, **options), "adj_er": lambda: generators.gen_er(spark, n, m / max(1, n * n), **options), "adj_ws": lambda: generators.gen_ws(spark, n, max(1, m // max(1, n)), **options)}
        return base.unionByName(made[kind]())
    if kind in ("rmat", "er", "ws"):
        return getattr(generators, f"gen_{kind}")(spark, **options)
    if kind == "columns":
        return read_columns(spark, path, **options)
    if kind == "updates_csv":
        return read_updates_csv(spark, path)[1]
    raise ValueError(f"unknown format {kind}")


def write_edges(log: DataFrame, path: str, sep: str = "\t") -> None:
    """src, dst, ts lines without a header, a file a partition."""
    log.select("src", "dst", "ts").write.csv(path, sep=sep)


def write_adj(log: DataFrame, path: str, n: int) -> None:
    """An adjacency list of the distinct pairs: counts, offsets by running sum, then destinations in order."""
    from edgetide.plans.running import running

    pairs = log.select("src", "dst").distinct()
    counts = log.sparkSession.range(n).select(F.col("id").alias("k")).join(pairs.groupBy(F.col("src").alias("k")).agg(F.count("*").alias("c")), "k", "left").fillna(0)
    m = pairs.count()
    offsets = running(counts.withColumn("o", F.col("c")), ("o",)).select(F.lit(1).alias("part"), F.col("k").alias("a"), F.lit(0).cast("long").alias("b"), (F.col("o") - F.col("c")).cast("string").alias("value"))
    spark = log.sparkSession
    head = spark.createDataFrame([(0, 0, 0, "AdjacencyGraph"), (0, 1, 0, str(n)), (0, 2, 0, str(m))], "part int, a long, b long, value string")
    body = pairs.select(F.lit(2).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("dst").cast("string").alias("value"))
    head.unionAll(offsets).unionAll(body).repartitionByRange("part", "a", "b").sortWithinPartitions("part", "a", "b").select("value").write.text(path)


def write_weighted_adj(pairs: DataFrame, path: str, n: int) -> None:
    """WeightedAdjacencyGraph lines of (u, v, w) over ids 0 to n - 1: counts, offsets, destinations, weights."""
    from edgetide.plans.running import running

    spark = pairs.sparkSession
    counts = spark.range(n).select(F.col("id").alias("k")).join(pairs.groupBy(F.col("u").alias("k")).agg(F.count("*").alias("c")), "k", "left").fillna(0)
    offsets = running(counts.withColumn("o", F.col("c")), ("o",)).select(F.lit(1).alias("part"), F.col("k").alias("a"), F.lit(0).cast("long").alias("b"), (F.col("o") - F.col("c")).cast("string").alias("value"))
    head = spark.createDataFrame([(0, 0, 0, "WeightedAdjacencyGraph"), (0, 1, 0, str(n)), (0, 2, 0, str(pairs.count()))], "part int, a long, b long, value string")
    cells = lambda part, c: pairs.select(F.lit(part).alias("part"), F.col("u").alias("a"), F.col("v").alias("b"), F.col(c).cast("string").alias("value"))
    head.unionAll(offsets).unionAll(cells(2, "v")).unionAll(cells(3, "w")).repartitionByRange("part", "a", "b").sortWithinPartitions("part", "a", "b").select("value").write.text(path)


def write_points(points: DataFrame, path: str) -> None:
    """pbbs_sequencePoint2d lines: `lon lat` of each point in the order of k."""
    head = points.sparkSession.createDataFrame([(-1, "pbbs_sequencePoint2d")], "k long, value string")
    body = points.select("k", F.concat_ws(" ", F.col("lon").cast("string"), F.col("lat").cast("string")).alias("value"))
    head.unionAll(body).repartitionByRange("k").sortWithinPartitions("k").select("value").write.text(path)
