"""Raw dumps by Spark's own readers: JSON lines, XML, tagged text, commit logs, map extracts."""

from __future__ import annotations

import lzma
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.operators.steps import assign_step
from edgetide.plans.running import running
from edgetide.session import arrow_batches, checkpoint, ship
from edgetide.sources.text import LINE_ORDER, ordered_lines

PAPER = "id string, year long, venue_id string, authors array<struct<id:string,org_id:string>>, references array<string>"
COMMENT = "author string, subreddit string, created_utc long"
WIKI_PAGE = "title string, revision array<struct<timestamp:string,text:string>>"
ARTICLE = "author array<string>, title string, year string"


def xz_lines(spark: SparkSession, path: str | list[str], rows: int = 10_000) -> DataFrame:
    """(value) of each line of xz files. Spark has no codec for them: a file's packed bytes (2 GB at most) are one task's, unpacked as a stream."""
    ship(spark)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with lzma.open(pa.BufferReader(content.as_buffer())) as f:
                    while lines := list(islice(f, rows)):
                        yield pa.RecordBatch.from_arrays([pa.array([x.rstrip(b"\r\n").decode("utf-8", "replace") for x in lines])], names=["value"])

    with arrow_batches(spark, rows=1):
        return checkpoint(spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "value string"))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines; gz, bz2 and zst files are read as such, xz files by `xz_lines`. A line that is no JSON gives nulls."""
    paths = [path] if isinstance(path, str) else path
    packed = [p for p in paths if p.endswith(".xz")]
    plain = [p for p in paths if not p.endswith(".xz")]
    parts = [spark.read.schema(schema).json(plain)] if plain else []
    if packed:
        parts.append(xz_lines(spark, packed).where("trim(value) <> ''").select(F.from_json("value", schema).alias("r")).select("r.*"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_xml(spark: SparkSession, path: str | list[str], row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).option("timestampFormat", "").schema(schema).load(path)


def read_tagged_text(spark: SparkSession, path: str) -> DataFrame:
    """Blocks that start at #index: (no, index, title, year, authors, refs), numbered in their order; the last block counts too."""
    blocks = ordered_lines(spark, path, "#index").where(F.trim(F.translate("value", "\n\r", "")) != "")
    lines = F.transform(F.split("value", "\n"), lambda x: F.trim(x))
    tagged = lambda tag: F.transform(F.filter("lines", lambda x: x.startswith(tag)), lambda x: F.trim(F.substr(x, F.lit(len(tag) + 1))))
    parsed = blocks.withColumn("lines", lines).select(
        *LINE_ORDER,
        F.get("lines", F.lit(0)).alias("index"),
        F.get(tagged("#*"), F.lit(0)).alias("title"),
        F.get(tagged("#t"), F.lit(0)).alias("year"),
        F.flatten(F.transform(tagged("#@"), lambda x: F.transform(F.split(x, ";"), lambda y: F.trim(y)))).alias("authors"),
        tagged("#%").alias("refs"),
    )
    return assign_step(parsed, LINE_ORDER, "no").drop(*LINE_ORDER)


def read_gitlog(spark: SparkSession, path: str) -> DataFrame:
    """(commit, author, date, files) of `hash|author|date` lines, each followed by file names; a file belongs to the commit line before it."""
    lines = assign_step(ordered_lines(spark, path), LINE_ORDER, "at").withColumn("head", F.col("value").contains("|"))
    # The running count of commit lines goes by blocks of lines: no task sees all of them.
    numbered = running(lines.select("at", "value", "head", F.col("head").cast("int").alias("commit")), ("commit",), key="at")
    fields = F.split("value", r"\|", 3)
    heads = numbered.where("head").select("commit", fields[0].alias("hash"), fields[1].alias("author"), fields[2].alias("date"))
    files = numbered.where("not head and trim(value) <> ''").groupBy("commit").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.trim("value").alias("f")))), lambda x: x["f"]).alias("files"))
    return heads.join(files, "commit", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))


def read_osm_csv(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """nodes.csv (id, lon, lat) and edges.csv (id, source, target, length, ...) of a road extract."""
    nodes = spark.read.csv(f"{folder}/nodes.csv", header=True, schema="id long, lon double, lat double")
    return nodes, spark.read.csv(f"{folder}/edges.csv", header=True, schema="id string, source long, target long, length double")


def read_osm(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A full history extracted to Parquet: nodes (id, lat, lon), ways (id, version, timestamp, visible, nodes, tags)."""
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/ways")
