"""Structured Streaming forms of the log operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from edgetide.session import ship
from edgetide.sources.paths import shared_path


def run_to_end(stream: DataFrame, mode: str, schema: str) -> DataFrame:
    """Run a stream over all that is there and return what it wrote. Batches go to folders by number, so a repeated batch replaces itself."""
    spark = stream.sparkSession
    out = shared_path(spark, "stream-out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", shared_path(spark, "stream-state")).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    found = spark.read.schema(schema + ", batch long").parquet(out) if _there(spark, out) else spark.createDataFrame([], schema + ", batch long")
    if mode == "complete":
        last = found.agg(F.max("batch")).first()[0]
        found = found.where(F.col("batch") == last) if last is not None else found
    return found.drop("batch")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_arrival(log: DataFrame) -> DataFrame:
    """The first row of each unordered pair, in the order of arrival; state is one key a pair."""
    pairs = log.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    return pairs.dropDuplicates(["u", "v"])


def session_windows(log: DataFrame, window: int, delay: str = "0 seconds") -> DataFrame:
    """(src, dst, start, end, events): the spans over which each directed pair stays alive; an event at a span's end extends it."""
    timed = log.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", delay)
    spans = timed.groupBy("src", "dst", F.session_window("at", f"{window} seconds").alias("s")).agg(F.count("*").alias("events"))
    return spans.select("src", "dst", F.unix_seconds("s.start").alias("start"), F.unix_seconds("s.end").alias("end"), "events")


#: Groups of state that the pairs of `ttl_updates` are dealt to.
BUCKETS = 4096


def ttl_updates(log: DataFrame, window: int, delay: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """(src, dst, op, ts): insertions and deletions of pairs that live for `window` after each event, by event-time timeouts.

    A group of state holds many pairs, 32 bytes each, so that one call settles
    them by whole columns; its timeout is that of its first pair to end. `buckets`
    must stay the same over restarts. Rows without a time are left out.
    """
    ship(log.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.frombuffer(state.get[0], dtype=np.int64).reshape(-1, 4) if state.exists else np.empty((0, 4), dtype=np.int64)
        rows = np.concatenate([held, *([] if state.hasTimedOut else [b[["nulls", "src", "dst", "ts"]].to_numpy(dtype=np.int64) for b in batches])])
        old = np.arange(len(rows)) < len(held)
        order = np.lexsort((rows[:, 3], ~old, rows[:, 2], rows[:, 1], rows[:, 0]))  # of each pair what is held, then its events
        rows, old = rows[order], old[order]
        pairs, first = rows[:, :3], np.ones(len(rows), dtype=bool)
        first[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
        start = np.flatnonzero(first)[np.cumsum(first) - 1]
        upto = np.where(old[start], np.maximum(rows[:, 3], rows[start, 3]), rows[:, 3])  # an event may be older than what is held
        ends = np.concatenate([upto[:1], upto[:-1]]) + window
        ended = ~first & (ends < rows[:, 3])
        begun = ended | (first & ~old)
        final = np.concatenate([first[1:], np.ones(min(1, len(rows)), dtype=bool)])
        mark = state.getCurrentWatermarkMs()
        due = final & ((upto + window) * 1000 < mark)
        kept = final & ~due
        if kept.any():
            state.update((np.column_stack([pairs, upto])[kept].tobytes(),))
            state.setTimeoutTimestamp(max((int(upto[kept].min()) + window) * 1000, mark + 1))
        elif state.exists:
            state.remove()
        made = np.concatenate([pairs[ended], pairs[begun], pairs[due]])
        end = lambda c, bit: pd.arrays.IntegerArray(made[:, c].copy(), made[:, 0] & bit != 0)
        op = np.repeat(np.array([1, 0, 1], dtype=np.int32), [ended.sum(), begun.sum(), due.sum()])
        if len(made):
            yield pd.DataFrame({"src": end(1, 1), "dst": end(2, 2), "op": op, "ts": np.concatenate([ends[ended], rows[begun, 3], upto[due] + window])})

    timed = log.where("ts is not null").withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", delay)
    keyed = timed.withColumn("nulls", F.expr("if(src is null, 1L, 0L) + if(dst is null, 2L, 0L)")).withColumn("bucket", F.pmod(F.xxhash64("src", "dst"), F.lit(buckets)))
    keyed = keyed.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("src", "dst")}).withColumn("ts", F.col("ts").cast("long"))
    return keyed.groupBy("bucket").applyInPandasWithState(step, "src long, dst long, op int, ts long", "pairs binary", "append", GroupStateTimeout.EventTimeTimeout)


def batch_stats(log: DataFrame) -> DataFrame:
    """(batch, updates, num_edges): after each micro-batch, the rows and distinct pairs so far.

    The pairs seen are a table of folders by batch number; a batch looks only
    for pairs that are not in earlier folders, so repeating it changes nothing.
    """
    spark = log.sparkSession
    pairs_at, rows_at = shared_path(spark, "stream-pairs"), shared_path(spark, "stream-rows")
    schema = "u long, v long, batch long"

    def keep(batch: DataFrame, number: int) -> None:
        pairs = batch.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
        if _there(spark, pairs_at):
            pairs = pairs.join(spark.read.schema(schema).parquet(pairs_at).where(F.col("batch") < number), ["u", "v"], "left_anti")
        pairs.write.mode("overwrite").parquet(f"{pairs_at}/batch={number:09d}")
        batch.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{rows_at}/batch={number:09d}")

    query = log.writeStream.option("checkpointLocation", shared_path(spark, "stream-state")).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    pairs = spark.read.schema(schema).parquet(pairs_at).groupBy("batch").agg(F.count("*").alias("e"))
    rows = spark.read.schema("n long, batch long").parquet(rows_at)
    from edgetide.plans.running import running

    both = rows.join(pairs, "batch", "left").select(F.col("batch").alias("k"), F.col("n").alias("updates"), F.coalesce("e", F.lit(0)).alias("num_edges"))
    return running(both, ("updates", "num_edges")).withColumnRenamed("k", "batch")
