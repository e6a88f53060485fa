"""From a log to its relations: total order, windows, first arrivals and alive intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from edgetide.session import checkpoint

SIGNAL_ORDER = ("ts", "src", "dst")
#: Deletes come before inserts of the same time.
UPDATE_ORDER = ("ts", "op desc", "src", "dst")


#: Up to so many partitions, their offsets are literals of an expression.
FEW_PARTITIONS = 2000


def _order(names: tuple[str, ...]) -> list:
    return [F.col(n.split()[0]).desc() if n.endswith(" desc") else F.col(n) for n in names]


def assign_step(log: DataFrame, order: tuple[str, ...] | None = None, name: str = "step") -> DataFrame:
    """`log` with its 1-based place in the total order.

    Rows are ranged over partitions and sorted there, and the result is
    checkpointed: a place is then the partition's offset and the row's place in
    it. Only the partitions' sizes reach the driver; no task sees all rows.
    """
    order = order or (UPDATE_ORDER if "op" in log.columns else SIGNAL_ORDER)
    placed = checkpoint(log.repartitionByRange(*_order(order)).sortWithinPartitions(*_order(order)))
    at = placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_at", 33))
    sizes = {r["_p"]: r["count"] for r in at.groupBy("_p").count().collect()}
    offsets, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(p, 0)
    if len(offsets) <= FEW_PARTITIONS:
        offset = F.element_at(F.array(*(F.lit(x).cast("long") for x in offsets or [0])), (F.col("_p") + 1).cast("int"))
    else:  # a row a partition, as a table: an expression of so many literals would be large in every task
        at = at.join(F.broadcast(log.sparkSession.createDataFrame(list(enumerate(offsets)), "_p long, _offset long")), "_p")
        offset = F.col("_offset")
    return at.withColumn(name, offset + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).select(*log.columns, name)


def sort_by_time(log: DataFrame, order: tuple[str, ...] | None = None) -> DataFrame:
    """The log in its total order, as a distributed sort."""
    return log.orderBy(*_order(order or (UPDATE_ORDER if "op" in log.columns else SIGNAL_ORDER)))


def limit_first_n(log: DataFrame, max_updates: int, row: str = "row") -> DataFrame:
    """The first rows as stored, by their row number in column `row`; 0 or less keeps all."""
    return log.where(F.col(row) < max_updates) if max_updates > 0 else log


def drop_self_loops(log: DataFrame) -> DataFrame:
    return log.where("src <> dst")


def canonicalize(log: DataFrame) -> DataFrame:
    """`log` with the unordered pair (u, v), u <= v."""
    return log.withColumns({"u": F.least("src", "dst"), "v": F.greatest("src", "dst")})


def arrivals(steps: DataFrame) -> DataFrame:
    """(u, v, step, src): the first row of each unordered pair; its src tells the orientation it came in."""
    pairs = canonicalize(drop_self_loops(steps))
    return pairs.groupBy("u", "v").agg(F.min(F.struct("step", "src")).alias("m")).select("u", "v", "m.step", "m.src")


def with_neighbours(df: DataFrame, keys: list[str], order: str, before: dict[str, str] | None = None, after: dict[str, str] | None = None, width: int = 1 << 20) -> DataFrame:
    """`df` with values of the row before (name: column) and after it within its key, null at the ends.

    Rows are windowed by key and block of `order`, a whole number that is
    distinct within a key, so a hot key is many groups of at most `width` rows;
    what lies across a block's edge comes from one row a key and block. Values
    must not be null.
    """
    before, after = before or {}, after or {}
    cut = df.withColumn("_block", F.expr(f"{order} div {width}"))
    w = W.partitionBy(*keys, "_block").orderBy(order)
    inner = cut.withColumns({f"_in_{n}": F.lag(c).over(w) for n, c in before.items()} | {f"_in_{n}": F.lead(c).over(w) for n, c in after.items()})
    ends = cut.groupBy(*keys, "_block").agg(*(F.max_by(c, order).alias(f"_at_{n}") for n, c in before.items()), *(F.min_by(c, order).alias(f"_at_{n}") for n, c in after.items()))
    over = W.partitionBy(*keys).orderBy("_block")
    across = ends.select(*keys, "_block", *(F.lag(f"_at_{n}").over(over).alias(f"_out_{n}") for n in before), *(F.lead(f"_at_{n}").over(over).alias(f"_out_{n}") for n in after))
    done = inner.join(across, [*keys, "_block"])
    return done.select(*df.columns, *(F.coalesce(f"_in_{n}", f"_out_{n}").alias(n) for n in (*before, *after)))


def collapse_ops(steps: DataFrame) -> DataFrame:
    """Updates whose op differs from the pair's op before; the state before the first one is deleted."""
    pairs = with_neighbours(canonicalize(drop_self_loops(steps)), ["u", "v"], "step", before={"before": "op"})
    return pairs.where("coalesce(before, 1) <> op").drop("before")


def edge_intervals(steps: DataFrame) -> DataFrame:
    """(u, v, s0, e0): the half-open intervals of steps over which each pair is alive; e0 is null while it is."""
    ops = with_neighbours(collapse_ops(steps).select("u", "v", "op", "step"), ["u", "v"], "step", after={"e0": "step"})
    return ops.where("op = 0").select("u", "v", F.col("step").alias("s0"), "e0")


def signal_to_windowed(log: DataFrame, window: int, canonicalize_before_window: bool = False) -> DataFrame:
    """(src, dst, op, ts): each interaction keeps its directed pair alive for `window`.

    An event at the very end of the last one's life extends it. The final
    deletion comes only where the life ends before the log does.
    """
    pairs = log.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "ts") if canonicalize_before_window else log.select("src", "dst", "ts")
    seen = with_neighbours(pairs.distinct(), ["src", "dst"], "ts", before={"p": "ts"}, after={"nx": "ts"})
    last = log.agg(F.max("ts").alias("last"))
    events = seen.crossJoin(F.broadcast(last))  # one row
    on = F.when(F.col("p").isNull() | (F.col("p") + window < F.col("ts")), F.struct(F.lit(0).alias("op"), F.col("ts").alias("at")))
    ends = F.col("ts") + window
    off = F.when((F.col("nx").isNotNull() & (ends < F.col("nx"))) | (F.col("nx").isNull() & (ends < F.col("last"))), F.struct(F.lit(1).alias("op"), ends.alias("at")))
    return events.select("src", "dst", F.explode(F.array_compact(F.array(on, off))).alias("e")).select("src", "dst", F.col("e.op").cast(T.ByteType()).alias("op"), F.col("e.at").alias("ts"))


def shuffle_signal(log: DataFrame, seed: int) -> DataFrame:
    """Timestamps drawn anew, uniformly between the second and the last one. Checkpointed: a draw that is made again after a loss would differ."""
    last = log.agg(F.max("ts").alias("hi"))
    second = log.select("ts").orderBy("ts").limit(2).agg(F.max("ts").alias("lo"))
    drawn = log.crossJoin(F.broadcast(second)).crossJoin(F.broadcast(last))  # single rows
    return checkpoint(drawn.withColumn("ts", F.floor(F.col("lo") + F.rand(seed) * (F.col("hi") - F.col("lo") + 1)).cast("long")).drop("lo", "hi"))


def shuffle_update(log: DataFrame, seed: int) -> DataFrame:
    """Timestamps drawn anew; each pair's updates, in the new order, are insert and delete by turns."""
    drawn = shuffle_signal(canonicalize(drop_self_loops(log)).select(F.col("u").alias("src"), F.col("v").alias("dst"), "ts"), seed)
    w = W.partitionBy("src", "dst").orderBy("ts")
    return drawn.withColumn("op", ((F.row_number().over(w) - 1) % 2).cast("byte"))


def rank_in_group(df: DataFrame, key: str, order: str, name: str, block: int = 65_536) -> DataFrame:
    """`df` with each row's 1-based place in its key's order. A hot key is ranked block by block, and the blocks' counts are summed."""
    cut = df.withColumn("_block", F.floor(F.col(order) / block))
    inner = F.row_number().over(W.partitionBy(key, "_block").orderBy(order))
    before = cut.groupBy(key, "_block").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))).drop("_n")
    return cut.withColumn("_inner", inner).join(before, [key, "_block"]).withColumn(name, (F.col("_inner") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_inner", "_before", "_block")
