"""The packed log: a 32-byte header and rows without padding, little-endian; and its headerless forebears."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from edgetide.model import CODES, HEADER_BYTES, TYPES, Header
from edgetide.sources.paths import file_size, local, read_bytes, shared_path
from edgetide.session import checkpoint, ship

ROWS_A_PARTITION = 4_000_000
ROWS_A_BATCH = 65_536
#: Headerless layouts, all unsigned 32-bit; the flag of legacy16 is 1 for an insertion.
LEGACY = {"legacy12": [("src", "<u4"), ("dst", "<u4"), ("ts", "<u4")], "legacy16": [("flag", "<u4"), ("src", "<u4"), ("dst", "<u4"), ("ts", "<u4")]}


class Range(InputPartition):
    def __init__(self, first: int, rows: int):
        self.first, self.rows = first, rows


class PackedReader(DataSourceReader):
    """Row ranges of a file; each task maps only its own bytes, and only the columns asked for are decoded."""

    def __init__(self, schema, options: dict):  # noqa: ANN001
        self.names = schema.fieldNames()
        self.path, self.skip, self.total = options["path"], int(options["skip"]), int(options["rows"])
        self.fields = [tuple(f.split(":")) for f in options["fields"].split(",")]

    def partitions(self) -> list[Range]:
        return [Range(k, min(ROWS_A_PARTITION, self.total - k)) for k in range(0, self.total, ROWS_A_PARTITION)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(self.fields)
        if not partition.rows:
            return
        rows = np.memmap(local(self.path), dtype=kind, mode="r", offset=self.skip + partition.first * kind.itemsize, shape=(partition.rows,))
        for at in range(0, partition.rows, ROWS_A_BATCH):
            part = rows[at : at + ROWS_A_BATCH]
            columns = []
            for name in self.names:
                if name == "row":
                    columns.append(pa.array(np.arange(partition.first + at, partition.first + at + len(part))))
                elif part[name].dtype.kind == "f":
                    columns.append(pa.array(part[name].astype(np.float64)))
                elif part[name].dtype == np.uint64 and len(part) and int(part[name].max()) >= 1 << 63:
                    raise ValueError(f"{name} exceeds the range of long")
                else:
                    columns.append(pa.array(part[name].astype(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=self.names)


class PackedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edgetide_packed"

    def schema(self) -> str:
        kinds = dict(f.split(":") for f in self.options["fields"].split(","))
        wanted = self.options.get("columns") or ",".join([*kinds, "row"])
        return ", ".join(f"{c} {'double' if kinds.get(c, '')[1:2] == 'f' else 'long'}" for c in wanted.split(","))

    def reader(self, schema) -> PackedReader:  # noqa: ANN001
        return PackedReader(schema, dict(self.options))

    def writer(self, schema, overwrite: bool) -> PackedWriter:  # noqa: ANN001
        return PackedWriter(schema, dict(self.options))


class Done(WriterCommitMessage):
    def __init__(self, rows: int):
        self.rows = rows


def packed_rows(batch: pa.RecordBatch, fields: list[tuple[str, str]]) -> np.ndarray:
    """A batch as packed rows; a null or a value beyond its field's type is an error."""
    out = np.empty(batch.num_rows, dtype=np.dtype(fields))
    for name, kind in fields:
        column = batch.column(batch.schema.get_field_index(name))
        if column.null_count:
            raise ValueError(f"{name} has nulls")
        values = column.to_numpy(zero_copy_only=False)
        if kind[1] != "f" and len(values) and (values.min() < np.iinfo(kind).min or values.max() > np.iinfo(kind).max):
            raise ValueError(f"{name} exceeds the range of {kind[1:]}")
        out[name] = values
    return out


class PackedWriter(DataSourceArrowWriter):
    """Rows have one width, so each task writes its own stretch of the one file; a task that runs again writes the same bytes.

    `starts` are the partitions' first rows, then the number of all rows. The
    file must be on a mount that all machines share; it bears another name until
    all of it is there.
    """

    def __init__(self, schema, options: dict):  # noqa: ANN001
        self.fields = [tuple(f.split(":")) for f in options["fields"].split(",")]
        self.starts = [int(x) for x in options["starts"].split(",")]
        self.head = bytes.fromhex(options["head"])
        self.target, self.path = local(options["path"]), f"{local(options['path'])}.{options['run']}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        from pyspark import TaskContext

        k, width, rows = TaskContext.get().partitionId(), np.dtype(self.fields).itemsize, 0
        with open(self.path, "r+b") as f:
            f.seek(len(self.head) + self.starts[k] * width)
            for batch in iterator:
                f.write(packed_rows(batch, self.fields).tobytes())
                rows += batch.num_rows
        if self.starts[k] + rows != self.starts[k + 1]:
            raise ValueError(f"partition {k} has {rows} rows, not {self.starts[k + 1] - self.starts[k]}")
        return Done(rows)

    def commit(self, messages: list[Done]) -> None:
        os.replace(self.path, self.target)

    def abort(self, messages: list) -> None:
        if os.path.exists(self.path):
            os.remove(self.path)


def _fields(fields: list[tuple[str, str]]) -> str:
    return ",".join(f"{n}:{k}" for n, k in fields)


def _load(spark: SparkSession, path: str, fields: list[tuple[str, str]], skip: int, rows: int, columns: list[str] | None) -> DataFrame:
    ship(spark)
    spark.dataSource.register(PackedSource)
    reader = spark.read.format("edgetide_packed").option("fields", _fields(fields)).option("skip", skip).option("rows", rows)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)


def read_header(spark: SparkSession, path: str) -> Header:
    """The header of a packed log; ValueError where the file is too short for one."""
    if file_size(spark, path) < HEADER_BYTES:
        raise ValueError(f"{path} has no header of {HEADER_BYTES} bytes")
    return Header.unpack(read_bytes(spark, path, HEADER_BYTES))


def read_bin(spark: SparkSession, path: str, insert_code: int = 0, columns: list[str] | None = None) -> DataFrame:
    """The rows of a packed log with their row number. No stored time: the row number; no weight: 1; a signal: all inserted."""
    head = read_header(spark, path)
    fields = head.fields()
    stored = [n for n, _ in fields]
    wanted = columns or ["row", "src", "dst", "ts", "weight", "op"]
    raw = _load(spark, path, fields, HEADER_BYTES, head.total_updates, [c for c in stored if c in wanted] + ["row"])
    defaults = {"ts": F.col("row"), "weight": F.lit(1.0), "op": F.lit(0)}
    out = {c: F.col(c) if c in stored or c == "row" else defaults[c] for c in wanted}
    if "op" in wanted and not head.signal:
        out["op"] = F.when(F.col("op") == insert_code, 0).otherwise(1)
    casts = {"op": "byte", "weight": "double"}
    if "ts" in wanted and head.timestamp_type in (30, 31):
        casts["ts"] = "double"
    return raw.select(*(e.cast(casts.get(c, "long")).alias(c) for c, e in out.items()))


def read_legacy(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """A headerless log; legacy16 has an op of 0 where its flag is 1."""
    fields = LEGACY[layout]
    size = file_size(spark, path)
    row = sum(int(k[2:]) for _, k in fields)
    if size % row:
        raise ValueError(f"{path} is no whole number of rows of {row} bytes")
    raw = _load(spark, path, fields, 0, size // row, None)
    return raw.withColumn("op", F.when(F.col("flag") == 1, 0).otherwise(1).cast("byte")).drop("flag") if layout == "legacy16" else raw


def write_legacy(df: DataFrame, path: str, layout: str, order: list[str]) -> None:
    """Write a headerless log, rows in the given order."""
    _save(df.withColumn("flag", F.lit(1) - F.col("op")) if layout == "legacy16" else df, path, LEGACY[layout], b"", order)


def _save(df: DataFrame, path: str, fields: list[tuple[str, str]], head: bytes, order: list[str]) -> None:
    ship(df.sparkSession)
    df.sparkSession.dataSource.register(PackedSource)
    rows = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).select(*(n for n, _ in fields)))
    # One number a partition; a checkpoint is read by the partitions that wrote it.
    counts = {r.k: r.n for r in rows.groupBy(F.spark_partition_id().alias("k")).agg(F.count("*").alias("n")).collect()}
    starts = [0, *accumulate(counts.get(k, 0) for k in range(max(1, rows.rdd.getNumPartitions())))]  # an empty frame is written by one task
    run = uuid.uuid4().hex[:12]
    with open(f"{local(path)}.{run}", "wb") as f:
        f.write(head)
        f.truncate(len(head) + starts[-1] * np.dtype(fields).itemsize)
    options = {"fields": _fields(fields), "head": head.hex(), "starts": ",".join(map(str, starts)), "run": run}
    rows.write.format("edgetide_packed").options(**options).mode("append").save(path)


def counted(df: DataFrame) -> tuple[int, int, int]:
    """Vertices, directed pairs and rows, by one aggregation."""
    none = F.lit(None).cast(df.schema["dst"].dataType)
    kinds = F.struct(F.lit(1).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")), *(F.struct(F.lit(0).alias("kind"), F.col(c).alias("a"), none.alias("b")) for c in ("src", "dst"))
    each = df.select(F.explode(F.array(*kinds)).alias("x")).groupBy("x.kind", "x.a", "x.b").agg(F.count("*").alias("n"))
    found = {r.kind: (r.n, r.rows) for r in each.groupBy("kind").agg(F.count("*").alias("n"), F.sum("n").alias("rows")).collect()}
    return found.get(0, (0, 0))[0], *found.get(1, (0, 0))


def write_bin(df: DataFrame, path: str, *, directed: bool = True, signal: bool | None = None, vertex_id_type: str = "uint32", timestamp_type: str = "uint32", weight_type: str = "none", order: list[str] | None = None) -> Header:
    """Write a log (src, dst, ts[, weight][, op]) with its header; rows go by `order`, or by time, source and destination."""
    signal = "op" not in df.columns if signal is None else signal
    needs = {"ts": timestamp_type, "weight": weight_type}
    for c, kind in needs.items():
        if kind != "none" and c not in df.columns:
            raise ValueError(f"a {c} of type {kind} is asked for, but there is no column {c}")
    if not signal and "op" not in df.columns:
        raise ValueError("an update log needs a column op")
    ends, edges, rows = counted(df)
    head = Header(ends, edges, rows, signal, CODES[vertex_id_type], CODES[timestamp_type], directed, CODES[weight_type])
    if TYPES[head.vertex_id_type][1] == 0:
        raise ValueError("vertex ids need a type")
    _save(df, path, head.fields(), head.pack(), order or [c for c in ("ts", "src", "dst") if c in df.columns])
    return head


__all__ = ["read_bin", "read_header", "read_legacy", "shared_path", "write_bin", "write_legacy"]
