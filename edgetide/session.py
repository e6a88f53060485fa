"""Session helpers shared by every operator: table paths, checkpoints, code shipping."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, by Spark's own reader (any store it can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one the cluster names, or else, on one machine only, a temporary one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="edgetide-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for the Arrow functions."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    path = os.path.join(tempfile.mkdtemp(prefix="edgetide-code-"), "edgetide_code.zip")
    Path(path).write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


_COMPILED: dict[tuple[str, str], JavaObject] = {}


def compiled(spark: SparkSession, name: str, source: str) -> JavaObject:
    """The one class of a Java source, for loops that are too hot for Python: compiled by Spark's own compiler, sent to the executors once per application."""
    sc = spark.sparkContext
    if (sc.applicationId, name) not in _COMPILED:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(sc._jsc.getClass().getClassLoader())
        compiler.cook(source)
        path = os.path.join(tempfile.mkdtemp(prefix="edgetide-code-"), f"{name}.jar")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for k, code in dict(compiler.getBytecodes()).items():
                z.writestr(f"{k.replace('.', '/')}.class", bytes(code))
        sc._jsc.addJar(path)
        _COMPILED[sc.applicationId, name] = compiler.getClassLoader().loadClass(name)
    return _COMPILED[sc.applicationId, name]


def map_compiled(df: DataFrame, name: str, source: str, arguments: list[int], schema: str) -> DataFrame:
    """`df` through a compiled class that is a MapPartitionsFunction of rows."""
    sc = df.sparkSession.sparkContext
    values = sc._gateway.new_array(sc._jvm.java.lang.Object, len(arguments))
    for i, x in enumerate(arguments):
        values[i] = sc._jvm.java.lang.Long.valueOf(str(x))
    function = compiled(df.sparkSession, name, source).getConstructors()[0].newInstance(values)
    encoder = sc._jvm.org.apache.spark.sql.Encoders.row(sc._jvm.org.apache.spark.sql.types.StructType.fromDDL(schema))
    return DataFrame(df._jdf.mapPartitions(function, encoder), df.sparkSession)


ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bounds for the Arrow batches handed to Python workers, where the session states none.
BOUNDS = {ROWS: "1000", BYTES: "16m"}


def bound_arrow(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and by bytes; what the session's user has set stays."""
    for key, value in BOUNDS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of so many rows for the jobs that run within; the session's settings come back afterwards."""
    before = spark.conf.get(ROWS, None)
    spark.conf.set(ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(ROWS) if before is None else spark.conf.set(ROWS, before)
