"""Arrow plumbing of the operators: one Python call per bounded batch of whole rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.session import bound_arrow, ship


def place(docs: DataFrame, name: str) -> int:
    """Where a column stands: the one of exactly this name, or else one that differs by case only."""
    names = docs.columns
    return names.index(name) if name in names else [n.lower() for n in names].index(name.lower())


def pick(docs: DataFrame, **wanted: tuple[str, str]) -> DataFrame:
    """New name = (column, type) of each column wanted. Others are pruned; names that differ by case only don't clash."""
    plain = [f"edgetide_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*plain).select(*(F.col(plain[place(docs, c)]).cast(t).alias(n) for n, (c, t) in wanted.items()))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns every text operator reads."""
    return pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A batch's texts; null reads as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def map_batches(docs: DataFrame, factory: Callable[[], Callable[[list[str]], list[tuple]]], fields: list[tuple[str, str, pa.DataType]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and, for each text, the tuple that the batch function makes of it.

    The factory runs once per task, so models and compiled patterns are
    loaded once; memory is bounded by the Arrow batch.
    """
    spark = docs.sparkSession
    ship(spark)
    bound_arrow(spark)
    names = [n for n, _, _ in fields]
    arrow = pa.schema([("doc_id", pa.int64()), *((n, t) for n, _, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = factory()
        for batch in batches:
            columns = list(zip(*rows_of(texts(batch)), strict=True)) or [()] * len(names)
            arrays = [batch.column(0), *(pa.array(c, type=arrow.field(n).type) for n, c in zip(names, columns, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, ", ".join(["doc_id long", *(f"{n} {s}" for n, s, _ in fields)]))


def map_texts(docs: DataFrame, factory: Callable[[], Callable[[str], tuple]], fields: list[tuple[str, str, pa.DataType]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As map_batches, by a function of one text."""

    def batched() -> Callable[[list[str]], list[tuple]]:
        row = factory()
        return lambda texts: [row(t) for t in texts]

    return map_batches(docs, batched, fields, id_col, text_col)


def filter_rows(docs: DataFrame, mask_factory: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows of `docs`, all columns kept, where the mask, by columns' places, is true; no join, so repeated rows and null ids survive."""
    spark = docs.sparkSession
    ship(spark)
    bound_arrow(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = mask_factory()
        for batch in batches:
            yield batch.filter(pa.array(mask(batch), type=pa.bool_()))

    plain = docs.toDF(*(f"edgetide_{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def least_hashed(rows: DataFrame, column: str, bound: int) -> DataFrame:
    """The `bound` rows whose `column` has the least hash, ties by its value. `rows` is read twice, but of many rows only a few times `bound` are sorted."""
    h, n = F.xxhash64(column), rows.count()
    if n > 16 * bound:
        few = rows.where(h < F.lit(int(-(2**63) + 2**64 * (8 * bound / n))))
        rows = few if few.limit(bound).count() == bound else rows
    return rows.orderBy(h, column).limit(bound)
