"""From raw documents to packed windows, one operator a stage.

Toxic documents go, then those the quality classifier rejects, then all but
one of each near-duplicate group; secrets are replaced in what stays, and that
is packed into windows. Every stage works on all that its predecessor kept,
and all but the last return the columns of documents.

Defined cases, in every stage: a null text reads as empty and stays null where
its row stays; long texts are read whole; repeated rows are kept or rejected
alike, but one of them stays at the near-duplicate stage, as of any group; rows
without an id take part; extra columns pass through under any name; an empty
table stays empty. `n_chars` remains what the source stated. Where there are
no labels to learn from, the quality stage keeps all, and the toxicity stage
goes by its fixed list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from edgetide.llm import packing, quality_classifier, secrets, simhash, toxicity, wordbpe
from edgetide.session import checkpoint, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of poor quality go."""
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every document stays."""
    return secrets.redact(docs, secrets.fit(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, by sequence."""
    return packing.pack(docs, wordbpe.vocabulary_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("SimHash near-duplicates", drop_copies),
    ("secrets", hide_secrets),
    ("packing", pack_windows),
]

#: Learned scores, fingerprints and tokens have no SQL; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is checkpointed, so the next reads it as written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
