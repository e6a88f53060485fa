"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgetide.llm import gif, licenses, packing, pii, quality_classifier, quality_rules, secrets, simhash, toxicity, wordbpe
from edgetide.session import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.ranks(docs))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), wordbpe.vocabulary_path())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.digest(table(spark, sf_dir, "documents"), wordbpe.vocabulary_path())


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = quality_classifier.featured(docs)
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels"), rows=rows), rows=rows)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(docs, secrets.fit(docs))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_licenses, op3_packing, op4_quality_rules, op5_simhash, op6_bpe, op7_quality_classifier, op8_secrets, op9_toxicity, op10_gif)}
ORACLE_SQL: dict[str, str] = {"op2_licenses": licenses.oracle_sql()}
