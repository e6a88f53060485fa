"""Columns whose names differ from the operators' own by case only, in documents and labels, for every operator and stage."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from edgetide.llm import gif, licenses, packing, pii, quality_classifier, quality_rules, secrets, simhash, toxicity, wordbpe

from . import cases
from .test_corpus_operators import quality_corpus
from .test_pipeline import folder


def doubled(df):
    """The same rows with a second column for each name, in other letters and of other types."""
    return df.select("*", F.lit("you idiot 1.2.3.4 all rights reserved").alias("Text"), F.lit(7).alias("DOC_ID"), F.create_map(F.lit("a"), F.lit(1)).alias("Lang"), F.array(F.lit(1)).alias("SOURCE"))


def labels_doubled(df):
    return df.select("*", F.lit("x").alias("Doc_Id"), F.lit("y").alias("QUALITY"), F.lit("z").alias("Toxic"))


def results(spark, df, labels):
    path = wordbpe.vocabulary_path()
    yield "pii", pii.digest(df)
    yield "licenses", licenses.scan(df, licenses.ranks(df))
    yield "packing", packing.pack(df, path).groupBy("doc_id").agg(F.sum("length").alias("n"))
    yield "rules", quality_rules.apply(df, quality_rules.fit(df, labels))
    yield "simhash", simhash.digest(df)
    yield "bpe", wordbpe.digest(df, path)
    yield "classifier", quality_classifier.score(df, quality_classifier.fit(df, labels))
    yield "secrets", secrets.digest(df, secrets.fit(df))
    yield "toxicity", toxicity.score(df, toxicity.fit(df, labels))
    yield "gif", gif.digest(df)


def test_operators(spark):
    df, labels = quality_corpus(spark, 60)
    df = df.unionByName(cases.docs(spark, cases.SPECIAL, clashing=False).withColumn("doc_id", F.col("doc_id") + 1000))
    plain, clashing = results(spark, df, labels), results(spark, doubled(df), labels_doubled(labels))
    for (name, a), (_, b) in zip(plain, clashing, strict=True):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())), name


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages(spark, tmp_path, stage):
    df, labels = quality_corpus(spark, 40)
    sf = folder(spark, tmp_path, df, labels)
    a, b = stage(spark, df, sf), stage(spark, doubled(df), sf)
    assert a.count() == b.count() and (len(b.columns) == len(a.columns) + 4 or "sequence_id" in b.columns)


def test_least_hashed_is_the_sorted_start(spark):
    from edgetide.llm.arrow import least_hashed

    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    plain = [r.doc_id for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(40).collect()]
    for bound in (0, 1, 40):
        assert [r.doc_id for r in least_hashed(rows, "doc_id", bound).collect()] == plain[:bound]
    assert least_hashed(rows.limit(0), "doc_id", 40).count() == 0 and least_hashed(rows, "doc_id", 9999).count() == 5000
