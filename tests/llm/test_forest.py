"""The isolation forest: path lengths against a plain walk, what it is grown and calibrated on, and duplicate lines."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from edgetide.llm import quality_rules as q

from . import cases


def test_scores_are_mean_paths():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 3))
    f = q.grow(x, trees=20, sample=64)
    for row in x[:20]:
        total = 0.0
        for at in f.roots:
            while f.feature[at] >= 0:
                at = f.left[at] if row[f.feature[at]] < f.value[at] else f.right[at]
            total += f.path[at]
        assert f.score(row[None])[0] == np.exp2(-total / 20 / f.norm)
    leaves = f.path[f.feature < 0]
    assert leaves.min() >= 0 and abs(f.norm - (2 * (math.log(63) + 0.5772156649015329) - 2 * 63 / 64)) < 1e-9


def test_values_that_no_row_has_are_isolated():
    """Also along a feature in which all rows are equal, without any outlier at hand."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(0, 1, 500), np.zeros(500)])
    f = q.grow(x)
    usual = np.quantile(f.score(x), 0.99)
    assert f.score(np.array([[0.0, 0.5]]))[0] > usual and f.score(np.array([[9.0, 0.0]]))[0] > usual


def corpus(spark, n=400):
    """Prose, some of it with lines that repeat between changing ones, poor by label."""
    rnd = random.Random(8)
    words = ["river", "stone", "bread", "walks", "quiet", "morning", "under", "bright", "clay", "moon", "tide", "over", "sharp", "field"]
    rows, labels = [], []
    for i in range(n):
        lines = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(6, 12))) for _ in range(rnd.randrange(8, 16))]
        poor = i % 8 == 0
        if poor:
            lines = [x for line in lines for x in (line, "home about")]
        rows.append((i, "\n".join(lines), "en", "s", 1))
        labels.append((i, int(not poor), 0))
    return spark.createDataFrame(rows, cases.SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_duplicate_lines_count(spark):
    docs, labels = corpus(spark)
    rows = q.apply(docs, q.fit(docs, labels.where("doc_id < 300"))).where("doc_id >= 300").collect()
    assert not any(r.base_failed for r in rows)
    assert all(not r.kept for r in rows if r.doc_id % 8 == 0) and sum(r.kept for r in rows if r.doc_id % 8) >= 85


def test_forest_never_sees_poor_rows_nor_those_it_is_calibrated_on(spark):
    docs, labels = corpus(spark)
    ids = np.arange(400)
    kept = {int(i) for i in ids[q.grown_on(ids)] if i % 8}
    altered = docs.withColumn("text", F.when(F.col("doc_id").isin(list(kept)), F.col("text")).otherwise(F.concat(F.lit("!!! ZZZ "), "text")))
    a, b = q.fit(docs, labels), q.fit(altered, labels)
    assert (a.forest.value == b.forest.value).all() and (a.forest.feature == b.forest.feature).all()
