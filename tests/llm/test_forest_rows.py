"""The forest's threshold and ranges come from every labelled row."""

from __future__ import annotations

import random

import numpy as np

from edgetide.llm import quality_rules as q

from . import cases


def test_every_labelled_row_counts(spark):
    rnd = random.Random(9)
    words = ["river", "stone", "bread", "walks", "quiet", "morning", "under", "bright", "clay", "moon", "tide", "over"]
    rows = [(i, " ".join(rnd.choice(words) + "!" * (i % 10 == 0) for _ in range(24)), "en", "s", 1) for i in range(9000)]
    docs, labels = spark.createDataFrame(rows, cases.SCHEMA).repartition(4), spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(9000)], "doc_id long, quality int, toxic int")
    model = q.fit(docs, labels)
    found = [r for r in q.apply(docs, model).collect() if not r.base_failed]
    own = q.grown_on(np.array([r.doc_id for r in found]))
    steps = [np.zeros(q.GRID, dtype=np.int64) for _ in range(2)]
    for r, grown in zip(found, own, strict=True):
        if not grown:
            steps[int(r.doc_id % 10 != 0)][int(r.anomaly * q.GRID)] += 1
    assert sum(map(sum, steps)) > 4000  # more than half of 8,000 rows
    assert model.threshold == q.threshold(steps[1], steps[0], 0.005)
    good = [r for r in found if r.doc_id % 10]
    assert sum(not r.kept for r in good) <= 0.01 * len(good) and not any(r.kept for r in found if r.doc_id % 10 == 0)


def test_trees_draw_from_all_rows(spark):
    n = 6000
    good = spark.range(n).selectExpr("id as doc_id", "array(double(id)) as x")
    x, drawn = q.drawn_rows(good, n, 7)
    assert len(drawn) == q.TREES and all(len(set(p.tolist())) == q.TREE_ROWS for p in drawn)
    chosen = {int(v) for p in drawn for v in x[p, 0]}
    assert len(chosen) > 0.9 * n
