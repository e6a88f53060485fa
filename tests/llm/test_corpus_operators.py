"""Operators that look at many texts, and the pipeline's stages, against plain versions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from edgetide.llm import linear, quality_classifier, simhash, toxicity

from . import cases


def plain_print(t):
    t = t.translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """prints: (id, fingerprint); ids of None take part. Returns the least id for each row."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        r = root(i)
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return [least.get(root(i)) for i in range(len(prints))]


def test_simhash(spark):
    df = cases.docs(spark)
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    prints = [(i, plain_print(t)) for i, t in rows]
    want = Counter(zip([i for i, _ in rows], [f"{p:016x}" for _, p in prints], plain_components(prints), strict=True))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.digest(df).collect())
    assert got == want
    assert simhash.digest(cases.empty(spark)).count() == 0


def test_simhash_links_in_crowds(spark):
    """Fingerprints made of a few centres with flipped bits, chains among them."""
    rnd = random.Random(4)
    prints = set()
    for _ in range(12):
        c = rnd.getrandbits(64)
        for _ in range(60):
            prints.add(c ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(0, 5))) & (1 << 64) - 1)
            c ^= (1 << rnd.randrange(64)) if rnd.random() < 0.2 else 0
    prints = [(i, p) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in df.join(simhash.components(df), "fp").collect()}
    assert [got[i] for i, _ in prints] == plain_components(prints)


def test_simhash_crowded_posting_by_flips():
    v = np.unique(np.random.default_rng(1).integers(0, 1 << 24, 2000, dtype=np.uint64))
    norm = lambda g: sorted((m, sorted(map(int, o))) for m, o in g)
    assert norm(simhash.stars(v, (1 << 24) - 1, 3)) == norm(simhash._stars_by_flips(v, (1 << 24) - 1, 3))


@pytest.mark.parametrize("repeat", [False, True])
def test_simhash_keep_one(spark, repeat):
    df = cases.docs(spark, repeat=repeat)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    prints = [(i, plain_print(t)) for i, t in rows]
    groups = {}
    parent = plain_components(prints)
    for (i, p), c in zip(prints, parent, strict=True):
        groups.setdefault(c if c is not None else ("none", p), []).append((i, p))
    got = [(r.doc_id, plain_print(r.text or "")) for r in kept.collect()]
    assert len(got) == len(groups)
    for c, members in groups.items():
        assert sum(g in members for g in got) == 1
        if not isinstance(c, tuple):
            assert any(g[0] == c for g in got)
    assert simhash.keep_one(cases.empty(spark)).count() == 0


def toxic_corpus(spark, n=600):
    rnd = random.Random(9)
    clean = ["river", "stone", "bread", "walks", "quiet", "morning", "under", "bright", "people", "you", "not", "said"]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(clean) + rnd.choice(["", "s", "ly", "."]) for _ in range(rnd.randrange(10, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rnd.randrange(2, 5)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["moron", "idiot", "grubzak" + rnd.choice(["a", "en", "ish"])]))
        rows.append((i, " ".join(words), "en", "src0", 1))
        labels.append((i, int(not toxic), int(toxic)))
    return spark.createDataFrame(rows, cases.SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_holds_out(spark):
    docs, labels = toxic_corpus(spark)
    grammar = toxicity.fit(docs, labels)
    assert any(s.startswith("gru") for s in grammar.insults)
    rows = toxicity.score(docs, grammar).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.97
    kept = toxicity.keep_clean(docs, grammar)
    assert kept.columns == docs.columns and kept.join(labels, "doc_id").where("toxic = 1").count() <= 3 and kept.count() >= 470


def test_toxicity_never_reads_held_out_labels(spark):
    docs, labels = toxic_corpus(spark, 300)
    flipped = labels.withColumn("toxic", F.expr("if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic)"))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert a.insults == b.insults and a.curve == b.curve


def test_toxicity_cases(spark):
    df = cases.docs(spark)
    _, labels = toxic_corpus(spark)
    for lab in (labels, labels.limit(0), labels.unionAll(labels).union(spark.createDataFrame([(None, 1, 1)], labels.schema))):
        grammar = toxicity.fit(df, lab)
        assert toxicity.score(df, grammar).count() == df.count()
        assert toxicity.keep_clean(df, grammar).columns == df.columns
    g = toxicity.fixed()
    a = g.automaton()
    full, negated, said = (g.matches(t, a)[0] for t in ("you idiot", "you are not idiot", "they said you idiot"))
    assert full > said > negated > 0 and g.matches("", a) == (0.0, 0.0, 0.0)
    assert g.matches("idiot " * 20_000, a)[2] > 0
    assert toxicity.score(cases.empty(spark), g).count() == 0 and toxicity.keep_clean(cases.empty(spark), g).count() == 0


def quality_corpus(spark, n=500):
    rnd = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(["river", "stone", "bread", "walks", "quiet", "morning", "Under", "bright"]) for _ in range(rnd.randrange(30, 90))]
        bad = i % 4 == 0
        text = " | ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    return spark.createDataFrame(rows, cases.SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_classifier(spark):
    docs, labels = quality_corpus(spark)
    model = quality_classifier.fit(docs, labels)
    rows = quality_classifier.score(docs, model).collect()
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in rows if r.held_out]) > 0.97
    kept = quality_classifier.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id % 4 <> 0").count() >= 370 and kept.where("doc_id % 4 = 0").count() <= 5


def test_quality_classifier_cases(spark):
    df = cases.docs(spark)
    _, labels = quality_corpus(spark)
    for lab in (labels, labels.limit(0)):
        model = quality_classifier.fit(df, lab)
        assert quality_classifier.score(df, model).count() == df.count()
        assert quality_classifier.keep_good(df, model).columns == df.columns
        assert quality_classifier.score(cases.empty(spark), model).count() == 0
        assert quality_classifier.keep_good(cases.empty(spark), model).count() == 0
    narrow = df.select("text", "doc_id")
    assert quality_classifier.keep_good(narrow, quality_classifier.fit(narrow, labels)).columns == ["text", "doc_id"]
    assert quality_classifier.fit(cases.empty(spark), labels).views == []


def test_co_training_hands_over_confident_rows():
    rng = np.random.default_rng(2)
    y = (np.arange(600) % 2).astype(float)
    a, b = (y[:, None] * 4 + rng.normal(0, 1, (600, 2)) for _ in range(2))
    views = quality_classifier.co_train([a[:20], b[:20]], y[:20], [a[20:500], b[20:500]])
    for v, x in zip(views, (a, b), strict=True):
        assert np.mean((v.logit(x[500:]) > 0) == (y[500:] > 0.5)) > 0.95


def test_logistic():
    x = np.column_stack([np.ones(200), np.linspace(-2, 2, 200)])
    b = linear.logistic(x, (x[:, 1] > 0.5).astype(float))
    assert b[1] > 1 and abs(-b[0] / b[1] - 0.5) < 0.2
