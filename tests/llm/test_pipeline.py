"""The corpus pipeline, stage by stage, and what is registered."""

from __future__ import annotations

import zlib
from collections import defaultdict

import corpus_pipeline
from edgetide.llm import quality_classifier, secrets, toxicity, wordbpe
from edgetide.llm.registry import ORACLE_SQL, QUERIES

from . import cases
from .test_corpus_operators import plain_components, plain_print, quality_corpus
from .test_text_operators import plain_secrets


def folder(spark, tmp_path, docs, labels):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_registry():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "SimHash near-duplicates", "secrets", "packing"]


def plain_stages(spark, docs, labels):
    """What each stage should keep, from its own input: rows as (id, text)."""
    rows = lambda d: [(r.doc_id, r.text) for r in d.collect()]
    grammar = toxicity.fit(docs, labels)
    auto = grammar.automaton()
    toxic = [(i, t) for i, t in rows(docs) if grammar.score(grammar.matches(t or "", auto)) < 0.5]
    return toxic


def test_stages(spark, tmp_path):
    docs, labels = quality_corpus(spark, 200)
    extra = [(1000 + i, t, "en", "src1", len(t or "")) for i, t in enumerate(cases.texts(20))]
    extra += [(2000, 'river stone bread walks quiet morning bright password="abcdefghijkl99" ' * 3, "en", "src0", 1), (None, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(extra, cases.SCHEMA))
    sf = folder(spark, tmp_path, docs, labels)
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        path = f"{tmp_path}/stage{k}"
        out.write.parquet(path)
        made = spark.read.parquet(path)
        before = [(r.doc_id, r.text) for r in now.collect()]
        if k < 4:
            assert made.columns == docs.columns
            after = [(r.doc_id, r.text) for r in made.collect()]
        if name == "toxicity":
            assert sorted(map(repr, after)) == sorted(map(repr, plain_stages(spark, now, labels)))
        if name == "quality classifier":
            model = quality_classifier.fit(now, labels)
            kept = {r.doc_id for r in quality_classifier.score(now, model).where("kept").collect()}
            assert sorted(map(repr, after)) == sorted(repr(x) for x in before if x[0] in kept)
        if name == "SimHash near-duplicates":
            groups = plain_components([(i, plain_print(t or "")) for i, t in before])
            assert sorted(map(repr, (i for i, _ in after))) == sorted(map(repr, set(groups)))
        if name == "secrets":
            assert len(after) == len(before) and not any(plain_secrets(t or "") for _, t in after)
            table = secrets.fit(now)
            touched = {r.doc_id for r in secrets.scan(now, table).where("size(found) > 0").collect()}
            assert {i: t for i, t in before if i not in touched} == {i: t for i, t in after if i not in touched} and 2000 in touched
        if name == "packing":
            bpe, parts = wordbpe.load(wordbpe.vocabulary_path()), defaultdict(list)
            for r in made.collect():
                parts[r.doc_id].append(r)
            for i, t in before:
                ids = bpe.encode(t or "") + b"\1\0\0\0"
                assert sum(r.length for r in parts[i]) == len(ids) // 4
                assert all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in parts[i])
        now = made


def test_stages_take_empty_tables(spark, tmp_path):
    docs, labels = quality_corpus(spark, 20)
    sf = folder(spark, tmp_path, docs.limit(0), labels)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_stages_take_odd_rows_and_columns(spark, tmp_path):
    docs, labels = quality_corpus(spark, 40)
    sf = folder(spark, tmp_path, docs, labels)
    odd = cases.docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        assert out.count() > 0
        if name != "packing":
            assert out.columns == odd.columns


def test_run(spark, tmp_path):
    docs, labels = quality_corpus(spark, 120)
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, docs, labels)).count() > 0
