"""The Markov models of the secrets operator: own spans against a plain version, recall and precision on planted rows."""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgetide.llm import secrets

from . import cases
from .test_text_operators import by_row, inputs, plain_secrets


def plain_markov(text, model):
    """Runs of the alphabet, each character's place looked up one by one, without those that touch a base span."""
    base = [(a, b) for a, _, b in plain_secrets(text)]
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        w = m.group()
        if len(w) < secrets.LEAST or len(set(w)) < secrets.DISTINCT or not re.search("[A-Za-z]", w) or any(a < m.end() and m.start() < b for a, b in base):
            continue
        places = [secrets.ALPHABET.index(c) + 1 if c in secrets.ALPHABET else 0 for c in w]
        if sum(model.table[a * secrets.STATES + b] for a, b in zip(places, places[1:], strict=False)) >= model.threshold:
            out.append((m.start(), m.end()))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return secrets.fit(cases.prose(spark))


def planted(seed=6, n=300):
    """Texts that hold one random string each, and texts that hold one identifier each."""
    rnd = random.Random(seed)
    kinds = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits]
    prose = [r for r in ("der morning river bread", "quiet stone walks by", "under the bright moon")]
    words = ["user", "profile", "image", "connection", "retries", "element", "class", "name", "internal", "message", "server", "cache", "morning", "river"]
    keys = ["".join(rnd.choice(rnd.choice(kinds)) for _ in range(1)) + "".join(rnd.choice(kinds[k % 4]) for _ in range(rnd.randrange(15, 48))) for k in range(n)]
    names = []
    for k in range(n):
        w = [rnd.choice(words) for _ in range(rnd.randrange(3, 6))]
        names.append(["_".join(w), "-".join(w), "/".join(w), w[0] + "".join(x.title() for x in w[1:]), "_".join(w).upper()][k % 5])
    return [f"{rnd.choice(prose)} {x} {rnd.choice(prose)}" for x in keys], [f"{rnd.choice(prose)} {x} end" for x in names]


def test_own_spans_are_the_plain_ones(spark, model):
    yes, no = planted(n=60)
    df = cases.docs(spark, cases.texts() + yes + no)
    got = by_row(secrets.digest(df, model))
    for i, t in inputs(df):
        if i is not None:
            want = [f"markov:{a}:{b}" for a, b in plain_markov(t, model)]
            for r in got[i]:
                assert [s for s in r.spans.split(",") if s.startswith("markov")] == want and r.n_markov == len(want)


def test_recall_and_precision(spark, model):
    yes, no = planted()
    df = spark.createDataFrame(list(enumerate(yes + no)), "doc_id long, text string")
    hit = {r.doc_id for r in secrets.digest(df, model).where("n_markov > 0").collect()}
    base = {i for i, t in enumerate(yes) if plain_secrets(t)}
    found = sum(i in hit or i in base for i in range(len(yes)))
    assert found >= 0.95 * len(yes) and sum(i >= len(yes) for i in hit) <= 0.02 * len(no)


def test_identifier_counts_cover_all_documents(spark):
    """Counts come from every document: a word far from the first ones changes the model, and doubling the corpus doubles its sums."""
    docs = cases.prose(spark)
    more = docs.unionAll(spark.createDataFrame([(9999, "zqxj " * 50, "en", "s", 1)], cases.SCHEMA))
    at = lambda a, b: (secrets.ALPHABET.index(a) + 1, secrets.ALPHABET.index(b) + 1)
    a, b = (secrets.ordinary(secrets.vocabulary(d)) for d in (docs, more))
    assert b[at("q", "x")] - a[at("q", "x")] == 100 and b[at("_", "z")] > a[at("_", "z")]
    assert secrets.ordinary(secrets.vocabulary(docs.unionAll(docs))) == pytest.approx(2 * a)
    plain = np.zeros((26, 26))
    for (t,) in docs.select("text").collect():
        for w in re.findall("[a-z]{2,}", t.lower()):
            for x, y in zip(w, w[1:], strict=False):
                plain[ord(x) - 97, ord(y) - 97] += 1
    words = secrets.vocabulary(docs)
    k = [secrets.ALPHABET.index(c) + 1 for c in string.ascii_lowercase]
    assert secrets.transitions(words)[np.ix_(k, k)] == pytest.approx(plain)


def test_runs_of_few_characters_are_no_secrets(model):
    assert not plain_markov("=" * 40 + " " + "x" * 40 + " " + "ababab" * 6, model)


def test_redact_among_clashing_names(spark, model):
    df = cases.docs(spark, ["key dGhpcyBpcyBhIHJhbmRvbSBzdHJpbmc5Zk1xUXo3 end"], repeat=False).select("*", F.lit("other").alias("Text"))
    r = secrets.redact(df, model).first()
    assert r["text"] == "key [secret] end" and r["Text"] == "other"
