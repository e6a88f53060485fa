"""License notices: texts that look alike, blocks across any window edge, and the SQL that applies no filter."""

from __future__ import annotations

import random

import duckdb
import pytest

from edgetide.llm import licenses

from . import cases


def labels_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in licenses.scan(df, licenses.ranks(df)).collect()}


def test_notices_and_look_alikes(spark):
    got = labels_of(
        spark,
        [
            "Researchers at MIT released the dataset last week under an unusual licence but not an open source license",
            "This work is licensed under the GNU Affero General Public License, version 3",
            "This work is licensed under the GNU Lesser General Public License, version 3",
            "This work is licensed under the GNU General Public License, version 3",
            "It is released under the MIT License and more",
            "the license released under mit the",
            licenses.GNU.format("Affero General Public License", "3", "Affero General Public License"),
            licenses.GNU.format("General Public License", "2", "General Public License"),
            "This work is licensed under the GNU General Public License, version 3 " + "x " * 50 + licenses.GNU.format("Affero General Public License", "3", "Affero General Public License"),
        ],
    )
    assert [got[i].labels for i in range(9)] == ["", "agpl,gpl", "gpl,lgpl", "gpl,gpl-3.0", "mit", "", "agpl,agpl-3.0,gpl", "gpl,gpl-2.0", "agpl,agpl-3.0,gpl,gpl-3.0"]
    assert got[0].score == 0 and got[3].score == 1


@pytest.mark.parametrize("at", [0, 1, 20, 40, 63, 64, 100])
def test_long_notices_stand_anywhere(spark, at):
    """A whole paragraph is one block wherever it begins, with some words changed."""
    texts = [t for label, t in licenses.TEMPLATES if len(licenses.words_of(t)) > 40]
    rnd = random.Random(at)
    changed = []
    for t in texts:
        w = licenses.words_of(t)
        w[rnd.randrange(len(w))] = "changed"
        w.insert(rnd.randrange(len(w)), "inserted")
        changed.append("word " * at + " ".join(w) + " word" * 30)
    got = labels_of(spark, changed)
    want = [label for label, t in licenses.TEMPLATES if len(licenses.words_of(t)) > 40]
    assert [w in got[i].labels.split(",") for i, w in enumerate(want)] == [True] * len(want)


def pieces(rnd, n):
    """Texts of whole, cut, mixed and repeated notices."""
    out = []
    for _ in range(n):
        text = []
        for _ in range(rnd.randrange(1, 5)):
            w = licenses.words_of(rnd.choice(licenses.TEMPLATES)[1])
            a = rnd.randrange(len(w)) if rnd.random() < 0.3 else 0
            w = w[a : a + rnd.randrange(3, len(w) + 1) if rnd.random() < 0.5 else None]
            if rnd.random() < 0.4:
                rnd.shuffle(w)
            text += w + ["river"] * rnd.randrange(0, 6)
        out.append(" ".join(text))
    return out


def test_filters_lose_nothing(spark):
    df = cases.docs(spark, cases.texts(10) + pieces(random.Random(3), 120))
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toArrow())
    want = sorted(map(repr, con.sql(licenses.oracle_sql()).fetchall()))
    assert sorted(repr(tuple(r)) for r in licenses.scan(df, licenses.ranks(df)).collect()) == want
    assert sum("0.0)" not in w for w in want) > 50


def test_any_global_order_gives_the_same_rows(spark):
    df = cases.docs(spark, pieces(random.Random(5), 40))
    rank = licenses.ranks(df)
    other = {t: len(rank) - 1 - k for t, k in rank.items()}
    assert sorted(map(repr, licenses.scan(df, rank).collect())) == sorted(map(repr, licenses.scan(df, other).collect()))


def test_many_notices_in_one_text(spark):
    """A text of thousands of notices takes no time that grows with their square."""
    text = ("this work is licensed under the gnu general public license version 3 and the weather " * 3000).strip()
    assert labels_of(spark, [text])[0].labels == "gpl,gpl-3.0"
