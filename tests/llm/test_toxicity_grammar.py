"""The composed clause machine against plain rules and path enumeration, and what each transducer decides."""

from __future__ import annotations

import itertools
import random

import pytest

from edgetide.llm import toxicity
from edgetide.llm.toxicity import MATCH, NEGATION_REACH, SYMBOLS, THREAT_REACH

from . import cases
from .test_corpus_operators import toxic_corpus


def clauses(n=400, seed=2):
    rnd = random.Random(seed)
    for _ in range(n):
        yield [(s, rnd.choice([1.0, 2.5]) if s in ("insult", "threat") else 0.0) for s in (rnd.choice(SYMBOLS) for _ in range(rnd.randrange(0, 9)))]


def plain_score(clause):
    """The rules, word by word, with the whole clause in view."""
    symbols = [s for s, _ in clause]
    total = 0.0
    for i, (s, w) in enumerate(clause):
        if s not in ("insult", "threat"):
            continue
        factor = MATCH["target"] if "target" in symbols else 1.0
        if s == "threat" and "target" not in symbols[i + 1 : i + 1 + THREAT_REACH]:
            factor *= MATCH["threat without target"]
        if "negation" in symbols[max(0, i - NEGATION_REACH) : i]:
            factor *= MATCH["negated"]
        if "report" in symbols[:i]:
            factor *= MATCH["reported"]
        total += w * factor
    return total


def paths(parts, clause):
    """Every path through the transducers one after the other: (weight, accepted)."""
    found = [([s for s, _ in clause], [1.0] * len(clause), True)]
    for t in parts:
        after = []
        for symbols, factors, good in found:
            runs = [(0, [], [])]
            for s, f in zip(symbols, factors, strict=True):
                runs = [(q, [*out, o], [*made, f * g]) for state, out, made in runs for o, g, q in t.arcs.get((state, s), ())]
            after += [(out, made, good and q in t.accepting) for q, out, made in runs]
        found = after
    return [sum(w * f for (_, w), f in zip(clause, factors, strict=True)) for _, factors, good in found if good]


def test_composition_equals_path_enumeration():
    parts = [toxicity.insult_transducer(), toxicity.threat_transducer(), toxicity.target_transducer(), toxicity.negation_transducer(), toxicity.report_transducer()]
    machine = toxicity.clause_machine()
    for clause in clauses():
        every = paths(parts, clause)
        assert len(every) >= 1 and max(every) == pytest.approx(machine.heaviest(clause)) == pytest.approx(plain_score(clause))


def test_short_clauses_in_full():
    machine = toxicity.clause_machine()
    for n in range(4):
        for symbols in itertools.product(SYMBOLS, repeat=n):
            clause = [(s, 1.0 if s in ("insult", "threat") else 0.0) for s in symbols]
            assert machine.heaviest(clause) == pytest.approx(plain_score(clause))


@pytest.mark.parametrize("part,clause", [("insult", "you idiot"), ("threat", "kill you"), ("target", "you idiot"), ("negation", "you are not an idiot"), ("report", "they said you are an idiot")])
def test_each_transducer_counts(part, clause):
    whole = toxicity.fixed()
    less = toxicity.Grammar(whole.insults, whole.threats, machine=toxicity.clause_machine(part))
    a = whole.automaton()
    assert whole.score(whole.matches(clause, a)) != pytest.approx(less.score(less.matches(clause, a)))


def test_ordinary_sentences_after_learning(spark):
    """Beginnings of insults are no entries: other words that share them are left alone."""
    docs, labels = toxic_corpus(spark)
    extra = [(5000 + i, f"{a} {b} you {c}", "en", "s", 1) for i, (a, b, c) in enumerate(itertools.product(["pathetic", "disgusting"], ["trash", "moron"], ["worthless", "loser", "clown"]))]
    docs = docs.unionByName(spark.createDataFrame(extra, cases.SCHEMA))
    labels = labels.unionByName(spark.createDataFrame([(r[0], 0, 1) for r in extra], labels.schema))
    g = toxicity.fit(docs, labels)
    a = g.automaton()
    score = lambda t: g.score(g.matches(t, a))
    for t in ("More people walked the path this morning.", "We discuss the sculpture.", "The world cup is close to its end.", "The train leaves at nine."):
        assert score(t) < 0.5
    assert score("You are a pathetic idiot.") > score("You are an idiot.") > score("You are not an idiot.")
    assert score("C'est l’idiot.") == score("c'est l'idiot.") > score("c'est la vie.") and all(len(s) >= toxicity.LEMMA[0] for s in g.lemmas)


def test_copies_count_once(spark):
    """A word that only copies of one toxic text repeat is no insult."""
    docs, labels = toxic_corpus(spark, 300)
    text = "the quiet river walks under a bright morning and blorpish stones stay idiot " * 3
    copies = [(9000 + i, text + f"end {i}", "en", "s", 1) for i in range(40)]
    docs = docs.unionByName(spark.createDataFrame(copies, cases.SCHEMA))
    labels = labels.unionByName(spark.createDataFrame([(r[0], 0, 1) for r in copies], labels.schema))
    assert "blorpish" not in toxicity.fit(docs, labels).insults
