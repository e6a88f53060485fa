"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon turns each whole word of a clause into one of six symbols (insult,
threat, target, negation, report, other) with a weight. Five transducers over
these symbols are composed into one machine: each passes its input on, marks
what it knows of an insult or a threat, and multiplies its weight:

* insult: an insult is a hit;
* threat: a threat is a hit, in full only if a target follows within reach;
* target: hits of a clause that names a target anywhere count more;
* negation: hits shortly after a negation count little;
* report: hits after a verb of reported speech count less.

The threat and target transducers foresee what follows, so they are
nondeterministic; a path that foresaw wrongly is not accepted. A clause's
score is that of its heaviest accepted path, the sum of weighted hits.
A document's matched clauses give three numbers that a logistic curve turns
into its score.

The insult lexicon is a small fixed list and what is learned from labelled
rows: whole words, and lemmas of `LEMMA` letters on that occur with several
different endings, none of which makes up most of them. Learning reads at
most `bound` labelled rows of each label, never those whose crc32 of the id,
modulo 5, is 0. Texts that share a least
shingle hash, by any of several orders, count as one.

Defined cases: null and empty texts match nothing and get the score of no
match; long texts are read whole, in linear time; repeated rows get equal
scores; an empty table gives an empty result; without labelled rows the fixed
list and fixed curve decide; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.llm.arrow import filter_rows, id_and_text, least_hashed, map_batches, pick, place, texts
from edgetide.llm.linear import logistic
from edgetide.session import bound_arrow, checkpoint, ship

#: Fixed words of each transducer.
INSULTS = ("idiot", "moron", "imbecile", "stupid", "loser", "scum", "worthless", "pathetic", "disgusting", "trash", "garbage", "vermin", "dumb", "filth", "bastard", "clown")
THREATS = ("kill", "murder", "hurt", "destroy", "shoot", "stab", "burn")
TARGETS = ("you", "your", "he", "she", "they", "them", "him", "her", "these", "those", "people", "everyone", "vous", "tu", "ihr", "sie", "du", "usted", "ustedes")
NEGATIONS = ("not", "never", "no", "nobody", "don't", "isn't", "aren't", "wasn't", "nicht", "kein", "keine", "jamais", "pas", "nunca")
REPORTS = ("said", "says", "wrote", "quoted", "quote", "reported", "claimed", "alleged", "sagte", "dit", "dijo")
FIXED_WEIGHT = {"insult": 3.0, "threat": 1.5}
SYMBOLS = ("insult", "threat", "target", "negation", "report", "other")
#: Contractions of a negation are one word; other apostrophes part words, as in l'idiot.
WORD = re.compile(r"[^\W\d_]+n't|[^\W\d_]+")
CLAUSE = re.compile(r"[^.!?;\n]+")
#: Letters of a lemma: at least, at most.
LEMMA = (4, 20)
NEGATION_REACH = 3
THREAT_REACH = 4
#: What an aimed threat weighs, against the heaviest learned entry. Labels of these tables know insults only.
THREAT_SHARE = 0.75
MATCH = {"target": 1.25, "negated": 0.2, "reported": 0.7, "threat without target": 0.2}

#: Odd factors by which shingle hashes are ordered in as many ways.
COPY_ORDERS = (1, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)

Arcs = dict[tuple[int, str], list[tuple[str, float, int]]]


@dataclass
class Transducer:
    """States by number, 0 the first; arcs (state, input) -> [(output, factor, next state)]; and the accepting states."""

    arcs: Arcs
    accepting: frozenset[int]

    @classmethod
    def build(cls, start: object, step: Callable[[object, str], list[tuple[str, float, object]]], accepts: Callable[[object], bool], symbols: tuple[str, ...]) -> Transducer:
        """All states that can be reached from `start`, by the function that tells a state's arcs for a symbol."""
        number, queue, arcs = {start: 0}, [start], {}
        for state in queue:
            for symbol in symbols:
                found = []
                for output, factor, after in step(state, symbol):
                    if after not in number:
                        number[after] = len(number)
                        queue.append(after)
                    found.append((output, factor, number[after]))
                if found:
                    arcs[number[state], symbol] = found
        return cls(arcs, frozenset(n for s, n in number.items() if accepts(s)))

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, the other reads; factors multiply."""

        def step(state: tuple[int, int], symbol: str) -> list[tuple[str, float, tuple[int, int]]]:
            return [(written, f * g, (p, q)) for middle, f, p in self.arcs.get((state[0], symbol), ()) for written, g, q in other.arcs.get((state[1], middle), ())]

        return Transducer.build((0, 0), step, lambda s: s[0] in self.accepting and s[1] in other.accepting, SYMBOLS)

    def heaviest(self, word_symbols: list[tuple[str, float]]) -> float:
        """The sum of weight times factor along the heaviest accepted path; 0 if there is none."""
        best = {0: 0.0}
        for symbol, weight in word_symbols:
            after: dict[int, float] = {}
            for state, so_far in best.items():
                for _, factor, q in self.arcs.get((state, symbol), ()):
                    z = so_far + weight * factor
                    if z > after.get(q, -math.inf):
                        after[q] = z
            best = after
        return max((z for q, z in best.items() if q in self.accepting), default=0.0)


def insult_transducer() -> Transducer:
    return Transducer.build(0, lambda s, x: [("hit" if x == "insult" else x, 1.0, 0)], lambda s: True, SYMBOLS)


def threat_transducer(reach: int = THREAT_REACH) -> Transducer:
    """State (no target within so many words, a target within so many words): what was foreseen of threats so far; 0 for nothing."""

    def step(state: tuple[int, int], x: str) -> list[tuple[str, float, tuple[int, int]]]:
        none, some = state
        if x == "target":
            return [] if none else [(x, 1.0, (0, 0))]
        if some == 1:
            return []
        none, some = max(none - 1, 0), max(some - 1, 0)
        if x != "threat":
            return [(x, 1.0, (none, some))]
        aimed = [("hit", 1.0, (none, some or reach))]
        return aimed if some else [*aimed, ("hit", MATCH["threat without target"], (reach, 0))]

    return Transducer.build((0, 0), step, lambda s: s[1] == 0, ("hit", *SYMBOLS[1:]))


def target_transducer() -> Transducer:
    """From the first word on: no target will come, one will come, or one has come."""

    def step(state: str, x: str) -> list[tuple[str, float, str]]:
        more = MATCH["target"] if x == "hit" else 1.0
        found = []
        if state in ("first", "none") and x != "target":
            found.append((x, 1.0, "none"))
        if state in ("first", "will"):
            found.append((x, more, "has") if x == "target" else (x, more, "will"))
        if state == "has":
            found.append((x, more, "has"))
        return found

    return Transducer.build("first", step, lambda s: s != "will", ("hit", "target", "negation", "report", "other"))


def negation_transducer(reach: int = NEGATION_REACH) -> Transducer:
    """How many more words a negation covers."""
    step = lambda s, x: [(x, MATCH["negated"] if x == "hit" and s else 1.0, reach if x == "negation" else max(s - 1, 0))]
    return Transducer.build(0, step, lambda s: True, ("hit", "target", "negation", "report", "other"))


def report_transducer() -> Transducer:
    step = lambda s, x: [(x, MATCH["reported"] if x == "hit" and s else 1.0, s or x == "report")]
    return Transducer.build(False, step, lambda s: True, ("hit", "target", "negation", "report", "other"))


def clause_machine(without: str = "") -> Transducer:
    """The composition of the five; one may be left out, and what it would mark passes unmarked."""
    parts = {"insult": insult_transducer(), "threat": threat_transducer(), "target": target_transducer(), "negation": negation_transducer(), "report": report_transducer()}
    if without in ("insult", "threat"):  # its symbol is then any other word
        parts[without] = Transducer.build(0, lambda s, x: [("other" if x == without else x, 0.0 if x == without else 1.0, 0)], lambda s: True, ("hit", *SYMBOLS))
    elif without:
        del parts[without]
    machine, *others = parts.values()
    for t in others:
        machine = machine.then(t)
    return machine


@dataclass
class Grammar:
    """Weights of whole words and lemmas by transducer, and the curve from matches to a score."""

    insults: dict[str, float]
    threats: dict[str, float]
    lemmas: dict[str, float] = field(default_factory=dict)
    curve: list[float] = field(default_factory=lambda: [-4.0, 1.6, 0.6, 0.5])
    machine: Transducer = field(default_factory=clause_machine)

    def __post_init__(self) -> None:
        self.symbols = {**dict.fromkeys(TARGETS, "target"), **dict.fromkeys(NEGATIONS, "negation"), **dict.fromkeys(REPORTS, "report")}
        self.longest = max(map(len, self.lemmas), default=0)

    def transduce(self, word: str) -> tuple[str, float]:
        """A word's symbol and weight: as a whole word, or else by its longest lemma."""
        if (w := self.insults.get(word)) is not None:
            return "insult", w
        if (w := self.threats.get(word)) is not None:
            return "threat", w
        if (s := self.symbols.get(word)) is not None:
            return s, 0.0
        for n in range(min(len(word), self.longest), LEMMA[0] - 1, -1):
            if (w := self.lemmas.get(word[:n])) is not None:
                return "insult", w
        return "other", 0.0

    def clause(self, words: list[str]) -> float:
        """The composed machine's weight of a clause."""
        symbols = [self.transduce(w) for w in words]
        return self.machine.heaviest(symbols) if any(w for _, w in symbols) else 0.0

    def automaton(self):  # noqa: ANN201
        """All entries, to find where a text may have a hit at all."""
        found = ahocorasick.Automaton()
        for s in {**self.insults, **self.threats, **self.lemmas}:
            found.add_word(s, (len(s), s in self.lemmas))
        if len(found):
            found.make_automaton()
        return found

    def matches(self, text: str, automaton) -> tuple[float, float, float]:  # noqa: ANN001
        """Logarithms of one and the largest clause weight, of one and their sum, and of one and the number of matched clauses."""
        if not len(automaton):
            return 0.0, 0.0, 0.0
        low = text.lower().replace("’", "'")
        end = len(low)
        hits = [at - n + 1 for at, (n, lemma) in automaton.iter(low) if (at < n or not low[at - n].isalpha()) and (lemma or at + 1 == end or not low[at + 1].isalpha())]
        if not hits:
            return 0.0, 0.0, 0.0
        weights, k = [], 0
        hits.sort()
        for c in CLAUSE.finditer(low):
            if k == len(hits):
                break
            if hits[k] < c.end():
                if (w := self.clause(WORD.findall(c.group()))) > 0:
                    weights.append(w)
                while k < len(hits) and hits[k] < c.end():
                    k += 1
        return math.log1p(max(weights, default=0.0)), math.log1p(sum(weights)), math.log1p(len(weights))

    def score(self, found: tuple[float, float, float]) -> float:
        z = self.curve[0] + sum(c * x for c, x in zip(self.curve[1:], found, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fixed() -> Grammar:
    """The grammar without anything learned."""
    return Grammar(dict.fromkeys(INSULTS, FIXED_WEIGHT["insult"]), dict.fromkeys(THREATS, FIXED_WEIGHT["threat"]))


def copy_keys(text: str) -> list[int]:
    """What near copies mostly share and other texts don't: for each of COPY_ORDERS, the least of the hashes of its shingles of five words."""
    words = WORD.findall(text.lower())
    hashes = np.array([zlib.crc32(" ".join(words[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 4))], dtype=np.uint64)
    return [int(((hashes * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min()) for m in COPY_ORDERS]


def learnable(labels: DataFrame, bound: int) -> DataFrame:
    """Ids and labels to learn from: at most `bound` of each label, those of least hash, none of the held-out ids."""
    known = pick(labels, doc_id=("doc_id", "long"), label=("toxic", "int")).where("doc_id is not null and label in (0, 1) and crc32(cast(doc_id as string)) % 5 <> 0")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    first = lambda y: least_hashed(known.where(F.col("label") == y), "doc_id", bound)
    return first(1).unionAll(first(0))


def occurrences(sample: DataFrame) -> DataFrame:
    """(s, whole, pos, neg): in how many toxic and other documents of (doc_id, label, text) a word or a lemma occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter(), Counter()]

        def made() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            columns = [[s for s, _ in keys], [w for _, w in keys], [counts[1][k] for k in keys], [counts[0][k] for k in keys]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["s", "whole", "pos", "neg"])

        for batch in batches:
            for text, y in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
                words = set(WORD.findall(text.lower().replace("’", "'")))
                counts[y].update([(w, True) for w in words])
                counts[y].update({(w[:n], False) for w in words for n in range(LEMMA[0], min(LEMMA[1], len(w)) + 1)})
                if len(counts[0]) + len(counts[1]) > 200_000:
                    yield made()
                    counts[0].clear()
                    counts[1].clear()
        yield made()

    return sample.select("doc_id", "label", "text").mapInArrow(run, "s string, whole boolean, pos long, neg long").groupBy("s", "whole").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit(docs: DataFrame, labels: DataFrame, bound: int = 4000, least_share: float = 0.003, least_odds: float = 2.5, by_chance: float = 10.0) -> Grammar:
    """Learn the lexicon and the curve from a bounded sample; what reaches the driver are entries found in `least_share` of its toxic rows, and three numbers a row."""
    spark = docs.sparkSession
    ship(spark)
    bound_arrow(spark)
    sample = checkpoint(id_and_text(docs).join(F.broadcast(learnable(labels, bound)), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "label", "text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([copy_keys(t) for t in texts(batch)], pa.list_(pa.int64()))], names=["doc_id", "label", "keys"])

    single = sample.mapInArrow(keys, "doc_id long, label int, keys array<long>")
    for k in range(len(COPY_ORDERS)):  # of those that share a key, the least stays
        single = single.groupBy("label", F.col("keys")[k]).agg(F.min(F.struct("doc_id", "keys")).alias("r")).select("label", "r.*")
    single = single.select("doc_id")
    sample = checkpoint(sample.join(F.broadcast(single), "doc_id", "left_semi"))  # as bounded as the sample is
    counts = dict(sample.groupBy("label").count().collect())
    n_pos, n_neg = counts.get(1, 0), counts.get(0, 0)
    if n_pos < 5 or n_neg < 5:
        return fixed()
    total = checkpoint(occurrences(sample))
    least = max(4, round(least_share * n_pos))
    words = total.where("whole and pos > 0").select("s", "pos")
    lemma = F.explode(F.transform(F.sequence(F.lit(LEMMA[0]), F.least(F.length("s"), F.lit(LEMMA[1]))), lambda n: F.substring("s", F.lit(1), n)))
    forms = words.where(F.length("s") >= LEMMA[0]).select(lemma.alias("s"), "pos").groupBy("s").agg(F.count("*").alias("forms"), F.max("pos").alias("top"))
    odds = F.log((F.col("pos") + 0.3) / (n_pos + 1) * (n_neg + 1) / (F.col("neg") + 0.6))
    # By Chernoff's bound, at most `by_chance` of all the entries tried would be as one-sided as this without a cause.
    n, share = F.col("pos") + F.col("neg"), n_pos / (n_pos + n_neg)
    q = F.col("pos") / n
    surprise = n * (q * F.log(q / share) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - share))).otherwise(0.0))
    tried = total.where((F.col("pos") >= least) | (F.col("neg") >= least)).count()
    strong = total.withColumn("w", odds).where((F.col("pos") >= least) & (F.col("w") > least_odds) & (surprise > math.log(max(tried, 1) / by_chance)))
    kept = strong.where("whole").select("s", "whole", "w").unionAll(strong.where("not whole").join(forms, "s").where((F.col("forms") >= 4) & (F.col("top") <= 0.6 * F.col("pos"))).select("s", "whole", "w")).collect()
    lemmas = {r.s: r.w for r in kept if not r.whole}
    # An entry that says no more than a shorter lemma is left out.
    said = lambda s, w: any(lemmas.get(s[:n], -9) >= w - 0.7 for n in range(LEMMA[0], len(s)))
    learned = {r.s: r.w for r in kept if r.whole and len(r.s) >= 3 and not said(r.s + " ", r.w)}
    lemmas = {s: w for s, w in sorted(lemmas.items()) if not said(s, w)}
    seen = {r.s: r.neg for r in total.where(F.col("whole") & F.col("s").isin(list(INSULTS + THREATS))).select("s", "neg").collect()}
    innocent = lambda w: seen.get(w, 0) >= max(5, 0.002 * n_neg)
    threat = max(FIXED_WEIGHT["threat"], THREAT_SHARE * max([*learned.values(), *lemmas.values()], default=0.0))
    grammar = Grammar({**{w: FIXED_WEIGHT["insult"] for w in INSULTS if not innocent(w)}, **dict(sorted(learned.items()))}, {w: threat for w in THREATS if not innocent(w)}, lemmas)
    found = matched(sample.select("doc_id", "text"), grammar).join(sample.select("doc_id", "label"), "doc_id").orderBy("doc_id").select("largest", "total", "clauses", "label").collect()
    x = np.array([[1.0, r.largest, r.total, r.clauses] for r in found])
    grammar.curve = logistic(x, np.array([r.label for r in found], dtype=float)).tolist()
    return grammar


def matched(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id and the three numbers of its matched clauses."""

    def factory() -> Callable[[list[str]], list[tuple]]:
        automaton = grammar.automaton()
        return lambda batch: [grammar.matches(t, automaton) for t in batch]

    return map_batches(docs, factory, [(n, "double", pa.float64()) for n in ("largest", "total", "clauses")])


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""

    def factory() -> Callable[[list[str]], list[tuple]]:
        automaton = grammar.automaton()
        return lambda batch: [(grammar.score(grammar.matches(t, automaton)),) for t in batch]

    scored = map_batches(docs, factory, [("score", "double", pa.float64())], id_col, text_col)
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, grammar: Grammar, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that score under the threshold."""
    at = place(docs, text_col)

    def factory() -> Callable[[pa.RecordBatch], list[bool]]:
        automaton = grammar.automaton()
        return lambda batch: [grammar.score(grammar.matches(t or "", automaton)) < threshold for t in batch.column(at).to_pylist()]

    return filter_rows(docs, factory)
