"""Secrets: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Everything on the main path is a DataFrame expression. Places come from
splitting a text at a pattern: the lengths of what lies between the matches
and of the matches themselves add up to code points.

Base kinds (assign, access, hex) are always kept. The method adds `markov`: a
run of `LEAST` or more identifier characters, at least `DISTINCT` different ones
among them, whose log-likelihood ratio, random string over identifier, reaches
a threshold. Both models are of first order with add-one smoothing. That of
random strings is trained on a labelled sample derived from hashes; that of
identifiers on the words of all documents, counted once over the whole corpus,
as they stand, capitalised, in capitals, numbered, and joined to one another.
The threshold is calibrated on labelled samples, random strings cut to `LEAST`
characters and identifiers made of at most `bound` words: as high as lets
`found` of the former pass, but at least so high that no more than `most_false`
of the latter do.

Defined cases: null and empty texts have no spans; long texts are scanned
whole; repeated rows give equal results; an empty table gives an empty result
(its model knows identifiers only by smoothing); other columns are ignored,
whatever their names, or kept by `redact`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.llm.arrow import id_and_text, least_hashed, pick, place
from edgetide.session import checkpoint

KINDS = ("assign", "access", "hex", "markov")
#: Of a run of hex digits or capitals only the whole run can be long enough, so the least length stands in the pattern.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{16,}",
    "markov": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}",
}
LEAST, DISTINCT = 16, 8
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-+/"
STATES = len(ALPHABET) + 1
SPAN = "array<struct<start:int,rank:int,end:int>>"


@dataclass
class Model:
    """Log-likelihood ratios of transitions, random over ordinary, as a flat table, and the least sum that counts."""

    table: np.ndarray
    threshold: float

    def ratio(self, word: str) -> float:
        """The sum for one word, on the driver."""
        c = [ALPHABET.find(x) + 1 for x in word]
        return float(sum(self.table[a * STATES + b] for a, b in zip(c, c[1:], strict=False)))


def position(c: Column) -> Column:
    """A character's place in the alphabet, 0 for others."""
    return F.call_function("instr", F.lit(ALPHABET), c)


def transitions(words: DataFrame) -> np.ndarray:
    """Counts of each transition in the words of column `word`, each `n` times: at most STATES squared sums reach the driver."""
    c = words.where(F.length("word") >= 2).select(F.transform(F.split("word", ""), position).alias("c"), "n")
    pairs = c.select(F.explode(F.expr(f"zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1), (a, b) -> a * {STATES} + b)")).alias("at"), "n")
    counts = np.zeros(STATES * STATES)
    for r in pairs.groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    return counts.reshape(STATES, STATES)


def random_strings(spark: SparkSession, n: int) -> DataFrame:
    """The labelled sample of random strings: `n` hashes, each in mixed, upper-case and lower-case writing and in hexadecimal."""
    h = F.sha2(F.col("id").cast("string"), 256)
    mixed = F.translate(F.base64(F.unhex(h)), "=", "")
    return spark.range(n).select(F.explode(F.array(h, mixed, F.upper(mixed), F.lower(mixed))).alias("word"), F.lit(1).alias("n"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word of two or more ASCII letters, in lower case, occurs in all documents. Checkpointed."""
    words = pick(docs, text=("text", "string")).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("word"))
    return checkpoint(words.groupBy("word").agg(F.count("*").alias("n")))


def ordinary(words: DataFrame) -> np.ndarray:
    """Transitions of identifiers made of the counted words: alone in three writings, numbered, and joined as if each followed any other."""
    inner = transitions(words)
    low, up, digits = (np.array([ALPHABET.index(x) + 1 for x in part]) for part in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))
    first = ends_of(words, F.substring("word", 1, 2))
    last = ends_of(words, F.substring("word", -1, 1))
    letters = inner[np.ix_(low, low)]
    starts = np.zeros((26, 26))
    ends = np.zeros(26)
    for w, n in first.items():
        starts[ord(w[0]) - 97, ord(w[1]) - 97] += n
    for w, n in last.items():
        ends[ord(w) - 97] += n
    heads = starts.sum(axis=1)
    total = max(ends.sum(), 1.0)
    out = np.zeros((STATES, STATES))
    out[np.ix_(low, low)] += letters + (letters - starts)  # as they stand, and after a capital
    out[np.ix_(up, low)] += starts
    out[np.ix_(up, up)] += 0.5 * letters
    out[np.ix_(low, up)] += 0.5 * np.outer(ends, heads) / total
    for mark in "_-/":
        k = ALPHABET.index(mark) + 1
        for kind, part in ((low, 1.0), (up, 0.5)):
            out[kind, k] += part / 3 * ends
            out[k, kind] += part / 3 * heads
        out[k, digits] += 0.01 * total / 10
    out[np.ix_(low, digits)] += 0.1 * ends[:, None] / 10
    out[np.ix_(digits, digits)] += 0.1 * total / 100
    return out


def ends_of(words: DataFrame, part: Column) -> dict[str, int]:
    """Occurrences by the words' first two letters, or their last: at most 676 rows."""
    return {r.part: r.n for r in words.groupBy(part.alias("part")).agg(F.sum("n").alias("n")).collect()}


def sample_identifiers(words: list[str]) -> list[str]:
    """The labelled sample of identifiers, of `LEAST` or more characters, from words in a fixed order."""
    made = []
    for k in range(len(words)):
        w = [words[(k + 7 * j) % len(words)] for j in range(2 + k % 4)]
        made += ["_".join(w), "-".join(w), "/".join(w), w[0] + "".join(x.capitalize() for x in w[1:]), "".join(x.capitalize() for x in w), "_".join(w).upper(), f"{'_'.join(w)}_{k % 100}", "".join(w[:2])]
    return [m for m in made if len(m) >= LEAST]


def fit(docs: DataFrame, bound: int = 4000, strings: int = 4000, found: float = 0.99, most_false: float = 0.001) -> Model:
    """Both models and the threshold. STATES squared sums, a few hundred letter counts, `strings` random strings and `bound` words of least hash reach the driver."""
    spark = docs.sparkSession
    words, random = vocabulary(docs), random_strings(spark, strings)
    log = [np.log((c + 1.0) / (c + 1.0).sum(axis=1, keepdims=True)) for c in (transitions(random), ordinary(words))]
    model = Model((log[0] - log[1]).reshape(-1), 0.0)
    some = [r.word for r in least_hashed(words.where("length(word) between 3 and 20"), "word", bound).collect()]
    no = np.array([0.0, *map(model.ratio, sample_identifiers(some))])
    yes = np.array([model.ratio(r.word) for r in random.limit(strings).select(F.substring("word", 1, LEAST).alias("word")).collect()])
    model.threshold = max(float(np.quantile(yes, 1 - found)), float(np.quantile(no, 1 - most_false)))
    return model


def ratio(word: Column, table: np.ndarray) -> Column:
    """The sum of the log-likelihood ratios of a word's transitions."""
    llr = F.lit(table)
    c = F.transform(F.split(word, ""), position)
    step = lambda acc, x: F.struct((acc["sum"] + F.when(acc["last"] >= 0, F.element_at(llr, acc["last"] * STATES + x + 1)).otherwise(F.lit(0.0))).alias("sum"), x.alias("last"))
    return F.aggregate(c, F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last")), step, lambda acc: acc["sum"])


def located(kind: str) -> Column:
    """Structs of (start, rank, end) from the matches in column m_<kind> and what lies between them in column p_<kind>."""
    rank = KINDS.index(kind)
    return F.expr(
        f"""aggregate(
            zip_with(m_{kind}, slice(p_{kind}, 1, size(m_{kind})), (m, p) -> named_struct('gap', length(p), 'size', length(m))),
            named_struct('at', 0, 'out', cast(array() as {SPAN})),
            (acc, x) -> named_struct('at', acc.at + x.gap + x.size,
                'out', array_append(acc.out, named_struct('start', acc.at + x.gap, 'rank', {rank}, 'end', acc.at + x.gap + x.size))),
            acc -> acc.out)"""
    )


def matches(docs: DataFrame) -> DataFrame:
    """`docs`, its text in column `text`, with the matches and gaps of each kind; a text that can't match is not split."""
    text, none = F.col("text"), F.lit(None).cast("array<string>")
    gate = {"assign": text.contains(":") | text.contains("="), "access": text.contains("AKIA"), "hex": F.lit(True), "markov": F.lit(True)}
    df = docs.withColumns({f"m_{k}": F.when(gate[k], F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))) for k in KINDS})
    return df.withColumns({f"p_{k}": F.when(F.size(f"m_{k}") > 0, F.split(text, PATTERNS[k], -1)).otherwise(none) for k in KINDS} | {"g_assign": F.when(F.size("m_assign") > 0, F.regexp_extract_all(text, F.lit(PATTERNS["assign"]), F.lit(1))).otherwise(none)})


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """`docs`, its text in column `text`, with `base` and `found` spans, by start, then kind as listed."""
    empty = F.lit(None).cast(SPAN)
    df = matches(docs)
    df = df.withColumns({f"s_{k}": F.when(F.size(f"m_{k}") > 0, located(k)).otherwise(empty) for k in KINDS})
    long_enough = F.expr("transform(filter(arrays_zip(s_assign, g_assign), x -> length(x.g_assign) >= 12), x -> x.s_assign)")
    df = df.withColumns({"s_assign": F.when(F.size("m_assign") > 0, long_enough).otherwise(empty)})
    nothing = F.expr(f"cast(array() as {SPAN})")
    df = df.withColumn("base", F.array_sort(F.concat(*(F.coalesce(f"s_{k}", nothing) for k in KINDS[:3]))))
    likely = F.filter(F.arrays_zip("s_markov", "m_markov"), lambda x: x["m_markov"].rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(x["m_markov"], ""))) >= DISTINCT) & (ratio(x["m_markov"], model.table) >= model.threshold))
    apart = F.filter(F.transform(likely, lambda x: x["s_markov"]), lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    df = df.withColumn("s_markov", F.when(F.size("m_markov") > 0, apart).otherwise(nothing))
    return df.withColumn("found", F.array_sort(F.concat("base", "s_markov"))).drop(*(f"{p}_{k}" for p in "mps" for k in KINDS), "g_assign")


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans: arrays of (start, rank, end), rank being the kind's place in KINDS."""
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return spans(rows, model).select("doc_id", "base", "found")


def digest(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as one string."""
    names = F.array(*map(F.lit, KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return scan(docs, model, id_col, text_col).select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"), count("markov"))


def redact(docs: DataFrame, model: Model, mark: str = "[secret]") -> DataFrame:
    """`docs` with every span of its text replaced by `mark`, overlapping spans by one; other columns, and null texts, stay."""
    names = [f"edgetide_{i}" for i in range(len(docs.columns))]
    at = place(docs, "text")
    kept = docs.toDF(*names)
    rows = spans(kept.withColumn("text", F.coalesce(F.col(names[at]).cast("string"), F.lit(""))), model)
    clean = F.expr(
        f"""aggregate(found, named_struct('at', 0, 'out', ''),
            (acc, x) -> if(x.end <= acc.at, acc, named_struct('at', x.end,
                'out', concat(acc.out, if(x.start < acc.at, '', concat(substring(text, acc.at + 1, x.start - acc.at), '{mark}'))))),
            acc -> concat(acc.out, substring(text, acc.at + 1, length(text))))"""
    )
    text = F.when(F.size("found") > 0, clean).otherwise(F.col(names[at])).alias("text")
    return rows.select(*(text if i == at else F.col(n).alias(docs.columns[i]) for i, n in enumerate(names)))
