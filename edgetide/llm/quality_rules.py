"""Quality rules with an isolation forest over their statistics.

Rule statistics of each whole text feed a forest of random splits; rows with
short mean path lengths are anomalous. The forest is grown on good rows only.
A node's split is drawn over its own rows' range, widened at both ends by what
the good rows span, so that a value that they never have is cut off early. The cut on the anomaly score
is calibrated on other labelled rows, good and poor, than those that the
forest was grown on, so that at most about `max_false_reject` of the good ones
fall beyond it. Every labelled row is read: ranges and counts are over all of
them, to `GRID` steps of the score. A tree is grown over 256 rows, as isolation
trees are, drawn for each tree from all the good ones it may be grown on.

Defined cases: null and empty texts have zero counts and fail the base rule;
long texts are read whole; repeated rows get equal results; an empty table
gives an empty result; without labelled good rows no forest is grown and the
base rule decides alone; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from edgetide.llm.arrow import id_and_text, map_batches, pick, texts
from edgetide.session import bound_arrow, checkpoint, ship

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "upper_rate", "mark_rate", "log_words")
WINDOW = 8


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """How many words lie in a window of `width` words that occurs at least twice. Exact: windows are ranked, not hashed."""
    if len(words) <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    span = 1
    while span < width:  # ranks of windows of 2, 4, 8 words
        pair = ids[:-span] * (int(ids.max()) + 1) + ids[span:]
        if len(seen) == len(words):
            return 0
        _, ids = np.unique(pair, return_inverse=True)
        span *= 2
    counts = np.bincount(ids)
    hit = counts[ids] > 1
    if not hit.any():
        return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(hit)
    edge[starts] += 1
    edge[starts + width] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str) -> tuple[int, ...]:
    """COUNTS, then what FEATURES needs besides: distinct words, upper-case letters, sentence marks, lines."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # splits at exactly the six ASCII spaces
    chars = len(text) - sum(text.count(c) for c in SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    dup, lines = 0, [x for x in data.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    if len(set(lines)) < len(lines):
        dup = len(lines) - len(set(lines))
    distinct = len(set(words))
    repeat = repeated_words(words) if distinct < len(words) else 0
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    marks = text.count("!") + text.count("?")
    return len(words), chars, symbols, dup, repeat, distinct, upper, marks, len(lines)


def features(s: tuple[int, ...]) -> list[float]:
    """FEATURES of one row of statistics."""
    n, chars, symbols, dup, repeat, distinct, upper, marks, lines = s
    d = max(n, 1)
    return [chars / d, symbols / d, dup / max(lines, 1), repeat / d, distinct / d ** 0.9, upper / d, marks / d, math.log1p(n)]


#: What the forest sees: all rates. Length is left to the base rule.
FOREST = ("mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "upper_rate", "mark_rate")


def forest_view(x: np.ndarray) -> np.ndarray:
    """The forest's features of rows of FEATURES, by their roots, so that small rates are told apart."""
    return np.sqrt(np.maximum(x[:, [FEATURES.index(f) for f in FOREST]], 0.0))


@dataclass
class Forest:
    """Isolation trees as flat arrays: split feature (-1: leaf), split value, left and right child, and leaf path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    norm: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1): 2 to the power of minus mean path length over its expectation."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                goes_left = x[rows, np.maximum(f, 0)] < self.value[at]
                at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)
            total += self.path[at]
        return np.exp2(-total / len(self.roots) / self.norm)


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow(x: np.ndarray, space: np.ndarray | None = None, trees: int = 100, sample: int = 256, depth: int = 12, seed: int = 7, margin: float = 1.0, extent: np.ndarray | None = None, drawn: list[np.ndarray] | None = None) -> Forest:
    """A forest of `trees` trees, each over `sample` rows of x drawn without return, with random features and split values.

    Split values are drawn over the range of a node's own rows, widened at both
    ends by `margin` of the range of x (or of a thousandth, where x has one value
    only), so rows that lie outside have short paths. `space` names further rows
    whose range is open to splits from the root on. Where x holds only rows that
    were drawn beforehand, `drawn` has each tree's places in x, and `extent` the
    range of all rows.
    """
    rng = np.random.default_rng(seed)
    size = min(sample, len(x)) if drawn is None else max(map(len, drawn))
    extent = x.max(axis=0) - x.min(axis=0) if extent is None else extent
    wider = np.maximum(margin * extent, 1e-3)
    outer = None if space is None else (np.minimum(space.min(axis=0), x.min(axis=0)), np.maximum(space.max(axis=0), x.max(axis=0)))
    nodes: list[list[float]] = []

    def build(rows: np.ndarray, low: np.ndarray | None, high: np.ndarray | None, level: int) -> int:
        k = len(nodes)
        nodes.append([-1, 0.0, k, k, level + expected_path(len(rows))])
        if level >= depth or len(rows) <= 1:
            return k
        f = int(rng.integers(x.shape[1]))
        begin, end = (rows[:, f].min() - wider[f], rows[:, f].max() + wider[f]) if low is None else (low[f], high[f])
        cut = float(rng.uniform(begin, end))
        mask = rows[:, f] < cut
        top, bottom = high, low
        if low is not None:
            top, bottom = high.copy(), low.copy()
            top[f] = bottom[f] = cut
        left, right = build(rows[mask], low, top, level + 1), build(rows[~mask], bottom, high, level + 1)
        nodes[k] = [f, cut, left, right, 0.0]
        return k

    places = (rng.choice(len(x), size, replace=False) for _ in range(trees)) if drawn is None else drawn
    roots = [build(x[rows], *(outer or (None, None)), 0) for rows in places]
    a = np.array(nodes)
    return Forest(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(roots), max(expected_path(size), 1e-9))


@dataclass
class Model:
    """A forest with its calibrated threshold; None: no labelled rows to learn from."""

    forest: Forest | None
    threshold: float


def labelled(rows: DataFrame, labels: DataFrame, label_col: str) -> DataFrame:
    """`rows` of labelled documents, with the label."""
    known = pick(labels, doc_id=("doc_id", "long"), label=(label_col, "int")).where("doc_id is not null and label is not null")
    return rows.join(known.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id")


def grown_on(doc_ids: np.ndarray) -> np.ndarray:
    """Which labelled rows the forest may be grown on; the others calibrate it."""
    return np.array([zlib.crc32(f"{i}/forest".encode()) % 2 == 0 for i in doc_ids], dtype=bool)


#: Steps of the anomaly score, which lies in 0 to 1, by which rows are counted for the threshold.
GRID = 100_000
TREES, TREE_ROWS = 100, 256


def drawn_rows(good: DataFrame, n: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows x of `good` (doc_id, x), n of them, and for each tree the places of TREE_ROWS of them (all, where there are fewer).

    A tree takes the rows of least hash by its own number. A row comes in
    question for a tree where that hash is among a few times TREE_ROWS least
    ones, so few rows are ordered and at most TREES * TREE_ROWS reach the driver.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(F.lit(seed), t, "doc_id").alias("h")))
    if n > 16 * TREE_ROWS:
        least = int(-(2**63) + 2**64 * (8 * TREE_ROWS / n))
        hashes = F.filter(hashes, lambda d: d["h"] < F.lit(least))
    spread = good.select("doc_id", "x", F.explode(hashes).alias("d")).select("doc_id", "x", "d.tree", "d.h")
    w = W.partitionBy("tree").orderBy("h", "doc_id")
    rows = spread.withColumn("place", F.row_number().over(w)).where(F.col("place") <= TREE_ROWS).groupBy("doc_id").agg(F.any_value("x").alias("x"), F.sort_array(F.collect_list("tree")).alias("trees")).orderBy("doc_id").collect()
    places: list[list[int]] = [[] for _ in range(TREES)]
    for i, r in enumerate(rows):
        for t in r.trees:
            places[t].append(i)
    return np.array([r.x for r in rows]), [np.array(p) for p in places]


def threshold(ok: np.ndarray, no: np.ndarray, max_false_reject: float) -> float:
    """The cut, from the numbers of good and poor rows at each step of the grid: from the quantile of the good ones on, the best by poor ones cut less twenty times the share of good ones."""
    beyond = lambda n: (n.sum() - np.cumsum(n)) / max(n.sum(), 1)  # noqa: E731, the share above each step
    if not no.sum():
        return float(np.flatnonzero(ok).max() + 1) / GRID
    allowed = np.flatnonzero(beyond(ok) <= max_false_reject)
    gain = beyond(no)[allowed] - 20 * beyond(ok)[allowed]
    return float(allowed[int(np.argmax(gain))] + 1) / GRID


def fit(docs: DataFrame, labels: DataFrame, max_false_reject: float = 0.005, seed: int = 7) -> Model:
    """Grow the forest on the good ones of half the labelled rows, and calibrate its threshold on the other half; every labelled row is read."""
    ship(docs.sparkSession)
    bound_arrow(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64())), ("n", pa.int64()), ("own", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in texts(batch)]
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays([ids, pa.array([features(s) for s in found], schema.field("x").type), pa.array([s[0] for s in found], pa.int64()), pa.array(grown_on(ids.to_numpy()), pa.bool_())], schema=schema)

    # Statistics come before the join, so that no text is shuffled.
    counted = id_and_text(docs).where("doc_id is not null").mapInArrow(run, "doc_id long, x array<double>, n long, own boolean")
    rows = labelled(counted, labels, "quality").groupBy("doc_id", "own").agg(F.min(F.struct("label", "x", "n")).alias("r")).select("doc_id", "own", "r.*")
    rate = F.element_at("x", FEATURES.index("repeat_rate") + 1)
    view = F.array(*(F.sqrt(F.greatest(F.element_at("x", FEATURES.index(f) + 1), F.lit(0.0))) for f in FOREST))
    rows = checkpoint(rows.where((F.col("n") >= 20) & (rate <= 0.3)).select("doc_id", "own", "label", view.alias("x")))  # the base rule decides the others
    good = rows.where("own and label = 1")
    ends = good.agg(F.count("*").alias("n"), *(f(F.element_at("x", i + 1)).alias(f"{name}{i}") for i in range(len(FOREST)) for name, f in (("low", F.min), ("high", F.max)))).first()
    if ends.n < 8 or rows.where("not own and label = 1").limit(8).count() < 8:
        return Model(None, 1.0)
    x, drawn = drawn_rows(good, ends.n, seed)
    extent = np.array([ends[f"high{i}"] - ends[f"low{i}"] for i in range(len(FOREST))])
    forest = grow(x, seed=seed, extent=extent, drawn=drawn)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = forest.score(np.array(batch.column(1).to_pylist()).reshape(-1, len(FOREST)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.minimum(at * GRID, GRID - 1).astype(np.int64))], names=["label", "step"])

    counts = {0: np.zeros(GRID, dtype=np.int64), 1: np.zeros(GRID, dtype=np.int64)}
    for r in rows.where("not own and label in (0, 1)").select("label", "x").mapInArrow(score, "label int, step long").groupBy("label", "step").count().collect():  # two rows a step at most
        counts[r.label][r.step] = r["count"]
    return Model(forest, threshold(counts[1], counts[0], max_false_reject))


def apply(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, COUNTS, base_failed, anomaly (score in 0 to 1; null without a forest) and kept for every document."""

    def factory() -> Callable[[list[str]], list[tuple]]:
        def rows(texts: list[str]) -> list[tuple]:
            stats = [statistics(t) for t in texts]
            scores = model.forest.score(forest_view(np.array([features(s) for s in stats]))).tolist() if model.forest and stats else [None] * len(stats)
            out = []
            for s, score in zip(stats, scores, strict=True):
                failed = s[0] < 20 or 100 * s[4] > 30 * s[0]
                out.append((*s[:5], failed, score, not failed and (score is None or score <= model.threshold)))
            return out

        return rows

    fields = [(n, "long", pa.int64()) for n in COUNTS]
    return map_batches(docs, factory, [*fields, ("base_failed", "boolean", pa.bool_()), ("anomaly", "double", pa.float64()), ("kept", "boolean", pa.bool_())], id_col, text_col)
