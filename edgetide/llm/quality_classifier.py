"""Quality by co-training of a text-content and a page-metadata classifier.

Each view is a logistic classifier over its own features: statistics of the
whole text, or language, source, both together and length as the page states
them. Views are fitted with both classes weighing alike, so a score of 0 is no
evidence. In each round every unlabelled row of the corpus is scored by both
views, on the executors. Each view picks, by rank, its surest rows of each
class, `share` of the corpus in the classes' labelled proportion, and hands
them to the other as pseudo-labels. Each weighs as much as its view is sure of
it, by a score that is calibrated on rows kept apart, so a view that proves
worth nothing teaches nothing; together they weigh at most a quarter of the
labelled rows. The other view is fitted anew from the sums of their gradients
and curvatures, so what reaches the driver in a round are two histograms of
scores and two sums.

Labelled rows, at most `bound` of them, those of least hashed id, are split in
four: to train, to calibrate each view, to fit the logistic curve that blends
the calibrated views, and to set the least score that is kept. No row whose
crc32 of the id, modulo 5, is 0 is learned from, with label or without.

Defined cases: null and empty texts have zero statistics, null metadata reads
as empty or 0; long texts are read whole; repeated rows get equal scores; an
empty table gives an empty result; without labelled rows of both kinds every
document is kept with a score of one half; other columns are ignored, whatever
their names. Texts are read twice, to learn and to score, unless `featured`
rows are handed on.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.llm.arrow import filter_rows, least_hashed, pick, place
from edgetide.llm.linear import logistic
from edgetide.llm.quality_rules import features, statistics
from edgetide.session import bound_arrow, checkpoint, ship

COLUMNS = ("text", "lang", "source", "n_chars")
BUCKETS = 32
HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"
#: Scores are counted in so many bins between minus and plus LIMIT.
BINS, LIMIT = 4096, 15.0


def content(text: str) -> list[float]:
    """The content view: rates of the rule statistics and shares of character classes and line shapes."""
    n = max(len(text), 1)
    words = text.split()
    w = max(len(words), 1)
    letters = sum(map(str.isalpha, words))
    return [
        *features(statistics(text)),
        math.log1p(n),
        text.count("\n") / w,
        text.count(".") / w,
        text.count(",") / w,
        text.count("|") / w,
        letters / w,
        len(set(words)) / w,
        sum(len(x) <= 3 for x in words) / w,
        max(map(len, words), default=0) / 50,
    ]


def metadata(lang: str | None, source: str | None, n_chars: float | None, found: int) -> list[float]:
    """The metadata view: hashed language, source and both together, the stated length, and what it is over the found one."""
    row = [0.0] * (3 * BUCKETS + 2)
    for k, name in enumerate((lang or "", source or "", f"{lang or ''}/{source or ''}")):
        row[k * BUCKETS + zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS] = 1.0
    row[-2] = math.log1p(max(0.0, float(n_chars or 0)))
    row[-1] = row[-2] - math.log1p(found)
    return row


@dataclass
class View:
    """A standardised logistic classifier with its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    calibration: tuple[float, float] = (0.0, 1.0)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> View:
        """From labelled rows, both classes weighing alike."""
        mean, scale = x.mean(axis=0), x.std(axis=0)
        view = cls(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(x.shape[1] + 1))
        view.settle(x, y)
        return view

    def settle(self, x: np.ndarray, y: np.ndarray, pseudo: tuple[np.ndarray, np.ndarray] | None = None, ridge: float = 2.0, steps: int = 30) -> None:
        """Newton's method on labelled rows, with a gradient and curvature of pseudo-labelled ones as they were at the present weights."""
        design, begun = self.design(x), self.weights.copy()
        balance = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        penalty = np.full(design.shape[1], ridge)
        penalty[0] = 1e-3
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(design @ self.weights, -30, 30)))
            slope = design.T @ (balance * (y - p)) - penalty * self.weights
            curve = (design * (balance * p * (1 - p))[:, None]).T @ design + np.diag(penalty + 1e-6)
            if pseudo is not None:
                slope = slope + pseudo[0] - pseudo[1] @ (self.weights - begun)
                curve = curve + pseudo[1]
            step = np.clip(np.linalg.solve(curve, slope), -5, 5)
            self.weights = self.weights + step
            if np.abs(step).max() < 1e-6:
                break

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The score before calibration: 0 is no evidence."""
        return np.clip(self.design(x) @ self.weights, -LIMIT, LIMIT)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.calibration[0] + self.calibration[1] * self.raw(x)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        a, b = logistic(np.column_stack([np.ones(len(x)), self.raw(x)]), y)
        self.calibration = (float(a), max(0.0, float(b)))


@dataclass
class Model:
    """Both calibrated views, how they combine, the least score that is kept, and what was handed over: (round, from, rows, good ones, change of the other's weights)."""

    views: list[View]
    blend: np.ndarray
    threshold: float
    handed: list[tuple[int, str, int, int, float]] = field(default_factory=list)

    def score(self, both: list[np.ndarray]) -> np.ndarray:
        if not self.views:
            return np.full(len(both[0]), 0.5)
        z = self.blend[0] + sum(b * v.logit(x) for b, v, x in zip(self.blend[1:], self.views, both, strict=True))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def histograms(views: list[View], x: list[np.ndarray]) -> np.ndarray:
    """How many rows each view scores in each bin."""
    at = [np.minimum(((v.raw(part) + LIMIT) * (BINS / (2 * LIMIT))).astype(np.int64), BINS - 1) for v, part in zip(views, x, strict=True)]
    return np.stack([np.bincount(a, minlength=BINS) for a in at])


def cuts(counts: np.ndarray, share: float, good: float) -> tuple[float, float]:
    """Scores from which on, and up to which, a view is surest: `share` of all rows, by rank, in the classes' proportion. Never on the wrong side of 0."""
    edges = np.linspace(-LIMIT, LIMIT, BINS + 1)
    wanted = share * counts.sum()
    upper = counts[::-1].cumsum()[::-1]  # rows in a bin or above
    top = int(np.flatnonzero(upper >= max(1, wanted * good))[-1]) if counts.sum() else BINS
    low = int(np.flatnonzero(counts.cumsum() >= max(1, wanted * (1 - good)))[0]) if counts.sum() else 0
    return max(1e-9, float(edges[top])), min(-1e-9, float(edges[low + 1]))


def pseudo_sums(views: list[View], bounds: list[tuple[float, float]], x: list[np.ndarray]) -> list[np.ndarray]:
    """For each view as taught by the other: [rows, good ones, gradient, curvature] over the rows that the other is surest of, by their weights."""
    out = []
    for other in (0, 1):
        mine = 1 - other
        z = views[mine].raw(x[mine])
        top, low = bounds[mine]
        chosen = (z >= top) | (z <= low)
        z, y = z[chosen], (z[chosen] > 0).astype(float)
        design = views[other].design(x[other][chosen])
        sure = np.abs(2 / (1 + np.exp(-views[mine].calibration[1] * z)) - 1)  # by what its scores proved worth
        p = 1 / (1 + np.exp(-np.clip(design @ views[other].weights, -30, 30)))
        slope = design.T @ (sure * (y - p))
        curve = (design * (0.25 * sure)[:, None]).T @ design  # the most the curvature can be, so that a step never overshoots
        out.append(np.concatenate([[len(y), y.sum()], slope, curve.reshape(-1)]))
    return out


@dataclass
class Rows:
    """An unlabelled pool in memory."""

    x: list[np.ndarray]

    def histograms(self, views: list[View]) -> np.ndarray:
        return histograms(views, self.x)

    def sums(self, views: list[View], bounds: list[tuple[float, float]]) -> list[np.ndarray]:
        return pseudo_sums(views, bounds, self.x)


@dataclass
class Table:
    """An unlabelled pool of any size: rows of both views' features, counted and added up on the executors."""

    rows: DataFrame

    def added(self, of: Callable[[list[np.ndarray]], list[np.ndarray]]) -> list[np.ndarray]:
        """The sums over all batches of a few arrays of fixed length."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: list[np.ndarray] | None = None
            for batch in batches:
                if batch.num_rows:
                    found = of(unpacked(batch))
                    total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
            for k, a in enumerate(total or []):
                at = np.flatnonzero(a)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(a[at].astype(np.float64))], names=["k", "at", "v"])

        found = self.rows.select("content", "metadata").mapInArrow(run, "k long, at long, v double").groupBy("k", "at").agg(F.sum("v").alias("v")).collect()
        sizes = {}
        for r in found:
            sizes[r.k] = max(sizes.get(r.k, 0), r["at"] + 1)
        out = [np.zeros(sizes.get(k, 0)) for k in (0, 1)]
        for r in found:
            out[r.k][r["at"]] = r.v
        return out

    def histograms(self, views: list[View]) -> np.ndarray:
        return np.stack([np.pad(a, (0, BINS - len(a))) for a in self.added(lambda x: list(histograms(views, x)))])

    def sums(self, views: list[View], bounds: list[tuple[float, float]]) -> list[np.ndarray]:
        whole = [2 + (n := len(v.weights)) + n * n for v in views]
        return [np.pad(a, (0, n - len(a))) for a, n in zip(self.added(lambda x: pseudo_sums(views, bounds, x)), whole, strict=True)]


def teach(views: list[View], labelled: list[np.ndarray], y: np.ndarray, pool: Rows | Table, rounds: int, share: float, apart: tuple[list[np.ndarray], np.ndarray] | None = None) -> list[tuple[int, str, int, int, float]]:
    """Rounds of pseudo-labels from each view to the other; what was handed over. On the labelled rows `apart`, if given, each round shows what a view's scores are worth."""
    handed = []
    for k in range(rounds):
        for view, x in zip(views, apart[0], strict=True) if apart else ():
            view.calibrate(x, apart[1])
        bounds = [cuts(c, share, float(y.mean())) for c in pool.histograms(views)]
        sums = pool.sums(views, bounds)
        for other, (view, found) in enumerate(zip(views, sums, strict=True)):
            n, rows = len(view.weights), found[0]
            before = view.weights
            if rows:
                part = min(1.0, 0.25 * len(y) / rows)  # all of them weigh at most a quarter of the labelled rows
                view.settle(labelled[other], y, (part * found[2 : 2 + n], part * found[2 + n :].reshape(n, n)))
            handed.append((k, ("metadata", "content")[other], int(rows), int(found[1]), float(np.linalg.norm(view.weights - before))))
    return handed


def co_train(labelled: list[np.ndarray], y: np.ndarray, unlabelled: list[np.ndarray], rounds: int = 5, share: float = 0.1) -> list[View]:
    """Views that taught each other over rows in memory."""
    views = [View.fit(x, y) for x in labelled]
    teach(views, labelled, y, Rows(unlabelled), rounds, share)
    return views


def both_views(texts: list[str | None], lang: list, source: list, n_chars: list) -> list[np.ndarray]:
    """Features by view."""
    rows = [t or "" for t in texts]
    return [np.array([content(t) for t in rows]), np.array([metadata(*m, len(t)) for t, *m in zip(rows, lang, source, n_chars, strict=True)])]


def unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Both views of a batch of stored features."""
    out = []
    for name in ("content", "metadata"):
        column = batch.column(batch.schema.get_field_index(name))
        out.append(column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64))
    return out


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, content and metadata of every row, from whole texts; a column of COLUMNS that isn't there reads as null. Checkpointed."""
    spark = docs.sparkSession
    ship(spark)
    bound_arrow(spark)
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "double"}
    there = {c: k for c, k in kinds.items() if c.lower() in [n.lower() for n in docs.columns]}
    rows = pick(docs, doc_id=("doc_id", "long"), **{c: (c, k) for c, k in there.items()})
    rows = rows.select("doc_id", *(F.col(c) if c in there else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.list_(pa.float32())), ("metadata", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                views = both_views(*(batch.column(k).to_pylist() for k in range(1, 5)))
                arrays = [pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.reshape(-1).astype(np.float32))) for v in views]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema=schema)

    return checkpoint(rows.mapInArrow(run, "doc_id long, content array<float>, metadata array<float>"))


def fit(docs: DataFrame, labels: DataFrame, bound: int = 6000, rounds: int = 4, share: float = 0.1, most_rejected: float = 0.005, rows: DataFrame | None = None) -> Model:
    """Co-train on at most `bound` labelled rows and all unlabelled ones. `rows` are docs as `featured`, where they are at hand."""
    rows = featured(docs) if rows is None else rows
    known = pick(labels, doc_id=("doc_id", "long"), label=("quality", "int")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = least_hashed(known.where(f"not {HELD_OUT}"), "doc_id", bound)
    sample = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("label", "content", "metadata")).alias("r")).orderBy("doc_id").select("doc_id", "r.*").collect()
    x = [np.array([r[v] for r in sample], dtype=np.float64) for v in ("content", "metadata")]
    y = np.array([r.label for r in sample], dtype=float)
    if (y == 0).sum() < 8 or (y == 1).sum() < 8:
        return Model([], np.zeros(3), 0.0)
    part = np.array([zlib.crc32(f"{r.doc_id}/part".encode()) % 8 for r in sample])
    splits = [part < 5, part == 5, part == 6, part == 7]  # train, calibrate, blend, threshold
    train, calibrate, blend, last = (s if len(set(y[s])) == 2 else np.ones(len(y), dtype=bool) for s in splits)
    views = [View.fit(v[train], y[train]) for v in x]
    pool = Table(rows.join(known.select("doc_id"), "doc_id", "left_anti").where(f"doc_id is not null and not {HELD_OUT}"))
    if rounds:
        pool = Table(checkpoint(pool.rows.select("content", "metadata")))
    handed = teach(views, [v[train] for v in x], y[train], pool, rounds, share, ([v[calibrate] for v in x], y[calibrate]))
    for view, v in zip(views, x, strict=True):
        view.calibrate(v[calibrate], y[calibrate])
    z = np.column_stack([np.ones(blend.sum()), *(view.logit(v[blend]) for view, v in zip(views, x, strict=True))])
    model = Model(views, logistic(z, y[blend]), 0.5, handed)
    good = model.score([v[last] for v in x])[y[last] == 1]
    model.threshold = min(0.5, float(np.quantile(good, most_rejected)))
    return model


def score(docs: DataFrame, model: Model, rows: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted and kept for every document."""
    rows = featured(docs) if rows is None else rows
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = model.score(unpacked(batch))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(s >= model.threshold)], schema=schema)

    scored = rows.mapInArrow(run, "doc_id long, score double, kept boolean")
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"), "kept")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, with all their columns, that the model keeps."""
    there = [n.lower() for n in docs.columns]
    at = [place(docs, c) if c in there else None for c in COLUMNS]

    def factory() -> Callable[[pa.RecordBatch], list[bool]]:
        def mask(batch: pa.RecordBatch) -> list[bool]:
            if not batch.num_rows:
                return []
            views = both_views(*([None] * batch.num_rows if i is None else batch.column(i).to_pylist() for i in at))
            return (model.score([v.astype(np.float32).astype(np.float64) for v in views]) >= model.threshold).tolist()  # as stored features are

        return mask

    return filter_rows(docs, factory)
