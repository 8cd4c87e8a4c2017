"""A quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel. Each task sums its rows' part of the normal equations, apart for each fold;
only those sums, of a fixed size, travel and are added up. A fold's rows are scored by the equations of the others, so
that all labels calibrate; a histogram of those scores is what the calibration is fitted to.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_texts, words
from .quality_rules import measure

STATISTICS = ("log_words", "word_length", "symbols", "repeated_lines", "repeated_words", "capitals", "digits", "letters", "lines", "distinct", "commonest", "stops")


@dataclass(frozen=True)
class Settings:
    features: int = 192
    width: float = 4.0  # of the Gaussian kernel, in standard deviations of the statistics
    ridge: float = 1.0
    bins: int = 512  # of the calibration's histogram, over scores from -0.5 to 1.5
    seed: int = 7


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    calibrated: np.ndarray  # the probability of each bin

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.weights + self.phase) * np.sqrt(2 / len(self.phase)), np.ones((len(x), 1))])

    def bin(self, x: np.ndarray) -> np.ndarray:
        return bin_of(self.features(x) @ self.beta, len(self.calibrated))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated[self.bin(x)]


def bin_of(raw: np.ndarray, bins: int) -> np.ndarray:
    return np.clip(np.floor((raw + 0.5) / 2 * bins), 0, bins - 1).astype(np.int64)


def statistics(text: str | None) -> tuple[list[float]]:
    """Statistics of a whole text that don't depend on its language; zeros for a NULL or empty one."""
    n, chars, symbols, dup, rep, lines, letters, capitals, digits = measure(text)
    if not n:
        return ([0.0] * len(STATISTICS),)
    seen = Counter(words(text))
    stops = sum(c for w, c in seen.items() if len(w) <= 3)
    return ([np.log1p(n), chars / n, min(symbols / n, 5.0), dup / max(lines, 1), rep / n, capitals / max(letters, 1), digits / max(chars, 1), letters / max(chars, 1), np.log1p(n / max(lines, 1)), len(seen) / n, max(seen.values()) / n, stops / n],)


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, x): the statistics of every row, in one pass."""
    return map_texts(docs, text, [doc_id], (("x", "array<double>"),), lambda: statistics)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def summed(rows: DataFrame, columns: list[str], size: int, partial: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of partial(batch), a vector of a fixed size, over all rows: one vector a task, added up in a second, smaller layer of tasks."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += partial(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for v in b.column(0).to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    parts = rows.select(*columns).mapInArrow(first, "v binary").repartition(32).mapInArrow(more, "v binary").collect()
    return np.sum([np.frombuffer(r["v"]) for r in parts], axis=0)


def pooled(good: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Isotonic regression of good / all over the bins, by pooling adjacent violators; an empty bin takes its neighbours' value."""
    stack: list[list[float]] = []  # [good, all, bins]
    for g, n in zip(good.tolist(), all_.tolist()):
        stack.append([g, n, 1])
        while len(stack) > 1 and (not stack[-2][1] or not stack[-1][1] or stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]):
            if stack[-2][1] and not stack[-1][1]:
                break
            top = stack.pop()
            stack[-1] = [a + b for a, b in zip(stack[-1], top)]
    out, last = [], 0.5
    for g, n, bins in stack:
        last = (g + 0.5 * 0.1) / (n + 0.1) if n else last
        out += [last] * int(bins)
    return np.maximum.accumulate(np.clip(np.array(out), 0, 1))  # shrinking small blocks more than large ones must not turn their order


def between(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Blocks of equal values joined by straight lines from centre to centre, the centre being the mean bin of a block's rows; monotone as before."""
    at = np.arange(len(values))
    block = np.cumsum(np.diff(values, prepend=values[0]) != 0)
    n, sums = np.bincount(block, counts), np.bincount(block, counts * at)
    seen = n > 0
    if not seen.any():
        return values
    return np.interp(at, sums[seen] / n[seen], values[np.flatnonzero(np.diff(block, prepend=-1))][seen])


def drawn(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights and phases of the random features."""
    rng = np.random.default_rng(s.seed)
    return rng.normal(size=(len(STATISTICS), s.features)) / s.width, rng.uniform(0, 2 * np.pi, s.features)


def scaled(rows: DataFrame, s: Settings) -> Model:
    """A model that knows the statistics' mean and deviation over the rows and scores 0.5 everywhere."""
    p = len(STATISTICS)

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x = matrix(b.column(0), p)
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    n, *rest = summed(rows, ["x"], 2 * p + 1, moments)
    n = max(n, 1.0)
    mean = np.array(rest[:p]) / n
    scale = np.sqrt(np.maximum(np.array(rest[p:]) / n - mean**2, 0)) + 1e-6
    return Model(mean, scale, *drawn(s), np.zeros(s.features + 1), np.full(s.bins, 0.5))


def cross_fit(labelled: DataFrame, folds: int, s: Settings = Settings()) -> Model:
    """A model from rows (x, y 0 or 1, fold 0 to folds - 1): ridge scores from all of them, calibrated on each fold's scores by the others.

    With no labelled rows every score is 0.5. Only sums of a fixed size reach the driver, and the equations' upper triangles at that.
    """
    p, d = len(STATISTICS), s.features + 1
    upper = np.triu_indices(d)
    size = len(upper[0]) + d
    blank = scaled(labelled, s)

    def equations(b: pa.RecordBatch) -> np.ndarray:
        f, y, of = blank.features(matrix(b.column(0), p)), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
        out = np.zeros((folds, size))
        for k in np.unique(of):
            g = f[of == k]
            out[k] = np.concatenate([(g.T @ g)[upper], g.T @ y[of == k]])
        return out.ravel()

    def solved(sums: np.ndarray) -> np.ndarray:
        a = np.zeros((d, d))
        a[upper] = sums[:-d]
        return np.linalg.solve(a + np.triu(a, 1).T + s.ridge * np.eye(d), sums[-d:])

    sums = summed(labelled, ["x", "y", "fold"], folds * size, equations).reshape(folds, size)
    total = sums.sum(0)
    others = np.stack([solved(total - own) for own in sums])

    def histogram(b: pa.RecordBatch) -> np.ndarray:
        f, y, of = blank.features(matrix(b.column(0), p)), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
        at = bin_of((f * others[of]).sum(1), s.bins)
        return np.concatenate([np.bincount(at, y, s.bins), np.bincount(at, minlength=s.bins)])

    counts = summed(labelled, ["x", "y", "fold"], 2 * s.bins, histogram)
    good, every = counts[: s.bins], counts[s.bins :]
    return replace(blank, beta=solved(total), calibrated=between(pooled(good, every), every))


def fit(labelled: DataFrame, s: Settings = Settings()) -> Model:
    """A model from rows (x, y 0 or 1, calibrate boolean): ridge scores from the rows not set aside, calibration on those that are.

    With no labelled rows every score is 0.5. Only sums of a fixed size reach the driver.
    """
    p, d = len(STATISTICS), s.features + 1
    learn = labelled.where("not calibrate")
    blank = scaled(learn, s)

    def equations(b: pa.RecordBatch) -> np.ndarray:
        f = blank.features(matrix(b.column(0), p))
        y = b.column(1).to_numpy(zero_copy_only=False)
        return np.concatenate([(f.T @ f).ravel(), f.T @ y])

    sums = summed(learn, ["x", "y"], d * d + d, equations)
    beta = np.linalg.solve(sums[: d * d].reshape(d, d) + s.ridge * np.eye(d), sums[d * d :])
    scored = replace(blank, beta=beta)

    def histogram(b: pa.RecordBatch) -> np.ndarray:
        at, y = scored.bin(matrix(b.column(0), p)), b.column(1).to_numpy(zero_copy_only=False)
        return np.concatenate([np.bincount(at, y, s.bins), np.bincount(at, minlength=s.bins)])

    counts = summed(labelled.where("calibrate"), ["x", "y"], 2 * s.bins, histogram)
    return replace(scored, calibrated=pooled(counts[: s.bins], counts[s.bins :]))


def predict(rows: DataFrame, model: Model, doc_id: str = "doc_id") -> DataFrame:
    """(id, score) for rows (id, x)."""
    kept = rows.schema[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(matrix(b.column(1), len(STATISTICS))), pa.float64())], names=[doc_id, "score"])

    return rows.select(doc_id, "x").mapInArrow(run, f"`{doc_id}` {kept.dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, may_learn: Column, set_aside: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "quality", s: Settings = Settings(), folds: int = 4) -> DataFrame:
    """(id, score) of every row of docs, 0 to 1, higher where label 1 is likelier.

    Learns from the labels of rows where may_learn holds. All of them calibrate too, in `folds` folds by a hash of the
    statistics, so that copies of a text share a fold; with set_aside, only the rows where it holds calibrate, and they do
    nothing else. Columns of docs and labels but the named ones are left alone, whatever their names. NULL
    labels teach nothing; a document with several label rows counts once for each; labels without a document are
    ignored. Texts are read once: their statistics are kept in a checkpoint. NULL and empty texts get the score of all-zero
    statistics; repeated and NULL ids keep a row each, NULL ids without labels.
    """
    stats = checkpoint(measured(docs, doc_id, text))
    y = labels.select(F.col(doc_id).alias("_label_id_"), F.col(label).cast("double").alias("y")).where("y in (0, 1)")
    way = F.pmod(F.xxhash64("x"), F.lit(folds)).cast("int").alias("fold") if set_aside is None else set_aside.alias("calibrate")
    marked = stats.select(doc_id, "x", may_learn.alias("_learn_"), way).where("_learn_")
    labelled = checkpoint(marked.join(y, marked[doc_id] == y["_label_id_"]).drop(doc_id, "_learn_", "_label_id_"))
    return predict(stats, cross_fit(labelled, folds, s) if set_aside is None else fit(labelled, s), doc_id)
