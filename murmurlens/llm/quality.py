"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Statistics come from a byte histogram and the words of the whole text.  Trees
are grown level by level from histograms of binned statistics (logistic loss,
second-order gains) and kept as complete trees in three arrays, so a batch of
documents walks down all levels with indexing alone.

Learning sees at most ``max_train`` labelled rows, half per class, chosen by a
hash of their ids; rows weigh as much as their class has in the labels.  Null
counts as the empty text and is scored like any other.  Without usable labels
each score is 0.5, with one class only it is that class.  Rows are independent:
repeated rows and ids are scored again, a null id is scored and held in.
Labels, lang, source and the id are no inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import held_out, kept_rows, labelled_sample, learnable, map_texts, slices, texts_of

FOLDS, FOLD = 4, 2
#: A document is kept from this score on.
THRESHOLD = 0.7
STATISTICS = 22


def statistics(texts: list[str]) -> np.ndarray:
    """One row of statistics per text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    owner = np.repeat(np.arange(len(raw)), sizes)
    hist = np.bincount(owner * 256 + np.frombuffer(b"".join(raw), dtype=np.uint8), minlength=256 * len(raw)).reshape(len(raw), 256)
    n_words, n_distinct, n_repeats, n_short, n_capital, n_longest = (np.zeros(len(raw)) for _ in range(6))
    for i, t in enumerate(texts):
        words = t.split()
        n_words[i], n_distinct[i] = len(words), len(set(words))
        n_repeats[i] = sum(map(eq, words, words[1:]))
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        n_short[i] = (lengths <= 2).sum()
        n_longest[i] = lengths.max() if len(words) else 0
        n_capital[i] = sum(map(str.istitle, words))
    size, words = np.maximum(sizes, 1), np.maximum(n_words, 1)
    share = hist / size[:, None]

    def of(chars: str) -> np.ndarray:
        return share[:, list(chars.encode())].sum(1)

    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(hist > 0, share * np.log(share), 0).sum(1)
    letters = share[:, 97:123].sum(1) + share[:, 65:91].sum(1)
    lines = hist[:, 10] + 1
    return np.stack([
        np.log1p(sizes), np.log1p(n_words), sizes / words, n_longest, n_distinct / words, n_distinct / np.sqrt(words), n_repeats / words,
        n_short / words, n_capital / words, entropy, letters, share[:, 65:91].sum(1), share[:, 48:58].sum(1), share[:, 128:].sum(1),
        of(" \t"), of(".,;:"), of("!?"), of("|"), of("#$%&*@~^<>{}[]\\/_=+"), of("aeiouAEIOU") / np.maximum(letters, 1e-9),
        n_words / lines, np.log1p(lines),
    ], axis=1)


@dataclass(frozen=True)
class Forest:
    """Complete binary trees, level order: split statistic and threshold of inner nodes, values of leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 48, rate: float = 0.15, least: float = 8.0) -> Forest:
        if not len(y):
            return cls.constant(0.0)
        mean = float(np.average(y, weights=weight))
        if mean in (0.0, 1.0):
            return cls.constant(30.0 if mean else -30.0)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])
        base = float(np.log(mean / (1 - mean)))
        margin, trees = np.full(len(y), base), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = weight * (p - y), weight * p * (1 - p)
            feature, threshold = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
            node = np.zeros(len(y), dtype=np.int64)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                split = np.full(width, bins + 1)
                for f, b in enumerate(binned):
                    at = (node - first) * bins + b
                    g, h, n = (np.bincount(at, w, minlength=width * bins).reshape(width, bins).cumsum(1) for w in (grad, hess, None))
                    gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                    gain[(n < least) | (n[:, -1:] - n < least)] = 0
                    gain[:, len(cuts[f]):] = 0
                    top = gain.argmax(1)
                    better = gain[np.arange(width), top] > best
                    best[better] = gain[better, top[better]]
                    feature[first:first + width][better] = f
                    split[better] = top[better]
                inner = np.arange(first, first + width)
                for k in inner[split <= bins]:
                    threshold[k] = cuts[feature[k]][split[k - first]]
                goes_right = binned[feature[node], np.arange(len(y))] > split[node - first]
                node = 2 * node + 1 + goes_right
            leaf = node - (2**depth - 1)
            g, h = (np.bincount(leaf, w, minlength=2**depth) for w in (grad, hess))
            value = -rate * g / (h + 1)
            margin += value[leaf]
            trees.append((feature, threshold, value))
        return cls(*(np.stack(part) for part in zip(*trees)), base)

    @classmethod
    def constant(cls, margin: float) -> Forest:
        return cls(np.zeros((1, 0), dtype=np.int64), np.zeros((1, 0)), np.zeros((1, 1)), margin)

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node[:1].size and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += value[node - inner]
        return 1 / (1 + np.exp(-margin))


def fit_quality(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, text: str = "text") -> Forest:
    """Trees fitted on at most ``max_train`` labelled rows outside the held-out fold."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(list(statistics(texts_of(part))), pa.list_(pa.float64()))], ["label", "x"])

    weights = class_weights(labels, "quality", FOLDS, FOLD)
    found = labelled_sample(docs, labels, "quality", max_train, FOLDS, FOLD, text).mapInArrow(rows, "label int, x array<double>").toArrow()
    y = np.asarray(found.column("label"), dtype=np.int64)
    x = np.array(found.column("x").to_pylist(), dtype=np.float64).reshape(len(y), STATISTICS)
    order = np.lexsort((*x.T, y))  # whatever order the rows came in
    x, y = x[order], y[order]
    weight = np.array([weights[v] / max(1, (y == v).sum()) for v in (0, 1)])[y]
    return Forest.fit(x, y, weight * len(y) / max(weight.sum(), 1e-9))


def class_weights(labels: DataFrame, label: str, folds: int, fold: int) -> dict[int, float]:
    """Rows of either class among the labels that may be learnt from."""
    counts = {int(r["label"]): float(r["count"]) for r in learnable(labels, label, folds, fold).groupBy("label").count().collect()}
    return {0: counts.get(0, 0.0), 1: counts.get(1, 0.0)}


def score_quality(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def make():
        def compute(texts: list[str]) -> dict:
            scores = forest.scores(statistics(texts))
            return {"score": scores, "predicted": (scores >= THRESHOLD).astype(np.int32)}

        return compute

    scored = map_texts(docs, make, "score double, predicted int", text)
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", "predicted")


def keep_quality(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the trees accept, all columns as they were."""

    def make():
        import pyarrow as pa

        return lambda texts: pa.array(forest.scores(statistics([t or "" for t in texts])) >= THRESHOLD)

    return kept_rows(docs, make, text)
