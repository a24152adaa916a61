"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean embedding of its character n-grams (3 to 5, word edges
marked, hashed into a fixed number of buckets), a text the mean of its words
and a two-class softmax on top.  In the mean a word counts with the square root
of its frequency and ``PRIOR`` neutral words are added, so neither one word said
often nor a text of three words decides alone.  Embeddings and softmax learn together, so a
misspelt word scores by the n-grams it shares with known ones.  Once trained,
every stage is linear: a word has one number, a text the mean of them.

Words of fewer than ``least`` training texts count in the means and teach nothing.
Learning sees at most ``max_train`` labelled rows, half per class, chosen by a
hash of their ids; rows weigh as much as their class has in the labels.  Null
and empty texts have no words and get the score of the bias alone.  Without
usable labels each score is 0.5, with one class only it is that class.  Rows
are independent: repeated rows and ids are scored again, a null id is scored.
Labels, lang, source and the id are no inputs of a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held_out, labelled_sample, map_texts, slices, texts_of
from .quality import class_weights

FOLDS, FOLD = 5, 0
BUCKETS = 1 << 17
SIZES = (3, 4, 5)
#: Words kept with their number in a task; when full the table starts anew.
KEPT_WORDS = 600_000
#: The softmax sees text vectors longer by this, as means of many words are short.
SCALE = 40.0
#: Neutral words added to each text.
PRIOR = 8.0


def words_of(text: str) -> list[str]:
    return text.lower().split()


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, word after word, and how many each word has (one at least)."""
    codes = np.frombuffer("".join(f"\x02{w}\x02" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    buckets, owners, h = [], [], np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(SIZES) + 1):
        h = (h[:len(codes) - n + 1] * np.uint64(0x100000001B3)) ^ codes[n - 1:]
        if n in SIZES and len(h):
            whole = owner[:len(h)] == owner[n - 1:]
            mixed = h[whole] * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((mixed >> np.uint64(47)).astype(np.int64) % BUCKETS)
            owners.append(owner[:len(h)][whole])
    if not buckets:
        return np.zeros(0, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    flat, of = np.concatenate(buckets), np.concatenate(owners)
    return flat[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of the given sizes (empty groups give 0)."""
    out = np.zeros((len(counts), *values.shape[1:]), dtype=np.float64)
    if len(values):
        starts = np.cumsum(counts) - counts
        out[counts > 0] = np.add.reduceat(values, starts[counts > 0], axis=0)
    return out


@dataclass(frozen=True)
class SubwordModel:
    """The logit of each bucket (embedding times softmax difference) and the bias."""

    bucket: np.ndarray
    bias: float

    @classmethod
    def fit(cls, bags: list[tuple[list[str], list[int]]], y: np.ndarray, weight: np.ndarray, size: int = 2, epochs: int = 60, rate: float = 0.1, least: int = 3, seed: int = 0) -> SubwordModel:
        """``bags`` are the distinct words of each text with their counts."""
        if not len(y) or len(set(y.tolist())) < 2:
            return cls(np.zeros(BUCKETS, dtype=np.float32), 0.0 if not len(y) else 30.0 if y[0] else -30.0)
        totals = np.array([np.sqrt(c).sum() for _, c in bags])
        # a word of a single text says nothing of others: it counts in the mean and teaches nothing
        texts_with = Counter(w for words, _ in bags for w in words)
        bags = [tuple(zip(*((w, n) for w, n in zip(*bag) if texts_with[w] >= least))) or ((), ()) for bag in bags]
        vocabulary = sorted({w for words, _ in bags for w in words})
        if not vocabulary:
            return cls(np.zeros(BUCKETS, dtype=np.float32), 0.0)
        index = {w: k for k, w in enumerate(vocabulary)}
        flat, n_grams = ngram_buckets(vocabulary)
        used, flat = np.unique(flat, return_inverse=True)
        n_grams = np.maximum(n_grams, 0)
        word = np.concatenate([np.fromiter((index[w] for w in words), dtype=np.int64, count=len(words)) for words, _ in bags])
        count = np.concatenate([np.array(c, dtype=np.float64) for _, c in bags])
        n_words = np.array([len(words) for words, _ in bags])
        doc = np.repeat(np.arange(len(bags)), n_words)
        count = np.sqrt(count)
        share = count / (totals + PRIOR)[doc]
        of_gram = np.repeat(np.arange(len(vocabulary)), n_grams)
        per_gram = 1 / np.maximum(n_grams, 1)
        rng = np.random.default_rng(seed)
        params = {"e": rng.normal(0, 0.1, (len(used), size)), "w": rng.normal(0, 0.5, (size, 2)), "b": np.zeros(2)}
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
        target = np.eye(2)[y]
        weight = weight / weight.sum()
        for step in range(1, epochs + 1):
            vectors = np.stack([np.bincount(of_gram, params["e"][flat, d], len(vocabulary)) for d in range(size)], axis=1) * per_gram[:, None]
            texts = np.stack([np.bincount(doc, share * vectors[word, d], len(bags)) for d in range(size)], axis=1)
            logits = texts @ params["w"] * SCALE + params["b"]
            p = np.exp(logits - logits.max(1, keepdims=True))
            error = (p / p.sum(1, keepdims=True) - target) * weight[:, None]
            to_texts = error @ params["w"].T * SCALE
            to_words = np.stack([np.bincount(word, share * to_texts[doc, d], len(vocabulary)) for d in range(size)], axis=1) * per_gram[:, None]
            grads = {"e": np.stack([np.bincount(flat, to_words[of_gram, d], len(used)) for d in range(size)], axis=1), "w": texts.T @ error * SCALE, "b": error.sum(0)}
            for k, g in grads.items():
                first, second = moments[k]
                first += 0.1 * (g - first)
                second += 0.001 * (g**2 - second)
                params[k] -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        bucket = np.zeros(BUCKETS, dtype=np.float32)
        bucket[used] = params["e"] @ (params["w"][:, 1] - params["w"][:, 0]) * SCALE
        return cls(bucket, float(params["b"][1] - params["b"][0]))

    def word_logits(self, words: list[str]) -> np.ndarray:
        flat, counts = ngram_buckets(words)
        return _sums(self.bucket[flat], counts) / np.maximum(counts, 1)


class Scorer(dict):
    """Word to logit, filled for the words of a batch at once."""

    def __init__(self, model: SubwordModel):
        super().__init__()
        self._model = model

    def scores(self, texts: list[str]) -> np.ndarray:
        bags = [Counter(words_of(t)) for t in texts]
        new = list({w for bag in bags for w in bag if w not in self})
        if len(self) + len(new) > KEPT_WORDS:
            self.clear()
            new = list({w for bag in bags for w in bag})
        if new:
            self.update(zip(new, self._model.word_logits(new).tolist()))
        logit = np.zeros(len(texts))
        for i, bag in enumerate(bags):
            counts = np.sqrt(np.fromiter(bag.values(), dtype=np.float64, count=len(bag)))
            logit[i] = counts @ np.fromiter(map(self.__getitem__, bag), dtype=np.float64, count=len(bag)) / (counts.sum() + PRIOR)
        return 1 / (1 + np.exp(-np.clip(logit + self._model.bias, -60, 60)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = 8000, text: str = "text") -> SubwordModel:
    """A model fitted on at most ``max_train`` labelled rows outside the held-out fold."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counted = [Counter(words_of(t)) for t in texts_of(part)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), pa.array([list(c) for c in counted], pa.list_(pa.string())), pa.array([list(c.values()) for c in counted], pa.list_(pa.int32()))],
                    ["label", "words", "counts"])

    weights = class_weights(labels, "toxic", FOLDS, FOLD)
    sample = labelled_sample(docs, labels, "toxic", max_train, FOLDS, FOLD, text)
    found = sample.mapInArrow(bags, "label int, words array<string>, counts array<int>").toArrow()
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("label", "words", "counts"))))  # whatever order they came in
    y = np.array([r[0] for r in rows], dtype=np.int64)
    weight = np.array([weights[v] / max(1, (y == v).sum()) for v in (0, 1)])[y]
    return SubwordModel.fit([(r[1], r[2]) for r in rows], y, weight)


def score_toxicity(docs: DataFrame, model: SubwordModel, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def make():
        scorer = Scorer(model)

        def compute(texts: list[str]) -> dict:
            scores = scorer.scores(texts)
            return {"score": scores, "predicted": (scores >= 0.5).astype(np.int32)}

        return compute

    scored = map_texts(docs, make, "score double, predicted int", text)
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", "predicted")
