"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its lower-cased words, neighbouring pairs, and pairs
that skip one or two words. Per-coordinate learning rates and the L1 term leave few weights other
than zero; those are what is sent to the executors.

Edge cases: a null or empty text has no feature and gets the score of the intercept; repeated rows
are scored each; without any labelled row every score is 0.5; an empty table gives an empty result;
further columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession

from tidemark.llm import scoring
from tidemark.llm.common import WordHash, labelled_sample, learn

#: Width of the hashed feature space.
BITS = 20
#: Labelled documents that are learned from, at most.
TRAIN_ROWS = 12_000
#: Passes over the examples and the L1 term, to choose features and to fit those chosen.
SELECT, REFIT = (5, 8.0), (8, 0.1)
ALPHA, BETA = 2.0, 1.0
#: A pair's feature value beside a word's of 1, so that what one word explains is learned from the word.
PAIR_VALUE = 0.4
THRESHOLD = 0.7

_word = re.compile(r"\w+")
_pair, _skip1, _skip2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def features(text: str | None, hashes: WordHash) -> np.ndarray:
    """Distinct feature numbers of a whole text, ascending: words in the lower half, pairs in the upper."""
    words = _word.findall((text or "").lower())
    h = np.frombuffer(b"".join(map(hashes.__getitem__, words)), dtype="<u8")
    words = np.unique((h >> np.uint64(65 - BITS)).astype(np.uint32))
    parts = []
    for gap, factor in ((1, _pair), (2, _skip1), (3, _skip2)):
        if len(h) > gap:
            parts.append((h[:-gap] * factor) ^ (h[gap:] * _pair + factor))
    if not parts:
        return words
    return np.concatenate([words, np.unique((np.concatenate(parts) >> np.uint64(65 - BITS)).astype(np.uint32)) + np.uint32(1 << BITS - 1)])


def value(idx: np.ndarray) -> np.ndarray:
    """1 for a word, PAIR_VALUE for a pair."""
    return np.where(idx < 1 << BITS - 1, 1.0, PAIR_VALUE)


def passes(examples: list[tuple[np.ndarray, int]], epochs: int, l1: float) -> tuple[np.ndarray, float]:
    """Weights (feature values included) and intercept after FTRL-proximal passes over the examples."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    z0 = n0 = 0.0

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA))

    for _ in range(epochs):
        for idx, y in examples:
            zi, ni, x = z[idx], n[idx], value(idx)
            w = weights(zi, ni)
            w0 = -z0 / ((BETA + n0**0.5) / ALPHA)
            g0 = 1 / (1 + np.exp(-np.clip(w @ x + w0, -35, 35))) - y
            g = g0 * x
            z[idx] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[idx] = ni + g * g
            z0 += g0 - ((n0 + g0 * g0) ** 0.5 - n0**0.5) / ALPHA * w0
            n0 += g0 * g0
    return weights(z, n) * value(np.arange(1 << BITS)), -z0 / ((BETA + n0**0.5) / ALPHA)


def train(examples: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature numbers, weights, intercept): passes with a strong L1 term choose the few features,

    passes with a weak one over these alone undo the shrinking."""
    chosen = passes(examples, *SELECT)[0] != 0
    w, b = passes([(idx[chosen[idx]], y) for idx, y in examples], *REFIT)
    kept = np.flatnonzero(w)
    return kept, w[kept], b


def fit(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held_out: int = 1, rows: int = TRAIN_ROWS) -> dict:
    """Learn from labelled rows outside the held-out fold, in one task over a bounded sample."""

    def start() -> tuple[Callable, Callable]:
        seen: list[tuple[np.ndarray, int]] = []
        hashes = WordHash()

        def add(texts: list, ys: list) -> None:
            seen.extend((features(t, hashes), y) for t, y in zip(texts, ys, strict=True))

        return add, lambda: dict(zip(("idx", "w", "b"), train(seen), strict=True))

    sample = labelled_sample(docs, labels, "toxic", folds, held_out, False, rows)
    return learn(sample, start) or {"idx": np.array([], dtype=np.int64), "w": np.array([]), "b": 0.0}


def scorer(spark: SparkSession, model: dict) -> Callable[[Column], Column]:
    """A function from a text column to the probability that a text is toxic."""
    sent = spark.sparkContext.broadcast(model)  # as many weights as there are features, at most

    def start() -> Callable:
        dense = np.zeros(1 << BITS, dtype=np.float32)
        dense[sent.value["idx"]] = sent.value["w"]
        b = sent.value["b"]
        hashes = WordHash()
        return lambda texts: [1 / (1 + np.exp(-np.clip(dense[features(t, hashes)].sum(dtype=np.float64) + b, -35, 35))) for t in texts]

    return scoring.scorer(start)


def score(docs: DataFrame, model: dict, *keep: str) -> DataFrame:
    """``keep`` columns plus score and predicted for every row of ``docs``."""
    return scoring.with_scores(docs, scorer(docs.sparkSession, model), THRESHOLD, *keep)
