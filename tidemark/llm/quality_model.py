"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

A word's vector is the sum of its neighbours' sparse ternary index vectors over a bounded labelled
sample (random indexing, hashed vocabulary). A document pools the vectors of its words and of their
shapes (case, digits, symbol runs, "as the word before"); a small numpy network turns the pools into
a probability, calibrated by a temperature that is chosen on rows kept out of the network's training.

Edge cases: a null or empty text pools to zeros and still gets a score; repeated rows are scored
each; without a labelled row, or with one class only, every score is 0.5; an empty table gives an
empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession

from tidemark.llm import scoring
from tidemark.llm.common import CACHE_WORDS, labelled_sample, learn

#: Labelled documents that are learned from, at most.
TRAIN_ROWS = 8000
#: Hashed vocabulary, length of a vector, entries other than zero of an index vector, neighbours on each side.
WORDS, DIM, NONZERO, SIDE = 1 << 14, 32, 4, 2
HIDDEN, EPOCHS, BATCH, RATE = 32, 25, 64, 0.003
THRESHOLD = 0.3

_token = re.compile(r"\w+|[^\w\s]+")
_AGAIN = 1


class TokenIds(dict):
    """token -> its vocabulary number and its shape's, as eight bytes; emptied when full."""

    def __missing__(self, token: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        first = token[0]
        if not (first.isalnum() or first == "_"):
            shape = f"symbol {first} {min(len(token), 3)}"
        elif token.isdigit():
            shape = "digits"
        else:
            shape = f"{'upper' if token.isupper() else 'title' if token[0].isupper() else 'lower'} {min(len(token) // 4, 4)}"
        value = self[token] = np.array([_number(token.lower()), _number(f"\x00{shape}")], dtype="<u4").tobytes()
        return value


def _number(token: str) -> int:
    return 2 + xxhash.xxh3_64_intdigest(token.encode("utf-8", "replace")) % (WORDS - 2)


def token_ids(text: str | None, ids: TokenIds) -> np.ndarray:
    """(2, n): the vocabulary numbers of all tokens; below, of their shapes."""
    pairs = np.frombuffer(b"".join(map(ids.__getitem__, _token.findall(text or ""))), dtype="<u4").reshape(-1, 2).T.astype(np.int64)
    if pairs.shape[1] > 1:
        pairs[1, 1:][pairs[0, 1:] == pairs[0, :-1]] = _AGAIN
    return pairs


def word_vectors(documents: list[np.ndarray]) -> np.ndarray:
    """Random indexing: unit-length sums of neighbours' index vectors, one row for each vocabulary number."""
    rng = np.random.default_rng(7)
    place = rng.integers(0, DIM, (WORDS, NONZERO))
    sign = rng.choice([-1.0, 1.0], (WORDS, NONZERO))
    out = np.zeros(WORDS * DIM)
    for pairs in documents:
        for row in pairs:
            for gap in range(1, SIDE + 1):
                for word, near in ((row[:-gap], row[gap:]), (row[gap:], row[:-gap])):
                    np.add.at(out, (word[:, None] * DIM + place[near]).ravel(), sign[near].ravel())
    vectors = out.reshape(WORDS, DIM)
    # a word's own index vector breaks ties between words of like neighbours
    np.add.at(vectors, (np.arange(WORDS)[:, None], place), sign * 0.5)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(pairs: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean vectors of the words and the shapes, and the words' spread."""
    if not pairs.shape[1]:
        return np.zeros(3 * DIM)
    words = vectors[pairs[0]]
    mean = words.mean(0)
    return np.concatenate([mean, vectors[pairs[1]].mean(0), np.sqrt(np.maximum((words * words).mean(0) - mean * mean, 0))])


def forward(x: np.ndarray, net: dict) -> np.ndarray:
    return (np.tanh(((x - net["mean"]) / net["std"]) @ net["w1"] + net["b1"]) @ net["w2"] + net["b2"])[:, 0]


def train(x: np.ndarray, y: np.ndarray) -> dict:
    """Two layers by Adam on four fifths of the rows; the temperature by the likelihood of the other fifth."""
    rng = np.random.default_rng(11)
    aside = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), bool)
    xt, yt = x[~aside], y[~aside]
    net = {"mean": xt.mean(0), "std": xt.std(0) + 1e-6, "w1": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), "b2": np.zeros(1), "t": 1.0}
    scaled = (xt - net["mean"]) / net["std"]
    names = ("w1", "b1", "w2", "b2")
    m, v, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(xt))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            h = np.tanh(scaled[some] @ net["w1"] + net["b1"])
            g = ((1 / (1 + np.exp(-(h @ net["w2"] + net["b2"])[:, 0])) - yt[some]) / len(some))[:, None]
            gh = (g @ net["w2"].T) * (1 - h * h)
            grads = {"w1": scaled[some].T @ gh + 1e-4 * net["w1"], "b1": gh.sum(0), "w2": h.T @ g + 1e-4 * net["w2"], "b2": g.sum(0)}
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                net[k] = net[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    if aside.any():
        logits = forward(x[aside], net)
        loss = lambda t: np.mean(np.logaddexp(0, logits / t) - y[aside] * logits / t)
        net["t"] = float(min(np.geomspace(0.5, 5, 47), key=loss))
    return net


def fit(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held_out: int = 0, rows: int = TRAIN_ROWS) -> dict | None:
    """Learn from labelled rows outside the held-out fold, in one task over a bounded sample."""

    def start() -> tuple[Callable, Callable]:
        ids, documents, ys = TokenIds(), [], []

        def add(texts: list, labels: list) -> None:
            documents.extend(token_ids(t, ids).astype(np.int16 if WORDS <= 1 << 15 else np.int32) for t in texts)
            ys.extend(labels)

        def finish() -> dict | None:
            if len(set(ys)) < 2:
                return None
            vectors = word_vectors([d.astype(np.int64) for d in documents])
            return {"vectors": vectors} | train(np.array([pooled(d, vectors) for d in documents]), np.array(ys, dtype=np.float64))

        return add, finish

    return learn(labelled_sample(docs, labels, "quality", folds, held_out, False, rows), start)


def scorer(spark: SparkSession, model: dict | None) -> Callable[[Column], Column]:
    """A function from a text column to the probability that a text's quality is 1."""
    sent = spark.sparkContext.broadcast(model)  # WORDS x DIM numbers and the network

    def start() -> Callable:
        net, ids = sent.value, TokenIds()
        if net is None:
            return lambda texts: [0.5] * len(texts)

        def work(texts: list) -> list:
            if not texts:
                return []
            x = np.array([pooled(token_ids(t, ids), net["vectors"]) for t in texts])
            return (1 / (1 + np.exp(-np.clip(forward(x, net) / net["t"], -35, 35)))).tolist()

        return work

    return scoring.scorer(start)


def score(docs: DataFrame, model: dict | None, *keep: str) -> DataFrame:
    """``keep`` columns plus score (that quality is 1) and predicted for every row of ``docs``."""
    return scoring.with_scores(docs, scorer(docs.sparkSession, model), THRESHOLD, *keep)
