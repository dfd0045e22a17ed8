"""Quality classifier with supervised subword embeddings.

Words and their character n-grams are hashed to learned vectors; a document is the average of all of them, and a
softmax layer gives the class. Vectors and layer are trained by stochastic gradient descent in numpy on a bounded
sample of labelled documents (``BOUND`` a class, and the bytes of ``samples``), in one task. Scoring covers whole texts: since average and layer are linear, each
word contributes one number and a count, which a worker remembers unless the word is very long. Words count whole: a long one
is scored in pieces, with all its n-grams.

Texts without words, nulls included, score by the layer's bias. Without labels of both classes every score is the
share of label 1 (0.5 without labels). Very long texts and words are read whole. Repeated rows score alike. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import operator
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, from_one_task, text_of
from .samples import labelled

by_value(__name__)

BOUND = 1500
BUCKETS, DIM, EPOCHS, RATE = 1 << 17, 8, 5, 0.5
#: The bucket of word pairs of equal words: the one word n-gram besides single words. The README has figures without it.
AGAIN = BUCKETS
NGRAMS = (3, 4)
REMEMBER = 1_000_000
#: Longer words (characters) are not remembered, and read ``PIECE`` n-grams at a time.
LONG_WORD, PIECE = 60, 1 << 16


def word_features(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams, case kept, in UTF-8 with marked ends."""
    b = f"<{word}>".encode("utf-8", "replace")
    out = [zlib.crc32(b) % BUCKETS]
    for n in NGRAMS:
        out += [zlib.crc32(b[i : i + n], n) % BUCKETS for i in range(len(b) - n + 1)]
    return out


def features(text: str, memory: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often they occur."""
    out: list[int] = []
    for w in text.split():
        f = memory.get(w)
        if f is None:
            f = word_features(w)
            if len(w) <= LONG_WORD:
                memory[w] = f
        out += f
    words = text.split()
    out += [AGAIN] * sum(map(operator.eq, words, words[1:]))
    return np.unique(np.array(out, np.int64), return_counts=True)


def word_gain(word: str, gain: np.ndarray) -> complex:
    """Sum of gains and number of features of a word, the features of ``word_features`` a piece at a time."""
    b = f"<{word}>".encode("utf-8", "replace")
    total, count = float(gain[zlib.crc32(b) % BUCKETS]), 1
    for n in NGRAMS:
        last = len(b) - n + 1
        for start in range(0, last, PIECE):
            f = [zlib.crc32(b[i : i + n], n) % BUCKETS for i in range(start, min(start + PIECE, last))]
            total += float(gain[f].sum())
            count += len(f)
    return complex(total, count)


class Memory(dict):
    """A word's sum of gains and number of features, as a complex number, learned as asked for."""

    def __init__(self, gain: np.ndarray):
        super().__init__()
        self.gain = gain

    def __missing__(self, word: str) -> complex:
        found = word_gain(word, self.gain)
        if len(word) > LONG_WORD:
            return found
        if len(self) > REMEMBER:
            self.clear()
        self[word] = found
        return found


class Model:
    """``gain``: a bucket's difference of class scores; ``bias``: that of the layer."""

    def __init__(self, gain: np.ndarray, bias: float):
        self.gain, self.bias = gain, bias

    def score(self, text: str, memory: Memory) -> float:
        words = text.split()
        total = sum(map(memory.__getitem__, words))
        if words:
            again = sum(map(operator.eq, words, words[1:]))
            total += complex(again * self.gain[AGAIN], again)
        z = self.bias + (total.real / total.imag if words else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[str], y: list[int], share: float, seed: int = 42) -> Model:
    """Fit vectors and layer; classes weigh as in the whole labelled set, whose share of label 1 is ``share``."""
    rng = np.random.default_rng(seed)
    memory: dict = {}
    docs = [features(t, memory) for t in texts]
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 1, DIM))
    w, bias = np.zeros((2, DIM)), np.zeros(2)
    ones = sum(y) / len(y)
    weight = ((1 - share) / max(1 - ones, 1e-9), share / max(ones, 1e-9))
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            rate = RATE * (1 - done / steps)
            done += 1
            at, n = docs[i]
            if not len(at):
                continue
            part = (n / n.sum())[:, None]
            x = (e[at] * part).sum(0)
            z = w @ x + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = rate * weight[y[i]] * p
            e[at] -= part * (w.T @ g)[None, :] * len(at) ** 0.5
            w -= np.outer(g, x)
            bias -= 0.1 * g
    return Model(e @ (w[1] - w[0]), float(bias[1] - bias[0]))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, usable: Column, bound: int = BOUND) -> Model:
    sample, share = labelled(spark, docs, labels, "quality", usable, bound)
    if not share or share == 1:
        share = 0.5 if share is None else min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS + 1), float(np.log(share / (1 - share))))

    def in_task(rows):
        some = sorted((r["doc_id"], r["text"], r["y"]) for r in rows)
        model = train([t for _, t, _ in some], [y for _, _, y in some], share)
        return {"gain": model.gain, "bias": model.bias}

    found = from_one_task(sample, in_task)
    return Model(**found) if found else Model(np.zeros(BUCKETS + 1), float(np.log(share / (1 - share))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast({"gain": model.gain, "bias": model.bias})

    def run(batches):
        m, memory = Model(**sent.value), Memory(sent.value["gain"])
        for b in batches:
            s = [m.score(t, memory) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double")
