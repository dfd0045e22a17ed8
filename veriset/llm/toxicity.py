"""Toxicity by class-conditional Kneser-Ney models.

One model is fitted to toxic and one to ordinary documents. A model gives the probability of a text's words, whole and
lower-cased, in two layers. The upper one has the words' counts in the class, less an absolute discount. What the
discount sets free goes to the lower one, which spells words: interpolated Kneser-Ney over the bytes of the class's
distinct words, ``ORDER`` bytes at most, so that rare and unseen forms share the counts of their stems. Its
lowest ``SHARED`` orders are one backoff that both models share, counted over the distinct words of all
documents. Discounts come from counts of counts. Single occurrences count.

A document's score is the toxic less the ordinary log-likelihood, divided by the number of words, through a logistic
curve. Curve and threshold are fitted on labelled documents that the counts leave out. Both models learn from the same
amount of text.

The labelled sample is bounded (``BOUND`` documents a class, and the bytes of ``samples``) and fitted in one task; the shared
counts cover every document, so the table of words that they come from grows with the corpus. Texts without
words, nulls included, score by the curve at zero. Very long texts and words are read whole. With fewer than
``LEAST`` labelled documents of a class every score is 0. Ties at the threshold count as toxic. Repeated rows score alike. Extra columns are ignored or,
in ``drop_toxic``, kept. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, cut, from_one_task, lean, release, text_of
from .samples import labelled

by_value(__name__)

#: Most labelled documents of each class, of which every fifth only fits the curve, and the fewest that say anything.
BOUND, LEAST = 4000, 20
ORDER, SHARED = 5, 2
#: Words a worker remembers; longer words (characters) are not remembered.
REMEMBER, LONG_WORD = 400_000, 60
#: Bytes of new words that are spelled at once.
PIECE = 1 << 20
#: A letter of a script without spaces, or a run of other letters and digits.
UNIT = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]|[^\\W฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]+")


DIGITS = str.maketrans("123456789", "000000000")


def units(text: str) -> list[str]:
    """Words in lower case, their digits as 0: numbers differ for reasons that have nothing to do with toxicity."""
    return UNIT.findall(text.lower().translate(DIGITS))


def named(words: list[str]) -> np.ndarray:
    """Words by their XXH64, which takes a tenth of their memory."""
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) for w in words), np.uint64, len(words))


def framed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the words between marks, the word of each byte, and its place in it."""
    raw = [b"\x01" + w.encode("utf-8", "replace") + b"\x02" for w in words]
    n = np.array([len(r) for r in raw], np.int64)
    own = np.repeat(np.arange(len(raw)), n)
    return np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64), own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)


def endings(data: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The last ``k`` bytes up to each byte, inside its word, packed in one number."""
    out = np.zeros(len(data), np.uint64)
    for j in range(min(k, len(data)) - 1, -1, -1):
        before = np.concatenate((np.zeros(j, np.uint64), data[: len(data) - j]))
        before[place < j] = 0
        out = out << np.uint64(8) | before
    return out


def discount(n: np.ndarray) -> float:
    """The absolute discount n1 / (n1 + 2 n2) of some counts."""
    once, twice = int((n == 1).sum()), int((n == 2).sum())
    return min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)


def levels(grams: np.ndarray, n: np.ndarray, order: int) -> list[tuple]:
    """Kneser-Ney levels, the lowest order first: grams, their discounted shares, contexts, and what these pass down.

    ``grams`` are the distinct ones of the highest order with their counts; lower orders count distinct longer grams.
    """
    out, n = [], n.astype(float)
    for k in range(order, 0, -1):
        d = discount(n)
        contexts, at = np.unique(grams >> np.uint64(8), return_inverse=True)
        total = np.bincount(at, n)
        out.append((grams, (n - d) / total[at], contexts, d * np.bincount(at) / total))
        if k > 1:
            grams, at = np.unique(grams & np.uint64((1 << 8 * (k - 1)) - 1), return_inverse=True)
            n = np.bincount(at).astype(float)
    return out[::-1]


def counted(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of ``order`` bytes (fewer where a word begins) in some words, and how often they occur."""
    data, _, place = framed(words)
    return np.unique(endings(data, place, order)[place > 0], return_counts=True)


def found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(asked), default)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], default)


def spelled(tables: list[tuple], grams: np.ndarray) -> np.ndarray:
    """Log probability of the last byte of each gram of ``ORDER`` bytes after the others."""
    p = np.full(len(grams), 1 / 256)
    for k, (keys, share, contexts, down) in enumerate(tables, 1):
        ending = grams & np.uint64((1 << 8 * k) - 1)
        p = found(keys, share, ending, 0.0) + found(contexts, down, ending >> np.uint64(8), 1.0) * p
    return np.log(p)


class Model:
    """Log ratios of the two models by word, from a plain ``state`` that can be sent to workers."""

    def __init__(self, state: dict):
        self.state = state
        self.memory: dict[str, float] = {}
        self.grams, self.logs = np.zeros(1, np.uint64), np.zeros((2, 1))  # no gram is 0

    def spelled(self, grams: np.ndarray) -> np.ndarray:
        """Both classes' log probabilities of distinct grams, which are remembered."""
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        new = grams[self.grams[at] != grams]
        if len(new):
            if len(self.grams) > REMEMBER:
                self.grams, self.logs = self.grams[:1], self.logs[:, :1]
            more = np.array([spelled(tables, new) for tables in self.state["levels"]])
            self.grams = np.concatenate((self.grams, new))
            order = np.argsort(self.grams)
            self.grams, self.logs = self.grams[order], np.concatenate((self.logs, more), axis=1)[:, order]
            if len(new) < len(grams):
                return self.spelled(grams)
            at = np.searchsorted(self.grams, grams)
        return self.logs[:, at]

    def learn(self, new: list[str]) -> dict[str, float]:
        """Log ratios of distinct words: the spelled ones of both classes, a piece at a time, under the words' own shares."""
        s, out = self.state, {}
        at = 0
        while at < len(new):
            stop, size = at, 0
            while stop < len(new) and size < PIECE:
                size += len(new[stop]) + 2
                stop += 1
            some = new[at:stop]
            data, own, place = framed(some)
            grams, back = np.unique(endings(data, place, ORDER)[place > 0], return_inverse=True)
            logs, own = self.spelled(grams), own[place > 0]
            names, both = named(some), []
            for c in (0, 1):
                low = np.bincount(own, logs[c][back], len(some)) + np.log(s["left"][c])
                share = found(s["words"], s["share"][c], names, 0.0)
                both.append(np.where(share > 0, np.logaddexp(low, np.log(np.maximum(share, 1e-300))), low))
            out.update(zip(some, (both[1] - both[0]).tolist()))
            at = stop
        return out

    def ratios(self, texts: list[str]) -> list[float]:
        """Mean log ratio of each text's words, 0 without words; texts are read about ``PIECE`` characters at a time."""
        out: list[float] = []
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and size < PIECE:
                size += len(texts[stop])
                stop += 1
            some = [units(t) for t in texts[at:stop]]
            if len(self.memory) > REMEMBER:
                self.memory.clear()
            fresh = self.learn([w for w in {w for words in some for w in words} if w not in self.memory])
            self.memory.update((w, v) for w, v in fresh.items() if len(w) <= LONG_WORD)
            of = self.memory if all(len(w) <= LONG_WORD for w in fresh) else self.memory | fresh
            out += [sum(map(of.__getitem__, words)) / len(words) if words else 0.0 for words in some]
            at = stop
        return out

    def probabilities(self, texts: list[str]) -> np.ndarray:
        slope, level = self.state["curve"]
        return 1 / (1 + np.exp(-np.clip(slope * np.array(self.ratios(texts), float) + level, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, with a little shrinkage."""
    a, b = 0.0, 0.0
    scale = x.std() or 1.0
    z = x / scale
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(weight * (p - y) * z).sum() + 1e-3 * a, (weight * (p - y)).sum()])
        w = weight * p * (1 - p) + 1e-9
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return a / scale, b


def threshold(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Between the two ratios where taking all above as toxic has the best F1."""
    order = np.argsort(-x, kind="stable")
    x, hit = x[order], (weight * y)[order].cumsum()
    f1 = 2 * hit / (weight[order].cumsum() + hit[-1])
    f1[:-1][x[:-1] == x[1:]] = -1  # equal ratios stay together
    best = int(f1.argmax())
    return float(x[best] + x[min(best + 1, len(x) - 1)]) / 2


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each unit occurs in all documents; a word is a row a task, then summed."""

    def run(batches):
        counts: Counter = Counter()

        def rows():
            some = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return some

        for b in parts(batches):
            for t in b.column(0).to_pylist():
                counts.update(units(t))
                if len(counts) > REMEMBER:
                    yield rows()
        yield rows()

    return docs.select(text_of().alias("text")).mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def shared_grams(words: DataFrame) -> DataFrame:
    """(gram, n): in how many places of distinct words each gram of ``SHARED`` + 1 bytes stands, 2 ** 24 rows at most."""

    def run(batches):
        total: Counter = Counter()
        for b in batches:
            if b.num_rows:
                grams, n = counted(b.column(0).to_pylist(), SHARED + 1)
                total.update(dict(zip(grams.tolist(), n.tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["gram", "n"])

    return words.select("word").mapInArrow(lean(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def fit_texts(texts: list[str], y: list[int], share: float, grams: dict[int, int]) -> dict | None:
    """The state of a model; None with fewer than ``LEAST`` texts of a class. Every fifth text of a class only fits curve and threshold."""
    by_class: list[list[str]] = [[], []]
    for t, c in zip(texts, y):
        by_class[c].append(t)
    if min(map(len, by_class)) < LEAST:
        return None
    held = [some[4::5] for some in by_class]
    learned = [[t for i, t in enumerate(some) if i % 5 != 4] for some in by_class]
    # as much text of one class as of the other: the model of less text would find every rare word likelier
    least = min(sum(map(len, some)) for some in learned)
    counts = [Counter(w for t in some[: int(np.searchsorted(np.cumsum(list(map(len, some))), least)) + 1] for w in units(t)) for some in learned]
    keys = np.array(sorted(grams), np.uint64)
    low = levels(keys, np.array([grams[int(k)] for k in keys]), SHARED + 1)[:SHARED] if len(keys) else []
    words = list(set(counts[0]) | set(counts[1]))
    names, first = np.unique(named(words), return_index=True)
    words = [words[i] for i in first]
    state: dict = {"words": names, "share": [], "left": [], "levels": []}
    for n in counts:
        d, total = discount(np.array(list(n.values()))), max(sum(n.values()), 1)
        state["share"].append(np.array([max(n.get(w, 0) - d, 0) / total for w in words]))
        state["left"].append(max(d * len(n) / total, 1e-9) if n else 1.0)
        high = levels(*counted(list(n), ORDER), ORDER) if n else []
        state["levels"].append(low + high[len(low) :])
    model = Model(state)
    x = np.array(model.ratios([t for some in held for t in some]))
    t = np.array([c for c in (0, 1) for _ in held[c]], float)
    weight = np.where(t == 1, share / t.mean(), (1 - share) / (1 - t.mean()))
    slope = max(logistic(x, t, weight)[0], 1e-6)
    state["curve"] = (slope, -slope * threshold(x, t, weight))
    return state


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, usable: Column, bound: int = BOUND) -> dict | None:
    """The state of the fitted model; None with too few labels."""
    sample, share = labelled(spark, docs, labels, "toxic", usable, bound)
    if not share or share == 1:
        return None
    words = cut(spark, word_counts(docs), "words")
    grams = shared_grams(words)
    none = F.lit(None)
    rows = sample.select("y", "text", "doc_id", none.cast("long").alias("gram"), none.cast("long").alias("n"))
    rows = rows.unionByName(grams.select(none.cast("int").alias("y"), none.cast("string").alias("text"), none.cast("long").alias("doc_id"), "gram", "n"))

    def in_task(found):
        some = sorted((r["doc_id"], r["text"], r["y"]) for r in found if r["y"] is not None)
        return fit_texts([t for _, t, _ in some], [y for _, _, y in some], share, {r["gram"]: r["n"] for r in found if r["y"] is None})

    state = from_one_task(rows, in_task)
    release(spark, words)
    return state


def parts(batches, rows: int = 500):
    """Batches of few rows, of which a worker then holds the texts."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def score(docs: DataFrame, state: dict | None) -> DataFrame:
    """``docs`` (doc_id, text, ...) as (doc_id, score)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    if state is None:
        return d.select("doc_id", F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(state)

    def run(batches):
        model = Model(sent.value)
        for b in parts(batches):
            s = model.probabilities(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return d.mapInArrow(lean(run), "doc_id long, score double")


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, usable: Column, limit: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``limit`` or more."""
    state = fit(spark, docs, labels, usable)
    if state is None:
        return docs
    sent = spark.sparkContext.broadcast(state)

    def run(batches):
        model = Model(sent.value)
        for b in parts(batches):
            keep = model.probabilities([t or "" for t in b.column("text").to_pylist()]) < limit
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
