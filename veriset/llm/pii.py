"""Personal data: pattern matches, and a skip-chain conditional random field over what they leave.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers. The field's tokens are those
matches, whose labels are given, and all other chunks that look like numbers or addresses. Its factors are token features,
chain edges between neighbours, and skip edges between tokens of one document that are equal or alike (same digits, same
address in another spelling), however far apart. Loopy message passing runs until the messages stand still and makes labels of
alike tokens agree, so an entity that is written out once in a known form is found where it returns in another. Matches
keep their labels; the field adds spans that overlap none of them.

All weights are trained together by the gradient of the likelihood, with the marginals of the same message passing. The
sample (``BOUND`` documents and the bytes of ``samples``) is read whole in one task. The labels are the patterns' own matches, of
which some are written in another spelling first (:func:`planted`), and "none" for the other tokens.

Null text is the empty text. Kinds are matched independently, so matches of different kinds may overlap. A token has skip edges to
the next and to the first token alike, so their number is linear in the tokens. Very long texts are handled whole. Ties between
labels go to none. Repeated rows each get a row. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, cut, from_one_task, text_of
from .samples import BYTES, within

by_value(__name__)

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Log potentials of tokens whose label is given.
GIVEN = np.where(np.eye(len(LABELS)) == 1, 0.0, -30.0)
#: Documents that the weights are trained on, at most.
BOUND = 2000
#: Messages stand still when none changes by more than ``STILL``; rounds grow with the tokens, so that the last one hears of the first.
DAMPING, STILL = 0.3, 1e-4
NEIGHBOURS = 40

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_NUMBER = re.compile(r"[+(]?[0-9](?:(?:\[\.\]| \. |[ ().\-/]{0,2})[0-9])+")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9.-]{1,255}")
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[^\w]{0,3}$")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards so that long words cost no more than their length."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern matches, by start and then kind."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if len(m[0]) >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def tokens(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label) by start: matches with their label, other chunks with -1; chunks that overlap a match are left out."""
    out = [(a, b, LABELS.index(k)) for k, a, b in base]
    loose = []
    if "@" in text or "at)" in text or "at]" in text:
        loose += [m.span() for m in _ADDRESS.finditer(text)]
    if _DIGIT.search(text):
        loose += [m.span() for m in _NUMBER.finditer(text) if len(_DIGIT.findall(m[0])) >= 6]
    if not loose:
        return out
    taken = sorted((a, b) for a, b, _ in out)
    k, reach = 0, -1
    for a, b in sorted(loose):
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= a:
            out.append((a, b, -1))
            reach = b
    return sorted(out)


def alike(chunk: str) -> str:
    """What alike tokens have in common: the digits of a number (its last ten if it has more than ten and may be a phone's), or an address without its spelling."""
    if "@" in chunk or "at" in chunk.lower():
        return "a" + re.sub(r"[^a-z0-9]", "", re.sub(r"\(at\)|\[at\]", "@", chunk.lower()).replace("@", ""))
    digits = "".join(_DIGIT.findall(chunk))
    return "n" + (digits[-10:] if 10 <= len(digits) <= 13 else digits)


def token_features(text: str, a: int, b: int) -> list[str]:
    chunk = text[a:b]
    groups = _DIGITS.findall(chunk)
    n = sum(map(len, groups))
    m = _WORD_BEFORE.search(text, max(0, a - 24), a)
    out = ["bias", f"digits{min(n, 20)}", "groups" + "-".join(str(min(len(g), 9)) for g in groups[:8]), "marks" + "".join(sorted(set(chunk) & set(" ()[].-/+@"))), f"before:{m[1].lower() if m else ''}"]
    if "@" in chunk or "at)" in chunk or "at]" in chunk:
        out.append("address")
    if 14 <= n <= 19 and luhn("".join(groups)):
        out.append("luhn")
    if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups):
        out.append("four bytes")
    return out


def edges_of(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Pairs of token numbers, with 1 for skip edges: each token meets its neighbour, and the last and the first token alike."""
    pairs: list[tuple[int, int, int]] = []
    last: dict[str, int] = {}
    first: dict[str, int] = {}
    for i, (a, b, _) in enumerate(found):
        if i and a - found[i - 1][1] <= NEIGHBOURS:
            pairs.append((i - 1, i, 0))
        key = alike(text[a:b])
        if len(key) > 6:
            if key in last:
                pairs.append((last[key], i, 1))
                if first[key] != last[key]:
                    pairs.append((first[key], i, 1))
            last[key] = i
            first.setdefault(key, i)
    return pairs


class Messages:
    """Damped loopy sum-product in the log domain, all messages at once, over a graph of tokens."""

    def __init__(self, n: int, edges: list[tuple[int, int, int]]):
        e = np.array(edges, np.int64).reshape(-1, 3)
        self.n, self.pairs, self.skip = n, e[:, :2], e[:, 2] == 1
        self.source, self.target = np.concatenate((self.pairs, self.pairs[:, ::-1])).T
        m = len(e)
        self.back = np.concatenate((np.arange(m) + m, np.arange(m)))
        self.sent = np.zeros((2 * m, len(LABELS)))

    def tables(self, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        return np.where(self.skip[:, None, None], skip, chain)

    def beliefs(self, local: np.ndarray) -> np.ndarray:
        out = local.copy()
        np.add.at(out, self.target, self.sent)
        return out

    def run(self, local: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int) -> np.ndarray:
        """Log beliefs after at most ``rounds`` rounds, fewer if the messages stand still."""
        if len(self.pairs):
            table = self.tables(chain, skip)
            table = np.concatenate((table, table.transpose(0, 2, 1)))
            for _ in range(rounds):
                x = (self.beliefs(local)[self.source] - self.sent[self.back])[:, :, None] + table
                top = x.max(1)
                new = top + np.log(np.exp(x - top[:, None]).sum(1))
                new -= new.max(1, keepdims=True).clip(-1e9)
                new = DAMPING * self.sent + (1 - DAMPING) * new
                change = np.abs(new - self.sent).max()
                self.sent = new
                if change < STILL:
                    break
        return self.beliefs(local)

    def pair_marginals(self, beliefs: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Probabilities of the labels of each edge's two tokens."""
        m = len(self.pairs)
        one = beliefs[self.pairs[:, 0]] - self.sent[m:]
        other = beliefs[self.pairs[:, 1]] - self.sent[:m]
        x = one[:, :, None] + other[:, None, :] + self.tables(chain, skip)
        x = np.exp(x - x.max((1, 2), keepdims=True))
        return x / x.sum((1, 2), keepdims=True)


def normal(beliefs: np.ndarray) -> np.ndarray:
    p = np.exp(beliefs - beliefs.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Field:
    """Weights by feature and label, and by pair of labels for chain and skip edges; ``state`` has them plain, for workers."""

    def __init__(self, state: dict):
        self.weights, self.chain, self.skip = state["weights"], state["chain"], state["skip"]

    @property
    def state(self) -> dict:
        return {"weights": self.weights, "chain": self.chain, "skip": self.skip}

    def potentials(self, text: str, found: list[tuple[int, int, int]]) -> np.ndarray:
        out = np.zeros((len(found), len(LABELS)))
        for i, (a, b, label) in enumerate(found):
            if label >= 0:
                out[i] = GIVEN[label]
            else:
                for f in token_features(text, a, b):
                    if f in self.weights:
                        out[i] += self.weights[f]
        return out

    def posterior(self, text: str, found: list[tuple[int, int, int]]) -> np.ndarray:
        """Marginal label probabilities of each token."""
        graph = Messages(len(found), edges_of(text, found))
        return normal(graph.run(self.potentials(text, found), self.chain, self.skip, 2 * len(found) + 20))


def spans(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The pattern matches, and all spans with those that the field adds."""
    base = base_spans(text)
    found = tokens(text, base)
    if len(found) == len(base):
        return base, base
    p = field.posterior(text, found)
    more = [(LABELS[k], a, b) for (a, b, label), k in zip(found, p.argmax(1)) if label < 0 and k]
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def respelled(kind: str, chunk: str, way: int) -> str:
    """A match in another spelling, of which there are several ways."""
    groups = _DIGITS.findall(chunk)
    if kind == "email":
        return chunk.replace("@", ("(at)", " (at) ", "[at]", " @ ")[way % 4])
    if kind == "ip":
        return ("[.]", "-", " . ")[way % 3].join(groups)
    digits = "".join(groups)
    if kind == "card":
        return (".", "/", "  ", ". ")[way % 4].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return ("00" + digits, digits, "-".join(groups), "(" + digits[:-10] + ") " + digits[-10:], ".".join(groups))[way % 5]


def planted(text: str, seed: int) -> tuple[str, dict[tuple[int, int], str]]:
    """The text with some of its matches in another spelling, at their place or once more at its end, and the kinds of these spans."""
    rng = random.Random(seed)
    base = base_spans(text)
    out, last, made, again = [], 0, {}, []
    size = 0
    for k, a, b in base:
        if a < last:
            continue
        new, what = respelled(k, text[a:b], rng.randrange(60)), rng.random()
        out.append(text[last:a])
        size += a - last
        if what < 0.3:
            made[size, size + len(new)] = k
            out.append(new)
            size += len(new)
        else:
            out.append(text[a:b])
            size += b - a
            if what < 0.6:
                again.append((k, new))
        last = b
    out.append(text[last:])
    size += len(text) - last
    filler = text[:60].rsplit(" ", 1)[0]
    for k, new in again:
        out += [" ", filler, " ", new]
        size += len(filler) + 2
        made[size, size + len(new)] = k
        size += len(new)
    return "".join(out), made


def train(texts: list[str], rounds: int = 150, rate: float = 0.5, shrink: float = 2e-3) -> Field:
    """All weights by the gradient of the likelihood of the labels that aren't given; marginals by message passing over all texts at once."""
    n = len(LABELS)
    index: dict[str, int] = {}
    flat, owner, y, given, edges = [], [], [], [], []
    for seed, original in enumerate(texts):
        text, made = planted(original, seed)
        found = tokens(text, base_spans(text))
        start = len(y)
        for a, b, label in found:
            k = LABELS.index(next((kind for (p, q), kind in made.items() if p < b and a < q), "none")) if label < 0 else label
            if label < 0:
                its = [index.setdefault(f, len(index)) for f in token_features(text, a, b)]
                flat += its
                owner += [len(y)] * len(its)
            y.append(k)
            given.append(label >= 0)
        edges += [(i + start, j + start, kind) for i, j, kind in edges_of(text, found)]
    weights, chain, skip = np.zeros((len(index), n)), np.zeros((n, n)), np.zeros((n, n))
    if not index:
        return Field({"weights": {}, "chain": chain, "skip": skip})
    labels, known = np.array(y), np.array(given)
    flat, owner = np.array(flat), np.array(owner)
    graph, target = Messages(len(y), edges), np.eye(n)[labels]
    seen = np.eye(n)[labels[graph.pairs[:, 0]]][:, :, None] * np.eye(n)[labels[graph.pairs[:, 1]]][:, None, :]
    count = np.bincount(flat, minlength=len(index))[:, None]
    speed = [np.full(w.shape, 1e-8) for w in (weights, chain, skip)]
    for _ in range(rounds):
        local = np.zeros((len(y), n))
        np.add.at(local, owner, weights[flat])
        local[known] = GIVEN[labels[known]]
        beliefs = graph.run(local, chain, skip, 4)  # messages go on from those of the round before
        off = normal(beliefs) - target
        by_feature = np.zeros_like(weights)
        np.add.at(by_feature, flat, off[owner])
        by_edge = graph.pair_marginals(beliefs, chain, skip) - seen
        gradients = (by_feature / np.sqrt(count), by_edge[~graph.skip].sum(0), by_edge[graph.skip].sum(0))
        for w, g, v in zip((weights, chain, skip), gradients, speed):
            g = g + shrink * len(y) ** 0.5 * w
            v += g * g
            w -= rate * g / np.sqrt(v)
    return Field({"weights": {f: weights[i] for f, i in index.items()}, "chain": chain, "skip": skip})


def fit(spark: SparkSession, docs: DataFrame, bound: int = BOUND) -> Field:
    """A field trained on at most ``bound`` documents with tokens, chosen by hash of the id."""
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[0-9].{0,12}[0-9]|@"))
    # the hash orders all documents, so the sample doesn't depend on how they are stored
    ids = some.select("doc_id", F.xxhash64("doc_id").alias("o")).orderBy("o", "doc_id").limit(bound).select("doc_id").distinct()
    sample = within(cut(spark, some.join(F.broadcast(ids), "doc_id"), "sample"), [], [F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")], BYTES)
    state = from_one_task(sample, lambda rows: train([t for _, t in sorted((r["doc_id"], r["text"]) for r in rows)]).state)
    return Field(state) if state else train([])


def _written(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans): counts and text form of the pattern matches, and of all spans."""
    sent = docs.sparkSession.sparkContext.broadcast(field.state)

    def run(batches):
        field = Field(sent.value)
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for t in b.column(1).to_pylist():
                base, every = spans(t, field)
                kinds = [k for k, _, _ in base]
                for column, v in zip(out, (*map(kinds.count, KINDS), _written(base), _written(every))):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(out, [pa.int64()] * 4 + [pa.string()] * 2)]], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first stands."""
    out, last = [], 0
    for k, a, b in found:
        if a >= last:
            out += [text[last:a], f"[{k}]"]
            last = b
    return "".join(out) + text[last:]


def digest(found: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(_written(found).encode()).hexdigest()
