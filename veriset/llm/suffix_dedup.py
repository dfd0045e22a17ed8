"""Exact removal of repeated byte strings with suffix arrays.

Every byte goes that lies in a string of ``LENGTH`` bytes which also starts anywhere else. Suffixes of the whole
corpus don't fit one array, so they are dealt to shards by content: in each window of ``LENGTH`` bytes the least
hash of its ``GRAM``-byte grams is the window's anchor, and equal windows have equal anchors. Anchors that occur
once in the corpus are dropped. For the others the bytes of the windows that they stand for go to the anchor's
shard, where the suffix array is built by Larsson-Sadakane refinement (prefix doubling that sorts only what is
still tied) and the common prefixes by Kasai's bound. A window is repeated if a suffix beside its own shares
``LENGTH`` bytes. Since equal windows meet in one shard, merging shards means merging the intervals that
they report for a document, by binary search.

Exact copies share one digest and one set of anchors; all of a copied text of ``LENGTH`` bytes or more goes. An anchor that
occurs ``HOT`` times or more is split further by the 16 bytes left or right of it, whichever lies inside the window.

A row is known by its doc_id and a 64-bit hash t of its text, so rows that repeat a doc_id or have none are documents of their own:
with equal texts they are copies, with different texts they share nothing. Null text is the empty text. Ties don't arise. Very
long texts are hashed in chunks. Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, cut, text_of

by_value(__name__)

LENGTH, GRAM = 200, 100
#: Windows start at most SIDE before their anchor; texts are hashed in chunks of about CHUNK bytes.
SIDE, CHUNK = LENGTH - GRAM, 1 << 21
HOT = 2000
#: Bytes of windows a shard holds, about.
SHARD = 6_000_000
BASE = 0x9E3779B97F4A7C15 | 1
NO_ID = -(2**63)
#: A place, packed: id, t and first window.
PLACE, PLACE_BYTES = "<qqq", 24


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _table() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sliding_least(a: np.ndarray, w: int) -> np.ndarray:
    """Least of every ``w`` neighbours, by least prefixes and suffixes of blocks."""
    n = len(a) - w + 1
    padded = np.full(-(-len(a) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(a)] = a
    blocks = padded.reshape(-1, w)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[:n], prefix[w - 1 : w - 1 + n])


def anchors(raw: bytes, table: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: its place, the first window it stands for, how many, and its hash. Long texts go in overlapping chunks."""
    out = []
    n_windows = len(raw) - LENGTH + 1
    step = len(up) - LENGTH
    for lo in range(0, max(n_windows, 0), step):
        part = np.frombuffer(raw, np.uint8, min(len(raw) - lo, step + LENGTH - 1), lo)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * up[: len(part)], out=sums[1:])
        h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(part) - GRAM + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        keyed = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        least = sliding_least(keyed, SIDE + 1) & np.uint64(0xFFFFFF)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        at = least[first].astype(np.int64)
        out.append((at + lo, first + lo, np.diff(np.append(first, len(least))), h[at].view(np.int64)))
    if not out:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out))


def scan(docs: DataFrame) -> DataFrame:
    """(id, t, digest, h array, p array) of (id, t, text): p packs place, windows before and number of windows of each anchor."""

    def run(batches):
        table, (up, down) = _table(), _powers(CHUNK)
        for b in batches:
            digests, hs, ps = [], [], []
            for t in b.column(2).to_pylist():
                raw = t.encode("utf-8", "surrogatepass")
                at, first, count, h = anchors(raw, table, up, down)
                digests.append(hashlib.sha256(raw).digest()[:16])
                hs.append(h)
                ps.append(at << 16 | (at - first) << 8 | (count - 1))
            ends = np.cumsum([0, *map(len, hs)]).astype(np.int32)
            flat = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*x, np.empty(0, np.int64)]))) for x in (hs, ps)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), *flat], names=["id", "t", "digest", "h", "p"])

    return docs.mapInArrow(run, "id long, t long, digest binary, h array<bigint>, p array<bigint>")


def windows_of(raw: bytes, picked: list) -> list[tuple[int, int, int, bytes]]:
    """(shard key, first window, number of windows, bytes) for the (h, p, hot) of a text's repeated anchors."""
    out = []
    for h, p, hot in picked:
        at, before, count = p >> 16, p >> 8 & 255, (p & 255) + 1
        first = at - before
        if not hot:
            out.append((h, first, count, raw[first : first + count + LENGTH - 1]))
            continue
        left = min(max(before - SIDE // 2 + 1, 0), count)  # windows with SIDE / 2 bytes or more before the anchor
        for start, n, near in ((first, left, raw[max(at - 16, 0) : at]), (first + left, count - left, raw[at + GRAM : at + GRAM + 16])):
            if n:
                key = int.from_bytes(hashlib.blake2b(h.to_bytes(8, "little", signed=True) + bytes([start == first and n == left]) + near, digest_size=8).digest(), "little", signed=True)
                out.append((key, start, n, raw[start : start + n + LENGTH - 1]))
    return out


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` ordered by their first ``depth`` bytes at least, and their ranks, by Larsson-Sadakane refinement.

    The first order is that of 8-byte prefixes. Each round doubles the prefix: only suffixes whose group isn't single
    are sorted again, by group and the group of the suffix that far on.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    sa = np.argsort(key)
    ordered = key[sa]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    del key, ordered
    starts = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.repeat(starts, np.diff(np.append(starts, n)))
    h = 8
    while h < depth:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # places of groups with more than one suffix
        if not len(tied):
            break
        s = sa[tied]
        after = rank[np.minimum(s + h, n)] + 1
        order = np.argsort(rank[s] * (n + 1) + after)
        s, after = s[order], after[order]
        group = rank[s]
        sa[tied] = s
        split = np.concatenate(([True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])))
        new[tied] |= split
        heads = np.flatnonzero(split)
        rank[s] = np.repeat(tied[heads], np.diff(np.append(heads, len(s))))
        h *= 2
    return sa, rank[:n]


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int, stride: int = 8) -> np.ndarray:
    """Common prefix, up to ``most``, of each suffix in ``sa`` with the one before it.

    Kasai's bound: the prefix of a place is at least that of the place before it less one. Every ``stride``-th place
    is compared from the start, all at once; the places after each of them start from the bound.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate((text, np.arange(most + 16, dtype=np.int64).astype(np.uint8)))
    words = np.lib.stride_tricks.as_strided(padded[: n + most + 8].view(), (n + most + 1, 8), (1, 1))
    common = np.zeros(n, np.int64)
    for c in range(stride):
        at = np.arange(c, n, stride)
        at = at[before[at] >= 0]
        have = common[at - 1] - 1 if c else np.zeros(len(at), np.int64)
        have[(have < 0) | (have == most - 1)] = 0  # beyond its depth the array isn't sorted, and the bound doesn't hold
        live = np.flatnonzero(have < most)
        while len(live):
            x, y = at[live] + have[live], before[at[live]] + have[live]
            differ = words[x] != words[y]
            equal = np.where(differ.any(1), differ.argmax(1), 8)
            have[live] += equal
            live = live[(equal == 8) & (have[live] < most)]
        common[at] = np.minimum(have, np.minimum(most, n - np.maximum(at, before[at])))
    return common[sa]


def repeated_windows(groups: list[tuple[bytes, int]]) -> list[np.ndarray]:
    """For distinct (bytes, number of windows) of a shard: which windows also start elsewhere in it."""
    text = np.frombuffer(b"".join(g for g, _ in groups), np.uint8)
    sa, _ = suffix_array(text, LENGTH)
    common = common_prefixes(text, sa, LENGTH)
    sizes = np.array([len(g) for g, _ in groups], np.int64)
    counts = np.array([c for _, c in groups], np.int64)
    starts = np.cumsum(sizes) - sizes
    places = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    is_window = np.zeros(len(text), bool)
    is_window[places] = True
    kind = np.cumsum(common < LENGTH)  # suffixes that share LENGTH bytes have one number
    number = np.empty(len(text), np.int64)
    number[sa] = kind
    seen = np.bincount(kind[is_window[sa]], minlength=kind[-1] + 1)
    twice = seen[number[places]] > 1
    return np.split(twice, np.cumsum(counts)[:-1])


def _intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [(int(a), int(b) + LENGTH - 1) for a, b in zip(edges[::2], edges[1::2])]


def shard(rows):
    """Arrays (id, t, start, stop) of the bytes that repeat, from a shard's (key, n, bytes, places) rows, a group of places at a time.

    places are packed (id, t, first) of rows with these bytes under the key, 24 bytes each, and stay so.
    """
    members: dict[tuple[int, int, bytes], bytearray] = {}
    for key, n, raw, places in rows:
        members.setdefault((key, n, raw), bytearray()).extend(places)
    # bytes that are the only ones under their key need no array: they repeat if they have several members
    kinds = Counter(key for key, _, _ in members)
    groups = [g for g in members if kinds[g[0]] > 1]
    several = {g for g, places in members.items() if len(places) > PLACE_BYTES}

    def told(g, spans):
        at = np.frombuffer(members[g], np.int64).reshape(-1, 3)
        return [(at[:, 0], at[:, 1], at[:, 2] + a, at[:, 2] + b) for a, b in spans]

    for g in several:  # all of it, whatever else is there
        yield from told(g, [(0, g[1] + LENGTH - 1)])
    at = 0
    while at < len(groups):  # the keys of a shard, in runs of about SHARD bytes that don't split a key
        stop, size = at, 0
        while stop < len(groups) and (size < SHARD or groups[stop][0] == groups[stop - 1][0]):
            size += len(groups[stop][2])
            stop += 1
        for g, f in zip(groups[at:stop], repeated_windows([(g[2], g[1]) for g in groups[at:stop]])):
            if g not in several and f.any():
                yield from told(g, _intervals(f))
        at = stop


def merged(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Disjoint runs of the union of intervals: a run ends where as many intervals have stopped as started, found by binary search."""
    if not spans:
        return []
    starts, stops = np.sort([a for a, _ in spans]), np.sort([min(b, n) for _, b in spans])
    ends = np.unique(stops)
    ends = ends[np.searchsorted(starts, ends, "right") == np.searchsorted(stops, ends, "right")]
    begins = starts[np.concatenate(([0], np.searchsorted(starts, ends[:-1], "right")))]
    return list(zip(begins.tolist(), ends.tolist()))


def _batch(part: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*part)], names=["id", "t", "a", "b"])


def repeated_spans(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, t, spans) of the repeated bytes of documents without copies, and (id, t) of those with copies, for (id, t, text)."""
    row = ["id", "t"]
    scanned = cut(spark, scan(docs), "anchors")
    contents = scanned.groupBy("digest").agg(F.min(F.struct("id", "t")).alias("rep"), F.count("*").alias("copies"))
    # one row of each content has its anchors looked up
    copied = scanned.select(*row, "digest").join(contents.filter("copies > 1"), "digest").select(*row).distinct()
    single = contents.select("rep.*")
    flat = scanned.select(*row, F.xxhash64("digest").alias("d"), F.arrays_zip("h", "p").alias("z")).select(*row, "d", F.inline("z"))
    again = flat.groupBy("h").agg(F.min(F.xxhash64("d", "p")).alias("lo"), F.max(F.xxhash64("d", "p")).alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("h", (F.col("n") >= HOT).alias("hot"))
    # a table of its own: the join may then split an anchor that many documents share
    again = cut(spark, again, "again")
    picked = flat.select(*row, "h", "p").join(again, "h").groupBy(*row).agg(F.collect_set(F.struct("h", "p", "hot")).alias("picked"))
    picked = cut(spark, picked.join(single, row), "picked")

    def emit(batches):
        for b in batches:
            # equal bytes of a batch travel once, with all their places
            found: dict[tuple[int, int, bytes], bytearray] = {}
            for doc, tag, t, its in zip(*(b.column(c).to_pylist() for c in ("id", "t", "text", "picked"))):
                for key, first, n, raw in windows_of(t.encode("utf-8", "surrogatepass"), [(x["h"], x["p"], x["hot"]) for x in its]):
                    found.setdefault((key, n, raw), bytearray()).extend(struct.pack(PLACE, doc, tag, first))
            rows = [(*g, bytes(places)) for g, places in found.items()]
            for i in range(0, len(rows), 20_000):
                part = list(zip(*rows[i : i + 20_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["key", "n", "raw", "places"])

    def solve(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        part, size = [], 0
        for arrays in shard(rows):
            part.append(arrays)
            size += len(arrays[0])
            if size >= 100_000:
                yield _batch(part)
                part, size = [], 0
        if part:
            yield _batch(part)

    total = picked.agg(F.sum(F.size("picked"))).first()[0] or 0
    parts = max(1, -(-total * (LENGTH + SIDE // 2) // SHARD))
    rows = docs.join(picked, row).mapInArrow(emit, "key long, n int, raw binary, places binary")
    spans = rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(solve, "id long, t long, a long, b long")
    return spans.groupBy(*row).agg(F.collect_list(F.struct("a", "b")).alias("spans")), copied


def removal(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    # the sentinel stands for null ids: joins then need no null check, and both use one exchange of the texts
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_of().alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("t"), "text")
    spans, copied = repeated_spans(spark, rows)

    def finish(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, t, found, all_of_it in zip(*(b.column(c).to_pylist() for c in ("id", "text", "spans", "copied"))):
                raw = t.encode("utf-8", "surrogatepass")
                runs = [(0, len(raw))] if all_of_it and len(raw) >= LENGTH else merged([(x["a"], x["b"]) for x in found or ()], len(raw))
                digest, last = hashlib.sha256(), 0
                for a, z in runs:
                    digest.update(raw[last:a])
                    last = z
                digest.update(raw[last:])
                for column, v in zip(out, (None if doc == NO_ID else doc, len(raw), sum(z - a for a, z in runs), len(runs), digest.hexdigest())):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(),) * 4 + (pa.string(),))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = rows.join(spans, ["id", "t"], "left").join(copied.withColumn("copied", F.lit(True)), ["id", "t"], "left")
    return found.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
