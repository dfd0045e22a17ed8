"""SimHash near-duplicate detection with pigeonhole blocks.

A fingerprint takes, for each bit, the majority over the hashes of a text's word shingles
(repeats included). Fingerprints are cut into blocks so that close pairs agree on whole blocks;
pairs that share a block key are verified by Hamming distance and joined into components.

Documents with equal fingerprints are merged before any pair is made. A block key with more than
``HOT`` (``CROWD``) distinct fingerprints never emits its pairs, so candidates grow with the members:

* for a small radius (``link_exact``) the members of hot keys are linked over midpoints instead: two
  fingerprints differ in at most 2 bits exactly when some value lies within 1 bit of both, so each
  member is sent to the 65 values within 1 bit and every value links its members to the least one;
* for wide fingerprints (``link_wide``) the members of such a key are compared with its least one; parts of the key that are
  still apart are then compared by one member each, until no more are linked. Of the parts that stay apart even so, all members outside
  the key's largest part are compared with all members of the others, in blocks, so that no link of the key is lost.

Rows without a doc_id take part by their fingerprints only: they are in the component of those with an equal one, if any, else
in none (null). Null texts and texts without words get fingerprint zero and link like any other. Ties (exactly half of
the hashes) give a 0 bit. Repeated rows are kept, each with its own result. Extra columns of the
input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, cut, release, text_of
from .graph import connected_components

by_value(__name__)

#: Distinct fingerprints under one block key up to which its pairs are enumerated, for 64 bits and for wide fingerprints.
HOT, CROWD = 64, 4
#: Members of a block that are compared with those of another at once.
BLOCK = 512
#: Odd multipliers that derive further 64-bit hashes of a shingle from its first one.
MIX = 0x9E3779B97F4A7C15


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined k-word shingles, lower-cased in A-Z, repeats included."""
    words = text.encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if n <= k:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64, n - k + 1)


def _bit_counts(words: np.ndarray) -> np.ndarray:
    """How often each bit is set in the rows of ``words`` (n x lanes): full adders on whole words first, so that few rows are unpacked."""
    total, weight = np.zeros(words.shape[1] * 64, np.int64), 1
    while len(words):
        carries = []
        while len(words) >= 3:
            m = len(words) // 3
            a, b, c, rest = words[:m], words[m : 2 * m], words[2 * m : 3 * m], words[3 * m :]
            either = a ^ b
            carries.append((a & b) | (either & c))
            words = np.concatenate([either ^ c, rest])
        total += weight * np.unpackbits(words.astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
        words, weight = np.concatenate(carries) if carries else words[:0], weight * 2
    return total


def fingerprint(text: str, k: int = 3, lanes: int = 1) -> np.ndarray:
    """``lanes`` 64-bit words, a bit set if it is in over half of the hashes; the first word uses the XXH64 hashes as they are."""
    hashes = shingle_hashes(text, k)
    counts = np.zeros(lanes * 64, np.int64)
    seeds = np.arange(lanes, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for i in range(0, len(hashes), 4096):
        first = hashes[i : i + 4096, None]
        h = first ^ seeds
        if lanes > 1:
            h *= np.uint64(MIX)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            h[:, :1] = first
        counts += _bit_counts(h)
    return np.packbits(counts * 2 > len(hashes)).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = 3, lanes: int = 1) -> DataFrame:
    """(doc_id, fp array<bigint>) for every row."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            fps = [fingerprint(t.as_py(), k, lanes).view(np.int64).tolist() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, fp array<bigint>")


def _masks(bits: int, blocks: int, keep: int) -> list[int]:
    """Masks of the unions of ``keep`` of ``blocks`` even blocks, as signed longs."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    full = [reduce(lambda x, y: x | y, c) for c in combinations(parts, keep)]
    return [m - (1 << 64) if m >> 63 else m for m in full]


def link_exact(spark: SparkSession, fps: DataFrame, blocks: int = 5, radius: int = 2) -> DataFrame:
    """Edges (a, b) that connect all ``fps`` (rep, fp long; distinct fp) within ``radius`` bits.

    Any ``radius`` differing bits leave ``blocks - radius`` blocks untouched, so a pair shares one of the
    keys made of that many blocks. Hot keys go over midpoints, which needs a radius of 2.
    """
    if radius != 2:
        raise ValueError("midpoints link fingerprints within 2 bits")
    keys = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(_masks(64, blocks, blocks - radius))])
    rows = fps.select("rep", "fp", F.explode(keys).alias("key")).select("rep", "fp", "key.c", "key.k")
    many = rows.groupBy("c", "k").agg(F.count("*").alias("n")).filter("n > 1")
    rows = cut(spark, rows.join(many, ["c", "k"]), "blocks")
    cold = rows.filter(F.col("n") <= HOT)
    other = cold.select("c", "k", F.col("rep").alias("b"), F.col("fp").alias("fp2"))
    pairs = cold.select("c", "k", F.col("rep").alias("a"), "fp").join(other, ["c", "k"]).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius)).select("a", "b")
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])
    ball = rows.filter(F.col("n") > HOT).select("rep", "fp").distinct().select("rep", F.explode(near).alias("mid"))
    least = ball.groupBy("mid").agg(F.min("rep").alias("a"), F.count("*").alias("n")).filter("n > 1").select("mid", "a")
    return pairs.unionByName(ball.join(least, "mid").filter("rep <> a").select("a", F.col("rep").alias("b"))).distinct()


def block_plan(n: int, bits: int, share: float, miss: float = 0.08) -> tuple[int, int]:
    """Width and number of block keys for ``n`` fingerprints of ``bits`` bits.

    The width grows with the logarithm of ``n``, so that unrelated fingerprints seldom meet under a key: one row in 16 at most. The
    number of keys grows with the width, so that of pairs that differ in the given ``share`` of their bits at most ``miss`` meet under none.
    """
    width = max(16, n.bit_length() + 4)
    return width, min(max(1, math.ceil(math.log(miss) / math.log1p(-((1 - share) ** width)))), 1 << 20)


def block_keys(fps: np.ndarray, width: int, keys: int) -> np.ndarray:
    """Keys of the rows of ``fps`` (n x lanes): blocks of ``width`` bits, each under its number; further sets of blocks cut the bits in another order."""
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8), axis=1)
    each = bits.shape[1] // width
    weights = 2.0 ** np.arange(width)
    out = []
    for i in range(-(-keys // each)):
        order = np.random.default_rng(i).permutation(bits.shape[1]) if i else np.arange(bits.shape[1])
        m = min(each, keys - i * each)
        blocks = bits[:, order[: m * width]].reshape(-1, width).astype(np.float64)
        out.append((blocks @ weights).astype(np.int64).reshape(-1, m) | (np.arange(m) + i * each) << width)
    return np.concatenate(out, axis=1)


def _keyed(fps: DataFrame, width: int, keys: int) -> DataFrame:
    """(key, rep) of all block keys of (rep, fp array)."""

    def run(batches):
        for b in (b for b in batches if b.num_rows):
            values = b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            reps, values = b.column(0).to_numpy(zero_copy_only=False), values.reshape(b.num_rows, -1)
            for i in range(0, len(reps), 1000):
                some = block_keys(values[i : i + 1000], width, keys)
                yield pa.RecordBatch.from_arrays([pa.array(some.ravel()), pa.array(np.repeat(reps[i : i + 1000], keys))], names=["key", "rep"])

    return fps.filter("rep is not null").select("rep", "fp").mapInArrow(run, "key long, rep long")


def _far(lanes: int, x: str, y: str) -> Column:
    """Differing bits of two wide fingerprints."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(lanes)])


def _distances(fps: DataFrame, pairs: DataFrame, lanes: int) -> DataFrame:
    """``pairs`` (a, b, more) with the differing bits of a and b as d."""
    left, right = (fps.select(F.col("rep").alias(x), F.col("fp").alias(f"fp_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").withColumn("d", _far(lanes, "fp_a", "fp_b")).drop("fp_a", "fp_b")


def _within(spark: SparkSession, fps: DataFrame, pairs: DataFrame, lanes: int, radius: int) -> DataFrame:
    """Those of distinct ``pairs`` (a, b) that differ in ``radius`` bits at most.

    One word of both is compared first: of ``radius`` bits spread over all words, more than ``most`` seldom (one pair in 10,000)
    fall on it, and of unrelated pairs most do. So few pairs meet their whole fingerprints.
    """
    share = radius / (64 * lanes)
    most = min(64, round(64 * share + 3.9 * math.sqrt(64 * share * (1 - share))))
    if lanes > 2:
        left, right = (fps.select(F.col("rep").alias(x), F.col("fp")[lanes - 1].alias(f"word_{x}")) for x in "ab")
        pairs = pairs.join(left, "a").join(right, "b").filter(F.bit_count(F.col("word_a").bitwiseXOR(F.col("word_b"))) <= most).select("a", "b")
        pairs = cut(spark, pairs, "pairs")
    found = cut(spark, _distances(fps, pairs, lanes).filter(F.col("d") <= radius).select("a", "b"), "links")
    if lanes > 2:
        release(spark, pairs)
    return found


def _ordered(one: str, other: str) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _merged(spark: SparkSession, part: DataFrame, more: DataFrame) -> DataFrame:
    """``part`` (node, component) after further edges ``more`` (a, b)."""
    of = lambda x: part.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    upper = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    upper = connected_components(spark, upper).select(F.col("node").alias("component"), F.col("component").alias("higher"))
    new = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(part, "node", "left_anti").select("node", F.col("node").alias("component"))
    return cut(spark, part.unionByName(new).join(upper, "component", "left").select("node", F.coalesce("higher", "component").alias("component")), "parts")


def _close(x: np.ndarray, y: np.ndarray, part_x: np.ndarray, part_y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` and ``y`` (n x lanes) of different parts that differ in ``radius`` bits at most, one pair for each two parts."""
    half = x.shape[1] // 2
    d = np.zeros((len(x), len(y)), np.uint16)
    for lane in range(half):
        d += np.bitwise_count(x[:, lane, None] ^ y[None, :, lane])
    i, j = np.nonzero((d <= radius) & (part_x[:, None] != part_y))  # beyond the radius in half of the bits is beyond it in all
    near = [np.bitwise_count(x[i[k : k + 8192], half:] ^ y[j[k : k + 8192], half:]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), 8192)]
    fits = d[i, j] + np.concatenate(near) <= radius if near else np.zeros(0, bool)
    i, j = i[fits], j[fits]
    one = np.unique(np.stack([part_x[i], part_y[j]], axis=1), axis=0, return_index=True)[1]
    return i[one], j[one]


def _open(fps: DataFrame, rows: DataFrame) -> DataFrame:
    """Of (key, rep, part) those of keys with several parts, with fp, the key's largest part ``top``, its members ``n`` and the ``rest`` outside ``top``."""
    sizes = rows.groupBy("key", "part").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "part")).alias("top"), F.count("*").alias("parts"))
    sizes = sizes.filter("parts > 1").select("key", "n", F.col("top.part").alias("top"), F.expr("n - top.m").alias("rest"))
    return rows.join(sizes, "key").join(fps.select("rep", "fp"), "rep")


def _parts_apart(spark: SparkSession, rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between the parts of each key of ``rows`` (:func:`_open`): every pair of members of different parts is compared.

    One of the two is outside the key's largest part, so the pairs grow with the members where one part has nearly all of them.
    Members go in blocks, and each two blocks of a key are a row of their own, so a key's pairs are spread over tasks.
    """

    def blocks(some: DataFrame, size: str, name: str) -> DataFrame:
        deal = F.pmod(F.xxhash64("rep"), F.ceil(F.col(size) / BLOCK)).alias(name)
        return some.groupBy("key", deal).agg(F.collect_list(F.struct("rep", "part", "fp")).alias(f"of_{name}"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = batch.column(0)[k].values, batch.column(1)[k].values
                (rep_x, part_x, fp_x), (rep_y, part_y, fp_y) = ((*(c.field(f).to_numpy(zero_copy_only=False) for f in ("rep", "part")), c.field("fp").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(c), -1)) for c in (x, y))
                i, j = _close(fp_x, fp_y, part_x, part_y, radius)
                yield pa.RecordBatch.from_arrays([pa.array(rep_x[i]), pa.array(rep_y[j])], names=["a", "b"])

    left, right = blocks(rows.filter("part <> top"), "rest", "i"), blocks(rows, "n", "j")
    counts = rows.select("key", F.ceil(F.col("rest") / BLOCK).alias("i"), F.ceil(F.col("n") / BLOCK).alias("j")).distinct()
    pairs = counts.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("i") - 1)).alias("i"), "j").select("key", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("j") - 1)).alias("j"))
    return cut(spark, pairs.join(left, ["key", "i"]).join(right, ["key", "j"]).select("of_i", "of_j").mapInArrow(run, "a long, b long").distinct(), "links")


def link_wide(spark: SparkSession, fps: DataFrame, lanes: int, radius: int, width: int, keys: int) -> DataFrame:
    """(node, component) of (rep, fp array) that links connect: wide fingerprints that share a block and differ in ``radius`` bits at most.

    With fewer differing bits than blocks of one set the pigeonhole finds every pair; beyond that a pair is found with a
    probability that falls with the share of differing bits (:func:`block_plan`; the README has the recall). Members of a crowded
    key are compared with its least one. Then the parts of the key that stay apart are compared with its first part, each by
    one of its members, which hashing picks anew for each key, until a round links nothing more. At last all members of the
    parts that are still apart are compared (:func:`_parts_apart`).
    """
    rows = _keyed(fps, width, keys)
    many = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("lo")).filter("n > 1")
    rows = cut(spark, rows.join(many, "key"), "blocks")
    cold, hot = rows.filter(F.col("n") <= CROWD), rows.filter(F.col("n") > CROWD)
    pairs = cold.select("key", F.col("rep").alias("a")).join(cold.select("key", F.col("rep").alias("b")), "key").filter("a < b").select("a", "b")
    pairs = pairs.unionByName(hot.filter("lo < rep").select(F.col("lo").alias("a"), F.col("rep").alias("b"))).distinct()
    part = connected_components(spark, _within(spark, fps, pairs, lanes, radius))
    members = rows
    while True:
        last = members
        some = last.filter(F.col("n") > CROWD).select("key", "rep", "n")
        members = cut(spark, some.join(part, some.rep == part.node, "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("part")), "members")
        release(spark, last)
        of = cut(spark, members.groupBy("key", "part").agg(F.min_by("rep", F.xxhash64("rep", "key")).alias("rep")), "open")
        first = of.groupBy("key").agg(F.min_by("rep", "part").alias("lo"), F.count("*").alias("n")).filter("n > 1").select("key", "lo")
        more = of.join(first, "key").filter("rep <> lo").select(*_ordered("rep", "lo")).distinct()
        more = _within(spark, fps, more, lanes, radius)
        release(spark, of)
        if more.isEmpty():
            break
        part = _merged(spark, part, more)
    apart = cut(spark, _open(fps, members.select("key", "rep", "part")), "apart")
    release(spark, members)
    more = _parts_apart(spark, apart, radius)
    release(spark, apart)
    return part if more.isEmpty() else _merged(spark, part, more)


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 3, lanes: int = 1, radius: int = 2, blocks: int = 5, share: float = 0.0) -> DataFrame:
    """(doc_id, fp array, component_id): component_id is the least doc_id reachable over links, itself included.

    With one lane every pair within ``radius`` bits is linked. With more, ``share`` is the share of differing bits up to which
    :func:`block_plan` promises its recall.
    """
    all_fps = cut(spark, fingerprints(docs, k, lanes), "fps")
    reps = cut(spark, all_fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    if lanes == 1:
        parts = connected_components(spark, link_exact(spark, reps.select("rep", F.col("fp")[0].alias("fp")), blocks, radius))
    else:
        parts = link_wide(spark, reps, lanes, radius, *block_plan(reps.count(), 64 * lanes, share))
    classes = reps.join(parts, reps.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return all_fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def differing(similarity: float) -> float:
    """Share of bits in which fingerprints of two shingle sets of that (Jaccard) similarity and equal size differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def deduplicate(spark: SparkSession, docs: DataFrame, k: int = 5, lanes: int = 32, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the least doc_id.

    Five-word shingles and 2048 bits: at a similarity of 0.8, 310 bits differ, with a spread of 16. Two spreads more are
    allowed, so that few pairs at the limit are missed; in turn a part of the pairs between 0.75 and 0.8 are linked.
    Rows that repeat a doc_id are one document: they stay or go together. Rows without a doc_id stay.
    """
    share, bits = differing(similarity), 64 * lanes
    radius = round(bits * share + 2 * math.sqrt(bits * share * (1 - share)))
    found = near_duplicates(spark, docs.filter("doc_id is not null"), k, lanes, radius, share=share)
    drop = cut(spark, found.filter("doc_id <> component_id").select("doc_id").distinct(), "drop")
    release(spark)
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)
