"""The portable draw of :func:`scalar.portable_int` for blocks of pairs, where one expression a pair would take too long.

MD5 runs over whole arrays in Arrow batches: all pairs of a block go through its steps together, without any text for a pair.
"""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# workers get the functions of this module by value, so they need no path to the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pairs whose states are held at once: arrays that stay in a core's cache.
TILE = 1 << 15
#: Longest message of one MD5 block.
ONE_BLOCK = 55
_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_STEPS = [(i, (i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16), np.uint32(int(abs(math.sin(i + 1)) * 2**32)), _TURNS[i // 16][i % 4]) for i in range(61)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _mix(kind: int, b, c, d):
    return (d ^ (b & (c ^ d)), c ^ (d & (b ^ c)), b ^ c ^ d, c ^ (b | ~d))[kind]


def _mix_into(out: np.ndarray, kind: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> None:
    """:func:`_mix` without new arrays."""
    if kind == 0:
        np.bitwise_xor(c, d, out=out)
        out &= b
        out ^= d
    elif kind == 1:
        np.bitwise_xor(b, c, out=out)
        out &= d
        out ^= c
    elif kind == 2:
        np.bitwise_xor(b, c, out=out)
        out ^= d
    else:
        np.invert(d, out=out)
        out |= b
        out ^= c


def first_word(words: dict[int, np.ndarray], first: int, shape: tuple[int, int]) -> np.ndarray:
    """The first word (little end first) of the MD5 of ``shape`` messages of one block each.

    ``words`` are the message's words other than zero, of any shapes that broadcast to ``shape``; those before ``first`` are the same
    along a row. The word is final after 61 of the 64 steps.
    """
    a, b, c, d = (np.full((1, 1), x) for x in _START)
    spare = np.empty(shape, np.uint32)
    for i, (kind, at), k, turn in _STEPS:
        more = [words[at], k] if at in words else [k]
        if at in words and words[at].shape != shape:
            more = [words[at] + k]
        if i < first + 4:  # until each of the four has been through a word that differs within a row
            a = a + _mix(kind, b, c, d)
            for x in more:
                a = a + x
            a = ((a << np.uint32(turn)) | (a >> np.uint32(32 - turn))) + b
            if i >= first:
                a = np.array(np.broadcast_to(a, shape))
        else:
            _mix_into(spare, kind, b, c, d)
            a += spare
            for x in more:
                a += x
            np.left_shift(a, np.uint32(turn), out=spare)
            a >>= np.uint32(32 - turn)
            a |= spare
            a += b
        a, b, c, d = d, a, b, c
    b += _START[0]
    return b


def _bytes(texts: list[bytes], shift: int) -> np.ndarray:
    """Texts as rows of bytes from ``shift`` on, filled with zeros to whole words."""
    width = max(map(len, texts), default=0)
    rows = np.zeros((len(texts), -(-(shift + width + 1) // 4) * 4), np.uint8)
    if width:
        rows[:, shift : shift + width] = np.array(texts, f"S{width}").view(np.uint8).reshape(len(texts), width)
    return rows


def draws(heads: list[bytes], tails: list[bytes]) -> np.ndarray:
    """First 32 bits of the MD5 of each head with each tail (heads x tails), big end first, as :func:`scalar.portable_int` reads them."""
    out = np.empty((len(heads), len(tails)), np.uint32)
    sizes, lengths = np.array([*map(len, heads)]), np.array([*map(len, tails)])
    for size in np.unique(sizes):
        rows, fits = np.flatnonzero(sizes == size), np.flatnonzero(size + lengths <= ONE_BLOCK)
        some = [heads[i] for i in rows]
        for j in np.flatnonzero(size + lengths > ONE_BLOCK):
            out[rows, j] = [int(hashlib.md5(h + tails[j]).hexdigest()[:8], 16) for h in some]
        if not len(fits):
            continue
        first, shift = divmod(int(size), 4)
        head = _bytes(some, 0)[:, : (first + 1) * 4].copy().view("<u4")
        tail = _bytes([tails[j] for j in fits], shift)
        tail[np.arange(len(fits)), shift + lengths[fits]] = 0x80
        tail = np.ascontiguousarray(tail.view("<u4").T)
        words = {i: head[:, i : i + 1] for i in range(first)}
        words[first] = head[:, first:] | tail[0]
        words |= {first + i: tail[i : i + 1] for i in range(1, len(tail))}
        words[14] = ((size + lengths[fits]) * 8).astype(np.uint32)[None, :]
        found = first_word(words, first, (len(rows), len(fits))).byteswap()
        if len(rows) == len(heads) and len(fits) == len(tails):
            return found
        out[np.ix_(rows, fits)] = found
    return out


def _texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _number(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def least_draws(left: pa.StructArray, right: pa.StructArray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of left, row of right, draw) of each left row's ``n`` least draws, and of those equal to the last of them.

    ``left`` has (text, low, high), ``right`` (text, value); only values from low to high take part.
    """
    heads, tails = _texts(left.field("text")), _texts(right.field("text"))
    low, high, value = (_number(c)[:, None] for c in (left.field("low"), left.field("high"), right.field("value")))
    found = []
    for j in range(0, len(tails), TILE):
        v = value[j : j + TILE].T
        each = max(1, TILE // v.shape[1])
        for i in range(0, len(heads), each):
            lo, hi = low[i : i + each], high[i : i + each]
            inside = (v >= lo) & (v <= hi) | np.isnan(v) & np.isnan(lo)  # Spark has NaN equal to itself
            if not inside.any():
                continue
            h = draws(heads[i : i + each], tails[j : j + TILE])
            h[~inside] = 0xFFFFFFFF
            last = np.partition(h, n - 1, axis=1)[:, n - 1 : n] if n < h.shape[1] else np.uint32(0xFFFFFFFF)
            a, b = np.nonzero((h <= last) & inside)
            found.append((a + i, b + j, h[a, b].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def least_of_blocks(n: int):
    """For mapInArrow over (left, right, by), blocks of rows in each: (left's id, right's id, by, draw) of :func:`least_draws`."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = batch.column(0)[k].values, batch.column(1)[k].values
                a, b, h = least_draws(left, right, n)
                if len(h):
                    by = pa.array([batch.column(2)[k].as_py()], batch.column(2).type).take(pa.array(np.zeros(len(h), np.int64)))
                    yield pa.RecordBatch.from_arrays([left.field("id").take(pa.array(a)), right.field("id").take(pa.array(b)), by, pa.array(h)], names=["a", "b", "by", "h"])

    return run
