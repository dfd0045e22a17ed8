"""Fast exact counts and ids of the tokenizers library, over a bounded memory of words.

Both vocabularies split a text into pieces before merging, and no piece crosses certain places: a single
space between two other characters that aren't white space. The library itself encodes each distinct part
between such places once; sums or joins of the parts are what it gives for the whole text. Texts in
which a space meets other white space are encoded whole where the vocabulary keeps white space.
"""

from __future__ import annotations

import hashlib
import os
import re

from .common import by_value, worker_cache

by_value(__name__)

#: Distinct words a worker remembers, with their ids and with their counts; beyond it the memory starts anew. About 200 bytes each.
REMEMBER, REMEMBER_COUNTS = 1_500_000, 500_000
_ODD = re.compile(r" \s|\s ")
_ASCII_WS = re.compile(r"[\x20\x09-\x0D]+")
_END = ".,!?;:"
#: Words of Latin letters only: one piece for either vocabulary, which the library's merging model takes without the steps around it.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ſ]+").fullmatch


def _as_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next free one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_SYMBOLS = _as_symbols()


def _symbols(text: str) -> str:
    return text.encode().decode("latin-1").translate(_SYMBOLS)


def version(path: str) -> str:
    """Digest of a tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def tokenizer(path: str):
    """The library's tokenizer, loaded once a worker; without truncation, padding or threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    cache = worker_cache("tokenizers")
    if path not in cache:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        cache[path] = t
    return cache[path]


def _core(word: str) -> str:
    """The word without the marks at its end, if a letter stands before them; letters and marks are never merged.

    A letter whose lower case ends in a combining mark (İ) is left with them: that mark merges with others.
    """
    core = word.rstrip(_END)
    return core if core and core[-1] < "ɐ" and core[-1].isalpha() and len(core[-1].lower()) == 1 else word


def _memory(name: str, most: int) -> dict:
    """A worker's memory of encoded words, begun anew when it is full."""
    cache = worker_cache(name)
    if len(cache) > most:
        cache.clear()
    return cache


def _learn(cache: dict, words: set, encode) -> None:
    """Encode the words that aren't remembered, parts before wholes."""
    new = [w for w in words if w not in cache]
    parts: dict = {}
    for w in new:
        core = _core(w)
        if core != w:
            parts.setdefault(core, None)
            parts.setdefault(("", w[len(core) :]), None)
        else:
            parts.setdefault(w, None)
    todo = [p for p in parts if p not in cache]
    cache.update(zip(todo, encode(todo)))
    for w in new:
        if w not in cache:
            core = _core(w)
            cache[w] = cache[core] + cache["", w[len(core) :]]


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text by a byte-level vocabulary that keeps white space; no special tokens are added."""
    t = tokenizer(path)

    pieces = t.model.tokenize

    def encode(parts):
        out = {p: len(pieces("Ġ" + _symbols(p))) for p in parts if isinstance(p, str) and _LETTERS(p)}
        rest = [p for p in parts if p not in out]
        found = t.encode_batch_fast([p[1] if isinstance(p, tuple) else " " + p for p in rest], add_special_tokens=False)
        out.update(zip(rest, map(len, found)))
        return [out[p] for p in parts]

    cache = _memory("counts:" + path, REMEMBER_COUNTS)
    out = []
    for text in texts:
        if not text:
            out.append(0)
        elif _ODD.search(text):
            out.append(len(t.encode(text, add_special_tokens=False)))
        else:
            words = text.split(" ")
            first = words.pop(0)
            try:
                n = sum(map(cache.__getitem__, words))
            except KeyError:
                _learn(cache, set(words), encode)
                n = sum(map(cache.__getitem__, words))
            if first:
                if ("", first) not in cache:
                    cache.update(zip([("", first)], encode([("", first)])))
                n += cache["", first]
            out.append(n)
    return out


def token_ids(texts: list[str], path: str) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text by a vocabulary that drops white space; no special tokens are added."""
    t = tokenizer(path)

    pieces = t.model.tokenize

    def written(ids):
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def encode(parts):
        low = {p: p.lower() for p in parts if isinstance(p, str) and _LETTERS(p)}
        known = {w: cache.get(w) for w in low.values()}
        for w, v in known.items():
            if v is None:
                known[w] = written(x.id for x in pieces(_symbols(w)))
        out = {p: known[w] for p, w in low.items()}
        rest = [p for p in parts if p not in out]
        found = t.encode_batch_fast([p[1] if isinstance(p, tuple) else p for p in rest], add_special_tokens=False)
        out.update(zip(rest, (written(e.ids) for e in found)))
        return [out[p] for p in parts]

    cache = _memory("ids:" + path, REMEMBER)
    out = []
    for text in texts:
        words = _ASCII_WS.split(text)
        if words and not words[0]:
            words = words[1:]
        if words and not words[-1]:
            words.pop()
        try:
            ids = b"".join(map(cache.__getitem__, words))
        except KeyError:
            _learn(cache, set(words), encode)
            ids = b"".join(map(cache.__getitem__, words))
        out.append(ids)
    return out
