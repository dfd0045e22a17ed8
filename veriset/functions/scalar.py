"""Scalar expressions: text, decisions, effect sizes and a portable generator.

All are built-in expressions but two Pandas functions for rare texts: compatibility forms, and texts with several pairs of braces.
"""

from __future__ import annotations

import json
import math
import re
import sys
import unicodedata
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import vocabulary as V

# workers get the functions of this module by value, so they need no path to the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def portable_int(*parts) -> Column:
    """First 8 hexadecimal digits of the MD5 of the parts joined by a bar: the same integer in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.lit(p) if not isinstance(p, Column) else p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode's compatibility form. Texts of ASCII and Cyrillic letters, which are in it already, don't go to Python."""
    other = text.rlike(r"[^\x00-\x7F\u0400-\u04FF]")
    return F.when(other, _nfkc(F.when(other, text))).otherwise(text)


def normalise(text: Column) -> Column:
    """Compatibility form in lower case, without outer white space and marks, inner white space single."""
    bare = F.regexp_replace(F.regexp_replace(nfkc(text), r"(?U)^\s+|\s+$", ""), V.OUTER_MARKS, "")
    return F.lower(F.regexp_replace(bare, r"(?U)\s+", " "))


def decision_of(value: Column) -> Column:
    """A written decision as one of the four canonical ones: exact entry, then words with negation, then abstention."""
    t = normalise(F.coalesce(value, F.lit("")))
    words = F.regexp_extract_all(t, F.lit(r"(?U)([^\W\d_]+)"), 1)
    has = lambda listing: F.arrays_overlap(words, F.array(*map(F.lit, listing)))
    hire, reject = has(V.HIRE_TOKENS), has(V.REJECT_TOKENS)
    abstains = reduce(lambda a, b: a | b, [t.contains(p) for p in V.ABSTAIN_PARTS])
    out = F.when(t == "", V.INVALID).when(t.isin(V.HIRE_WORDS), V.HIRE).when(t.isin(V.REJECT_WORDS), V.REJECT).when(t.isin(V.REFUSED_WORDS), V.REFUSED)
    out = out.when(reject & ~hire, V.REJECT).when(hire & ~reject, F.when(t.rlike("(?U)" + V.NEGATION), V.REJECT).otherwise(V.HIRE))
    return out.when(abstains, V.REFUSED).otherwise(V.INVALID)


def outcome_of(decision: Column) -> Column:
    return F.when(decision.isin(V.HIRE, V.REJECT), "decided").when(decision == V.REFUSED, "refused").otherwise("invalid")


_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|[{}"]', re.S)


def _balanced(text: str, start: int) -> str | None:
    """The text from the brace at ``start`` to the one that closes it; braces in double quotes don't count."""
    depth = 0
    for m in _TOKEN.finditer(text, start):
        if m[0] == '"':  # a quote without an end
            return None
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            return text[start : m.end()]
    return None


def _mended(blob: str) -> str:
    """Without trailing commas; single quotes become double where no double ones are."""
    blob = re.sub(r",\s*([}\]])", r"\1", blob)
    return blob if '"' in blob else blob.replace("'", '"')


def _object(text: str | None) -> str | None:
    at = -1 if text is None else text.find("{")
    while at >= 0:
        blob = _balanced(text, at)
        for attempt in () if blob is None else (blob, _mended(blob)):
            try:
                if isinstance(json.loads(attempt), dict):
                    return attempt
            except ValueError:
                pass
        at = text.find("{", at + 1)
    return None


@F.pandas_udf(StringType())
def _objects(text: pd.Series) -> pd.Series:
    return text.map(_object)


def first_object(text: Column) -> Column:
    """The first balanced JSON object of a text, mended if need be; null without one.

    A text with one pair of braces has it between them. Only texts with more are scanned in Python, in Arrow batches.
    """
    one = F.regexp_extract(text, r"(?s)^[^{}]*(\{[^{}]*\})[^{}]*$", 1)
    blob = F.regexp_replace(one, r",\s*([}\]])", "$1")
    many = (one == "") & text.contains("{")
    return F.when(many, _objects(F.when(many, text))).when(one != "", F.when(blob.contains('"'), blob).otherwise(F.translate(blob, "'", '"')))


def parsed(raw: Column) -> Column:
    """Struct (decision, feedback, outcome, raw_decision) of a model's answer; null is an empty answer.

    An object decides by its own decision, even where that is none. Only without an object do phrases of refusal count,
    and the first 200 characters stand for the raw decision.
    """
    text = F.coalesce(raw, F.lit(""))
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    o = F.from_json(first_object(text), "decision string, feedback string, __bad string", {"columnNameOfCorruptRecord": "__bad", "allowSingleQuotes": "false"})
    found = o.isNotNull() & o["__bad"].isNull()
    refuses = reduce(lambda a, b: a | b, [F.lower(text).contains(p) for p in V.REFUSAL_PHRASES])
    decision = F.when(found, decision_of(o["decision"])).when(refuses, V.REFUSED).otherwise(V.INVALID)
    feedback, word = F.when(found, strip(o["feedback"])).otherwise(""), F.when(found, strip(o["decision"])).otherwise(F.substring(strip(text), 1, 200))
    return F.struct(decision.alias("decision"), feedback.alias("feedback"), outcome_of(decision).alias("outcome"), word.alias("raw_decision"))


def stems(attribute: Column) -> Column:
    """The first letters of an attribute's words; none of the pseudo-attribute of rows without one."""
    words = F.when(attribute == "__attr_free__", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(F.lower(attribute), F.lit(r"(?U)([^\W\d_]+)"), 1))
    kept = F.filter(words, lambda w: ~w.isin(V.STOPWORDS) & (F.length(w) >= V.LEAST_WORD))
    return F.array_distinct(F.transform(kept, lambda w: F.substring(w, 1, V.STEM)))


def mentions(text: Column, attribute_stems: Column) -> Column:
    low = F.lower(text)
    return F.exists(attribute_stems, lambda s: F.contains(low, s))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def cyrillic(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^Ѐ-ӿ]", ""))


def latin(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]", ""))


def language_ok(text: Column, lang: str) -> Column:
    """Whether letters are those of the language; texts with under 12 letters pass."""
    c, n = cyrillic(text), cyrillic(text) + latin(text)
    share = c / F.when(n > 0, n)
    return F.when(n < 12, True).otherwise(share >= 0.4 if lang == "uk" else share <= 0.2)


def drifted(text: Column, lang: Column) -> Column:
    """Whether a rationale of some length is in the other script: 20 characters and 15 letters at least."""
    t = nfkc(F.coalesce(text, F.lit("")))
    c, n = cyrillic(t), cyrillic(t) + latin(t)
    share = c / F.when(n > 0, n)
    wrong = F.when(lang == "uk", share < 0.4).when(lang == "en", share > 0.2)
    return F.coalesce((F.length(t) >= 20) & (n >= 15) & wrong, F.lit(False))


def mapped_loosely(raw_decision: Column, outcome: Column) -> Column:
    """Decided rows whose written decision, without marks around it, is none of the words that were asked for."""
    word = F.lower(F.trim(F.regexp_replace(F.coalesce(raw_decision, F.lit("")), r"(?U)^\s+|\s+$", ""), F.lit("`*_ .:;\"'")))
    return (outcome == "decided") & ~word.isin([w for words in V.DECISION_WORDS.values() for w in words])


def has_meta(text: Column, lang: str) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(p) for p in V.META_PHRASES[lang]])


def has_marker(text: Column, lang: str) -> Column:
    """One alternation of the language's patterns."""
    return text.rlike("(?iU)" + "|".join(V.MARKERS[lang]))


def cohens_h(p: Column, q: Column) -> Column:
    inside = p.between(0, 1) & q.between(0, 1)
    return F.when(inside, 2 * F.asin(F.sqrt(p)) - 2 * F.asin(F.sqrt(q)))


def completion(decision: Column, feedback: Column) -> Column:
    """The answer object with the spacing of Python's json module."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    return F.concat(F.lit('{"decision": '), quote(decision), F.lit(', "feedback": '), quote(feedback), F.lit("}"))


def first_number(label: Column) -> Column:
    """The first number of a label, decimals included; 0 without one."""
    return F.coalesce(F.regexp_extract(label, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))


def safe_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-"), F.lit("-"))


def log_factorial(n: Column) -> Column:
    """Logarithm of n!: exact to 20, by Stirling's series beyond (error under 1e-12)."""
    x = n.cast("double")
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20))).cast("double"))).otherwise(series)


def sign_test(a: Column, b: Column) -> Column:
    """Exact two-sided binomial test of a against b at one half; null without trials.

    The tail is summed from its largest term down, each from the one before it. Ten standard deviations
    further down nothing is left that a double could hold, so the steps grow with the root of the trials.
    """
    n, k = (a + b).cast("long"), F.least(a, b).cast("long")
    largest = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * math.log(2.0))
    steps = F.least(k, (5 * F.sqrt(n) + 20).cast("long"))
    down = F.when(steps > 0, F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    first = F.struct(largest.alias("term"), largest.alias("total"))
    ratio = lambda i: (k - i + 1).cast("double") / (n - k + i)
    tail = F.aggregate(down, first, lambda s, i: F.struct((s["term"] * ratio(i)).alias("term"), (s["total"] + s["term"] * ratio(i)).alias("total")), lambda s: s["total"])
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail))
