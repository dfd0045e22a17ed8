"""Quality rules by distribution divergence, with DataFrame functions only.

Base rules (too few words, too many repeated words) come first. The verdict then compares two histograms
of a document with those of its language by Jensen-Shannon distance: character classes, and common words
(one bin for each word of a fixed list and one for all others). The references are the pooled histograms of
all documents of the language that pass the base rules. Documents below a minimum length, where histograms
say little, are judged by the base rules alone.

Null text is the empty text. A null or unlisted language is judged by character classes against the pool of
all such documents. Rows that repeat a doc_id are judged one by one. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, cut, text_of

# Common words of each listed language.
COMMON_WORDS = {
    "de": ["auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "er", "es", "im", "in", "ist", "mit", "nicht", "sich", "sie", "und", "von", "zu"],
    "en": ["a", "and", "are", "as", "at", "be", "by", "for", "from", "he", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"],
    "es": ["a", "al", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "no", "por", "que", "se", "su", "un", "una", "y"],
    "fr": ["a", "au", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "ne", "par", "pas", "pour", "que", "qui", "un", "une"],
}
#: Character classes besides white space, symbols and all else: patterns of what is not counted.
CLASSES = [r"[^\p{Lu}]+", r"[^\p{Ll}]+", r"[^0-9]+", r"[^.,;:!?'\"()\-]+"]
SYMBOLS = r"[^#*$%&|<>]+"

MIN_WORDS = 50
#: Histograms are compared from so many characters or words on.
MIN_CHARS, MIN_HIST_WORDS = 200, 50
#: Largest Jensen-Shannon distances (square root of the divergence in bits, 0 to 1) that are kept.
MAX_CHAR_JS, MAX_WORD_JS = 0.25, 0.31


def _repeated(n: Column, windows: Column, ordered: Column) -> Column:
    """Words of ``n``-long texts in 3-word windows that occur twice or more."""
    same = lambda x, j: F.coalesce(F.get(ordered, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, j + 1)["h"] == x["h"], F.lit(False))
    places = F.transform(F.filter(ordered, same), lambda x: x["i"])
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))


def features(docs: DataFrame) -> DataFrame:
    """One row for each document with the base counts and its two histograms (arrays of counts)."""
    text, lang = F.col("text"), F.col("lang")
    listed = F.coalesce(F.col("lang").isin(*COMMON_WORDS), F.lit(False))
    has_lang = "lang" in docs.columns
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), (F.col("lang").cast("string") if has_lang else F.lit(None).cast("string")).alias("lang"))
    d = d.select("doc_id", "text", F.when(listed, lang).otherwise(F.lit("und")).alias("lang"))
    d = d.select("*", F.filter(F.split(text, WS), lambda w: w != "").alias("words"))
    d = d.select("*", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"))
    words = F.col("words")
    at = F.sequence(F.lit(0), F.greatest(F.col("n_words").cast("int") - 3, F.lit(0)))
    d = d.withColumn("windows", F.when(F.col("n_words") >= 3, F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("again", F.size(F.array_distinct("windows")) < F.size("windows"))
    d = d.withColumn("ordered", F.when(F.col("again"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("lines", lines)
    lists = F.array().cast("array<string>")
    for name, listing in COMMON_WORDS.items():
        lists = F.when(lang == name, F.array(*[F.lit(w) for w in listing])).otherwise(lists)
    d = d.withColumn("listing", lists)
    listing = F.col("listing")
    d = d.withColumn("hits", F.filter(words, lambda w: F.array_contains(listing, w)))
    counted = [F.length(F.regexp_replace(text, p, "")).cast("long") for p in CLASSES]
    d = d.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", F.length(text).cast("long").alias("n_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("again"), _repeated(F.col("n_words"), F.col("windows"), F.col("ordered"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.array(*counted).alias("counted"),
        F.transform("listing", lambda c: (F.size("hits") - F.size(F.array_remove(F.col("hits"), c))).cast("long")).alias("listed"),
        F.size("hits").cast("long").alias("n_hits"),
    )
    space = F.col("n_chars") - F.col("word_chars")
    rest = F.greatest(F.col("n_chars") - space - F.col("n_symbols") - F.aggregate("counted", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", failed.alias("base_failed"), F.concat("counted", F.array(space, F.col("n_symbols"), rest)).alias("chars"), F.concat("listed", F.array(F.col("n_words") - F.col("n_hits"))).alias("common"))


def references(found: DataFrame) -> DataFrame:
    """(lang, ref_chars, ref_common): pooled histograms of the documents that pass the base rules; a row a listed language and one for the others."""
    ok = found.filter(~F.col("base_failed"))
    n_chars, n_common = len(CLASSES) + 3, max(map(len, COMMON_WORDS.values())) + 1
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(n_chars)] + [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(n_common)]
    g = ok.groupBy("lang").agg(*sums)
    known = lambda cols: F.filter(F.array(*cols), lambda x: x.isNotNull())
    return g.select("lang", known([f"c{i}" for i in range(n_chars)]).alias("ref_chars"), known([f"w{i}" for i in range(n_common)]).alias("ref_common"))


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance of two count arrays; null if either is empty."""
    total = lambda c: F.aggregate(F.transform(c, lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    sp, sq = total(p), total(q)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m) / 2).otherwise(0.0)
    both = F.zip_with(p, q, lambda a, b: F.struct((a / sp).alias("a"), (b / sq).alias("b")))
    js = F.aggregate(both, F.lit(0.0), lambda s, x: s + part(x["a"], (x["a"] + x["b"]) / 2) + part(x["b"], (x["a"] + x["b"]) / 2))
    return F.when((sp > 0) & (sq > 0), F.round(F.sqrt(F.greatest(js, F.lit(0.0))), 6))


def judge(spark: SparkSession, docs: DataFrame, max_char_js: float = MAX_CHAR_JS, max_word_js: float = MAX_WORD_JS) -> DataFrame:
    """Base counts, both distances and the verdict ``kept`` for every document."""
    found = cut(spark, features(docs), "features")
    # one row a listed language and one for all others: broadcast whatever the corpus
    d = found.join(F.broadcast(references(found)), "lang", "left")
    d = d.withColumn("char_js", F.when(F.col("n_chars") >= MIN_CHARS, distance("chars", "ref_chars")))
    d = d.withColumn("word_js", F.when((F.col("n_words") >= MIN_HIST_WORDS) & (F.col("lang") != "und"), distance("common", "ref_common")))
    fine = (F.coalesce("char_js", F.lit(0.0)) <= max_char_js) & (F.coalesce("word_js", F.lit(0.0)) <= max_word_js)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fine).alias("kept"), "char_js", "word_js", "lang")
