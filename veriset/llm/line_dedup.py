"""Removal of repeated multi-line chunks with content-defined boundaries, with DataFrame functions only.

A text is cut into lines, after each line break and after each sentence end with a space (so that a passage
set inside a long line is found too). Each line has a hash; a rolling hash over the hashes of a line and the
line before it decides whether a chunk ends there, so boundaries move with the content and not with its
place. A chunk counts if it has two lines or more, or a line of ``LONG`` characters, and ``LEAST`` characters.
Of the chunks with equal bytes all but the first (least doc_id, then place) are removed.

Lines of ``LONG`` characters are chunks of their own. Null text is the empty text and stays as it is. Rows that
repeat a doc_id have equal ids, so equal chunks at the same place in them are one: they stay or go together. Rows
without a doc_id stay whole and don't count. Extra columns stay. An empty table gives an empty result.

Texts are cut into chunks once; the table of chunks is written, and the steps read from it the columns they need.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, release, text_of

LINE_END = r"(?<=\n)|(?<=[.!?] )"
LONG, LEAST = 300, 60
#: Repeated passages of so many words go in ``apply``, whatever their lines.
WORDS = 50
#: The white space around lines.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
#: A chunk ends where the last hexadecimal digit of the rolling hash is one of these: after every second line on average.
ENDS = list("02468ace")


def chunked(docs: DataFrame, keep: tuple[str, ...] = (), lines: bool = False) -> DataFrame:
    """(doc_id, *keep, bodies, hs): the bodies, joined, are the text; hs has the hash of each chunk that counts, null for the others.

    Of the columns to keep, text is kept as whether it is null. With ``lines``, (doc_id, *keep, odd, lines, chunks) instead: whether there is other white space
    than blanks and line breaks, the lines, and the first and last line (i, e) of the chunks that count.
    """
    keep = [(F.col(c).isNull() if c == "text" else F.col(c)).alias(f"__{c}") for c in keep]
    if lines:
        keep.append(reduce(lambda a, b: a | b, [F.contains(text_of(), F.lit(c)) for c in "\t\x0b\x0c\r"]).alias("odd"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.filter(F.split(text_of(), LINE_END), lambda x: x != "").alias("lines"))
    d = d.select("*", F.transform("lines", lambda x: F.md5(x)).alias("h"), F.transform("lines", lambda x: F.length(x) >= LONG).alias("long"), F.size("lines").alias("n"))
    h, long, n = F.col("h"), F.col("long"), F.col("n")
    rolling = lambda i: F.md5(F.concat(F.coalesce(F.get(h, i - 1), F.lit("")), F.get(h, i)))
    ends_here = lambda i: (i == n - 1) | F.get(long, i) | F.coalesce(F.get(long, i + 1), F.lit(False)) | F.substring(rolling(i), 32, 1).isin(ENDS)
    d = d.withColumn("ends", F.when(n > 0, F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), ends_here)).otherwise(F.array().cast("array<int>")))
    whole, ends = F.col("lines"), F.col("ends")
    first = lambda j: F.coalesce(F.get(ends, j - 1) + 1, F.lit(0))
    if lines:
        d = d.withColumn("sizes", F.transform("lines", lambda x: F.length(x).cast("long")))
        sized = F.transform(ends, lambda e, j: F.struct(first(j).alias("i"), e.alias("e"), F.aggregate(_part("sizes", first(j), e - first(j) + 1), F.lit(0).cast("long"), lambda s, x: s + x).alias("n")))
        chunks = F.filter(sized, lambda x: (x["n"] >= LEAST) & ((x["e"] > x["i"]) | (x["n"] >= LONG)))
        return d.select("doc_id", *[c for c in d.columns if c.startswith("__")], "odd", "lines", F.transform(chunks, lambda x: F.struct(x["i"].alias("i"), x["e"].alias("e"))).alias("chunks"))
    d = d.withColumn("bodies", F.transform(ends, lambda e, j: F.array_join(F.slice(whole, first(j) + 1, e - first(j) + 1), "")))
    counts = lambda b, j: (F.length(b) >= LEAST) & ((F.get(ends, j) > first(j)) | (F.length(b) >= LONG))
    return d.select("doc_id", *[c for c in d.columns if c.startswith("__")], "bodies", F.transform("bodies", lambda b, j: F.when(counts(b, j), F.xxhash64(b))).alias("hs"))


def _digest(body: Column) -> Column:
    """SHA-256 of some bytes, which stands for them when bytes are compared."""
    return F.unhex(F.sha2(body, 256))


def _again(spark: SparkSession, places: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``places`` whose key occurs more than once, and the table of these keys.

    The keys are a table of their own, so that neither the count nor the join needs all places of a frequent key in one task.
    """
    twice = cut(spark, places.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key), "twice")
    return places.join(twice, key), twice


def repeated(spark: SparkSession, chunks: DataFrame) -> DataFrame:
    """(doc_id, gone): the chunks to remove, as structs (j, h), from a stored ``chunked`` table."""
    keys = chunks.filter("doc_id is not null").select("doc_id", F.posexplode("hs").alias("j", "h")).filter("h is not null")
    asked, twice = _again(spark, keys, "h")
    asked = cut(spark, asked.groupBy("doc_id").agg(F.collect_set(F.struct("j", "h")).alias("asked")), "asked")
    release(spark, twice)
    found = chunks.join(asked, "doc_id").select("doc_id", "bodies", F.filter("asked", lambda x: F.get("hs", x["j"]) == x["h"]).alias("asked"))
    found = found.select("doc_id", F.inline(F.transform("asked", lambda x: F.struct(x["j"].alias("j"), x["h"].alias("h"), _digest(F.get("bodies", x["j"])).alias("s")))))
    found = cut(spark, found, "digests")
    release(spark, asked)
    # by the digests of the bytes, so that texts with equal hashes stay apart
    kept = cut(spark, found.groupBy("s").agg(F.min(F.struct("doc_id", "j")).alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n"), "kept")
    other = found.join(kept, "s").filter((F.col("doc_id") != F.col("kept.doc_id")) | (F.col("j") != F.col("kept.j")))
    gone = cut(spark, other.groupBy("doc_id").agg(F.collect_set(F.struct("j", "h")).alias("gone")), "gone")
    release(spark, found, kept)
    return gone


def _left() -> Column:
    """The bodies that stay: those between the places that go, in order."""
    its = F.filter(F.coalesce("gone", F.array().cast("array<struct<j: int, h: bigint>>")), lambda x: F.get("hs", x["j"]) == x["h"])
    places = F.sort_array(F.transform(its, lambda x: x["j"]))
    # the places and the end, each with the bodies from the place before it on
    ends = F.concat(places, F.array(F.size("bodies")))
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), places), ends, lambda a, b: F.struct((a + 1).alias("a"), b.alias("b")))
    return F.flatten(F.transform(F.filter(runs, lambda r: r["a"] < r["b"]), lambda r: _part("bodies", r["a"], r["b"] - r["a"])))


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_chunks, n_removed): the text without its removed chunks."""
    chunks = cut(spark, chunked(docs), "chunks")
    d = chunks.join(repeated(spark, chunks), "doc_id", "left").select("doc_id", F.size("bodies").alias("n_chunks"), _left().alias("left"))
    return d.select("doc_id", F.array_join("left", "").alias("text"), "n_chunks", (F.col("n_chunks") - F.size("left")).alias("n_removed"))


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE))


def _part(column: str, start: Column, n: Column) -> Column:
    """``n`` elements (one at least) from place ``start`` on; ``slice`` in a lambda would copy the whole array each time."""
    return F.transform(F.sequence(start, start + n - 1), lambda t: F.get(column, t))


def _reach(k: Column) -> Column:
    """The number of lines from ``k`` on that it takes to have ``WORDS`` words, from the columns words, two and four: sums of so many lines.

    Null if there are too few. Eight lines are enough nearly always; only where they aren't, all are tried. Each line has one word at least,
    so ``WORDS`` lines suffice.
    """
    one, two, four = (lambda t, c=c: F.get(c, k + t if t else k) for c in ("words", "two", "four"))
    full = lambda x: x >= WORDS
    steps = F.array(*[F.lit(t) for t in range(WORDS)])
    # one number, 100 times the words and the lines, as structs cost several times as much
    far = F.aggregate(steps, F.lit(0).cast("long"), lambda a, t: F.when(a >= 100 * WORDS, a).otherwise(a + F.get("words", k + t) * 100 + 1), lambda a: F.when(a >= 100 * WORDS, (a % 100).cast("int")))
    up_to_2 = F.when(full(one(0)), 1).otherwise(2)
    up_to_4 = F.when(full(two(0)), up_to_2).otherwise(F.when(full(two(0) + one(2)), 3).otherwise(4))
    up_to_6 = F.when(full(four(0) + one(4)), 5).otherwise(6)
    up_to_8 = F.when(full(four(0) + two(4)), up_to_6).otherwise(F.when(full(four(0) + two(4) + one(6)), 7).otherwise(8))
    return F.when(full(four(0)), up_to_4).when(full(four(0) + four(4)), up_to_8).otherwise(far)


def cut_lines(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, version, lines, chunks, at, words, hs): the lines, joined, are the text.

    at has the places of the lines that aren't blank, words and hs their words and hashes without the white space around them.
    """
    d = chunked(docs, keep, lines=True)
    keep = [c for c in d.columns if c.startswith("__")]
    d = d.select("*", F.transform("lines", _trimmed).alias("bare"))
    d = d.select("*", F.filter(F.sequence(F.lit(0), F.greatest(F.size("lines") - 1, F.lit(0))), lambda i: F.get("bare", i) != "").alias("at"), F.filter("bare", lambda x: x != "").alias("solid"))
    # where words have one blank between them, as nearly everywhere, blanks are counted: an expression takes several times as long
    blanks = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))
    split = lambda x: F.size(F.split(x, r"[\x20\x09-\x0D]+"))
    words = F.transform("solid", lambda x: F.when(F.col("odd") | F.contains(x, F.lit("  ")), split(x)).otherwise(blanks(x) + 1).cast("long"))
    return d.select("doc_id", *keep, F.xxhash64("lines").alias("version"), "lines", "chunks", "at", words.alias("words"), F.transform("solid", lambda x: F.xxhash64(x)).alias("hs"))


def ranges(known: DataFrame) -> DataFrame:
    """(doc_id, version, lines, solid, units) of ``cut_lines`` with ``asked``, the lines (j, h) that occur elsewhere: units are the ranges to compare, as structs (i, e, p, q).

    Units are the chunks that count and end in such a line, and passages: the least ones of ``WORDS`` words or more that start, or that end,
    with each line, inside runs of such lines. So each line of a repeated run of lines with ``WORDS`` words lies in a passage that is
    repeated, wherever the run stands. i and e are the places of the first and last line, p and q, null in chunks,
    those among ``solid``, the lines that aren't blank without the white space around them.
    """
    # rows that share a doc_id are told apart by the hash at the place
    mine = F.filter("asked", lambda x: F.get("hs", x["j"]) == x["h"])
    d = known.select("doc_id", "version", "lines", "chunks", "at", "words", F.sort_array(F.transform(mine, lambda x: x["j"])).alias("js"))
    js, at = F.col("js"), F.col("at")
    starts = F.filter(js, lambda x, k: F.coalesce(F.get(js, k - 1) != x - 1, F.lit(True)))
    stops = F.filter(js, lambda x, k: F.coalesce(F.get(js, k + 1) != x + 1, F.lit(True)))
    runs = F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    with_later = lambda c, n: F.transform(c, lambda x, k: x + F.coalesce(F.get(c, k + n), F.lit(0)))
    d = d.withColumn("two", with_later("words", 1))
    d = d.withColumn("four", with_later("two", 2))
    end = lambda p: p + _reach(p) - 1  # noqa: E731  of the least passage from there on
    runs = F.filter(runs, lambda r: end(r["a"]) <= r["b"])
    # those that have a passage are the first lines of a run
    qs = lambda r: F.filter(F.transform(F.sequence(r["a"], r["b"]), end), lambda q: q <= r["b"])
    d = d.select("*", F.transform(runs, lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b"), qs(r).alias("qs"))).alias("runs"))
    # a passage goes on over blank lines up to the next line that isn't
    last = lambda q: F.coalesce(F.get(at, q + 1), F.size("lines")) - 1
    unit = lambda p, q: F.struct(F.get(at, p).alias("i"), last(q).alias("e"), p.alias("p"), q.alias("q"))
    # the least passage that ends with a line starts with the last one whose own ends there or before: up to where that of the next ends
    until = lambda r, q, k: F.greatest(q, F.coalesce(F.get(r["qs"], k + 1) - 1, r["b"]))
    of_line = lambda r, q, k: F.transform(F.sequence(q, until(r, q, k)), lambda t: unit(r["a"] + k, t))
    passages = F.flatten(F.flatten(F.transform("runs", lambda r: F.transform(r["qs"], lambda q, k: of_line(r, q, k)))))
    # whether each line occurs elsewhere: the gap before each of them, and what follows the last
    flags = F.flatten(F.transform(js, lambda j, k: F.concat(F.array_repeat(F.lit(False), F.get(at, j) - F.coalesce(F.get(at, F.get(js, k - 1)), F.lit(-1)) - 1), F.array(F.lit(True)))))
    d = d.select("*", passages.alias("passages"), flags.alias("flags"))
    chunks = F.filter("chunks", lambda x: F.coalesce(F.get("flags", x["e"]), F.lit(False)) | (_trimmed(F.get("lines", x["e"])) == ""))
    none = F.lit(None).cast("int")
    chunks = F.transform(chunks, lambda x: F.struct(x["i"].alias("i"), x["e"].alias("e"), none.alias("p"), none.alias("q")))
    # flags stands twice here, or the optimiser would put its making into the lambda and so make it for every chunk
    units = F.concat("passages", F.when(F.size("flags") >= 0, chunks)).alias("units")
    return d.select("doc_id", "version", "lines", F.transform("at", lambda i: _trimmed(F.get("lines", i))).alias("solid"), units)


def repeated_ranges(spark: SparkSession, stored: DataFrame) -> DataFrame:
    """(doc_id, version, gone): the disjoint ranges (a, b) of lines to remove, in order, from a stored ``cut_lines`` table."""
    row = ["doc_id", "version"]
    keys = stored.filter("doc_id is not null").select("doc_id", F.posexplode("hs").alias("j", "h"))
    asked, twice = _again(spark, keys, "h")
    asked = cut(spark, asked.groupBy("doc_id").agg(F.collect_set(F.struct("j", "h")).alias("asked")), "asked")
    release(spark, twice)
    passage = lambda x: F.concat(F.lit("p"), F.array_join(_part("solid", x["p"], x["q"] - x["p"] + 1), "\n"))
    chunk = lambda x: F.concat(F.lit("c"), F.array_join(_part("lines", x["i"], x["e"] - x["i"] + 1), ""))
    exact = lambda x: F.when(x["p"].isNotNull(), passage(x)).otherwise(chunk(x))
    found = ranges(stored.join(asked, "doc_id"))
    found = found.select(*row, F.inline(F.transform("units", lambda x: F.struct(x["i"].alias("i"), x["e"].alias("e"), _digest(exact(x)).alias("s")))))
    found = cut(spark, found, "ranges")
    release(spark, asked)
    kept = cut(spark, found.groupBy("s").agg(F.min(F.struct(*row, "i", "e")).alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n"), "kept")
    here = (F.col("doc_id") == F.col("kept.doc_id")) & (F.col("version") == F.col("kept.version"))
    other = found.join(kept, "s").filter(~(here & (F.col("i") == F.col("kept.i"))))
    # a later copy that overlaps the first one leaves it whole
    other = other.select(*row, F.when(here, F.greatest("i", F.col("kept.e") + 1)).otherwise(F.col("i")).alias("a"), F.col("e").alias("b")).filter("a <= b").distinct()
    w = Window.partitionBy(*row).orderBy("a", "b")
    other = other.withColumn("new", F.when(F.col("a") > F.coalesce(F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(-1)), 1).otherwise(0))
    other = other.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*row, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    gone = cut(spark, other.groupBy(*row).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("gone")), "gone")
    release(spark, found, kept)
    return gone


def apply(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with its texts cut, and n_chars to match where there is one; documents left with white space only go. Extra columns stay.

    Removed are repeated chunks and, whatever their line lengths, repeated passages of ``WORDS`` words or more in whole lines, which
    are compared without the white space around their lines. Documents that lose nothing stay as they are, empty ones included.
    """
    stored = cut(spark, cut_lines(docs, tuple(docs.columns)), "lines")
    gone = F.col("gone")
    start = lambda j: F.coalesce(F.get(gone, j - 1)["b"] + 1, F.lit(0))
    stop = lambda j: F.coalesce(F.get(gone, j)["a"], F.size("lines"))
    left = F.array_join(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda j: F.when(stop(j) > start(j), F.array_join(_part("lines", start(j), stop(j) - start(j)), ""))), "")
    d = stored.drop("chunks", "at", "words", "hs").join(repeated_ranges(spark, stored), ["doc_id", "version"], "left").withColumn("left", F.when(gone.isNotNull(), left))
    d = d.filter(F.col("left").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.coalesce("left", F.when(~F.col("__text"), F.array_join("lines", "")))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("left").isNotNull(), F.length("left")).otherwise(F.col("__n_chars"))
    return d.select(*[new.get(c, F.col(f"__{c}")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
