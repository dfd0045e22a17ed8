"""Benchmark decontamination over a distributed positional inverted index, with DataFrame functions only.

The index stores postings (term, doc_id, pos) of the corpus, with the words that stand near a posting. Test
windows look up their rarest terms first: the posting lists of the two rarest terms of a window are shifted
by the terms' offsets and intersected, and what remains is compared word by word with the stored
neighbourhood. Only postings of terms that some window looks up are stored.

A window is ``size`` consecutive words of a test item, or the whole item if it has fewer (but not none).
Nulls and texts without words have no postings and no windows. Ties in rarity go to the first term of the window.
Rows that repeat a doc_id count as one document with the matches of all of them; each row keeps its own
n_words. Extra columns are ignored; empty tables give no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, text_of

SIZE = 10
#: Test terms or windows up to this number are broadcast, about 200 bytes each; beyond it joins shuffle.
BROADCAST_ROWS = 500_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(column: str = "text") -> Column:
    """Words of letters, digits and non-ASCII characters, with A-Z (and no other letter) lower-cased.

    ``lower`` changes further letters, so texts with such letters take the slower ``translate``.
    """
    text = text_of(column)
    other = text.rlike(r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^\x00-\x7F]]")
    return F.filter(F.split(F.when(other, F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text)), NOT_WORD), lambda w: w != "")


def windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(wid, words, n): the distinct windows of all items; use :func:`window_items` for their items."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words_of().alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    w = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, size))).alias("words"))
    return w.distinct().select(F.sha2(F.array_join("words", " "), 256).alias("wid"), "item_id", "words", F.size("words").alias("n"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def rarest(spark: SparkSession, docs: DataFrame, wins: DataFrame, lists: int = 2) -> DataFrame:
    """(wid, rank, term, off): the ``lists`` rarest terms of each window by corpus frequency (fewer words: all of them)."""
    terms = cut(spark, wins.select(F.explode("words").alias("term")).distinct(), "terms")
    n_terms = terms.count()
    seen = docs.select(F.explode(words_of()).alias("term")).join(_small(terms, n_terms), "term").groupBy("term").agg(F.count("*").alias("freq"))
    inside = wins.select("wid", F.posexplode("words").alias("off", "term")).distinct()
    ranked = inside.join(seen, "term", "left").withColumn("rank", F.row_number().over(Window.partitionBy("wid").orderBy(F.coalesce("freq", F.lit(0)), "off")))
    return ranked.filter(F.col("rank") <= lists).select("wid", "rank", "term", "off", F.coalesce("freq", F.lit(0)).alias("freq"))


def build_index(spark: SparkSession, docs: DataFrame, terms: DataFrame, n_terms: int, size: int = SIZE) -> DataFrame:
    """Postings (term, doc_id, pos, lead, near) of ``terms`` as a stored table; near has the words from ``lead`` before to ``size`` - 1 after."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of().alias("words"))
    if n_terms <= BROADCAST_ROWS:
        p = rows.select("doc_id", "words", F.posexplode("words").alias("pos", "term")).join(F.broadcast(terms), "term")
    else:  # texts aren't moved once a word: places are found first, and each text comes to its places once
        rows = rows.withColumn("version", F.xxhash64("words"))
        places = rows.select("doc_id", "version", F.posexplode("words").alias("pos", "term")).join(terms, "term")
        places = places.groupBy("doc_id", "version").agg(F.collect_set(F.struct("pos", "term")).alias("places"))
        p = rows.join(places, ["doc_id", "version"]).select("doc_id", "words", F.inline("places"))
    lead = F.least("pos", F.lit(size - 1))
    return cut(spark, p.select("term", "doc_id", "pos", lead.alias("lead"), F.slice("words", F.col("pos") - lead + 1, lead + size).alias("near")), "postings")


def phrase_matches(index: DataFrame, wins: DataFrame, looked_up: DataFrame, n_windows: int) -> DataFrame:
    """(doc_id, start, n, item_id): the places where a whole window occurs."""
    distinct = wins.select("wid", "words", "n").dropDuplicates(["wid"])
    first, second = (looked_up.filter(F.col("rank") == r).select("wid", "term", "off") for r in (1, 2))
    start = (F.col("pos") - F.col("off")).alias("start")
    a = index.join(_small(first.join(distinct, "wid"), n_windows), "term").filter("pos >= off")
    same = F.slice("near", F.greatest(F.col("lead") - F.col("off") + 1, F.lit(1)), F.col("n")) == F.col("words")
    a = a.select("doc_id", "wid", start, "n", same.alias("same")).filter("same").drop("same").distinct()
    b = index.join(_small(second, n_windows), "term").filter("pos >= off").select("doc_id", "wid", start).distinct()
    hits = a.filter("n > 1").join(b, ["doc_id", "wid", "start"]).select("doc_id", "start", "n", "wid").unionByName(a.filter("n = 1").select("doc_id", "start", "n", "wid"))
    return hits.join(_small(wins.select("wid", "item_id").distinct(), n_windows), "wid").select("doc_id", "start", "n", "item_id")


def proximity_matches(index: DataFrame, looked_up: DataFrame, n_windows: int, slack: int = 5) -> DataFrame:
    """(doc_id, wid, pos, gap): where a window's two rarest terms stand in order, at most ``slack`` words off their distance in it.

    The second list is cut into blocks of positions, so that a pair meets in equal or neighbouring blocks.
    """
    block = SIZE + slack
    one, two = (_small(looked_up.filter(F.col("rank") == r).select("wid", "term", "off"), n_windows) for r in (1, 2))
    a = index.join(one, "term").select("wid", "doc_id", (F.col("pos") - F.col("off")).alias("pos"))
    b = index.join(two, "term").select("wid", "doc_id", (F.col("pos") - F.col("off")).alias("pos2"))
    a = a.select("*", F.explode(F.array(*[F.floor(F.col("pos") / block) + d for d in (-1, 0, 1)])).alias("blk"))
    b = b.withColumn("blk", F.floor(F.col("pos2") / block))
    return a.join(b, ["wid", "doc_id", "blk"]).filter(F.abs(F.col("pos") - F.col("pos2")) <= slack).select("doc_id", "wid", "pos", (F.col("pos2") - F.col("pos")).alias("gap")).distinct()


def lookup(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = SIZE) -> dict[str, DataFrame]:
    """The index, the windows with their rarest terms, and the exact matches."""
    wins = cut(spark, windows(items, size), "windows")
    n_windows = wins.count()
    looked_up = cut(spark, rarest(spark, docs, wins), "rarest")
    terms = looked_up.filter("freq > 0").select("term").distinct()
    index = build_index(spark, docs, terms, 2 * n_windows, size)
    return {"index": index, "windows": wins, "rarest": looked_up, "matches": phrase_matches(index, wins, looked_up, n_windows), "n_windows": n_windows}


def matches(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = SIZE, slack: int = 5) -> DataFrame:
    """(doc_id, item_id, kind, start, gap): exact phrases (gap 0), and the proximity matches of :func:`proximity_matches`.

    start is where the window begins, or would begin by its rarest term.
    """
    found = lookup(spark, docs, items, size)
    phrases = found["matches"].select("doc_id", "item_id", F.lit("phrase").alias("kind"), F.col("start").cast("long").alias("start"), F.lit(0).cast("long").alias("gap"))
    near = proximity_matches(found["index"], found["rarest"], found["n_windows"], slack)
    near = near.join(_small(found["windows"].select("wid", "item_id").distinct(), found["n_windows"]), "wid")
    near = near.select("doc_id", "item_id", F.lit("proximity").alias("kind"), F.col("pos").cast("long").alias("start"), F.col("gap").cast("long").alias("gap"))
    return phrases.unionByName(near).distinct()


def covered(matches: DataFrame) -> DataFrame:
    """(doc_id, n_hit, items): words covered by matches, and the sorted item ids."""
    spans = matches.select("doc_id", "start", (F.col("start") + F.col("n")).alias("stop")).distinct()
    w = Window.partitionBy("doc_id").orderBy("start", "stop")
    reached = F.coalesce(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n_hit = spans.withColumn("new", F.greatest(F.col("stop") - F.greatest("start", reached), F.lit(0))).groupBy("doc_id").agg(F.sum("new").alias("n_hit"))
    items = matches.select("doc_id", "item_id").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return n_hit.join(items, "doc_id")


def report(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, n_hit, items) for every row of ``docs``."""
    hits = covered(lookup(spark, docs, items, size)["matches"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(words_of()).cast("long").alias("n_words"))
    return rows.join(hits, "doc_id", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` without the documents in which a window of an item occurs."""
    bad = lookup(spark, docs, items, size)["matches"].select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
