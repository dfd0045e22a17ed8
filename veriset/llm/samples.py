"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, text_of

#: Bytes of texts a class that a sample holds, and bytes of a text in it, at most. Texts are taken whole or not at all.
BYTES, LONGEST = 16_000_000, 1_000_000


def remainder(divisor: int) -> Column:
    """crc32 of the doc_id as text, modulo ``divisor``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def within(rows: DataFrame, by: list[str], order: list[str | Column], most: int) -> DataFrame:
    """Of ``rows`` (bounded in number, with a text) as many in each group, in order, as have ``most`` bytes together; none longer than ``LONGEST``."""
    rows = rows.filter(F.octet_length("text") <= LONGEST)
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__sum", F.sum(F.octet_length("text")).over(w)).filter(F.col("__sum") <= most).drop("__sum")


def labelled(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, usable: Column, bound: int) -> tuple[DataFrame, float | None]:
    """A stored sample (doc_id, y, text) and the share of label 1 among all ``usable`` rows (None without any).

    The sample has whole texts, of at most ``LONGEST`` bytes each, of at most ``bound`` documents and ``BYTES`` bytes of each class. The ids are chosen by hash from
    the labels alone; at most 2 * ``bound`` of them are broadcast to pick out the texts. Labels of missing documents are passed
    over, and a row that repeats a document counts as one more.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & usable)
    picked = None
    for y in (0, 1):
        one = rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        picked = one if picked is None else picked.unionByName(one)
    picked = picked.distinct()
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(picked), "doc_id")
    found = cut(spark, found.select("doc_id", "y", "text"), "sample")
    share = rows.agg(F.avg(F.col("y").cast("double"))).first()[0]
    return within(found, ["y"], [F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")], BYTES), share
