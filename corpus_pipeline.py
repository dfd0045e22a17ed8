"""A training corpus from raw documents: toxic documents out, repeated lines out, one of each group of near
copies, no benchmark passages, and the rest packed into sequences.

Each stage works on all that the stage before it kept. ORACLE_SQL is None: hashing of shingles, model scores and
tokenizers can't be written in SQL; tests/llm holds the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriset.llm import decontam, line_dedup, packing, simhash, toxicity
from veriset.llm.common import cut, table
from veriset.llm.queries import tokenizer_file


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go; the models learn from all labels."""
    return toxicity.drop_toxic(spark, docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), F.lit(True))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go, all but the first of each."""
    return line_dedup.apply(spark, docs)


def near_copies_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.deduplicate(spark, docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontam.decontaminate(spark, docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their sequences."""
    return packing.pack(spark, packing.pieces(docs, tokenizer_file("word_bpe_49k.json")))


STAGES = [("toxicity", toxic_out), ("line dedup", lines_once), ("SimHash near-dedup", near_copies_once), ("benchmark decontamination", benchmark_out), ("best-fit packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
