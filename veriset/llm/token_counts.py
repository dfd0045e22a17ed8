"""Token counts through a digest cache.

A text is identified by the SHA-256 of its normalised content (null is the empty text; nothing else may
change, or the count would), a tokenizer by that of its file. Counts are kept in a Parquet table
(version, digest, n_tokens). Contents that aren't there are encoded once each, however many documents share them,
and appended. Copies are merged before the shuffle, so a large group of copies costs one row a task.
Tables are written in few files (``_in_few_files``).

Empty texts have no tokens. Repeated rows each get a row. Extra columns are ignored; an empty table appends nothing.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokenise
from .common import by_value, cut, shared_dir, text_of

by_value(__name__)

SCHEMA = "version string, digest string, n_tokens long"


def encode_missing(missing: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of (digest, text)."""

    def run(batches):
        for b in batches:
            n = tokenise.count_tokens(b.column(1).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return missing.mapInArrow(run, "digest string, n_tokens long")


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, cache: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row; ``cache`` is the cache table's path (default: a new one in the shared folder)."""
    version = tokenise.version(path)
    fresh = cache is None
    cache = cache or f"{shared_dir(spark)}/veriset/token-cache-{uuid.uuid4().hex}"
    known = None if fresh else _known(spark, cache, version)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    missing = d.select("digest", "text")
    if known is not None:
        missing = missing.join(known, "digest", "left_anti")
    missing = missing.groupBy("digest").agg(F.first("text").alias("text"))
    _in_few_files(encode_missing(missing, path)).select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = _known(spark, cache, version)
    if not fresh:  # runs at the same time may have appended a digest twice
        counts = cut(spark, _in_few_files(counts.dropDuplicates(["digest"])), "counts")
    # counts come from a table, so that the join may split a digest that many documents share
    return _in_few_files(d.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens"))


def _in_few_files(counts: DataFrame) -> DataFrame:
    """The same rows, dealt evenly to as many partitions as the cluster has cores, however many those of the shuffles are.

    On a local file system without Hadoop's native library each file that is made forks the executor several times
    (for chmod), and until such a child runs its own program the executor's memory is its memory too.
    """
    return counts.repartition(counts.sparkSession.sparkContext.defaultParallelism)


def _known(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """The cached counts of one tokenizer version; None where there is no table yet."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(cache)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(SCHEMA).parquet(cache).filter(F.col("version") == version).select("digest", "n_tokens")
