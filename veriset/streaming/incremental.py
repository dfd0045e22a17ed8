"""Set tables kept up to date from a stream of answers (an extension: the batch operators define the results)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit


def fold(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Running sums of each cell after one more batch."""
    new = batch.groupBy("user_id", (F.col("event_id") % 2).alias("half"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(100 * F.col("value")).cast("long")).alias("s"))
    both = new if state is None else state.unionByName(new)
    return both.groupBy("user_id", "half", "event_type").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def sets(state: DataFrame) -> DataFrame:
    """The set table that the running sums give."""
    rows = state.select(F.col("user_id").alias("pair_id"), (F.col("user_id") % 20).alias("candidate_id"), F.when(F.col("half") == 0, "explicit").otherwise("implicit").alias("condition"), F.lit("decided").alias("outcome"), F.when(F.col("s") >= 5000 * F.col("n"), "hire").otherwise("reject").alias("decision"))
    return audit.set_table(rows, ["pair_id", "condition"]).select("pair_id", "condition", "size", "n_decided", "n_hire", "unstable")


def start(source: DataFrame, state_path: str, checkpoint: str):
    """Fold every micro-batch of ``source`` into a versioned table under ``state_path``; a replayed batch overwrites its own version."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{state_path}/v={number - 1}") if number else None
        fold(old, batch).write.mode("overwrite").parquet(f"{state_path}/v={number}")

    return source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, events: DataFrame) -> DataFrame:
    """All events as one stream, in the shared folder, and the set table at its end."""
    root = (spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="veriset-")).rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    events.repartition(4).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    q = start(stream, f"{root}/state", f"{root}/checkpoint")
    q.awaitTermination()
    last = q.lastProgress
    number = max(p["batchId"] for p in q.recentProgress) if q.recentProgress else last["batchId"]
    return sets(spark.read.parquet(f"{root}/state/v={number}"))
