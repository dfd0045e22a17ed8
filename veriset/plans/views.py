"""Deterministic views that turn the driver's tables into audit rows. Decisions compare integers, so every engine agrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _answer(hire, outcome) -> list:
    decision = F.when(outcome == "decided", F.when(hire, V.HIRE).otherwise(V.REJECT))
    return [outcome.alias("outcome"), decision.alias("decision")]


def lineitem_rows(spark: SparkSession, sf_dir: str, threshold: int = 5) -> DataFrame:
    """One answer for each part, line status and return flag, with the part's own rule as reference."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linestatus", "l_returnflag", "l_linenumber", F.round(100 * F.col("l_discount")).cast("long").alias("pct"))
    g = li.groupBy("l_partkey", "l_linestatus", "l_returnflag").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("ln"), F.sum("pct").alias("s"))
    # the reference needs sums over the part; the grouped rows have all it takes
    ref = g.groupBy("l_partkey").agg((F.sum("s") >= 5 * F.sum("n")).alias("ref_hire"))
    outcome = F.when(F.col("n") < 2, "invalid").when(F.col("ln") >= 4, "refused").otherwise("decided")
    d = g.join(ref, "l_partkey")
    return d.select(F.col("l_partkey").alias("pair_id"), (F.col("l_partkey") % 50).alias("candidate_id"), F.lit("returnflag").alias("protected_group"), F.col("l_returnflag").alias("protected_attr"), F.when(F.col("l_linestatus") == "O", "explicit").otherwise("implicit").alias("condition"), *_answer(F.col("s") >= threshold * F.col("n"), outcome), F.when(F.col("ref_hire"), V.HIRE).otherwise(V.REJECT).alias("reference_decision"))


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer for each customer, order status and priority."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderpriority", F.floor("o_totalprice").alias("price"))
    g = o.groupBy("c_custkey", "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("price").alias("s")).join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return g.select(F.col("c_custkey").alias("pair_id"), F.col("c_nationkey").cast("long").alias("candidate_id"), F.lit("priority").alias("protected_group"), F.col("o_orderpriority").alias("protected_attr"), F.when(F.col("o_orderstatus") == "F", "explicit").when(F.col("o_orderstatus") == "O", "implicit").otherwise("attr_free").alias("condition"), *_answer(F.col("s") >= 250000 * F.col("n"), F.lit("decided")))


def event_rows(events: DataFrame) -> DataFrame:
    """One answer for each user, half of the events and event type; works on a stream's batches too."""
    g = events.groupBy("user_id", (F.col("event_id") % 2).alias("half"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(100 * F.col("value")).cast("long")).alias("s"))
    return g.select(F.col("user_id").alias("pair_id"), (F.col("user_id") % 20).alias("candidate_id"), F.lit("event").alias("protected_group"), F.col("event_type").alias("protected_attr"), F.when(F.col("half") == 0, "explicit").otherwise("implicit").alias("condition"), *_answer(F.col("s") >= 5000 * F.col("n"), F.lit("decided")))


def crossed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, n, rate): acceptance by order priority and return flag."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("b"), (F.round(100 * F.col("l_discount")).cast("long") >= 5).cast("int").alias("hire"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("a"))
    return li.join(o, "o_orderkey").groupBy("a", "b").agg(F.count("*").alias("n"), (F.sum("hire") / F.count("*")).alias("rate"))


def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.expr("vec_id div 5").alias("set_id"), (F.col("vec_id") % 5).alias("attr"), F.col("embedding")[0].cast("double").alias("base"), F.col("embedding")[1].cast("double").alias("adapter"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw_output): model answers of seven shapes, by doc_id."""
    k = F.col("doc_id") % 7
    raw = (
        F.when(k == 0, '{"decision": "Hire", "feedback": "good match of skills"}')
        .when(k == 1, '```json\n{"decision": "reject.", "feedback": "too little experience"}\n```')
        .when(k == 2, '{"decision": "To hire", "feedback": "strong",}')
        .when(k == 3, "{'decision': 'do not hire', 'feedback': 'weak'}")
        .when(k == 4, 'My answer: {"decision": "maybe", "feedback": "unclear"} as asked')
        .when(k == 5, "I cannot provide a hiring decision for this person.")
        .otherwise("%% garbage ##")
    )
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw_output"))
