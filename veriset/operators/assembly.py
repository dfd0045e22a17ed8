"""Grids, joins, samples and training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws as D
from ..functions import scalar as S


def grid(pairs: DataFrame, attributes: DataFrame, conditions: list[str]) -> DataFrame:
    """Every pair in every attribute and condition, and once without an attribute."""
    injected = pairs.crossJoin(F.broadcast(attributes)).withColumn("condition", F.explode(F.array(*map(F.lit, conditions))))
    free = pairs.withColumn("protected_group", F.lit("none")).withColumn("protected_attr", F.lit("__attr_free__")).withColumn("condition", F.lit("attr_free"))
    d = injected.select(*pairs.columns, "protected_group", "protected_attr", "condition").unionByName(free)
    return d.withColumn("group_id", F.concat_ws("::", F.col("pair_id").cast("string"), "protected_group", "condition"))


def intersections(one: DataFrame, two: DataFrame, cap: int, references: tuple[str, str], seed: str) -> DataFrame:
    """Ordered product of two attribute lists (ordinal, attr), cut to ``cap``: cells at a reference first, the others by a portable draw."""
    d = one.select(F.col("ordinal").alias("i"), F.col("attr").alias("a")).crossJoin(F.broadcast(two.select(F.col("ordinal").alias("j"), F.col("attr").alias("b"))))
    anchor = (F.col("a") == references[0]) | (F.col("b") == references[1])
    w = Window.orderBy(anchor.desc(), S.portable_int(seed, F.col("a"), F.col("b")), "i", "j")
    return d.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= cap).select("i", "j", F.concat("a", F.lit(" | "), "b").alias("attr"))


def without_held_out(rows: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    return rows.join(held_out.select(key).distinct(), key, "left_anti")


def leaked(rows: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """Rows that should not be there: none, or the build must stop."""
    return rows.join(held_out.select(key).distinct(), key, "left_semi")


def _blocks(rows: DataFrame, by: str, value: Column, size: int, low: Column, high: Column, block: str, of: Column) -> DataFrame:
    """Rows packed into (``by``, ``block``, least ``low``, greatest ``high``, array of ``of``): about ``size`` rows of values within one of each other."""
    d = rows.withColumns({"__cell": F.floor(value), "__of": of, "__low": low, "__high": high})
    sizes = d.groupBy(by, "__cell").agg(F.count("*").alias("__n"))
    part = F.pmod(F.xxhash64("__of"), F.ceil(F.col("__n") / size))
    packed = d.join(sizes, [by, "__cell"]).groupBy(by, "__cell", part.alias("__part"))
    packed = packed.agg(F.min("__low").alias(f"{block}_low"), F.max("__high").alias(f"{block}_high"), F.collect_list("__of").alias(f"{block}_rows"))
    return packed.select(by, F.struct("__cell", "__part").alias(block), f"{block}_low", f"{block}_high", f"{block}_rows")


def match_pool(candidates: DataFrame, jobs: DataFrame, per_candidate: int, seed: str, below: float = 3, above: float = 0.5) -> DataFrame:
    """Jobs of a candidate's keyword whose years lie in its band, ``per_candidate`` drawn for each; null years match nothing.

    The draw is by pair, so every pair is drawn: blocks of candidates meet blocks of jobs, and each candidate's least draws of a block go on.
    """
    years, required = F.col("years").cast("double"), F.col("required").cast("double")
    # the parts of the drawn text (scalar.portable_int), where a missing id leaves its bar out
    head = F.concat_ws("|", F.lit(seed), F.col("candidate_id").cast("string"))
    tail = F.coalesce(F.concat(F.lit("|"), F.col("job_id").cast("string")), F.lit(""))
    c = F.struct(F.col("candidate_id").alias("id"), head.alias("text"), (years - below).alias("low"), (years + above).alias("high"))
    j = F.struct(F.col("job_id").alias("id"), tail.alias("text"), required.alias("value"))
    left = _blocks(candidates.filter(F.col("years").isNotNull()), "keyword", years, 1024, years - below, years + above, "c", c)
    right = _blocks(jobs.filter(F.col("required").isNotNull()), "keyword", required, 8192, required, required, "j", j)
    pairs = left.select("keyword", "c", "c_low", "c_high").join(right.select("keyword", "j", "j_low", "j_high"), "keyword").filter("j_high >= c_low and j_low <= c_high")
    pairs = pairs.select("keyword", "c", "j").join(left.select("keyword", "c", "c_rows"), ["keyword", "c"]).join(right.select("keyword", "j", "j_rows"), ["keyword", "j"])
    spark = candidates.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)
    kinds = {x: d.schema[x].dataType.simpleString() for d, x in ((candidates, "candidate_id"), (jobs, "job_id"), (candidates, "keyword"))}
    found = pairs.repartition(tasks, "keyword", "c", "j").select("c_rows", "j_rows", "keyword").mapInArrow(D.least_of_blocks(per_candidate), f"a {kinds['candidate_id']}, b {kinds['job_id']}, by {kinds['keyword']}, h long")
    w = Window.partitionBy("a").orderBy("h", "b")
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_candidate).select(F.col("a").alias("candidate_id"), F.col("b").alias("job_id"), F.col("by").alias("keyword"), F.col("r").alias("rank"))


def triples(kept: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Preference rows: the decision to keep and the one to reject of the same cell, where they differ."""
    a = kept.select(*key, F.col("decision").alias("chosen"))
    b = other.select(*key, F.col("decision").alias("rejected"))
    return a.join(b, key).filter("chosen <> rejected")


def unpaired(rows: DataFrame, key: list[str]) -> DataFrame:
    """Each preference row as a wanted and an unwanted completion."""
    return rows.selectExpr(*key, "stack(2, chosen, true, rejected, false) as (completion, label)")


def drawn_rank(rows: DataFrame, draw: Column, ties: list[str], by: Column | None = None) -> DataFrame:
    """Rows with ``r``, the rank by a 32-bit draw and ``ties``, within each value of ``by`` if given.

    The draw's highest byte deals the rows to 256 windows; only the sizes of these, one row each, are summed in one task.
    """
    d = rows.withColumns({"__h": draw.cast("long"), "__by": F.lit(0) if by is None else by}).withColumn("__bin", F.shiftright("__h", 24))
    sizes = d.groupBy("__by", "__bin").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__by").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__by", "__bin", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    w = Window.partitionBy("__by", "__bin").orderBy("__h", *ties)
    ranked = d.withColumn("r", F.row_number().over(w)).join(sizes, ["__by", "__bin"])
    return ranked.withColumn("r", F.col("r") + F.col("__before")).drop("__h", "__by", "__bin", "__before")


def balanced(rows: DataFrame, column: str, positive: str, draw: Column, ties: tuple[str, ...] = (), rate: float | None = None) -> DataFrame:
    """Rows of two classes by a draw: as many of each as the scarcer has, or, with ``rate``, that share of positives and all the scarcer side allows.

    One class alone stays as it is. Rows without a class are left out.
    """
    d = rows.filter(F.col(column).isNotNull())
    sizes = d.agg(F.count_if(F.col(column) == positive).alias("p"), F.count_if(F.col(column) != positive).alias("q"))
    if rate is None:
        want = sizes.select("p", "q", F.least("p", "q").alias("__p"), F.least("p", "q").alias("__q"))
    else:
        totals = [F.floor(F.col(n) / F.lit(share)) for n, share in (("p", rate), ("q", 1 - rate)) if share > 0]
        total = F.least(*[F.when(t > 0, t) for t in totals]) if len(totals) > 1 else totals[0]
        want = sizes.select("p", "q", F.bround(total * F.lit(rate)).cast("long").alias("__p"), total.alias("__t")).select("p", "q", "__p", (F.col("__t") - F.col("__p")).alias("__q"))
    is_positive = F.col(column) == positive
    d = drawn_rank(d, draw, list(ties), is_positive).crossJoin(F.broadcast(want))
    return d.filter((F.least("p", "q") == 0) | (F.col("r") <= F.when(is_positive, F.col("__p")).otherwise(F.col("__q")))).drop("r", "p", "q", "__p", "__q")


def split_candidates(rows: DataFrame, key: str, fraction: float, seed: str) -> DataFrame:
    """Rows marked validation or train so that a candidate is on one side only; at least one candidate validates."""
    ids = rows.select(key).distinct()
    n = ids.agg(F.greatest(F.lit(1), F.floor(F.lit(fraction) * F.count("*"))).alias("n"))
    ranked = drawn_rank(ids, S.portable_int(seed, F.col(key)), [key])
    marked = ranked.crossJoin(F.broadcast(n)).select(key, F.when(F.col("r") <= F.col("n"), "validation").otherwise("train").alias("split"))
    return rows.join(marked, key)


def exact_sample(rows: DataFrame, n: int, order: Column) -> DataFrame:
    """``n`` rows by a portable draw; a top-n, so no task gets more than its own rows."""
    return rows.orderBy(order).limit(n)


def drop_reasons(rows: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """Rows with ``drop_reason``, the first that holds; null keeps."""
    c = F.lit(None).cast("string")
    for name, failed in reversed(reasons):
        c = F.when(failed, name).otherwise(c)
    return rows.withColumn("drop_reason", c)


def drop_report(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
