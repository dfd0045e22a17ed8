"""Frames of the reports: tidy tables in percentage points, decision table, review items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import audit as A


def points(c: Column | str) -> Column:
    return F.round(100 * (F.col(c) if isinstance(c, str) else c), 6)


def run_level(rows: DataFrame, run: list[str]) -> DataFrame:
    """One row a run: volume and the rates over all its answers, in per cent."""
    p = A.population(rows, run)
    return p.select(*run, "n_total", points("acceptance_rate").alias("hire_pct"), points("reference_agreement").alias("utility_pct"), points("refusal_rate").alias("refusal_pct"), points("parse_failure_rate").alias("parse_fail_pct"), points("inconsistency_rate").alias("inconsistency_pct"))


def cell_level(table: DataFrame, cells: DataFrame, effects: DataFrame, cell: list[str] = A.CELL) -> DataFrame:
    """One row a cell: spread, largest gap with its attribute, utility."""
    d = A.disparity(table, cells, effects, cell).join(A.largest_gap(effects, cell), cell, "left").join(cells.select(*cell, "reference_agreement"), cell)
    return d.select(*cell, "n_attributes", points("ar_range").alias("ar_range_pp"), points("ar_mad").alias("mad_pp"), "largest_gap_attr", points("largest_gap").alias("largest_gap_pp"), points("reference_agreement").alias("utility_pct"))


def attribute_level(table: DataFrame, effects: DataFrame, cell: list[str] = A.CELL) -> DataFrame:
    """One row an attribute: hire share, gap to the reference level (null for the level itself), decided rows."""
    e = effects.select(*cell, "protected_attr", "gap")
    return table.join(e, [*cell, "protected_attr"], "left").select(*cell, "protected_attr", "n_decided", points("acceptance_rate").alias("hire_pct"), points("gap").alias("gap_pp"))


def decision_table(stability: DataFrame, after: DataFrame, before: DataFrame, run: list[str]) -> DataFrame:
    """Change of stability with its p, adjusted over all runs, beside the change of utility on the same cells."""
    tests = A.bh_adjust(stability, "p_sign")
    a = after.select(*run, F.col("reference_agreement").alias("a"), "parse_failure_rate")
    b = before.select(*run, F.col("reference_agreement").alias("b"))
    return tests.join(a, run).join(b, run).select(*run, F.round("delta_pp", 1).alias("delta_unstable_pp"), F.round("p_adj", 6).alias("p_fdr"), F.round(100 * (F.col("a") - F.col("b")), 1).alias("delta_utility_pp"), F.round(100 * F.coalesce("parse_failure_rate", F.lit(0.0)), 1).alias("parse_fail_pct"))


def review_items(rows: DataFrame, key: str, kinds: list[tuple[str, Column]], sample: int = 5) -> DataFrame:
    """For each kind how many rows show it, their share, and the first ``sample`` keys to look at.

    A row with several kinds counts in each; kinds without rows are left out. Counts come from one pass of partial sums,
    and the filter on row numbers reaches the map side, so a kind with most of the rows sends few of them.
    """
    flags = [F.coalesce(c, F.lit(False)) for _, c in kinds]
    named = F.filter(F.array(*[F.when(c, F.lit(n)) for c, (n, _) in zip(flags, kinds)]), lambda x: x.isNotNull())
    counts = rows.agg(F.count("*").alias("total"), *[F.count_if(c).alias(f"k{i}") for i, c in enumerate(flags)])
    stacked = reduce(DataFrame.unionByName, [counts.select(F.lit(n).alias("kind"), F.col(f"k{i}").alias("n"), "total") for i, (n, _) in enumerate(kinds)])
    long = rows.select(F.col(key).alias("k"), F.explode(named).alias("kind"))
    first = long.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("k"))).filter(F.col("r") <= sample)
    shown = first.groupBy("kind").agg(F.array_join(F.sort_array(F.collect_list("k")).cast("array<string>"), ",").alias("sample"))
    return stacked.filter("n > 0").join(shown, "kind").select("kind", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"), "sample")


def markdown(frame: DataFrame, title: str, most: int = 1000) -> str:
    """A section of a report; frames longer than ``most`` rows are refused, as a report isn't a sink for data."""
    got = frame.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"{title}: over {most} rows")
    show = lambda v: "--" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(frame.columns) + " |", "|" + "---|" * len(frame.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in got]) + "\n"
