"""Follow-up planning over graded cells: what to treat, what to keep as a control, what to leave out.

A graded cell has the columns of RUN, ``protected_group``, ``condition``, ``verdict``, ``passed``, ``gate_reasons``,
``ar_mad``, ``utility`` and ``discrimination``. Cells are aggregates: their number grows with runs, groups and
conditions, not with answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V

RUN = ["model", "lang"]
CELL = [*RUN, "protected_group", "condition"]


def verdict_rank(verdict: Column) -> Column:
    return F.when(verdict == "confirmed", 3).when(verdict == "probable", 2).when(verdict == "weak", 1).when(verdict == "clean", 0).otherwise(-1)


def families(mad: Column) -> Column:
    """Mitigations to try, cheapest first; the costly ones only where a run could show a difference."""
    cheap = ["prompt", "scrub"]
    of = lambda names: F.array(*map(F.lit, names))
    return F.when(mad >= V.PLAN["all_families"], of([*cheap, "embedding", "sft", "dpo"])).when(mad >= V.PLAN["tuned_families"], of([*cheap, "embedding", "sft"])).otherwise(of(cheap))


def rescuable(cells: DataFrame) -> DataFrame:
    """Cells that fail the gate on utility alone and still tell candidates apart."""
    valid = ~F.arrays_overlap("gate_reasons", F.array(F.lit("partial"), F.lit("unusable")))
    return cells.filter(~F.col("passed") & valid & (F.col("discrimination") >= V.PLAN["rescuable"]))


def targets(cells: DataFrame, most: int | None = None) -> DataFrame:
    """Strong cells with a material spread, by ``priority`` from 1: best verdict first, then widest spread, then name."""
    strong = cells.withColumn("rank", verdict_rank(F.col("verdict"))).filter(F.col("passed") & (F.col("rank") >= 2) & (F.col("ar_mad") >= V.RULES["mad"]))
    order = Window.orderBy(F.col("rank").desc(), F.col("ar_mad").desc(), *CELL)
    d = strong.withColumn("priority", F.row_number().over(order)).withColumn("families", families(F.col("ar_mad"))).drop("rank")
    return d if most is None else d.filter(F.col("priority") <= most)


def controls(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """For each run with a target its cleanest clean cell; the first by name wins ties."""
    clean = cells.filter(F.col("passed") & (F.col("verdict") == "clean") & F.col("ar_mad").isNotNull()).join(chosen.select(*RUN).distinct(), RUN, "left_semi")
    least = clean.groupBy(*RUN).agg(F.min(F.struct("ar_mad", "protected_group", "condition")).alias("least"))
    return least.select(*RUN, "least.protected_group", "least.condition", "least.ar_mad")


def excluded(cells: DataFrame) -> DataFrame:
    return cells.filter(~F.col("passed")).select(*CELL, F.array_join(F.sort_array("gate_reasons"), ",").alias("reasons"))


def roles(cells: DataFrame, most: int | None = None) -> DataFrame:
    """One row a run in the plan: its strongest role (rescue, then target, then control) and the number of cells in it."""
    chosen = targets(cells, most)
    named = [(rescuable(cells), "rescue", 0), (chosen, "target", 1), (controls(cells, chosen), "control", 2)]
    rows = [d.select(*RUN, F.lit(role).alias("role"), F.lit(r).alias("r")) for d, role, r in named]
    counted = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy(*RUN, "role", "r").agg(F.count("*").alias("cells"))
    return counted.groupBy(*RUN).agg(F.min(F.struct("r", "role", "cells")).alias("best")).select(*RUN, "best.role", "best.cells")


def scope(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """Groups and conditions to measure again for each run: those of its targets and its control, and always the plain condition."""
    both = chosen.select(*CELL).unionByName(controls(cells, chosen).select(*CELL))
    plain = F.array_join(F.array_append(F.sort_array(F.collect_set("condition")), F.lit("attr_free")), ",")
    return both.groupBy(*RUN).agg(F.array_join(F.sort_array(F.collect_set("protected_group")), ",").alias("groups"), plain.alias("conditions"))


def configurations(chosen: DataFrame) -> DataFrame:
    """The path of each configuration that the targets ask for, once."""
    slug = F.lower("model")
    d = chosen.select(slug.alias("slug"), "lang", F.explode("families").alias("family")).distinct()
    return d.select("slug", "lang", "family", F.concat(F.lit("configs/"), "family", F.lit("/"), F.concat_ws("-", "slug", "lang"), F.lit(".yaml")).alias("path"))


def language_notes(cells: DataFrame, first: str = "en", second: str = "uk") -> DataFrame:
    """The same cell in two languages side by side, with a note where lower utility may explain the wider spread."""
    at = lambda lang, tag: F.max(F.when(F.col("lang") == lang, F.struct("ar_mad", "utility", "verdict"))).alias(tag)
    wide = cells.groupBy("model", "protected_group", "condition").agg(at(first, "a"), at(second, "b")).filter("a is not null and b is not null")
    change = F.round(F.col("b.utility") - F.col("a.utility"), 9)
    return wide.select("model", "protected_group", "condition", F.round(F.col("b.ar_mad") - F.col("a.ar_mad"), 9).alias("delta_mad"), change.alias("delta_utility"), F.when(change < -V.PLAN["utility_drop"], "utility_lower").otherwise("").alias("note"))


def condition_notes(cells: DataFrame) -> DataFrame:
    """The same cell stated outright and told in passing, with a note where only the latter is biased."""
    at = lambda c, tag: F.max(F.when(F.col("condition") == c, F.struct("ar_mad", "utility", "verdict"))).alias(tag)
    wide = cells.groupBy(*RUN, "protected_group").agg(at("explicit", "a"), at("implicit", "b")).filter("a is not null and b is not null")
    hidden = F.col("a.verdict").isin("clean", "weak") & (verdict_rank(F.col("b.verdict")) >= 2)
    return wide.select(*RUN, "protected_group", F.round(F.col("b.ar_mad") - F.col("a.ar_mad"), 9).alias("delta_mad"), F.when(hidden, "implicit_only").otherwise("").alias("note"))


def winners(runs: DataFrame, top: int = 1) -> DataFrame:
    """The best ``top`` runs of each family, model and language that reduce the spread without damage; ties by run name."""
    w = Window.partitionBy("family", *RUN).orderBy(F.col("mad_reduction").desc(), "run_name")
    return runs.filter(~F.col("damaged") & (F.col("mad_reduction") > 0)).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def crossed_scope(cells: DataFrame, crossed: list[str]) -> DataFrame:
    """Crossed groups with confirmed, material bias by run, under the conditions that showed it."""
    kept = cells.filter(F.col("passed") & (F.col("verdict") == "confirmed") & F.col("protected_group").isin(crossed) & (F.col("ar_mad") >= V.RULES["mad"]))
    plain = F.array_join(F.array_append(F.sort_array(F.collect_set("condition")), F.lit("attr_free")), ",")
    return kept.groupBy(*RUN).agg(F.array_join(F.sort_array(F.collect_set("protected_group")), ",").alias("groups"), plain.alias("conditions"))


def direction(gap: Column, rate_flag: Column, flips_flag: Column) -> Column:
    """Which way an attribute moves decisions; unstable where they move without moving the rate."""
    material = F.coalesce(F.abs(gap) >= V.RULES["gap"], F.lit(False))
    side = F.when(gap > 0, "favoured").otherwise("penalised")
    return F.when(rate_flag & material, side).when(flips_flag & ~material, "unstable").when(material, side).otherwise("none")
