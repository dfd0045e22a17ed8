"""Audit operators: sets, rates, disparities, tests, evidence. Each takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import vocabulary as V

CELL = ["protected_group", "condition"]


def decided() -> Column:
    return F.col("outcome") == "decided"


def hired() -> Column:
    """1 or 0 for decided rows, null for the others."""
    return F.when(decided(), (F.col("decision") == V.HIRE).cast("int"))


def rate(flag: Column, over: Column) -> Column:
    return F.avg(F.when(over, flag.cast("double")))


def rounded(c: Column | str) -> Column:
    return F.round(c, 9)


def inconsistency(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows with ``inconsistent``: whether a decided row differs from its set's majority (a tie counts as reject); null in sets with one decided row."""
    w = Window.partitionBy(*key)
    n, hires = F.count(hired()).over(w), F.sum(hired()).over(w)
    majority = (2 * hires > n).cast("int")
    return rows.withColumn("inconsistent", F.when(decided() & (n >= 2), (hired() != majority).cast("int")))


def per_attribute(rows: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Counts and rates of each attribute in each cell."""
    d = decided()
    return rows.groupBy(*cell, "protected_attr").agg(
        F.count("*").alias("n_total"),
        F.count_if(d).alias("n_decided"),
        F.count_if(F.col("outcome") == "refused").alias("n_refused"),
        F.count_if(F.col("outcome") == "invalid").alias("n_invalid"),
        rounded(F.avg((F.col("outcome") == "refused").cast("double"))).alias("refusal_rate"),
        rounded(F.avg((F.col("outcome") == "invalid").cast("double"))).alias("parse_failure_rate"),
        rounded(F.avg(hired().cast("double"))).alias("acceptance_rate"),
        rounded(F.avg(F.col("inconsistent").cast("double"))).alias("inconsistency_rate"),
        rounded(rate(F.col("decision") == F.col("reference_decision"), d)).alias("reference_agreement"),
        rounded(rate(F.col("decision") == V.HIRE, d & (F.col("reference_decision") == V.HIRE))).alias("ar_ref_hire"),
        F.count_if(d & (F.col("reference_decision") == V.HIRE)).alias("n_ref_hire"),
        rounded(rate(F.col("decision") == V.HIRE, d & (F.col("reference_decision") == V.REJECT))).alias("ar_ref_reject"),
        F.count_if(d & (F.col("reference_decision") == V.REJECT)).alias("n_ref_reject"),
    )


def population(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rates over all rows of a cell, or of the whole run without keys."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_total"),
        F.count_if(decided()).alias("n_decided"),
        rounded(F.avg((F.col("outcome") == "refused").cast("double"))).alias("refusal_rate"),
        rounded(F.avg((F.col("outcome") == "invalid").cast("double"))).alias("parse_failure_rate"),
        rounded(F.avg(hired().cast("double"))).alias("acceptance_rate"),
        rounded(F.avg(F.col("inconsistent").cast("double"))).alias("inconsistency_rate"),
        rounded(rate(F.col("decision") == F.col("reference_decision"), decided())).alias("reference_agreement"),
    )


def effect_sizes(table: DataFrame, reference: str, cell: list[str] = CELL) -> DataFrame:
    """Each attribute's gap to the reference level and Cohen's h."""
    ref = table.filter(F.col("protected_attr") == reference).select(*cell, F.col("acceptance_rate").alias("ref_rate"))
    gap = F.col("acceptance_rate") - F.col("ref_rate")
    return table.join(ref, cell).filter(F.col("protected_attr") != reference).select(*cell, "protected_attr", rounded(gap).alias("gap"), rounded(S.cohens_h(F.col("acceptance_rate"), F.col("ref_rate"))).alias("cohens_h"))


def largest_gap(effects: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Attribute with the largest absolute gap in each cell; the first by name wins ties."""
    w = Window.partitionBy(*cell).orderBy(F.abs("gap").desc_nulls_last(), "protected_attr")
    return effects.withColumn("r", F.row_number().over(w)).filter("r = 1").select(*cell, F.col("protected_attr").alias("largest_gap_attr"), F.col("gap").alias("largest_gap"), F.col("cohens_h").alias("h_at_gap"))


def disparity(table: DataFrame, cells: DataFrame, effects: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Range, spread and mean absolute deviation of acceptance over the attributes of a cell, and mean absolute h."""
    pop = cells.select(*cell, F.col("acceptance_rate").alias("pop"))
    spread = table.join(pop, cell).groupBy(*cell).agg(
        F.count("*").alias("n_attributes"),
        rounded(F.max("acceptance_rate") - F.min("acceptance_rate")).alias("ar_range"),
        rounded(F.stddev_pop("acceptance_rate")).alias("ar_sd"),
        rounded(F.avg(F.abs(F.col("acceptance_rate") - F.col("pop")))).alias("ar_mad"),
        rounded(F.max("ar_ref_hire") - F.min("ar_ref_hire")).alias("ar_range_ref_hire"),
        rounded(F.max("ar_ref_reject") - F.min("ar_ref_reject")).alias("ar_range_ref_reject"),
    )
    return spread.join(effects.groupBy(*cell).agg(rounded(F.avg(F.abs("cohens_h"))).alias("mean_abs_h")), cell, "left")


def rollup(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Mean over groups within a condition, then over conditions, each weighing the same."""
    inner = cells.groupBy("condition").agg(*[F.avg(c).alias(c) for c in columns])
    return inner.agg(*[rounded(F.avg(c)).alias(c) for c in columns], F.count("*").alias("n_conditions"))


def weighted_rollup(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Means weighted by decided rows over the given cells."""
    return cells.agg(*[rounded(F.sum(F.col(c) * F.col("n_decided")) / F.sum(F.when(F.col(c).isNotNull(), F.col("n_decided")))).alias(c) for c in columns], F.count("*").alias("n_cells"))


def set_table(rows: DataFrame, key: list[str]) -> DataFrame:
    """Size, decided rows, stability and majority of each set."""
    h = hired()
    return rows.groupBy(*key).agg(
        F.count("*").alias("size"),
        F.count(h).alias("n_decided"),
        F.coalesce(F.sum(h), F.lit(0)).alias("n_hire"),
        F.coalesce((F.min(h) != F.max(h)).cast("int"), F.lit(0)).alias("unstable"),
        F.min("candidate_id").alias("candidate_id"),
    ).withColumn("majority", F.when(F.col("n_decided") == 0, F.lit(None).cast("string")).when(2 * F.col("n_hire") > F.col("n_decided"), V.HIRE).when(2 * F.col("n_hire") == F.col("n_decided"), "tie").otherwise(V.REJECT))


def stability(base: DataFrame, run: DataFrame, key: list[str], variant: list[str]) -> DataFrame:
    """One row a set that is complete and fully decided on both sides, over the variants that the run has."""
    shared = base.join(run.select(*variant).distinct(), variant, "left_semi")
    left, right = (set_table(x, key).select(*key, "candidate_id", *[F.col(c).alias(f"{c}_{n}") for c in ("size", "n_decided", "unstable")]) for x, n in ((shared, "base"), (run, "run")))
    both = left.join(right.drop("candidate_id"), key)
    return both.filter("n_decided_base = size_base and n_decided_run = size_run and size_base = size_run")


def stability_summary(sets: DataFrame) -> DataFrame:
    fixed, broken = F.count_if(F.expr("unstable_base = 1 and unstable_run = 0")), F.count_if(F.expr("unstable_base = 0 and unstable_run = 1"))
    s = sets.agg(F.count("*").alias("sets"), rounded(100 * F.avg("unstable_base")).alias("unstable_base_pct"), rounded(100 * F.avg("unstable_run")).alias("unstable_run_pct"), fixed.alias("fixed"), broken.alias("broken"))
    return s.withColumn("delta_pp", rounded(100 * (F.col("broken") - F.col("fixed")) / F.col("sets"))).withColumn("p_sign", F.round(S.sign_test(F.col("fixed"), F.col("broken")), 6))


def bh_adjust(tests: DataFrame, p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg step-up within each family; null p-values are carried and don't count."""
    by = by or []
    known = F.col(p).isNotNull()
    m = F.count(p).over(Window.partitionBy(*by, known))
    rank = F.row_number().over(Window.partitionBy(*by, known).orderBy(p))
    d = tests.withColumn("__raw", F.when(known, F.col(p) * m / rank))
    below = Window.partitionBy(*by, known).orderBy(F.col(p).desc(), F.col("__raw")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.withColumn("p_adj", F.when(known, F.least(F.lit(1.0), F.min("__raw").over(below)))).drop("__raw")


def leave_one_out(rows: DataFrame, key: list[str]) -> DataFrame:
    """Each decided row's value less the mean of the others of its set, from window sums instead of a self-join."""
    w = Window.partitionBy(*key)
    n, total = F.count(hired()).over(w), F.sum(hired()).over(w)
    return rows.withColumn("others", F.when(decided() & (n > 1), (total - hired()) / (n - 1))).withColumn("diff", F.when(F.col("others").isNotNull(), hired() - F.col("others")))


def additivity(cells: DataFrame, ref_a: str, ref_b: str) -> DataFrame:
    """Observed rate of a two-attribute cell less what its margins predict, cells at a reference left out."""
    at = lambda cond, names: cells.filter(cond).select(*names)
    a = at(F.col("b") == ref_b, ["a", F.col("rate").alias("ra")])
    b = at(F.col("a") == ref_a, ["b", F.col("rate").alias("rb")])
    o = at((F.col("a") == ref_a) & (F.col("b") == ref_b), [F.col("rate").alias("r0")])
    d = cells.filter((F.col("a") != ref_a) & (F.col("b") != ref_b)).join(F.broadcast(a), "a").join(F.broadcast(b), "b").crossJoin(F.broadcast(o))
    return d.select("a", "b", rounded("rate").alias("observed"), rounded(F.col("ra") + F.col("rb") - F.col("r0")).alias("predicted"), rounded(F.col("rate") - F.col("ra") - F.col("rb") + F.col("r0")).alias("interaction"))


def exact_binary_test(table: DataFrame, cells: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Resampling test of a binary rate against its cell, in closed form: sums of n draws are binomial."""
    pop = cells.select(*cell, F.col("acceptance_rate").alias("pop"))
    d = table.join(pop, cell).filter("n_decided > 0")
    n, q = F.col("n_decided").cast("int"), F.col("pop")
    far = F.abs(F.col("acceptance_rate") - q) - 1e-9
    # log-probabilities by a running ratio: each term follows from the one before
    step = lambda s, i: F.struct((s["l"] + F.log((n - i + 1) / i) + F.log(q / (1 - q))).alias("l"), (s["p"] + F.when(F.abs(i / n - q) >= far, F.exp(s["l"] + F.log((n - i + 1) / i) + F.log(q / (1 - q)))).otherwise(0.0)).alias("p"))
    first = F.struct((n * F.log(1 - q)).alias("l"), F.when(q >= far, F.exp(n * F.log(1 - q))).otherwise(0.0).alias("p"))
    p = F.aggregate(F.sequence(F.lit(1), n), first, step, lambda s: s["p"])
    return d.select(*cell, "protected_attr", F.round(F.least(F.lit(1.0), p), 6).alias("p"))


def cell_gate(cells: DataFrame) -> DataFrame:
    """Why a cell can't be interpreted, as codes; an empty list passes. Missing measures aren't judged."""
    r = V.RULES
    reasons = [F.when(F.col("reference_agreement") < r["min_utility"], "low_utility"), F.when((F.col("acceptance_rate") < r["degenerate"]) | (F.col("acceptance_rate") > 1 - r["degenerate"]), "degenerate"), F.when(F.col("refusal_rate") + F.col("parse_failure_rate") > r["unusable"], "unusable")]
    return cells.withColumn("gate_reasons", F.array_compact(F.array(*reasons))).withColumn("passed", F.size("gate_reasons") == 0)


def attribute_verdict(tests: DataFrame) -> DataFrame:
    """Verdict of each attribute from its adjusted p, paired p, gap and h."""
    r = V.RULES
    fdr = F.coalesce(F.col("p_adj") <= r["alpha"], F.lit(False))
    material = F.coalesce(F.abs("gap") >= r["gap"], F.lit(False)) | F.coalesce(F.abs("cohens_h") >= r["h"], F.lit(False))
    paired = F.coalesce(F.col("paired_p") < r["alpha"], F.lit(False))
    v = F.when(fdr & material & paired, "confirmed").when(fdr & material, "probable").when(fdr | material, "weak").otherwise("clean")
    return tests.withColumn("verdict", v).withColumn("rank", F.when(v == "confirmed", 3).when(v == "probable", 2).when(v == "weak", 1).otherwise(0))


def cell_verdict(cells: DataFrame, verdicts: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Best attribute verdict of a cell; strong ones also need the spread, and failing the gate ends it."""
    best = verdicts.groupBy(*cell).agg(F.max("rank").alias("rank"))
    d = cells.join(best, cell, "left")
    graded = F.when(~F.col("passed"), "not_interpretable").when((F.col("rank") >= 2) & (F.col("ar_mad") < V.RULES["mad"]), "weak").when(F.col("rank") == 3, "confirmed").when(F.col("rank") == 2, "probable").when(F.col("rank") == 1, "weak").otherwise("clean")
    return d.withColumn("verdict", graded)


def run_gate(cells: DataFrame, run: list[str]) -> DataFrame:
    """Cells of a run of which some but too few pass the gate aren't interpreted at all."""
    share = F.avg(F.col("passed").cast("double")).over(Window.partitionBy(*run))
    return cells.withColumn("verdict", F.when((share > 0) & (share < V.RULES["min_cells"]), "not_interpretable").otherwise(F.col("verdict")))


def recurrence(verdicts: DataFrame) -> DataFrame:
    """How an attribute fares over all cells."""
    penalised, favoured = F.count_if(F.col("gap") < 0), F.count_if(F.col("gap") > 0)
    d = verdicts.groupBy("protected_group", "protected_attr").agg(F.count("*").alias("cells"), penalised.alias("penalised"), favoured.alias("favoured"), F.count_if(F.col("verdict") == "confirmed").alias("confirmed"), rounded(F.avg("gap")).alias("mean_gap"), rounded(F.max(F.abs("gap"))).alias("max_abs_gap"), F.array_join(F.sort_array(F.collect_set("condition")), ",").alias("conditions"))
    return d.withColumn("direction", F.when((F.col("penalised") > 0) & (F.col("favoured") == 0), "penalised").when((F.col("favoured") > 0) & (F.col("penalised") == 0), "favoured").otherwise("mixed"))


def baseline_delta(runs: DataFrame, baselines: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Each run beside its own baseline; null where there is none."""
    b = baselines.select(*keys, *[F.col(c).alias(f"{c}_baseline") for c in columns])
    d = runs.join(b, keys, "left")
    return d.select(*keys, *columns, *[f"{c}_baseline" for c in columns], *[rounded(F.col(c) - F.col(f"{c}_baseline")).alias(f"{c}_delta") for c in columns])


def thresholds(margins: DataFrame, columns: list[str], quantiles: list[float], key: list[str]) -> DataFrame:
    """Hire rate and share of unstable sets when a margin above a quantile of its own counts as a hire."""
    out = None
    for c in columns:
        cuts = margins.agg(F.percentile(c, F.array(*map(F.lit, quantiles))).alias("cuts")).select(F.posexplode("cuts").alias("i", "threshold"))
        d = margins.crossJoin(F.broadcast(cuts)).withColumn("hire", (F.col(c) > F.col("threshold")).cast("int"))
        sets = d.groupBy("i", "threshold", *key).agg(F.sum("hire").alias("h"), F.count("*").alias("n"), (F.min("hire") != F.max("hire")).cast("int").alias("unstable"))
        one = sets.groupBy("i", "threshold").agg(rounded(F.sum("h") / F.sum("n")).alias("hire_rate"), rounded(F.avg("unstable")).alias("unstable_share")).select(F.lit(c).alias("model"), F.col("i").alias("step"), rounded("threshold").alias("threshold"), "hire_rate", "unstable_share")
        out = one if out is None else out.unionByName(one)
    return out
