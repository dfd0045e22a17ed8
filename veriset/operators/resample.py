"""Resampling tests in numpy, one group at a time, and rank tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .audit import hired

SEED, CHUNK = 42, 2_000_000


def _chunks(draws: int, n: int):
    """Numbers of draws whose index matrices stay small."""
    step = max(1, CHUNK // max(n, 1))
    for i in range(0, draws, step):
        yield min(step, draws - i)


def permutation(rows: DataFrame, cell: list[str], draws: int) -> DataFrame:
    """Each attribute's acceptance against draws of its size, with replacement, from its cell.

    A cell's answers are 0 or 1, so its counts say all: tasks get one row an attribute, whatever the number of rows,
    and a draw's sum is binomial.
    """
    counts = rows.withColumn("h", hired()).filter("h is not null").groupBy(*cell, "protected_attr").agg(F.count("*").alias("n"), F.sum("h").alias("k"))
    schema = ", ".join([f"{c} string" for c in cell] + ["protected_attr string", "n long", "observed double", "p double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q = pdf["k"].sum() / pdf["n"].sum()
        out = []
        for r in pdf.itertuples(index=False):
            drawn = np.random.default_rng(SEED).binomial(r.n, q, draws) / r.n - q
            observed = r.k / r.n - q
            out.append((*[getattr(r, c) for c in cell], r.protected_attr, r.n, observed, float((np.abs(drawn) >= abs(observed) - 1e-12).mean())))
        return pd.DataFrame(out, columns=[*cell, "protected_attr", "n", "observed", "p"])

    return counts.groupBy(*cell).applyInPandas(run, schema)


def _histogram(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """How often each value occurs in a group: what resampling needs of rows with few distinct values."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n"))


def sign_flip(rows: DataFrame, by: list[str], value: str, draws: int) -> DataFrame:
    """Mean difference against random signs; values that occur n times flip as one binomial."""
    schema = ", ".join([f"{c} string" for c in by] + ["n long", "mean double", "p double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n = pdf["x"].to_numpy(), pdf["n"].to_numpy()
        total, mean = n.sum(), (x * n).sum() / n.sum()
        rng = np.random.default_rng(SEED)
        drawn = np.concatenate([((2 * rng.binomial(n, 0.5, (d, len(n))) - n) * x).sum(1) / total for d in _chunks(draws, len(n))])
        return pd.DataFrame([(*pdf.iloc[0][by], int(total), float(mean), float((np.abs(drawn) >= abs(mean) - 1e-12).mean()))], columns=[*by, "n", "mean", "p"])

    return _histogram(rows, by, value).groupBy(*by).applyInPandas(run, schema)


def bootstrap(rows: DataFrame, by: list[str], value: str, draws: int, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the mean; null with fewer than two values."""
    schema = ", ".join([f"{c} string" for c in by] + ["n long", "mean double", "ci_low double", "ci_high double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n = pdf["x"].to_numpy(), pdf["n"].to_numpy()
        total = int(n.sum())
        rng = np.random.default_rng(SEED)
        means = np.concatenate([rng.multinomial(total, n / total, d) @ x / total for d in _chunks(draws, len(n))])
        low, high = np.quantile(means, [alpha / 2, 1 - alpha / 2]) if total > 1 else (None, None)
        return pd.DataFrame([(*pdf.iloc[0][by], total, float((x * n).sum() / total), low, high)], columns=[*by, "n", "mean", "ci_low", "ci_high"])

    return _histogram(rows, by, value).groupBy(*by).applyInPandas(run, schema)


def cluster_bootstrap(sets: DataFrame, cluster: str, flags: list[str], draws: int) -> DataFrame:
    """Intervals, in percent, of shares and of their difference when whole clusters are drawn again.

    Spark sums to one row a cluster; equal rows are counted, so that the task that draws gets the distinct ones only.
    """
    per = sets.groupBy(cluster).agg(F.count("*").alias("n"), *[F.sum(f).alias(f) for f in flags]).groupBy("n", *flags).agg(F.count("*").alias("clusters"))
    schema = "measure string, value double, ci_low double, ci_high double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf["clusters"].to_numpy()
        rng = np.random.default_rng(SEED)
        w = np.concatenate([rng.multinomial(c.sum(), c / c.sum(), d) for d in _chunks(draws, len(c))])
        n = pdf["n"].to_numpy(float)
        measures = {f: pdf[f].to_numpy(float) for f in flags} | {"delta": pdf[flags[1]].to_numpy(float) - pdf[flags[0]].to_numpy(float)}
        return pd.DataFrame([(k, float(100 * (v * c).sum() / (n * c).sum()), *map(float, np.quantile(100 * (w @ v) / (w @ n), [0.025, 0.975]))) for k, v in measures.items()], columns=["measure", "value", "ci_low", "ci_high"])

    return per.groupBy(F.lit(1).alias("one")).applyInPandas(run, schema)


def summed_before(rows: DataFrame, x: str, n: str, bins: int = 64) -> DataFrame:
    """Rows of distinct ``x`` with ``before``, the sum of ``n`` over all rows with a smaller one.

    Approximate quantiles deal the rows to bins of about equal size, each with a window of its own; only the bins' sums
    meet in one task.
    """
    cuts = rows.agg(F.percentile_approx(x, [i / bins for i in range(1, bins)], 1000).alias("__cuts"))
    d = rows.crossJoin(F.broadcast(cuts)).withColumn("__bin", F.size(F.filter("__cuts", lambda c: c < F.col(x)))).drop("__cuts")
    sums = d.groupBy("__bin").agg(F.sum(n).alias("__s"))
    sums = sums.select("__bin", F.coalesce(F.sum("__s").over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__bin").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    inside = d.withColumn("before", F.coalesce(F.sum(n).over(within), F.lit(0)))
    return inside.join(F.broadcast(sums), "__bin").withColumn("before", F.col("before") + F.col("__base")).drop("__bin", "__base")


def quantile_at(rows: DataFrame, column: str, level: DataFrame) -> DataFrame:
    """``level`` (one row: level) with ``value``, the interpolated quantile of the column at that level, which may come from data."""
    values = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    placed = summed_before(values, column, "n").crossJoin(F.broadcast(level.select(F.col("level")).crossJoin(values.agg(F.sum("n").alias("__t")))))
    at = F.col("level") * (F.col("__t") - 1)
    value = lambda r: F.max(F.when((F.col("before") <= r) & (r < F.col("before") + F.col("n")), F.col(column)))
    d = placed.groupBy("level", "__t").agg(value(F.floor(at)).alias("__lo"), value(F.floor(at) + 1).alias("__hi"))
    share = at - F.floor(at)
    return d.select("level", (F.col("__lo") * (1 - share) + F.coalesce(F.col("__hi") * share, F.lit(0.0))).alias("value"))


def wilcoxon(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Signed-rank test of two columns with the normal tail, ties at their mean rank, zeros left out. Ranks come from counts of distinct differences."""
    d = rows.select((F.col(a) - F.col(b)).alias("d")).filter("d <> 0")
    sizes = d.groupBy(F.abs("d").alias("m")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    ranked = summed_before(sizes, "m", "n").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    s = ranked.agg(F.sum("n").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w_plus"), F.sum(F.pow("n", 3) - F.col("n")).alias("ties"))
    n = F.col("n")
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    # Abramowitz and Stegun 7.1.26 for the normal tail
    t = 1 / (1 + 0.3275911 * F.abs("z") / math.sqrt(2))
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-F.col("z") * F.col("z") / 2)
    return s.withColumn("z", z).select("n", "w_plus", F.round("z", 6).alias("z"), F.round(tail, 6).alias("p"))
