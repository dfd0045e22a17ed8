"""Linear concept erasure: directions from distributed sums, small matrices on the driver, applied in batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Eraser:
    """x becomes mean + P (x - mean)."""

    projection: np.ndarray
    mean: np.ndarray


def cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def moments(rows: DataFrame, vector: str = "embedding", label: str = "label") -> tuple[dict, np.ndarray]:
    """By label: count and sum of vectors; and the sum of outer products. A task sends one partial sum, of a size that depends on the dimension only."""

    def run(batches):
        sums: dict = {}
        gram = None
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float)
            y = np.array(b.column(1).to_pylist())
            if not len(x):
                continue
            gram = x.T @ x + (0 if gram is None else gram)
            for k in np.unique(y):
                n, s = sums.get(k, (0, 0))
                sums[k] = (n + int((y == k).sum()), s + x[y == k].sum(0))
        if gram is not None:
            rows = [(int(k), n, s.tolist()) for k, (n, s) in sums.items()] + [(-1, 0, gram.ravel().tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.float64())))], names=["k", "n", "s"])

    parts = rows.select(vector, F.col(label).cast("long")).mapInArrow(run, "k long, n long, s array<double>")
    total = parts.select("k", "n", F.posexplode("s").alias("i", "v")).groupBy("k", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    got = total.toPandas().sort_values(["k", "i"])
    out = {k: (int(g["n"].iloc[0]), g["v"].to_numpy()) for k, g in got.groupby("k")}
    gram = out.pop(-1)[1]
    d = int(len(gram) ** 0.5)
    return out, gram.reshape(d, d)


def fit_mean_diff(rows: DataFrame, vector: str = "embedding", label: str = "label") -> Eraser:
    """Projects out the span of each class mean less the mean of the rest."""
    sums, _ = moments(rows, vector, label)
    n, total = sum(c for c, _ in sums.values()), sum(s for _, s in sums.values())
    directions = [s / c - (total - s) / (n - c) for c, s in sums.values() if 0 < c < n]
    directions = [v / np.linalg.norm(v) for v in directions if np.linalg.norm(v) > 1e-8]
    d = len(total)
    if not directions:
        return Eraser(np.eye(d), np.zeros(d))
    u, s, _ = np.linalg.svd(np.array(directions).T, full_matrices=False)
    u = u[:, s > 1e-8]
    return Eraser(np.eye(d) - u @ u.T, np.zeros(d))


def fit_leace(rows: DataFrame, vector: str = "embedding", label: str = "label", floor: float = 1e-6) -> Eraser:
    """Least change that removes all linear covariance with the label: whitens, projects, unwhitens."""
    sums, gram = moments(rows, vector, label)
    n, total = sum(c for c, _ in sums.values()), sum(s for _, s in sums.values())
    mean = total / n
    sxx = (gram - n * np.outer(mean, mean)) / (n - 1)
    sxz = np.array([(s - c * mean) / (n - 1) for c, s in sums.values()]).T
    values, vectors = np.linalg.eigh(sxx)
    kept = values > floor
    root = np.sqrt(values[kept])
    whiten, unwhiten = (vectors[:, kept] / root) @ vectors[:, kept].T, (vectors[:, kept] * root) @ vectors[:, kept].T
    u, s, _ = np.linalg.svd(whiten @ sxz, full_matrices=False)
    u = u[:, s > 1e-10]
    return Eraser(np.eye(len(mean)) - unwhiten @ u @ u.T @ whiten, mean)


def fit_inlp(rows: DataFrame, vector: str = "embedding", label: str = "label", rounds: int = 8, margin: float = 0.01, steps: int = 50) -> Eraser:
    """Linear probes whose directions are projected out one after the other, until a probe is no better than the commonest label.

    Each probe is a distributed logistic regression on the vectors as they are then; the projection is composed on the driver.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    counts = rows.groupBy(label).count().collect()
    n = sum(r["count"] for r in counts)
    majority = max((r["count"] for r in counts), default=0) / max(n, 1)
    index = {r[label]: i for i, r in enumerate(sorted(counts, key=lambda r: r[label]))}
    first = rows.select(vector).first()
    d = len(first[0]) if first else 0
    projection = np.eye(d)
    if len(index) < 2:
        return Eraser(projection, np.zeros(d))
    coded = F.element_at(F.create_map(*[F.lit(x) for k, i in index.items() for x in (k, float(i))]), F.col(label))
    data = rows.select(vector, coded.alias("__y"))
    probe = LogisticRegression(featuresCol="__x", labelCol="__y", maxIter=steps, regParam=1e-4, standardization=False)
    for _ in range(rounds):
        current = apply(data, Eraser(projection, np.zeros(d)), vector).select(array_to_vector("erased").alias("__x"), "__y")
        model = probe.fit(current)
        right = model.transform(current).agg(F.avg((F.col("prediction") == F.col("__y")).cast("double"))).first()[0]
        if right <= majority + margin:
            break
        u, s, _ = np.linalg.svd(model.coefficientMatrix.toArray().T, full_matrices=False)
        u = u[:, s > 1e-8 * max(s[0], 1e-300)]
        projection = (np.eye(d) - u @ u.T) @ projection
    return Eraser(projection, np.zeros(d))


def diagnose(rows: DataFrame, eraser: Eraser, vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row: rows, share of the commonest label, mean relative change of the vectors."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    d = apply(rows, eraser, vector)
    change = norm(F.zip_with("erased", vector, lambda a, b: a - b.cast("double"))) / F.nullif(norm(F.col(vector)), F.lit(0.0))
    by = d.groupBy(label).agg(F.count("*").alias("n"), F.sum(change).alias("change"))
    return by.agg(F.sum("n").alias("n_rows"), F.round(F.max("n") / F.sum("n"), 9).alias("majority_share"), F.round(F.sum("change") / F.sum("n"), 5).alias("relative_change"))


def apply(rows: DataFrame, eraser: Eraser, vector: str = "embedding", strength: float = 1.0) -> DataFrame:
    """``rows`` with ``erased``; the matrix is as large as the dimension squared, so it is sent along."""
    p, mean = eraser.projection, eraser.mean

    @F.pandas_udf("array<double>")
    def run(x):
        import pandas as pd

        v = np.array(x.tolist(), float).reshape(len(x), -1)
        w = mean + (v - mean) @ p.T if len(v) else v
        return pd.Series(list(v + strength * (w - v)) if len(v) else [], dtype=object)

    return rows.withColumn("erased", run(vector))
