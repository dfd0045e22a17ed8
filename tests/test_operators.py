"""Hand-made cases of the audit operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriset.functions import scalar as S
from veriset.operators import assembly as M
from veriset.operators import audit as A
from veriset.operators import erasure as E
from veriset.operators import resample as R

ROW = "pair_id string, protected_attr string, outcome string, decision string, candidate_id string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def rows(spark, answers):
    return spark.createDataFrame([("p", str(i), o, d, "c") for i, (o, d) in enumerate(answers)], ROW)


def test_inconsistency_majority_tie_and_single(spark):
    d = A.inconsistency(rows(spark, [("decided", "hire"), ("decided", "hire"), ("decided", "reject"), ("refused", None)]), ["pair_id"])
    assert [r.inconsistent for r in d.orderBy("protected_attr").collect()] == [0, 0, 1, None]
    tie = A.inconsistency(rows(spark, [("decided", "hire"), ("decided", "reject")]), ["pair_id"])
    assert [r.inconsistent for r in tie.orderBy("protected_attr").collect()] == [1, 0]
    assert A.inconsistency(rows(spark, [("decided", "hire")]), ["pair_id"]).first().inconsistent is None


@pytest.mark.parametrize("text, want", [("Hire!", "hire"), ("do not hire", "reject"), ("we cannot hire", "reject"), ("I would hire them", "hire"), ("відхилити", "reject"), ("не найняти", "reject"), ("maybe", "model refuses to decide"), ("unable to say", "model refuses to decide"), ("", "invalid output"), ("banana", "invalid output"), (None, "invalid output")])
def test_decisions(spark, text, want):
    assert one(spark, S.decision_of(F.lit(text).cast("string"))) == want


def test_mentions_inflected(spark):
    assert one(spark, S.mentions(F.lit("досвід ветерана корисний"), S.stems(F.lit("Ветеран"))))
    assert not one(spark, S.mentions(F.lit("strong skills"), S.stems(F.lit("Veteran of war"))))


def test_language(spark):
    assert one(spark, S.language_ok(F.lit("гарний досвід роботи"), "uk"))
    assert not one(spark, S.language_ok(F.lit("гарний досвід роботи"), "en"))
    assert one(spark, S.language_ok(F.lit("ok"), "uk"))


def test_sign_test_published_values(spark):
    assert one(spark, S.sign_test(F.lit(0), F.lit(0))) is None
    for a, b in ((59, 16), (38, 4), (5, 5), (1, 0)):
        want = min(1, 2 * sum(math.comb(a + b, i) for i in range(min(a, b) + 1)) / 2 ** (a + b))
        assert abs(one(spark, S.sign_test(F.lit(a), F.lit(b))) - want) < 1e-12


def test_cohens_h(spark):
    assert one(spark, S.cohens_h(F.lit(1.5), F.lit(0.5))) is None
    assert abs(one(spark, S.cohens_h(F.lit(0.5), F.lit(0.25))) - (2 * math.asin(0.5**0.5) - 2 * math.asin(0.5))) < 1e-12


def test_bh_nulls_and_monotone(spark):
    p = [0.01, 0.04, 0.03, None, 0.2]
    d = A.bh_adjust(spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")).orderBy("i").collect()
    assert [None if r.p_adj is None else round(r.p_adj, 6) for r in d] == [0.04, 0.053333, 0.053333, None, 0.2]


def test_stability_only_complete_sets(spark):
    schema = "pair_id string, condition string, protected_group string, protected_attr string, candidate_id string, outcome string, decision string"
    base = spark.createDataFrame([("p", "e", "g", a, "c", "decided", d) for a, d in (("x", "hire"), ("y", "reject"))] + [("q", "e", "g", "x", "c", "decided", "hire"), ("q", "e", "g", "y", "c", "refused", None)], schema)
    run = spark.createDataFrame([(p, "e", "g", a, "c", "decided", "hire") for p in "pq" for a in "xy"], schema)
    got = A.stability_summary(A.stability(base, run, ["pair_id", "condition"], ["protected_group", "protected_attr"])).first()
    assert (got.sets, got.fixed, got.broken) == (1, 1, 0)


def test_split_keeps_candidates_apart(spark):
    d = M.split_candidates(spark.range(100).selectExpr("id % 10 as c", "id"), "c", 0.2, "s")
    assert d.groupBy("c").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert d.filter("split = 'validation'").select("c").distinct().count() == 2


def test_balance(spark):
    d = spark.createDataFrame([(i, "hire" if i < 90 else "reject") for i in range(100)], "i int, d string")
    assert sorted(r[1] for r in M.balanced(d, "d", "hire", F.col("i")).groupBy("d").count().collect()) == [10, 10]
    assert M.balanced(d.filter("d = 'hire'"), "d", "hire", F.col("i")).count() == 90


def test_permutation_flags_a_planted_effect(spark):
    rng = np.random.default_rng(0)
    data = [("p", a, "decided", "hire" if rng.random() < p else "reject", "c", "g", "e") for a, p in (("x", 0.5), ("y", 0.5), ("z", 0.2)) for _ in range(400)]
    d = spark.createDataFrame(data, ROW + ", protected_group string, condition string")
    p = {r.protected_attr: r.p for r in R.permutation(d, A.CELL, 2000).collect()}
    assert p["z"] < 0.01


def test_leace_removes_covariance(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 600)
    x = rng.normal(size=(600, 8)) + np.eye(8)[y] * 3
    d = spark.createDataFrame([(x[i].tolist(), int(y[i])) for i in range(600)], "embedding array<double>, label long")
    for fit in (E.fit_leace, E.fit_mean_diff):
        z = np.array([r.erased for r in E.apply(d, fit(d)).select("erased", "label").collect()])
        means = np.array([z[y == k].mean(0) for k in range(3)])
        assert np.abs(means - means[0]).max() < 1e-6


def test_drop_reason_is_the_first(spark):
    d = M.drop_reasons(spark.range(4).selectExpr("id"), [("small", F.col("id") < 2), ("even", F.col("id") % 2 == 0)])
    assert [r.drop_reason for r in d.orderBy("id").collect()] == ["small", "small", "even", None]


def test_balance_to_a_rate(spark):
    d = spark.createDataFrame([(i, "hire" if i < 60 else "reject") for i in range(100)], "i int, d string")
    got = {r["d"]: r["count"] for r in M.balanced(d, "d", "hire", F.col("i"), rate=0.25).groupBy("d").count().collect()}
    assert got == {"hire": 13, "reject": 40}
    none = M.balanced(d.withColumn("d", F.lit(None).cast("string")), "d", "hire", F.col("i"))
    assert none.count() == 0


def test_drawn_rank_is_the_global_order(spark):
    d = spark.range(3000).select("id", S.portable_int("x", F.col("id") % 700).alias("h"))
    got = {r.id: r.r for r in M.drawn_rank(d, F.col("h"), ["id"]).collect()}
    order = sorted((r.h, r.id) for r in d.collect())
    assert got == {i: n + 1 for n, (_, i) in enumerate(order)}


def test_quantile_and_sums_before(spark):
    rng = np.random.default_rng(2)
    x = np.round(np.concatenate([rng.normal(size=900), rng.lognormal(3, 2, 300)]), 1)
    d = spark.createDataFrame([(float(v),) for v in x], "x double")
    for q in (0.0, 0.137, 0.5, 1.0):
        got = R.quantile_at(d, "x", spark.createDataFrame([(q,)], "level double")).first().value
        assert abs(got - np.quantile(x, q)) < 1e-9
    sizes = d.groupBy("x").agg(F.count("*").alias("n"))
    assert all(r.before == (x < r.x).sum() for r in R.summed_before(sizes, "x", "n").collect())
    assert R.summed_before(sizes.limit(0), "x", "n").count() == 0


def brute_pool(candidates, jobs, n, seed):
    """match_pool row by row: the draw is the start of an MD5, a null id leaves its part out."""
    import hashlib

    def draw(*parts):
        return int(hashlib.md5("|".join(str(p) for p in (seed, *parts) if p is not None).encode()).hexdigest()[:8], 16)

    found = {}
    for i, k, y in candidates:
        fits = [j for j, kk, r in jobs if k is not None and k == kk and y is not None and r is not None and y - 3 <= r <= y + 0.5]
        found.setdefault(i, []).extend((draw(i, j), j is not None, j or "", j, k) for j in fits)
    return sorted((repr(i), repr(x[3]), x[4], r + 1) for i, rows in found.items() for r, x in enumerate(sorted(rows, key=lambda x: x[:3])[:n]))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_match_pool_by_blocks(spark, kind):
    """Draws of whole blocks against the pair by pair definition; no row of text is made for a pair."""
    rng = np.random.default_rng(4)
    key = int if kind == "long" else lambda i: f"{'é' * int(i % 40)}{i}"
    number = lambda: None if rng.random() < 0.02 else float(rng.integers(0, 48) / 4)
    word = lambda: [None, "a", "b", "c"][int(rng.choice(4, p=[0.02, 0.6, 0.3, 0.08]))]
    c = [(key(10 ** int(rng.integers(0, 12)) + i), word(), number()) for i in range(150)] + [(None, "a", 5.0)]
    j = [(key(10 ** int(rng.integers(0, 12)) + i), word(), number()) for i in range(400)] + [(None, "a", 5.0), (key(1), "c", 5.0)]
    left = spark.createDataFrame(c, f"candidate_id {kind}, keyword string, years double")
    right = spark.createDataFrame(j, f"job_id {kind}, keyword string, required double")
    got = M.match_pool(left, right, 3, "42")
    assert "md5(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((repr(r[0]), repr(r[1]), r[2], r[3]) for r in got.collect()) == brute_pool(c, j, 3, "42")
    assert M.match_pool(left.limit(0), right, 3, "42").count() == 0


def test_least_draws_over_tiles(spark, monkeypatch):
    """Small tiles find the same rows; equal draws at the edge all go on."""
    import pyarrow as pa

    from veriset.functions import draws as D

    left = pa.StructArray.from_arrays([pa.array([f"7|{i}" for i in range(30)]), pa.array([0.0] * 30), pa.array([9.0] * 30)], ["text", "low", "high"])
    right = pa.StructArray.from_arrays([pa.array([f"|{i % 40}" for i in range(90)]), pa.array([float(i % 12) for i in range(90)])], ["text", "value"])
    whole = list(zip(*D.least_draws(left, right, 2)))
    monkeypatch.setattr(D, "TILE", 16)
    some = list(zip(*D.least_draws(left, right, 2)))
    assert set(whole) <= set(some) and len(some) < 30 * 90
    for i in range(30):
        fits = sorted((D.draws([b"7|%d" % i], [b"|%d" % (k % 40)])[0, 0], k) for k in range(90) if k % 12 <= 9)
        assert sorted((h, b) for a, b, h in whole if a == i) == [x for x in fits if x[0] <= fits[1][0]]
