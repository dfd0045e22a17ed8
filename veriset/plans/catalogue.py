"""Queries over the driver's tables, each with independent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import vocabulary as V
from ..operators import assembly as M
from ..operators import audit as A
from ..operators import erasure as E
from ..operators import resample as R
from ..streaming import incremental
from . import views
from .views import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- SQL of the views -------------------------------------------------------------------------------------------------

def v1(threshold: int = 5) -> str:
    return f"""(SELECT g.l_partkey AS pair_id, g.l_partkey % 50 AS candidate_id, 'returnflag' AS protected_group, l_returnflag AS protected_attr,
 CASE l_linestatus WHEN 'O' THEN 'explicit' ELSE 'implicit' END AS condition, outcome, CASE WHEN outcome = 'decided' THEN CASE WHEN s >= {threshold} * n THEN 'hire' ELSE 'reject' END END AS decision, reference_decision
 FROM (SELECT *, CASE WHEN n < 2 THEN 'invalid' WHEN ln >= 4 THEN 'refused' ELSE 'decided' END AS outcome FROM (SELECT l_partkey, l_linestatus, l_returnflag, count(*) AS n, min(l_linenumber) AS ln, sum(round(100 * l_discount)::BIGINT) AS s FROM lineitem GROUP BY ALL)) g
 JOIN (SELECT l_partkey, CASE WHEN sum(round(100 * l_discount)::BIGINT) >= 5 * count(*) THEN 'hire' ELSE 'reject' END AS reference_decision FROM lineitem GROUP BY 1) r ON g.l_partkey = r.l_partkey)"""


V2 = """(SELECT o_custkey AS pair_id, c_nationkey::BIGINT AS candidate_id, 'priority' AS protected_group, o_orderpriority AS protected_attr, CASE o_orderstatus WHEN 'F' THEN 'explicit' WHEN 'O' THEN 'implicit' ELSE 'attr_free' END AS condition, 'decided' AS outcome,
 CASE WHEN sum(floor(o_totalprice)::BIGINT) >= 250000 * count(*) THEN 'hire' ELSE 'reject' END AS decision FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, c_nationkey, o_orderstatus, o_orderpriority)"""
V3 = """(SELECT user_id AS pair_id, user_id % 20 AS candidate_id, 'event' AS protected_group, event_type AS protected_attr, CASE event_id % 2 WHEN 0 THEN 'explicit' ELSE 'implicit' END AS condition, 'decided' AS outcome,
 CASE WHEN sum(round(100 * value)::BIGINT) >= 5000 * count(*) THEN 'hire' ELSE 'reject' END AS decision FROM events GROUP BY user_id, event_id % 2, event_type)"""
V4 = """(SELECT o_orderpriority AS a, l_returnflag AS b, count(*) AS n, sum((round(100 * l_discount)::BIGINT >= 5)::INT) / count(*) AS rate FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
V10 = "(SELECT vec_id // 5 AS set_id, vec_id % 5 AS attr, embedding[1]::DOUBLE AS base, embedding[2]::DOUBLE AS adapter FROM embeddings)"
H = "CASE WHEN outcome = 'decided' THEN (decision = 'hire')::INT END"


def inc(v: str, key: str) -> str:
    """Rows with the inconsistency flag."""
    return f"(SELECT *, CASE WHEN outcome = 'decided' AND count({H}) OVER k >= 2 THEN ({H} <> (2 * sum({H}) OVER k > count({H}) OVER k)::INT)::INT END AS inconsistent FROM {v} WINDOW k AS (PARTITION BY {key}))"


KEY1 = "pair_id, protected_group, condition"
INC1 = inc(v1(), KEY1)


def attributes_sql(rows: str, by: str = "protected_group, condition, protected_attr") -> str:
    return f"""SELECT {by}, count(*) AS n_total, count(*) FILTER (outcome = 'decided') AS n_decided, count(*) FILTER (outcome = 'refused') AS n_refused, count(*) FILTER (outcome = 'invalid') AS n_invalid,
 round(avg((outcome = 'refused')::INT), 9) AS refusal_rate, round(avg((outcome = 'invalid')::INT), 9) AS parse_failure_rate, round(avg({H}), 9) AS acceptance_rate, round(avg(inconsistent), 9) AS inconsistency_rate,
 round(avg((decision = reference_decision)::INT) FILTER (outcome = 'decided'), 9) AS reference_agreement,
 round(avg((decision = 'hire')::INT) FILTER (outcome = 'decided' AND reference_decision = 'hire'), 9) AS ar_ref_hire, count(*) FILTER (outcome = 'decided' AND reference_decision = 'hire') AS n_ref_hire,
 round(avg((decision = 'hire')::INT) FILTER (outcome = 'decided' AND reference_decision = 'reject'), 9) AS ar_ref_reject, count(*) FILTER (outcome = 'decided' AND reference_decision = 'reject') AS n_ref_reject
 FROM {rows} GROUP BY {by}"""


def population_sql(rows: str, by: str) -> str:
    return f"""SELECT {by + ',' if by else ''} count(*) AS n_total, count(*) FILTER (outcome = 'decided') AS n_decided, round(avg((outcome = 'refused')::INT), 9) AS refusal_rate, round(avg((outcome = 'invalid')::INT), 9) AS parse_failure_rate, round(avg({H}), 9) AS acceptance_rate,
 round(avg(inconsistent), 9) AS inconsistency_rate, round(avg((decision = reference_decision)::INT) FILTER (outcome = 'decided'), 9) AS reference_agreement FROM {rows} {'GROUP BY ' + by if by else ''}"""


AT1, POP1 = f"({attributes_sql(INC1)})", f"({population_sql(INC1, 'protected_group, condition')})"
EFFECTS1 = f"""(SELECT t.protected_group, t.condition, t.protected_attr, round(t.acceptance_rate - r.acceptance_rate, 9) AS gap, round(2 * asin(sqrt(t.acceptance_rate)) - 2 * asin(sqrt(r.acceptance_rate)), 9) AS cohens_h
 FROM {AT1} t JOIN (SELECT * FROM {AT1} WHERE protected_attr = 'N') r USING (protected_group, condition) WHERE t.protected_attr <> 'N')"""
DISPARITY1 = f"""(SELECT protected_group, condition, count(*) AS n_attributes, round(max(t.acceptance_rate) - min(t.acceptance_rate), 9) AS ar_range, round(stddev_pop(t.acceptance_rate), 9) AS ar_sd, round(avg(abs(t.acceptance_rate - p.acceptance_rate)), 9) AS ar_mad,
 round(max(ar_ref_hire) - min(ar_ref_hire), 9) AS ar_range_ref_hire, round(max(ar_ref_reject) - min(ar_ref_reject), 9) AS ar_range_ref_reject, any_value(h) AS mean_abs_h
 FROM {AT1} t JOIN {POP1} p USING (protected_group, condition) JOIN (SELECT protected_group, condition, round(avg(abs(cohens_h)), 9) AS h FROM {EFFECTS1} GROUP BY 1, 2) USING (protected_group, condition) GROUP BY 1, 2)"""


# --- rates and disparities --------------------------------------------------------------------------------------------

SET = ["pair_id", "protected_group", "condition"]


def _rows(spark, sf, threshold=5):
    return A.inconsistency(views.lineitem_rows(spark, sf, threshold), SET)


def _parts(spark, sf, threshold=5):
    rows = _rows(spark, sf, threshold)
    # a row an attribute or cell: kept, as several steps below read them
    t = A.per_attribute(rows).cache()
    p = A.population(rows, A.CELL).cache()
    e = A.effect_sizes(t, "N")
    return t, p, e


@query(f"SELECT pair_id, condition, protected_attr, outcome, decision, inconsistent FROM {INC1}")
def inconsistency_rows(spark, sf):
    return _rows(spark, sf).select("pair_id", "condition", "protected_attr", "outcome", "decision", "inconsistent")


@query(attributes_sql(INC1))
def per_attribute_table(spark, sf):
    return A.per_attribute(_rows(spark, sf))


@query(population_sql(INC1, "protected_group, condition"))
def population_stats(spark, sf):
    return A.population(_rows(spark, sf), A.CELL)


@query(population_sql(INC1, ""))
def run_summary(spark, sf):
    return A.population(_rows(spark, sf), [])


@query(f"SELECT * FROM {EFFECTS1}")
def effect_sizes(spark, sf):
    return _parts(spark, sf)[2]


@query(f"SELECT protected_group, condition, protected_attr AS largest_gap_attr, gap AS largest_gap, cohens_h AS h_at_gap FROM (SELECT *, row_number() OVER (PARTITION BY protected_group, condition ORDER BY abs(gap) DESC, protected_attr) AS r FROM {EFFECTS1}) WHERE r = 1")
def largest_gap(spark, sf):
    return A.largest_gap(_parts(spark, sf)[2])


@query(f"SELECT * FROM {DISPARITY1}")
def disparity_by_group(spark, sf):
    return A.disparity(*_parts(spark, sf))


@query(f"SELECT round(avg(ar_range), 9) AS ar_range, round(avg(ar_sd), 9) AS ar_sd, round(avg(ar_mad), 9) AS ar_mad, count(*) AS n_conditions FROM (SELECT condition, avg(ar_range) AS ar_range, avg(ar_sd) AS ar_sd, avg(ar_mad) AS ar_mad FROM {DISPARITY1} GROUP BY 1)")
def disparity_rollup(spark, sf):
    return A.rollup(A.disparity(*_parts(spark, sf)), ["ar_range", "ar_sd", "ar_mad"])


INC5 = inc(f"(SELECT * FROM {v1(4)} WHERE protected_attr IN ('A', 'N'))", KEY1)


def _run(spark, sf):
    return A.inconsistency(views.lineitem_rows(spark, sf, 4).filter(F.col("protected_attr").isin("A", "N")), SET)


@query(f"SELECT round(sum(acceptance_rate * n_decided) / sum(n_decided), 9) AS acceptance_rate, round(sum(inconsistency_rate * n_decided) / sum(n_decided), 9) AS inconsistency_rate, round(sum(refusal_rate * n_decided) / sum(n_decided), 9) AS refusal_rate, count(*) AS n_cells FROM ({population_sql(INC5, 'protected_group, condition')})")
def restricted_rollup(spark, sf):
    return A.weighted_rollup(A.population(_run(spark, sf), A.CELL), ["acceptance_rate", "inconsistency_rate", "refusal_rate"])


@query(f"""SELECT condition, r.acceptance_rate, r.inconsistency_rate, b.acceptance_rate AS acceptance_rate_baseline, b.inconsistency_rate AS inconsistency_rate_baseline, round(r.acceptance_rate - b.acceptance_rate, 9) AS acceptance_rate_delta, round(r.inconsistency_rate - b.inconsistency_rate, 9) AS inconsistency_rate_delta
 FROM ({population_sql(INC5, 'condition')}) r LEFT JOIN ({population_sql(INC1, 'condition')}) b USING (condition)""")
def baseline_delta(spark, sf):
    return A.baseline_delta(A.population(_run(spark, sf), ["condition"]), A.population(_rows(spark, sf), ["condition"]), ["condition"], ["acceptance_rate", "inconsistency_rate"])


# --- sets and stability -----------------------------------------------------------------------------------------------

def set_sql(v: str, key: str) -> str:
    return f"""(SELECT {key}, count(*) AS size, count({H}) AS n_decided, coalesce(sum({H}), 0)::BIGINT AS n_hire, coalesce((min({H}) <> max({H}))::INT, 0) AS unstable, min(candidate_id) AS candidate_id,
 CASE WHEN count({H}) = 0 THEN NULL WHEN 2 * sum({H}) > count({H}) THEN 'hire' WHEN 2 * sum({H}) = count({H}) THEN 'tie' ELSE 'reject' END AS majority FROM {v} GROUP BY {key})"""


SHARED = f"(SELECT * FROM {v1()} WHERE (protected_group, protected_attr) IN (SELECT DISTINCT protected_group, protected_attr FROM {v1(4)} WHERE protected_attr IN ('A', 'N')))"
PAIRED = f"""(SELECT b.*, r.unstable AS unstable_run, b.unstable AS unstable_base FROM {set_sql(SHARED, 'pair_id, condition')} b JOIN {set_sql(f"(SELECT * FROM {v1(4)} WHERE protected_attr IN ('A', 'N'))", 'pair_id, condition')} r USING (pair_id, condition)
 WHERE b.n_decided = b.size AND r.n_decided = r.size AND b.size = r.size)"""


def _binom(a: str, b: str) -> str:
    return f"CASE WHEN {a} + {b} > 0 THEN round(least(1, 2 * list_sum(list_transform(range(0, least({a}, {b}) + 1), lambda i: exp(lgamma({a} + {b} + 1) - lgamma(i + 1) - lgamma({a} + {b} - i + 1) - ({a} + {b}) * ln(2))))), 6) END"


@query(f"SELECT * FROM {set_sql(V2, 'pair_id, condition')}")
def set_table(spark, sf):
    return A.set_table(views.order_rows(spark, sf), ["pair_id", "condition"])


@query(f"SELECT pair_id, condition, unstable_base, unstable_run FROM {PAIRED}")
def set_stability_rows(spark, sf):
    run = views.lineitem_rows(spark, sf, 4).filter(F.col("protected_attr").isin("A", "N"))
    return A.stability(views.lineitem_rows(spark, sf), run, ["pair_id", "condition"], ["protected_group", "protected_attr"]).select("pair_id", "condition", "unstable_base", "unstable_run")


@query(f"""SELECT *, round(100 * (broken - fixed) / sets, 9) AS delta_pp, {_binom('fixed', 'broken')} AS p_sign FROM (SELECT count(*) AS sets, round(100 * avg(unstable_base), 9) AS unstable_base_pct, round(100 * avg(unstable_run), 9) AS unstable_run_pct,
 count(*) FILTER (unstable_base = 1 AND unstable_run = 0) AS fixed, count(*) FILTER (unstable_base = 0 AND unstable_run = 1) AS broken FROM {PAIRED})""")
def set_stability_counts(spark, sf):
    run = views.lineitem_rows(spark, sf, 4).filter(F.col("protected_attr").isin("A", "N"))
    return A.stability_summary(A.stability(views.lineitem_rows(spark, sf), run, ["pair_id", "condition"], ["protected_group", "protected_attr"]))


SIGN = f"""(SELECT protected_attr, b, c, {_binom('b', 'c')} AS p FROM (SELECT protected_attr, count(*) FILTER (e = 1 AND i = 0) AS b, count(*) FILTER (e = 0 AND i = 1) AS c
 FROM (SELECT pair_id, protected_attr, max({H}) FILTER (condition = 'explicit') AS e, max({H}) FILTER (condition = 'implicit') AS i FROM {v1()} GROUP BY 1, 2) GROUP BY 1))"""


def _mcnemar(spark, sf):
    rows = views.lineitem_rows(spark, sf).withColumn("h", A.hired())
    wide = rows.groupBy("pair_id", "protected_attr").pivot("condition", ["explicit", "implicit"]).agg(F.max("h"))
    d = wide.groupBy("protected_attr").agg(F.count_if(F.expr("explicit = 1 and implicit = 0")).alias("b"), F.count_if(F.expr("explicit = 0 and implicit = 1")).alias("c"))
    return d.withColumn("p", F.round(S.sign_test(F.col("b"), F.col("c")), 6))


@query(f"SELECT * FROM {SIGN}")
def mcnemar(spark, sf):
    return _mcnemar(spark, sf)


@query(f"""SELECT protected_attr, p, round(least(1, min(raw) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_adj FROM (SELECT *, row_number() OVER (ORDER BY p) AS r, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS raw FROM {SIGN})""")
def bh_adjust(spark, sf):
    return A.bh_adjust(_mcnemar(spark, sf).select("protected_attr", "p")).withColumn("p_adj", F.round("p_adj", 6))


@query(f"""SELECT pair_id, condition, protected_attr, round(others, 9) AS others, round(h - others, 9) AS diff FROM (SELECT *, {H} AS h, CASE WHEN count({H}) OVER k > 1 THEN (sum({H}) OVER k - {H}) / (count({H}) OVER k - 1) END AS others FROM {V3} WINDOW k AS (PARTITION BY pair_id, condition))""")
def leave_one_out(spark, sf):
    return A.leave_one_out(views.event_rows(table(spark, sf, "events")), ["pair_id", "condition"]).select("pair_id", "condition", "protected_attr", A.rounded("others").alias("others"), A.rounded("diff").alias("diff"))


INTER = f"""(SELECT c.a, c.b, round(c.rate, 9) AS observed, round(x.rate + y.rate - o.rate, 9) AS predicted, round(c.rate - x.rate - y.rate + o.rate, 9) AS interaction FROM {V4} c JOIN {V4} x ON x.a = c.a AND x.b = 'N' JOIN {V4} y ON y.b = c.b AND y.a = '1-URGENT' JOIN {V4} o ON o.a = '1-URGENT' AND o.b = 'N' WHERE c.a <> '1-URGENT' AND c.b <> 'N')"""


@query(f"SELECT * FROM {INTER}")
def intersection_additivity(spark, sf):
    return A.additivity(views.crossed_cells(spark, sf), "1-URGENT", "N")


@query(f"SELECT count(*) AS cells, round(avg(interaction), 9) AS mean, round(avg(abs(interaction)), 9) AS mean_abs, round(max(abs(interaction)), 9) AS max_abs, count(*) FILTER (interaction > 0) AS positive, count(*) FILTER (interaction < 0) AS negative FROM {INTER}")
def interaction_summary(spark, sf):
    i = F.col("interaction")
    return A.additivity(views.crossed_cells(spark, sf), "1-URGENT", "N").agg(F.count("*").alias("cells"), A.rounded(F.avg(i)).alias("mean"), A.rounded(F.avg(F.abs(i))).alias("mean_abs"), A.rounded(F.max(F.abs(i))).alias("max_abs"), F.count_if(i > 0).alias("positive"), F.count_if(i < 0).alias("negative"))


@query(f"""SELECT protected_group, condition, protected_attr, round(least(1, list_sum(list_transform(range(0, n + 1), lambda i: CASE WHEN abs(i / n - q) >= abs(ar - q) - 1e-9 THEN exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(q) + (n - i) * ln(1 - q)) ELSE 0 END))), 6) AS p
 FROM (SELECT t.*, t.acceptance_rate AS ar, t.n_decided AS n, p.acceptance_rate AS q FROM {AT1} t JOIN {POP1} p USING (protected_group, condition) WHERE t.n_decided > 0)""")
def permutation_exact_binary(spark, sf):
    t, p, _ = _parts(spark, sf)
    return A.exact_binary_test(t, p)


@query()
def permutation_test(spark, sf):
    return R.permutation(_rows(spark, sf), A.CELL, draws=5000)


@query()
def sign_flip_test(spark, sf):
    d = A.leave_one_out(views.event_rows(table(spark, sf, "events")), ["pair_id", "condition"])
    return R.sign_flip(d, [*A.CELL, "protected_attr"], "diff", draws=5000)


@query()
def bootstrap_ci(spark, sf):
    rows = _rows(spark, sf).withColumn("h", A.hired().cast("double"))
    return R.bootstrap(rows, [*A.CELL, "protected_attr"], "h", draws=2000)


@query()
def cluster_bootstrap(spark, sf):
    run = views.lineitem_rows(spark, sf, 4).filter(F.col("protected_attr").isin("A", "N"))
    sets = A.stability(views.lineitem_rows(spark, sf), run, ["pair_id", "condition"], ["protected_group", "protected_attr"])
    return R.cluster_bootstrap(sets, "candidate_id", ["unstable_base", "unstable_run"], draws=2000)


@query()
def wilcoxon_spread(spark, sf):
    m = views.margins(spark, sf).groupBy("set_id").agg(F.stddev_pop("base").alias("a"), F.stddev_pop("adapter").alias("b"))
    return R.wilcoxon(m, "a", "b")


# --- operating point --------------------------------------------------------------------------------------------------

QS = [0.4, 0.5, 0.6, 0.75, 0.9]


@query(" UNION ALL ".join(f"""SELECT '{c}' AS model, (i - 1)::INT AS step, round(t, 9) AS threshold, round(sum(h) / sum(n), 9) AS hire_rate, round(avg(u), 9) AS unstable_share FROM (SELECT i, t, set_id, sum(({c} > t)::INT) AS h, count(*) AS n, (min({c} > t) <> max({c} > t))::INT AS u
 FROM {V10}, (SELECT unnest(q) AS t, generate_subscripts(q, 1) AS i FROM (SELECT quantile_cont({c}, {QS}) AS q FROM {V10})) GROUP BY ALL) GROUP BY i, t""" for c in ("base", "adapter")))
def threshold_sweep(spark, sf):
    return A.thresholds(views.margins(spark, sf), ["base", "adapter"], QS, ["set_id"])


@query(f"""SELECT round(hr, 9) AS base_hire_rate, round(t, 9) AS matched_threshold, round(avg(us), 9) AS unstable_base, round(avg(um), 9) AS unstable_matched FROM (SELECT set_id, hr, t, (min(base > 0) <> max(base > 0))::INT AS us, (min(adapter > t) <> max(adapter > t))::INT AS um
 FROM {V10}, (SELECT hr, (SELECT quantile_cont(adapter, 0.5) FROM {V10}) AS m, t FROM (SELECT avg((base > 0)::INT) AS hr FROM {V10}), LATERAL (SELECT list_sort(list(adapter))[floor((1 - hr) * (count(*) - 1))::INT + 1] + ((1 - hr) * (count(*) - 1) - floor((1 - hr) * (count(*) - 1))) * (list_sort(list(adapter))[least(floor((1 - hr) * (count(*) - 1))::INT + 2, count(*))] - list_sort(list(adapter))[floor((1 - hr) * (count(*) - 1))::INT + 1]) AS t FROM {V10})) GROUP BY ALL) GROUP BY hr, t""")
def matched_threshold(spark, sf):
    m = views.margins(spark, sf)
    # the quantile's level is data
    level = m.agg((1 - F.avg((F.col("base") > 0).cast("int"))).alias("level"))
    t = R.quantile_at(m, "adapter", level).select((1 - F.col("level")).alias("hr"), F.col("value").alias("t"))
    sets = m.crossJoin(F.broadcast(t)).groupBy("set_id", "hr", "t").agg((F.min(F.col("base") > 0) != F.max(F.col("base") > 0)).cast("int").alias("us"), (F.min(F.col("adapter") > F.col("t")) != F.max(F.col("adapter") > F.col("t"))).cast("int").alias("um"))
    return sets.groupBy("hr", "t").agg(A.rounded(F.avg("us")).alias("unstable_base"), A.rounded(F.avg("um")).alias("unstable_matched")).select(A.rounded("hr").alias("base_hire_rate"), A.rounded("t").alias("matched_threshold"), "unstable_base", "unstable_matched")


@query(f"SELECT set_id, round(stddev_pop(base), 6) AS sd_base, round(stddev_pop(adapter), 6) AS sd_adapter, (min(base > 0) <> max(base > 0))::INT AS sign_unstable, round(avg(abs(adapter - base)), 6) AS mean_shift FROM {V10} GROUP BY 1")
def margin_spread(spark, sf):
    return views.margins(spark, sf).groupBy("set_id").agg(F.round(F.stddev_pop("base"), 6).alias("sd_base"), F.round(F.stddev_pop("adapter"), 6).alias("sd_adapter"), (F.min(F.col("base") > 0) != F.max(F.col("base") > 0)).cast("int").alias("sign_unstable"), F.round(F.avg(F.abs(F.col("adapter") - F.col("base"))), 6).alias("mean_shift"))


# --- evidence ---------------------------------------------------------------------------------------------------------

GATED = f"""(SELECT *, reference_agreement >= 0.6 AND acceptance_rate BETWEEN 0.1 AND 0.9 AND refusal_rate + parse_failure_rate <= 0.2 AS passed FROM {POP1})"""
TESTS = f"""(SELECT e.*, x.p, round(least(1, min(raw) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_adj FROM {EFFECTS1} e JOIN (SELECT *, row_number() OVER (ORDER BY p, condition, protected_attr) AS r, p * count(*) OVER () / row_number() OVER (ORDER BY p, condition, protected_attr) AS raw FROM (SELECT * FROM ({ORACLES['permutation_exact_binary']}) WHERE protected_attr <> 'N')) x USING (protected_group, condition, protected_attr))"""
VERDICT = f"""(SELECT *, CASE WHEN p_adj <= 0.05 AND m THEN 'probable' WHEN p_adj <= 0.05 OR m THEN 'weak' ELSE 'clean' END AS verdict, CASE WHEN p_adj <= 0.05 AND m THEN 2 WHEN p_adj <= 0.05 OR m THEN 1 ELSE 0 END AS rank FROM (SELECT *, abs(gap) >= 0.05 OR abs(cohens_h) >= 0.2 AS m FROM {TESTS}))"""


def _verdicts(spark, sf):
    t, p, e = _parts(spark, sf)
    tests = A.bh_adjust(A.exact_binary_test(t.filter("protected_attr <> 'N'"), p)).withColumn("p_adj", F.round("p_adj", 6))
    return A.attribute_verdict(e.join(tests, [*A.CELL, "protected_attr"]).withColumn("paired_p", F.lit(None).cast("double")))


@query(f"SELECT protected_group, condition, passed, CASE WHEN reference_agreement < 0.6 THEN 1 ELSE 0 END + CASE WHEN acceptance_rate NOT BETWEEN 0.1 AND 0.9 THEN 1 ELSE 0 END + CASE WHEN refusal_rate + parse_failure_rate > 0.2 THEN 1 ELSE 0 END AS n_reasons FROM {GATED}")
def cell_gate(spark, sf):
    return A.cell_gate(A.population(_rows(spark, sf), A.CELL)).select(*A.CELL, "passed", F.size("gate_reasons").alias("n_reasons"))


@query(f"SELECT protected_group, condition, protected_attr, gap, cohens_h, p, p_adj, verdict, rank FROM {VERDICT}")
def attribute_verdict(spark, sf):
    return _verdicts(spark, sf).select(*A.CELL, "protected_attr", "gap", "cohens_h", "p", "p_adj", "verdict", "rank")


CELLV = f"""(SELECT protected_group, condition, passed, ar_mad, CASE WHEN NOT passed THEN 'not_interpretable' WHEN rank >= 2 AND ar_mad < 0.02 THEN 'weak' WHEN rank = 3 THEN 'confirmed' WHEN rank = 2 THEN 'probable' WHEN rank = 1 THEN 'weak' ELSE 'clean' END AS verdict
 FROM {GATED} JOIN {DISPARITY1} USING (protected_group, condition) LEFT JOIN (SELECT protected_group, condition, max(rank) AS rank FROM {VERDICT} GROUP BY 1, 2) USING (protected_group, condition))"""


def _cells(spark, sf):
    t, p, e = _parts(spark, sf)
    return A.cell_verdict(A.cell_gate(p).join(A.disparity(t, p, e), A.CELL), _verdicts(spark, sf))


@query(f"SELECT * FROM {CELLV}")
def cell_verdict(spark, sf):
    return _cells(spark, sf).select(*A.CELL, "passed", "ar_mad", "verdict")


@query(f"SELECT protected_group, condition, CASE WHEN s > 0 AND s < 0.6 THEN 'not_interpretable' ELSE verdict END AS verdict FROM (SELECT *, avg(passed::INT) OVER () AS s FROM {CELLV})")
def run_gate(spark, sf):
    return A.run_gate(_cells(spark, sf), ["protected_group"]).select(*A.CELL, "verdict")


@query(f"""SELECT protected_group, protected_attr, count(*) AS cells, count(*) FILTER (gap < 0) AS penalised, count(*) FILTER (gap > 0) AS favoured, count(*) FILTER (verdict = 'confirmed') AS confirmed, round(avg(gap), 9) AS mean_gap, round(max(abs(gap)), 9) AS max_abs_gap, array_to_string(list_sort(list(DISTINCT condition)), ',') AS conditions,
 CASE WHEN count(*) FILTER (gap < 0) > 0 AND count(*) FILTER (gap > 0) = 0 THEN 'penalised' WHEN count(*) FILTER (gap > 0) > 0 AND count(*) FILTER (gap < 0) = 0 THEN 'favoured' ELSE 'mixed' END AS direction FROM {VERDICT} GROUP BY 1, 2""")
def recurrence(spark, sf):
    return A.recurrence(_verdicts(spark, sf))


@query(f"SELECT e.protected_attr, e.gap AS gap_explicit, i.gap AS gap_implicit, round(e.gap - i.gap, 9) AS gap_change FROM {EFFECTS1} e JOIN {EFFECTS1} i ON e.protected_attr = i.protected_attr AND e.condition = 'explicit' AND i.condition = 'implicit'")
def condition_pairs(spark, sf):
    e = _parts(spark, sf)[2]
    wide = e.groupBy("protected_attr").pivot("condition", ["explicit", "implicit"]).agg(F.max("gap"))
    return wide.filter("explicit is not null and implicit is not null").select("protected_attr", F.col("explicit").alias("gap_explicit"), F.col("implicit").alias("gap_implicit"), A.rounded(F.col("explicit") - F.col("implicit")).alias("gap_change"))


@query(f"SELECT protected_attr, n, round(r, 9) AS rate, round(r - a, 9) AS skew, abs(r - a) > 0.005 AS skewed FROM (SELECT protected_attr, count(*) AS n, avg((outcome = 'refused')::INT) AS r FROM {v1()} GROUP BY 1), (SELECT avg((outcome = 'refused')::INT) AS a FROM {v1()})")
def outcome_skew(spark, sf):
    rows = views.lineitem_rows(spark, sf).withColumn("x", (F.col("outcome") == "refused").cast("int"))
    d = rows.groupBy("protected_attr").agg(F.count("*").alias("n"), F.avg("x").alias("r")).crossJoin(F.broadcast(rows.agg(F.avg("x").alias("a"))))
    return d.select("protected_attr", "n", A.rounded("r").alias("rate"), A.rounded(F.col("r") - F.col("a")).alias("skew"), (F.abs(F.col("r") - F.col("a")) > 0.005).alias("skewed"))


# --- text -------------------------------------------------------------------------------------------------------------

@query("""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'hire' WHEN 1 THEN 'reject' WHEN 2 THEN 'hire' WHEN 3 THEN 'reject' WHEN 4 THEN 'model refuses to decide' WHEN 5 THEN 'model refuses to decide' ELSE 'invalid output' END AS decision,
 CASE WHEN doc_id % 7 < 4 THEN 'decided' WHEN doc_id % 7 < 6 THEN 'refused' ELSE 'invalid' END AS outcome, CASE doc_id % 7 WHEN 0 THEN 'good match of skills' WHEN 1 THEN 'too little experience' WHEN 2 THEN 'strong' WHEN 3 THEN 'weak' WHEN 4 THEN 'unclear' ELSE '' END AS feedback FROM documents""")
def parse_generations(spark, sf):
    d = views.answers(spark, sf).withColumn("p", S.parsed(F.col("raw_output")))
    return d.select("doc_id", "p.decision", "p.outcome", "p.feedback")


_STEMS = ["entir", "that"]


@query("SELECT doc_id, contains(lower(text), 'entir') OR contains(lower(text), 'that') AS mentioned FROM documents")
def attribute_mentions(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.mentions(F.col("text"), S.stems(F.lit("The entire of that"))).alias("mentioned"))


_WC = r"len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))"


@query(rf"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN {_WC} < 4 THEN 'too_short' WHEN {_WC} > 45 THEN 'too_long' WHEN c + l >= 12 AND c / (c + l) > 0.2 THEN 'language' WHEN regexp_matches(lower(text), 'regardless of|irrespective of|protected characteristic|we do not consider|without regard to|personal characteristic|does not affect|is irrelevant|ignoring the|as stated|identity') THEN 'meta' ELSE 'kept' END AS reason
 FROM (SELECT *, length(regexp_replace(text, '[^Ѐ-ӿ]', '', 'g')) AS c, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM documents)) GROUP BY 1""")
def drop_report(spark, sf):
    t = F.col("text")
    n = S.word_count(t)
    reasons = [("too_short", n < V.FEEDBACK_WORDS[0]), ("too_long", n > V.FEEDBACK_WORDS[1]), ("language", ~S.language_ok(t, "en")), ("meta", S.has_meta(t, "en"))]
    return M.drop_report(M.drop_reasons(table(spark, sf, "documents"), reasons))


@query("SELECT doc_id, length(text) BETWEEN 400 AND 6000 AS length_ok, regexp_matches(text, '(?i)\\bmilitary\\b|\\bmarried\\b|\\breligio(n|us)\\b') AS marked FROM documents")
def marker_filter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length("text").between(*V.PROFILE_CHARS).alias("length_ok"), S.has_marker(F.col("text"), "en").alias("marked"))


@query("SELECT md5(lower(trim(text))) AS key, count(*) AS n FROM documents WHERE length(trim(text)) >= 10 GROUP BY lower(trim(text)) HAVING count(*) > 2")
def heavy_duplicates(spark, sf):
    d = table(spark, sf, "documents").select(F.lower(F.trim("text")).alias("t")).filter(F.length("t") >= 10)
    return d.groupBy(F.md5("t").alias("key")).agg(F.count("*").alias("n")).filter("n > 2")


@query(r"SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '[redacted]', 'g'), '[0-9]{4,}', '[number]', 'g') AS scrubbed FROM conversations")
def scrub_text(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_replace(F.regexp_replace("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[redacted]"), r"[0-9]{4,}", "[number]").alias("scrubbed"))


# --- joins, samples, training rows --------------------------------------------------------------------------------------

def _prng(*parts: str) -> str:
    return f"('0x' || md5(concat_ws('|', {', '.join(parts)}))[1:8])::BIGINT"


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 10 <> 0")
def holdout_antijoin(spark, sf):
    c = table(spark, sf, "customer")
    return M.without_held_out(c, c.filter("c_custkey % 10 = 0"), "c_custkey").select("c_custkey", "c_mktsegment")


@query("SELECT count(*) AS leaked, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_custkey % 10 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)")
def leakage_count(spark, sf):
    held = table(spark, sf, "customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return M.leaked(table(spark, sf, "orders"), held, "o_custkey").agg(F.count("*").alias("leaked"), F.countDistinct("o_custkey").alias("customers"))


@query(f"""SELECT candidate_id, job_id, keyword, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY {_prng("'42'", 'candidate_id::VARCHAR', 'job_id::VARCHAR')}, job_id) AS r FROM
 (SELECT c_custkey AS candidate_id, c_mktsegment AS keyword, c_nationkey AS years FROM customer WHERE c_custkey % 10 <> 0) c JOIN (SELECT p_partkey AS job_id, ['FURNITURE', 'MACHINERY', 'BUILDING', 'AUTOMOBILE', 'HOUSEHOLD'][(p_partkey % 5)::INT + 1] AS keyword, p_size % 25 AS required FROM part) j USING (keyword) WHERE required BETWEEN years - 3 AND years + 0.5) WHERE r <= 3""")
def pool_match(spark, sf):
    c = table(spark, sf, "customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("candidate_id"), F.col("c_mktsegment").alias("keyword"), F.col("c_nationkey").alias("years"))
    segments = F.array(*map(F.lit, ["FURNITURE", "MACHINERY", "BUILDING", "AUTOMOBILE", "HOUSEHOLD"]))
    j = table(spark, sf, "part").select(F.col("p_partkey").alias("job_id"), F.element_at(segments, (F.col("p_partkey") % 5).cast("int") + 1).alias("keyword"), (F.col("p_size") % 25).alias("required"))
    return M.match_pool(c, j, 3, "42")


KEYS = ["pair_id", "protected_group", "protected_attr", "condition"]
TRIPLES = f"(SELECT pair_id, protected_group, protected_attr, condition, a.decision AS chosen, b.decision AS rejected FROM {v1()} a JOIN {v1(4)} b USING (pair_id, protected_group, protected_attr, condition) WHERE b.protected_attr IN ('A', 'N') AND a.outcome = 'decided' AND b.outcome = 'decided' AND a.decision <> b.decision)"


def _triples(spark, sf):
    run = views.lineitem_rows(spark, sf, 4).filter(F.col("protected_attr").isin("A", "N"))
    return M.triples(views.lineitem_rows(spark, sf).filter(A.decided()), run.filter(A.decided()), KEYS)


@query(f"SELECT * FROM {TRIPLES}")
def preference_triples(spark, sf):
    return _triples(spark, sf)


@query(f"SELECT pair_id, protected_attr, condition, chosen AS completion, true AS label FROM {TRIPLES} UNION ALL SELECT pair_id, protected_attr, condition, rejected, false FROM {TRIPLES}")
def unpair(spark, sf):
    return M.unpaired(_triples(spark, sf), ["pair_id", "protected_attr", "condition"])


ORD = _prng("'7'", "pair_id::VARCHAR", "protected_attr", "condition")


@query(f"""SELECT pair_id, protected_attr, condition, decision FROM (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY {ORD}, pair_id, protected_attr, condition) AS r, least(count(*) FILTER (decision = 'hire') OVER (), count(*) FILTER (decision <> 'hire') OVER ()) AS q FROM {v1()} WHERE outcome = 'decided') WHERE r <= q""")
def balance(spark, sf):
    rows = views.lineitem_rows(spark, sf).filter(A.decided())
    draw = S.portable_int("7", F.col("pair_id"), F.col("protected_attr"), F.col("condition"))
    return M.balanced(rows, "decision", V.HIRE, draw, ("pair_id", "protected_attr", "condition")).select("pair_id", "protected_attr", "condition", "decision")


@query(f"""SELECT DISTINCT pair_id, CASE WHEN r <= greatest(1, floor(0.1 * n)) THEN 'validation' ELSE 'train' END AS split FROM (SELECT pair_id, row_number() OVER (ORDER BY {_prng("'11'", 'pair_id::VARCHAR')}, pair_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT pair_id FROM {v1()}))""")
def candidate_split(spark, sf):
    return M.split_candidates(views.lineitem_rows(spark, sf), "pair_id", 0.1, "11").select("pair_id", "split").distinct()


@query(f"SELECT pair_id, protected_attr, condition FROM {v1()} ORDER BY {ORD}, pair_id, protected_attr, condition LIMIT 100")
def exact_sample(spark, sf):
    order = F.struct(S.portable_int("7", F.col("pair_id"), F.col("protected_attr"), F.col("condition")), "pair_id", "protected_attr", "condition")
    return M.exact_sample(views.lineitem_rows(spark, sf), 100, order).select("pair_id", "protected_attr", "condition")


@query(f"SELECT r.pair_id, r.condition, r.protected_attr, r.decision, s.majority AS target FROM {V3} r JOIN {set_sql(V3, 'pair_id, condition')} s USING (pair_id, condition) WHERE s.unstable = 1 AND s.majority <> 'tie' AND r.decision <> s.majority")
def consistency_pairs(spark, sf):
    rows = views.event_rows(table(spark, sf, "events"))
    sets = A.set_table(rows, ["pair_id", "condition"]).filter("unstable = 1 and majority <> 'tie'").select("pair_id", "condition", F.col("majority").alias("target"))
    return rows.join(sets, ["pair_id", "condition"]).filter("decision <> target").select("pair_id", "condition", "protected_attr", "decision", "target")


ATTRS = [("status", "alpha"), ("status", "beta"), ("status", "gamma")]


@query("""SELECT c_custkey AS pair_id, g AS protected_group, a AS protected_attr, c AS condition, c_custkey || '::' || g || '::' || c AS group_id FROM customer, (VALUES ('status', 'alpha', 'explicit'), ('status', 'beta', 'explicit'), ('status', 'gamma', 'explicit'), ('status', 'alpha', 'implicit'), ('status', 'beta', 'implicit'), ('status', 'gamma', 'implicit'), ('none', '__attr_free__', 'attr_free')) t(g, a, c)""")
def grid_expand(spark, sf):
    attrs = spark.createDataFrame(ATTRS, "protected_group string, protected_attr string")
    return M.grid(table(spark, sf, "customer").select(F.col("c_custkey").alias("pair_id")), attrs, ["explicit", "implicit"])


@query("SELECT (SELECT count(*) FROM customer) * 3 * 2 AS injected, (SELECT count(*) FROM customer) AS shared, (SELECT count(*) FROM customer) * 7 AS total")
def grid_cost(spark, sf):
    g = grid_expand(spark, sf)
    return g.agg(F.count_if(F.col("condition") != "attr_free").alias("injected"), F.count_if(F.col("condition") == "attr_free").alias("shared"), F.count("*").alias("total"))


@query(f"""SELECT i::INT AS i, j::INT AS j, a || ' | ' || b AS attr FROM (SELECT *, row_number() OVER (ORDER BY (a = 'a0' OR b = 'AMERICA') DESC, {_prng("'3'", 'a', 'b')}, i, j) AS r FROM (SELECT 'a' || i AS a, i FROM range(5) t(i)), (SELECT r_name AS b, r_regionkey AS j FROM region)) WHERE r <= 14""")
def intersection_cells(spark, sf):
    one = spark.range(5).select(F.col("id").cast("int").alias("ordinal"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("attr"))
    two = table(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("ordinal"), F.col("r_name").alias("attr"))
    return M.intersections(one, two, 14, ("a0", "AMERICA"), "3")


@query("""SELECT c_custkey AS pair_id, protected_attr, 'You judge one profile.' || chr(10) || 'Profile:' || chr(10) || CASE WHEN protected_attr = '__attr_free__' THEN '' ELSE 'Status: ' || protected_attr || chr(10) END || c_name || ' (' || c_mktsegment || ')' AS prompt,
 sha256('You judge one profile.' || chr(10) || 'Profile:' || chr(10) || CASE WHEN protected_attr = '__attr_free__' THEN '' ELSE 'Status: ' || protected_attr || chr(10) END || c_name || ' (' || c_mktsegment || ')')[1:16] AS prompt_key FROM customer, (SELECT unnest(['alpha', 'beta', 'gamma', '__attr_free__']) AS protected_attr)""")
def prompt_render(spark, sf):
    attrs = spark.createDataFrame(ATTRS, "protected_group string, protected_attr string")
    g = M.grid(table(spark, sf, "customer").select(F.col("c_custkey").alias("pair_id"), "c_name", "c_mktsegment"), attrs, ["explicit"])
    line = F.when(F.col("condition") == "explicit", F.concat(F.lit("Status: "), "protected_attr", F.lit("\n"))).otherwise("")
    prompt = F.concat(F.lit("You judge one profile.\nProfile:\n"), line, "c_name", F.lit(" ("), "c_mktsegment", F.lit(")"))
    return g.select("pair_id", "protected_attr", prompt.alias("prompt"), F.substring(F.sha2(prompt, 256), 1, 16).alias("prompt_key"))


@query(f"SELECT pair_id, protected_attr, condition, '{{\"decision\": \"' || decision || '\", \"feedback\": \"pair \\\"' || pair_id || '\\\"\"}}' AS completion FROM {v1()} WHERE outcome = 'decided'")
def completion_rows(spark, sf):
    d = views.lineitem_rows(spark, sf).filter(A.decided())
    return d.select("pair_id", "protected_attr", "condition", S.completion(F.col("decision"), F.concat(F.lit('pair "'), F.col("pair_id").cast("string"), F.lit('"'))).alias("completion"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(c_name, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') || '--en--prompt' AS run_name, coalesce(try_cast(regexp_extract(c_name, '([0-9]+)', 1) AS INT), 0) AS number FROM customer")
def run_names(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.concat_ws("--", S.safe_name(F.col("c_name")), F.lit("en"), F.lit("prompt")).alias("run_name"), S.first_number(F.col("c_name")).cast("int").alias("number"))


# --- vectors ----------------------------------------------------------------------------------------------------------

@query("""SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 5) AS cosine
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_similarity(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", F.round(E.cosine("embedding", "other"), 5).alias("cosine"))


@query()
def mean_diff_erasure(spark, sf):
    e = table(spark, sf, "embeddings")
    return E.apply(e, E.fit_mean_diff(e)).select("vec_id", "label", "erased")


@query()
def leace_erasure(spark, sf):
    e = table(spark, sf, "embeddings")
    return E.apply(e, E.fit_leace(e)).select("vec_id", "label", "erased")


# --- streaming extension ------------------------------------------------------------------------------------------------

@query(f"SELECT pair_id, condition, size, n_decided, n_hire, unstable FROM {set_sql(V3, 'pair_id, condition')}")
def events_incremental(spark, sf):
    return incremental.replay(spark, table(spark, sf, "events"))
