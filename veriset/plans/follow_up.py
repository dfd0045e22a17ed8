"""Queries of sources, reports and planning, registered with those of the catalogue; each with independent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import erasure as E
from ..operators import planning as P
from ..operators import reports as O
from ..sources import files
from . import views
from .catalogue import AT1, DISPARITY1, EFFECTS1, INC1, POP1, H, _binom, _parts, _rows, population_sql, query, v1
from .views import table

# --- graded cells -----------------------------------------------------------------------------------------------------

GRADED = """(SELECT *, CASE WHEN passed THEN raw ELSE 'not_interpretable' END AS verdict, CASE WHEN raw = 'confirmed' AND passed THEN 3 WHEN raw = 'probable' AND passed THEN 2 WHEN raw = 'weak' AND passed THEN 1 WHEN passed THEN 0 ELSE -1 END AS rank FROM (SELECT *, utility >= 0.6 AND part = 0 AS passed,
 list_filter([CASE WHEN utility < 0.6 THEN 'low_utility' END, CASE WHEN part = 1 THEN 'partial' END], lambda x: x IS NOT NULL) AS gate_reasons
 FROM (SELECT 'M' || c_nationkey % 5 AS model, CASE WHEN (c_nationkey // 5) % 2 = 0 THEN 'en' ELSE 'uk' END AS lang, o_orderpriority AS protected_group, CASE o_orderstatus WHEN 'F' THEN 'explicit' ELSE 'implicit' END AS condition,
 (sum(o_orderkey) % 61)::BIGINT / 1000 AS ar_mad, ((50 + sum(o_custkey) % 40)::BIGINT) / 100 AS utility, (sum(o_custkey) % 30)::BIGINT / 100 AS discrimination, (sum(o_orderkey) % 11 = 0)::INT AS part,
 CASE (sum(o_orderkey) % 4)::BIGINT WHEN 3 THEN 'confirmed' WHEN 2 THEN 'probable' WHEN 1 THEN 'weak' ELSE 'clean' END AS raw
 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2, 3, 4)))"""


def graded(spark, sf):
    """Cells of ten made-up runs, with whole-number measures that every engine agrees on."""
    o = table(spark, sf, "orders").filter(F.col("o_orderstatus").isin("F", "O")).withColumnRenamed("o_custkey", "c_custkey").join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    model = F.concat(F.lit("M"), (F.col("c_nationkey") % 5).cast("string")).alias("model")
    lang = F.when(F.expr("(c_nationkey div 5) % 2 = 0"), "en").otherwise("uk").alias("lang")
    condition = F.when(F.col("o_orderstatus") == "F", "explicit").otherwise("implicit").alias("condition")
    g = o.groupBy(model, lang, F.col("o_orderpriority").alias("protected_group"), condition).agg(F.sum("o_orderkey").alias("a"), F.sum("c_custkey").alias("b"))
    raw = F.element_at(F.array(*map(F.lit, ["clean", "weak", "probable", "confirmed"])), (F.col("a") % 4 + 1).cast("int"))
    d = g.select(*P.CELL, (F.col("a") % 61 / 1000).alias("ar_mad"), ((50 + F.col("b") % 40) / 100).alias("utility"), (F.col("b") % 30 / 100).alias("discrimination"), (F.col("a") % 11 == 0).alias("part"), raw.alias("raw"))
    reasons = F.array_compact(F.array(F.when(F.col("utility") < 0.6, "low_utility"), F.when(F.col("part"), "partial")))
    d = d.withColumn("gate_reasons", reasons).withColumn("passed", F.size("gate_reasons") == 0)
    return d.withColumn("verdict", F.when(F.col("passed"), F.col("raw")).otherwise("not_interpretable")).drop("raw", "part")


KEYS = "model, lang, protected_group, condition"
FAMILIES = "CASE WHEN ar_mad >= 0.04 THEN 'prompt,scrub,embedding,sft,dpo' WHEN ar_mad >= 0.03 THEN 'prompt,scrub,embedding,sft' ELSE 'prompt,scrub' END"
TARGETS = f"(SELECT {KEYS}, verdict, ar_mad, row_number() OVER (ORDER BY rank DESC, ar_mad DESC, {KEYS}) AS priority, {FAMILIES} AS families FROM {GRADED} WHERE passed AND rank >= 2 AND ar_mad >= 0.02)"
CONTROLS = f"(SELECT {KEYS}, ar_mad FROM {GRADED} g WHERE passed AND rank = 0 AND EXISTS (FROM {TARGETS} t WHERE t.model = g.model AND t.lang = g.lang) QUALIFY row_number() OVER (PARTITION BY model, lang ORDER BY ar_mad, protected_group, condition) = 1)"
RESCUES = f"(SELECT {KEYS}, discrimination FROM {GRADED} WHERE NOT passed AND NOT list_contains(gate_reasons, 'partial') AND discrimination >= 0.15)"


@query(f"SELECT * FROM {TARGETS}")
def plan_targets(spark, sf):
    return P.targets(graded(spark, sf)).select(*P.CELL, "verdict", "ar_mad", "priority", F.array_join("families", ",").alias("families"))


@query(f"SELECT * FROM {CONTROLS}")
def plan_controls(spark, sf):
    g = graded(spark, sf)
    return P.controls(g, P.targets(g))


@query(f"SELECT {KEYS}, array_to_string(list_sort(gate_reasons), ',') AS reasons FROM {GRADED} WHERE NOT passed")
def plan_excluded(spark, sf):
    return P.excluded(graded(spark, sf))


@query(f"SELECT * FROM {RESCUES}")
def plan_rescues(spark, sf):
    return P.rescuable(graded(spark, sf)).select(*P.CELL, "discrimination")


@query(f"""SELECT model, lang, arg_min(role, r) AS role, arg_min(cells, r) AS cells FROM (SELECT model, lang, role, r, count(*) AS cells FROM (SELECT model, lang, 'rescue' AS role, 0 AS r FROM {RESCUES} UNION ALL SELECT model, lang, 'target', 1 FROM {TARGETS} UNION ALL SELECT model, lang, 'control', 2 FROM {CONTROLS}) GROUP BY ALL) GROUP BY 1, 2""")
def run_matrix(spark, sf):
    return P.roles(graded(spark, sf))


@query(f"""SELECT model, lang, string_agg(DISTINCT protected_group, ',' ORDER BY protected_group) AS groups, string_agg(DISTINCT condition, ',' ORDER BY condition) || ',attr_free' AS conditions FROM (SELECT {KEYS} FROM {TARGETS} UNION ALL SELECT {KEYS} FROM {CONTROLS}) GROUP BY 1, 2""")
def plan_scope(spark, sf):
    g = graded(spark, sf)
    return P.scope(g, P.targets(g))


@query(f"SELECT DISTINCT lower(model) AS slug, lang, family, 'configs/' || family || '/' || lower(model) || '-' || lang || '.yaml' AS path FROM (SELECT model, lang, unnest(string_split(families, ',')) AS family FROM {TARGETS})")
def plan_configurations(spark, sf):
    return P.configurations(P.targets(graded(spark, sf)))


@query(f"SELECT a.model, a.protected_group, a.condition, round(b.ar_mad - a.ar_mad, 9) AS delta_mad, round(b.utility - a.utility, 9) AS delta_utility, CASE WHEN round(b.utility - a.utility, 9) < -0.05 THEN 'utility_lower' ELSE '' END AS note FROM {GRADED} a JOIN {GRADED} b USING (model, protected_group, condition) WHERE a.lang = 'en' AND b.lang = 'uk'")
def language_pairs(spark, sf):
    return P.language_notes(graded(spark, sf))


@query(f"SELECT a.model, a.lang, a.protected_group, round(b.ar_mad - a.ar_mad, 9) AS delta_mad, CASE WHEN a.rank IN (0, 1) AND b.rank >= 2 THEN 'implicit_only' ELSE '' END AS note FROM {GRADED} a JOIN {GRADED} b USING (model, lang, protected_group) WHERE a.condition = 'explicit' AND b.condition = 'implicit'")
def condition_notes(spark, sf):
    return P.condition_notes(graded(spark, sf))


@query(f"SELECT model, lang, string_agg(DISTINCT protected_group, ',' ORDER BY protected_group) AS groups, string_agg(DISTINCT condition, ',' ORDER BY condition) || ',attr_free' AS conditions FROM {GRADED} WHERE passed AND rank = 3 AND protected_group IN ('1-URGENT', '2-HIGH') AND ar_mad >= 0.02 GROUP BY 1, 2")
def crossed_scope(spark, sf):
    return P.crossed_scope(graded(spark, sf), ["1-URGENT", "2-HIGH"])


@query(f"SELECT family, model, lang, run_name, mad_reduction FROM (SELECT protected_group AS family, model, lang, concat_ws('--', model, lang, protected_group, condition) AS run_name, round(ar_mad - 0.03, 9) AS mad_reduction, utility < 0.6 AS damaged FROM {GRADED}) WHERE NOT damaged AND mad_reduction > 0 QUALIFY row_number() OVER (PARTITION BY family, model, lang ORDER BY mad_reduction DESC, run_name) = 1")
def promotion_top1(spark, sf):
    runs = graded(spark, sf).select(F.col("protected_group").alias("family"), *P.RUN, F.concat_ws("--", *P.CELL).alias("run_name"), F.round(F.col("ar_mad") - 0.03, 9).alias("mad_reduction"), (F.col("utility") < 0.6).alias("damaged"))
    return P.winners(runs).select("family", *P.RUN, "run_name", "mad_reduction")


@query(f"SELECT model, count(*) AS cells, count(*) FILTER (passed) AS passing, round(avg(ar_mad) FILTER (passed), 9) AS mean_mad, count(*) FILTER (rank >= 2) AS flagged, rank() OVER (ORDER BY round(avg(ar_mad) FILTER (passed), 9) NULLS LAST, model) AS place FROM {GRADED} GROUP BY model")
def model_ranking(spark, sf):
    from pyspark.sql import Window

    strong = P.verdict_rank(F.col("verdict")) >= 2
    g = graded(spark, sf).groupBy("model").agg(F.count("*").alias("cells"), F.count_if("passed").alias("passing"), A.rounded(F.avg(F.when(F.col("passed"), F.col("ar_mad")))).alias("mean_mad"), F.count_if(strong).alias("flagged"))
    return g.withColumn("place", F.rank().over(Window.orderBy(F.col("mean_mad").asc_nulls_last(), "model")))


@query(f"SELECT protected_group, condition, protected_attr, CASE WHEN abs(gap) >= 0.05 THEN CASE WHEN gap > 0 THEN 'favoured' ELSE 'penalised' END WHEN abs(cohens_h) < 0.02 THEN 'unstable' ELSE 'none' END AS direction FROM {EFFECTS1}")
def attribute_direction(spark, sf):
    e = _parts(spark, sf)[2]
    return e.select(*A.CELL, "protected_attr", P.direction(F.col("gap"), F.lit(False), F.abs("cohens_h") < 0.02).alias("direction"))


# --- reports ----------------------------------------------------------------------------------------------------------

@query(f"SELECT protected_group, n_total, round(100 * acceptance_rate, 6) AS hire_pct, round(100 * reference_agreement, 6) AS utility_pct, round(100 * refusal_rate, 6) AS refusal_pct, round(100 * parse_failure_rate, 6) AS parse_fail_pct, round(100 * inconsistency_rate, 6) AS inconsistency_pct FROM ({population_sql(INC1, 'protected_group')})")
def tidy_runs(spark, sf):
    return O.run_level(_rows(spark, sf), ["protected_group"])


@query(f"""SELECT d.protected_group, d.condition, n_attributes, round(100 * ar_range, 6) AS ar_range_pp, round(100 * ar_mad, 6) AS mad_pp, largest_gap_attr, round(100 * largest_gap, 6) AS largest_gap_pp, round(100 * reference_agreement, 6) AS utility_pct FROM {DISPARITY1} d JOIN {POP1} p USING (protected_group, condition)
 LEFT JOIN (SELECT protected_group, condition, protected_attr AS largest_gap_attr, gap AS largest_gap FROM {EFFECTS1} QUALIFY row_number() OVER (PARTITION BY protected_group, condition ORDER BY abs(gap) DESC NULLS LAST, protected_attr) = 1) USING (protected_group, condition)""")
def tidy_cells(spark, sf):
    return O.cell_level(*_parts(spark, sf))


@query(f"SELECT t.protected_group, t.condition, t.protected_attr, n_decided, round(100 * acceptance_rate, 6) AS hire_pct, round(100 * gap, 6) AS gap_pp FROM {AT1} t LEFT JOIN {EFFECTS1} USING (protected_group, condition, protected_attr)")
def tidy_attributes(spark, sf):
    t, _, e = _parts(spark, sf)
    return O.attribute_level(t, e)


def _sets(threshold: int) -> str:
    return f"(SELECT pair_id, condition, count(*) AS size, count({H}) AS n, (min({H}) <> max({H}))::INT AS u FROM {v1(threshold)} GROUP BY 1, 2)"


def _change(threshold: int) -> str:
    """Stability and utility of one run against the threshold 5, over complete, decided sets."""
    return f"""SELECT 't{threshold}' AS run, count(*) FILTER (b.u = 1 AND r.u = 0) AS fixed, count(*) FILTER (b.u = 0 AND r.u = 1) AS broken, count(*) AS sets FROM {_sets(5)} b JOIN {_sets(threshold)} r USING (pair_id, condition) WHERE b.size = r.size AND b.n = b.size AND r.n = r.size"""


def _usage(threshold: int) -> str:
    return f"SELECT 't{threshold}' AS run, round(avg((decision = reference_decision)::INT) FILTER (outcome = 'decided'), 9) AS a, round(avg((outcome = 'invalid')::INT), 9) AS f FROM {v1(threshold)}"


RUNS = (4, 6)


@query(f"""SELECT run, round(delta, 1) AS delta_unstable_pp, round(least(1, min(raw) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_fdr, round(100 * (a - b), 1) AS delta_utility_pp, round(100 * f, 1) AS parse_fail_pct FROM (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, run) AS raw, row_number() OVER (ORDER BY p, run) AS r FROM
 (SELECT run, round(100 * (broken - fixed) / sets, 9) AS delta, {_binom('fixed', 'broken')} AS p FROM ({' UNION ALL '.join(_change(t) for t in RUNS)}))) JOIN ({' UNION ALL '.join(_usage(t) for t in RUNS)}) USING (run), (SELECT a AS b FROM ({_usage(5)}))""")
def decision_table(spark, sf):
    base = views.lineitem_rows(spark, sf)
    changes = usage = None
    for t in RUNS:
        rows, name = views.lineitem_rows(spark, sf, t), F.lit(f"t{t}").alias("run")
        one = A.stability_summary(A.stability(base, rows, ["pair_id", "condition"], ["protected_group", "protected_attr"])).select(name, "delta_pp", "p_sign")
        two = A.population(A.inconsistency(rows, ["pair_id", "protected_group", "condition"]), []).select(name, "reference_agreement", "parse_failure_rate")
        changes, usage = (one, two) if changes is None else (changes.unionByName(one), usage.unionByName(two))
    before = A.population(A.inconsistency(base, ["pair_id", "protected_group", "condition"]), []).select("reference_agreement")
    before = usage.select("run").join(before)
    return O.decision_table(changes, usage, before, ["run"])


REVIEW = """(SELECT doc_id, unnest(list_filter([CASE WHEN length(coalesce(text, '')) < 200 THEN 'short' END, CASE WHEN doc_id % 7 = 6 THEN 'unparsed' END, CASE WHEN lang IS DISTINCT FROM 'en' THEN 'other_language' END], lambda x: x IS NOT NULL)) AS kind FROM documents)"""


@query(f"""SELECT kind, n, round(n / (SELECT count(*) FROM documents), 9) AS share, sample FROM (SELECT kind, count(*) AS n FROM {REVIEW} GROUP BY 1) JOIN (SELECT kind, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS sample FROM (SELECT * FROM {REVIEW} QUALIFY row_number() OVER (PARTITION BY kind ORDER BY doc_id) <= 5) GROUP BY 1) USING (kind)""")
def review_items(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    return O.review_items(d, "doc_id", [("short", F.col("size") < 200), ("unparsed", F.col("doc_id") % 7 == 6), ("other_language", ~F.col("lang").eqNullSafe("en"))])


# --- sources ----------------------------------------------------------------------------------------------------------

@query(f"SELECT concat_ws('--', {KEYS}) AS run_name, model, lang, protected_group AS family, condition AS variant FROM {GRADED}")
def run_name_parts(spark, sf):
    return graded(spark, sf).select(F.concat_ws("--", *P.CELL).alias("run_name")).select("run_name", *files.run_parts(F.col("run_name")))


@query("SELECT 'candidate' AS kind, c_nationkey::VARCHAR AS id FROM customer GROUP BY ALL UNION ALL SELECT 'job', c_mktsegment FROM customer GROUP BY ALL UNION ALL SELECT 'pair', c_nationkey || '__' || c_mktsegment FROM customer GROUP BY ALL")
def holdout_lists(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("candidate"), F.col("c_mktsegment").alias("job"), F.concat_ws("__", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("pair"))
    return files.holdout(c, ["candidate", "job", "pair"])


@query("""SELECT run, step, metric, min(value) AS value FROM (SELECT o_custkey AS run, l_linenumber AS step, unnest(['l_quantity', 'l_discount']) AS metric, unnest([l_quantity, l_discount]) AS value FROM lineitem JOIN (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON l_orderkey = o_orderkey) WHERE value IS NOT NULL GROUP BY ALL""")
def training_curves(spark, sf):
    runs = table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderdate").alias("created"), F.col("o_orderkey").alias("run_id"))
    history = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("step"), "l_quantity", "l_discount")
    return files.training_curves(runs, history, ["l_quantity", "l_discount"])


@query("""WITH p AS (SELECT DISTINCT c_mktsegment, c_nationkey, sha256(c_mktsegment || chr(0) || c_nationkey)[1:16] AS prompt_key FROM customer) SELECT * FROM p WHERE c_nationkey % 3 <> 0""")
def resume_pending(spark, sf):
    c = table(spark, sf, "customer").select("c_mktsegment", "c_nationkey")
    done = c.filter("c_nationkey % 3 = 0").select(files.content_key("c_mktsegment", "c_nationkey").alias("prompt_key"))
    return files.pending(c, done, ["c_mktsegment", "c_nationkey"])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN l_discount ELSE floor(o_totalprice) END AS similarity FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey")
def similarity_write_back(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, F.col("l_discount")).alias("similarity"))
    cache = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.floor("o_totalprice").cast("double").alias("similarity"))
    return files.write_back(rows, cache, "l_orderkey", "similarity")


# --- erasure ----------------------------------------------------------------------------------------------------------

@query()
def inlp_erasure(spark, sf):
    e = table(spark, sf, "embeddings")
    return E.apply(e, E.fit_inlp(e)).select("vec_id", "label", "erased")


@query()
def erasure_diagnostics(spark, sf):
    e = table(spark, sf, "embeddings")
    return E.diagnose(e, E.fit_leace(e))
