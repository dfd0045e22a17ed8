"""Hand-made cases of generated answers, scrubbing, gates and runs."""

import re

import pytest
from pyspark.sql import functions as F

from veriset.functions import scalar as S
from veriset.functions import vocabulary as V
from veriset.operators import generation as G
from veriset.operators import runs as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("raw, decision, outcome, feedback, word", [
    ('{"decision": " Hire ", "feedback": " fine "}', "hire", "decided", "fine", "Hire"),
    ('Note {x}. {"decision": "no", "feedback": null}', "reject", "decided", "", "no"),
    ('{"feedback": "I cannot say"}', V.INVALID, "invalid", "I cannot say", ""),
    ("As an AI {not json} I pass", V.REFUSED, "refused", "", "As an AI {not json} I pass"),
    ("{'decision': \"hire\"}", V.INVALID, "invalid", "", "{'decision': \"hire\"}"),
    ("x" * 300, V.INVALID, "invalid", "", "x" * 200),
    (None, V.INVALID, "invalid", "", ""),
])
def test_parsed(spark, raw, decision, outcome, feedback, word):
    got = one(spark, S.parsed(F.lit(raw).cast("string")))
    assert (got.decision, got.outcome, got.feedback, got.raw_decision) == (decision, outcome, feedback, word)


def test_render_keeps_braces_of_values(spark):
    assert one(spark, G.render("a {x} {{y}} {z}", x=F.lit("{z}"), z=F.lit(None).cast("string"))) == "a {z} {y} "
    with pytest.raises(KeyError):
        G.render("{x}", y=F.lit(""))


def test_sentences_missing_is_an_error(spark):
    rows = spark.createDataFrame([("g", "a"), ("g", "b")], "protected_group string, protected_attr string")
    told = spark.createDataFrame([("g", "a", "I am a.")], "protected_group string, protected_attr string, sentence string")
    with pytest.raises(Exception, match="no sentence for g / b"):
        G.with_sentences(rows, told).collect()
    assert G.with_sentences(rows.limit(0), told).collect() == []


def brute_scrub(text, lang, labels, sentences, attributes):
    """The passes as plain loops."""
    gone, removals = [re.escape(s) for s in sentences] + list(V.IDENTITY[lang]), []
    either = "|".join(map(re.escape, labels))
    gone.insert(0, rf"(?im)^\s*(?:{either})\s+кандидата\s*:.*$" if lang == "uk" else rf"(?im)^\s*(?:candidate'?s\s+)?(?:{either})\s*:.*$")
    stems = [r"(?i)\b" + r"[\s/()-]+".join(w[:5] + r"\w*" for w in re.findall(r"[^\W\d_]{3,}", a)) for a in attributes]
    for pattern, put in [(p, "") for p in gone] + [(p, V.REDACTION[lang]) for p in stems]:
        removals += [m[0].strip() for m in re.finditer(pattern, text) if m[0].strip()]
        text = re.sub(pattern, lambda _, put=put: put, text)
    return re.sub("\n{3,}", "\n\n", re.sub("[ \t]{2,}", " ", text)).strip(), removals


@pytest.mark.parametrize("lang, labels, sentences, attributes, texts", [
    ("en", ["military status", "age"], ["I served (long)."], ["War veteran", "Redacted person"], ["", "plain  text\n\n\n\nend ", "Candidate's Military status: War veteran\nAGE : 3\nrest", "I served (long). My pronouns are x. A war-VETERANS' club; redacted persons", "I am married! I am a reservist? warm veteran", "\n  age: 5\n\n\nx"]),
    ("uk", ["вік"], ["Я служив."], ["Ветеран війни"], ["Вік кандидата: 5\nдосвід", "Я служив. Ветераном війною був. Я одружений! кінець", "Я дотримуюся віри. Мої займенники вони."]),
])
def test_scrub_against_loops(spark, lang, labels, sentences, attributes, texts):
    passes = G.scrub_passes(lang, labels, sentences, attributes)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", G.scrubbed(F.col("t"), passes).alias("s"))
    got = [(r.s.text, list(r.s.removals)) for r in d.orderBy("i").collect()]
    assert got == [brute_scrub(t, lang, labels, sentences, attributes) for t in texts]


def test_scrub_null_and_no_passes(spark):
    got = one(spark, G.scrubbed(F.lit(None).cast("string"), G.scrub_passes("en", [], [], [])))
    assert got.text is None and got.removals == []
    assert one(spark, G.scrubbed(F.lit(" a  b "), [])).text == "a b"


@pytest.mark.parametrize("back, want", [("```text\nnew\n```", "new"), ("```\n\n```", "old"), ("a ```\nb\n``` c", "a ```\nb\n``` c"), (None, "old"), ("  ", "old")])
def test_rewritten(spark, back, want):
    assert one(spark, G.rewritten_or(F.lit("old"), F.lit(back).cast("string"))) == want


def test_gates_first_reason_and_nulls(spark):
    schema = "outcome string, decision string, reference_decision string, protected_attr string, feedback string"
    d = spark.createDataFrame([
        ("invalid", None, "hire", "Veteran", None),
        ("decided", "hire", "hire", "Veteran", None),
        ("decided", "reject", "hire", "Veteran", "the veterans are many here"),
        ("decided", "hire", "hire", "Veteran", "the veterans are many here"),
        ("decided", "hire", "hire", "Veteran", "hired regardless of some trait"),
        ("decided", "hire", "hire", "__attr_free__", "good match of attr and free skills"),
    ], schema).coalesce(1)
    reasons = lambda mode: [r.drop_reason for r in G.gate(d, mode, "en").collect()]
    assert reasons("reference") == ["reference_invalid", "reference_feedback_too_short", None, None, None, None]
    assert reasons("invariant") == ["invariant_invalid", "invariant_feedback_length", "invariant_decision_drift", "invariant_attribute_leak", "invariant_meta_commentary", None]
    assert reasons("biased") == ["biased_invalid", "biased_not_actually_biased", None, None, "biased_not_actually_biased", "biased_not_actually_biased"]
    with pytest.raises(ValueError):
        G.gate(d, "other", "en")
    got = G.gate_report(G.gate(d, "invariant", "en")).first()
    assert (got.n_input, got.n_kept, got["yield"]) == (6, 1, 0.1667) and [x.n for x in got.dropped] == [1] * 5
    empty = G.gate_report(G.gate(d.limit(0), "invariant", "en")).first()
    assert (empty.n_input, empty.n_kept, empty["yield"], empty.dropped) == (0, 0, 0.0, [])


def test_usability_judges_only_what_is_there(spark):
    d = spark.createDataFrame([(None, None, None), (0.51, 5, 10), (float("nan"), 99, 100), (0.5, 100, 100)], "parse_failure_rate double, n_decided long, n_total long").coalesce(1)
    got = R.usability(d).collect()
    assert [r.usable for r in got] == [True, False, False, True]
    assert got[1].unusable_reason == "51.0% of responses could not be parsed (only 5 of 10 decided)"
    assert got[2].unusable_reason == "only 99 parsed decisions, below the 100 minimum"


def test_labels(spark):
    assert one(spark, R.labelled(F.lit("a"), {"a": "A"})) == "A"
    with pytest.raises(Exception, match="no label for b"):
        one(spark, R.labelled(F.lit("b"), {"a": "A"}))


def test_first_number(spark):
    assert [one(spark, S.first_number(F.lit(x).cast("string"))) for x in ("2.5y", "no_exp", "5y", None)] == [2.5, 0.0, 5.0, 0.0]


def test_flags_over_shared_cells(spark):
    tests = spark.createDataFrame([("c", 0.01, 0.2), ("c", 0.04, 0.04), ("c", None, None)], "cell string, p double, p_adj double")
    got = R.flag_counts(tests, ["cell"]).first()
    assert (got.n_attributes, got.n_flagged_raw, got.n_flagged_fdr, round(got.pct_flagged_raw, 3)) == (3, 2, 1, 66.667)
    schema = "run string, cell string, n_flagged_fdr long, largest_gap double"
    base = spark.createDataFrame([("r", "a", 3, -0.4), ("r", "b", 9, 0.9)], schema)
    run = spark.createDataFrame([("r", "a", 1, 0.1)], schema)
    got = R.shared_delta(base.drop("run"), run, ["cell"], ["run"]).first()
    assert (got.n_cells, got.flags_delta, got.gap_before, got.gap_after) == (1, -2, 0.4, 0.1)


def test_loose_words_and_drift(spark):
    assert not one(spark, S.mapped_loosely(F.lit(" **Hire.** "), F.lit("decided")))
    assert one(spark, S.mapped_loosely(F.lit("to hire"), F.lit("decided")))
    assert not one(spark, S.mapped_loosely(F.lit(None).cast("string"), F.lit("refused")))
    assert one(spark, S.drifted(F.lit("досвід роботи чудовий і довгий"), F.lit("en")))
    assert not one(spark, S.drifted(F.lit("досвід"), F.lit("en")))


@pytest.mark.parametrize("measured", [True, False])
def test_ranking_keeps_baselines_of_equal_measures_apart(spark, measured):
    rows = [(1, "m", "sft", None, 0.5, 0.5), (2, "m", "none", None, 0.7, 0.75), (3, "m", "none", 0, 0.7, 0.75), (4, "m", "none", 9, 0.7, 0.75), (5, "m", "dpo", None, None, 0.75), (6, "n", "dpo", None, 0.1, 0.1)]
    runs = spark.createDataFrame(rows, "run int, model string, family string, limit_pairs int, ar_mad double, utility double")
    got = R.rank_mitigations(runs, ["model"], measured=measured).select("run", "baseline", "mad_reduction", "utility_delta", "damaged").collect()
    want = [(1, 2, 0.2, -0.25, True), (1, 3, 0.2, -0.25, True)] + [(5, 2, None, 0.0, False), (5, 3, None, 0.0, False)] * (not measured)
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == want


def test_mitigation_ranking_at_equal_baselines(spark, tmp_path):
    """Suppliers of equal balances, or none: one row for each baseline, as the SQL has it."""
    import duckdb

    from veriset.plans import generation as P
    from veriset.plans.catalogue import ORACLES

    rows = [(i * 50 + k, "s", 1, None if i == 3 else 100.0) for i in range(6) for k in (1, 2, 4, 8)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    names = "run, baseline, mad_reduction, utility_delta, damaged"
    want = con.execute(f"SELECT {names} FROM ({ORACLES['mitigation_ranking']})").fetchall()
    got = P.mitigation_ranking(spark, str(tmp_path)).select(*names.split(", ")).collect()
    assert len(want) > 20 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
