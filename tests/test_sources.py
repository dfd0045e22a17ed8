"""Sources and sinks on small files, planning rules, probes."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriset.operators import erasure as E
from veriset.operators import planning as P
from veriset.operators import reports as O
from veriset.sources import files


def test_benchmark_csv(spark, tmp_path):
    head = 'candidate_id,job_id,CV,Job Description,Job Position,lang,decision_gpt-4o,feedback'
    (tmp_path / "b.csv").write_text(head + '\nc1,j1,"two\nlines","says ""yes""",dev,en, Hire ,fine\n')
    r = files.benchmark(spark, str(tmp_path / "b.csv")).first()
    assert (r.pair_id, r.cv, r.job_description, r.reference_decision, r.reference_feedback) == ("c1__j1", "two\nlines", 'says "yes"', "hire", "fine")
    (tmp_path / "twice.csv").write_text(head + "\n" + "c1,j1,a,b,c,en,hire,f\n" * 2)
    with pytest.raises(ValueError, match="c1__j1"):
        files.benchmark(spark, str(tmp_path / "twice.csv"))
    (tmp_path / "none.csv").write_text(head.replace(",feedback", "") + "\nc1,j1,a,b,c,en,hire\n")
    with pytest.raises(ValueError, match="feedback"):
        files.benchmark(spark, str(tmp_path / "none.csv"))


def test_attribute_list(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" one \n\n two\r\nthree")
    rows = files.attributes(spark, str(tmp_path / "a.txt"), "g", "en").orderBy("ordinal").collect()
    assert [(r.ordinal, r.protected_attr) for r in rows] == [(0, "one"), (1, "two"), (2, "three")]
    (tmp_path / "e.txt").write_text(" \n")
    with pytest.raises(ValueError):
        files.attributes(spark, str(tmp_path / "e.txt"), "g", "en")


def test_templates(spark, tmp_path):
    (tmp_path / "t.csv").write_text("group,attribute,text\nmarital status,married,I am married.\n")
    assert tuple(files.templates(spark, str(tmp_path / "t.csv")).first()) == ("marital_status", "married", "I am married.")


def test_runs_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, "x")], "id int, raw_output string")
    for name in ("M1.5--en--prompt--a", "M2--uk--scrub"):
        files.save_run(d, str(tmp_path), name, {"model": name.split("--")[0], "n": 1})
    files.save_run(d, str(tmp_path), "M2--uk--scrub", {"model": "M2", "n": 1})
    assert files.load_runs(spark, str(tmp_path)).count() == 2
    one = files.load_runs(spark, str(tmp_path), ["M1.5--en--prompt--a"]).select(*files.run_parts(F.col("run"))).first()
    assert tuple(one) == ("M1.5", "en", "prompt", "a")
    assert json.loads(spark.read.json(str(tmp_path / "meta")).filter("run like 'M2%'").first().meta) == {"model": "M2", "n": 1}


def test_records_and_csv_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a", float("nan"), 1), ("б", 0.5, None)], "name string, rate double, n int")
    files.write_records(d, str(tmp_path / "r"))
    assert sorted(tuple(r) for r in files.read_records(spark, str(tmp_path / "r"), d.schema).collect()) == [("a", None, 1), ("б", 0.5, None)]
    t = spark.createDataFrame([('say "x", y', 1)], "name string, n int")
    files.write_csv(t, str(tmp_path / "c"))
    assert spark.read.options(**files.CSV).csv(str(tmp_path / "c")).first().name == 'say "x", y'


def test_raw_dumps(spark, tmp_path):
    for n in ("en_hire", "uk_reject_two"):
        spark.range(1).toPandas().to_parquet(tmp_path / f"{n}.parquet")
    assert sorted(tuple(r) for r in files.raw_dumps(spark, str(tmp_path)).collect()) == [("en", "hire"), ("uk", "reject_two")]


def test_pending_answers_only_new_prompts(spark):
    d = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "prompt string")
    done = d.filter("prompt = 'b'").withColumn("prompt_key", files.content_key("prompt"))
    assert sorted(str(r.prompt) for r in files.pending(d, done, ["prompt"]).collect()) == ["None", "a"]


def test_write_back_keeps_own_values(spark):
    d = spark.createDataFrame([(1, 0.5), (2, None), (3, None)], "id int, s double")
    c = spark.createDataFrame([(1, 0.9), (2, 0.7), (2, 0.7)], "id int, s double")
    assert sorted((r.id, r.s) for r in files.write_back(d, c, "id", "s").collect()) == [(1, 0.5), (2, 0.7), (3, None)]


def test_config_with_references(tmp_path):
    (tmp_path / "audit.json").write_text('{"groups": ["g"]}')
    (tmp_path / "main.json").write_text('{"audit_config": "audit.json", "x": 1}')
    assert files.load_config(str(tmp_path / "main.json")) == {"audit_config": "audit.json", "x": 1, "audit": {"groups": ["g"]}}


CELLS = "model string, lang string, protected_group string, condition string, verdict string, passed boolean, gate_reasons array<string>, ar_mad double, utility double, discrimination double"


def test_plan(spark):
    cells = spark.createDataFrame(
        [
            ("m", "en", "a", "explicit", "confirmed", True, [], 0.05, 0.8, 0.3),
            ("m", "en", "b", "explicit", "probable", True, [], 0.09, 0.8, 0.3),
            ("m", "en", "c", "explicit", "clean", True, [], 0.01, 0.8, 0.3),
            ("m", "en", "d", "explicit", "clean", True, [], 0.005, 0.8, 0.3),
            ("m", "en", "e", "explicit", "confirmed", True, [], None, 0.8, 0.3),
            ("r", "en", "a", "explicit", "not_interpretable", False, ["low_utility"], 0.05, 0.4, 0.15),
            ("s", "en", "a", "explicit", "not_interpretable", False, ["unusable"], 0.05, 0.4, 0.5),
        ],
        CELLS,
    )
    t = P.targets(cells)
    assert [(r.protected_group, list(r.families)) for r in t.orderBy("priority").collect()] == [("a", ["prompt", "scrub", "embedding", "sft", "dpo"]), ("b", ["prompt", "scrub", "embedding", "sft", "dpo"])]
    assert P.targets(cells, 1).count() == 1
    assert [r.protected_group for r in P.controls(cells, t).collect()] == ["d"]
    assert [r.model for r in P.rescuable(cells).collect()] == ["r"]
    assert sorted((r.model, r.role, r.cells) for r in P.roles(cells).collect()) == [("m", "target", 2), ("r", "rescue", 1)]
    assert tuple(P.scope(cells, t).first())[2:] == ("a,b,d", "explicit,attr_free")


def test_markdown_refuses_data(spark):
    assert "| a\\|b | -- |" in O.markdown(spark.createDataFrame([("a|b", None)], "x string, y double"), "T")
    with pytest.raises(ValueError):
        O.markdown(spark.range(20), "T", 10)


def test_review_items_without_rows(spark):
    assert O.review_items(spark.range(0), "id", [("odd", F.col("id") % 2 == 1)]).count() == 0


def test_inlp_removes_what_a_probe_finds(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    x = rng.normal(size=(400, 6))
    x[:, 2] += 4 * y
    d = spark.createDataFrame([(x[i].tolist(), int(y[i])) for i in range(400)], "embedding array<double>, label long")
    e = E.fit_inlp(d)
    z = np.array([r.erased for r in E.apply(d, e).select("erased").collect()])
    gap = lambda v: np.linalg.norm(v[y == 1].mean(0) - v[y == 0].mean(0))
    assert gap(z) < 0.2 * gap(x)
    assert 0 < np.linalg.matrix_rank(e.projection) < 6
    assert 0 < E.diagnose(d, e).first().relative_change < 1
    assert np.array_equal(E.fit_inlp(d.withColumn("label", d.label * 0)).projection, np.eye(6))
