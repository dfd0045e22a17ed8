"""Answers, sign tests and set stability against brute force."""

import json
import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from veriset.functions import scalar as S
from veriset.operators import audit as A


def objects(text):
    """The first balanced object by trying every stretch from an opening to a closing brace."""
    decoder = json.JSONDecoder()
    for i, c in enumerate(text):
        if c == "{":
            try:
                found, _ = decoder.raw_decode(text, i)
            except ValueError:
                continue
            return found
    return None


def test_first_object(spark):
    rng = random.Random(1)
    parts = ['{"decision": "hire"}', '{"a": {"b": "}"}, "decision": "no"}', "{x}", "Note {x}.", "```json\n", '{"decision": "reject", "feedback": "a {b} \\" c"}', "{", "}", " text ", '{"open": "', "{{", '{"n": [1, {"k": 2}]}']
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(400)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.first_object(F.col("t")).alias("o")).collect()
    for i, o in rows:
        want = None if texts[i] is None else objects(texts[i])
        try:
            got = None if o is None else json.loads(o)
        except ValueError:
            got = None
        assert got == want, texts[i]


@pytest.mark.parametrize("text, want", [("Note {x}. {'decision': 'hire'}", {"decision": "hire"}), ('{"decision": "hire",}', {"decision": "hire"}), ('a {"f": "{", "decision": "no",} b {"z": 1}', {"f": "{", "decision": "no"}), ("no object", None)])
def test_mended_objects(spark, text, want):
    o = spark.createDataFrame([(text,)], "t string").select(S.first_object(F.col("t"))).first()[0]
    assert (json.loads(o) if o else None) == want


def test_normalise(spark):
    texts = ["  **Hire.**\n", "(no)", "ＨＩＲＥ", "no!", "не  найняти", "ﬁt now", "…", None]
    marks = "`*_ \t\n.:;\"'"
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(S.normalise(F.col("t"))).collect()]
    assert got == [None if t is None else " ".join(unicodedata.normalize("NFKC", t).strip().strip(marks).split()).lower() for t in texts]


def test_sign_test(spark):
    pairs = [(0, 0), (0, 1), (5, 5), (3, 9), (0, 20), (21, 40), (500, 560), (4000, 4000), (4000, 4300), (10**6, 10**6 + 2500)]
    got = [r[0] for r in spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a long, b long").orderBy("i").select(S.sign_test(F.col("a"), F.col("b"))).collect()]
    for (a, b), p in zip(pairs, got):
        n, k = a + b, min(a, b)
        if not n:
            assert p is None
            continue
        tail = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(max(0, k - 20000), k + 1))
        assert math.isclose(p, min(1, 2 * tail), rel_tol=1e-6, abs_tol=1e-9), (a, b)


def test_stability_keeps_complete_sets_of_every_size(spark):
    row = lambda pair, group, attr, outcome, decision: (pair, group, attr, outcome, decision, 0)
    rows = [row(1, "g2", a, "decided", d) for a, d in (("a", "hire"), ("b", "reject"))] + [row(1, "g3", a, "decided", "hire") for a in "xyz"] + [row(2, "g2", "a", "decided", "hire"), row(2, "g2", "b", "invalid", None)]
    d = spark.createDataFrame(rows, "pair_id int, protected_group string, protected_attr string, outcome string, decision string, candidate_id int")
    got = A.stability(d, d, ["pair_id", "protected_group"], ["protected_group", "protected_attr"]).collect()
    assert {(r.pair_id, r.protected_group, r.unstable_base) for r in got} == {(1, "g2", 1), (1, "g3", 0)}
