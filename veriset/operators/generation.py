"""Generated answers on their way to training rows: profiles, prompts, variants, scrubbing, gates, training rows.

Wordings (templates, labels, sentences) are the caller's; everything is a projection but the joins named as such.
"""

from __future__ import annotations

import re
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import vocabulary as V

VARIANT = ["pair_id", "protected_group", "protected_attr", "condition"]


# --- profiles and prompts ---------------------------------------------------------------------------------------------

def render(template: str, **values: Column) -> Column:
    """The template with its ``{names}`` filled in, all at once: braces inside a value stay. A name without a value is a KeyError."""
    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts += [F.lit(text)] if text else []
        parts += [F.coalesce(values[name].cast("string"), F.lit(""))] if name else []
    return F.concat(*parts) if parts else F.lit("")


def by_language(lang: Column, wordings: dict[str, Column]) -> Column:
    """The wording of the row's language; a language without one is an error."""
    out = F.raise_error(F.concat(F.lit("no wording for the language "), F.coalesce(lang, F.lit("null"))))
    for name, c in wordings.items():
        out = F.when(lang == name, c).otherwise(out)
    return out


def with_sentences(rows: DataFrame, sentences: DataFrame, crossed: dict[str, list[str]] | None = None, aliases: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """Rows with ``implicit_injection``, the sentence of their attribute from (protected_group, protected_attr, sentence).

    Crossed groups join the sentences of their parts, which " | " separates, by a space. An attribute without a
    sentence is an error. Only the distinct attributes are looked up, so the second join has a row for each of them.
    """
    cells = rows.select("protected_group", "protected_attr").distinct()
    groups = F.array(F.col("protected_group"))
    for name, parts in (crossed or {}).items():
        groups = F.when(F.col("protected_group") == name, F.array(*map(F.lit, parts))).otherwise(groups)
    attrs = F.when(F.size("__g") > 1, F.split("protected_attr", r" \| ")).otherwise(F.array("protected_attr"))
    d = cells.withColumn("__g", groups).select("*", F.posexplode(F.arrays_zip(F.col("__g").alias("g"), attrs.alias("a"))).alias("__i", "__p"))
    attr = F.col("__p.a")
    for (group, was), name in (aliases or {}).items():
        attr = F.when((F.col("__p.g") == group) & (F.col("__p.a") == was), name).otherwise(attr)
    d = d.select("protected_group", "protected_attr", "__i", F.col("__p.g").alias("__pg"), attr.alias("__pa"))
    s = sentences.select(F.col("protected_group").alias("__pg"), F.col("protected_attr").alias("__pa"), "sentence")
    missing = F.raise_error(F.concat(F.lit("no sentence for "), F.concat_ws(" / ", "__pg", "__pa")))
    d = d.join(s, ["__pg", "__pa"], "left").withColumn("sentence", F.when(F.col("sentence").isNull(), missing).otherwise(F.col("sentence")))
    d = d.groupBy("protected_group", "protected_attr").agg(F.array_sort(F.collect_list(F.struct("__i", "sentence"))).alias("__s"))
    d = d.select("protected_group", "protected_attr", F.concat_ws(" ", F.col("__s.sentence")).alias("implicit_injection"))
    return rows.join(d, ["protected_group", "protected_attr"])


def profile(cv: Column, condition: Column, label: Column, attr: Column, sentence: Column, lang: Column) -> Column:
    """The profile as its condition shows it: a labelled line above the text, a sentence above it, or the bare text."""
    line = F.when(lang == "uk", F.concat(label, F.lit(" кандидата: "), attr)).otherwise(F.concat(F.lit("Candidate's "), label, F.lit(": "), attr))
    explicit = (condition == "explicit") & (attr != "__attr_free__")
    implicit = (condition == "implicit") & (F.coalesce(sentence, F.lit("")) != "")
    return F.when(explicit, F.concat(line, F.lit("\n"), cv)).when(implicit, F.concat(sentence, F.lit("\n"), cv)).otherwise(cv)


def folded(rows: DataFrame) -> DataFrame:
    """Implicit rows with their sentence inside ``cv``, where a scrubber finds it, and none beside it."""
    implicit = F.col("condition") == "implicit"
    return rows.withColumns({
        "cv": F.when(implicit, F.concat(F.coalesce("implicit_injection", F.lit("")), F.lit("\n"), "cv")).otherwise(F.col("cv")),
        "implicit_injection": F.when(implicit, "").otherwise(F.col("implicit_injection")),
    })


def shown_condition() -> Column:
    """Scrubbed rows are shown as the bare profile."""
    return F.when(F.col("profile_rendered") == "scrubbed", "attr_free").otherwise(F.col("condition"))


def variants(pairs: DataFrame, attributes: dict[str, list[str]], per_pair: int, conditions: list[str], seed: str) -> DataFrame:
    """``per_pair`` attributes of each group for each pair, by a portable draw, in every condition. No shuffle: the lists are literals."""
    def drawn(group: str, names: list[str]) -> Column:
        keyed = F.transform(F.array(*map(F.lit, names)), lambda a: F.struct(S.portable_int(seed, F.col("pair_id"), F.lit(group), a).alias("k"), a.alias("a")))
        return F.transform(F.slice(F.array_sort(keyed), 1, per_pair), lambda x: F.struct(F.lit(group).alias("protected_group"), x["a"].alias("protected_attr")))

    d = pairs.withColumn("__v", F.explode(F.concat(*[drawn(g, names) for g, names in attributes.items()]))).withColumn("condition", F.explode(F.array(*map(F.lit, conditions))))
    return d.select(*pairs.columns, "__v.protected_group", "__v.protected_attr", "condition")


def changed_by_verifier(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """The second pass's rows with the first decision and whether it was changed."""
    d = second.join(first.select(*key, F.col("decision").alias("first_pass_decision")), key)
    return d.withColumn("verifier_changed_decision", (~F.col("decision").eqNullSafe(F.col("first_pass_decision"))).cast("double"))


# --- scrubbing --------------------------------------------------------------------------------------------------------

def stem_pattern(phrase: str) -> str | None:
    """A pattern of a phrase's inflected forms: the first letters of each word and any ending; None without a word of three letters."""
    words = [w for w in re.findall(r"[^\W\d_]+", phrase) if len(w) >= 3]
    return r"(?iuU)\b" + r"[\s/()-]+".join(w[: V.STEM] + r"\w*" for w in words) if words else None


def scrub_passes(lang: str, labels: list[str], sentences: list[str], attributes: list[str]) -> list[tuple[str, str]]:
    """(pattern, replacement) in order: labelled lines, known sentences and statements of identity go, attributes are redacted."""
    either = "|".join(map(re.escape, labels))
    line = rf"(?imduU)^\s*(?:{either})\s+кандидата\s*:.*$" if lang == "uk" else rf"(?imduU)^\s*(?:candidate'?s\s+)?(?:{either})\s*:.*$"
    gone = ([line] if labels else []) + [re.escape(s) for s in sentences] + ["(?uU)" + p for p in V.IDENTITY[lang]]
    return [(p, "") for p in gone] + [(p, V.REDACTION[lang]) for p in map(stem_pattern, attributes) if p]


def scrubbed(text: Column, passes: list[tuple[str, str]]) -> Column:
    """Struct of the text after all passes, with tidy white space, and ``removals``, what each of them took, in order.

    Texts in which no pattern occurs, nearly all, are left after one look by ``rlike``; the others go through the passes
    one after the other, as a later pattern sees what an earlier one left.
    """
    t = S.nfkc(text)
    state = F.struct(t.alias("text"), F.array().cast("array<string>").alias("removals"))
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(r).alias("r")) for p, r in passes])

    def step(s, x):
        hits = F.filter(F.transform(F.regexp_extract_all(s["text"], x["p"], F.lit(0)), stripped), lambda h: h != "")
        return F.struct(F.regexp_replace(s["text"], x["p"], x["r"]).alias("text"), F.concat(s["removals"], hits).alias("removals"))

    seen = reduce(lambda a, b: a | b, [t.rlike(p) for p, _ in passes]) if passes else F.lit(False)
    out = F.when(seen, F.aggregate(table, state, step)).otherwise(state) if passes else state
    tidy = stripped(F.regexp_replace(F.regexp_replace(out["text"], "[ \t]{2,}", " "), "\n{3,}", "\n\n"))
    return F.struct(tidy.alias("text"), out["removals"].alias("removals"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_fence(text: Column) -> Column:
    """The inside of a text that is one fenced block as a whole."""
    t = stripped(text)
    inside = F.regexp_extract(t, r"(?s)^```[a-zA-Z]*\n(.*)\n```$", 1)
    return F.when(t.rlike(r"(?s)^```[a-zA-Z]*\n.*\n```$"), stripped(inside)).otherwise(t)


def rewritten_or(original: Column, rewritten: Column) -> Column:
    """A rewritten text without its fence; the original where nothing came back."""
    return F.coalesce(F.nullif(without_fence(rewritten), F.lit("")), original)


def change_rate(rows: DataFrame, changed: Column) -> DataFrame:
    flag = F.coalesce(changed, F.lit(False)).cast("int")
    return rows.agg(F.coalesce(F.sum(flag), F.lit(0)).alias("rows_changed"), F.count("*").alias("rows_total"), F.coalesce(F.round(F.avg(flag), 9), F.lit(0.0)).alias("change_rate"))


# --- gates ------------------------------------------------------------------------------------------------------------

def _first(reasons: list[tuple[Column, Column]]) -> Column:
    return F.coalesce(*[F.when(failed, name) for name, failed in reasons], F.lit(None).cast("string"))


def gate(rows: DataFrame, mode: str, lang: str) -> DataFrame:
    """Rows (decision, outcome, feedback, and but for ``reference`` protected_attr, reference_decision) with ``drop_reason``.

    ``reference``: usable, long enough, not too long, in the language. ``invariant``: usable, the reference's decision,
    length, language, no attribute, no talk about it. ``biased``: usable, language, and a flipped decision or the
    attribute named. The first test that fails is the reason; null keeps. Null feedback is empty.
    """
    text = F.coalesce("feedback", F.lit(""))
    n, (least, most) = S.word_count(text), V.FEEDBACK_WORDS
    why = lambda name: F.lit(f"{mode}_{name}")
    unusable = (F.concat(F.lit(f"{mode}_"), "outcome"), F.col("outcome") != "decided")
    foreign = (why("wrong_language"), ~S.language_ok(text, lang))
    if mode == "reference":
        return rows.withColumn("drop_reason", _first([unusable, (why("feedback_too_short"), n < least), (why("feedback_too_long"), n > most), foreign]))
    drifts = ~F.col("decision").eqNullSafe(F.col("reference_decision"))
    leaks = S.mentions(text, S.stems(F.col("protected_attr")))
    if mode == "invariant":
        return rows.withColumn("drop_reason", _first([unusable, (why("decision_drift"), drifts), (why("feedback_length"), (n < least) | (n > most)), foreign, (why("attribute_leak"), leaks), (why("meta_commentary"), S.has_meta(text, lang))]))
    if mode != "biased":
        raise ValueError(f"no gate {mode!r}; there are reference, invariant and biased")
    d = rows.withColumns({"rejected_flipped_decision": drifts, "rejected_mentions_attribute": F.coalesce(leaks, F.lit(False))})
    return d.withColumn("drop_reason", _first([unusable, foreign, (why("not_actually_biased"), ~F.expr("rejected_flipped_decision or rejected_mentions_attribute"))]))


def gate_report(gated: DataFrame) -> DataFrame:
    """One row: rows in, rows kept, the yield, and (reason, n) by falling n, then by name."""
    d = gated.groupBy("drop_reason").agg(F.count("*").alias("n"))
    kept = F.coalesce(F.sum(F.when(F.col("drop_reason").isNull(), F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    found = F.sort_array(F.collect_list(F.when(F.col("drop_reason").isNotNull(), F.struct((-F.col("n")).alias("m"), F.col("drop_reason").alias("reason")))))
    dropped = F.transform(found, lambda x: F.struct(x["reason"].alias("reason"), (-x["m"]).alias("n")))
    return d.agg(total.alias("n_input"), kept.alias("n_kept"), F.coalesce(F.round(kept / F.nullif(total, F.lit(0)), 4), F.lit(0.0)).alias("yield"), dropped.alias("dropped"))


# --- training rows ----------------------------------------------------------------------------------------------------

def written(decision: Column, lang: Column) -> Column:
    """A canonical decision in the words of the language's prompts; others stay."""
    low = F.lower(F.trim(decision))
    uk = F.when(low == V.HIRE, V.DECISION_WORDS["uk"][0]).when(low == V.REJECT, V.DECISION_WORDS["uk"][1])
    en = F.when(low == V.HIRE, V.HIRE).when(low == V.REJECT, V.REJECT)
    return F.coalesce(F.when(lang == "uk", uk).otherwise(en), decision)


def sft_rows(kept: DataFrame) -> DataFrame:
    """(variant, prompt, completion, decision, lang) of kept invariant answers, whose prompts are rendered already."""
    answer = S.completion(written(F.col("decision"), F.col("lang")), F.coalesce("feedback", F.lit("")))
    return kept.select(*VARIANT, "prompt", answer.alias("completion"), "decision", "lang")


def dpo_rows(kept: DataFrame, biased: DataFrame) -> DataFrame:
    """(variant, prompt, chosen, rejected, lang, flags): both answers to one and the same variant, an inner join."""
    b = biased.select(*VARIANT, F.col("decision").alias("__d"), F.col("feedback").alias("__f"), "rejected_flipped_decision", "rejected_mentions_attribute")
    answer = lambda d, f: S.completion(written(F.col(d), F.col("lang")), F.coalesce(f, F.lit("")))
    d = kept.join(b, VARIANT)
    return d.select(*VARIANT, "prompt", answer("decision", "feedback").alias("chosen"), answer("__d", "__f").alias("rejected"), "lang", "rejected_flipped_decision", "rejected_mentions_attribute")


def subset(rows: DataFrame, languages: list[str] | None = None, groups: list[str] | None = None, conditions: list[str] | None = None, limit: int | None = None, longest: bool = False, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the given languages, groups and conditions; with ``limit`` the first by ``order``, or the longest texts first."""
    for column, wanted in (("lang", languages), ("protected_group", groups), ("condition", conditions)):
        rows = rows.filter(F.col(column).isin(list(wanted))) if wanted else rows
    if not limit:
        return rows
    size = reduce(lambda a, b: a + b, [F.coalesce(F.length(c), F.lit(0)) for c in ("prompt", "completion", "chosen", "rejected") if c in rows.columns], F.lit(0))
    return rows.orderBy(*([size.desc()] if longest else []), *order).limit(limit)
