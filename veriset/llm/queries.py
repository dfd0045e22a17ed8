"""The thin ``opN_<name>`` queries over the driver's tables, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, line_dedup, packing, pii, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts, toxicity
from .common import table
from .samples import remainder


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(spark, docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("lang", "char_js", "word_js")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.report(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("n_chunks").cast("long").alias("n_chunks"), F.col("n_removed").cast("long").alias("n_removed"), F.length("text").cast("long").alias("n_chars_kept"), F.md5("text").alias("kept_md5"))


#: Session setting with the path of a token cache to keep; without it a run starts a new one and encodes every content.
TOKEN_CACHE = "spark.veriset.tokenCache"


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, cache = table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(TOKEN_CACHE, None)
    found = token_counts.count_tokens(spark, docs, tokenizer_file("byte_bpe_50k.json"), cache)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"))
    return packing.pack(spark, found)


def _judged(scores: DataFrame, divisor: int, rest: int) -> DataFrame:
    return scores.select("doc_id", (remainder(divisor) == rest).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return _judged(quality_classifier.score(docs, quality_classifier.fit(spark, docs, labels, remainder(3) != 1)), 3, 1)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return _judged(toxicity.score(docs, toxicity.fit(spark, docs, labels, remainder(5) != 0)), 5, 0)


QUERIES = {q.__name__: q for q in (op1_simhash, op2_pii, op3_quality_rules, op4_decontamination, op5_line_dedup, op6_token_counts, op7_suffix_dedup, op8_packing, op9_quality_classifier, op10_toxicity)}

#: White space and the words of a text, in DuckDB.
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _quality_sql() -> str:
    lists = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in quality_rules.COMMON_WORDS.items())
    names = ", ".join(repr(k) for k in quality_rules.COMMON_WORDS)
    keep = [r"[^\p{Lu}]+", r"[^\p{Ll}]+", "[^0-9]+", "[^.,;:!?''\"()\\-]+"]
    counted = ", ".join(f"length(regexp_replace(t, '{p}', '', 'g'))" for p in keep)
    js = lambda p, q: f"""round(sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z:
        CASE WHEN z[1] > 0 THEN z[1] / list_sum({p}) * log2(z[1] / list_sum({p}) / ((z[1] / list_sum({p}) + z[2] / list_sum({q})) / 2)) / 2 ELSE 0 END +
        CASE WHEN z[2] > 0 THEN z[2] / list_sum({q}) * log2(z[2] / list_sum({q}) / ((z[1] / list_sum({p}) + z[2] / list_sum({q})) / 2)) / 2 ELSE 0 END)), 0)), 6)"""  # noqa: E731
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({names}) THEN lang ELSE 'und' END AS lang, {_WORDS} AS w FROM documents),
e AS (SELECT *, CASE lang {lists} ELSE [] END AS listing, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
      CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END AS win FROM d),
tri AS (SELECT doc_id, unnest(win) AS g, generate_subscripts(win, 1) AS i FROM e),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
f AS (SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '{quality_rules.SYMBOLS}', '', 'g')) AS n_symbols,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, length(t) AS n_chars, [{counted}] AS counted,
      list_transform(listing, lambda c: len(list_filter(w, lambda x: x = c))) AS listed, len(list_filter(w, lambda x: list_contains(listing, x))) AS n_hits
      FROM e LEFT JOIN rep USING (doc_id)),
g AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      list_transform(list_concat(counted, [n_chars - word_chars, n_symbols, greatest(word_chars - n_symbols - list_sum(counted), 0)]), lambda x: x::DOUBLE) AS p,
      list_transform(list_append(listed, n_words - n_hits), lambda x: x::DOUBLE) AS q FROM f),
ref AS (SELECT lang, list(s ORDER BY i) AS rp FROM (SELECT lang, i, sum(x) AS s FROM (SELECT lang, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM g WHERE NOT base_failed) GROUP BY lang, i) GROUP BY lang),
ref2 AS (SELECT lang, list(s ORDER BY i) AS rq FROM (SELECT lang, i, sum(x) AS s FROM (SELECT lang, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM g WHERE NOT base_failed) GROUP BY lang, i) GROUP BY lang)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND (n_chars < {quality_rules.MIN_CHARS} OR coalesce({js('p', 'rp')}, 0) <= {quality_rules.MAX_CHAR_JS})
  AND (n_words < {quality_rules.MIN_HIST_WORDS} OR lang = 'und' OR coalesce({js('q', 'rq')}, 0) <= {quality_rules.MAX_WORD_JS}) AS kept
FROM g LEFT JOIN ref USING (lang) LEFT JOIN ref2 USING (lang)"""


_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DECONTAM = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex({_AZ}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, list_filter(string_split_regex({_AZ}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])), ' ') AS g FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'i': i, 'g': array_to_string(w[i:i + n - 1], ' ')}})) AS x FROM d, lens WHERE len(w) >= n),
hits AS (SELECT doc_id, x.i AS i, n, item_id FROM grams JOIN win USING (n) WHERE x.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""

_LINES = rf"""
WITH l AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '(?s).*?(?:\n|[.!?] |$)'), lambda x: x <> '') AS lines FROM documents),
u AS (SELECT doc_id, unnest(lines) AS x, generate_subscripts(lines, 1) AS i FROM l),
v AS (SELECT *, length(x) >= {line_dedup.LONG} AS lng, md5(x) AS h, lead(length(x) >= {line_dedup.LONG}) OVER w AS next_long, coalesce(lag(md5(x)) OVER w, '') AS hp, lead(i) OVER w IS NULL AS last FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, (last OR lng OR coalesce(next_long, false) OR md5(hp || h)[32] IN ({', '.join(repr(c) for c in line_dedup.ENDS)}))::INT AS e FROM v),
c AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS j FROM e),
ch AS (SELECT doc_id, j, string_agg(x, '' ORDER BY i) AS body, count(*) AS n FROM c GROUP BY doc_id, j),
r AS (SELECT *, length(body) >= {line_dedup.LEAST} AND (n >= 2 OR length(body) >= {line_dedup.LONG}) AND row_number() OVER (PARTITION BY body, length(body) >= {line_dedup.LEAST} AND (n >= 2 OR length(body) >= {line_dedup.LONG}) ORDER BY doc_id, j) > 1 AS gone FROM ch),
k AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(body, '' ORDER BY j) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_chunks, 0)::BIGINT AS n_chunks, coalesce(n_removed, 0)::BIGINT AS n_removed, length(coalesce(kept, ''))::BIGINT AS n_chars_kept, md5(coalesce(kept, '')) AS kept_md5 FROM l LEFT JOIN k USING (doc_id)"""

ORACLES = {"op3_quality_rules": _quality_sql(), "op4_decontamination": _DECONTAM, "op5_line_dedup": _LINES}
