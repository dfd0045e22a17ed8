"""Sources and sinks: benchmark pairs, attribute lists, templates, runs, records, caches. Paths are any that Spark reads."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CSV = {"header": True, "multiLine": True, "escape": '"'}

# Columns of a benchmark file and what they are called here; the last has three spellings.
BENCHMARK = {"candidate_id": "candidate_id", "job_id": "job_id", "CV": "cv", "Job Description": "job_description", "Job Position": "job_position", "lang": "lang", "decision_gpt-4o": "reference_decision"}
FEEDBACK = ["feedback_gpt-4o", "feedbackgpt-4o", "feedback"]


def unique(rows: DataFrame, key: str) -> DataFrame:
    """``rows``, or an error naming keys that occur twice."""
    twice = rows.groupBy(key).count().filter("count > 1").select(key).limit(5).collect()
    if twice:
        raise ValueError(f"{key} occurs more than once: {[r[0] for r in twice]}")
    return rows


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark pairs from CSV, all columns strings, keyed by ``pair_id``."""
    d = spark.read.options(**CSV).csv(path)
    feedback = next((c for c in FEEDBACK if c in d.columns), None)
    if feedback is None:
        raise ValueError(f"{path}: no column of reference feedback")
    d = d.select(*[F.col(f"`{a}`").alias(b) for a, b in BENCHMARK.items()], F.col(f"`{feedback}`").alias("reference_feedback"))
    d = d.withColumn("reference_decision", F.lower(F.trim("reference_decision")))
    return unique(d.select(F.concat_ws("__", "candidate_id", "job_id").alias("pair_id"), *d.columns), "pair_id")


def attributes(spark: SparkSession, path: str, group: str, lang: str) -> DataFrame:
    """(protected_group, lang, ordinal, protected_attr) from a text file, one a line in its order; an empty file is an error."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    d = lines.select("line", F.trim("text").alias("protected_attr")).filter("protected_attr <> ''")
    if d.isEmpty():
        raise ValueError(f"{path}: no attributes")
    # a list is a handful of lines in one file
    return d.select(F.lit(group).alias("protected_group"), F.lit(lang).alias("lang"), (F.row_number().over(Window.orderBy("line")) - 1).alias("ordinal"), "protected_attr")


def templates(spark: SparkSession, path: str) -> DataFrame:
    """(protected_group, protected_attr, sentence) from CSV; spaces of group names become underscores."""
    d = spark.read.options(**CSV).csv(path)
    group, attr, sentence = d.columns[:3]
    return d.select(F.regexp_replace(F.trim(F.col(f"`{group}`")), " ", "_").alias("protected_group"), F.trim(F.col(f"`{attr}`")).alias("protected_attr"), F.col(f"`{sentence}`").alias("sentence"))


def save_run(rows: DataFrame, folder: str, run_name: str, meta: dict) -> None:
    """A run's answers as a partition of the folder's table, its description beside them."""
    rows.write.mode("overwrite").parquet(f"{folder}/responses/run={run_name}")
    rows.sparkSession.createDataFrame([(run_name, json.dumps(meta, ensure_ascii=False, sort_keys=True))], "run string, meta string").coalesce(1).write.mode("overwrite").json(f"{folder}/meta/run={run_name}")


def load_runs(spark: SparkSession, folder: str, runs: list[str] | None = None) -> DataFrame:
    """Answers of all or some runs; the filter on ``run`` prunes folders."""
    d = spark.read.parquet(f"{folder}/responses").withColumn("run", F.col("run").cast("string"))
    return d if runs is None else d.filter(F.col("run").isin(runs))


def write_records(records: DataFrame, path: str) -> None:
    """Records as lines of JSON; NaN becomes null, which JSON has."""
    plain = [F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in records.schema]
    records.select(*plain).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_records(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").options(header=True, escape='"').csv(path)


def run_parts(name: Column) -> list[Column]:
    """Model, language, family and variant of a run's name; missing parts are null."""
    parts = F.split(name, "--", 4)
    return [F.get(parts, i).alias(n) for i, n in enumerate(["model", "lang", "family", "variant"])]


def raw_dumps(spark: SparkSession, folder: str) -> DataFrame:
    """(lang, pass) of the dumps in a folder, from their names alone."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", "*_*.parquet").load(folder).select("path")
    name = F.regexp_extract("path", r"([^/]+)\.parquet$", 1)
    return d.select(F.substring_index(name, "_", 1).alias("lang"), F.regexp_extract(name, "^[^_]+_(.*)$", 1).alias("pass")).distinct()


def content_key(*columns: str) -> Column:
    """What a cached answer is filed under: digest of the columns joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256), 1, 16)


def pending(prompts: DataFrame, done: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each distinct prompt without a stored answer, by content."""
    keyed = prompts.select(*columns).distinct().withColumn("prompt_key", content_key(*columns))
    return keyed.join(done.select("prompt_key").distinct(), "prompt_key", "left_anti")


def write_back(rows: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``value`` from the cache where they have none of their own."""
    c = cache.select(key, F.col(value).alias("__cached")).dropDuplicates([key])
    return rows.join(c, key, "left").withColumn(value, F.coalesce(value, "__cached")).drop("__cached")


def holdout(rows: DataFrame, ids: list[str]) -> DataFrame:
    """(kind, id) of all identifiers that training must not see, once each; sort when writing."""
    return rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("id")) for c in ids])).alias("x")).select("x.kind", "x.id").filter("id is not null").distinct()


def training_curves(runs: DataFrame, history: DataFrame, metrics: list[str]) -> DataFrame:
    """(run, step, metric, value) of each name's newest run, from its wide history; one value a step."""
    newest = runs.groupBy("run").agg(F.max(F.struct("created", "run_id")).alias("x")).select("run", "x.run_id")
    wide = history.join(newest, "run_id").select("run", "step", *[F.col(m).cast("double").alias(m) for m in metrics])
    long = wide.unpivot(["run", "step"], metrics, "metric", "value").filter("step is not null and value is not null")
    return long.groupBy("run", "step", "metric").agg(F.min("value").alias("value"))


def load_config(path: str, read=None) -> dict:
    """A configuration with the ones it names (`audit_config`, `data_config`) nested under `audit` and `data`; those lie beside it. JSON, or YAML where that is installed."""

    def parse(p: str) -> dict:
        with open(p, encoding="utf-8") as f:
            text = f.read()
        if p.endswith(".json"):
            return json.loads(text)
        import yaml

        return yaml.safe_load(text) or {}

    read = read or parse
    base = path.rsplit("/", 1)[0] if "/" in path else "."
    config = dict(read(path))
    for name in ("audit", "data"):
        other = config.get(f"{name}_config")
        if other:
            config[name] = read(other if other.startswith("/") else f"{base}/{other}")
    return config
