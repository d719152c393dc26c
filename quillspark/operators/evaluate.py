"""Paired evaluation: tasks, resuming, metrics per benchmark, weighted totals and the guarded verdict."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.functions import answers
from quillspark.functions.text import to_bengali_digits

SCRIPTS = ("ar", "bn")
SYSTEM = "You are a careful assistant for mathematics."
TEMPLATE = "Solve the problem. Put the final answer in \\boxed{{}}.\n\n%s"
METRICS = ("accuracy_ar", "accuracy_bn", "accuracy_gap", "answer_agreement", "both_correct", "correctness_flip", "parseable_ar", "parseable_bn", "truncated_ar", "truncated_bn")


def tasks(records: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Each record in both scripts, without the (eval_id, script) that are done."""
    out = records.withColumn("script", F.explode(F.array(*map(F.lit, SCRIPTS))))
    return out if done is None else out.join(done.select("eval_id", "script").distinct(), ["eval_id", "script"], "left_anti")


def prompt(question: str, template: Callable[[Column, Column], Column] | None = None) -> Column:
    """The prompt of a question: what template makes of the system's and the user's message, else both one after the other."""
    system, user = F.lit(SYSTEM), F.format_string(TEMPLATE.replace("{{}}", "{}"), F.col(question))
    return template(system, user) if template else F.concat(system, F.lit("\n\n"), user, F.lit("\n\n"))


def turns(opening: str = "<|im_start|>", closing: str = "<|im_end|>", thinking: bool = False) -> Callable[[Column, Column], Column]:
    """A chat template of marked turns, for prompt: system, user, and the opening of the answer, with an empty thought unless the model is to think."""

    def make(system: Column, user: Column) -> Column:
        turn = lambda role, said: F.concat(F.lit(f"{opening}{role}\n"), said, F.lit(f"{closing}\n"))
        return F.concat(turn("system", system), turn("user", user), F.lit(f"{opening}assistant\n" + ("" if thinking else "<think>\n\n</think>\n\n")))

    return make


def token_budget(script: Column, max_new: int, matched: bool = True) -> Column:
    """The native script gets half as much again where budgets are matched by content."""
    return F.when((script == "bn") & F.lit(matched), int(max_new * 1.5)).otherwise(max_new)


def generate(todo: DataFrame, model: Callable[[list[str], list[int]], list[tuple[str, int]]], batch: int = 8, tasks: int = 128) -> DataFrame:
    """todo (eval_id, script, prompt, budget) with output, output_tokens and truncated; model answers a batch of one script.

    Questions are dealt to tasks by a hash; a task takes its scripts one after the other.
    """
    schema = todo.select("*", F.lit("").alias("output"), F.lit(0).cast("long").alias("output_tokens"), F.lit(True).alias("truncated")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for _, own in pdf.groupby("script", sort=True):
                for i in range(0, len(own), batch):
                    part = own.iloc[i : i + batch]
                    got = model(part["prompt"].tolist(), part["budget"].tolist())
                    yield part.assign(output=[g[0] for g in got], output_tokens=[g[1] for g in got], truncated=[g[1] >= b for g, b in zip(got, part["budget"], strict=True)])

    return todo.repartition(tasks, "eval_id").sortWithinPartitions("script").mapInPandas(run, schema)


def grade(results: DataFrame) -> DataFrame:
    """results (output, gold_answer, answer_type, ...) with correct, reason, predicted_raw, predicted_canonical, extraction_method."""
    got = answers.verify(results, "output", "gold_answer", "answer_type", out="_v")
    v = got["_v"]
    return got.select(*results.columns, v["correct"].alias("correct"), v["reason"].alias("reason"), v["raw"].alias("predicted_raw"), v["pred_key"].alias("predicted_canonical"), v["method"].alias("extraction_method"))


def last_lines(log: DataFrame, seq: str = "seq") -> DataFrame:
    """Of each (benchmark, eval_id, script) the row with the largest seq."""
    rest = [c for c in log.columns if c not in ("benchmark", "eval_id", "script")]
    last = log.groupBy("benchmark", "eval_id", "script").agg(F.max_by(F.struct(*rest), seq).alias("_r"))
    return last.select("benchmark", "eval_id", "script", *[F.col("_r")[c].alias(c) for c in rest])


def paired(rows: DataFrame) -> DataFrame:
    """One row per (benchmark, eval_id) that has both scripts: correct, canonical, parsed and truncated of each."""
    one = lambda c, s: F.max(F.when(F.col("script") == s, F.col(c)))
    aggs = [one(c, s).alias(f"{c}_{s}") for s in SCRIPTS for c in ("correct", "predicted_canonical", "extraction_method", "truncated")]
    return rows.groupBy("benchmark", "eval_id").agg(F.count_distinct("script").alias("_n"), *aggs).where("_n = 2").drop("_n")


def metrics(pairs: DataFrame) -> DataFrame:
    """Per benchmark n_paired and METRICS; two missing answers agree."""
    share = lambda c: F.avg(c.cast("double"))
    a, b = F.col("correct_ar"), F.col("correct_bn")
    return pairs.groupBy("benchmark").agg(
        F.count("*").alias("n_paired"), share(a).alias("accuracy_ar"), share(b).alias("accuracy_bn"), (share(a) - share(b)).alias("accuracy_gap"),
        share(F.col("predicted_canonical_ar").eqNullSafe(F.col("predicted_canonical_bn"))).alias("answer_agreement"), share(a & b).alias("both_correct"), share(a != b).alias("correctness_flip"),
        *[share(F.col(f"extraction_method_{s}").isNotNull()).alias(f"parseable_{s}") for s in SCRIPTS], *[share(F.col(f"truncated_{s}")).alias(f"truncated_{s}") for s in SCRIPTS],
    )


def overall(summary: DataFrame, by: list[str] | None = None) -> DataFrame:
    """METRICS weighted by n_paired, over all benchmarks (of each value of by)."""
    n = F.col("n_paired")
    return summary.groupBy(*(by or [])).agg(F.sum(n).alias("n_paired"), *[(F.sum(F.col(m) * n) / F.sum(n)).alias(m) for m in METRICS])


def verdict() -> Column:
    """Of a row of METRICS: blocked by parsing, truncation or accuracy, else the agreement's level."""
    agreement = F.when(F.col("answer_agreement") >= 0.95, "consistent").when(F.col("answer_agreement") >= 0.85, "mostly_consistent").otherwise("inconsistent")
    return (
        F.when(F.least("parseable_ar", "parseable_bn") < 0.5, "blocked_parse_rate")
        .when(F.col("truncated_bn") > 0.3, "blocked_truncation")
        .when(F.greatest("accuracy_ar", "accuracy_bn") < 0.15, "blocked_accuracy_floor")
        .otherwise(agreement)
    )


def compare_models(summaries: DataFrame) -> DataFrame:
    """(model, n_paired, METRICS, verdict) over summaries, one row per (model, benchmark); the verdict is always guarded."""
    return overall(summaries, ["model"]).withColumn("verdict", verdict())


def parse_rates(graded: DataFrame, by: list[str]) -> DataFrame:
    """(by, extraction_method, n, share, low): how answers were found in each group; low where under half were found at all."""
    n = graded.groupBy(*by).agg(F.count("*").alias("_n"), F.avg(F.col("extraction_method").isNotNull().cast("double")).alias("_found"))
    each = graded.groupBy(*by, "extraction_method").agg(F.count("*").alias("n"))
    return each.join(n, by).select(*by, "extraction_method", "n", (F.col("n") / F.col("_n")).alias("share"), (F.col("_found") < 0.5).alias("low"))


def report(log: DataFrame, seq: str = "seq") -> DataFrame:
    """(benchmark, n_paired, METRICS, verdict) of a result log, and the weighted total as benchmark OVERALL.

    Of repeated lines the last counts; questions with one script alone don't.
    """
    each = metrics(paired(last_lines(log, seq)))
    total = overall(each).where("n_paired > 0").withColumn("benchmark", F.lit("OVERALL"))
    return each.withColumn("benchmark", F.col("benchmark").cast("string")).unionByName(total).withColumn("verdict", verdict())


#: Numbers that show how digits are grouped into tokens.
PROBE_NUMBERS = ("0", "7", "12", "42", "100", "365", "1000", "2026", "12345", "3.14", "1000000")


def probes(spark: SparkSession, count: Callable[[Column], Column] = F.octet_length) -> DataFrame:
    """(number, tokens_ar, tokens_bn, ratio) of PROBE_NUMBERS in both scripts; count gives a text's tokens."""
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, PROBE_NUMBERS))).alias("number"))
    rows = rows.select("number", count(F.col("number")).cast("long").alias("tokens_ar"), count(to_bengali_digits("number")).cast("long").alias("tokens_bn"))
    return rows.withColumn("ratio", F.col("tokens_bn") / F.greatest("tokens_ar", F.lit(1)))


def sanity(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(n, missing): rows, and the required columns that aren't there; an empty input, or one that lacks any, is no input."""
    return df.agg(F.count("*").alias("n")).withColumn("missing", F.array(*map(F.lit, missing_columns(df, required))).cast("array<string>"))


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    """Required names that df has no column of."""
    return [c for c in required if c not in df.columns]


def ratios(pairs: DataFrame) -> DataFrame:
    """pairs (benchmark, tokens_ar, tokens_bn, fertility_ar, fertility_bn) with length_ratio, fertility_ratio and what the latter means."""
    rows = pairs.withColumn("length_ratio", F.col("tokens_bn") / F.greatest("tokens_ar", F.lit(1))).withColumn("fertility_ratio", F.col("fertility_bn") / F.greatest("fertility_ar", F.lit(1e-9)))
    r = F.col("fertility_ratio")
    return rows.withColumn("meaning", F.when(r >= 2.0, "strong").when(r >= 1.25, "moderate").otherwise("weak"))


def worst(ratio_rows: DataFrame) -> DataFrame:
    """(benchmark, fertility_ratio, meaning) of the largest fertility_ratio, the first name of equals."""
    best = F.min_by(F.struct("benchmark", "fertility_ratio", "meaning"), F.struct((-F.col("fertility_ratio")).alias("r"), "benchmark"))
    return ratio_rows.agg(best.alias("w")).select("w.*")


def fertility(rows: DataFrame, text: str, count: Callable[[Column], Column] = F.octet_length) -> DataFrame:
    """n, tokens and digit_fertility of a text column: tokens of its digit runs over its digits; count gives a text's tokens."""
    runs = F.regexp_extract_all(F.col(text), F.lit("([0-9০-৯]+)"), F.lit(1))
    digits = F.regexp_count(F.col(text), F.lit(r"\p{Nd}"))
    in_runs = F.aggregate(runs, F.lit(0), lambda s, r: s + count(r))
    return rows.agg(F.count("*").alias("n"), F.avg(count(F.col(text))).alias("mean_tokens"), (F.sum(in_runs) / F.greatest(F.sum(digits), F.lit(1))).alias("digit_fertility"))
