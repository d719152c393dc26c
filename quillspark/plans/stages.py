"""The corpus build in stages, each written as Parquet so that a later run can start from any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions import answers
from quillspark.functions.text import matching_key
from quillspark.operators import curate, decontaminate, dedup, splits

STAGES = ("unified", "deduped", "verified", "pairs", "splits")
STRATA = ["pool", "source", "answer_type", "verifiable"]


def _voting(records: DataFrame) -> DataFrame:
    """records as dedup takes them: with key, solution and the vote of a canonical answer."""
    rows = answers.canonical(records, "final_answer", "answer_type", out="_canon")
    return rows.withColumn("vote_key", F.col("_canon.key")).withColumn("solution", F.col("solution_bn")).withColumn("key", matching_key("question_bn")).drop("_canon")


def evals_from(questions: DataFrame) -> DataFrame:
    """(ord, benchmark, key) of questions (benchmark, ord, question): one row per key, the first benchmark owns it."""
    keyed = questions.select("benchmark", "ord", matching_key("question").alias("key")).where("key != ''")
    one = keyed.groupBy("key").agg(F.min_by("benchmark", "ord").alias("benchmark"), F.min("ord").alias("o"))
    return one.select(F.concat(F.lpad(F.col("o").cast("string"), 9, "0"), F.lit(":"), F.md5(F.col("key").cast("binary"))).alias("ord"), "benchmark", "key")


def build(spark: SparkSession, master: DataFrame, evals: DataFrame, lineage: DataFrame, loaded: DataFrame, out: str, start: int = 1, dropped_sources: tuple[str, ...] = (), keep_unverifiable: bool = False) -> dict[str, DataFrame]:
    """Stage to frame, in the order of STAGES; stages before start (from 1) are read from out.

    The order matters: a split of records that are later removed would not be frozen. unified holds
    dropped rows too, with their drop_reason.
    """

    def unified() -> DataFrame:
        return curate.build_records(master, dropped_sources)

    def deduped() -> DataFrame:
        rows = _voting(got["unified"].where("drop_reason is null").drop("drop_reason"))
        return dedup.dedup(rows).drop("vote_key", "solution")

    def verified() -> DataFrame:
        slim = got["deduped"].select("id", "source", "key")
        good = decontaminate.clean(slim, evals, lineage, loaded, keep_unverifiable=keep_unverifiable)
        return got["deduped"].join(good.select("id"), "id", "left_semi").drop("key")

    def pairs() -> DataFrame:
        return curate.script_pairs(got["verified"])

    def split() -> DataFrame:
        return splits.assign(got["verified"].select("id", *STRATA), STRATA, splits.bucket("id")).select("id", "pool", "split")

    got: dict[str, DataFrame] = {}
    for i, (name, stage) in enumerate(zip(STAGES, (unified, deduped, verified, pairs, split), strict=True), 1):
        path = f"{out.rstrip('/')}/{name}"
        if i >= start:
            stage().write.mode("overwrite").parquet(path)
        got[name] = spark.read.parquet(path)
    return got


def counts(got: dict[str, DataFrame]) -> DataFrame:
    """(stage, n): rows each stage kept."""
    parts = [df.where("drop_reason is null") if "drop_reason" in df.columns else df for df in got.values()]
    each = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in zip(got, parts, strict=True)]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out
