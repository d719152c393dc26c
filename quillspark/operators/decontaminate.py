"""Benchmark decontamination: exact, near, by lineage; the first reason that holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.operators.dedup import similar_texts


def owners(evals: DataFrame) -> DataFrame:
    """(key, exact_benchmark): which of evals (ord, benchmark, key) owns each key, the first registered."""
    return evals.where("key != ''").groupBy("key").agg(F.min_by("benchmark", "ord").alias("exact_benchmark"))


def exact(train: DataFrame, evals: DataFrame) -> DataFrame:
    """train (..., key) with exact_benchmark, null where no benchmark has the key."""
    return train.join(owners(evals), "key", "left")


def reasons(train: DataFrame, evals: DataFrame, lineage: DataFrame, loaded: DataFrame, threshold: float = 0.8) -> DataFrame:
    """train (id, source, key) with reason (exact, near, lineage, lineage_unverifiable or null) and benchmark.

    evals: (ord, benchmark, key), ord the order of registration, the first owner wins. lineage:
    (source, derived_key, parent_key, parent_benchmark), one row per derived key. loaded: benchmark.
    An empty evals raises: nothing could be told from it.
    """
    if evals.isEmpty():
        raise ValueError("no benchmark is loaded: refusing to call anything clean")
    first = owners(evals)
    hit = exact(train, evals)
    open_ = hit.where("exact_benchmark is null").select("id", "key")
    near = similar_texts(open_, evals.select(F.col("ord").alias("id"), "key"), threshold)
    owner = near.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("ord")).join(evals.select("ord", F.col("benchmark").alias("near_benchmark")), "ord").drop("ord")
    hit = hit.join(owner, "id", "left")
    line = lineage.select("source", F.col("derived_key").alias("key"), "parent_key", "parent_benchmark")
    parents = first.select(F.col("key").alias("parent_key"), F.col("exact_benchmark").alias("lineage_benchmark"))
    hit = hit.join(line, ["source", "key"], "left").join(parents, "parent_key", "left").join(loaded.select(F.col("benchmark").alias("parent_benchmark"), F.lit(True).alias("is_loaded")), "parent_benchmark", "left")
    reason = (
        F.when(F.col("exact_benchmark").isNotNull(), "exact")
        .when(F.col("near_benchmark").isNotNull(), "near")
        .when(F.col("lineage_benchmark").isNotNull(), "lineage")
        .when(F.col("parent_benchmark").isNotNull() & F.col("is_loaded").isNull(), "lineage_unverifiable")
    )
    return hit.select(*train.columns, reason.alias("reason"), F.coalesce("exact_benchmark", "near_benchmark", "lineage_benchmark").alias("benchmark"))


def clean(train: DataFrame, evals: DataFrame, lineage: DataFrame, loaded: DataFrame, threshold: float = 0.8, keep_unverifiable: bool = False) -> DataFrame:
    """The rows of train with no reason to go."""
    got = reasons(train, evals, lineage, loaded, threshold)
    return got.where(F.col("reason").isNull() | (F.lit(keep_unverifiable) & (F.col("reason") == "lineage_unverifiable"))).select(*train.columns)
