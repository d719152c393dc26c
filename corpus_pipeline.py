"""The corpus pipeline: five operators in a row over documents, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import mixing, sentencepiece_codec, shingle_dedup, substring_dedup, toxicity
from quillspark.llm.common import table
from quillspark.operators.cuts import cut


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return shingle_dedup.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are taken out of the texts."""
    return substring_dedup.strip_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their slot and position in the mixture."""
    return mixing.placed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each text's ids and of what they decode to, with slot and position."""
    return sentencepiece_codec.round_trip(docs, sentencepiece_codec.default_model(), ("slot", "position"))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("source mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: Fingerprints, suffix trees, learned weights and merges aren't SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests in the order of the mixture: files keep no order between stages, so slot and position make it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs.orderBy("slot", "position").drop("slot", "position")
