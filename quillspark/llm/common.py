"""What several operators of this subpackage use."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.operators.columns import fresh
from quillspark.operators.cuts import cut

#: ASCII white space of the word patterns: \x20 and \x09-\x0D, as bytes.split() takes it.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the edges u-v as edges (node, smallest node), at most one per node."""
    if not len(u):
        return u[:0], v[:0]
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def row_key(doc_id: str, text_hash) -> F.Column:
    """What tells rows apart but for repeats of both doc_id and text: both in one string."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), text_hash)


def one_of_each(docs: DataFrame, named: DataFrame) -> DataFrame:
    """One row of docs (doc_id, text, ...) for each component of named (doc_id, th, component), th a hash of the text.

    It is the row with the smallest doc_id, null last, and the smallest th where that repeats; of rows
    that repeat both, one.
    """
    rows = cut(named.groupBy("component", "doc_id", "th").agg(F.count("*").alias("n")), "components")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("f"))
    first = first.select("component", row_key("f.doc_id", F.col("f.th")).alias("first_row"))
    (key,) = fresh(docs, "row_key")
    marked = rows.withColumn(key, row_key("doc_id", F.col("th"))).join(first, "component").select(key, "n", (F.col(key) == F.col("first_row")).alias("stays"))
    given = docs.withColumn(key, row_key("doc_id", F.xxhash64("text")))
    # Most rows stay and occur once: they are those that are neither gone nor repeated.
    plain = given.join(marked.where("not stays or n > 1").select(key), key, "left_anti")
    again = given.join(marked.where("stays and n > 1").select(key), key, "left_semi").dropDuplicates([key])
    return plain.unionByName(again).select(*docs.columns)
