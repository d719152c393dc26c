"""Connected components by alternating star operations, each round cut to shared storage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quillspark.operators.cuts import cut, remove


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, of each node the smallest one of its component, after the edges a-b are added."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _stars(edges: DataFrame) -> bool:
    """True if each node has one target and no target is itself a source."""
    n = edges.agg(F.count("u").alias("n"), F.count_distinct("u").alias("d")).first()
    if n["n"] != n["d"]:
        return False
    return edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root): every node that has an edge to another one, root the smallest node reachable.

    Edges are undirected; loops, repeats and edges with a null end are ignored; no edges give no
    rows. Each round is one large-star and one small-star: minima are taken by partial aggregation
    and joined back, so a hub of many edges is pre-aggregated and its join can be split by AQE.
    The number of edges never grows, and rounds grow with the logarithm of the longest chain.
    """
    a, b = F.col(src), F.col(dst)
    now = cut(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        remove(now.sparkSession, now.cut_path)
        now = new
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
