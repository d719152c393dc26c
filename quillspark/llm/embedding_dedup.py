"""Embedding near-dedup by product quantisation: coarse inverted lists, residual codes, exact rerank.

Equal vectors are one class. Centroids and codebooks are fitted on a bounded sample. Each class lies
in the list of its nearest centroid with the codes of its residual and how far they are off. Two
vectors in different lists are at least as far apart as both are from the border between them
together, so a vector probes just the lists whose border is within the link distance, of two lists
one the other, and there only the members that are close enough to that border: no link is lost,
however vectors lie. In a list, distances to all codes come from one lookup table per query; whatever
they don't exclude (the code's error is added, so none is lost) is compared by exact cosine. Counts
and a forest of the links leave a task, never all pairs.

Nulls and edge cases: vectors that are null, empty, zero, or with null or non-finite components link
with nothing and are returned with no links as their own component; vectors of different lengths
don't link with each other; equal vectors do; rows that repeat a vec_id count as one row each and are
returned each; a null vec_id is a component's smallest only where all are null; no vectors give no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import forest, table
from quillspark.llm.vectors import cosines, lengths, load, matrix, meet, sample, steps, unit
from quillspark.operators.cuts import cut
from quillspark.operators.graph import components

COSINE = 0.9
#: Vectors that centroids and codebooks are fitted on, at most.
SAMPLE = 50_000
#: The coarse lists are as many as the root of the number of vectors over this.
ROOT_SHARE = 8
SUBSPACES, CODES = 16, 256
#: Queries whose tables are looked up at once.
AT_ONCE = 64


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """k centres of x, or fewer if it has fewer distinct rows."""
    start = np.unique(x, axis=0)
    centres = start[np.random.default_rng(seed).permutation(len(start))[:k]]
    for _ in range(rounds):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([(x[part] @ centres.T - half).argmax(1) for part in steps(len(x), len(centres))] or [np.zeros(0, np.int64)])


class Quantizer:
    """Coarse centroids and the codebooks of residuals."""

    def __init__(self, x: np.ndarray, lists: int):
        self.centres = kmeans(x, lists)
        residual = x - self.centres[nearest(x, self.centres)]
        self.edges = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
        part = residual[:20_000]
        self.books = [kmeans(part[:, a:b], CODES) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, error): of each residual its code in each subspace, and its distance to what they stand for."""
        codes, off = np.zeros((len(residual), len(self.books)), np.uint8), np.zeros(len(residual))
        for j, book in enumerate(self.books):
            part = residual[:, self.edges[j] : self.edges[j + 1]]
            codes[:, j] = nearest(part, book)
            off += ((part - book[codes[:, j]]) ** 2).sum(1)
        return codes, np.sqrt(off)

    def tables(self, residual: np.ndarray) -> list[np.ndarray]:
        """Of each subspace the squared distances of each code (rows) to each residual."""
        out = []
        for j, book in enumerate(self.books):
            part = residual[:, self.edges[j] : self.edges[j + 1]]
            out.append(((book * book).sum(1)[:, None] - 2 * (book @ part.T) + (part * part).sum(1)).astype(np.float32))
        return out

    def margins(self, v: np.ndarray, own: np.ndarray, to: np.ndarray) -> np.ndarray:
        """How far each row of v, which is in list own, is from the border to each of the lists to."""
        c, square = self.centres, (self.centres * self.centres).sum(1)
        far = square[to] - 2 * (v @ c[to].T) - (square[own] - 2 * (v * c[own]).sum(1))[:, None]
        lists, at = np.unique(own, return_inverse=True)
        apart = np.sqrt(np.maximum(square[lists][:, None] - 2 * c[lists] @ c[to].T + square[to], 1e-18))
        return far / (2 * apart[at])


def asks(own: np.ndarray, lists: int) -> np.ndarray:
    """Whether vectors of list own ask each list: of two lists one asks the other, and each its own."""
    own, other = own[:, None], np.arange(lists)[None]
    return np.where((own + other) % 2 == 0, own <= other, own > other)


def within(tables: list[np.ndarray], codes: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of codes, query) where what the codes stand for is within most of a query, asymmetrically, by table lookup."""
    total = np.take(tables[0], codes[:, 0], axis=0)
    row = np.empty_like(total)
    for j in range(1, len(tables)):
        total += np.take(tables[j], codes[:, j], axis=0, out=row, mode="clip")
    return np.nonzero(total <= (most * most).astype(np.float32)[:, None])


class Tally:
    """Links as they are found: how many each vector has, and what they connect."""

    def __init__(self):
        self.ids, self.n, self.u, self.v = [], [], [], []

    def add(self, x: np.ndarray, y: np.ndarray, x_n: np.ndarray, y_n: np.ndarray) -> None:
        self.ids += [x, y]
        self.n += [y_n, x_n]
        u, v = forest(x, y)
        self.u.append(u)
        self.v.append(v)
        if sum(map(len, self.ids)) > 1 << 20:
            ids, n = self.counts()
            self.ids, self.n = [ids], [n]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        ids, at = np.unique(np.concatenate([*self.ids, np.zeros(0, np.int64)]), return_inverse=True)
        return ids, np.bincount(at, np.concatenate([*self.n, np.zeros(0, np.int64)]), len(ids)).astype(np.int64)

    def rows(self) -> pd.DataFrame:
        ids, n = self.counts()
        none = np.zeros(0, np.int64)
        u, v = forest(np.concatenate([*self.u, none]), np.concatenate([*self.v, none]))
        return pd.concat([pd.DataFrame({"vec_id": ids, "other": -1, "links": n}), pd.DataFrame({"vec_id": u, "other": v, "links": 0})]).astype("int64")


def _links(classes: DataFrame, many: int, cosine: float) -> DataFrame:
    """(vec_id, other, links) of classes (vec_id, v, n) of one length: counts (links > 0) and edges (links 0)."""
    fitted = Quantizer(sample(classes, SAMPLE), max(1, round(math.sqrt(many) / ROOT_SHARE)))
    shared = classes.sparkSession.sparkContext.broadcast(fitted)  # lists x dimensions: the root of all rows
    near = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                q, v = shared.value, unit(matrix(pdf["v"]))
                own = nearest(v, q.centres)
                codes, off = q.encode(v - q.centres[own])
                yield pd.DataFrame({"key": own.astype(np.int32), "vec_id": pdf["vec_id"], "v": pdf["v"], "n": pdf["n"], "codes": [c.tobytes() for c in codes], "off": off})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            q = shared.value
            lists = len(q.centres)
            for part in steps(len(pdf), lists):
                some = pdf.iloc[part]
                v = unit(matrix(some["v"]))
                own = nearest(v, q.centres)
                at, key = np.nonzero(asks(own, lists) & (q.margins(v, own, np.arange(lists)) <= near))
                yield pd.DataFrame({"key": key.astype(np.int32), "vec_id": some["vec_id"].to_numpy()[at], "v": some["v"].to_numpy()[at], "n": some["n"].to_numpy()[at], "own": own[at].astype(np.int32)})

    def compare(key: int, members: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        q, found = shared.value, Tally()
        y0, x0 = matrix(members["v"]), matrix(asking["v"])
        y, x = unit(y0), unit(x0)
        codes = np.frombuffer(b"".join(members["codes"]), np.uint8).reshape(len(members), -1)
        most = near + members["off"].to_numpy(np.float64) + 1e-4
        y_id, x_id = members["vec_id"].to_numpy(np.int64), asking["vec_id"].to_numpy(np.int64)
        y_n, x_n = members["n"].to_numpy(np.int64), asking["n"].to_numpy(np.int64)
        x_own = asking["own"].to_numpy(np.int64)
        for own in np.unique(x_own):
            mine = np.flatnonzero(x_own == own)
            to = np.array([own])
            gap = np.zeros(len(y)) if own == key else q.margins(y, np.full(len(y), key), to)[:, 0]
            edge = np.zeros(len(mine)) if own == key else q.margins(x[mine], np.full(len(mine), own), np.array([key]))[:, 0]
            # Both sides from the border on: a query needs the members up to what is left of the distance.
            mine, edge = mine[np.argsort(edge)], np.sort(edge)
            order = np.argsort(gap)
            gap = gap[order]
            for i in range(0, len(mine), AT_ONCE):
                part = mine[i : i + AT_ONCE]
                some = order[: np.searchsorted(gap, near - edge[i] + 1e-9, "right")]
                if not len(some):
                    break
                a, b = within(q.tables(x[part] - q.centres[key]), codes[some], most[some])
                a, b = some[a], part[b]
                keep = cosines(x0[b], y0[a]) >= cosine
                if own == key:
                    keep &= x_id[b] < y_id[a]
                a, b = a[keep], b[keep]
                found.add(x_id[b], y_id[a], x_n[b], y_n[a])
        return found.rows()

    members = classes.mapInPandas(place, "key int, vec_id long, v binary, n long, codes binary, off double")
    queries = classes.mapInPandas(probe, "key int, vec_id long, v binary, n long, own int")
    return cut(meet(members, queries, compare, "vec_id long, other long, links long"), "links")


def link(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row (vec_id, embedding)."""
    good = cut(load(rows), "vectors")
    # Classes have numbers of their own here, as vec_ids may be null or repeat.
    made = good.groupBy("d", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    classes = cut(made.withColumn("vec_id", F.monotonically_increasing_id()), "classes")
    ids = rows.select(F.col("vec_id").cast("long").alias("vec_id"))
    sizes = {r["d"]: r["count"] for r in classes.groupBy("d").count().collect()}
    alone = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not sizes:
        return alone(ids).withColumn("kept", F.lit(True))
    parts = [_links(classes.where(F.col("d") == d).select("vec_id", "v", "n"), sizes[d], cosine) for d in lengths(classes)]
    found = reduce(DataFrame.unionByName, parts)
    reach = components(found.where("links = 0").select(F.col("vec_id").alias("src"), F.col("other").alias("dst")))
    counts = found.where("links > 0").groupBy("vec_id").agg(F.sum("links").alias("links"))
    named = classes.join(counts, "vec_id", "left").join(reach.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    named = named.select("d", "v", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "root")
    least = named.where("root is not null").groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(least, "root", "left").select("d", "v", "n_links", F.coalesce("component_id", "low").alias("component_id"))
    out = good.join(named, ["d", "v"]).select("vec_id", "n_links", "component_id")
    # The rows left out, by what they hold: a repeated vec_id may have a good vector and a bad one.
    e = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rest = rows.where(F.coalesce((F.size(e) <= 0) | F.exists(e, bad) | F.forall(e, lambda x: x == 0), F.lit(True)))
    rest = alone(rest.select(F.col("vec_id").cast("long").alias("vec_id")))
    return out.unionByName(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, v, len(v) AS d, sqrt(list_dot_product(v, v)) AS s FROM e),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.d = b.d AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.s * b.s) >= 0.9),
r(x, y) AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY 1), l AS (SELECT x, count(*) AS n FROM p GROUP BY 1),
o AS (SELECT vec_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links, CAST(coalesce(least(c.low, vec_id), vec_id) AS BIGINT) AS component_id FROM embeddings LEFT JOIN l ON l.x = vec_id LEFT JOIN c ON c.x = vec_id)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM o"""
