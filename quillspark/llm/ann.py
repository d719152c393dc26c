"""Approximate nearest neighbours by a permutation index.

Pivots, twice the root of the number of vectors, are a bounded sample of them. Each vector is
represented by its nearest pivots in order (LENGTH of them) and posted in the inverted files of its
POSTED nearest ones. A query opens the files of its OPENED nearest pivots; a vector found in several
is judged in the one that is nearest to the vector. As pivots grow with the root, the share of all
vectors that a query meets falls with it. What is met is ranked by footrule distance of the two
permutations, and the nearest are reranked by exact cosine: those within the distance that a share
RERANK / root of all vectors has, which the query tells from a bounded sample. Nothing caps the
number of candidates; a query that found fewer than k neighbours is answered by a scan in blocks.

Nulls and edge cases: vectors that are null, empty, zero, or with null or non-finite components take
no part; vectors of different lengths aren't neighbours; ties go to the smaller vec_id; fewer than k
candidates are all returned; rows that repeat a vec_id are one candidate each, but none of the query
itself, and a query that is repeated is answered once for all its rows together; a null vec_id is no
query and no candidate; no vectors or no queries give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillspark.llm.common import table
from quillspark.llm.vectors import cosines, lengths, load, matrix, meet, sample, steps, unit
from quillspark.operators.cuts import cut

K = 5
#: Pivots for each root of the number of vectors.
PIVOTS = 2
#: Pivots in a permutation; of which a vector is posted with; whose files a query opens.
LENGTH, POSTED, OPENED = 96, 4, 64
#: The share to be reranked, times the root of the number of vectors; the vectors it is told from, or as many as pivots if more.
RERANK, SAMPLE = 16, 4096
#: Queries judged at once.
AT_ONCE = 256
FOUND = "query_id long, vec_id long, score double"


def number(pivots: int) -> type:
    """The type that names a pivot."""
    return np.uint16 if pivots <= 1 << 16 else np.uint32


def permutations(v: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first."""
    out = np.empty((len(v), length), number(len(pivots)))
    for part in steps(len(v), len(pivots)):
        near = v[part] @ pivots.T
        if length < near.shape[1]:
            some = np.argpartition(-near, length - 1, axis=1)[:, :length]
        else:
            some = np.broadcast_to(np.arange(near.shape[1]), near.shape)
        order = np.lexsort((some, -np.take_along_axis(near, some, 1)), axis=1)
        out[part] = np.take_along_axis(some, order, 1)
    return out


def footrule(mine: np.ndarray, theirs: np.ndarray, pivots: int) -> np.ndarray:
    """The distance of each permutation of mine to each of theirs over the pivots of mine; absent ones stand last."""
    out = np.empty((len(mine), len(theirs)), np.int32)
    length = theirs.shape[1]
    at = np.arange(mine.shape[1], dtype=np.int16)[:, None]
    step = max(64, (1 << 24) // pivots)
    for a in range(0, len(theirs), step):
        part = theirs[a : a + step]
        place = np.full((pivots, len(part)), length, np.int16)
        place[part.ravel(), np.repeat(np.arange(len(part)), length)] = np.tile(np.arange(length, dtype=np.int16), len(part))
        for i, row in enumerate(mine):
            out[i, a : a + step] = np.abs(place[row] - at).sum(0, dtype=np.int32)
    return out


def first_files(mine: np.ndarray, posted: np.ndarray, pivots: int) -> np.ndarray:
    """Of each query (row) and vector the first of the vector's files that the query opens, or -1."""
    opened = np.zeros((len(mine), pivots), bool)
    np.put_along_axis(opened, mine.astype(np.int64), True, 1)
    first = np.full((len(mine), len(posted)), -1, np.int32)
    for j in reversed(range(posted.shape[1])):
        first = np.where(opened[:, posted[:, j]], posted[:, j].astype(np.int32)[None], first)
    return first


def best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """Of pairs (query, vector) the k best of each query: largest score first, then smallest id."""
    order = np.lexsort((ids, -scores, q))
    q = q[order]
    head = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(head, np.arange(len(q)), 0))
    keep = order[rank < k]
    return pd.DataFrame({"query_id": q[rank < k], "vec_id": ids[keep], "score": scores[keep]})


def _scan(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of all v to each of q."""
    out = []
    for i in range(0, len(q), AT_ONCE):
        part, own = q[i : i + AT_ONCE], q_ids[i : i + AT_ONCE]
        rough = unit(part) @ unit(v).T
        rough[own[:, None] == ids] = -9
        least = np.partition(rough, -k, axis=1)[:, -k] if len(v) > k else np.full(len(part), -5.0)
        a, b = np.nonzero((rough >= least[:, None] - 1e-9) & (rough > -5))
        out.append(best(own[a], ids[b], cosines(part[a], v[b]), k))
    return pd.concat(out) if out else best(q_ids[:0], ids[:0], np.zeros(0), k)


def _nearest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(every: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank) within vectors (vec_id, v) of one length."""
    spark, n = every.sparkSession, every.count()
    pivots = max(1, min(round(PIVOTS * math.sqrt(n)), n))
    drawn = sample(every, max(SAMPLE, pivots))
    chosen = drawn[:pivots]
    length, opened, posted = (min(x, pivots) for x in (LENGTH, OPENED, POSTED))
    others = permutations(drawn, chosen, length)
    shared = spark.sparkContext.broadcast((chosen, others))  # pivots x dimensions: the root of all rows
    share = min(1.0, RERANK / math.sqrt(n))

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                perm = permutations(unit(matrix(pdf["v"])), shared.value[0], length)
                at = np.repeat(np.arange(len(pdf)), posted)
                blobs = np.array([x.tobytes() for x in perm], object)
                yield pd.DataFrame({"key": perm[:, :posted].ravel().astype(np.int32), "vec_id": pdf["vec_id"].to_numpy()[at], "v": pdf["v"].to_numpy()[at], "perm": blobs[at]})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), AT_ONCE):
                part = pdf.iloc[i : i + AT_ONCE]
                perm = permutations(unit(matrix(part["v"])), shared.value[0], opened)
                reach = np.quantile(footrule(perm, shared.value[1], pivots), share, axis=1, method="higher") if share < 1 else np.full(len(part), np.inf)
                at = np.repeat(np.arange(len(part)), opened)
                blobs = np.array([x.tobytes() for x in perm], object)
                yield pd.DataFrame({"key": perm.ravel().astype(np.int32), "vec_id": part["vec_id"].to_numpy()[at], "v": part["v"].to_numpy()[at], "perm": blobs[at], "reach": reach[at].astype(np.float64)})

    def judge(key: int, members: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        order = lambda x: np.frombuffer(b"".join(x["perm"]), number(pivots)).reshape(len(x), -1)
        theirs, mine = order(members), order(own)
        v, q = matrix(members["v"]), matrix(own["v"])
        ids, q_ids, reach = members["vec_id"].to_numpy(np.int64), own["vec_id"].to_numpy(np.int64), own["reach"].to_numpy(np.float64)
        out = []
        for i in range(0, len(own), AT_ONCE):
            part = slice(i, i + AT_ONCE)
            allowed = (first_files(mine[part], theirs[:, :posted], pivots) == key) & (q_ids[part, None] != ids)
            allowed &= footrule(mine[part], theirs, pivots) <= reach[part, None]
            a, b = np.nonzero(allowed)
            out.append(best(q_ids[part][a], ids[b], cosines(q[part][a], v[b]), k))
        return pd.concat(out) if out else best(q_ids[:0], ids[:0], np.zeros(0), k)

    kinds = "key int, vec_id long, v binary, perm binary"
    found = meet(every.mapInPandas(post, kinds), asked.mapInPandas(ask, kinds + ", reach double"), judge, FOUND)
    out = cut(_nearest(found, k), "nearest")
    full = out.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = cut(asked.join(full, "vec_id", "left_anti"), "short")
    if short.isEmpty():
        return out
    scan = lambda key, m, q: _scan(q["vec_id"].to_numpy(np.int64), matrix(q["v"]), m["vec_id"].to_numpy(np.int64), matrix(m["v"]), k)
    one = F.lit(0).alias("key")
    rest = _nearest(meet(every.select(one, "*"), short.select(one, "*"), scan, FOUND), k)
    kept = out.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti")
    return kept.unionByName(rest)


def search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest rows; both of columns vec_id and embedding."""
    spark = rows.sparkSession
    every, asked = (cut(load(df).where("vec_id is not null"), name) for df, name in ((rows, "vectors"), (queries, "queries")))
    of = lambda df, d: df.where(F.col("d") == d).select("vec_id", "v")
    parts = [_search(of(every, d), of(asked, d), k) for d in sorted(set(lengths(every)) & set(lengths(asked)))]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = reduce(DataFrame.unionByName, parts)
    out = _nearest(out, k) if len(parts) > 1 else out  # a repeated query may have vectors of several lengths
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 50 = 0"))
