"""Embeddings as blobs, and the meeting of queries with members in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Rows of each side that one task holds at once.
BLOCK = 4096
#: Distances of rows to pivots or centroids, which grow with the root of all rows, that are held at once.
CELLS = 1 << 22


def load(rows: DataFrame) -> DataFrame:
    """(vec_id, d, v): embeddings of d components as blobs of doubles.

    Vectors that are null, empty, zero, or hold null or non-finite components are left out.
    """
    e = F.col("embedding").cast("array<double>")
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).where(F.col("e").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = [np.asarray(x, np.float64) for x in pdf["e"]]
            good = np.array([bool(np.isfinite(x).all() and x.any()) for x in vectors], bool)
            yield pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy()[good], "d": np.array([len(x) for x in vectors], np.int32)[good], "v": [x.tobytes() for x, ok in zip(vectors, good.tolist(), strict=True) if ok]})

    return base.where((F.size("e") > 0) & ~F.exists("e", lambda x: x.isNull())).mapInPandas(run, "vec_id long, d int, v binary")


def lengths(vectors: DataFrame) -> list[int]:
    """The lengths that occur: cosines exist within one only, so each is worked on by itself."""
    return sorted(r["d"] for r in vectors.select("d").distinct().collect())


def matrix(blobs: pd.Series) -> np.ndarray:
    """The vectors, each times a power of two (which changes no cosine, not even its rounding) so that no square over- or underflows."""
    m = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    return np.ldexp(m, -np.frexp(np.abs(m).max(1, keepdims=True))[1])


def steps(rows: int, others: int) -> Iterator[slice]:
    """The rows in slices of which each has about CELLS distances to the others."""
    step = max(1, CELLS // max(1, others))
    for i in range(0, rows, step):
        yield slice(i, i + step)


def norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(1))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    return m / norms(m)[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x and the same row of y, on the vectors as they are."""
    return (x * y).sum(1) / (norms(x) * norms(y))


def sample(vectors: DataFrame, most: int) -> np.ndarray:
    """Unit vectors of up to ``most`` rows, those whose ids hash lowest."""
    rows = vectors.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toPandas()
    return unit(matrix(rows["v"])) if len(rows) else np.zeros((0, 0))


def meet(members: DataFrame, queries: DataFrame, fn: Callable[[int, pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int = BLOCK) -> DataFrame:
    """fn(key, members, queries) for each pair of blocks of members and queries with the same key.

    Both sides have a column key (as many as the root of all rows, about) and vec_id; other columns
    may differ. A key with many rows is dealt out to many tasks, whatever its share of all rows.
    """
    spark = members.sparkSession
    count = lambda df: {r["key"]: -(-r["count"] // block) for r in df.groupBy("key").count().collect()}
    m, q = count(members), count(queries)
    both = [(k, m[k], q[k]) for k in m.keys() & q.keys()]
    sizes = F.broadcast(spark.createDataFrame(both, "key int, mb int, qb int"))
    names = list(dict.fromkeys([*members.columns, *queries.columns]))
    kinds = dict(members.dtypes) | dict(queries.dtypes)

    def side(df: DataFrame, own: str, other: str, is_query: bool) -> DataFrame:
        at = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col(own)).cast("int")
        df = df.join(sizes, "key").withColumn("_own", at).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        cols = [(F.col(c) if c in df.columns else F.lit(None).cast(kinds[c])).alias(c) for c in names]
        a, b = ("_other", "_own") if is_query else ("_own", "_other")
        return df.select(*cols, F.col(a).alias("_m"), F.col(b).alias("_q"), F.lit(is_query).alias("_query"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_query = pdf["_query"].to_numpy(bool)
        return fn(int(pdf["key"].iloc[0]), pdf[~is_query].reset_index(drop=True), pdf[is_query].reset_index(drop=True))

    rows = side(members, "mb", "qb", False).unionByName(side(queries, "qb", "mb", True))
    return rows.groupBy("key", "_m", "_q").applyInPandas(run, schema)
