"""Frozen splits and samples: by a hash of the id within strata."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from quillspark.operators.columns import fresh, ranked


def bucket(id_: str, salt: str = "split") -> Column:
    """A share of one from a keyed 64-bit BLAKE2b of salt:id, big-endian."""

    @F.pandas_udf(DoubleType())
    def one(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: int.from_bytes(hashlib.blake2b(f"{salt}:{x}".encode(), digest_size=8).digest(), "big") / 2**64)

    return one(F.col(id_).cast("string"))


def hash_order(id_: str, salt: str = "split") -> Column:
    """An order from MD5, for use without Python."""
    return F.md5(F.concat(F.lit(f"{salt}:"), F.col(id_).cast("string")))


def assign(rows: DataFrame, strata: list[str], order: Column, id_: str = "id", val: float = 0.05, test: float = 0.05, least: int = 10) -> DataFrame:
    """rows with split: in each stratum the first round(n*test) are test, the next round(n*val) val; small strata all train.

    order: bucket() or hash_order(). Null is a value of a stratum like any other.
    """
    found, r, n = ranked(rows, strata, order, id_)
    t, v = F.rint(F.col(n) * test), F.rint(F.col(n) * val)
    split = F.when(F.col(n) < least, "train").when(F.col(r) <= t, "test").when(F.col(r) <= t + v, "val").otherwise("train")
    return found.select(*[c for c in rows.columns if c != "split"], split.alias("split"))


def checksum(ids: Column) -> Column:
    """Aggregate: 16 hex digits of the SHA-256 of the sorted ids, joined by line feeds. Gathers a split's ids in one row: for splits as frozen before."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(ids.cast("string"))), "\n"), 256), 1, 16)


#: Leading hexadecimal digits of an id's MD5 that name its part in a checksum by parts.
PART_DIGITS = 3


def checksum_by_parts(rows: DataFrame, by: list[str], id_: str) -> DataFrame:
    """(by, checksum): as checksum, over the checksums of the 4,096 parts that the ids' hashes deal them to; no row holds a split."""
    part, own, whole = fresh(rows, "part", "own", "checksum")
    dealt = rows.select(*by, F.substring(F.md5(F.col(id_).cast("string")), 1, PART_DIGITS).alias(part), id_)
    each = dealt.groupBy(*by, part).agg(checksum(F.col(id_)).alias(own))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(part, own))), lambda x: F.concat_ws(":", x[part], x[own])), "\n")
    return each.groupBy(*by).agg(F.substring(F.sha2(lines, 256), 1, 16).alias(whole))


def sample(rows: DataFrame, stratum: str, n: int, seed: int = 0, id_: str = "eval_id") -> DataFrame:
    """About n rows, evenly over strata (at least one of each; null is one), topped up from the rest; by a seeded hash."""
    order = hash_order(id_, str(seed))
    groups = rows.select(stratum).distinct().count()
    per = max(1, n // max(1, groups))
    found, r, _ = ranked(rows, [stratum], order, id_)
    first = found.where(F.col(r) <= per)
    rest = found.where(F.col(r) > per).orderBy(order, id_).limit(max(0, n - first.count()))
    return first.unionByName(rest).select(*rows.columns).orderBy(id_)
