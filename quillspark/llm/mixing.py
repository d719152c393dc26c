"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions.

Weights are whole numbers; a period has as many slots as they add up to. The k-th block of a source
of weight w may run from slot floor((k-1)*W/w) and is due by ceil(k*W/w); earliest deadline first
among the released fills every slot, so at any slot each source is less than one block from its
share. One period is scheduled once and repeats; the table of it, one row per slot, is bounded and
joined to the documents' blocks. A source that is used up leaves its slots idle: the others keep
their places and proportions. All documents are kept.

Nulls and edge cases: null is a source of its own; documents of a source are dealt in the order of a
hash of doc_id and text, equal rows in any order; sources absent from the given weights raise;
no documents give no rows; other columns are ignored (mix_order) or carried along (mix).
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quillspark.llm.common import table

BLOCK_DOCS = 16
#: Slots of a period, about; sources, at most: their counts and one period's slots are gathered.
PERIOD, MAX_SOURCES = 1000, 10_000


def schedule(weights: list[int]) -> list[tuple[int, int, int]]:
    """(source, which of its blocks, slot) for each slot of one period."""
    if any(w < 1 for w in weights):
        raise ValueError("weights are whole numbers from 1")
    total = sum(weights)
    waiting = [(0, i, 1) for i in range(len(weights))]  # release, source, k
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-k * total // weights[i]), -weights[i], i, k))
        due, _, i, k = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline was missed")
        out.append((i, k - 1, slot))
        if k < weights[i]:
            heapq.heappush(waiting, (k * total // weights[i], i, k + 1))
    return out


def default_weights(counts: dict[str | None, int], period: int = PERIOD) -> dict[str | None, int]:
    """Shares by the square root of each source's number of documents: large sources are damped."""
    total = sum(math.sqrt(n) for n in counts.values())
    return {s: max(1, round(period * math.sqrt(n) / total)) for s, n in counts.items()}


def _key(source: Column) -> Column:
    """A source's name that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _placed(docs: DataFrame, weights: dict[str | None, int] | None, block_docs: int, carried: list[str]) -> DataFrame:
    """(row, source, block, slot, position) of docs, row being the columns carried along in one."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*carried).alias("row"), "source", _key(F.col("source")).alias("s"), "doc_id", F.xxhash64("doc_id", "text").alias("h"))
    found = {r["s"]: r["count"] for r in rows.groupBy("s").count().limit(MAX_SOURCES + 1).collect()}
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = sorted(found)
    given = {None if s == "null" else s[1:]: n for s, n in found.items()}
    weights = default_weights(given) if weights is None else weights
    own = [weights[None if s == "null" else s[1:]] for s in names]
    # Ranks in a source without one task for it: by ranges of the hash, then within each. A source has the root
    # of its rows of them, so neither the ranges nor the rows of one are many.
    sizes = ", ".join(f"('{s}', {math.ceil(math.sqrt(found[s]))}L, {w}L)" for s, w in zip(_quoted(names), own, strict=True)) or "('', 1L, 1L)"
    rows = rows.join(F.broadcast(spark.sql(f"SELECT * FROM VALUES {sizes} AS t(s, parts, w)")), "s")
    rows = rows.withColumn("part", F.floor(F.shiftrightunsigned("h", 34) * F.col("parts") / (1 << 30)).cast("long"))
    each = rows.groupBy("s", "part").agg(F.count("*").alias("own"))
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = each.select("s", "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("s", "part").orderBy("h", "doc_id")
    rows = rows.withColumn("rank", F.row_number().over(within)).join(start, ["s", "part"])
    rank = F.col("start") + F.col("rank") - 1
    rows = rows.withColumn("block", F.floor(rank / block_docs)).withColumn("position", (rank % block_docs).cast("int"))
    period = schedule(own) if own else []
    slots = ", ".join(f"({i}, {k}L, {slot}L)" for i, k, slot in period) or "(0, 0L, 0L)"
    order = spark.sql(f"SELECT * FROM VALUES {slots} AS t(i, k, at)")
    index = spark.sql("SELECT * FROM VALUES " + (", ".join(f"('{s}', {i})" for i, s in enumerate(_quoted(names))) or "('', 0)") + " AS t(s, i)")
    order = order.join(F.broadcast(index), "i").drop("i")
    rows = rows.withColumn("k", F.col("block") % F.col("w")).join(F.broadcast(order), ["s", "k"])
    return rows.select("row", "source", "block", (F.floor(F.col("block") / F.col("w")) * sum(own) + F.col("at")).alias("slot"), "position")


def _quoted(names: list[str]) -> list[str]:
    return [s.replace("\\", "\\\\").replace("'", "\\'") for s in names]


def mix_order(docs: DataFrame, weights: dict[str | None, int] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(doc_id, source, block, slot, position): slot orders the mixture, position the documents of a block."""
    rows = _placed(docs, weights, block_docs, ["doc_id"])
    return rows.select(F.col("row.doc_id").alias("doc_id"), "source", "block", "slot", "position")


def placed(docs: DataFrame, weights: dict[str | None, int] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All rows of docs with slot and position, which order the mixture however the rows are stored and read; given columns of these names are replaced."""
    kept = [c for c in docs.columns if c.lower() not in ("slot", "position")]
    return _placed(docs, weights, block_docs, kept).select(*[F.col("row")[c].alias(c) for c in kept], "slot", "position")


def mix(docs: DataFrame, weights: dict[str | None, int] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All rows of docs in the mixture's order: partitions follow each other, rows in them too."""
    rows = _placed(docs, weights, block_docs, docs.columns)
    return rows.repartitionByRange("slot").sortWithinPartitions("slot", "position").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_order(table(spark, sf_dir, "documents"))
