"""SimHash near-dedup: 64-bit fingerprints linked within 3 bits by meet-in-the-middle ball hashing.

Two fingerprints within 3 bits meet at a variant that is one flip from one of them and at most two
from the other. Fingerprints of even parity emit their variants of up to one flip, those of odd
parity also the variants of two flips within the same 32-bit half: of three differing bits two lie
in one half, so every pair still meets. Variants are shuffled by their top bits: one row of a
fingerprint stands for all its variants below a prefix, which the receiving task writes out.

Nulls and edge cases: null or wordless text has fingerprint zero and links like any other; texts of
one or two words hash their whole sequence; rows with equal doc_id are judged by each own text and
share the id; a null doc_id is never a component's smallest id unless all are null; no documents
give no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import as_bytes, forest, one_of_each, table
from quillspark.operators.cuts import cut
from quillspark.operators.graph import components

SEED = 42
RADIUS = 3
#: Variants a task holds at once, about 30 bytes each.
VARIANTS_PER_BUCKET = 2_000_000
HALF = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """The fingerprint of one text."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= width:
        spans = [(0, len(flat))]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        spans = zip((end - size)[: -width + 1].tolist(), end[width - 1 :].tolist(), strict=True)
    xx = xxhash.xxh64_intdigest
    h = np.array([xx(flat[a:b], SEED) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), HALF):
        ones += np.unpackbits(h[i : i + HALF].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.array([fingerprint(x) for x in as_bytes(batch.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), batch.column(2)], ["doc_id", "fp", "th"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, th): the fingerprint's bits as a signed long, a hash of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th")).mapInArrow(_fingerprints, "doc_id long, fp long, th long")


def _flips(bits: range, many: int) -> np.ndarray:
    """Masks of up to two flips among bits; two only within one 32-bit half."""
    one = [1 << i for i in bits]
    two = [1 << i | 1 << j for i in bits for j in bits if i < j and i // 32 == j // 32] if many > 1 else []
    return np.array([0, *one, *two], np.uint64)


def _spread(top: int):
    """Rows (bucket, fp) of each fingerprint for every prefix of top bits that its variants have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low = np.uint64(64 - top)
        masks = [_flips(range(64 - top, 64), many) >> low for many in (1, 2)] if top else [np.zeros(1, np.uint64)] * 2
        for pdf in batches:
            fp = pdf["fp"].to_numpy().view(np.uint64)
            odd = np.bitwise_count(fp) % 2 == 1
            for which, mask in ((~odd, masks[0]), (odd, masks[1])):
                mine = fp[which]
                prefix = mine >> low if top else np.zeros(len(mine), np.uint64)
                yield pd.DataFrame({"bucket": (prefix[:, None] ^ mask).ravel().astype(np.int64), "fp": np.repeat(mine, len(mask)).view(np.int64)})

    return run


def links_in_bucket(bucket: int, fp: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between fingerprints that share a variant whose top bits are bucket, as a local forest.

    Every variant links all that reach it to one that reaches it by at most one flip; whoever
    reaches it by two is then within three bits. Each edge is verified.
    """
    low = 64 - top
    fp = np.unique(fp)
    odd = np.bitwise_count(fp) % 2 == 1
    used = np.bitwise_count((fp >> np.uint64(low)) ^ np.uint64(bucket)) if top else np.zeros(len(fp), np.uint8)
    moved = fp & np.uint64((1 << low) - 1) | (np.uint64(bucket) << np.uint64(low) if top else np.uint64(0))
    every, high = _flips(range(low), 2), _flips(range(32, low), 1)[1:]
    one = _flips(range(low), 1)
    near, far = [], []  # reached by at most one flip; by two
    index = np.arange(len(fp))
    for which, masks, into in (
        (used == 0, one, near), (used == 1, one[:1], near),
        (odd & (used == 0), every[len(one) :], far), (odd & (used == 1), high, far), (odd & (used == 2), one[:1], far),
    ):
        mine = index[which]
        into.append(((moved[mine][:, None] ^ masks).ravel(), np.repeat(mine, len(masks))))
    parts = near + far
    variant, owner = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    n_near = sum(len(p[0]) for p in near)
    order = np.argsort(variant, kind="stable")  # within a variant, those near it come first
    variant = variant[order]
    new = np.r_[True, variant[1:] != variant[:-1]] if len(variant) else np.zeros(0, bool)
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    u, v = owner[order], owner[first]
    keep = (first < n_near) & (u != v)
    u, v = fp[u[keep]], fp[v[keep]]
    keep = np.bitwise_count(u ^ v) <= RADIUS
    return forest(u[keep].view(np.int64), v[keep].view(np.int64))


def ball_links(fps: DataFrame, n: int) -> DataFrame:
    """(src, dst): edges between distinct fingerprints within 3 bits that connect all that are.

    n: how many there are, which sets the number of prefixes.
    """
    top = min(30, max(0, math.ceil(math.log2(max(1, n * 600 / VARIANTS_PER_BUCKET)))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = links_in_bucket(int(pdf["bucket"].iloc[0]), pdf["fp"].to_numpy().view(np.uint64), top)
        return pd.DataFrame({"src": u, "dst": v})

    spread = fps.select("fp").mapInPandas(_spread(top), "bucket long, fp long")
    return spread.groupBy("bucket").applyInPandas(run, "src long, dst long")


def _rooted(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, th, root, component_id) for each row: root is the smallest fingerprint reachable."""
    own = cut(fingerprints(docs), "fingerprints")
    classes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    reach = components(ball_links(classes, classes.count()))
    rooted = classes.join(reach.withColumnRenamed("node", "fp"), "fp", "left")
    low = rooted.where("root is not null").groupBy("root").agg(F.min("first_id").alias("low"))
    named = rooted.join(low, "root", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("low", "first_id").alias("component_id"))
    return own.join(cut(named, "named"), "fp").select("doc_id", "fp", "th", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row: component_id is the smallest doc_id reachable by links."""
    return _rooted(docs).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component stays, with all its columns: see one_of_each."""
    return one_of_each(docs, _rooted(docs).select("doc_id", "th", F.col("root").alias("component")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
