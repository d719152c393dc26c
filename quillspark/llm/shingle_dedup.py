"""SimHash near-dedup at a Jaccard similarity of 0.8 or more over five-word shingles, by ball hashing of blocks.

At such a similarity about 15 % of fingerprint bits differ, more than a ball around 64 bits can hold.
So a fingerprint has BLOCKS blocks of BITS bits, and pairs within two bits in any block are wanted:
every block emits its variants of up to one flip, which are shuffled by their top bits, and blocks
that meet at a variant are candidates if a stretch of other bits doesn't tell them apart. Two
fingerprints meet in a block in 19 of 100 cases at a similarity of 0.8, so one pair in 800 meets in
none (sets of under ten shingles, whose bits differ more: up to one in 15), one in 40,000 at 0.85.
Candidates' groups are then dealt to tasks in blocks of bounded size, and every pair there that its
whole fingerprints don't exclude is decided by the exact similarity of its shingle sets, unless
other links already connect it. Equal sets are one class; forests leave a task, never all pairs.

Nulls and edge cases: texts of fewer than five words are their whole sequence; null and wordless
texts are equal to each other only; rows may repeat, and repeat or lack a doc_id; no documents give
no rows; other columns are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import as_bytes, forest, one_of_each
from quillspark.operators.cuts import cut
from quillspark.operators.graph import components

WIDTH, JACCARD = 5, 0.8
BLOCKS, BITS = 32, 28
WORDS = BLOCKS * BITS // 64
#: Differing bits of two check words, and of all words, at most: five deviations above the mean of small sets at 0.8.
CHECK_BITS, MOST_BITS = 38, 242
#: Variants a task holds at once; members of a group that meet in one task.
VARIANTS_PER_BUCKET, MEMBERS = 4_000_000, 2048
#: Members of a variant compared all with all; larger ones by leaders first.
SMALL = 64
#: Shingles whose bits are added up at once.
SLICE = 255 * 16
_rng = np.random.default_rng(42)
TIMES = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64)
ENTRY = np.dtype([("block", np.uint32), ("id", np.int64), ("c0", np.uint64), ("c1", np.uint64)])


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles, ascending."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    most = max(1, len(words) - WIDTH + 1)
    xx = xxhash.xxh64_intdigest
    spans = zip((end - size)[:most].tolist(), (end[WIDTH - 1 :] if len(words) >= WIDTH else end[-1:]).tolist(), strict=True)
    return np.unique(np.array([xx(flat[a:b]) for a, b in spans], np.uint64))


def signature(grams: np.ndarray) -> np.ndarray:
    """The fingerprint: bit j is 1 if it is set in over half of the shingles' j-th derived bits."""
    ones = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(grams), SLICE):
        h = (grams[i : i + SLICE, None] ^ PLUS) * TIMES
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255  # so that sums of a byte each don't overflow
        if whole:
            ones += bits[:whole].reshape(-1, 255, bits.shape[1]).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        ones += bits[whole:].sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(grams), bitorder="little").view(np.uint64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        set_id, sigs, sets = [], [], []
        for text in as_bytes(batch.column(2)):
            grams = shingles(text)
            set_id.append(xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63))
            sigs.append(signature(grams).tobytes() if len(grams) else None)
            sets.append(np.unique(grams.astype(np.uint32)).tobytes())  # four bytes tell a pair's shingles apart well enough
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(set_id, pa.int64()), pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "th", "set_id", "sig", "grams"])


def blocks(sig: np.ndarray) -> np.ndarray:
    """The blocks of each fingerprint (row of words)."""
    bits = np.unpackbits(sig.view(np.uint8), axis=1, bitorder="little")
    return bits[:, : BLOCKS * BITS].reshape(len(sig), BLOCKS, BITS) @ (1 << np.arange(BITS, dtype=np.uint32))


def check_words(table: int) -> tuple[int, int]:
    """Two words that a block is no part of."""
    at = table * BITS // 64
    return (at + 3) % WORDS, (at + 6) % WORDS


def _spread(top: int):
    """Rows (bucket, entries): each block for every prefix of top bits that its variants have."""
    masks = np.array([0, *(1 << i for i in range(top))], np.uint32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint64).reshape(len(pdf), WORDS)
            own, rows = blocks(sig), []
            for t in range(BLOCKS):
                e = np.zeros(len(pdf), ENTRY)
                a, b = check_words(t)
                e["block"], e["id"], e["c0"], e["c1"] = own[:, t], pdf["set_id"], sig[:, a], sig[:, b]
                bucket = ((e["block"] >> np.uint32(BITS - top))[:, None] ^ masks).ravel()
                e = np.repeat(e, len(masks))
                order = np.argsort(bucket, kind="stable")
                bucket, e = bucket[order], e[order]
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
                rows += [((t << top) + int(bucket[x]), e[x:y].tobytes()) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pd.DataFrame(rows, columns=["bucket", "entries"])

    return run


def _pairs(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places within each run (start, size)."""
    at = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    rest = np.repeat(start + size, size) - at - 1
    a = np.repeat(at, rest)
    return a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(rest) - rest, rest)


def _alike(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = e[a], e[b]
    return np.bitwise_count(x["c0"] ^ y["c0"]).astype(np.int64) + np.bitwise_count(x["c1"] ^ y["c1"]) <= CHECK_BITS


def links_in_bucket(e: np.ndarray, bucket: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the candidates that meet at a variant whose top bits are bucket."""
    low = BITS - top
    home = (e["block"] >> np.uint32(low)) == (bucket & ((1 << top) - 1))
    part = e["block"] & np.uint32((1 << low) - 1)
    flips = np.array([0, *(1 << i for i in range(low))], np.uint32)
    index = np.arange(len(e))
    variant = np.concatenate([(part[home][:, None] ^ flips).ravel(), part[~home]])
    owner = np.concatenate([np.repeat(index[home], len(flips)), index[~home]])
    order = np.argsort(variant, kind="stable")
    variant, owner = variant[order], owner[order]
    start = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]]) if len(variant) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(variant)))
    us, vs = [], []

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        ok = _alike(e, a, b)
        us.append(e["id"][a[ok]])
        vs.append(e["id"][b[ok]])

    small = (size > 1) & (size <= SMALL)
    for i in range(0, int(small.sum()), 1 << 14):
        a, b = _pairs(start[small][i : i + (1 << 14)], size[small][i : i + (1 << 14)])
        keep(owner[a], owner[b])
    for s, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        for a, b in by_leaders(e, owner[s : s + n]):
            us.append(e["id"][a])
            vs.append(e["id"][b])
    none = np.zeros(0, np.int64)
    return forest(np.concatenate([none, *us]), np.concatenate([none, *vs]))


def by_leaders(e: np.ndarray, who: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect all alike members of who: to leaders first, then between what is still apart."""
    label, rest = np.full(len(who), -1), np.arange(len(who))
    while len(rest):
        ok = _alike(e, who[rest], np.broadcast_to(who[rest[0]], len(rest)))
        ok[0] = True
        yield who[rest[ok]], np.broadcast_to(who[rest[0]], int(ok.sum()))
        label[rest[ok]] = rest[0]
        rest = rest[~ok]
    group, n = np.unique(label, return_counts=True)
    main = group[n.argmax()]
    for g in group[group != main].tolist():  # each lesser group against all that come after or are in the largest
        others = np.flatnonzero((label == main) | (label > g) & (label != main))
        for x in np.flatnonzero(label == g).tolist():
            ok = others[_alike(e, who[others], np.broadcast_to(who[x], len(others)))]
            if len(ok):
                yield who[ok], np.broadcast_to(who[x], len(ok))


def candidates(classes: DataFrame, n: int) -> DataFrame:
    """(src, dst): edges between classes (set_id, sig) that connect all that meet in a block. n: how many there are."""
    top = min(BITS - 8, max(0, math.ceil(math.log2(max(1, n * (BITS + 1) / VARIANTS_PER_BUCKET)))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = links_in_bucket(np.frombuffer(b"".join(pdf["entries"]), ENTRY), int(pdf["bucket"].iloc[0]), top)
        return pd.DataFrame({"src": u, "dst": v})

    sent = classes.where("sig is not null").select("set_id", "sig").mapInPandas(_spread(top), "bucket long, entries binary")
    return sent.groupBy("bucket").applyInPandas(run, "src long, dst long")


class Sets:
    """Shingle sets of members, and the exact similarity of pairs of them."""

    def __init__(self, blobs: list[bytes]):
        self.n = np.array([len(b) // 4 for b in blobs], np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.flat = np.frombuffer(b"".join(blobs), np.uint32)
        self.key = (np.repeat(np.arange(len(blobs), dtype=np.uint64), self.n) << np.uint64(32)) | self.flat  # ascending

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = np.where(self.n[a] <= self.n[b], a, b), np.where(self.n[a] <= self.n[b], b, a)
        out = np.zeros(len(a), bool)
        fit = np.flatnonzero(self.n[a] >= JACCARD * self.n[b] - 1e-9)
        step = max(1, (1 << 22) // max(1, int(self.n[a].max(initial=1))))
        for i in range(0, len(fit), step):
            x, y = a[fit[i : i + step]], b[fit[i : i + step]]
            m = self.n[x]
            at = np.arange(int(m.sum())) + np.repeat(self.start[x] - (np.cumsum(m) - m), m)
            want = (np.repeat(y.astype(np.uint64), m) << np.uint64(32)) | self.flat[at]
            place = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            shared = np.add.reduceat((self.key[place] == want).astype(np.int64), np.cumsum(m) - m)
            out[fit[i : i + step]] = shared >= JACCARD * (m + self.n[y] - shared) - 1e-9
        return out


def exact_links(sig: np.ndarray, sets: Sets, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest over all pairs of similar members, of both sides where there are two."""
    n, label = len(sig), np.arange(len(sig))
    rows, columns = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(n), np.arange(n))
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def decide(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal label
        ok = sets.similar(a, b)
        us.append(a[ok])
        vs.append(b[ok])
        u, v = forest(np.concatenate(us), np.concatenate(vs))
        label = np.arange(n)
        label[u] = v

    for i in range(0, len(rows), 256):
        part = rows[i : i + 256]
        far = np.zeros((len(part), len(columns)), np.int16)
        for w in range(WORDS):
            far += np.bitwise_count(sig[part, w][:, None] ^ sig[columns, w][None])
        ok = (far <= MOST_BITS) & (label[part][:, None] != label[columns][None])
        if not side.any():
            ok &= part[:, None] < columns[None]
        a, b = np.nonzero(ok)
        order = np.argsort(far[a, b], kind="stable")  # the closest first: most others are connected then
        a, b = part[a[order]], columns[b[order]]
        step = 1024
        while len(a):
            decide(a[:step], b[:step])
            a, b = a[step:], b[step:]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
    return forest(np.concatenate(us), np.concatenate(vs))


def _verify(pdf: pd.DataFrame) -> pd.DataFrame:
    """(a, b): a forest of the links of each group in pdf (group, own, other, set_id, sig, grams)."""
    out = []
    for _, part in pdf.groupby("group", sort=False):
        sig = np.frombuffer(b"".join(part["sig"]), np.uint64).reshape(len(part), WORDS)
        side = (part["own"] > part["other"]).to_numpy(np.int64)
        u, v = exact_links(sig, Sets(part["grams"].tolist()), side)
        ids = part["set_id"].to_numpy(np.int64)
        out.append(pd.DataFrame({"a": ids[u], "b": ids[v]}))
    return pd.concat(out)


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, th, component) for each row: rows linked by similarity, directly or by others, share the component. th: a hash of the text."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    rows = cut(given.mapInArrow(_sets, "doc_id long, th long, set_id long, sig binary, grams binary"), "sets")
    classes = cut(rows.select("set_id", "sig").dropDuplicates(["set_id"]), "classes")
    near = components(candidates(classes, classes.count())).select(F.col("node").alias("set_id"), F.col("root").alias("group"))
    sized = near.join(near.groupBy("group").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")), "group")
    # Small groups share tasks; a large one is dealt out, its parts meeting two by two.
    own = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("set_id", F.lit(3)), F.col("parts"))).otherwise(0).cast("int")
    members = rows.select("set_id", "sig", "grams").join(sized, "set_id").dropDuplicates(["set_id"]).withColumn("own", own)
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.when(F.col("parts") > 1, F.xxhash64("group")).otherwise(F.pmod(F.xxhash64("group"), F.lit(tasks)))
    met = members.groupBy(key.alias("key"), F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"))
    links = met.applyInPandas(_verify, "a long, b long")
    roots = components(links, "a", "b").select(F.col("node").alias("set_id"), "root")
    return rows.select("doc_id", "th", "set_id").join(roots, "set_id", "left").select("doc_id", "th", F.coalesce("root", "set_id").alias("component"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component stays, with all its columns: see one_of_each."""
    return one_of_each(docs, near_copies(docs))
