r"""Substring dedup: windows of 13 words that start in an earlier document, found by prefix-partitioned suffix trees.

Words are [^\x20\x09-\x0D]+. Suffixes start at every word and matter from a depth of 13 words. A suffix's
prefix, by which it is assigned, is as long as it takes to the end of its anchor: the run of GRAM
words with the least hash (leftmost of equals) among its first 13 words, so prefixes have 4 to 13 words, and equal
windows have equal ones. Prefixes with one anchor are counted together and go to one group, as
neighbouring suffixes share it and can travel as one stretch of words. Anchors that occur in one
document only are dropped first. The rest split the suffixes into groups of about GROUP_CHARS, however
many. A prefix that occurs more often than a sixty-fourth of a group's share of the text is extended to the
whole window: each of its windows goes to a group of its own hash, and there in two rounds, the first
dealt anew by the slice it comes from, so that not even one window of all documents meets in one task.

In a group the tree of its suffixes is built top down: nodes split by the words that follow, several at
once where nodes are shallow, and subtrees with leaves of one document are cut off. The deep internal
nodes that are left, at 13 words or more, are the repeats: all leaves but those of the smallest doc_id
go. Overlapping windows that go make up the maximal repeated passages of a document.

What travels is bounded by what repeats: in one slice of a task, an anchor known to several documents
is sent once, and equal stretches of a slice are sent for the first document alone, once with all their starts.

Nulls and edge cases: null text has no words; texts shorter than 13 words lose nothing; a repeat within
one document alone, or in rows of equal doc_id, is kept; a null doc_id counts as larger than all others;
rows with equal doc_id are judged by their own text each; no documents give no rows; other columns are
ignored (removals, passages, digests) or carried along, whatever their names (strip_repeats).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import SPACE, as_bytes, table
from quillspark.operators.columns import fresh
from quillspark.operators.cuts import cut, release, remove

WINDOW, GRAM = 13, 4
#: Words by which nodes split at once above the depth of a window.
STEPS = (4, 4, 5)
#: Characters of text for each group of suffixes, and bytes that are cut into words at once.
GROUP_CHARS, SLICE = 16 << 20, 4 << 20
#: An anchor is hot beyond this share of a group's characters; below LEAST_HOT occurrences none is.
HOT_SHARE, LEAST_HOT = 64, 64
LAST = (1 << 63) - 1
_R = np.random.default_rng(13).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of several texts, flat: start and end in data, and first[i]:first[i+1] those of text i."""

    def __init__(self, texts: list[bytes]):
        self.data = b"".join(texts)
        buf = np.frombuffer(self.data, np.uint8)
        offset = np.cumsum([0, *map(len, texts)])
        inner = ~SPACE[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[offset] = True
        self.start = np.flatnonzero(inner & (edge[:-1] | ~np.r_[False, inner[:-1]])) if len(buf) else np.zeros(0, np.int64)
        self.end = np.flatnonzero(inner & (edge[1:] | ~np.r_[inner[1:], False])) + 1 if len(buf) else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offset)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.buf, self.inner = buf, inner

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        part = _R[at & 63] * (self.buf[self.inner].astype(np.uint64) + np.uint64(1))
        return _mix(np.add.reduceat(part, np.cumsum(size) - size))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, anchor, key): the words that a whole window starts at, its anchor's place, its anchor's hash."""
        h = self.h = self.hashes()
        if len(h) < WINDOW:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        g = np.zeros(len(h) - GRAM + 1, np.uint64)
        for j in range(GRAM):
            g = g * _M + h[j : len(h) - GRAM + 1 + j]
        g = _mix(g)
        n = len(h) - WINDOW + 1
        anchor = np.arange(n) + np.lib.stride_tricks.sliding_window_view(g, WINDOW - GRAM + 1).argmin(1)
        window = np.flatnonzero(self.text[:n] == self.text[WINDOW - 1 :])
        anchor = anchor[window]
        return window, anchor, g[anchor]

    def window_hashes(self, window: np.ndarray) -> np.ndarray:
        """A hash of each window's words, after anchors()."""
        g = np.zeros(len(window), np.uint64)
        for j in range(WINDOW):
            g = _mix(g * _M + self.h[window + j])
        return g


def _slices(texts: list[bytes], order: np.ndarray) -> Iterator[np.ndarray]:
    """order cut where the texts reach SLICE bytes."""
    size = np.cumsum([len(texts[i]) for i in order]) // SLICE if len(order) else np.zeros(0)
    for part in np.split(order, np.flatnonzero(np.diff(size)) + 1):
        if len(part):
            yield part


def _anchors(groups: int):
    """Rows (bucket, keys, ids, places) of each slice's anchors; without keys, what is known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = np.array(b.column(0), np.int64), as_bytes(b.column(1))
            for part in _slices(texts, np.arange(len(texts))):
                w = Words([texts[i] for i in part])
                window, anchor, key = w.anchors()
                new = np.r_[True, anchor[1:] != anchor[:-1]] if len(anchor) else np.zeros(0, bool)
                anchor, key = anchor[new], key[new]
                text = w.text[anchor]
                place, own = (anchor - w.first[text]).astype(np.int32), ids[part][text]
                # Anchors of several documents here: one of them tells the others, all are known to repeat.
                order = np.lexsort((own, key))
                key, own, place = key[order], own[order], place[order]
                head = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
                start = np.flatnonzero(head)
                tail = np.append(start[1:], len(key)) - 1
                several = own[start] != own[tail] if len(start) else np.zeros(0, bool)
                known = several[np.cumsum(head) - 1] if len(key) else several
                rows = [(int(part[0] + len(w.data)) % groups, None, own[known].tobytes(), place[known].tobytes())] if known.any() else []
                many = (tail - start + 1).astype(np.int32)[np.cumsum(head) - 1] if len(key) else place
                place = np.where(known, -many, place)
                send = ~known | head
                key, own, place = key[send], own[send], place[send]
                bucket = (key >> np.uint64(32)) % np.uint64(groups)
                order = np.argsort(bucket, kind="stable")
                sorted_ = bucket[order]
                cuts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1], True]) if len(order) else [0]
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    at = order[x:y]
                    rows.append((int(sorted_[x]), key[at].tobytes(), own[at].tobytes(), place[at].tobytes()))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "keys", "ids", "places"])

    return run


def _repeated(pdf: pd.DataFrame, limit: int) -> pd.DataFrame:
    """(doc_id, place) of anchors of a bucket that several documents have, and rows with no doc_id for the hot ones."""
    join = lambda c, kind, rows: np.frombuffer(b"".join(rows[c]), kind)
    sent = pdf["keys"].notna()
    known, rows = pdf[~sent], pdf[sent]
    key, own, place = join("keys", np.uint64, rows), join("ids", np.int64, rows), join("places", np.int32, rows)
    order = np.argsort(key)
    key, own, place = key[order], own[order], place[order]
    hot = key[:0]
    if len(key):
        head = np.r_[True, key[1:] != key[:-1]]
        start = np.flatnonzero(head)
        several = (np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start)) | (np.minimum.reduceat(place, start) < 0)
        hot = key[start][several & (np.add.reduceat(np.where(place < 0, -place, 1).astype(np.int64), start) > limit)]
        keep = several[np.cumsum(head) - 1] & (place >= 0)
        own, place = own[keep], place[keep]
    own, place = np.concatenate([own, join("ids", np.int64, known)]), np.concatenate([place, join("places", np.int32, known)])
    found = pd.DataFrame({"dk": pd.array(own, "Int64"), "place": pd.array(place, "Int32"), "hot": pd.array([pd.NA] * len(own), "Int64")})
    none = pd.array([pd.NA] * len(hot), "Int64")
    return pd.concat([found, pd.DataFrame({"dk": none, "place": none.astype("Int32"), "hot": pd.array(hot.view(np.int64), "Int64")})])


#: again: the group of the second round, of windows that travel alone.
STRETCH = "bucket long, again long, dk long, th long, starts binary, n int, words binary"


def _stretches(groups: int, salts: int, hot):
    """Rows of STRETCH: n windows from each of the words starts on; without words, known to go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, th, texts = np.array(b.column(0), np.int64), np.array(b.column(1), np.int64), as_bytes(b.column(2))
            places = b.column(3)
            for part in _slices(texts, np.argsort(ids, kind="stable")):
                w = Words([texts[i] for i in part])
                window, anchor, key = w.anchors()
                marked = np.zeros(len(w.start) + 1, bool)
                for j, i in enumerate(part.tolist()):
                    at = np.array(places[i].values, np.int64) + w.first[j]
                    marked[at[at < w.first[j + 1]]] = True
                keep = marked[anchor]
                window, anchor, key = window[keep], anchor[keep], key[keep]
                if not len(window):
                    continue
                alone = np.isin(key, hot.value)
                key[alone] = _mix(key[alone] ^ w.window_hashes(window[alone]))
                head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1) | alone[1:]])
                n = np.diff(np.append(head, len(window)))
                begin = window[head]
                text = w.text[begin]
                own, own_th = ids[part][text], th[part][text]
                data, seen, words, starts, rows = w.data, {}, [], [], []
                place = (begin - w.first[text]).astype(np.int32).tolist()
                for j, (a, z, i, t) in enumerate(zip(w.start[begin].tolist(), w.end[begin + n + WINDOW - 2].tolist(), own.tolist(), own_th.tolist(), strict=True)):
                    s = data[a:z]
                    first, first_th, at = seen.setdefault(s, (i, t, len(rows)))
                    if at < len(rows) and (first, first_th) == (i, t):
                        starts[at].append(place[j])
                        continue
                    words.append(None if first < i else s)
                    starts.append([place[j]])
                    rows.append(j)
                rows = np.array(rows, np.int64)
                single, key = alone[head][rows], key[head][rows]
                bucket = ((key >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
                again = bucket.copy()
                # Windows alone meet by salts of their slice first, and then the firsts of all salts.
                salt = np.uint64(int(_mix(np.array([int(th[part[0]]) & LAST, len(w.data)], np.uint64)).sum()) % salts)
                bucket[single] = ((_mix(key[single] + salt) >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
                # What is known to go needs no group: it is dealt out evenly.
                sure = np.array([x is None for x in words], bool)
                bucket[sure] = ((own + begin) % groups)[rows][sure]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), pa.array(again, mask=~single | sure), pa.array(own[rows]), pa.array(own_th[rows]), pa.array([np.array(x, np.int32).tobytes() for x in starts], pa.binary()), pa.array(n[rows].astype(np.int32)), pa.array(words, pa.binary())],
                    ["bucket", "again", "dk", "th", "starts", "n", "words"],
                )

    return run


def _split(node: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """The child of each suffix: numbers that are equal where node and all columns are."""
    h = node.astype(np.uint64) * _M
    for c in columns:
        h = (h ^ _mix(c.astype(np.uint64) + np.uint64(1))) * _M
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    equal = node[order][1:] == node[order][:-1]
    for c in columns:
        equal &= c[order][1:] == c[order][:-1]
    if (same != equal).any():  # two edges with one hash: sort by the words themselves
        order = np.lexsort((*columns, node))
        equal = node[order][1:] == node[order][:-1]
        for c in columns:
            equal &= c[order][1:] == c[order][:-1]
    child = np.empty(len(node), np.int64)
    child[order] = np.cumsum(np.r_[False, ~equal])
    return child


class Subtree:
    """The suffix tree of a group from its root to the deep internal nodes, and below them as far as asked for.

    stretches: words, counts: how many suffixes start in each, own: its document. Leaves are the suffixes
    that may still repeat in several documents, node the number of the node that each hangs below.
    """

    def __init__(self, stretches: list[bytes], counts: np.ndarray, own: np.ndarray):
        code: dict[bytes, int] = {}
        flat, first = [], [0]
        for s in stretches:
            flat += [code.setdefault(x, len(code)) for x in s.split()]
            first.append(len(flat))
        self.words, self.total = np.array(flat, np.int64), int(counts.sum())
        shift = np.arange(self.total) - np.repeat(np.cumsum(counts) - counts, counts)
        first = np.array(first, np.int64)
        self.start = np.repeat(first[:-1], counts) + shift
        self.end = np.repeat(first[1:], counts)
        self.doc = np.repeat(own, counts)
        self.leaves, self.node = np.arange(self.total), np.zeros(self.total, np.int64)
        self.depth = 0
        for step in STEPS:
            self.descend(step)

    def descend(self, step: int) -> None:
        """Split all nodes by the next words; suffixes that end before are no leaves any more."""
        if self.depth >= WINDOW:
            inside = self.start[self.leaves] + self.depth + step <= self.end[self.leaves]
            self.leaves, self.node = self.leaves[inside], self.node[inside]
        at = self.start[self.leaves] + self.depth
        self.node = _split(self.node, [self.words[at + j] for j in range(step)])
        self.depth += step
        low, high = self.ends()
        keep = (low < high)[self.node]
        self.leaves, self.node = self.leaves[keep], self.node[keep]

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The smallest and the largest document below each node."""
        many = int(self.node.max(initial=-1)) + 1
        low, high = np.full(many, LAST), np.full(many, -LAST - 1)
        np.minimum.at(low, self.node, self.doc[self.leaves])
        np.maximum.at(high, self.node, self.doc[self.leaves])
        return low, high

    def repeats(self) -> np.ndarray:
        """Of each suffix whether its window starts in a document before its own. Asked before descending further."""
        out = np.zeros(self.total, bool)
        low, _ = self.ends()
        out[self.leaves] = self.doc[self.leaves] > low[self.node]
        return out

    def internal_nodes(self) -> Iterator[tuple[int, list[int]]]:
        """(depth, its suffixes) of each deep internal node, of several documents, where words part or end: right-maximal repeats."""
        while len(self.leaves):
            depth, leaves, node = self.depth, self.leaves, self.node
            self.descend(1)
            # A node is passed by where all its leaves go on by one word.
            left = np.full(int(node.max()) + 1, -1)
            after = np.full(self.total, -1)
            after[self.leaves] = self.node
            np.maximum.at(left, node, after[leaves])
            parts = np.zeros(len(left), bool)
            np.logical_or.at(parts, node, after[leaves] != left[node])
            parts |= left < 0
            order = np.argsort(node, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                if parts[node[own[0]]]:
                    yield depth, leaves[own].tolist()


FLAGGED = "dk long, th long, start int, n int, again long, starts binary, words binary"


def _flag(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of FLAGGED: the windows (start, n) of a group that go; and with words those that have another round before them."""
    known = pdf["words"].isna()
    rows = pdf[~known].reset_index(drop=True)
    n = rows["n"].to_numpy(np.int64)
    gone = Subtree(rows["words"].tolist(), n, rows["dk"].to_numpy(np.int64)).repeats()
    which = np.repeat(np.arange(len(rows)), n)
    stays = np.ones(len(rows), bool)
    stays[which[gone]] = False
    left = rows[stays & rows["again"].notna().to_numpy(bool)]
    off = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    which, off = which[gone], off[gone]
    head = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (off[1:] != off[:-1] + 1)]) if len(which) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(which)))
    # Each run of windows that go, at every start of its stretch.
    starts = lambda part: np.frombuffer(b"".join(part["starts"]), np.int32).astype(np.int64)
    many = rows["starts"].map(len).to_numpy(np.int64) // 4
    row, k = which[head], many[which[head]]
    run = np.repeat(np.arange(len(head)), k)
    at = (np.cumsum(many) - many)[row[run]] + np.arange(len(run)) - np.repeat(np.cumsum(k) - k, k)
    found = pd.DataFrame({"dk": rows["dk"].to_numpy()[row[run]], "th": rows["th"].to_numpy()[row[run]], "start": starts(rows)[at] + off[head][run], "n": size[run]})
    sure = pdf.loc[known, ["dk", "th", "n"]].assign(start=starts(pdf[known]))
    out = pd.concat([found, sure])[["dk", "th", "start", "n"]].astype({"dk": "int64", "th": "int64", "start": "int32", "n": "int32"})
    out = out.assign(again=pd.array([pd.NA] * len(out), "Int64"), starts=None, words=None)
    if len(left):
        out = pd.concat([out, left.assign(start=0)[list(out.columns)].astype({"again": "Int64"})])
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("dk", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("th", F.xxhash64("text"))


def _repeated_anchors(rows: DataFrame, groups: int, limit: int) -> DataFrame:
    """(dk, places, hot): of each document the anchors that other documents have too; the row without dk lists the hot ones."""
    sent = rows.select("dk", "text").mapInArrow(_anchors(groups), "bucket long, keys binary, ids binary, places binary")
    marks = sent.groupBy("bucket").applyInPandas(lambda pdf: _repeated(pdf, limit), "dk long, place int, hot long")
    # At most a document's words; one hot anchor for each limit places of all texts.
    return cut(marks.groupBy("dk").agg(F.collect_set("place").alias("places"), F.collect_set("hot").alias("hot")), "anchors")


def _repeated_windows(rows: DataFrame, places: DataFrame, groups: int, salts: int) -> DataFrame:
    """(dk, th, spans): of each text with something to remove, the windows (start, n) that go."""
    listed = places.where("dk is null").select("hot").first()
    hot = rows.sparkSession.sparkContext.broadcast(np.array(listed[0] if listed else [], np.int64).view(np.uint64))
    own = rows.join(places.drop("hot"), "dk").select("dk", "th", "text", "places").mapInArrow(_stretches(groups, salts, hot), STRETCH)
    flagged = own.groupBy("bucket").applyInPandas(_flag, FLAGGED)
    if hot.value.size:
        flagged = cut(flagged, "windows")
        alone = F.lit(None).cast("long").alias("again")
        later = flagged.where("again is not null").select(F.col("again").alias("bucket"), alone, "dk", "th", "starts", "n", "words")
        flagged = flagged.where("again is null").unionByName(later.groupBy("bucket").applyInPandas(_flag, FLAGGED))
    return cut(flagged.groupBy("dk", "th").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "spans")


def removals(docs: DataFrame) -> DataFrame:
    """(dk, th, spans) of docs. What each step shuffled is released before the next one starts."""
    rows = _keyed(docs.select("doc_id", "text")).select("dk", "th", "text")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    spark = docs.sparkSession
    groups = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), chars // GROUP_CHARS)
    places = _repeated_anchors(rows, groups, max(LEAST_HOT, chars // (groups * HOT_SHARE)))
    release(spark)
    spans = _repeated_windows(rows, places, groups, max(1, math.isqrt(chars // SLICE)))
    remove(spark, places.cut_path)
    release(spark)
    return spans


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n_words): the maximal runs of words of each text that windows of earlier documents cover."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for dk, spans in zip(pdf["dk"], pdf["spans"], strict=True):
                now = None
                for start, n in sorted((s["start"], s["n"]) for s in spans):
                    if now and start <= now[1] + now[2]:
                        now[2] = max(now[2], start + n + WINDOW - 1 - now[1])
                    else:
                        now = [dk, start, n + WINDOW - 1]
                        rows.append(now)
            yield pd.DataFrame(rows, columns=["dk", "start", "n_words"])

    found = removals(docs).select("dk", "spans").mapInPandas(run, "dk long, start int, n_words int")
    return found.select(F.when(F.col("dk") != LAST, F.col("dk")).alias("doc_id"), "start", "n_words")


def kept_words(text: bytes, spans: list[dict] | None) -> tuple[list[bytes], int]:
    """(words that stay, how many there were)."""
    words = text.split()
    if not spans:
        return words, len(words)
    change = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        change[s["start"]] += 1
        change[min(s["start"] + s["n"] + WINDOW - 1, len(words))] -= 1
    stay = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(stay).tolist()], len(words)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    rows = _keyed(docs.select("doc_id", "text")).join(removals(docs), ["dk", "th"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha = [], [], []
            for text, spans in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                words, many = kept_words(text, spans)
                n.append(many)
                gone.append(many - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeats taken out of text (kept words joined by one space) and n_chars to match; other texts stay as they are."""
    dk, th, spans = fresh(docs, "dk", "th", "spans")
    gone = removals(docs).toDF(dk, th, spans)
    rows = docs.withColumn(dk, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn(th, F.xxhash64("text")).join(gone, [dk, th], "left")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = list(b.column(at).to_pylist())
            for i, listed in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if listed:
                    text[i] = b" ".join(kept_words(text[i].encode(), listed)[0]).decode()
            cols = [pa.array(text, pa.string()) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(cols[:-1], b.schema.names[:-1])

    out = rows.select(*docs.columns, spans).mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13),
w AS (SELECT s.doc_id, s.i, array_to_string(d.ws[s.i : s.i + 12], ' ') AS t FROM s JOIN d USING (doc_id)),
f AS (SELECT t, min(doc_id) AS first FROM w GROUP BY t HAVING min(doc_id) < max(doc_id)),
g AS (SELECT w.doc_id, w.i FROM w JOIN f USING (t) WHERE w.doc_id > f.first),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g),
k AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM c GROUP BY 1),
a AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE doc_id IN (SELECT doc_id FROM k)),
t AS (SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.i) AS kept FROM a LEFT JOIN c USING (doc_id, i) WHERE c.i IS NULL GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN k.n IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(t.kept, '') END) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    """doc_id to (n_words, n_removed, kept_sha256), for tests; doc_ids are distinct."""
    split = {i: (t or "").encode().split() for i, t in rows}
    first: dict[tuple, int] = {}
    for i in sorted(split):
        for k in range(len(split[i]) - WINDOW + 1):
            first.setdefault(tuple(split[i][k : k + WINDOW]), i)
    out = {}
    for i, words in split.items():
        gone = set()
        for k in range(len(words) - WINDOW + 1):
            if first[tuple(words[k : k + WINDOW])] < i:
                gone.update(range(k, k + WINDOW))
        out[i] = len(words), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()
    return out
