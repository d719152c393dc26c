"""SentencePiece BPE encoding and decoding by vectorised merge rounds over flat symbol arrays.

A batch's texts are cut where no piece can reach across, its new words become one flat array of
symbols, and each round finds every word's lowest pair rank, merges all its leftmost occurrences at
once and compacts, until no pair is left. Where a new symbol could itself take part in a pair of no
higher rank, a round merges the leftmost occurrence only, so the order is the library's.

Nulls and edge cases: null text counts as empty and has no ids; characters outside the vocabulary
become byte pieces; rows with equal doc_id are encoded each; long runs of white space or words
without a break are encoded whole; no documents give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import as_bytes, table

MARK = "▁"
NONE = np.iinfo(np.int32).max
#: Words whose ids a worker keeps; beyond that it starts anew.
CACHE_WORDS = 800_000
#: Words merged at once, so that the arrays stay in the processor's cache.
AT_ONCE = 16_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
NORMAL, BYTE = 1, 6
USED = (1, 4, 5)  # normal, user-defined and unused pieces take part in merges


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            c = data[i]
            i += 1
            out |= (c & 127) << shift
            shift += 7
            if c < 128:
                return out

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            value = varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            value = data[i : i + n]
            i += n
        yield key >> 3, value


class Csr:
    """Rows of different lengths in one flat array, for gathering many at once."""

    def __init__(self, rows: list, dtype):
        self.size = np.fromiter(map(len, rows), np.int64, len(rows))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.concatenate([np.asarray(r, dtype) for r in rows]) if rows else np.zeros(0, dtype)

    @staticmethod
    def take(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        total = int(size.sum())
        return flat[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)]

    def gather(self, at: np.ndarray) -> np.ndarray:
        return self.take(self.flat, self.start[at], self.size[at])


class Codes(dict):
    """A number for each word, in order of appearance; new: the words that came since it was emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class Codec:
    """A BPE model (the bytes of its file) with identity normalisation, a dummy prefix and byte fallback."""

    def __init__(self, model: bytes):
        pieces, self.prefix = [], True
        for number, value in _fields(model):
            if number == 1:
                d = dict(_fields(value))
                pieces.append((d[1].decode(), struct.unpack("<f", d[2])[0], d.get(3, NORMAL)))
            elif number == 3:
                norm = dict(_fields(value))
                if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
                    raise ValueError("only identity normalisation that keeps white space is supported")
                self.prefix = bool(norm.get(3, 1))
        self.byte_id = np.zeros(256, np.int32)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_id[int(p[3:5], 16)] = i
        used = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in USED}
        scores = sorted({-pieces[i][1] for i in used.values()})
        place = {s: r for r, s in enumerate(scores)}
        rank = {p: place[-pieces[i][1]] for p, i in used.items()}
        # Symbols: the pieces by their ids, then characters that occur in pieces only, then all others.
        self.symbol = dict(used)
        for p in used:
            for c in p:
                self.symbol.setdefault(c, len(pieces) + len(self.symbol))
        self.others = len(pieces) + len(self.symbol) + 1
        self.width = self.others + 0x110000
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.others
        for p, i in self.symbol.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        pairs, early = {}, np.zeros(self.width, bool)
        for p, r in rank.items():
            for k in range(1, len(p)):
                x, y = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if x is not None and y is not None:
                    pairs[x * self.width + y] = (r, used[p])
                    for part, s in ((p[:k], x), (p[k:], y)):
                        early[s] |= len(part) > 1 and rank.get(part, -1) >= r
        keys = list(pairs)
        self.last = len(keys)  # what empty slots point to
        self.keys = np.array([*keys, -1], np.int64)
        self.rank = np.array([*(pairs[k][0] for k in keys), NONE], np.int32)
        self.made = np.array([*(pairs[k][1] for k in keys), 0], np.int64)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask, self.slot = np.uint64(64 - bits), (1 << bits) - 1, np.full(1 << bits, self.last, np.int32)
        for i, k in enumerate((self.keys[:-1].view(np.uint64) * FACTOR >> self.shift).tolist()):
            while self.slot[k] != self.last:
                k = (k + 1) & self.mask
            self.slot[k] = i
        self.early = early
        self.known = np.zeros(self.width, bool)
        self.known[list(used.values())] = True
        long = [p for p in used if len(p) > 1]
        inside = {(a, b) for p in long for a, b in zip(p, p[1:], strict=False)}
        if any(a != MARK and b == MARK for a, b in inside):
            self.words = re.compile("(?s).+")
        else:  # cut before marks, and on both sides of line feeds, commas and full stops that no piece joins to letters
            alone = "".join(c for c in "\n" if not any(c in p for p in long))
            before = "".join(c for c in ",." if not any(b == c and a.isalpha() for a, b in inside))
            letters = "A-Za-z\u00C0-\u024F"
            head = f"{MARK}*[{letters}]+(?=[{re.escape(before)}])|" if before else ""
            self.words = re.compile(f"{head}{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))
        self.digits = Csr([np.frombuffer(b"%d," % i, np.uint8) for i in range(len(pieces))], np.uint8)
        text = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == 3 else b" \xe2\x81\x87 " if kind == 2 else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.text = Csr([np.frombuffer(t, np.uint8) for t in text], np.uint8)
        self.marked = np.array([kind in USED and p[0] == MARK for p, _, kind in pieces])
        self.is_byte = np.array([kind == BYTE for _, _, kind in pieces])
        self.forget()

    def forget(self) -> None:
        self.code = Codes()
        self.parts: list[tuple] = []
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look_up(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair of symbols its rank, NONE if it has none, and what it becomes."""
        key = x * self.width + y
        slot = (key.view(np.uint64) * FACTOR >> self.shift).view(np.int64)
        at = self.slot[slot]
        todo = np.flatnonzero(self.keys[at] != key)
        todo = todo[at[todo] < self.last]
        while len(todo):  # the next slots, until the key or an empty one
            slot[todo] = (slot[todo] + 1) & self.mask
            at[todo] = self.slot[slot[todo]]
            todo = todo[(self.keys[at[todo]] != key[todo]) & (at[todo] < self.last)]
        return self.rank[at], self.made[at]

    def merge(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The final symbols, and the word of each; word: ascending numbers."""
        done = []
        rank, made = np.full(len(symbol), NONE, np.int32), np.zeros(len(symbol), np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], made[inner] = self.look_up(symbol[inner], symbol[inner + 1])
        while len(symbol):
            new = np.r_[True, word[1:] != word[:-1]]
            start = np.flatnonzero(new)
            least = np.minimum.reduceat(rank, start)
            group = np.cumsum(new) - 1
            least_of = least[group]
            if (least == NONE).any():
                over = least_of == NONE
                done.append((symbol[over], word[over]))
                keep = np.flatnonzero(~over)
                symbol, word, rank, made, least_of, new = (x[keep] for x in (symbol, word, rank, made, least_of, new))
                if not len(symbol):
                    break
            best = rank == least_of
            index = np.flatnonzero(best)
            # The leftmost ones that don't overlap: every second of each run of neighbours.
            head = np.r_[True, index[1:] != index[:-1] + 1]
            n = np.arange(len(index))
            pick = index[(n - np.maximum.accumulate(np.where(head, n, 0))) % 2 == 0]
            alone = self.early[made[pick]]
            if alone.any():  # of a word with such a symbol, the leftmost occurrence only
                again = np.r_[False, word[pick][1:] == word[pick][:-1]]
                pick = pick[~(again & np.isin(word[pick], word[pick[alone]]))]
            symbol[pick] = made[pick]
            stay = np.ones(len(symbol), bool)
            stay[pick + 1] = False
            at = (np.cumsum(stay) - 1)[pick]
            symbol, word, rank, made = symbol[stay], word[stay], rank[stay], made[stay]
            # Only the pairs on both sides of a new symbol change.
            at = np.concatenate([at, at[at > 0] - 1])
            inside = at < len(symbol) - 1
            rank[at[~inside]] = NONE
            at = at[inside]
            same = word[at] == word[at + 1]
            rank[at[~same]] = NONE
            at = at[same]
            rank[at], made[at] = self.look_up(symbol[at], symbol[at + 1])
        if not done:
            return symbol, word
        symbol, word = (np.concatenate([d[i] for d in done]) for i in (0, 1))
        order = np.argsort(word, kind="stable")
        return symbol[order], word[order]

    def learn(self, words: list[str]) -> None:
        """Append the ids of words to the cache."""
        for i in range(0, len(words), AT_ONCE):
            self._learn(words[i : i + AT_ONCE])

    def _learn(self, words: list[str]) -> None:
        size = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol, word = self.merge(self.of_char[points], np.repeat(np.arange(len(words)), size))
        odd = np.unique(symbol[~self.known[symbol]])
        if len(odd):
            back = {s: c for c, s in self.symbol.items()}
            raw = Csr([self.byte_id[list((back[s] if s in back else chr(s - self.others)).encode())] for s in odd.tolist()], np.int32)
            which = ~self.known[symbol]
            place = np.searchsorted(odd, symbol[which])
            n = np.ones(len(symbol), np.int64)
            n[which] = raw.size[place]
            source = np.concatenate([symbol.astype(np.int32), raw.flat])
            start = np.arange(len(symbol))
            start[which] = len(symbol) + raw.start[place]
            ids = Csr.take(source, start, n)
            count = np.bincount(word, n, len(words)).astype(np.int64)
        else:
            ids, count = symbol.astype(np.int32), np.bincount(word, minlength=len(words))
        start = self.parts[-1][3] if self.parts else 0
        self.parts.append((ids, start + np.cumsum(count) - count, count, start + len(ids)))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if len(self.code) > CACHE_WORDS:
            self.forget()
        look = self.code.__getitem__
        coded = []
        for t in texts:
            words = self.words.findall((MARK if self.prefix else "") + t.replace(" ", MARK)) if t else []
            coded.append(np.fromiter(map(look, words), np.int64, len(words)))
        if self.code.new:
            self.learn(self.code.new)
            self.code.new = []
            self.parts = [(*(np.concatenate([p[i] for p in self.parts]) for i in range(3)), self.parts[-1][3])]
            self.flat, self.start, self.size, _ = self.parts[0]
        for at in coded:
            yield Csr.take(self.flat, self.start[at], self.size[at])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the library's decode(ids)."""
        raw = self.text.gather(ids).tobytes()
        try:
            out = raw.decode() if self.text.size[ids].all() else self._loose(ids)  # control pieces part bytes
        except UnicodeDecodeError:
            out = self._loose(ids)
        first = ids[self.text.size[ids] > 0][:1]
        return out[1:] if self.prefix and len(first) and self.marked[first[0]] else out

    def _loose(self, ids: np.ndarray) -> str:
        """As decode, with each byte that is no part of a character replaced."""
        out, edge = [], np.flatnonzero(np.r_[True, self.is_byte[ids][1:] != self.is_byte[ids][:-1], True])
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            raw = self.text.gather(ids[a:b]).tobytes()
            while raw:
                try:
                    out.append(raw.decode())
                    break
                except UnicodeDecodeError as e:
                    out += [raw[: e.start].decode(), "�"]
                    raw = raw[e.start + 1 :]
        return "".join(out)

    def joined(self, ids: np.ndarray) -> bytes:
        """The decimal ids, joined by commas."""
        return self.digits.gather(ids).tobytes()[:-1]


_codecs: dict[bytes, Codec] = {}


class Shipped:
    """A model file that the driver reads and the executors get with the job; each worker builds its codec once."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            model = f.read()
        self.name, self.model = hashlib.sha256(model).digest(), spark.sparkContext.broadcast(model)

    def codec(self) -> Codec:
        if self.name not in _codecs:
            _codecs[self.name] = Codec(self.model.value)
        return _codecs[self.name]


#: Bytes of text that are cut into words at once.
SLICE = 4 << 20


def _slices(texts: list[str]) -> Iterator[list[str]]:
    own, n = [], 0
    for t in texts:
        own.append(t)
        n += len(t)
        if n > SLICE:
            yield own
            own, n = [], 0
    if own:
        yield own


def _texts(column: pa.Array) -> list[str]:
    return [x.decode() for x in as_bytes(column)]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the ids of each whole text."""
    shipped = Shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [x for part in _slices(_texts(b.column(1))) for x in shipped.codec().encode(part)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give null."""
    shipped = Shipped(rows.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [None if x is None else shipped.codec().decode(np.array(x, np.int64)) if x else "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """Digests of each text's ids and of the text decoded from them; carried: columns that go along."""
    shipped = Shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, n, a, d = shipped.codec(), [], [], []
            for part in _slices(_texts(b.column(1))):
                for ids in c.encode(part):
                    n.append(len(ids))
                    a.append(hashlib.sha256(c.joined(ids)).hexdigest())
                    d.append(hashlib.sha256(c.decode(ids).encode() if len(ids) else b"").hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), *b.columns[2:]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *carried])

    kinds = dict(docs.dtypes)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried).mapInArrow(run, ", ".join([DIGEST, *(f"{c} {kinds[c]}" for c in carried)]))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_model())
