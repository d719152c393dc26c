"""Toxicity: a weighted lexicon, learned from labels, matched by Aho-Corasick after folding.

Folding lower-cases, maps lookalike letters of other scripts and digits or signs that stand for
letters to Latin ones, drops zero-width characters and turns the rest into spaces. Entries are
folded words and word beginnings of four to six letters (a stem for words of rich inflection), with
their smoothed log odds as weights. Support counts documents, but neighbours (the word before and the
word after) that recur count once, so that copies of one text lend a word no more than the text does;
it must be improbable under the labels' base rate for as many terms as were tried. A word beginning must
also be as pure in the words that are no entries themselves, or it lends their weight to other words. A word counts once,
by its heaviest entry, unless it lies within an exception phrase.
score = 1 - exp(-sum of weights / (SCALE * (1 + LENGTH * ln(1 + words/1000)))).

Nulls and edge cases: null or empty text scores 0; labels that are null or other than 0 and 1, and
labels without a document, are ignored; several labels of a document count as toxic if one is; with
no toxic label the lexicon is empty and every score is 0; rows with equal doc_id are scored each;
no documents give no rows; only doc_id and text are read of the documents.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.common import table
from quillspark.operators.cuts import cut

#: Labelled rows that the lexicon is learned from, at most; taken by a hash of their id.
MAX_LABELLED = 50_000
#: The least lower bound (two standard errors) of an entry's log odds.
LEAST = 1.2
#: Toxic documents with an entry for each clean one, at least.
PURITY = 4
#: The chance of any wrong entry at the base rate, at most, over all terms tried.
CHANCE = 0.5
SCALE, LENGTH = 1.5, 0.1
STEMS = range(4, 7)
#: Harmless phrases around words that may be in the lexicon.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "idiot proof", "disgusting taste", "stupid mistake of mine", "pathetic fallacy", "pond scum")

LOOKALIKES = (
    ("аәɑα", "a"), ("ьв", "b"), ("сϲ", "c"), ("ԁ", "d"), ("еєε", "e"), ("ɡ", "g"), ("һ", "h"), ("іїıι", "i"), ("ј", "j"),
    ("кκ", "k"), ("ӏ", "l"), ("м", "m"), ("пη", "n"), ("оοσө", "o"), ("рρ", "p"), ("ԛ", "q"), ("г", "r"), ("ѕ", "s"),
    ("тτ", "t"), ("υ", "u"), ("ѵν", "v"), ("ԝω", "w"), ("хχ", "x"), ("уγ", "y"),
)
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = str.maketrans({"@": "a", "$": "s"})
FOLD = {ord(c): to for group, to in LOOKALIKES for c in group}
FOLD |= {ord(c): to for c, to in DIGITS.items()}
FOLD |= {c: " " for c in range(128) if not chr(c).isalnum() and chr(c) not in "@$"}
FOLD |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
FOLD |= {c: " " for c in (0xA0, 0xA1, 0xAB, 0xBB, 0xBF, *range(0x2010, 0x2030), *range(0x3000, 0x3003))}


def fold(text: str | None) -> str:
    """The words of text as they are matched, with a space before and after all."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower().translate(FOLD)
    if "@" in text or "$" in text:  # a sign counts as a letter inside a word only
        text = " ".join(w.strip("@$").translate(SIGNS) for w in text.split())
    return f" {text} "


def terms(text: str | None) -> set[str]:
    """The candidates of a text: ' word ' and ' stem'."""
    out = set()
    for w in set(fold(text).split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in STEMS if len(w) >= n)
    return out


def spread(text: str | None, entries: Collection[str]) -> set[str]:
    """The stems among the entries by which a word of text matches that is no entry itself."""
    rest = (w for w in set(fold(text).split()) if f" {w} " not in entries)
    return {stem for w in rest for n in STEMS if len(w) >= n and (stem := f" {w[:n]}") in entries}


def _counts(rows: DataFrame, of: Callable[[str | None], set[str]]) -> DataFrame:
    """(term, clean, toxic): how many clean and toxic texts of rows (text, label) have each term that of finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = (Counter(), Counter())
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                both[toxic].update(of(text))
            keys = list(both[0].keys() | both[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in both)], ["term", "clean", "toxic"])

    return rows.mapInArrow(run, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _contexts(batches: Iterator[pa.RecordBatch], wanted: set[str]) -> Iterator[pa.RecordBatch]:
    import xxhash

    own: dict[str, tuple[str, ...]] = {}
    for b in batches:
        seen = set()
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = ["", *fold(text).split(), ""]
            for i in range(1, len(words) - 1):
                w = words[i]
                if (found := own.get(w)) is None:
                    found = own[w] = tuple(t for t in (f" {w} ", *(f" {w[:n]}" for n in STEMS if len(w) >= n)) if t in wanted)
                if found:
                    around = xxhash.xxh64_intdigest(f"{words[i - 1]} {words[i + 1]}") >> 1
                    seen.update((t, toxic, around) for t in found)
        own.clear()
        rows = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int64()))], ["term", "label", "around"])


def evidence(toxic: int, clean: int, share: float) -> float:
    """Nats against a term of so many toxic and clean documents being spread as the labels are: a Chernoff bound."""
    n = toxic + clean
    if not n or toxic / n <= share:
        return 0.0
    rest = clean * math.log(clean / n / (1 - share)) if clean else 0.0
    return toxic * math.log(toxic / n / share) + rest


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict[str, float]:
    """Weights of terms from the labelled documents; labels: rows (doc_id, toxic) that may be learned from."""
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # bounded, so it can be broadcast
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not n.get(1):
        return {}
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "label"), "labelled")
    tried = cut(_counts(rows, terms).where("toxic >= 3"), "terms")
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n.get(0, 0) + 1))
    bound = odds - 2 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = tried.where(F.col("toxic") >= PURITY * F.col("clean")).withColumn("w", odds).withColumn("bound", bound).where(F.col("bound") > LEAST)
    # What the bounded number of labelled rows holds bounds the entries.
    best = {r["term"]: r for r in best.collect()}
    wanted = docs.sparkSession.sparkContext.broadcast(set(best))
    found = rows.mapInArrow(lambda batches: _contexts(batches, wanted.value), "term string, label int, around long").distinct().groupBy("term").pivot("label", [0, 1]).count()
    share = n[1] / (n[1] + n.get(0, 0))
    least = math.log(max(1, tried.count()) / CHANCE)
    out = {}
    for r in found.na.fill(0).collect():
        b = best[r["term"]]
        if evidence(min(b["toxic"], r["1"]), min(b["clean"], r["0"]), share) > least:
            out[r["term"]] = round(b["w"], 6)
    entries = frozenset(out)
    for r in _counts(rows, lambda text: spread(text, entries)).where(F.col("toxic") < PURITY * F.col("clean")).collect():
        del out[r["term"]]
    return out


class Matcher:
    """The automaton of a lexicon."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for term, w in lexicon.items():
            self.auto.add_word(term, (len(term), w))
        for phrase in exceptions:
            self.auto.add_word(key := f" {' '.join(fold(phrase).split())} ", (len(key), -1.0))
        self.auto.make_automaton()

    def score(self, text: str | None) -> float:
        """Between 0 and 1; above 0 only where an entry matches."""
        t = fold(text)
        found: dict[int, float] = {}
        spared = []
        for end, (n, w) in self.auto.iter(t):
            at = end - n + 1
            if w < 0:
                spared.append((at, end))
            elif w > found.get(at, 0):
                found[at] = w
        if not found:
            return 0.0
        total = sum(w for at, w in found.items() if not any(a <= at < b for a, b in spared))
        return 1 - math.exp(-total / (SCALE * (1 + LENGTH * math.log1p(len(t.split()) / 1000))))


def score(docs: DataFrame, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """(doc_id, score) of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    made: list[Matcher] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Matcher(shared.value, exceptions))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([made[0].score(t) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out())


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below one half, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, training(labels)))
    made: list[Matcher] = []
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Matcher(shared.value))
        for b in batches:
            yield b.filter(pa.array([made[0].score(t) < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, learn(docs, training(labels)))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
