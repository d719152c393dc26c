r"""License scans: exact set-similarity join of text blocks with licence templates, in DataFrame functions.

Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z lower-cased. A template's stride is the
power of two that is no less than its words, 32 at least; for each stride in use, blocks of twice as
many words start every stride words, so any place of a template lies in one of its blocks as a
whole. A template's set of tokens is contained in a block to the degree |T & B| / |T|; all blocks at
or above the template's threshold are found: tokens are ordered by their global frequency, a template
posts its prefix of rarest tokens, and length and positional filters precede the exact count of shared
tokens. The phrases that the base labels stand for are templates of threshold 1; their places are then
counted word by word inside the blocks found. Templates are notices and whole licence texts of any length.

Nulls and edge cases: null text counts as empty; documents without words get zero counts, null
places and empty labels; rows with equal doc_id (or none) and text get equal results each; no
documents give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.llm.common import table
from quillspark.llm.license_texts import NOTICES, TEXTS
from quillspark.operators.cuts import cut

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: (text, label) of what earns a label of the method's own, by containment.
OWN = tuple((text, label) for label, text in (*NOTICES, *TEXTS))
THRESHOLD = 0.9
LEAST_STRIDE = 32
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Templates are a fixed list that goes along with the plan.
MAX_TEMPLATES = 10_000


def words(text: Column) -> Column:
    """The array of words of a text, empty for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def plain_words(text: str | None) -> list[str]:
    """As words, of one text."""
    return re.findall(WORD, (text or "").translate(str.maketrans(UPPER, LOWER)))


def templates(base: dict[str, str] = BASE, own: tuple[tuple[str, str], ...] = OWN, threshold: float = THRESHOLD) -> list[dict]:
    """Each template's phrase, label, stride, distinct tokens, and how many of them a block must hold."""
    both = [(p, label, 1.0, True) for p, label in base.items()] + [(p, label, threshold, False) for p, label in own]
    if len(both) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    out = []
    for i, (text, label, least, is_base) in enumerate(both):
        phrase = plain_words(text)
        tokens = list(dict.fromkeys(phrase))
        stride = max(LEAST_STRIDE, 1 << (len(phrase) - 1).bit_length())
        out.append({"id": i, "phrase": phrase, "label": label, "base": is_base, "stride": stride, "tokens": tokens, "need": math.ceil(least * len(tokens) - 1e-9)})
    return out


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of the vocabulary stands in all texts."""
    own = docs.sparkSession.createDataFrame([(v,) for v in vocabulary], "token string")
    rows = docs.select(F.explode(words(F.col("text"))).alias("token")).join(F.broadcast(own), "token")
    return {r["token"]: r["count"] for r in rows.groupBy("token").count().collect()}


def scan(docs: DataFrame, made: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(documents, hits): documents (doc_id, h, n_words), hits (doc_id, h, stride, block, template, containment, starts).

    A hit is a block that meets a template's threshold; starts: the places of the template's phrase
    that begin in the block's own stride words. h: a hash of the text, which with doc_id names a row.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    vocabulary = sorted({t for m in made for t in m["tokens"]})
    count = frequencies(docs, vocabulary)
    rank = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (count.get(t, 0), t)))}
    postings = []
    for m in made:
        order = sorted(rank[t] for t in m["tokens"])
        m["ranks"] = order
        postings += [(r, m["id"], m["stride"], i, len(order), m["need"]) for i, r in enumerate(order[: len(order) - m["need"] + 1])]
    posted = {r: v for v, r in rank.items()}
    prefix = {s: _strings(sorted({posted[p[0]] for p in postings if p[2] == s})) for s in sorted({m["stride"] for m in made})}

    # One pass over the texts: the blocks of each stride that hold a token posted for it.
    w = docs.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("words"))

    def found(stride: int) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / stride).cast("int"))
        cut_out = F.transform(at, lambda b: F.struct(F.lit(stride).alias("stride"), b.alias("block"), F.slice(F.col("words"), b * stride + 1, 2 * stride).alias("words")))
        none = F.array().cast("array<struct<stride:int,block:int,words:array<string>>>")
        return F.when(F.arrays_overlap("words", prefix[stride]), F.filter(cut_out, lambda b: F.arrays_overlap(b["words"], prefix[stride]))).otherwise(none)

    rows = cut(w.select("doc_id", "h", F.size("words").cast("long").alias("n_words"), F.concat(*map(found, prefix)).alias("blocks")), "licences")

    ranks = F.create_map(*[F.lit(x) for item in rank.items() for x in item])
    block = rows.where("size(blocks) > 0").select("doc_id", "h", F.explode("blocks").alias("b")).select("doc_id", "h", "b.*")
    known = F.filter(F.array_distinct("words"), lambda x: F.array_contains(_strings(vocabulary), x))
    block = block.withColumn("ranks", F.array_sort(F.transform(known, lambda x: F.element_at(ranks, x))))
    posts = spark.createDataFrame(postings, "rank int, template int, stride int, i int, m int, need int")
    pairs = (
        block.select("*", F.posexplode("ranks").alias("j", "rank"))
        .join(F.broadcast(posts), ["rank", "stride"])
        .where((F.size("ranks") >= F.col("need")) & (1 + F.least(F.col("m") - F.col("i"), F.size("ranks") - F.col("j")) - 1 >= F.col("need")))
        .groupBy("doc_id", "h", "stride", "block", "template")
        .agg(F.first("ranks").alias("ranks"), F.first("words").alias("words"))
    )
    own = spark.createDataFrame([(m["id"], m["label"], m["base"], m["phrase"], m["ranks"], m["need"]) for m in made], "template int, label string, base boolean, phrase array<string>, t array<int>, need int")
    hits = pairs.join(F.broadcast(own), "template").withColumn("shared", F.size(F.array_intersect("ranks", "t"))).where("shared >= need")
    starts = F.filter(F.sequence(F.lit(0), F.least(F.size("words"), F.col("stride")) - 1), lambda s: F.slice(F.col("words"), s + 1, F.size("phrase")) == F.col("phrase"))
    hits = hits.select("doc_id", "h", "stride", "block", "template", "label", "base", (F.col("shared") / F.size("t")).alias("containment"), F.transform(starts, lambda s: (s + F.col("block") * F.col("stride")).cast("long")).alias("starts"))
    return rows.select("doc_id", "h", "n_words"), hits


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, own: tuple[tuple[str, str], ...] = OWN) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows, hits = scan(docs, templates(base, own))
    placed = F.col("base") & (F.size("starts") > 0)
    counts = F.col("base") & placed
    per_row = hits.groupBy("doc_id", "h").agg(
        F.sum(F.when(counts, F.size("starts")).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(counts, F.array_min("starts"))).alias("first_word"),
        F.max(F.when(counts, F.array_max("starts"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(counts, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(placed | ~F.col("base"), F.col("label")))), ",").alias("labels"),
        F.max(F.when(placed | ~F.col("base"), F.col("containment"))).alias("score"),
    )
    per_row = per_row.select(F.col("doc_id").alias("own_id"), F.col("h").alias("own_h"), *per_row.columns[2:])
    out = rows.join(per_row, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("h") == F.col("own_h")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def brute_force(text: str | None, base: dict[str, str] = BASE, own: tuple[tuple[str, str], ...] = OWN) -> tuple:
    """The columns of one text but doc_id, block by block without indexes, for tests."""
    w = plain_words(text)
    places = [(i, label) for p, label in base.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at, found, best = [i for i, _ in places], {x for _, x in places}, 1.0 if places else 0.0
    for m in templates(base, own):
        for b in range(0, 0 if m["base"] else len(w), m["stride"]):
            shared = len(set(m["tokens"]) & set(w[b : b + 2 * m["stride"]]))
            if shared >= m["need"]:
                found.add(m["label"])
                best = max(best, shared / len(m["tokens"]))
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(found)), best


def _oracle() -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    made = templates()
    tokens = ", ".join(f"({m['id']}, {quote(t)})" for m in made if not m["base"] for t in m["tokens"])
    known = ", ".join(f"({m['id']}, {quote(m['label'])}, {m['stride']}, {len(m['tokens'])}, {m['need']})" for m in made if not m["base"])
    phrases = ", ".join(f"([{', '.join(map(quote, m['phrase']))}], {quote(m['label'])})" for m in made if m["base"])
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
p(phrase, label) AS (VALUES {phrases}), t(template, token) AS (VALUES {tokens}), m(template, label, stride, n, need) AS (VALUES {known}),
w AS (SELECT doc_id, unnest(ws) AS token, unnest(range(len(ws))) AS i FROM d),
places AS (SELECT w.doc_id, w.i, p.label FROM w JOIN p ON w.token = p.phrase[1] JOIN d USING (doc_id) WHERE d.ws[w.i + 1 : w.i + len(p.phrase)] = p.phrase),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY 1),
k AS (SELECT DISTINCT doc_id, template, label, n, need, i // stride - o AS block, token FROM w JOIN t USING (token) JOIN m USING (template), (VALUES (0), (1)) v(o) WHERE i // stride >= o),
h AS (SELECT doc_id, label, count(*) / n AS score FROM k GROUP BY doc_id, template, label, n, need, block HAVING count(*) >= need),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM (SELECT * FROM h UNION ALL SELECT doc_id, label, 1.0 FROM places) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN l USING (doc_id)"""


ORACLE = _oracle()
