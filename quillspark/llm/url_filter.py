"""URL filters: rules and listed hosts held in Bloom filter cascades, in DataFrame functions.

A cascade is exact over a complete key universe: level 0 encodes the listed keys, level 1 the other
keys of the universe that level 0 takes for listed, level 2 the listed ones that level 1 holds, and
so on until a level errs on none. Level 0 has as many hash functions as the universe is larger than
the list, in bits, so the levels together take a few bytes a listed key. Keys are dealt to shards by a hash,
each with a small cascade of its own: a row meets its shard's bit arrays, never the list, whatever
its size. The cascades of rules, which come with the call, are constants of the plan. The universe of
rules is every host suffix and path beginning (of the rules' lengths) in the corpus; that of listed
hosts is every host in it.

Nulls and edge cases: a null url, or one without ://, has empty host and path, fits no rule and is
allowed unless the empty host is listed; rows are judged each, repeated or not; null page_ids are kept;
empty tables give no rows; an empty list marks nothing; other columns are ignored. Of fitting rules
of equal length the longer host wins.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.llm.common import table
from quillspark.operators.columns import fresh
from quillspark.operators.cuts import cut

#: Rules: key (host and beginning of the path) and verdict.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: Hash functions of level 0 at most, and of the levels above.
MOST_HASHES, HASHES = 32, 6
#: Listed keys of a shard, about: its levels take some 200 KB.
SHARD_KEYS = 100_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def rule_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every key that a rule with a path of one of these lengths could fit, longest first."""
    def of(n: int) -> Column:
        own = F.transform(suffixes(host), lambda h: F.concat(h, F.substring(path, 1, n)))
        return F.when(F.length(path) >= n, own).otherwise(F.array().cast("array<string>"))

    ordered = F.transform(F.array_distinct(F.flatten(F.array(*map(of, lengths)))), lambda k: F.struct((-F.length(k)).alias("n"), F.instr(k, "/").alias("host"), k.alias("key")))
    return F.transform(F.array_sort(F.transform(ordered, lambda x: F.struct(x["n"], (-x["host"]).alias("host"), x["key"]))), lambda x: x["key"])


def _positions(key: Column, level: int, m: Column, hashes: int) -> list[Column]:
    a, b = (F.pmod(F.xxhash64(key, F.lit(2 * level + i)), m) for i in (0, 1))
    return [F.pmod(a + F.lit(i) * b, m) for i in range(hashes)]


def _hit(key: Column, level: int, m: Column, words: Column, hashes: int) -> Column:
    """Whether a level's bits hold a key."""
    bits = [F.getbit(F.element_at(words, F.floor(p / 64).cast("int") + 1), (p % 64).cast("int")) == 1 for p in _positions(key, level, m, hashes)]
    return reduce(lambda x, y: x & y, bits)


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards)).cast("int")


def _level(keys: DataFrame, level: int, hashes: int) -> DataFrame:
    """(shard, m, words) of keys (shard, key): the bits of each shard and the long words that hold them."""
    per_key = math.ceil(1.45 * hashes)
    sizes = keys.groupBy("shard").agg((F.greatest(F.lit(1), F.ceil(F.count("*") * per_key / 64)) * 64).cast("long").alias("m"))
    at = keys.join(F.broadcast(sizes), "shard").select("shard", "m", F.explode(F.array(*_positions(F.col("key"), level, F.col("m"), hashes))).alias("p"))  # a row for each shard is broadcast
    held = at.groupBy("shard", "m", F.expr("p div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits"))
    empty = sizes.select("shard", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("m div 64 - 1"))).alias("word"), F.lit(0).cast("long").alias("bits"))
    words = held.unionByName(empty).groupBy("shard", "m", "word").agg(F.max(F.struct(F.col("bits") != 0, "bits"))["bits"].alias("bits"))
    made = words.groupBy("shard", "m").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w"))  # a shard's words: bounded
    return cut(made.select("shard", "m", F.transform("w", lambda x: x["bits"]).alias("words")), "level")


class Cascade:
    """levels: of each its frame (shard, m, words) and how many hash functions it has."""

    def __init__(self, listed: DataFrame, universe: DataFrame, shards: int | None = None):
        """The cascade of listed keys over universe, both of column key; shards: as many as the list needs, unless given."""
        inside = cut(listed.where("key is not null").distinct(), "listed")
        n = inside.count()
        self.shards = shards or max(1, math.ceil(n / SHARD_KEYS))
        dealt = lambda df: df.select(_shard(F.col("key"), self.shards).alias("shard"), "key")
        outside = cut(dealt(universe.where("key is not null").distinct().join(inside, "key", "left_anti")), "unlisted")
        sides, hashes = [dealt(inside), outside], max(1, min(MOST_HASHES, math.ceil(math.log2(max(2, outside.count() / max(1, n))))))
        self.levels: list[tuple[DataFrame, int]] = []
        while n:
            level, other = len(self.levels), 1 - len(self.levels) % 2
            made = _level(sides[level % 2], level, hashes)
            self.levels.append((made, hashes))
            mistaken = sides[other].join(made, "shard").where(_hit(F.col("key"), level, F.col("m"), F.col("words"), hashes))
            sides[other], hashes = cut(mistaken.select("shard", "key"), "cascade"), HASHES
            n = sides[other].count()

    def _decide(self, key: Column, levels: list[tuple[Column, Column]]) -> Column:
        """levels: m and words of each level, null where a shard has no such level: all that came so far hold."""
        out = F.lit(len(levels) % 2 == 1)
        for i, (m, words) in reversed(list(enumerate(levels))):
            out = F.when(m.isNull(), F.lit(i % 2 == 1)).when(_hit(key, i, m, words, self.levels[i][1]), out).otherwise(F.lit(i % 2 == 1))
        return F.coalesce(out, F.lit(False))

    def constant(self) -> list[tuple[int, list[int]]]:
        """The levels of a cascade of one shard, for lists that come with a call."""
        rows = [made.first() for made, _ in self.levels]
        return [(r["m"], r["words"]) for r in rows]

    def contains(self, key: Column, held: list[tuple[int, list[int]]]) -> Column:
        """Whether a key of the universe is listed; held: what constant() gave."""
        words = [F.split(F.lit(",".join(map(str, w))), ",").cast("array<bigint>") for _, w in held]  # folded to constants
        return self._decide(key, [(F.lit(m).cast("long"), w) for (m, _), w in zip(held, words, strict=True)])

    def mark(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """rows with a boolean column name: whether key, one of the universe, is listed.

        Rows meet their shard's bits; bits that are small go to every task, else rows go by shard, and
        the shard of a hot key is split like any skewed side of a join.
        """
        if not self.levels:
            return rows.withColumn(name, F.lit(False))
        shard, *names = fresh(rows, "shard", *(f"l{i}" for i in range(len(self.levels))))
        parts = [made.select(F.col("shard").alias(shard), F.struct("m", "words").alias(n)) for n, (made, _) in zip(names, self.levels, strict=True)]
        both = cut(reduce(lambda x, y: x.join(y, shard, "left"), parts), "shards")
        met = rows.withColumn(shard, _shard(F.coalesce(F.col(key), F.lit("")), self.shards)).join(both, shard, "left")
        levels = [(F.col(n)["m"], F.col(n)["words"]) for n in names]
        return met.select(*rows.columns, self._decide(F.col(key), levels).alias(name))


def _own_keys(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, keys))).alias("key"))


def judge(pages: DataFrame, listed_hosts: DataFrame, rules: dict[str, str] = RULES, shards: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict): the longest fitting rule's verdict, else block for listed hosts.

    listed_hosts: rows of column key, however many. Rules are few and come with the call.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = Cascade(listed_hosts, rows.select(F.col("host").alias("key")), shards).mark(rows, "host", "listed")
    lengths = sorted({len(k) - k.index("/") for k in rules})
    if rules:
        keys = rule_keys(F.col("host"), F.col("path"), lengths)
        universe = cut(rows.select(F.explode(keys).alias("key")).distinct(), "universe")
        hits = {}
        for v in ("allow", "block"):
            if own := [k for k, x in rules.items() if x == v]:
                made = Cascade(_own_keys(spark, own), universe, 1)
                hits[v] = lambda k, made=made, held=made.constant(): made.contains(k, held)
        fit = F.filter(keys, lambda k: reduce(lambda x, y: x | y, [f(k) for f in hits.values()]))
        rows = rows.withColumn("rule", F.get(fit, F.lit(0)))
        verdict = F.lit(None).cast("string")
        for v, f in hits.items():
            verdict = F.when(f(F.col("rule")), v).otherwise(verdict)
        ruled = F.when(F.col("rule").isNotNull(), verdict)
    else:
        rows, ruled = rows.withColumn("rule", F.lit(None).cast("string")), F.lit(None).cast("string")
    return rows.select("page_id", "host", "path", "rule", F.coalesce(ruled, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def sample_list(pages: DataFrame) -> DataFrame:
    """A stand-in for a published block list: the hosts whose MD5 starts with 0 or 1."""
    host, _ = split_url(F.col("url"))
    return pages.select(host.alias("key")).distinct().where(F.md5(F.col("key").cast("binary")) < "2")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, sample_list(pages))


ORACLE = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(key, host, path, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
  ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
best AS (
  SELECT p.page_id, p.host, p.path, max_by(r.key, length(r.key)) AS rule, max_by(r.verdict, length(r.key)) AS ruled
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.page_id, p.host, p.path)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN md5(host) < '2' THEN 'block' ELSE 'allow' END) AS verdict FROM best
"""
