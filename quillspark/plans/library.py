"""Queries over the driver's tables, registered with catalog.query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions import answers, text as T
from quillspark.operators import decontaminate, dedup, evaluate, splits
from quillspark.plans.catalog import query

# The matching key in both engines; the driver's texts are composed already.
KEY_SQL = "regexp_replace(lower(translate(text, '০১২৩৪৫৬৭৮৯', '0123456789')), '[^\\p{L}\\p{N}_\\x{0980}-\\x{09FF}]+', '', 'g')"

GRAMS_OF = "CASE WHEN length(key) < 5 THEN [key] ELSE list_distinct(list_transform(generate_series(1, length(key) - 4), lambda i: substring(key, i, 5))) END"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "source", T.matching_key("text", compose=False).alias("key"))


@query("n1_exact_dedup", f"""
WITH k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY doc_id) AS r FROM documents)
SELECT source, CAST(count(*) FILTER (WHERE r = 1) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE r > 1) AS BIGINT) AS removed FROM k GROUP BY source""")
def exact_dedup(spark, sf_dir):
    rows = keyed(spark, sf_dir).withColumn("key", F.md5(F.col("key").cast("binary")))
    each = dedup.first_of_each(rows, "key", "doc_id")
    kept = each.groupBy("source").agg(F.count("*").alias("kept"))
    total = rows.groupBy("source").agg(F.count("*").alias("total"))
    kept0 = F.coalesce("kept", F.lit(0)).cast("long")
    return total.join(kept, "source", "left").select("source", kept0.alias("kept"), (F.col("total") - kept0).alias("removed"))


# Part names with the size in either script, in both, or left out, by p_partkey.
MIXED = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_size WHEN 2 THEN translate(p_name || ' ' || p_size, '0123456789', '০১২৩৪৫৬৭৮৯') ELSE p_size || ' ' || translate(p_name || p_size, '0123456789', '০১২৩৪৫৬৭৮৯') END"


def mixed_texts(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.expr(MIXED).alias("t"))


@query("t_digits", f"""
WITH p AS (SELECT p_partkey, {MIXED} AS t FROM part), q AS (SELECT *, regexp_matches(t, '[0-9]') AS a, regexp_matches(t, '[০-৯]') AS b FROM p)
SELECT p_partkey, translate(t, '0123456789', '০১২৩৪৫৬৭৮৯') AS bn, translate(t, '০১২৩৪৫৬৭৮৯', '0123456789') AS ar, a OR b AS differ,
       CASE WHEN a AND b THEN 'mixed' WHEN a THEN 'arabic' WHEN b THEN 'bengali' ELSE 'none' END AS native, CASE WHEN a AND b THEN 'mixed' WHEN a THEN 'arabic' WHEN b THEN 'bengali' ELSE 'no_digits' END AS original FROM q""")
def digits(spark, sf_dir):
    return mixed_texts(spark, sf_dir).select("p_partkey", T.to_bengali_digits("t").alias("bn"), T.to_ascii_digits("t").alias("ar"), T.variants_differ("t").alias("differ"), T.native_script("t").alias("native"), T.original_script("t").alias("original"))


# Documents' texts with Bengali, CJK and mathematics put in, by doc_id; concatenated with || in either engine.
SCRIPTS = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || ' একটি বাংলা বাক্য ' || text WHEN 2 THEN '汉 $x + অ$ ' || text ELSE 'প্রশ্ন বাংলায় লেখা \\[ abc \\] abc' END"


@query("t_profile", r"""
WITH t AS (SELECT doc_id, """ + SCRIPTS + r""" AS text FROM documents),
p AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '(?s)\$\$.*?\$\$|\$[^$]*\$|\\\[.*?\\\]|\\\(.*?\\\)', ' ', 'g'), '\\[a-zA-Z]+', ' ', 'g') AS plain FROM t),
c AS (SELECT doc_id, CAST(len(regexp_extract_all(plain, '[\x{0980}-\x{09FF}]')) AS BIGINT) AS bengali, CAST(len(regexp_extract_all(plain, '[A-Za-z]')) AS BIGINT) AS latin, regexp_matches(text, '[\x{3000}-\x{303F}\x{4E00}-\x{9FFF}\x{FF00}-\x{FFEF}]') AS has_cjk FROM p)
SELECT doc_id, bengali, latin, round(CASE WHEN bengali + latin > 0 THEN bengali / (bengali + latin) ELSE 0 END, 9) AS bengali_ratio, has_cjk FROM c""")
def profile(spark, sf_dir):
    text = SCRIPTS.replace("\\", "\\\\")  # Spark reads a backslash as an escape
    rows = read(spark, sf_dir, "documents").select("doc_id", F.expr(text).alias("text"))
    return rows.select("doc_id", T.script_profile("text").alias("p")).select("doc_id", "p.bengali", "p.latin", F.round("p.bengali_ratio", 9).alias("bengali_ratio"), "p.has_cjk")


@query("t_shingles", f"""
WITH k AS (SELECT doc_id, {KEY_SQL} AS key FROM documents)
SELECT doc_id, key, CAST(CASE WHEN length(key) = 0 THEN 0 WHEN length(key) < 5 THEN 1 ELSE len(list_distinct(list_transform(generate_series(1, length(key) - 4), lambda i: substring(key, i, 5)))) END AS BIGINT) AS n FROM k""")
def shingle_counts(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", T.matching_key("text", compose=False).alias("key"))
    return rows.select("doc_id", "key", F.size(T.shingles("key")).cast("long").alias("n"))


# Answers by l_linenumber: (text, type, key of the canonical value).
GENERATED = [
    ("#### 12", "12", "numeric", "numeric|12.0"), ("উত্তর: 3/4", "3/4", "fraction", "fraction|3/4"), (r"so \boxed{10\%}", r"10\%", "percent", "percent|10.0"), (r"\boxed{(B)}", "(B)", "mcq_option", "mcq_option|B"),
    (r"\boxed{\text{সঠিক}}", r"\text{সঠিক}", "bool_bn", "bool_bn|true"), (r"\boxed{\sqrt{2}}", r"\sqrt{2}", "symbolic", None), ("৬০ টাকা", "৬০ টাকা", "numeric", "numeric|60.0"),
]


def _generated(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    n = F.col("l_linenumber") % len(GENERATED)
    value = F.get(F.array(*[F.lit(g[0]) for g in GENERATED]), n)
    return rows.withColumn("output", value)


def _case(i: int) -> str:
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return "CASE l_linenumber % 7 " + " ".join(f"WHEN {k} THEN {quote(g[i])}" for k, g in enumerate(GENERATED)) + " END"


METHODS = "CASE l_linenumber % 7 WHEN 0 THEN 'gsm_marker' WHEN 1 THEN 'bn_marker' WHEN 6 THEN 'bare' ELSE 'boxed' END"


@query("a_c_answers", f"SELECT {_case(1)} AS raw, {METHODS} AS method, {_case(2)} AS type, {_case(3)} AS key, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2, 3, 4")
def answer_types(spark, sf_dir):
    rows = answers.canonical(answers.extract_answer(_generated(spark, sf_dir), "output"), "raw")
    return rows.groupBy("raw", "method", F.col("canonical.type").alias("type"), F.col("canonical.key").alias("key")).agg(F.count("*").alias("n"))


@query("v_verify", f"SELECT l_linenumber % 7 AS kind, CAST(count(*) FILTER (WHERE l_linenumber % 7 <> 5 AND l_partkey % 3 <> 0) AS BIGINT) AS correct, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def verified(spark, sf_dir):
    rows = _generated(spark, sf_dir).withColumn("gold", F.get(F.array(*[F.lit(g[1]) for g in GENERATED]), F.col("l_linenumber") % 7))
    rows = rows.withColumn("said", F.when(F.col("l_partkey") % 3 == 0, F.lit("#### 99999/7 wrong")).otherwise(F.col("output")))
    got = answers.verify(rows, "said", "gold")
    return got.groupBy((F.col("l_linenumber") % 7).alias("kind")).agg(F.count_if("verdict.correct").alias("correct"), F.count("*").alias("n"))


PAIRS_SQL = f"""
k AS (SELECT min(doc_id) AS id, {KEY_SQL} AS key FROM documents GROUP BY 2),
g AS (SELECT id, unnest({GRAMS_OF}) AS g FROM k WHERE key <> ''),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
s AS (SELECT a.id AS a, b.id AS b, count(*) AS s FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
pairs AS (SELECT s.a, s.b, s.s / (x.n + y.n - s.s) AS jaccard FROM s JOIN n x ON x.id = s.a JOIN n y ON y.id = s.b WHERE s.s / (x.n + y.n - s.s) >= 0.8)"""


def _distinct_keys(spark, sf_dir) -> DataFrame:
    return keyed(spark, sf_dir).groupBy("key").agg(F.min("doc_id").alias("id"))


@query("n6_near_pairs", f"WITH {PAIRS_SQL} SELECT a, b, round(jaccard, 9) AS jaccard FROM pairs")
def near_pairs(spark, sf_dir):
    return dedup.similar_texts(_distinct_keys(spark, sf_dir), threshold=0.8).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


@query("n7_components", f"""WITH RECURSIVE {PAIRS_SQL},
e AS (SELECT a AS u, b AS v FROM pairs UNION ALL SELECT b, a FROM pairs),
r(node, root) AS (SELECT u, u FROM e UNION SELECT e.u, r.root FROM e JOIN r ON e.v = r.node)
SELECT node, min(root) AS root FROM r GROUP BY node""")
def near_components(spark, sf_dir):
    return dedup.near_clusters(_distinct_keys(spark, sf_dir), threshold=0.8)


@query("j1_decontam_exact", f"""
WITH k AS (SELECT doc_id, {KEY_SQL} AS key FROM documents), e AS (SELECT key, min(doc_id) AS owner FROM k WHERE doc_id % 10 = 0 AND key <> '' GROUP BY key)
SELECT k.doc_id, e.owner FROM k JOIN e USING (key) WHERE k.doc_id % 10 <> 0""")
def decontaminate_exact(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    evals = rows.where("doc_id % 10 = 0").select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("benchmark"), "key")
    hit = decontaminate.exact(rows.where("doc_id % 10 != 0").select("doc_id", "key"), evals)
    return hit.where("exact_benchmark is not null").select("doc_id", F.col("exact_benchmark").alias("owner"))


@query("w1_split", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY md5('split:' || c_custkey), c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) AS n FROM customer),
s AS (SELECT *, round_even(CAST(n * CAST(0.05 AS DOUBLE) AS DOUBLE), 0) AS k FROM r)
SELECT c_custkey AS id, CASE WHEN n < 10 THEN 'train' WHEN r <= k THEN 'test' WHEN r <= k + k THEN 'val' ELSE 'train' END AS split FROM s""")
def split_customers(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment", "c_nationkey")
    return splits.assign(rows, ["c_mktsegment", "c_nationkey"], splits.hash_order("id")).select("id", "split")


@query("w3_checksum", """SELECT c_mktsegment, substring(sha256(string_agg(CAST(c_custkey AS VARCHAR), chr(10) ORDER BY CAST(c_custkey AS VARCHAR))), 1, 16) AS checksum FROM customer GROUP BY 1""")
def split_checksum(spark, sf_dir):
    return read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(splits.checksum(F.col("c_custkey")).alias("checksum"))


# Six benchmarks: 0 to 2 as they come, 3 where little parses, 4 where much is cut off, 5 where little is right, 6 where answers agree.
RESULTS_SQL = """
d AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p, max(l_quantity) AS q FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY 1, 2),
e AS (SELECT l_orderkey % 7 AS benchmark, CASE WHEN l_orderkey % 7 = 6 THEN l_orderkey ELSE a.p END AS x, CASE WHEN l_orderkey % 7 = 6 THEN l_orderkey ELSE b.p END AS y, a.q AS aq, b.q AS bq FROM d a JOIN d b USING (l_orderkey) WHERE a.l_linenumber = 1 AND b.l_linenumber = 2),
p AS (SELECT benchmark, x % CASE benchmark WHEN 5 THEN 9 ELSE 4 END <> 0 AND (benchmark <> 5 OR x % 9 = 1) AS ca, y % CASE benchmark WHEN 5 THEN 9 ELSE 3 END <> 0 AND (benchmark <> 5 OR y % 9 = 1) AS cb,
      CASE WHEN x % 5 > CASE benchmark WHEN 3 THEN 2 ELSE 0 END THEN x % 5 END AS va, CASE WHEN y % 5 > CASE benchmark WHEN 3 THEN 2 ELSE 0 END THEN y % 5 END AS vb, aq > 45 AS ta, bq > CASE benchmark WHEN 4 THEN 10 ELSE 45 END AS tb FROM e)"""

VERDICT_SQL = """CASE WHEN least(parseable_ar, parseable_bn) < 0.5 THEN 'blocked_parse_rate' WHEN truncated_bn > 0.3 THEN 'blocked_truncation' WHEN greatest(accuracy_ar, accuracy_bn) < 0.15 THEN 'blocked_accuracy_floor'
  WHEN answer_agreement >= 0.95 THEN 'consistent' WHEN answer_agreement >= 0.85 THEN 'mostly_consistent' ELSE 'inconsistent' END"""
MEASURES_SQL = """CAST(count(*) AS BIGINT) AS n_paired, avg(CAST(ca AS INT)) AS accuracy_ar, avg(CAST(cb AS INT)) AS accuracy_bn, avg(CAST(va IS NOT DISTINCT FROM vb AS INT)) AS answer_agreement,
  avg(CAST(ca AND cb AS INT)) AS both_correct, avg(CAST(ca <> cb AS INT)) AS correctness_flip, avg(CAST(va IS NOT NULL AS INT)) AS parseable_ar, avg(CAST(vb IS NOT NULL AS INT)) AS parseable_bn, avg(CAST(tb AS INT)) AS truncated_bn"""
MEASURES = ("accuracy_ar", "accuracy_bn", "answer_agreement", "both_correct", "correctness_flip", "parseable_ar", "parseable_bn", "truncated_bn")
ROUNDED_SQL = ", ".join(f"round({m}, 9) AS {m}" for m in MEASURES)


def result_log(spark, sf_dir) -> DataFrame:
    """A result log from lines 1 and 2 of each order as the two scripts."""
    rows = read(spark, sf_dir, "lineitem").where("l_linenumber in (1, 2)").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_quantity").alias("q"))
    first, bench = F.col("l_linenumber") == 1, F.col("l_orderkey") % 7
    p = F.when(bench == 6, F.col("l_orderkey")).otherwise(F.col("p"))
    right = F.when(bench == 5, p % 9 == 1).when(first, p % 4 != 0).otherwise(p % 3 != 0)
    parsed = p % 5 > F.when(bench == 3, 2).otherwise(0)
    most = F.when((bench == 4) & ~first, 10).otherwise(45)
    return rows.select(
        bench.alias("benchmark"), F.col("l_orderkey").alias("eval_id"), F.when(first, "ar").otherwise("bn").alias("script"), right.alias("correct"),
        F.when(parsed, (p % 5).cast("string")).alias("predicted_canonical"), F.when(parsed, "boxed").alias("extraction_method"), (F.col("q") > most).alias("truncated"),
    )


@query("g8_metrics", f"WITH {RESULTS_SQL}, m AS (SELECT benchmark, {MEASURES_SQL} FROM p GROUP BY 1) SELECT benchmark, n_paired, {ROUNDED_SQL}, {VERDICT_SQL} AS verdict FROM m")
def paired_metrics(spark, sf_dir):
    m = evaluate.metrics(evaluate.paired(result_log(spark, sf_dir))).withColumn("verdict", evaluate.verdict())
    return m.select("benchmark", "n_paired", *[F.round(c, 9).alias(c) for c in MEASURES], "verdict")


@query("g10_report", f"""WITH {RESULTS_SQL}, m AS (SELECT CAST(benchmark AS VARCHAR) AS benchmark, {MEASURES_SQL} FROM p GROUP BY 1 UNION ALL SELECT 'OVERALL', {MEASURES_SQL} FROM p)
SELECT benchmark, n_paired, {ROUNDED_SQL}, {VERDICT_SQL} AS verdict FROM m""")
def report(spark, sf_dir):
    """The report of a log in which every line stands twice, first with other values, and some questions lack a script."""
    log = result_log(spark, sf_dir)
    stale = log.withColumn("correct", ~F.col("correct")).withColumn("truncated", ~F.col("truncated")).withColumn("extraction_method", F.lit(None).cast("string"))
    both = log.withColumn("seq", F.lit(2)).unionByName(stale.withColumn("seq", F.lit(1)))
    return evaluate.report(both).select("benchmark", "n_paired", *[F.round(c, 9).alias(c) for c in MEASURES], "verdict")


@query("g11_last_wins", "SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def last_event(spark, sf_dir):
    log = read(spark, sf_dir, "events").select(F.col("event_type").alias("benchmark"), F.col("user_id").alias("eval_id"), F.lit("ar").alias("script"), "event_id", F.struct("ts", "event_id").alias("seq"))
    return evaluate.last_lines(log).select(F.col("eval_id").alias("user_id"), F.col("benchmark").alias("event_type"), "event_id")


@query("j7_resume", "SELECT o_orderkey AS eval_id, s AS script FROM orders, (VALUES ('ar'), ('bn')) t(s) WHERE NOT (o_orderkey % 4 = 0 AND s = 'ar')")
def resume(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("eval_id"))
    return evaluate.tasks(orders, orders.where("eval_id % 4 = 0").withColumn("script", F.lit("ar")))


@query("g2_counts", "SELECT lang, source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1, 2")
def two_level_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("g4_spanning", f"SELECT md5({KEY_SQL}) AS key, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT source) AS BIGINT) AS sources FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def spanning_clusters(spark, sf_dir):
    return dedup.spanning(keyed(spark, sf_dir).withColumn("key", F.md5(F.col("key").cast("binary"))), "key")


@query("w3_checksum_by_parts", """
WITH p AS (SELECT c_mktsegment, substring(md5(CAST(c_custkey AS VARCHAR)), 1, 3) AS part, CAST(c_custkey AS VARCHAR) AS id FROM customer),
e AS (SELECT c_mktsegment, part, substring(sha256(string_agg(id, chr(10) ORDER BY id)), 1, 16) AS own FROM p GROUP BY 1, 2)
SELECT c_mktsegment, substring(sha256(string_agg(part || ':' || own, chr(10) ORDER BY part)), 1, 16) AS checksum FROM e GROUP BY 1""")
def split_checksum_by_parts(spark, sf_dir):
    return splits.checksum_by_parts(read(spark, sf_dir, "customer"), ["c_mktsegment"], "c_custkey")


@query("e10_probes", "SELECT number, CAST(strlen(number) AS BIGINT) AS tokens_ar, CAST(strlen(bn) AS BIGINT) AS tokens_bn, round(strlen(bn) / strlen(number), 9) AS ratio FROM (SELECT number, translate(number, '0123456789', '০১২৩৪৫৬৭৮৯') AS bn FROM (VALUES " + ", ".join(f"('{n}')" for n in evaluate.PROBE_NUMBERS) + ") v(number))")
def probe_numbers(spark, sf_dir):
    return evaluate.probes(spark).withColumn("ratio", F.round("ratio", 9))


@query("e13_sanity", "SELECT CAST(count(*) AS BIGINT) AS n, 'absent' AS missing FROM documents")
def input_sanity(spark, sf_dir):
    return evaluate.sanity(read(spark, sf_dir, "documents"), ("doc_id", "absent", "text")).withColumn("missing", F.array_join("missing", ","))
