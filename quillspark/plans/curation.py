"""Queries of curation, decontamination, sampling and evaluation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.functions import text as T
from quillspark.operators import curate, decontaminate, dedup, evaluate, splits
from quillspark.operators.cuts import cut
from quillspark.plans.catalog import query
from quillspark.plans.library import KEY_SQL, MIXED, RESULTS_SQL, keyed, mixed_texts, read, result_log

SPACE_SQL = r"[\t-\r\x1C-\x20\x{85}\p{Z}]"
NORMAL_SQL = r"regexp_replace(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), '[ \t\x{A0}\x{200B}\x{200C}\x{200D}]+', ' ', 'g')"
NORMAL_SQL = f"regexp_replace(regexp_replace({NORMAL_SQL}, '{SPACE_SQL}+([।,;:?!)])', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"


@query("t7_normalize", f"SELECT doc_id, md5(regexp_replace({NORMAL_SQL}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')) AS stored FROM documents")
def normalized(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_text("text", compose=False).cast("binary")).alias("stored"))


@query("g7_keeper", f"""
WITH q AS (SELECT doc_id, CAST(max(quality) AS VARCHAR) AS vote FROM labels GROUP BY 1),
r AS (SELECT CAST(doc_id AS VARCHAR) AS id, {KEY_SQL} AS key, doc_id % 2 <> 0 AS rl, doc_id % 3 <> 0 AS ok, length(text) AS n, vote FROM documents LEFT JOIN q USING (doc_id)),
c AS (SELECT key, vote, count(*) AS n FROM r WHERE vote IS NOT NULL GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER w AS r, lead(n) OVER w AS second FROM c WINDOW w AS (PARTITION BY key ORDER BY n DESC, vote)),
b AS (SELECT r.*, coalesce(o.n = o.second, false) AS tie, row_number() OVER (PARTITION BY r.key ORDER BY r.rl, NOT r.ok, -r.n, r.id) AS r
      FROM r LEFT JOIN (SELECT * FROM o WHERE r = 1) o ON o.key = r.key WHERE o.second IS NULL OR o.n = o.second OR coalesce(r.vote = o.vote, false))
SELECT id, ok AND NOT tie AS verifiable, CAST(tie AS BIGINT) AS conflicts FROM b WHERE r = 1""")
def keeper(spark, sf_dir):
    votes = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("string").alias("vote_key"))
    rows = read(spark, sf_dir, "documents").join(votes, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"), T.matching_key("text", compose=False).alias("key"), F.when(F.col("doc_id") % 2 == 0, "sft").otherwise("rl").alias("pool"),
        (F.col("doc_id") % 3 != 0).alias("verifiable"), F.col("text").alias("solution"), "vote_key", F.array().cast("array<string>").alias("flags"),
    )
    return dedup.keep_one(rows, "key").select("id", "verifiable", F.size("flags").cast("long").alias("conflicts"))


GRAMS = "list_distinct(list_transform(generate_series(1, length(key) - 4), lambda i: substring(key, i, 5)))"
ACROSS_SQL = f"""
k AS (SELECT doc_id, source, {KEY_SQL} AS key FROM documents),
e AS (SELECT key, min(doc_id) AS owner FROM k WHERE doc_id % 10 = 0 AND key <> '' GROUP BY key),
t AS (SELECT key, min(doc_id) AS id FROM k WHERE doc_id % 10 <> 0 AND key NOT IN (SELECT key FROM e) GROUP BY key),
gt AS (SELECT id, unnest(CASE WHEN length(key) < 5 THEN [key] ELSE {GRAMS} END) AS g FROM t WHERE key <> ''), ge AS (SELECT owner, unnest(CASE WHEN length(key) < 5 THEN [key] ELSE {GRAMS} END) AS g FROM e),
nt AS (SELECT id, count(*) AS n FROM gt GROUP BY 1), ne AS (SELECT owner, count(*) AS n FROM ge GROUP BY 1),
s AS (SELECT id, owner, count(*) AS s FROM gt JOIN ge USING (g) GROUP BY 1, 2),
near AS (SELECT id, min(owner) AS owner FROM s JOIN nt USING (id) JOIN ne USING (owner) WHERE s.s / (nt.n + ne.n - s.s) >= 0.8 GROUP BY id)"""


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Keys of documents that aren't, and that are, benchmark documents; copies are one row with their smallest id."""
    rows = keyed(spark, sf_dir)
    one = lambda df: df.where("key != ''").groupBy("key").agg(F.min("doc_id").alias("id"))
    return one(rows.where("doc_id % 10 != 0")), one(rows.where("doc_id % 10 = 0"))


@query("j2_decontam_near", f"WITH {ACROSS_SQL} SELECT id, owner FROM near")
def decontaminate_near(spark, sf_dir):
    train, evals = _sides(spark, sf_dir)
    train = train.join(evals.select("key"), "key", "left_anti")
    near = dedup.similar_texts(train, evals, 0.8)
    return near.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("owner"))


@query("j3_decontam_reasons", f"""
WITH {ACROSS_SQL},
m AS (SELECT t.id, p.key AS parent, t.id % 3 = 2 AS unknown FROM (SELECT key, min(doc_id) AS id FROM k WHERE doc_id % 10 <> 0 GROUP BY key) t JOIN k p ON p.doc_id = t.id - t.id % 5 WHERE t.id % 4 = 1),
a AS (SELECT key, min(doc_id) AS id FROM k WHERE doc_id % 10 <> 0 AND key <> '' GROUP BY key),
r AS (SELECT a.id, CASE WHEN e.key IS NOT NULL THEN 'exact' WHEN near.id IS NOT NULL THEN 'near' WHEN pe.key IS NOT NULL THEN 'lineage' WHEN m.unknown THEN 'lineage_unverifiable' END AS reason
      FROM a LEFT JOIN e ON e.key = a.key LEFT JOIN near ON near.id = a.id LEFT JOIN m ON m.id = a.id LEFT JOIN e pe ON pe.key = m.parent)
SELECT id, reason FROM r""")
def decontaminate_reasons(spark, sf_dir):
    train, evals = _sides(spark, sf_dir)
    train = train.withColumn("source", F.lit("corpus"))
    keys = keyed(spark, sf_dir)
    parents = keys.select(F.col("doc_id").alias("parent"), F.col("key").alias("parent_key"))
    derived = train.where("id % 4 = 1").withColumn("parent", F.col("id") - F.col("id") % 5).join(parents, "parent")
    lineage = derived.select("source", F.col("key").alias("derived_key"), "parent_key", F.when(F.col("id") % 3 == 2, "absent").otherwise("present").alias("parent_benchmark"))
    loaded = spark.sql("SELECT 'present' AS benchmark")
    got = decontaminate.reasons(train, evals.select(F.col("id").alias("ord"), F.lit("present").alias("benchmark"), "key"), lineage, loaded)
    return got.select("id", "reason")


@query("w4_sample", """
WITH r AS (SELECT c_custkey AS eval_id, md5('7:' || c_custkey) AS o, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7:' || c_custkey), c_custkey) AS r FROM customer),
p AS (SELECT greatest(1, 103 // count(DISTINCT c_mktsegment)) AS per FROM customer),
f AS (SELECT eval_id FROM r, p WHERE r <= per),
t AS (SELECT eval_id, row_number() OVER (ORDER BY o, eval_id) AS i FROM r, p WHERE r > per)
SELECT eval_id FROM f UNION ALL SELECT eval_id FROM t WHERE i <= 103 - (SELECT count(*) FROM f)""")
def stratified_sample(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("eval_id"), "c_mktsegment")
    return splits.sample(rows, "c_mktsegment", 103, seed=7).select("eval_id")


@query("g9_overall", f"""WITH {RESULTS_SQL}
SELECT CAST(count(*) AS BIGINT) AS n_paired, round(avg(CAST(ca AS INT)), 9) AS accuracy_ar, round(avg(CAST(cb AS INT)), 9) AS accuracy_bn, round(avg(CAST(va IS NOT DISTINCT FROM vb AS INT)), 9) AS answer_agreement, round(avg(CAST(ca <> cb AS INT)), 9) AS correctness_flip FROM p""")
def overall_metrics(spark, sf_dir):
    m = evaluate.overall(evaluate.metrics(evaluate.paired(result_log(spark, sf_dir))))
    return m.select("n_paired", *[F.round(c, 9).alias(c) for c in ("accuracy_ar", "accuracy_bn", "answer_agreement", "correctness_flip")])


@query("e7_fertility", f"""
WITH t AS (SELECT {MIXED} AS t FROM part), d AS (SELECT t, regexp_replace(t, '[^0-9০-৯]+', '', 'g') AS d FROM t)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(strlen(t)), 9) AS mean_tokens, round(sum(strlen(d)) / sum(length(d)), 9) AS digit_fertility FROM d""")
def digit_fertility(spark, sf_dir):
    rows = mixed_texts(spark, sf_dir)
    return evaluate.fertility(rows, "t").select("n", F.round("mean_tokens", 9).alias("mean_tokens"), F.round("digit_fertility", 9).alias("digit_fertility"))


@query("g12_repeated_ids", "SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM (SELECT l_orderkey, l_linenumber % 3 AS l_linenumber FROM lineitem) GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_ids(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("l_linenumber"))
    return curate.repeated(rows, "l_orderkey", "l_linenumber")


@query("u_set_operations", """
SELECT 'both' AS which, o_custkey AS id FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL
SELECT 'without', c_custkey FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'distinct', o_custkey FROM (SELECT DISTINCT o_custkey FROM orders)""")
def set_operations(spark, sf_dir):
    placed, known = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    tag = lambda name, df: df.select(F.lit(name).alias("which"), "id")
    return tag("both", placed.intersect(known.where("id % 2 = 0"))).unionByName(tag("without", known.exceptAll(placed.distinct()).distinct())).unionByName(tag("distinct", placed.distinct()))


# One master row per part: (id, source, question_bn, solution_bn, answer).
LATIN_CHAIN = "This chain of thought is in English and longer than forty letters"
NATIVE_CHAIN = "সমাধান এখানে অনেক লম্বা একটি বাংলা বাক্য লেখা আছে"


def master_rows(spark, sf_dir) -> DataFrame:
    i, n = F.col("p_partkey"), F.col("p_size").cast("string")
    marked = F.concat(F.lit(f"{NATIVE_CHAIN}\nউত্তর: "), (F.col("p_size") + i % 2).cast("string"))
    return read(spark, sf_dir, "part").select(
        i.alias("id"), F.when(i % 7 == 0, "bad").otherwise("good").alias("source"),
        F.when(i % 5 == 0, "  ").when(i % 11 == 0, "汉字 12").otherwise(F.concat(F.lit("প্রশ্ন "), n)).alias("question_bn"),
        F.when(i % 3 == 0, LATIN_CHAIN).otherwise(marked).alias("solution_bn"), F.when(i % 4 != 0, n).alias("answer"),
    )


REASON_SQL = "CASE WHEN p_partkey % 7 = 0 THEN 'dropped_source' WHEN p_partkey % 5 = 0 THEN 'empty_question' WHEN p_partkey % 12 = 0 THEN 'no_recoverable_answer' WHEN p_partkey % 11 = 0 THEN 'cjk_contamination' END"


@query("f_build_records", f"""
WITH r AS (SELECT *, {REASON_SQL} AS drop_reason FROM part)
SELECT drop_reason, CASE WHEN p_partkey % 3 = 0 THEN 'rl' ELSE 'sft' END AS pool, CASE WHEN p_partkey % 4 <> 0 THEN 'bare_field' WHEN p_partkey % 3 <> 0 THEN 'bn_marker' END AS answer_method, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2, 3""")
def records(spark, sf_dir):
    return curate.build_records(master_rows(spark, sf_dir), ("bad",)).groupBy("drop_reason", "pool", "answer_method").agg(F.count("*").alias("n"))


@query("q_gates", f"""
WITH r AS (SELECT p_partkey AS i, p_size, ({REASON_SQL}) IS NULL AS kept FROM part), k AS (SELECT * FROM r WHERE kept),
s AS (SELECT i, i % 3 <> 0 AS sft FROM k),
c AS (SELECT count(*) FILTER (WHERE k.i % 17 = 0) + count(*) FILTER (WHERE k.i % 34 = 1) AS chains, count(*) FILTER (WHERE sft AND k.i % 17 = 0) + count(*) FILTER (WHERE sft AND k.i % 17 <> 0 AND k.i % 19 = 0) AS foreign_,
  count(*) FILTER (WHERE k.i % 23 = 0) AS valueless, count(*) FILTER (WHERE k.i % 29 = 0) AS conflict FROM k JOIN s USING (i)),
o AS (SELECT count(*) FILTER (WHERE i % 9 <> 0 AND i % 8 = 0) AS overlap, count(*) FILTER (WHERE kept AND i % 9 = 0) AS uncovered,
  count(*) FILTER (WHERE NOT kept AND i % 9 <> 0) + count(*) FILTER (WHERE NOT kept AND i % 9 <> 0 AND i % 8 = 0) AS unknown, count(*) FILTER (WHERE kept AND p_size = 7) AS hit, count(*) FILTER (WHERE kept AND i % 37 = 0) AS twice FROM r)
SELECT gate, severity, CAST(violations AS BIGINT) AS violations FROM o, LATERAL (VALUES
  ('duplicate_ids', 'fail', twice), ('split_overlap', 'fail', overlap), ('split_coverage', 'fail', uncovered + (SELECT count(*) FROM k WHERE i % 37 = 0 AND i % 9 = 0)), ('split_unknown_ids', 'fail', unknown),
  ('contaminated', 'fail', hit + (SELECT count(*) FROM k WHERE i % 37 = 0 AND p_size = 7)), ('required_fields', 'fail', 1), ('declared_gaps', 'warn', 2)) v(gate, severity, violations)
UNION ALL SELECT * FROM (
WITH k AS (SELECT p_partkey AS i, p_size FROM part WHERE ({REASON_SQL}) IS NULL), b AS (SELECT * FROM k UNION ALL SELECT * FROM k WHERE i % 37 = 0),
f AS (SELECT i, i % 3 <> 0 AS sft, i % 17 = 0 AS no_chain, i % 17 <> 0 AND i % 19 = 0 AS latin, i % 23 = 0 AS bad, i % 4 <> 0 AND i % 2 = 1 AS odd, i % 29 = 0 AS flag FROM b)
SELECT gate, severity, CAST(n AS BIGINT) FROM (SELECT
  count(*) FILTER (WHERE (sft AND no_chain) OR (NOT sft AND NOT no_chain AND latin)) AS a, count(*) FILTER (WHERE sft AND (no_chain OR latin)) AS b, count(*) FILTER (WHERE bad) AS c,
  count(*) FILTER (WHERE sft AND (no_chain OR latin OR odd OR bad)) AS d, count(*) FILTER (WHERE flag) AS e FROM f), LATERAL (VALUES
  ('pool_and_chain', 'fail', a), ('chain_not_native', 'fail', b), ('verifiable_without_value', 'fail', c), ('chain_disagrees', 'fail', d), ('answer_conflict', 'warn', e)) v(gate, severity, n))""")
def quality_gates(spark, sf_dir):
    """Records that break every gate: chains taken away or in Latin, values that don't compute, flags, repeats, a field left out."""
    kept = curate.build_records(master_rows(spark, sf_dir), ("bad",)).where("drop_reason is null").withColumn("i", F.col("id").cast("int"))
    i = F.col("i")
    kept = kept.withColumn("solution_bn", F.when(i % 17 == 0, F.lit(None)).when(i % 19 == 0, F.lit(LATIN_CHAIN)).otherwise(F.col("solution_bn")))
    kept = kept.withColumn("final_answer", F.when(i % 23 == 0, F.lit("1/0")).otherwise(F.col("final_answer"))).withColumn("answer_type", F.when(i % 23 == 0, F.lit("fraction")).otherwise(F.col("answer_type")))
    kept = kept.withColumn("flags", F.when(i % 29 == 0, F.array_append("flags", F.lit("answer_conflict"))).otherwise(F.col("flags")))
    kept = cut(kept.unionByName(kept.where("i % 37 = 0")).drop("question_bn_digits", "i"), "records")
    ids = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("i")).where("i % 9 != 0")
    assigned = ids.select("id", F.lit("train").alias("split")).unionByName(ids.where("i % 8 = 0").select("id", F.lit("val").alias("split")))
    keys = read(spark, sf_dir, "part").where("p_size = 7").select(T.matching_key(F.concat(F.lit("প্রশ্ন "), F.col("p_size").cast("string"))).alias("key"))
    gaps = spark.createDataFrame([("x", "not downloaded"), ("y", "not readable")], "benchmark string, problem string")
    return curate.gates(kept, assigned, keys, T.matching_key("question_bn"), gaps)


# Eval rows from parts: blank questions and answers, answers of several types, metadata that may be empty.
EVAL_ANSWER = "CASE p_partkey % 6 WHEN 0 THEN '  ' WHEN 1 THEN CAST(p_size AS STRING) WHEN 2 THEN p_size || '/7' WHEN 3 THEN p_size || '%' WHEN 4 THEN 'C' ELSE 'x + ' || p_size END"


@query("f_eval_records", f"""
WITH e AS (SELECT p_partkey AS i, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE {MIXED} END AS q, trim({EVAL_ANSWER}) AS a, p_brand FROM part),
r AS (SELECT *, CASE WHEN q = '' THEN 'empty_question' WHEN a = '' THEN 'empty_answer' END AS skip_reason FROM e)
SELECT 'parts_' || i AS eval_id, translate(q, '০১২৩৪৫৬৭৮৯', '0123456789') AS ar, translate(q, '0123456789', '০১২৩৪৫৬৭৮৯') AS bn, regexp_matches(q, '[0-9০-৯]') AS variants_differ, translate(a, '0123456789', '০১২৩৪৫৬৭৮৯') AS gold_bn,
  CASE i % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'numeric' WHEN 2 THEN 'fraction' WHEN 3 THEN 'percent' WHEN 4 THEN 'mcq_option' ELSE 'expression' END AS answer_type, i % 6 BETWEEN 1 AND 4 AS verifiable,
  CASE WHEN i % 2 = 0 THEN p_brand END AS brand, skip_reason FROM r""")
def eval_records(spark, sf_dir):
    records = _eval_records(spark, sf_dir)
    return records.select(
        "eval_id", F.col("question_ar_digits").alias("ar"), F.col("question_bn_digits").alias("bn"), "variants_differ", F.col("gold_answer_bn_digits").alias("gold_bn"), "answer_type", "verifiable",
        F.col("meta")["brand"].alias("brand"), "skip_reason",
    )


def _eval_records(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", F.expr(f"CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE {MIXED} END").alias("q"), F.expr(EVAL_ANSWER).alias("a"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END").alias("brand"))
    return curate.eval_records(rows, "parts", F.col("p_partkey"), "q", "a", ("brand",))


@query("f_eval_report", f"""
WITH e AS (SELECT p_partkey AS i, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE {MIXED} END AS q FROM part), k AS (SELECT *, regexp_matches(q, '[0-9]') AS x, regexp_matches(q, '[০-৯]') AS y FROM e WHERE q <> '' AND i % 6 <> 0),
a AS (SELECT 'records' AS measure, unnest(['problems', 'variants_differ', 'verifiable', 'usable_for_agreement']) AS name, unnest([count(*), count(*) FILTER (WHERE x OR y), count(*) FILTER (WHERE i % 6 < 5), count(*) FILTER (WHERE i % 6 < 5 AND (x OR y))]) AS n FROM k
UNION ALL SELECT 'answer_type', CASE i % 6 WHEN 1 THEN 'numeric' WHEN 2 THEN 'fraction' WHEN 3 THEN 'percent' WHEN 4 THEN 'mcq_option' ELSE 'expression' END, count(*) FROM k GROUP BY 2
UNION ALL SELECT 'original_script', CASE WHEN x AND y THEN 'mixed' WHEN x THEN 'arabic' WHEN y THEN 'bengali' ELSE 'no_digits' END, count(*) FROM k GROUP BY 2
UNION ALL SELECT 'skipped', CASE WHEN q = '' THEN 'empty_question' ELSE 'empty_answer' END, count(*) FROM e WHERE q = '' OR i % 6 = 0 GROUP BY 2)
SELECT 'parts' AS benchmark, measure, name, CAST(n AS BIGINT) AS n FROM a""")
def eval_report(spark, sf_dir):
    return curate.eval_report(_eval_records(spark, sf_dir))


@query("f8_script_pairs", f"""
SELECT CAST(p_partkey AS VARCHAR) AS id, 'প্রশ্ন ' || p_size AS question_ar_digits, translate('প্রশ্ন ' || p_size, '0123456789', '০১২৩৪৫৬৭৮৯') AS question_bn_digits FROM part WHERE ({REASON_SQL}) IS NULL""")
def pairs(spark, sf_dir):
    kept = curate.build_records(master_rows(spark, sf_dir), ("bad",)).where("drop_reason is null")
    return curate.script_pairs(kept).select("id", "question_ar_digits", "question_bn_digits")
