"""Queries of sources and sinks, the graded stream, whole dedup, model comparison and the staged build."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.functions import registry, text as T
from quillspark.operators import dedup, evaluate, splits
from quillspark.operators.cuts import cut, new_path
from quillspark.plans import stages
from quillspark.plans.catalog import query
from quillspark.plans.curation import master_rows
from quillspark.plans.library import GRAMS_OF, KEY_SQL, MEASURES_SQL, RESULTS_SQL, VERDICT_SQL, keyed, read, result_log
from quillspark.sources import files
from quillspark.streaming import results


@query("s_json_lines", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_round_trip(spark, sf_dir):
    rows, path = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), new_path(spark, "lines")
    files.write_json(rows.where("n_nationkey % 2 = 0"), path)
    files.write_json(rows.where("n_nationkey % 2 = 1"), path, "append")
    return files.json_lines(spark, path, rows.schema)


@query("s_json_array", "SELECT n_nationkey, n_name, CASE WHEN n_regionkey > 1 THEN n_regionkey END AS region FROM nation")
def json_array_round_trip(spark, sf_dir):
    rows, path = read(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_name", "if(n_regionkey > 1, n_regionkey, null) AS region"), new_path(spark, "array")
    files.write_json_array(rows.repartition(3), path)
    return files.json_array(spark, path, rows.schema)


@query("s_manifest", "SELECT 'one' AS name, 'primary' AS role, 1 AS files, false AS gap UNION ALL SELECT 'two', 'secondary', 0, false UNION ALL SELECT 'three', 'primary', 0, true")
def manifest(spark, sf_dir):
    root = new_path(spark, "fetched")
    read(spark, sf_dir, "region").coalesce(1).write.parquet(f"{root}/one")
    known = spark.createDataFrame([("one", "primary"), ("two", "secondary"), ("three", "primary")], "name string, role string")
    rows = files.manifest(spark, known, root)
    lacking = files.gaps(rows).select(F.col("benchmark").alias("name"), F.lit(True).alias("gap"))
    n = F.size(F.filter("downloaded", lambda f: f.endswith(".parquet")))
    return rows.join(lacking, "name", "left").select("name", "role", n.alias("files"), F.coalesce("gap", F.lit(False)).alias("gap"))


@query("s_load_benchmark", """
WITH r AS (SELECT c_custkey AS eval_id, c_mktsegment, md5('3:' || c_custkey) AS o FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 7 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o, eval_id) AS r FROM r), p AS (SELECT greatest(1, 61 // count(DISTINCT c_mktsegment)) AS per FROM r),
f AS (SELECT eval_id FROM k, p WHERE r <= per), t AS (SELECT eval_id, row_number() OVER (ORDER BY o, eval_id) AS i FROM k, p WHERE r > per),
s AS (SELECT eval_id FROM f UNION ALL SELECT eval_id FROM t WHERE i <= 61 - (SELECT count(*) FROM f))
SELECT eval_id FROM s ORDER BY eval_id LIMIT 50""")
def sampled_benchmark(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey AS eval_id", "c_mktsegment", "c_custkey % 3 != 0 AS verifiable", "c_custkey % 7 != 0 AS variants_differ")
    return files.load_benchmark(rows, limit=50, sample=61, stratum="c_mktsegment", seed=3).select("eval_id")


@query("s_delimited", "SELECT c_custkey, c_name || ', \"' || c_mktsegment || '\"' AS noted FROM customer")
def delimited_round_trip(spark, sf_dir):
    path = new_path(spark, "delimited")
    noted = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))
    read(spark, sf_dir, "customer").select("c_custkey", noted.alias("noted")).write.csv(path, header=True, quote='"', escape='"', sep="\t")
    return files.delimited(spark, path, "\t").select(F.col("c_custkey").cast("long").alias("c_custkey"), "noted")


@query("s_benchmark_questions", """
SELECT 'one' AS benchmark, CAST(0 AS INT) AS ord, n_name AS question FROM nation UNION ALL SELECT 'one', 0, 'of ' || n_regionkey FROM nation WHERE n_regionkey <> 1 UNION ALL
SELECT 'two', 1, r_name FROM region UNION ALL SELECT 'two', 2, 'at ' || r_regionkey FROM region""")
def benchmark_questions(spark, sf_dir):
    root, nation, region = new_path(spark, "benchmarks"), read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    second = F.when(F.col("n_regionkey") != 1, F.concat(F.lit("of "), F.col("n_regionkey").cast("string"))).otherwise("  ")
    nation.select(F.col("n_name").alias("Source_Question"), second.alias("eng_query"), F.lit("7").alias("answer")).write.csv(f"{root}/one/a.csv", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    region.select(F.col("r_name").alias("question"), F.lit("x").alias("problem")).write.parquet(f"{root}/two/b.parquet")
    region.agg(F.collect_list(F.struct(F.concat(F.lit("at "), F.col("r_regionkey").cast("string")).alias("Query"))).alias("data")).write.json(f"{root}/two/c.json")
    region.select(F.col("r_name").alias("question")).write.parquet(f"{root}/unwanted/d.parquet")
    return files.benchmark_questions(spark, root, skip=("unwanted",))


@query("s_missing_primary", "SELECT n_name AS name FROM nation WHERE n_regionkey < 3 AND n_nationkey % 2 = 1")
def missing_primary(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    known = nation.select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") < 3, "primary").otherwise("secondary").alias("role"))
    return files.missing_primary(known, nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name")))


@query("s_report", "SELECT '{\"rows\":' || count(*) || ',\"sources\":' || count(DISTINCT source) || ',\"empty\":' || count(*) FILTER (WHERE text = '') || '}' AS json FROM documents")
def stage_report(spark, sf_dir):
    return files.report(read(spark, sf_dir, "documents"), F.count("*").alias("rows"), F.count_distinct("source").alias("sources"), F.count_if(F.col("text") == "").alias("empty"))


@query("s_publish_plan")
def publish_plan(spark, sf_dir):
    """The tables' files that a listing allows, without those it never allows."""
    return files.publish_plan(spark, sf_dir, ("documents.parquet", "labels.parquet", "nation.parquet"), never=("nation.parquet",))


@query("fn_registered", f"""
SELECT doc_id, md5({KEY_SQL}) AS key, translate(lang || doc_id, '0123456789', '০১২৩৪৫৬৭৮৯') AS bn, CASE WHEN doc_id % 2 = 0 THEN 'bengali' ELSE 'none' END AS native, doc_id % 2 = 0 AS differ, 'fraction' AS kind, CASE WHEN doc_id = 0 THEN 'fraction|0/1' WHEN doc_id % 4 = 0 THEN 'fraction|' || doc_id // 4 || '/1' WHEN doc_id % 2 = 0 THEN 'fraction|' || doc_id // 2 || '/2' ELSE 'fraction|' || doc_id || '/4' END AS value, doc_id % 3 = 0 AS right FROM documents""")
def registered_functions(spark, sf_dir):
    registry.register(spark)
    read(spark, sf_dir, "documents").createOrReplaceTempView("quillspark_documents")
    return spark.sql("""SELECT doc_id, md5(cast(matching_key(text) AS binary)) AS key, to_bn_digits(lang || doc_id) AS bn,
        native_script(to_bn_digits(lang || if(doc_id % 2 = 0, cast(doc_id AS string), ''))) AS native, variants_differ(lang || if(doc_id % 2 = 0, cast(doc_id AS string), '')) AS differ, answer_type(doc_id || '/4') AS kind, canonical_key(doc_id || '/4') AS value,
        verify_answer('#### ' || (doc_id + doc_id % 3) || '/4', doc_id || '/4').correct AS right FROM quillspark_documents""")


def _votes(rows: str, cluster: str) -> str:
    """SQL of keep_one over rows (id, rl, ok, n, vote, hit, key, cluster): CTE bodies o and b, without names."""
    return f"""SELECT *, row_number() OVER (PARTITION BY {cluster} ORDER BY n DESC, vote) AS r, lead(n) OVER (PARTITION BY {cluster} ORDER BY n DESC, vote) AS second
      FROM (SELECT {cluster}, vote, count(*) AS n FROM {rows} WHERE vote IS NOT NULL GROUP BY 1, 2)"""


def _best(rows: str, votes: str, cluster: str) -> str:
    return f"""SELECT * EXCLUDE (r, tie, ok, hit), ok AND NOT tie AS ok, hit OR tie AS hit FROM (SELECT x.*, coalesce(o.n = o.second, false) AS tie, row_number() OVER (PARTITION BY x.{cluster} ORDER BY x.rl, NOT x.ok, -x.n, x.id) AS r
      FROM {rows} x LEFT JOIN (SELECT * FROM {votes} WHERE r = 1) o ON o.{cluster} = x.{cluster} WHERE o.second IS NULL OR o.n = o.second OR coalesce(x.vote = o.vote, false)) WHERE r = 1"""


@query("n8_dedup", f"""
WITH RECURSIVE q AS (SELECT doc_id, CAST(max(quality) AS VARCHAR) AS vote FROM labels GROUP BY 1),
x AS (SELECT CAST(doc_id AS VARCHAR) AS id, {KEY_SQL} AS key, doc_id % 2 <> 0 AS rl, doc_id % 3 <> 0 AS ok, length(text) AS n, vote, false AS hit FROM documents LEFT JOIN q USING (doc_id)),
o AS ({_votes("x", "key")}), e AS ({_best("x", "o", "key")}),
g AS (SELECT id, unnest({GRAMS_OF}) AS g FROM e WHERE key <> ''), c AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
s AS (SELECT a.id AS a, b.id AS b, count(*) AS s FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
p AS (SELECT a, b FROM s JOIN c u ON u.id = a JOIN c v ON v.id = b WHERE s.s / (u.n + v.n - s.s) >= 0.9),
l AS (SELECT a AS u, b AS v FROM p UNION ALL SELECT b, a FROM p),
r(node, root) AS (SELECT u, u FROM l UNION SELECT l.u, r.root FROM l JOIN r ON l.v = r.node),
f AS (SELECT e.*, coalesce(t.root, e.id) AS cluster FROM e LEFT JOIN (SELECT node, min(root) AS root FROM r GROUP BY 1) t ON t.node = e.id),
o2 AS ({_votes("f", "cluster")}), b2 AS ({_best("f", "o2", "cluster")})
SELECT id, ok AS verifiable, hit AS conflict FROM b2""")
def whole_dedup(spark, sf_dir):
    votes = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("string").alias("vote_key"))
    rows = read(spark, sf_dir, "documents").join(votes, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"), T.matching_key("text", compose=False).alias("key"), F.when(F.col("doc_id") % 2 == 0, "sft").otherwise("rl").alias("pool"),
        (F.col("doc_id") % 3 != 0).alias("verifiable"), F.col("text").alias("solution"), "vote_key", F.array().cast("array<string>").alias("flags"),
    )
    return dedup.dedup(rows).select("id", "verifiable", F.array_contains("flags", "answer_conflict").alias("conflict"))


@query("n4_banded_links")
def banded_links(spark, sf_dir):
    """Links that banded MinHash proposes and exact similarity confirms, between distinct keys."""
    keys = keyed(spark, sf_dir).groupBy("key").agg(F.min("doc_id").alias("id"))
    return dedup.banded_text_links(keys)


@query("n5_cross_banded")
def cross_banded(spark, sf_dir):
    """Candidates between even and odd documents that share a band."""
    keys = keyed(spark, sf_dir).groupBy("key").agg(F.min("doc_id").alias("id"))
    sets = dedup.shingled(cut(keys, "keys"), "id", "key")
    return dedup.cross_banded_pairs(sets.where("id % 2 = 0"), sets.where("id % 2 = 1"))


@query("w2_bucket")
def id_buckets(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), splits.bucket("c_custkey").alias("bucket"))


def _outputs(spark, sf_dir) -> DataFrame:
    """A log of two outputs for each order, one in three wrong, with repeated lines."""
    rows = read(spark, sf_dir, "lineitem").where("l_linenumber in (1, 2)")
    n = F.col("l_orderkey").cast("string")
    said = F.when(F.col("l_orderkey") % 3 == 0, F.lit("#### 1/7")).otherwise(F.concat(F.lit("#### "), n))
    return rows.select(
        F.lit("b").alias("benchmark"), n.alias("eval_id"), F.when(F.col("l_linenumber") == 1, "ar").otherwise("bn").alias("script"), n.alias("gold_answer"),
        F.lit("numeric").alias("answer_type"), said.alias("output"), F.col("l_partkey").cast("long").alias("seq"),
    )


@query("st_graded_stream", """
SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS eval_id, CASE WHEN l_linenumber = 1 THEN 'ar' ELSE 'bn' END AS script, l_orderkey % 3 <> 0 AS correct FROM lineitem WHERE l_linenumber IN (1, 2)""")
def graded_stream(spark, sf_dir):
    source, out, state = (new_path(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    log = _outputs(spark, sf_dir)
    files.write_json(log.where("seq % 2 = 0"), source)
    results.grade_stream(spark, source, out, state).awaitTermination()
    files.write_json(log, source, "append")
    results.grade_stream(spark, source, out, state).awaitTermination()
    return spark.read.parquet(out).select("eval_id", "script", "correct")


@query("e12_parse_rates", f"""WITH {RESULTS_SQL},
m AS (SELECT benchmark, CASE WHEN va IS NOT NULL THEN 'boxed' END AS extraction_method FROM p UNION ALL SELECT benchmark, CASE WHEN vb IS NOT NULL THEN 'boxed' END FROM p)
SELECT benchmark, extraction_method, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY benchmark), 9) AS share, sum(count(*)) FILTER (WHERE extraction_method IS NOT NULL) OVER (PARTITION BY benchmark) < 0.5 * sum(count(*)) OVER (PARTITION BY benchmark) AS low FROM m GROUP BY 1, 2""")
def parse_rates(spark, sf_dir):
    both = result_log(spark, sf_dir).join(evaluate.paired(result_log(spark, sf_dir)).select("benchmark", "eval_id"), ["benchmark", "eval_id"], "left_semi")
    return evaluate.parse_rates(both, ["benchmark"]).withColumn("share", F.round("share", 9))


@query("e11_models", f"""WITH {RESULTS_SQL}, m AS (SELECT unnest(['large', 'small']) AS model, unnest([0.0, 0.5]) AS less),
x AS (SELECT benchmark, {MEASURES_SQL} FROM p GROUP BY 1), y AS (SELECT model, n_paired, answer_agreement * (1 - less) AS answer_agreement, accuracy_ar, accuracy_bn, parseable_ar, parseable_bn, CASE model WHEN 'small' THEN 1 ELSE truncated_bn END AS truncated_bn FROM x, m),
z AS (SELECT model, CAST(sum(n_paired) AS BIGINT) AS n, {", ".join(f"sum({c} * n_paired) / sum(n_paired) AS {c}" for c in ("answer_agreement", "accuracy_ar", "accuracy_bn", "parseable_ar", "parseable_bn", "truncated_bn"))} FROM y GROUP BY 1)
SELECT model, n AS n_paired, round(answer_agreement, 9) AS answer_agreement, {VERDICT_SQL} AS verdict FROM z""")
def compare_models(spark, sf_dir):
    one = evaluate.metrics(evaluate.paired(result_log(spark, sf_dir)))
    two = one.withColumn("answer_agreement", F.col("answer_agreement") * 0.5).withColumn("truncated_bn", F.lit(1.0))
    both = one.withColumn("model", F.lit("large")).unionByName(two.withColumn("model", F.lit("small")))
    return evaluate.compare_models(both).select("model", "n_paired", F.round("answer_agreement", 9).alias("answer_agreement"), "verdict")


@query("e9_worst_benchmark", """
WITH t AS (SELECT p_brand AS benchmark, avg(p_size) AS ar, avg(p_size + p_partkey % 50) AS bn FROM part GROUP BY 1)
SELECT benchmark, round(bn / ar, 9) AS fertility_ratio, CASE WHEN bn / ar >= 2 THEN 'strong' WHEN bn / ar >= 1.25 THEN 'moderate' ELSE 'weak' END AS meaning FROM t ORDER BY bn / ar DESC, benchmark LIMIT 1""")
def worst_benchmark(spark, sf_dir):
    ar, bn = F.avg("p_size"), F.avg(F.col("p_size") + F.col("p_partkey") % 50)
    rows = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("benchmark")).agg(ar.alias("tokens_ar"), bn.alias("tokens_bn"), ar.alias("fertility_ar"), bn.alias("fertility_bn"))
    return evaluate.worst(evaluate.ratios(rows)).withColumn("fertility_ratio", F.round("fertility_ratio", 9))


@query("e2_tasks", "SELECT o_orderkey AS eval_id, s AS script, CAST(CASE WHEN s = 'bn' THEN 300 ELSE 200 END AS INT) AS budget FROM orders, (VALUES ('ar'), ('bn')) t(s)")
def budgets(spark, sf_dir):
    rows = evaluate.tasks(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("eval_id")))
    return rows.withColumn("budget", evaluate.token_budget(F.col("script"), 200))


@query("p_corpus_build")
def corpus_build(spark, sf_dir):
    """Rows that each stage of the build kept."""
    master = master_rows(spark, sf_dir)
    evals = stages.evals_from(master.where("id % 13 = 0").select(F.lit("held").alias("benchmark"), F.lit(0).alias("ord"), F.col("question_bn").alias("question")))
    lineage = spark.createDataFrame([], "source string, key string, parent_key string, parent_benchmark string").withColumnRenamed("key", "derived_key")
    loaded = spark.createDataFrame([("held",)], "benchmark string")
    return stages.counts(stages.build(spark, master, evals, lineage, loaded, new_path(spark, "corpus"), dropped_sources=("bad",)))
