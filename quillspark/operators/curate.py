"""Stage one: first-match drop reasons, pool routing, script pairs, quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import answers
from quillspark.functions.text import CJK, is_bengali_dominant, normalize_text, original_script, to_ascii_digits, to_bengali_digits
from quillspark.operators.cuts import cut


def build_records(master: DataFrame, dropped_sources: tuple[str, ...] = ()) -> DataFrame:
    """master (id, source, question_bn, solution_bn, answer) as unified records with drop_reason (null: kept).

    Reasons in order: dropped_source, empty_question, no_recoverable_answer, cjk_contamination. A row
    with a Bengali-dominant chain is sft; any other is rl, without its chain, which is flagged.
    """
    rows = master.select(F.col("id").cast("string").alias("id"), "source", normalize_text("question_bn").alias("question_bn"), normalize_text("solution_bn").alias("_solution"), normalize_text("answer").alias("_answer"))
    bare = (F.col("_answer") != "") & (F.length("_answer") <= answers.BARE) & ~F.col("_answer").contains("\n")
    promoted = (F.col("_solution") == "") & (F.col("_answer") != "") & ~bare
    rows = rows.withColumn("_bare", bare).withColumn("solution_promoted_from_answer", promoted).withColumn("_chain", F.when(promoted, F.col("_answer")).otherwise(F.col("_solution")))
    rows = answers.extract_answer(rows, "_solution", "_answer", raw="_raw", method="_method")
    rows = rows.withColumn("final_answer", F.when(F.col("_bare"), F.col("_answer")).otherwise(F.col("_raw"))).withColumn("answer_method", F.when(F.col("_bare"), "bare_field").otherwise(F.col("_method")))
    rows = answers.canonical(rows, "final_answer", out="_canon")
    cjk = F.col("question_bn").rlike(CJK) | F.col("_chain").rlike(CJK)
    reason = (
        F.when(F.col("source").isin(*dropped_sources), "dropped_source").when(F.col("question_bn") == "", "empty_question")
        .when(F.col("final_answer").isNull() | (F.col("_canon.type") == "missing"), "no_recoverable_answer").when(cjk, "cjk_contamination")
    )
    native = is_bengali_dominant("_chain")
    sft = (F.col("_chain") != "") & native
    solution = F.when(sft, F.col("_chain"))
    flags = F.when((F.col("_chain") != "") & ~native, F.array(F.lit("english_chain_discarded"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "id", "source", F.when(sft, "sft").otherwise("rl").alias("pool"), F.col("_canon.type").alias("answer_type"), "answer_method", "question_bn",
        to_ascii_digits("question_bn").alias("question_ar_digits"), to_bengali_digits("question_bn").alias("question_bn_digits"), solution.alias("solution_bn"),
        to_ascii_digits(solution).alias("solution_ar_digits"), to_bengali_digits(solution).alias("solution_bn_digits"), "final_answer",
        answers.is_verifiable("_canon").alias("verifiable"), "solution_promoted_from_answer", flags.alias("flags"), reason.alias("drop_reason"),
    )


def eval_records(rows: DataFrame, benchmark: str, number: Column, question: str, answer: str, meta: tuple[str, ...] = ()) -> DataFrame:
    """Eval records of a benchmark's rows, those that are skipped with a skip_reason (null: kept).

    number: the row's place, which makes its eval_id. Reasons in order: empty_question, empty_answer.
    meta holds the named columns that aren't null or empty.
    """
    said = F.trim(F.coalesce(F.col(answer).cast("string"), F.lit("")))
    kept = list(dict.fromkeys(meta))
    own = rows.select(
        F.concat(F.lit(f"{benchmark}_"), number.cast("string")).alias("eval_id"), F.lit(benchmark).alias("benchmark"), normalize_text(F.col(question).cast("string")).alias("question_original"), said.alias("gold_answer"),
        F.map_filter(F.create_map(*[x for c in kept for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull() & (v != "")).alias("meta") if kept else F.create_map().cast("map<string,string>").alias("meta"),
    )
    own = answers.canonical(own, "gold_answer", out="_canon")
    ar, bn = to_ascii_digits("question_original"), to_bengali_digits("question_original")
    reason = F.when(F.col("question_original") == "", "empty_question").when(F.col("gold_answer") == "", "empty_answer")
    return own.select(
        "eval_id", "benchmark", "question_original", ar.alias("question_ar_digits"), bn.alias("question_bn_digits"), (ar != bn).alias("variants_differ"), "gold_answer",
        to_ascii_digits("gold_answer").alias("gold_answer_ar_digits"), to_bengali_digits("gold_answer").alias("gold_answer_bn_digits"), F.col("_canon.type").alias("answer_type"),
        answers.is_verifiable("_canon").alias("verifiable"), "meta", reason.alias("skip_reason"),
    )


def eval_report(records: DataFrame) -> DataFrame:
    """(benchmark, measure, name, n) of eval records: counts of problems, answer types, original scripts and skip reasons."""
    kept = F.col("skip_reason").isNull()
    script = original_script("question_original")
    facts = F.array(
        *[F.when(c, F.struct(F.lit("records").alias("measure"), F.lit(n).alias("name"))) for n, c in (
            ("problems", kept), ("variants_differ", kept & F.col("variants_differ")), ("verifiable", kept & F.col("verifiable")), ("usable_for_agreement", kept & gradable()))],
        F.when(kept, F.struct(F.lit("answer_type").alias("measure"), F.col("answer_type").alias("name"))), F.when(kept, F.struct(F.lit("original_script").alias("measure"), script.alias("name"))),
        F.when(~kept, F.struct(F.lit("skipped").alias("measure"), F.col("skip_reason").alias("name"))),
    )
    each = records.select("benchmark", F.explode(facts).alias("f")).where("f is not null")
    return each.groupBy("benchmark", F.col("f.measure").alias("measure"), F.col("f.name").alias("name")).agg(F.count("*").alias("n"))


def script_pairs(records: DataFrame) -> DataFrame:
    """Records whose two numeral variants differ, with both variants of question, solution and answer."""
    rows = records.where(F.col("question_ar_digits") != F.col("question_bn_digits"))
    return rows.select("id", "source", "pool", "answer_type", "verifiable", "question_ar_digits", "question_bn_digits", "solution_ar_digits", "solution_bn_digits", to_ascii_digits("final_answer").alias("final_answer_ar_digits"), to_bengali_digits("final_answer").alias("final_answer_bn_digits"))


def gradable() -> Column:
    """The filter on eval records."""
    return F.col("verifiable") & F.col("variants_differ")


REQUIRED = ("id", "source", "pool", "question_bn", "question_ar_digits", "question_bn_digits", "final_answer", "answer_type", "verifiable", "flags")


def repeated(rows: DataFrame, *ids: str) -> DataFrame:
    """(ids, n): ids that more than one row has."""
    return rows.groupBy(*ids).agg(F.count("*").alias("n")).where("n > 1")


def gates(records: DataFrame, splits: DataFrame, eval_keys: DataFrame, key: Column, gaps: DataFrame | None = None) -> DataFrame:
    """(gate, severity, violations): fail or warn, and how many rows break each gate.

    records as build_records gives them, splits (id, split), eval_keys (key), key: a record's matching key,
    gaps (benchmark, problem): benchmarks whose contamination can't be measured.
    """
    missing = [c for c in REQUIRED if c not in records.columns]
    rows = answers.canonical(records, "final_answer", "answer_type", out="_canon").withColumn("_chain", F.coalesce("solution_bn", F.lit("")))
    rows = answers.verify(rows, "_chain", "final_answer", "answer_type", out="_own")
    sft, chain = F.col("pool") == "sft", F.col("_chain") != ""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    one = rows.agg(
        count((sft & ~chain) | (~sft & chain)).alias("pool_and_chain"), count(sft & ~is_bengali_dominant("_chain")).alias("chain_not_native"),
        count(F.col("verifiable") & F.col("_canon.key").isNull()).alias("verifiable_without_value"), count(sft & F.col("verifiable") & ~F.col("_own.correct")).alias("chain_disagrees"),
        count(F.array_contains("flags", "answer_conflict")).alias("answer_conflict"),
    )
    names = ["pool_and_chain", "chain_not_native", "verifiable_without_value", "chain_disagrees", "answer_conflict"]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.lit("warn" if n == "answer_conflict" else "fail").alias("severity"), F.coalesce(n, F.lit(0)).cast("long").alias("violations")) for n in names]))
    parts = [one.select(each.alias("g")).select("g.*")]
    # Graded once above; the other gates read ids and keys only.
    slim = cut(records.select("id", key.alias("key")), "gate-keys")
    ids = slim.select("id")

    def total(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("gate"), F.lit("fail").alias("severity"), "violations")

    parts += [
        total("duplicate_ids", repeated(ids, "id")),
        total("split_overlap", splits.groupBy("id").agg(F.count_distinct("split").alias("n")).where("n > 1")),
        total("split_coverage", ids.join(splits, "id", "left_anti")), total("split_unknown_ids", splits.join(ids, "id", "left_anti")),
        total("contaminated", slim.join(eval_keys.where("key != ''").distinct(), "key", "left_semi")),
        ids.sparkSession.range(1).select(F.lit("required_fields").alias("gate"), F.lit("fail").alias("severity"), F.lit(len(missing)).cast("long").alias("violations")),
    ]
    if gaps is not None:
        parts.append(gaps.agg(F.count("*").alias("violations")).select(F.lit("declared_gaps").alias("gate"), F.lit("warn").alias("severity"), "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def passed(gate_rows: DataFrame) -> bool:
    """Whether no failing gate has a violation."""
    return gate_rows.where("severity = 'fail' and violations > 0").isEmpty()
