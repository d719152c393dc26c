"""Metrics, splits, keeper votes and components on small fixtures, counted by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark.operators import columns, dedup, evaluate, splits
from quillspark.operators.cuts import work_dir
from quillspark.operators.graph import components

LOG = "benchmark string, eval_id string, script string, correct boolean, predicted_canonical string, extraction_method string, truncated boolean, seq int"


def line(bench, i, script, right, said, seq=1, cut=False):
    return bench, f"q{i}", script, right, said and f"numeric|{said}", said and "boxed", cut, seq


def test_report(spark):
    """Four pairs of one benchmark and one of another; a repeated line, a lone script and answers that are both missing."""
    rows = [
        line("a", 0, "ar", True, "3"), line("a", 0, "bn", True, "3"), line("a", 1, "ar", True, "5"), line("a", 1, "bn", False, "6", cut=True),
        line("a", 2, "ar", False, None), line("a", 2, "bn", False, None), line("a", 3, "ar", True, "1"), line("a", 3, "ar", False, "2", seq=2), line("a", 3, "bn", False, "2"),
        line("a", 4, "ar", True, "9"), line("b", 0, "bn", True, "7"), line("b", 0, "ar", False, None),
    ]
    got = {r.benchmark: r for r in evaluate.report(spark.createDataFrame(rows, LOG)).collect()}
    a = got["a"]
    assert (a.n_paired, a.accuracy_ar, a.accuracy_bn, a.accuracy_gap, a.answer_agreement) == (4, 0.5, 0.25, 0.25, 0.75)
    assert (a.both_correct, a.correctness_flip, a.parseable_ar, a.parseable_bn, a.truncated_ar, a.truncated_bn) == (0.25, 0.25, 0.75, 0.75, 0, 0.25)
    assert a.verdict == "inconsistent" and got["b"].verdict == "blocked_parse_rate"
    total = got["OVERALL"]
    assert (total.n_paired, total.accuracy_ar, total.accuracy_bn, total.answer_agreement) == (5, 0.4, 0.4, 0.6)
    assert set(got) == {"a", "b", "OVERALL"} and evaluate.report(spark.createDataFrame([], LOG)).count() == 0


@pytest.mark.parametrize(("agreement", "parsed", "cut_off", "right", "want"), [
    (0.96, 0.9, 0.1, 0.5, "consistent"), (0.9, 0.9, 0.1, 0.5, "mostly_consistent"), (0.84, 0.9, 0.1, 0.5, "inconsistent"),
    (0.96, 0.49, 0.9, 0.1, "blocked_parse_rate"), (0.96, 0.5, 0.31, 0.1, "blocked_truncation"), (0.96, 0.5, 0.3, 0.14, "blocked_accuracy_floor"),
])
def test_verdict(spark, agreement, parsed, cut_off, right, want):
    row = spark.range(1).select(F.lit(agreement).alias("answer_agreement"), F.lit(0.9).alias("parseable_ar"), F.lit(parsed).alias("parseable_bn"), F.lit(cut_off).alias("truncated_bn"), F.lit(right).alias("accuracy_ar"), F.lit(0.0).alias("accuracy_bn"))
    assert row.select(evaluate.verdict()).first()[0] == want


def test_sample(spark):
    """Three strata of unlike sizes, one of them null: as many of each as there are, then the rest by the hash."""
    rows = spark.createDataFrame([(f"e{i:03}", "big" if i < 70 else "mid" if i < 90 else None, i) for i in range(95)], "eval_id string, kind string, rank int")
    got = splits.sample(rows, "kind", 30, 5).collect()
    n = {k: sum(r.kind == k for r in got) for k in ("big", "mid", None)}
    assert len(got) == 30 and n[None] == 5 and min(n["big"], n["mid"]) >= 10 and [r.eval_id for r in got] == sorted(r.eval_id for r in got)
    assert got == splits.sample(rows, "kind", 30, 5).collect() != splits.sample(rows, "kind", 30, 6).collect()
    assert splits.sample(rows, "kind", 2, 5).count() == 3 and splits.sample(rows, "kind", 500).count() == 95 and splits.sample(rows.limit(0), "kind", 5).count() == 0


def test_ranks_by_ranges(spark):
    """Ranks are those of a sort, for hashes and shares, with clashing names and null groups."""
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN 'x' WHEN id % 2 = 0 THEN 'y' END AS part", "id AS rank", "'r' AS row")
    for order, key in ((splits.hash_order("id"), lambda i: hashlib.md5(f"split:{i}".encode()).hexdigest()), (splits.bucket("id"), lambda i: hashlib.blake2b(f"split:{i}".encode(), digest_size=8).hexdigest())):
        got, r, n = columns.ranked(rows, ["part"], order, "id")
        for part in ("x", "y", None):
            own = sorted((x[r], x.id, x[n]) for x in got.collect() if x.part == part)
            assert [i for _, i, _ in own] == sorted((i for _, i, _ in own), key=key) and [k for k, _, _ in own] == list(range(1, own[0][2] + 1))


def test_checksum_by_parts(spark):
    rows = spark.range(500).selectExpr("id % 2 AS split", "id")
    one = {r.split: r.checksum for r in splits.checksum_by_parts(rows, ["split"], "id").collect()}
    assert one == {r.split: r.checksum for r in splits.checksum_by_parts(rows.repartition(7), ["split"], "id").collect()} and len(set(one.values())) == 2
    assert one[0] != {r.split: r.checksum for r in splits.checksum_by_parts(rows.where("id != 4"), ["split"], "id").collect()}[0]


def test_keeper(spark):
    rows = [("p", "g", "rl", True, None, "n|1"), ("q", "g", "sft", True, "xx", "n|2"), ("r", "g", "rl", True, None, "n|1"), ("s", "h", "rl", True, None, "n|1"), ("t", "h", "sft", True, "x", "n|2"), ("u", "i", "sft", False, "x", None), ("v", "i", "sft", False, "xyz", None)]
    df = spark.createDataFrame([(*r, []) for r in rows], "id string, key string, pool string, verifiable boolean, solution string, vote_key string, flags array<string>")
    got = {r.key: (r.id, r.verifiable, r.flags) for r in dedup.keep_one(df, "key").collect()}
    assert got == {"g": ("p", True, []), "h": ("t", False, ["answer_conflict"]), "i": ("v", False, [])}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_generation_is_dealt_out(spark):
    todo = spark.range(400).selectExpr("id AS eval_id", "CASE WHEN id % 2 = 0 THEN 'ar' ELSE 'bn' END AS script", "concat('p', id) AS prompt", "5 AS budget")
    out = evaluate.generate(todo, lambda prompts, budgets: [(p.upper(), b if p.endswith("7") else 1) for p, b in zip(prompts, budgets, strict=True)], tasks=8)
    rows = out.select("*", F.spark_partition_id().alias("at")).collect()
    assert len(rows) == 400 and all(r.output == r.prompt.upper() and r.truncated == r.prompt.endswith("7") for r in rows) and len({r["at"] for r in rows}) > 3


def test_prompts(spark):
    row = spark.createDataFrame([("2+2?",)], "q string").select(evaluate.prompt("q").alias("plain"), evaluate.prompt("q", evaluate.turns()).alias("chat")).first()
    assert "2+2?" in row.plain and "\\boxed{}" in row.plain and row.chat.count("<|im_start|>") == 3 and row.chat.endswith("</think>\n\n")


def test_no_folder_on_a_cluster():
    class Conf:
        get = staticmethod(lambda key, default: default)

    class Session:
        conf = Conf
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(Session())
