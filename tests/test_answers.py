"""Answers and text rule by rule, on cases of our own."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import answer_forms as A
from quillspark.functions import answers, registry
from quillspark.functions import text as T


@pytest.mark.parametrize(("text", "want"), [
    ("we get \\boxed{8}", "8"), ("first \\boxed{8}, rather \\boxed{x_{1}^{2}}", "x_{1}^{2}"), ("\\boxed {a{b}c}", "a{b}c"),
    ("\\boxed{1} then \\boxed{2{", "1"), ("\\boxed{never closed", None), ("nothing here", None), ("\\boxed", None), ("", None), (None, None),
])
def test_boxes(text, want):
    assert A.last_box(text) == want


@pytest.mark.parametrize(("fields", "want"), [
    (("so #### 17 apples",), ("17 apples", "gsm_marker")), (("####\n\n 5\nrest",), ("5", "gsm_marker")), (("#### ", "41"), ("####", "bare")),
    (("ফলাফল হবে : ৯",), ("৯", "bn_marker")), (("উত্তরঃ\n১২ টি",), ("১২ টি", "bn_marker")), (("উত্তর নেই, ফলাফল: 3",), ("3", "bn_marker")),
    (("long text\nof two lines", "#### 2"), ("2", "gsm_marker")), (("#### 1 \\boxed{2}",), ("2", "boxed")), (("\\boxed{ }",), ("\\boxed{ }", "bare")),
    (("y" * 40,), ("y" * 40, "bare")), (("y" * 41,), (None, None)), (("", None), (None, None)), (("a\nb", "c"), ("c", "bare")),
])
def test_extract(fields, want):
    assert A.extract(*fields) == want


@pytest.mark.parametrize(("answer", "want"), [
    (" $$7$$ ", "7"), ("1\\,000", "1000"), ("\\left(2\\right)", "(2)"), ("\\leftarrow", "\\leftarrow"), ("\\displaystyle 4", "4"), ("a\\ b", "a b"),
    ("15,", "15"), ("x,", "x,"), ("৯,  ", "৯"), ("done.", "done"), ("শেষ।", "শেষ"), (".", ""), ("", ""),
])
def test_clean(answer, want):
    assert A.clean(answer) == want


KINDS = [
    ("+1,234,567.5", "numeric", "1234567.5"), ("12,34", "other", None), ("7.", "numeric", "7.0"), ("₹ 99.5", "numeric", "99.5"), ("৳৫০", "numeric", "50.0"), ("\\$7", "numeric", "7.0"),
    ("8 কেজি", "numeric", "8.0"), ("20 units", "numeric", "20.0"), ("20 unitss", "expression", None), ("3 hr.", "numeric", "3.0"),
    ("12.5%", "percent", "12.5"), ("-4 \\%", "percent", "-4.0"), ("1.2.3%", "percent", None), ("%", "other", None),
    ("6/8", "fraction", "3/4"), ("-6 / 8", "fraction", "-3/4"), ("\\tfrac{1.5}{3}", "fraction", "1/2"), ("\\frac{4}{0}", "fraction", None), ("\\frac{a}{2}", "expression", None), ("6/-8", "other", None),
    ("(d)", "mcq_option", "D"), ("E.", "mcq_option", "E"), ("\\mathrm{a}", "mcq_option", "A"), ("C) 12", "mcq_option", "C"), ("\\text{B: } x", "mcq_option", "B"), ("(a): 5}", "mcq_option", "A"), ("F", "expression", None),
    ("\\textit{মিথ্যা}", "bool_bn", "false"), ("হ্যাঁ", "bool_bn", "true"), ("\\log 2", "symbolic", None), ("3\\pi", "symbolic", None), ("x > 3", "expression", None),
    ("[1; 2]", "other", None), ("5:7", "other", None), ("$ $", "missing", None), (None, "missing", None),
]


def test_types_and_values(spark):
    df = spark.createDataFrame([(a,) for a, _, _ in KINDS], "a string")
    got = answers.classify(answers.canonical(df, "a"), "a", "kind").collect()
    assert [(r.a, r.kind) for r in got] == [(a, k) for a, k, _ in KINDS]
    assert [(r.a, r.canonical.key) for r in got] == [(a, v and f"{k}|{v}") for a, k, v in KINDS]


def test_payloads():
    forms = {a: (A.Form(a).letter, A.Form(a).stands_for) for a in ("(B) 2.5", "\\textbf{(C)}\\ 70", "d: }", "A", "\\text{E. 3/4}", "B)")}
    assert forms == {"(B) 2.5": ("B", "2.5"), "\\textbf{(C)}\\ 70": ("C", "70"), "d: }": ("D", None), "A": ("A", None), "\\text{E. 3/4}": ("E", "3/4"), "B)": ("B", None)}


VERDICTS = [  # prediction, gold, type, correct, reason
    ("#### 1", "x+1", None, False, "unverifiable_type:expression"), ("#### 1", "1/0", None, False, "gold_uncanonicalizable"), ("no idea,\nsorry", "4", None, False, "no_answer_in_prediction"),
    ("\\boxed{7}", "7.000001", None, True, "numeric_compare"), ("\\boxed{7}", "7.0001", None, False, "numeric_compare"), ("40%", "40 \\%", None, True, "numeric_compare"),
    ("\\boxed{0.4}", "40%", None, True, "cross_type_numeric"), ("\\boxed{40}", "40%", None, False, "cross_type_numeric"), ("\\boxed{3/4}", "0.75", None, True, "cross_type_numeric"),
    ("\\boxed{75%}", "3/4", None, True, "cross_type_numeric"), ("\\boxed{\\frac{1}{0}}", "5", None, False, "pred_uncanonicalizable:fraction"), ("\\boxed{x}", "5", None, False, "pred_uncanonicalizable:expression"),
    ("\\boxed{9/12}", "3/4", None, True, "fraction_compare"), ("\\boxed{9/13}", "3/4", None, False, "fraction_compare"),
    ("\\boxed{b}", "(B)", None, True, "mcq_option_compare"), ("\\boxed{a}", "(B)", None, False, "mcq_option_compare"), ("\\boxed{12}", "B) 12", None, True, "mcq_payload_compare"),
    ("\\boxed{13}", "B) 12", None, False, "pred_uncanonicalizable:numeric"), ("\\boxed{D) 3/4}", "B) 3/4", None, False, "mcq_option_compare"), ("\\boxed{x}", "B) y", None, False, "pred_uncanonicalizable:expression"),
    ("\\boxed{অসত্য}", "ভুল", None, True, "bool_bn_compare"), ("\\boxed{সত্য}", "ভুল", None, False, "bool_bn_compare"), ("#### 5", "5", "percent", False, "gold_uncanonicalizable"), (None, "5", None, False, "no_answer_in_prediction"),
]


def test_verify(spark):
    got = answers.verify(spark.createDataFrame(VERDICTS, "p string, g string, k string, ok boolean, why string"), "p", "g", "k", out="v").collect()
    assert [(r.p, r.g, r.v.correct, r.v.reason) for r in got] == [(r.p, r.g, r.ok, r.why) for r in got]


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([("#### 4", "4", "x")], "raw string, verdict string, _step0 string")
    out = answers.verify(answers.extract_answer(df, "raw", raw="found"), "raw", "verdict", out="v")
    assert out.columns == ["raw", "verdict", "_step0", "found", "method", "v"] and out.first()["_step0"] == "x"
    assert answers.verify(df.limit(0), "raw", "verdict").count() == 0


def test_plan_is_short(spark):
    df = answers.verify(spark.createDataFrame([("1", "1")], "p string, g string"), "p", "g")
    assert len(df._jdf.queryExecution().toString()) < 5_000


def test_sql_functions(spark):
    assert {"extract_answer", "answer_type", "canonical_key", "verify_answer"} <= set(registry.register(spark))
    row = spark.sql("SELECT extract_answer('#### 6').raw AS raw, answer_type('6/8') AS kind, canonical_key('6/8') AS key, verify_answer('#### 0.75', '6/8').correct AS ok, verify_answer(NULL, NULL).reason AS none").first()
    assert tuple(row) == ("6", "fraction", "fraction|3/4", True, "unverifiable_type:missing")


def test_text(spark):
    row = spark.range(1).select(
        T.to_bengali_digits(F.lit("room 907")).alias("bn"), T.to_ascii_digits(F.lit("৯০৭ নং")).alias("ar"), T.matching_key(F.lit("আম: ৫ টি?")).alias("a"), T.matching_key(F.lit("আম 5টি")).alias("b"),
        T.script_profile(F.lit("ab কখগ $zz$ \\alpha 漢")).alias("p"), T.is_bengali_dominant(F.lit("abc কখ")).alias("no"), T.strip_math(F.lit("a$$b\nc$$d\\[e\\]f\\(g\\)h$i$j")).alias("m"),
        T.normalize_text(F.lit("\u00a0e\u0301  x\r\r\r\ny !\u200b ")).alias("n"), T.shingles(F.lit("abcdefab")).alias("s"), T.native_script(F.lit("১a")).alias("native"), T.original_script(F.lit("১ 2")).alias("original"),
    ).first()
    assert (row.bn, row.ar, row.a, row.no, row.m) == ("room ৯০৭", "907 নং", row.b, False, "a d f h j")
    assert tuple(row.p) == (3, 2, 0.6, True) and row.n == "é x\n\ny!" and row.s == ["abcde", "bcdef", "cdefa", "defab"]
    assert (row.native, row.original) == ("bengali", "mixed")
