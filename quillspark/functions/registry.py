"""The scalars as SQL functions of a session; Catalyst inlines those of text but nfc, the answers' run batch by batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession, functions as F
from pyspark.sql.types import StringType

from quillspark.functions import answers, text as T
from quillspark.functions.answer_forms import Form

A, B = T.ASCII_DIGITS, T.BENGALI_DIGITS
FUNCTIONS = {
    "to_bn_digits": ("STRING", f"translate(s, '{A}', '{B}')"),
    "to_ar_digits": ("STRING", f"translate(s, '{B}', '{A}')"),
    "has_bn_digits": ("BOOLEAN", "s RLIKE '[০-৯]'"),
    "has_ar_digits": ("BOOLEAN", "s RLIKE '[0-9]'"),
    "variants_differ": ("BOOLEAN", f"translate(s, '{A}', '{B}') <> translate(s, '{B}', '{A}')"),
    "native_script": ("STRING", "CASE WHEN s RLIKE '[0-9]' AND s RLIKE '[০-৯]' THEN 'mixed' WHEN s RLIKE '[0-9]' THEN 'arabic' WHEN s RLIKE '[০-৯]' THEN 'bengali' ELSE 'none' END"),
    "strip_math": ("STRING", rf"regexp_replace(regexp_replace(s, r'{T.MATH}', ' '), r'\\[a-zA-Z]+', ' ')"),
    "matching_key": ("STRING", rf"regexp_replace(lower(translate(coalesce(nfc(CASE WHEN s RLIKE r'{T.COMPOSABLE}' THEN s END), s, ''), '{B}', '{A}')), r'{T.NOT_A_WORD}', '')"),
}


def _string(fn: Callable[[str | None], str | None]):
    """fn over the distinct values of each batch."""

    def run(texts: pd.Series) -> pd.Series:
        known = {x: fn(x) for x in texts.dropna().unique()}
        none = fn(None)
        return pd.Series([none if x is None or x != x else known[x] for x in texts], dtype=object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, StringType())


#: extract_answer(field, ...) and verify_answer(prediction, gold) give structs.
ANSWERS = {
    "extract_answer": answers.extract_udf,
    "answer_type": _string(lambda s: Form(s).kind),
    "canonical_key": _string(lambda s: Form(s).value().key),
    "verify_answer": answers.verify_udf,
}


def register(spark: SparkSession) -> list[str]:
    """Make all of them known to spark.sql; returns their names."""
    spark.udf.register("nfc", T.nfc)
    for name, fn in ANSWERS.items():
        spark.udf.register(name, fn)
    for name, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS {kind} RETURN {body}")
    return ["nfc", *FUNCTIONS, *ANSWERS]
