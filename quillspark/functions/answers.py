"""Final answers: extraction, typing, canonical values and tolerant verification, as columns of a frame.

One Arrow-batched function for each, which looks at every distinct input of a batch once: the rules
branch and look back too much for a plan of built-in functions, which grew to hundreds of kilobytes.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, StringType, StructField, StructType

from quillspark.functions import answer_forms as A
from quillspark.functions.answer_forms import BARE, VERIFIABLE, last_box  # noqa: F401  part of this module's interface


def _struct(strings: str, **others: DataType) -> StructType:
    """A struct of the names in strings, which are strings unless others says so."""
    return StructType([StructField(name, others.get(name, StringType())) for name in strings.split()])


EXTRACTED = _struct("raw method")
CANONICAL = _struct("type num frac text key", num=DoubleType())
VERDICT = _struct("correct reason raw method gold_key pred_key", correct=BooleanType())


def _batched(fn: Callable[..., tuple], schema: StructType):
    """A function of columns to a struct of schema; fn gets the values of a row, None for nulls."""
    names = schema.names

    def run(*columns: pd.Series) -> pd.DataFrame:
        seen: dict[tuple, tuple] = {}
        rows = []
        for row in zip(*(c.astype(object).where(c.notna(), None) for c in columns), strict=True):
            if row not in seen:
                seen[row] = fn(*row)
            rows.append(seen[row])
        return pd.DataFrame(rows, columns=names)

    run.__annotations__ = {"columns": pd.Series, "return": pd.DataFrame}  # what Spark tells the kind of function by
    return F.pandas_udf(run, schema)


def _canonical(answer: str | None, kind: str | None) -> tuple:
    v = A.Form(answer).value(kind)
    return v.type, v.num, v.frac if v.frac is None else f"{v.frac.numerator}/{v.frac.denominator}", v.text, v.key


def _verify(prediction: str | None, gold: str | None, kind: str | None = None) -> tuple:
    asked = A.Form(gold)
    raw, method = A.extract(prediction)
    correct, reason, want, have = A.judge(asked, kind or asked.kind, raw)
    return correct, reason, raw, method, want.key, have and have.key


extract_udf = _batched(A.extract, EXTRACTED)
canonical_udf = _batched(_canonical, CANONICAL)
verify_udf = _batched(_verify, VERDICT)


def _text(name: str | None) -> Column:
    return F.lit(None).cast("string") if name is None else F.col(name).cast("string")


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns, which replace those of their names and come last."""
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, *(v.alias(k) for k, v in columns.items()))


def extract_answer(df: DataFrame, *fields: str, raw: str = "raw", method: str = "method") -> DataFrame:
    """df with raw and method: boxed, then #### marker, then Bengali marker of each field in turn; then a short bare field."""
    found = extract_udf(*map(_text, fields))
    return _with(df, **{raw: found["raw"], method: found["method"]})


def classify(df: DataFrame, answer: str, out: str = "answer_type") -> DataFrame:
    """df with the answer's type; missing for null or empty."""
    return _with(df, **{out: canonical_udf(_text(answer), _text(None))["type"]})


def canonical(df: DataFrame, answer: str, kind: str | None = None, out: str = "canonical") -> DataFrame:
    """df with struct(type, num, frac, text, key): comparable within a type, key for grouping and voting."""
    return _with(df, **{out: canonical_udf(_text(answer), _text(kind))})


def is_verifiable(value: str = "canonical") -> Column:
    """Of a canonical struct: whether it can be checked."""
    return F.coalesce(F.col(value)["type"].isin(*VERIFIABLE) & F.col(value)["key"].isNotNull(), F.lit(False))


def verify(df: DataFrame, prediction: str, gold: str, kind: str | None = None, out: str = "verdict") -> DataFrame:
    """df with struct(correct, reason, raw, method, gold_key, pred_key): the first step of the ladder that decides."""
    return _with(df, **{out: verify_udf(_text(prediction), _text(gold), _text(kind))})
