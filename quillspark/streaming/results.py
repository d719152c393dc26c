"""Grading as a stream: JSON lines arrive in a folder, each (benchmark, eval_id, script) is graded once."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators import evaluate

KEYS = ["benchmark", "eval_id", "script"]
SCHEMA = "benchmark string, eval_id string, script string, gold_answer string, answer_type string, output string, seq long"


def first_lines(lines: DataFrame) -> DataFrame:
    """The row with the least seq of each key of a batch of SCHEMA, rows without one last; by partial aggregation."""
    rest = [c.split()[0] for c in SCHEMA.split(", ")][len(KEYS) :]
    least = lines.groupBy(*KEYS).agg(F.min_by(F.struct(*rest), F.struct(F.col("seq").isNull(), "seq")).alias("_r"))
    return least.select(*KEYS, *[F.col("_r")[c].alias(c) for c in rest])


def grade_stream(spark: SparkSession, source: str, out: str, checkpoint: str) -> StreamingQuery:
    """Grade what is in source and not yet in out, then stop; a later call goes on from checkpoint.

    Of equal keys in one batch the least seq counts, of later ones none. Each batch has its folder in out,
    batch=N, which a repetition of that batch replaces; the keys of those before it are the state. Undecodable
    lines are skipped.
    """

    def grade(lines: DataFrame, n: int) -> None:
        new = first_lines(lines)
        if n:
            done = lines.sparkSession.read.schema(", ".join(f"{k} string" for k in KEYS) + ", batch long").parquet(out).where(F.col("batch") < n).select(*[F.col(k).alias(f"_{k}") for k in KEYS])
            new = new.join(done, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS)), "left_anti")
        evaluate.grade(new).write.mode("overwrite").parquet(f"{out}/batch={n}")

    lines = spark.readStream.schema(SCHEMA).option("mode", "DROPMALFORMED").json(source)
    return lines.writeStream.foreachBatch(grade).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
