"""Sources and sinks: JSON arrays and lines, delimited text, Parquet; folders of benchmarks; what would be published."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from quillspark.operators import splits

#: Names of question columns, the likeliest first.
QUESTION_HINTS = ("question", "problem", "query")


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines without those that can't be decoded, such as a torn last one."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', sep=sep, maxCharsPerColumn=-1)


def wrapped_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array, JSON lines (by the suffix .jsonl) or one object whose rows are below data; columns as found."""
    df = spark.read.option("multiLine", not path.endswith(".jsonl")).json(path)
    if "data" in df.columns and df.schema["data"].dataType.typeName() == "array":
        return df.select(F.explode("data").alias("_row")).select("_row.*")
    return df


def load_benchmark(rows: DataFrame, limit: int | None = None, sample: int | None = None, stratum: str = "stratum", seed: int = 0, gradable: bool = True) -> DataFrame:
    """Eval records: those that can be graded (verifiable, with two different variants), then a sample over strata, then a limit, in this order."""
    out = rows.where("verifiable and variants_differ") if gradable else rows
    if sample and out.count() > sample:
        out = splits.sample(out, stratum, sample, seed)
    return out if limit is None else out.orderBy("eval_id").limit(limit)


def question_column(names: list[str]) -> str | None:
    """The column of questions: a hint itself, else the first name that contains one."""
    lower = {n.lower(): n for n in reversed(names)}
    exact = next((lower[h] for h in QUESTION_HINTS if h in lower), None)
    return exact or next((n for h in QUESTION_HINTS for n in names if h in n.lower()), None)


def question_columns(names: list[str]) -> list[str]:
    """All columns whose name contains a hint, else what question_column finds."""
    found = [n for n in names if any(h in n.lower() for h in QUESTION_HINTS)]
    return found or [c for c in [question_column(names)] if c]


def questions(df: DataFrame, columns: list[str], benchmark: str, ord_: int) -> DataFrame:
    """(benchmark, ord, question): one row per non-blank cell of the columns."""
    cell = F.explode(F.array(*[F.col(f"`{c}`").cast("string") for c in columns])).alias("question")
    return df.select(F.lit(benchmark).alias("benchmark"), F.lit(ord_).alias("ord"), cell).where("trim(question) != ''")


def children(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(path, whether it is a folder) of what lies in a folder, sorted, by Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted((s.getPath().toString(), s.isDirectory()) for s in fs.listStatus(p))


def benchmark_questions(spark: SparkSession, root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(benchmark, ord, question) of all files in the folders below root, in the order of their names.

    A folder is a benchmark; ord counts files. Delimited files give all their question columns, others
    the likeliest one. Files of other kinds, or without a question column, give nothing.
    """
    out = spark.createDataFrame([], "benchmark string, ord int, question string")
    ord_ = 0
    for folder, is_folder in children(spark, root):
        name = folder.rsplit("/", 1)[1]
        if not is_folder or name in skip:
            continue
        for path, _ in children(spark, folder):
            kind = path.rsplit(".", 1)[-1].lower()
            if kind in ("csv", "tsv"):
                df = delimited(spark, path, "," if kind == "csv" else "\t")
                columns = question_columns(df.columns)
            elif kind in ("parquet", "json", "jsonl"):
                df = spark.read.parquet(path) if kind == "parquet" else wrapped_json(spark, path)
                columns = [c for c in [question_column(df.columns)] if c]
            else:
                continue
            if columns:
                out = out.unionByName(questions(df, columns, name, ord_))
            ord_ += 1
    return out


def missing_primary(registry: DataFrame, found: DataFrame) -> DataFrame:
    """The primary benchmarks of registry (name, role) that found (name) lacks."""
    return registry.where("role = 'primary'").join(found.select("name").distinct(), "name", "left_anti").select("name")


def manifest(spark: SparkSession, registry: DataFrame, root: str) -> DataFrame:
    """registry (name, role, ...) with downloaded: the sorted names of the files in each one's folder below root."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    folders = children(spark, root) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else []
    found = [(folder.rsplit("/", 1)[1], path.rsplit("/", 1)[1]) for folder, is_folder in folders if is_folder for path, below in children(spark, folder) if not below]
    files = spark.createDataFrame(found, "name string, file string").groupBy("name").agg(F.array_sort(F.collect_list("file")).alias("downloaded"))
    return registry.join(files, "name", "left").withColumn("downloaded", F.coalesce("downloaded", F.array().cast("array<string>")))


def gaps(manifest_rows: DataFrame) -> DataFrame:
    """(benchmark, problem) of the primary benchmarks without files, as gates takes them."""
    lacking = manifest_rows.where((F.col("role") == "primary") & (F.size("downloaded") == 0))
    return lacking.select(F.col("name").alias("benchmark"), F.lit("not downloaded").alias("problem"))


def write_json_array(df: DataFrame, path: str) -> None:
    """A folder of JSON arrays, one a partition, each row on a line of its own; json_array reads them as one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = False
        for pdf in frames:
            if len(pdf):
                lines = [("," if opened or i else "[") + x for i, x in enumerate(pdf["json"])]
                opened = True
                yield pd.DataFrame({"value": lines})
        yield pd.DataFrame({"value": ["]" if opened else "[]"]})

    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json")).mapInPandas(run, "value string").write.text(path)


def publish_plan(spark: SparkSession, root: str, allow: tuple[str, ...], never: tuple[str, ...] = ()) -> DataFrame:
    """(path, bytes) of the files below root that would be published: relative paths that allow lists, or whose folder it lists.

    Paths that never lists, likewise, are left out whatever allow says. No content is read.
    """
    base = children(spark, root)
    at = (base[0][0].rsplit("/", 1)[0] if base else root).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.substring("path", len(at) + 1, 1 << 20).alias("path"), F.col("length").alias("bytes"))

    def listed(names: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for n in names:
            found = found | (F.col("path") == n) | F.startswith("path", F.lit(n.rstrip("/") + "/"))
        return found

    return files.where(listed(allow) & ~listed(never))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; mode append adds to a log."""
    df.write.mode(mode).json(path)


def report(df: DataFrame, *aggregates: Column) -> DataFrame:
    """One row (json): a stage's counters."""
    return df.agg(*aggregates).select(F.to_json(F.struct("*")).alias("json"))
