"""Sources and sinks: yearly files, JSON records and objects, parallel arrays, resumable results."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .json_splits import json_entries


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, in whatever file system it names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def scratch(spark: SparkSession) -> str:
    """A new name in the folder that all executors share; in a local session without one, among its temporary files."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.gettempdir()
    return f"{root}/eventloom-{uuid.uuid4().hex}"


def read_years(spark: SparkSession, pattern: str, years: list[int], schema: StructType | str, fmt: str = "csv") -> DataFrame:
    """One file per year, missing years skipped, columns that a year lacks filled with null.

    ``pattern`` has ``{year}`` in it. The schema is declared, never inferred, so that codes stay strings.
    """
    paths = [p for p in (pattern.format(year=y) for y in years) if exists(spark, p)]
    reader = spark.read.schema(schema).option("header", True)
    if not paths:
        return spark.createDataFrame([], schema)
    return reader.format(fmt).load(paths) if fmt != "csv" else reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [reader.option("enforceSchema", False).csv(p) for p in paths])


def read_json_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that hold one JSON array of records each, of any size: a file is read in splits."""
    kind = schema if isinstance(schema, str) else schema.simpleString().removeprefix("struct<").removesuffix(">")
    rows = json_entries(spark, path).select(F.explode(F.from_json(F.concat(F.lit("["), "entry", F.lit("]")), f"array<struct<{kind}>>")).alias("_r"))
    return rows.select("_r.*")


def read_keyed_json(spark: SparkSession, path: str, value_schema: str, key: str = "accession") -> DataFrame:
    """Files that hold one JSON object keyed by id, of any size: a row per key, read in splits."""
    rows = json_entries(spark, path).select(F.explode(F.from_json(F.concat(F.lit("{"), "entry", F.lit("}")), f"map<string,{value_schema}>")).alias(key, "_v"))
    return rows.select(key, "_v.*")


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed lines are dropped."""
    kind = StructType([*spark.createDataFrame([], schema).schema.fields, StructField("_bad", StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("_r"))
    return parsed.select("_r.*").filter(F.col("_bad").isNull()).drop("_bad")


def explode_submissions(docs: DataFrame, form: str, year: int, arrays: str = "recent") -> DataFrame:
    """From parallel arrays form, filingDate and accessionNumber to one row per filing of a form and year."""
    each = docs.withColumn("_x", F.explode(F.arrays_zip(*[F.col(f"{arrays}.{c}").alias(c) for c in ("form", "filingDate", "accessionNumber")])))
    rows = each.select(*[c for c in docs.columns if c != arrays], F.col("_x.form").alias("form"), F.col("_x.filingDate").alias("filing_date"), F.col("_x.accessionNumber").alias("accession"))
    return rows.filter((F.col("form") == form) & F.col("filing_date").startswith(str(year)))


def id_map(records: DataFrame, name: str, number: str, position: str, width: int = 10) -> DataFrame:
    """Name to zero-padded id; of several records for a name the last by position holds."""
    return records.groupBy(name).agg(F.lpad(F.max_by(F.col(number).cast("string"), position), width, "0").alias("padded_id"))


def complete_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the finished ones."""
    return df.join(done.select(key), key, "left_anti")


def successful(df: DataFrame, columns: list[str], status: str = "status", value: str = "success") -> DataFrame:
    return df.filter(F.col(status) == value).select(*columns)


def write_with_metadata(df: DataFrame, path: str, text_col: str, partition: str | None = None) -> None:
    """The table, and beside it the table without its wide text column."""
    for name, part in (("full", df), ("metadata", df.drop(text_col))):
        writer = part.write.mode("overwrite")
        (writer.partitionBy(partition) if partition else writer).parquet(f"{path}/{name}")


def write_splits(df: DataFrame, path: str, split: str = "split", formats: tuple[str, ...] = ("csv", "json")) -> None:
    for fmt in formats:
        writer = df.write.mode("overwrite").partitionBy(split)
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(f"{path}/{fmt}")
