"""Reading with a contract, writing results."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, NumericType, StringType, StructField, StructType

from brindle.functions.columns import nan_to_null
from brindle.sources.shared import written


#: Columns beside those of a file: a line that could not be read, and the file's name.
CORRUPT, FILE = "__unreadable", "__file"


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The same table; ValueError with the sorted names if columns are missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, required: Iterable[str] = ()) -> DataFrame:
    """CSV with a header; NaN becomes NULL.  Without a schema the types are inferred (an extra pass)."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return require(nan_to_null(reader.csv(path)), required)


@dataclass(frozen=True)
class CheckedRows:
    """What a file held: rows of the schema, lines that are none (with their file), and the number of each by file."""

    good: DataFrame
    bad: DataFrame
    report: DataFrame


def read_csv_checked(spark: SparkSession, path: str, schema: StructType | str, required: Iterable[str] = (), header: bool = True) -> CheckedRows:
    """CSV whose unreadable lines are set aside: values of another type, too many fields or too few.

    Lines are parsed once, with all columns, and written to the shared folder;
    both tables and the report read that.  ValueError if the header lacks a
    required column.  NaN becomes NULL.
    """
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if header:
        require(spark.read.option("header", True).csv(path), required)
    else:
        require(spark.createDataFrame([], wanted), required)
    fields = StructType([*wanted.fields, StructField(CORRUPT, StringType())])
    rows = spark.read.option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(fields).csv(path)
    rows = written(rows.withColumn(FILE, F.col("_metadata.file_name")), "csv")
    good, bad = rows.filter(F.col(CORRUPT).isNull()), rows.filter(F.col(CORRUPT).isNotNull())
    report = rows.groupBy(F.col(FILE).alias("file")).agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col(CORRUPT).isNull()).alias("good"), F.count(CORRUPT).alias("bad"))
    return CheckedRows(nan_to_null(good.select(*[F.col(f"`{f.name}`") for f in wanted])), bad.select(F.col(FILE).alias("file"), F.col(CORRUPT).alias("line")), report)


def read_table(spark: SparkSession, path: str, kind: str = "parquet", required: Iterable[str] = ()) -> DataFrame:
    """Any of Spark's file formats; NaN becomes NULL."""
    return require(nan_to_null(spark.read.format(kind).load(path)), required)


def read_matrix(spark: SparkSession, path: str, metadata: Sequence[str], kind: str = "parquet") -> tuple[DataFrame, list[str]]:
    """A table and its feature columns: the numeric ones that are not metadata, in file order."""
    df = read_table(spark, path, kind)
    features = [f.name for f in df.schema if f.name not in set(metadata) and isinstance(f.dataType, NumericType)]
    if not features:
        raise ValueError("no feature columns")
    return df, features


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Overwrite a table."""
    writer = df.write.mode("overwrite").format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def _put(path: str | Path, content: str) -> None:
    """A small file, by Spark's file systems: a local path, or any store that Spark writes to."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("an active session is needed")
    at = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def write_json(path: str | Path, content: object) -> None:
    """Small metadata, from the driver."""
    _put(path, json.dumps(content, indent=2, ensure_ascii=False, sort_keys=True) + "\n")


def write_text(path: str | Path, content: str) -> None:
    """A report or drawing, stripped, with one newline at its end."""
    _put(path, content.strip() + "\n")


def write_results(df: DataFrame, path: str) -> None:
    """A result table twice: Parquet under ``path``, and CSV under ``path`` + ``.csv`` with nested columns as JSON."""
    write_table(df, path)
    flat = [F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, ArrayType | MapType | StructType) else F.col(f"`{f.name}`") for f in df.schema]
    write_table(df.sparkSession.read.schema(df.schema).parquet(path).select(*flat), path + ".csv", "csv")


def need(spark: SparkSession, *paths: str) -> None:
    """FileNotFoundError, with the names, unless every table that a step builds on is there."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    missing = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(conf).exists(at):
            missing.append(path)
    if missing:
        raise FileNotFoundError(f"run the earlier steps first; missing: {missing}")
