"""Tables that are appended to or replaced by parts, so that a batch that is written twice counts once."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shared import written

_BATCH = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


def _replaced(df: DataFrame, path: str, *parts: str) -> None:
    """Write rows by parts; only the parts that the rows have are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def append_once(df: DataFrame, path: str, batch: str) -> None:
    """Append the rows of a batch, under a key that is always the same for it, to the table at a path.

    A batch has a part of the table of its own, which a second run replaces: nothing of it is there twice, and rows of other
    batches stay. A batch without rows leaves what an earlier run of it wrote.
    """
    if not _BATCH.fullmatch(batch):
        raise ValueError("a batch's key has letters, digits, dots, hyphens and low lines")
    _replaced(df.withColumn("batch", F.lit(batch)), path, "batch")


def appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table of append_once with its column `batch`; the schema is that of the rows. A filter on batch reads its part alone."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.StringType())])).parquet(path)


def day_parts(day: Column) -> dict[str, Column]:
    return {"y": F.date_format(day, "yyyy"), "m": F.date_format(day, "MM"), "d": F.date_format(day, "dd")}


def write_days(df: DataFrame, path: str, day: str) -> None:
    """Write rows under path/y=YYYY/m=MM/d=DD by a date or timestamp column, in place of the days that the rows have; other days
    stay. Rows without a day go to Hive's default folder. Each day is one task's, spread further where it is large."""
    parts = day_parts(F.col(day))
    _replaced(df.withColumns(parts).hint("rebalance", *parts), path, *parts)


def read_days(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table of write_days; y, m and d are texts, and filters on them read only the days asked for."""
    return spark.read.schema(T.StructType([*schema.fields, *(T.StructField(p, T.StringType()) for p in "ymd")])).parquet(path)


def read_csv(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a CSV corpus of a declared schema, and the lines that don't fit it.

    Texts are quoted, hold line breaks, and double their quotes; \\N without quotes is null. A line with a value of another type or
    with too few or too many columns is a reject: its text stands in `line`.
    """
    schema = T.StructType.fromDDL(ddl)
    read = spark.read.schema(T.StructType([*schema.fields, T.StructField("_line", T.StringType())])).option("columnNameOfCorruptRecord", "_line")
    # parsed once and whole: a scan of some columns alone would find fewer faults
    rows = written(read.csv(path, header=True, mode="PERMISSIVE", multiLine=True, escape='"', quote='"', nullValue="\\N", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))
    return rows.where("_line is null").drop("_line"), rows.where("_line is not null").select(F.col("_line").alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    """Rows as read_csv reads them."""
    df.write.csv(path, header=True, quoteAll=True, escape='"', quote='"', nullValue="\\N", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
