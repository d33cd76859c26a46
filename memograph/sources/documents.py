"""The document contract every source fulfils, and readers of landed exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("source_id", T.StringType()), T.StructField("workspace_id", T.StringType()),
    T.StructField("parent_id", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("author", T.StringType()),
    T.StructField("created_time", T.TimestampType()), T.StructField("last_edited_time", T.TimestampType()),
    T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("metadata", T.StringType()),
])


def as_documents(df: DataFrame, **fixed: str) -> DataFrame:
    """Project any frame onto the document columns; missing ones are null."""
    out = df
    for name, value in fixed.items():
        out = out.withColumn(name, F.lit(value))
    return out.select(*[
        (F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in DOCUMENT
    ])


def read_landed(spark: SparkSession, path: str, source: str, fmt: str = "json") -> DataFrame:
    """Tickets, drive files and other exports landed as JSON, Parquet or ORC, with a fixed schema."""
    reader = spark.read.schema(DOCUMENT) if fmt == "json" else spark.read
    found = reader.format(fmt).load(path)
    return as_documents(found.drop("source"), source=source)


def read_tickets(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return read_landed(spark, path, "jira", fmt)


def read_drive(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return read_landed(spark, path, "gdrive", fmt)
