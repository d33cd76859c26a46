"""Keyed tables on Parquet: a write replaces rows by key inside the partitions it touches."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memograph.operators.upsert import keep_by
from memograph.session import cut_lineage, prepare


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(and_, [left[c].eqNullSafe(right[c]) for c in columns])


def remove_folders(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete partition folders; one call per partition, never per row."""
    jvm = spark._jvm
    for folder in folders:
        place = jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def partition_folders(rows: DataFrame) -> list[str]:
    """Folders of the files that hold these rows of a stored table."""
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    return [r["folder"] for r in rows.select(folder.alias("folder")).distinct().collect()]


def upsert(rows: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], partitions: Sequence[str]) -> None:
    """Insert-or-replace by key, wherever the key lies.

    Partitions that hold an incoming key or receive one are read and rewritten,
    so a key whose partition value changes leaves its old partition; a partition
    that loses its last row goes. Null keys and null partition values match
    themselves. The merged rows are staged in the shared folder first, because a
    partition cannot be overwritten while it is being read. Rows of one
    partition value may span many files: nothing is gathered by partition.
    """
    spark = prepare(rows.sparkSession)
    incoming = cut_lineage(keep_by(rows, keys, order, newest=True))
    current = read_table(spark, path)
    if current is None:
        merged, emptied = incoming, []
    else:
        replaced = current.join(incoming.select(*keys), _same(current, incoming, keys), "left_semi")
        touched = cut_lineage(incoming.select(*partitions).unionByName(replaced.select(*partitions)).distinct())
        kept = current.join(touched, _same(current, touched, partitions), "left_semi").select(*incoming.columns)
        merged = cut_lineage(kept.join(incoming.select(*keys), _same(kept, incoming, keys), "left_anti").unionByName(incoming))
        left = touched.join(merged, _same(touched, merged, partitions), "left_anti")
        emptied = partition_folders(current.join(left, _same(current, left, partitions), "left_semi"))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
    remove_folders(spark, emptied)


def reset_workspace(spark: SparkSession, path: str, workspace_id: str | None) -> None:
    """Remove a workspace's rows from a table partitioned by workspace_id first; the table must exist.

    Only the workspace's own partition folders are deleted; others are not read or rewritten.
    """
    remove_folders(spark, partition_folders(spark.read.parquet(path).filter(F.col("workspace_id").eqNullSafe(workspace_id))))
