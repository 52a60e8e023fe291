"""Table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one with this schema before its first write."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def append_new(df: DataFrame, existing: DataFrame, keys: Sequence[str], path: str, partition_by: Sequence[str] = ()) -> None:
    """Insert-or-ignore: rows whose key is absent; the first writer wins."""
    fresh = df.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")
    writer = fresh.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_export(documents: DataFrame, path: str, format: str = "markdown") -> None:
    """One folder per project; an existing export is never overwritten."""
    out = documents.select("project_id", F.col("document").alias("value"))
    out.write.mode("errorifexists").option("lineSep", "\n").partitionBy("project_id").text(path)
