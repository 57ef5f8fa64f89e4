"""Incremental loading: signatures, differences, and writes that replace only what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame, key: str, signature: list[str]) -> DataFrame:
    """key and change (created, updated, deleted, unchanged) between two snapshots."""
    mark = F.struct(*signature).alias
    a, b = before.select(F.col(key).alias("ka"), mark("sa")), after.select(F.col(key).alias("kb"), mark("sb"))
    change = F.when(F.col("ka").isNull(), "created").when(F.col("kb").isNull(), "deleted").when(F.col("sa").eqNullSafe(F.col("sb")), "unchanged").otherwise("updated")
    return a.join(b, F.col("ka") == F.col("kb"), "full").select(F.coalesce("ka", "kb").alias(key), change.alias("change"))


def file_signatures(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime and length of files, without their content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")


def reindex(rows: DataFrame, path: str, partition: str = "pack_id") -> None:
    """Replace the partitions that rows have, and no others."""
    rows.write.mode("overwrite").partitionBy(partition).option("partitionOverwriteMode", "dynamic").parquet(path)
