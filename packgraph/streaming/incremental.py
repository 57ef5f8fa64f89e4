"""Streams: new files of a folder into a partitioned index, and windowed counts of events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def index_new_files(spark: SparkSession, folder: str, schema: str, index: str, checkpoint: str, partition: str = "pack_id") -> StreamingQuery:
    """Every JSON file of the folder once. The index is partitioned by pack and by source file, and a batch replaces only the
    partitions of the files that it reads: a pack whose files come in several batches keeps all of them, and a batch that is
    run again after a failure writes the same rows again. Ends when all files are in."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").partitionBy(partition, "source_file").option("partitionOverwriteMode", "dynamic").parquet(index)

    path = F.input_file_name()
    named = F.concat(F.element_at(F.split(path, "/"), -1), F.lit("-"), F.lower(F.hex(F.xxhash64(path))))  # files of one name in two folders are two
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(folder).withColumn("source_file", named)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; events later than the watermark are dropped by a stream, by no batch."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")
