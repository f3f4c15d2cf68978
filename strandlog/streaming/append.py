"""A streaming producer: micro-batches become log records with dense offsets.

``foreachBatch`` is the single writer. A batch's offsets continue from the ends
of the log as it stood before that batch, which a small table beside the log
keeps, one row per partition and micro-batch; the batch id is a partition column
of both, so a batch that runs again after a failure replaces its own files and
gets the same offsets. The file sink of a batch that has ended is read exactly
once: stronger than the at-least-once delivery of a producer that sends again
after an unanswered request, whose repeats are records like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from strandlog.functions import scalars as S
from strandlog.operators import log

ENDS = "topic string, partition int, log_end long, micro_batch long"


def exists(spark, path: str) -> bool:
    """Whether there is a file or folder at the path, in any file system that Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def ends_before(spark, path: str, micro_batch: int) -> DataFrame | None:
    """Log ends per partition after all earlier micro-batches; None for a log that does not exist yet."""
    if not exists(spark, f"{path}/_ends"):
        return None
    held = spark.read.schema(ENDS).parquet(f"{path}/_ends")
    return held.filter(F.col("micro_batch") < micro_batch).groupBy("topic", "partition").agg(F.max("log_end").alias("log_end"))


def append_rows(rows: DataFrame, path: str, micro_batch: int) -> None:
    """Write routed and sized rows (topic, partition, seq, batch_id, size, ...) behind the log's ends, then the new ends."""
    spark = rows.sparkSession
    out = log.assign_offsets(rows, ends_before(spark, path, micro_batch)).withColumn("micro_batch", F.lit(micro_batch).cast("long"))
    sink = lambda df, to, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("micro_batch", *by).parquet(to)
    sink(out, f"{path}/data", "topic", "partition")
    written = spark.read.parquet(f"{path}/data").filter(F.col("micro_batch") == micro_batch)  # one folder
    sink(written.groupBy("topic", "partition", "micro_batch").agg((F.max("offset") + 1).alias("log_end")).select("topic", F.col("partition").cast("int"), "log_end", "micro_batch"), f"{path}/_ends")


def append_batch(path: str, partitions: int):
    """The writer of one micro-batch of (topic, seq, batch_id, key, value, timestamp_ms) rows."""

    def write(batch: DataFrame, micro_batch: int) -> None:
        rows = log.route(batch, partitions).withColumn("size", S.record_size(F.col("key"), F.col("value")))
        append_rows(rows, path, micro_batch)

    return write


def append_stream(records: DataFrame, path: str, partitions: int, checkpoint: str) -> DataStreamWriter:
    return records.writeStream.foreachBatch(append_batch(path, partitions)).option("checkpointLocation", checkpoint)
