"""The driver's tables as logs, replica progress, group events and metric samples.

``records`` is the events table as a topic of four partitions: keys are user
ids (null for every fifth user), values the properties; every 97th record has
no timestamp and every 50th an early one; a batch holds a hundred records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.functions import scalars as S
from strandlog.functions import wire
from strandlog.operators import log

PARTITIONS, BATCH = 4, 100
SEGMENT_BYTES, INDEX_BYTES = 16384, 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def produced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as producers send them: no offsets, timestamps unset in places."""
    e = table(spark, sf_dir, "events")
    ms, n = F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id")
    raw = F.when(n % 97 == 0, 0).when(n % 50 == 0, ms - 3_600_000).otherwise(ms)
    key = F.when(F.col("user_id") % 5 != 0, F.col("user_id").cast("string"))
    e = e.select(F.lit("events").alias("topic"), n.alias("seq"), F.floor(n / BATCH).cast("long").alias("batch_id"), key.alias("key"), F.col("props").alias("value"), raw.cast("long").alias("raw_ms"), ms.alias("clock_ms"), F.when(n % 101 == 0, 4).otherwise(0).alias("attributes"))
    return log.route(e, PARTITIONS)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log: routed, stamped with append times, sized, with dense offsets per partition."""
    rows = produced(spark, sf_dir)
    clock = F.max("clock_ms").over(Window.partitionBy("batch_id"))
    rows = rows.withColumn("append_time_ms", clock).withColumn("timestamp_ms", F.when(F.col("raw_ms") <= 0, F.col("append_time_ms")).otherwise(F.col("raw_ms")))
    rows = rows.withColumn("size", S.record_size(F.col("key"), F.col("value")))
    return log.assign_offsets(rows).drop("raw_ms", "clock_ms")


#: Rows of a table that may be held by the driver and broadcast.
SMALL_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """The table, computed once and broadcast if it has few rows (of which there is one per partition or replica)."""
    rows = df.limit(SMALL_ROWS + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= SMALL_ROWS else df


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's state, a row per partition."""
    return small(log_state(records(spark, sf_dir)))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as it lies on disk: every record with its bytes, by slot (the place in its partition)."""
    r = records(spark, sf_dir)
    return r.withColumn("data", wire.encode(F.col("offset"), F.col("timestamp_ms"), F.col("attributes"), F.col("key"), F.col("value"))).withColumn("slot", F.col("offset"))


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored log after a crash: in partition 0 a bit is turned at 7/8, in 1 a record is missing at 9/10, in 2 the last one is cut short, in 3 only reserved space follows."""
    end = state(spark, sf_dir).select("topic", "partition", "log_end")
    rows = stored(spark, sf_dir).select("topic", "partition", "seq", "slot", "data").join(end, ["topic", "partition"])
    rows = rows.filter((F.col("partition") != 1) | (F.col("slot") != F.floor(F.col("log_end") * 9 / 10)))
    bad = F.when((F.col("partition") == 0) & (F.col("slot") == F.floor(F.col("log_end") * 7 / 8)), wire.turned(F.col("data")))
    short = F.when((F.col("partition") == 2) & (F.col("slot") == F.col("log_end") - 1), F.substring(F.col("data"), F.lit(1), F.octet_length("data") - 3))
    rows = rows.withColumn("data", F.coalesce(bad, short, F.col("data")))
    space = end.filter("partition = 3").select("topic", "partition", F.lit(None).cast("long").alias("seq"), F.col("log_end").alias("slot"), F.lit(bytes(64)).alias("data"), "log_end")
    return rows.select("topic", "partition", "seq", "slot", "data", "log_end").unionByName(space).drop("log_end")


def log_state(records: DataFrame) -> DataFrame:
    """One row per partition: log_start, log_end, flushed and high-water mark."""
    end = records.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("log_end"))
    part = lambda a, b: F.floor(F.col("log_end") * a / b).cast("long")
    return end.select("topic", "partition", part(1, 20).alias("log_start"), "log_end", part(8, 10).alias("flushed"), part(9, 10).alias("hwm"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Followers' reports in order: broker 1 or 2, an epoch, log end, flushed end, connected."""
    end = state(spark, sf_dir).select("topic", "partition", F.col("log_end").alias("leader_end"))
    n = F.col("event_id")
    e = table(spark, sf_dir, "events").select(n.alias("seq"), (n % 4).cast("int").alias("partition"), (1 + F.floor(n / 4) % 2).cast("int").alias("broker"), (n % 211 == 0).cast("long").alias("epoch"), (n % 13 != 0).alias("connected"))
    e = e.join(end, "partition")
    e = e.withColumn("log_end", F.floor(F.col("leader_end") * (F.col("seq") % 10 + 1) / 10).cast("long"))
    return e.withColumn("flushed", F.col("log_end") - F.floor(F.col("log_end") / 20).cast("long"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An offset journal: rewinds, tombstones, stale generations, negative and unassigned positions."""
    n = F.col("event_id")
    e = table(spark, sf_dir, "events")
    return e.select(
        n.alias("log_offset"), F.concat(F.lit("group-"), (n % 7).cast("string")).alias("group_id"), F.lit("events").alias("topic"), (F.floor(n / 7) % 5).cast("int").alias("partition"),
        F.when(n % 31 == 0, -5).otherwise(F.floor(n / 3) - n % 11).cast("long").alias("position"), F.unix_millis(F.col("ts").cast("timestamp")).alias("commit_time_ms"), (n % 23 == 0).alias("tombstone"),
        F.when(n % 17 == 0, "").when(n % 19 == 0, "stranger").otherwise(F.concat(F.lit("member-"), (n % 3).cast("string"))).alias("member_id"), F.when(n % 29 == 0, 1).otherwise(2).cast("int").alias("generation"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of all events: every sixty make four groups, whose last heartbeats lie within ten minutes."""
    n, k = F.col("event_id"), F.col("event_id") % 60
    group = F.concat(F.lit("group-"), (F.floor(n / 60) * 4 + n % 4).cast("string"))
    return table(spark, sf_dir, "events").select(group.alias("group_id"), F.concat(F.lit("g-"), F.floor(k / 4).cast("string")).alias("member_id"), (10_000 * k).cast("long").alias("heartbeat_ms"), F.lit(30_000).cast("long").alias("timeout_ms"), F.array(F.lit("events"), F.when(n % 8 == 3, F.lit("audit")).otherwise(F.lit("events"))).alias("topics"), n.alias("event_id"))
