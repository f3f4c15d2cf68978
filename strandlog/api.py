"""A log in a folder: topics, appends, reads and group positions as DataFrames.

Layout: ``topics`` (a row per topic), ``log/data`` (records by append, topic and
partition), ``log/_ends`` (log ends after each append) and ``journal`` (commits). One
writer at a time; readers see whole appends. Delivery to a group is at least
once: a position is committed after its records were read, and a reader that
fails before reads them again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.functions import scalars as S
from strandlog.model import EARLIEST, LATEST, LOG, READ_COMMITTED, READ_UNCOMMITTED
from strandlog.operators import cluster, log
from strandlog.streaming import append

TOPICS = "topic string, partitions int, version long, deleted boolean"
JOURNAL = "log_offset long, group_id string, topic string, partition int, position long, commit_time_ms long, metadata string, tombstone boolean"


@dataclass(frozen=True)
class Options:
    """Settings of storage, topics and groups that change what the log computes."""

    default_partitions: int = 4
    segment_bytes: int = 64 << 20
    segment_ms: int = 0
    index_bytes: int = 4096
    retention_ms: int = 0
    retention_bytes: int = 0
    session_timeout_ms: int = 10_000
    max_poll_bytes: int = 1 << 20


class Log:
    """A log below ``path``. Statuses are names of errors, OK if there is none."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options or Options()

    def _table(self, name: str, schema: str) -> DataFrame:
        if append.exists(self.spark, f"{self.path}/{name}"):
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return self.spark.createDataFrame([], schema)

    def topics(self) -> DataFrame:
        """topic, partitions of topics that are there."""
        last = self._table("topics", TOPICS).groupBy("topic").agg(F.max_by(F.struct("partitions", "deleted"), "version").alias("t"))
        return last.filter("NOT t.deleted").select("topic", "t.partitions")

    def _put_topic(self, topic: str, partitions: int, deleted: bool) -> None:
        version = self._table("topics", TOPICS).count()
        self.spark.createDataFrame([(topic, partitions, version, deleted)], TOPICS).coalesce(1).write.mode("append").parquet(f"{self.path}/topics")

    def create_topic(self, topic: str, partitions: int | None = None) -> str:
        """CREATED; OK if it is there with as many partitions, ALREADY_EXISTS with others, INVALID_ARGUMENT for a bad name or count."""
        n = self.options.default_partitions if partitions is None else partitions
        if n < 1 or not self.spark.range(1).select(S.valid_topic(F.lit(topic))).first()[0]:
            return "INVALID_ARGUMENT"
        held = self.topics().filter(F.col("topic") == topic).first()
        if held:
            return "OK" if held.partitions == n else "ALREADY_EXISTS"
        self._put_topic(topic, n, False)
        return "CREATED"

    def delete_topic(self, topic: str) -> str:
        """OK, or NOT_FOUND; its records are no longer read."""
        if not self.topics().filter(F.col("topic") == topic).limit(1).count():
            return "NOT_FOUND"
        self._put_topic(topic, 0, True)
        return "OK"

    def records(self) -> DataFrame:
        """All records of topics that are there."""
        schema = "seq long, batch_id long, key string, value string, timestamp_ms long, size long, offset long, micro_batch long, topic string, partition int"
        data = self._table("log/data", schema)
        return data.join(self.topics().select("topic"), "topic", "left_semi")

    def produce(self, rows: DataFrame) -> None:
        """Append rows (topic, key, value, timestamp_ms), in the order of ``seq`` if they have it; topics that are missing are created."""
        known = self.topics()
        named = rows.select("topic").distinct().join(known, "topic", "left_anti").collect()  # a row per new topic
        for r in named:
            if self.create_topic(r.topic) == "INVALID_ARGUMENT":
                raise ValueError(f"bad topic name: {r.topic}")
        rows = rows if "seq" in rows.columns else rows.withColumn("seq", F.monotonically_increasing_id())
        rows = rows.withColumn("batch_id", F.floor(F.col("seq") / 100)).join(self.topics(), "topic")
        by_batch = F.pmod("batch_id", "partitions").cast("int")
        by_key = (S.crc32c(F.col("key")).bitwiseAND(F.lit(0x7FFFFFFF)) % F.col("partitions")).cast("int")
        rows = rows.withColumn("partition", F.when(F.col("key").isNull(), by_batch).otherwise(by_key)).withColumn("size", S.record_size(F.col("key"), F.col("value")))
        ends = self._table("log/_ends", append.ENDS)
        number = (ends.agg(F.max("micro_batch")).first()[0] or 0) + 1
        append.append_rows(rows.select("topic", "partition", "seq", "batch_id", "key", "value", "timestamp_ms", "size"), f"{self.path}/log", number)

    def state(self) -> DataFrame:
        """topic, partition, log_start, log_end, flushed, hwm of every partition, empty ones too; what was appended is flushed and replicated by the store."""
        ends = self._table("log/_ends", append.ENDS).groupBy(*LOG).agg(F.max("log_end").alias("log_end"))
        every = self.topics().select("topic", F.explode(F.sequence(F.lit(0), F.col("partitions") - 1)).alias("partition"))
        end = F.coalesce("log_end", F.lit(0))
        return every.join(ends, list(LOG), "left").select(*LOG, F.lit(0).cast("long").alias("log_start"), end.alias("log_end"), end.alias("flushed"), end.alias("hwm"))

    def offsets(self) -> DataFrame:
        """topic, partition, earliest, latest."""
        return self.state().select(*LOG, F.col("log_start").alias("earliest"), F.col("log_end").alias("latest"))

    def read(self, topic: str, start: int = EARLIEST, max_bytes: int | None = None, committed: bool = True) -> DataFrame:
        """Records of every partition of a topic from an offset (or EARLIEST, LATEST), as many as a byte budget takes."""
        state = self.state().filter(F.col("topic") == topic)
        isolation = READ_COMMITTED if committed else READ_UNCOMMITTED
        budget = self.options.max_poll_bytes if max_bytes is None else max_bytes
        asked = state.select(F.col("partition").cast("string").alias("req_id"), *LOG, F.lit(start).cast("long").alias("start"), F.lit(budget).alias("max_bytes"), F.lit(isolation).alias("isolation"))
        return log.fetch(self.records().filter(F.col("topic") == topic), state, asked).select("topic", "partition", "offset", "timestamp_ms", "key", "value")

    def commit(self, group: str, positions: DataFrame, now_ms: int = 0) -> None:
        """Add positions (topic, partition, position) of a group to the journal."""
        journal = self._table("journal", JOURNAL)
        base = (journal.agg(F.max("log_offset")).first()[0] or 0) + 1
        place = F.row_number().over(Window.orderBy("topic", "partition")) - 1  # a row per partition of a group
        rows = positions.select((F.lit(base) + place).cast("long").alias("log_offset"), F.lit(group).alias("group_id"), "topic", F.col("partition").cast("int").alias("partition"), F.col("position").cast("long").alias("position"), F.lit(now_ms).cast("long").alias("commit_time_ms"), F.lit("").alias("metadata"), F.lit(False).alias("tombstone"))
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/journal")

    def committed(self, group: str) -> DataFrame:
        """topic, partition, position of a group's last commits."""
        return cluster.committed(self._table("journal", JOURNAL)).filter(F.col("group_id") == group).select("topic", "partition", "position")

    def group_read(self, group: str, topics: list[str], max_bytes: int | None = None) -> DataFrame:
        """What a group has not read yet of its topics: records from its committed positions on, each partition to the byte budget.

        A partition without a commit is read from its start, one whose position
        has left the log too. Commit ``next_positions`` of what was handled.
        """
        state = self.state().filter(F.col("topic").isin(topics))
        at = state.join(self.committed(group), list(LOG), "left")
        start = F.when(F.col("position").between(F.col("log_start"), F.col("log_end")), F.col("position")).otherwise(F.col("log_start"))
        budget = self.options.max_poll_bytes if max_bytes is None else max_bytes
        asked = at.select(F.concat_ws("-", "topic", F.col("partition").cast("string")).alias("req_id"), *LOG, start.alias("start"), F.lit(budget).alias("max_bytes"), F.lit(READ_COMMITTED).alias("isolation"))
        return log.fetch(self.records().filter(F.col("topic").isin(topics)), state, asked).select("topic", "partition", "offset", "timestamp_ms", "key", "value")

    @staticmethod
    def next_positions(read: DataFrame) -> DataFrame:
        """The positions to commit after these records."""
        return read.groupBy(*LOG).agg((F.max("offset") + 1).alias("position"))

    def lag(self, group: str) -> DataFrame:
        """topic, partition, lag of a group."""
        return self.state().join(self.committed(group), list(LOG), "left").select(*LOG, (F.col("log_end") - F.coalesce("position", "log_start")).alias("lag"))

    def health(self) -> DataFrame:
        """One row: topics, partitions and records that the log holds."""
        return self.state().agg(F.countDistinct("topic").alias("topics"), F.count("*").alias("partitions"), F.coalesce(F.sum("log_end"), F.lit(0)).alias("records"))


__all__ = ["EARLIEST", "LATEST", "Log", "Options"]
