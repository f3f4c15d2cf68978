"""Names, registries, polls, admission, journals and documents around the log."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions.wire import _column
from strandlog.model import LOG
from strandlog.operators import log

METADATA_HEADER = "#strandlog-metadata 1"


def sorted_brokers(brokers: DataFrame, keys: list[str]) -> DataFrame:
    """Brokers (keys, broker) with their slot in order of id; a registry that names one twice is INVALID_ARGUMENT whole, without slots."""
    w = Window.partitionBy(*keys)
    out = brokers.withColumn("slot", F.row_number().over(w.orderBy("broker")) - 1)
    out = out.withColumn("_again", (F.lag("broker").over(w.orderBy("broker")) == F.col("broker")).cast("int"))
    bad = F.coalesce(F.max("_again").over(w), F.lit(0)) == 1
    return out.withColumn("status", F.when(bad, "INVALID_ARGUMENT").otherwise("OK")).withColumn("slot", F.when(~bad, F.col("slot"))).drop("_again")


def poll(assigned: DataFrame, state: DataFrame) -> DataFrame:
    """What one poll of every member does: owner, topic, partition, position, outcome, next_place.

    ``assigned``: owner, place (of the partition among the owner's), n (the
    owner's partitions), next_place (where the round robin stands), topic,
    partition, position. Partitions are tried in turn from next_place: one whose
    position is outside of the log is set to its start and passed by (RESET),
    one without records is passed by (EMPTY), the first with records is read
    (READ), and those after it wait (WAIT).
    """
    out = assigned.join(state.select(*LOG, "log_start", "log_end"), list(LOG)).withColumn("attempt", F.pmod(F.col("place") - F.col("next_place"), F.col("n")))
    outside = (F.col("position") < F.col("log_start")) | (F.col("position") > F.col("log_end"))
    kind = F.when(outside, "RESET").when(F.col("position") == F.col("log_end"), "EMPTY").otherwise("READ")
    out = out.withColumn("_kind", kind)
    first = F.min(F.when(F.col("_kind") == "READ", F.col("attempt"))).over(Window.partitionBy("owner"))
    out = out.withColumn("_first", first)
    outcome = F.when(F.col("attempt") > F.col("_first"), "WAIT").otherwise(F.col("_kind"))
    after = F.when(F.col("_first").isNull(), F.col("next_place")).otherwise((F.col("next_place") + F.col("_first") + 1) % F.col("n"))
    return out.withColumn("outcome", outcome).withColumn("position", F.when(F.col("outcome") == "RESET", F.col("log_start")).otherwise(F.col("position"))).withColumn("next_place", after.cast("int")).drop("_kind", "_first", "attempt", "log_start", "log_end", "n")


def admit(requests: DataFrame, keys: list[str], order: str, limit: int) -> DataFrame:
    """Requests with ``status``: the first ``limit`` of each queue (keys) are OK, the others are told BACKPRESSURE and may try again."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return requests.withColumn("status", F.when(place <= limit, "OK").otherwise("BACKPRESSURE"))


def waiters(requests: DataFrame, events: DataFrame, replicas: int) -> DataFrame:
    """When every produce request is answered: req_id, status, done_ms.

    ``requests``: req_id, topic, partition, mode (none, leader, quorum),
    last_offset, sent_ms, deadline_ms. ``events``: topic, partition, at_ms, and the
    running state after each: log_end, and flushed ends of leader and followers
    in sync as an array ``flushed``. A request ends OK at the first event from
    its sending on that meets its mode (none: at once), else TIMEOUT at its deadline.
    """
    # Of each mode the end that counts; the first event that passes an offset is an as-of lookup, no pairs are made.
    quorum = F.element_at(F.sort_array("flushed", asc=False), replicas // 2 + 1)
    found = []
    for mode, end in (("leader", F.col("log_end")), ("quorum", quorum)):
        asked = requests.filter(F.col("mode") == mode).select(*LOG, (F.col("last_offset") + 1).alias("t")).distinct()
        never = asked.select(*LOG).distinct().withColumn("log_end", F.lit(None).cast("long"))
        hit = log.ceiling(events.select(*LOG, end.cast("long").alias("at"), F.col("at_ms").alias("offset")), never, asked)
        found.append(hit.select(*LOG, F.lit(mode).alias("mode"), (F.col("t") - 1).alias("last_offset"), F.col("found").alias("at_ms")))
    met = requests.join(found[0].unionByName(found[1]), [*LOG, "mode", "last_offset"]).filter(F.col("at_ms") <= F.col("deadline_ms"))
    hits = met.select("req_id", F.greatest("at_ms", "sent_ms").alias("done"))
    out = requests.join(hits, "req_id", "left")
    at = F.when(F.col("mode") == "none", F.col("sent_ms")).otherwise(F.coalesce("done", "deadline_ms"))
    return out.select("req_id", F.when((F.col("mode") == "none") | F.col("done").isNotNull(), "OK").otherwise("TIMEOUT").alias("status"), at.alias("done_ms"))


def _text(x: str) -> bytes:
    raw = x.encode()
    return struct.pack("<H", len(raw)) + raw


def journal_key(group: Column, topic: Column, partition: Column) -> Column:
    """The key of a commit in the offset journal: group and topic with their lengths, then the partition."""

    def run(group, topic, partition):
        import pyarrow as pa

        return pa.array([_text(g) + _text(t) + struct.pack("<i", p) for g, t, p in zip(group.to_pylist(), topic.to_pylist(), partition.to_pylist())], pa.binary())

    return _column(run, "binary", group, topic, partition.cast("int"))


def journal_value(offset: Column, commit_time_ms: Column, metadata: Column) -> Column:
    """The value of a commit in the offset journal."""

    def run(offset, commit_time_ms, metadata):
        import pyarrow as pa

        return pa.array([struct.pack("<qq", o, t) + _text(m or "") for o, t, m in zip(offset.to_pylist(), commit_time_ms.to_pylist(), metadata.to_pylist())], pa.binary())

    return _column(run, "binary", offset.cast("long"), commit_time_ms.cast("long"), metadata)


def read_journal(records: DataFrame) -> DataFrame:
    """log_offset, group_id, topic, partition, position, commit_time_ms, metadata, tombstone of journal records (log_offset, attributes, key, value); malformed ones go."""

    def run(key, value):
        import pyarrow as pa

        def text(raw, at):
            (n,) = struct.unpack_from("<H", raw, at)
            if at + 2 + n > len(raw):
                raise struct.error
            return raw[at + 2 : at + 2 + n].decode(), at + 2 + n

        rows = []
        for k, v in zip(key.to_pylist(), value.to_pylist()):
            try:
                group, at = text(k, 0)
                topic, at = text(k, at)
                (partition,) = struct.unpack_from("<i", k, at)
                if at + 4 != len(k) or partition < 0:
                    raise struct.error
                offset, when, metadata = None, None, None
                if v:
                    offset, when = struct.unpack_from("<qq", v)
                    metadata, at = text(v, 16)
                    if at != len(v):
                        raise struct.error
                rows.append((group, topic, partition, offset, when, metadata))
            except (struct.error, UnicodeDecodeError, TypeError):
                rows.append((None,) * 6)
        types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        names = ("group_id", "topic", "partition", "position", "commit_time_ms", "metadata")
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    schema = "struct<group_id: string, topic: string, partition: int, position: bigint, commit_time_ms: bigint, metadata: string>"
    out = records.withColumn("c", _column(run, schema, F.col("key"), F.col("value"))).withColumn("tombstone", F.col("attributes").bitwiseAND(F.lit(4)) != 0)
    return out.filter("c.group_id IS NOT NULL AND (tombstone OR c.position IS NOT NULL)").select("log_offset", "c.*", "tombstone")


def metadata_lines(topics: DataFrame, partitions: DataFrame) -> DataFrame:
    """topic, kind, at, line: the metadata file's lines, a topic's own first, then its partitions in order.

    ``topics``: topic, partitions, replication, retention_ms, segment_bytes, codec;
    ``partitions``: topic, partition, leader, epoch, replicas.
    """
    text = lambda *cols: F.concat_ws("\t", *(F.col(c).cast("string") if isinstance(c, str) else c for c in cols))
    own = topics.select("topic", F.lit(0).alias("kind"), F.lit(0).alias("at"), text(F.lit("topic"), "topic", "partitions", "replication", "retention_ms", "segment_bytes", "codec").alias("line"))
    placed = partitions.select("topic", F.lit(1).alias("kind"), F.col("partition").alias("at"), text(F.lit("partition"), "topic", "partition", "leader", "epoch", F.concat_ws(",", F.col("replicas").cast("array<string>"))).alias("line"))
    return own.unionByName(placed)


def parse_metadata(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics and partitions of metadata lines (line): unknown kinds of lines are skipped; a topic whose lines are malformed or whose partitions have a gap is CORRUPTION."""
    f = lines.filter("line <> ''").withColumn("f", F.split("line", "\t"))
    number = lambda k, kind: F.try_element_at("f", F.lit(k)).try_cast(kind)
    t = f.filter("f[0] = 'topic'").select(F.try_element_at("f", F.lit(2)).alias("topic"), number(3, "int").alias("partitions"), number(4, "int").alias("replication"), number(5, "bigint").alias("retention_ms"), number(6, "bigint").alias("segment_bytes"), number(7, "int").alias("codec"))
    p = f.filter("f[0] = 'partition'").select(F.try_element_at("f", F.lit(2)).alias("topic"), number(3, "int").alias("partition"), number(4, "int").alias("leader"), number(5, "bigint").alias("epoch"), F.transform(F.split(F.try_element_at("f", F.lit(6)), ","), lambda x: x.try_cast("int")).alias("replicas"))
    dense = p.groupBy(F.col("topic").alias("of")).agg(F.count("*").alias("n"), F.countDistinct("partition").alias("distinct"), F.max("partition").alias("last"), F.min("partition").alias("first"))
    whole = (F.coalesce("n", F.lit(0)) == 0) | (F.col("n") == F.col("distinct")) & (F.col("first") == 0) & (F.col("last") == F.col("n") - 1)
    known = F.col("partitions").isNotNull() & F.col("replication").isNotNull() & F.col("retention_ms").isNotNull() & F.col("segment_bytes").isNotNull() & F.col("codec").isNotNull()
    t = t.join(dense, F.col("topic") == F.col("of"), "left").withColumn("status", F.when(known & whole, "OK").otherwise("CORRUPTION")).drop("of", "n", "distinct", "first", "last")
    return t, p


def save_metadata(topics: DataFrame, partitions: DataFrame, path: str) -> None:
    """Write the metadata as one text file with a header, by Spark's own commit: readers see the old file or the whole new one."""
    lines = metadata_lines(topics, partitions)
    head = lines.sparkSession.createDataFrame([("", -1, 0, METADATA_HEADER)], lines.schema)
    head.unionByName(lines).coalesce(1).sortWithinPartitions("topic", "kind", "at").select("line").write.mode("overwrite").text(path)


def load_metadata(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Topics and partitions that ``save_metadata`` has written; a folder without its header is refused."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    if not lines.filter(F.col("line") == METADATA_HEADER).limit(1).count():
        raise ValueError(f"{path} has no header of metadata")
    return parse_metadata(lines)
