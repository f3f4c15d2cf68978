"""The log in a folder, from topics to group positions."""

import json

import pytest
from pyspark.sql import functions as F

from strandlog.api import LATEST, Log, Options
from strandlog.operators import admin, metrics


def test_topics_appends_and_group_reads(spark, tmp_path):
    log = Log(spark, str(tmp_path), Options(default_partitions=3))
    assert [log.create_topic("a", 2), log.create_topic("a", 2), log.create_topic("a", 3), log.create_topic(".."), log.delete_topic("zzz")] == ["CREATED", "OK", "ALREADY_EXISTS", "INVALID_ARGUMENT", "NOT_FOUND"]
    rows = spark.range(60).select(F.when(F.col("id") % 2 == 0, "a").otherwise("new").alias("topic"), F.col("id").alias("seq"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("key"), F.lit("v").alias("value"), F.lit(1).cast("long").alias("timestamp_ms"))
    log.produce(rows)
    log.produce(rows)
    assert {r.topic: r.partitions for r in log.topics().collect()} == {"a": 2, "new": 3}
    ends = {(r.topic, r.partition): r.latest for r in log.offsets().collect()}
    assert sum(n for (t, _), n in ends.items() if t == "a") == 60
    for t, n in (("a", 2), ("new", 3)):
        got = log.read(t).groupBy("partition").agg(F.count("*").alias("n"), F.countDistinct("offset").alias("d"), F.max("offset").alias("top")).collect()
        assert len(got) <= n
        assert all(r.n == r.d == r.top + 1 == ends[t, r.partition] for r in got)
    assert log.read("a", LATEST).count() == 0
    first = log.group_read("g", ["a"], max_bytes=100)
    seen = {(r.partition, r.offset) for r in first.collect()}
    assert 0 < len(seen) < 60
    log.commit("g", log.next_positions(first))
    rest = {(r.partition, r.offset) for r in log.group_read("g", ["a"]).collect()}
    assert not rest & seen
    assert len(rest | seen) == 60
    assert sum(r.lag for r in log.lag("g").filter("topic = 'a'").collect()) == len(rest)
    assert log.health().first().records == 120
    assert log.delete_topic("a") == "OK"
    assert log.read("a").count() == 0
    with pytest.raises(ValueError, match="bad topic"):
        log.produce(rows.withColumn("topic", F.lit("no/slash")))


def test_metadata_file(spark, tmp_path):
    topics = spark.createDataFrame([("b", 1, 1, -1, 5, 0), ("a", 2, 1, -1, 5, 1)], "topic string, partitions int, replication int, retention_ms long, segment_bytes long, codec int")
    parts = spark.createDataFrame([("a", 1, 0, 3, [0, 1]), ("a", 0, 1, 0, [1]), ("b", 0, 0, 0, [0])], "topic string, partition int, leader int, epoch long, replicas array<int>")
    path = f"{tmp_path}/meta"
    admin.save_metadata(topics, parts, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[0] == admin.METADATA_HEADER
    assert lines[1:3] == ["topic\ta\t2\t1\t-1\t5\t1", "partition\ta\t0\t1\t0\t1"]
    t, p = admin.load_metadata(spark, path)
    assert sorted(map(tuple, t.drop("status").collect())) == sorted(map(tuple, topics.collect()))
    assert sorted(map(tuple, p.collect()), key=str) == sorted(map(tuple, parts.collect()), key=str)
    assert {r.status for r in t.collect()} == {"OK"}
    spark.createDataFrame([("topic\tx",)], "value string").write.text(f"{tmp_path}/other")
    with pytest.raises(ValueError, match="header"):
        admin.load_metadata(spark, f"{tmp_path}/other")


def test_results_and_csv(spark, tmp_path):
    docs = [(json.dumps({"scenario": 1, "trials": [{"trial": k, "records_per_second": 10 * k} for k in (1, 2, 3)]}),), ("{oops",)]
    trials = metrics.load_results(spark.createDataFrame(docs, "doc string"))
    metrics.write_csv(trials.orderBy("trial"), f"{tmp_path}/trials")
    back = spark.read.option("header", True).csv(f"{tmp_path}/trials")
    assert sorted(map(tuple, back.collect())) == [("1", "1", "10"), ("1", "2", "20"), ("1", "3", "30")]


def test_waiters(spark):
    req = [(0, "none", 50, 5, 10), (1, "leader", 50, 5, 100), (2, "quorum", 50, 5, 100), (3, "quorum", 80, 5, 100), (4, "leader", 10, 30, 100)]
    req = spark.createDataFrame([(r, "t", 0, m, o, s, d) for r, m, o, s, d in req], "req_id long, topic string, partition int, mode string, last_offset long, sent_ms long, deadline_ms long")
    ev = spark.createDataFrame([("t", 0, 10, 51, [51, 0, 0]), ("t", 0, 20, 60, [60, 51, 0]), ("t", 0, 200, 99, [99, 99, 99])], "topic string, partition int, at_ms long, log_end long, flushed array<long>")
    got = {r.req_id: (r.status, r.done_ms) for r in admin.waiters(req, ev, 3).collect()}
    assert got == {0: ("OK", 5), 1: ("OK", 10), 2: ("OK", 20), 3: ("TIMEOUT", 100), 4: ("OK", 30)}
