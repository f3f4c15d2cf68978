from pyspark.sql import functions as F

from strandlog.operators import cluster, log, metrics
from strandlog.plans import registry
from strandlog.streaming import groups

LOG = ["topic", "partition"]


def records(spark, n=200, size=100):
    return spark.range(n).select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), F.col("id").alias("seq"), F.floor(F.col("id") / 10).alias("batch_id"), F.lit(size).cast("long").alias("size"), (1000 + F.col("id")).alias("timestamp_ms"))


def state(spark, end, start=0):
    return spark.createDataFrame([("t", 0, start, end, end, end)], "topic string, partition int, log_start long, log_end long, flushed long, hwm long")


def ask(spark, start, max_bytes, isolation=0):
    return spark.createDataFrame([("r", "t", 0, start, max_bytes, isolation)], "req_id string, topic string, partition int, start long, max_bytes long, isolation int")


def test_offsets_continue(spark):
    rows = records(spark, 30).drop("offset")
    high = spark.createDataFrame([("t", 0, 100)], "topic string, partition int, log_end long")
    assert sorted(r.offset for r in log.assign_offsets(rows, high).collect()) == list(range(100, 130))


def test_byte_budget_and_oversized(spark):
    got = log.fetch(records(spark), state(spark, 200), ask(spark, 0, 1000)).collect()
    assert 0 < sum(r["size"] for r in got) <= 1100
    assert len(log.fetch(records(spark, 5, 65536), state(spark, 5), ask(spark, 0, 100)).collect()) == 1


def test_end_and_past_end(spark):
    assert log.fetch(records(spark, 5), state(spark, 5), ask(spark, 5, 100)).count() == 0
    assert log.bounds_error(ask(spark, 6, 100), state(spark, 5)).first()["error"] == "OUT_OF_RANGE"
    assert log.bounds_error(ask(spark, 5, 100), state(spark, 5)).first()["error"] == "OK"
    assert log.bounds_error(ask(spark, 0, 100), state(spark, 5, 2)).first()["error"] == "OUT_OF_RANGE"


def test_sparse_time_lookup_can_land_later(spark):
    r = records(spark, 100)
    seg = log.roll_and_index(log.batches_of(r), 1 << 20, 3000)
    t = spark.createDataFrame([("t", 0, 1015)], "topic string, partition int, t long")
    exact = log.offsets_for_times(r, state(spark, 100), t).first()["found"]
    sparse = log.offsets_for_times_sparse(seg, state(spark, 100), t).first()["found"]
    assert exact == 15
    assert sparse == 30


def test_roll_and_retention(spark):
    seg = log.roll_and_index(log.batches_of(records(spark, 400)), 4096, 256)
    s = log.segments_of(seg)
    assert s.count() > 1
    assert s.agg(F.sum("records")).first()[0] == 400
    assert log.retention(s, 0, max_bytes=1).filter("NOT dropped").count() == 1
    one = log.segments_of(log.roll_and_index(log.batches_of(records(spark, 5)), 4096, 256))
    assert not log.retention(one, 0, max_bytes=1).first()["dropped"]


def progress(spark, rows):
    """(seq, broker, log_end, connected) reports to a leader whose end is 100."""
    return spark.createDataFrame([("t", 0, s, b, e, c, 100) for s, b, e, c in rows], "topic string, partition int, seq long, broker int, log_end long, connected boolean, leader_end long").withColumn("flushed", F.col("log_end"))


def test_high_water_mark_waits_for_every_follower(spark, monkeypatch):
    """Followers start in sync at 0; the mark never falls; without followers in sync the leader's end is the mark."""
    monkeypatch.setattr(cluster, "STRETCH", 2)  # several stretches
    p = progress(spark, [(0, 1, 50, True), (1, 1, 60, True), (2, 2, 40, True), (3, 2, 70, True), (4, 1, 60, False), (5, 2, 70, False), (6, 1, 61, True)])
    got = [(r.hwm, r.isr) for r in cluster.high_water_timeline(p, [1, 2]).orderBy("seq").collect()]
    assert got == [(0, 3), (0, 3), (40, 3), (60, 3), (70, 2), (100, 1), (100, 2)]
    s = state(spark, 100)
    r = cluster.high_water_mark(s, p.filter("seq < 1"), [1, 2]).first()
    assert (r.high_water, r.isr) == (0, 3)
    r = cluster.high_water_mark(s, p.limit(0), []).first()
    assert (r.high_water, r.isr) == (100, 1)


def test_stale_epochs_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(cluster, "STRETCH", 3)
    e = [0, 0, 2, 0, 0, 1, 0, 2, 3, 2]
    p = spark.createDataFrame([("t", 0, k, x) for k, x in enumerate(e)], "topic string, partition int, seq long, epoch long")
    assert [r.stale for r in cluster.fence_epochs(p).orderBy("seq").collect()] == [x < max(e[: k + 1]) for k, x in enumerate(e)]


def test_time_lookup_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(log, "TIME_STRETCH", 7)
    times = [5, 3, 9, 9, 30, 12, 29, 40]
    r = spark.createDataFrame([("t", 0, k, x) for k, x in enumerate(times)], "topic string, partition int, offset long, timestamp_ms long")
    asked = spark.createDataFrame([("t", 0, t) for t in range(45)], "topic string, partition int, t long")
    got = {x.t: x.found for x in log.offsets_for_times(r, state(spark, 8), asked).collect()}
    assert got == {t: min((k for k, x in enumerate(times) if x >= t), default=8) for t in range(45)}


def test_as_of_and_gaps_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(log, "STRETCH", 4)
    left = spark.createDataFrame([("t", 0, k, k) for k in range(20)], "topic string, partition int, seq long, offset long")
    right = spark.createDataFrame([("t", 0, b) for b in (2, 3, 11)], "topic string, partition int, base long")
    got = {r.offset: r.base for r in log.as_of(left, right, LOG, "offset", "base", "base").collect()}
    assert got == {k: max((b for b in (2, 3, 11) if b <= k), default=None) for k in range(20)}
    gaps = log.gaps(left.filter("offset NOT IN (4, 9, 10, 19)")).orderBy("offset").collect()
    assert [(r.offset, r.missing) for r in gaps] == [(5, 1), (11, 2)]


def test_roll_by_age(spark):
    b = log.batches_of(records(spark, 100)).withColumn("append_ms", F.col("base"))
    assert log.segments_of(log.roll_and_index(b, 1 << 20, 1 << 20, segment_ms=25)).count() == 4


def test_topology_sums_log_ends(spark):
    led = spark.createDataFrame([("a", 0, 10, [0, 1]), ("a", 1, 5, [1, 0]), ("b", 0, 7, [0, 1])], "topic string, partition int, log_end long, replicas array<int>")
    got = {r.topic: (r.partitions, r.log_end) for r in cluster.topic_log_ends(cluster.topology_documents(led), "doc").collect()}
    assert got == {"a": (2, 15), "b": (1, 7)}


def test_members_sort_by_text_and_union_topics(spark):
    m = spark.createDataFrame([("g", f"g-{k}", ["a"] if k else ["b"]) for k in range(11)], "group_id string, member_id string, topics array<string>")
    t = spark.createDataFrame([("a", 11), ("b", 1)], "topic string, partitions int")
    got = {(r.topic, r.partition): r.member_id for r in cluster.assign_range(m, t).collect()}
    assert len(got) == 12
    assert got[("a", 2)] == "g-10"
    rr = cluster.assign_round_robin(m, t).groupBy("member_id").count().collect()
    assert max(r["count"] for r in rr) - min(r["count"] for r in rr) <= 1


def test_percentile_rank_rounds_half_up(spark):
    b = metrics.hdr_buckets(spark.range(1, 161).select(F.lit("x").alias("k"), F.col("id").alias("value")), ["k"])
    assert metrics.hdr_percentiles(b, ["k"], [99.0]).first()["value"] == 158


def test_spread_of_one_trial(spark):
    t = spark.createDataFrame([("a", 5), ("b", 1), ("b", 2), ("b", 3), ("b", 10)], "s string, v long")
    got = {r.s: r for r in metrics.spread(t, ["s"], "v").collect()}
    assert got["a"].stdev == 0
    assert got["b"].median == 2.5
    assert metrics.median_trial(t, ["s"], "v", "v").filter("s = 'b'").first()["v"] == 3


def events(spark):
    rows = [
        (0, "", "join", "a", 0), (1, "chosen", "join", "a", 10), (2, "g-1", "join", "a", 20), (3, "g-1", "join", "a,b", 30), (4, "g-2", "leave", "", 40), (5, "g-2", "heartbeat", "", 50),
        (6, "", "join", "", 60), (7, "", "join", "a", 9000), (8, "g-3", "leave", "", 9001), (9, "", "join", "b", 9002),
    ]
    strategy = lambda s: "range" if s < 9 else "roundrobin"
    return [(s, "g", m, k, t, strategy(s), 1000, ms) for s, m, k, t, ms in rows], "seq long, group_id string, member_id string, kind string, topics string, strategy string, timeout_ms long, event_ms long"


def test_group_machine(spark):
    """Ids are given, an expiry and a join are a generation each, a group keeps its strategy when it empties."""
    got = groups.replay(spark.createDataFrame(*events(spark)), {"a": 3, "b": 1}).orderBy("seq").collect()
    assert [r.generation for r in got] == [1, 2, 2, 3, 4, 4, 4, 6, 7, 8]
    assert [r.member_id for r in got] == ["g-1", "g-2", "g-1", "g-1", "g-2", "g-2", None, "g-3", "g-3", "g-4"]
    assert [r.error for r in got] == [None] * 5 + ["UNKNOWN_MEMBER", "INVALID_ARGUMENT"] + [None] * 3
    assert [r.members for r in got] == [1, 2, 2, 2, 1, 1, 1, 1, 0, 1]
    assert {r.strategy for r in got} == {"range"}
    assert got[3].assignment == '{"g-1": ["a-0", "a-1", "b-0"], "g-2": ["a-2"]}'
    assert got[9].assignment == '{"g-4": ["b-0"]}'
    assert groups.assign("roundrobin", ["x", "y"], {"a": 3, "b": 2}) == {"x": ["a-0", "a-2", "b-1"], "y": ["a-1", "b-0"]}


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)
    assert len(registry.QUERIES) >= 100
