"""Queries over placement, replication and groups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.functions import scalars as S
from strandlog.operators import cluster
from strandlog.plans.sql import COMMITS, MEMBERS, PROGRESS, RECORDS, STATE, crc, with_
from strandlog.sources import fixtures as X

QUERIES: dict = {}
SQL: dict[str, str] = {}
LOG = ["topic", "partition"]


def part():
    return F.col("partition").cast("long").alias("partition")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def topics(spark: SparkSession, d: str) -> DataFrame:
    """A topic per region and nation name, with 3 to 8 partitions."""
    n = X.table(spark, d, "nation").select(F.lower("n_name").alias("topic"), (3 + F.col("n_nationkey") % 6).cast("int").alias("partitions"))
    return n.withColumn("topic", F.replace("topic", F.lit(" "), F.lit("-")))


TOPICS = "t AS (SELECT replace(lower(n_name), ' ', '-') AS topic, (3 + n_nationkey % 6)::INT AS partitions FROM nation)"
PLACED = f"""{TOPICS}, tc AS (SELECT *, {crc('topic')} AS c FROM t),
pl AS (SELECT topic, partition, (partition + c % 3) % 3 AS leader, (partition + 1 + c % 3) % 3 AS second, (partition + 2 + c % 3) % 3 AS third FROM (SELECT *, unnest(range(partitions)) AS partition FROM tc))"""


def placed(spark, d):
    return cluster.assignments(topics(spark, d), 3, 3)


@query(with_(PLACED, "SELECT topic, partition::BIGINT AS partition, leader::BIGINT AS leader, concat_ws(',', leader, second, third) AS replicas, 2::BIGINT AS quorum FROM pl"))
def compute_assignments(spark, d):
    return placed(spark, d).select("topic", part(), F.col("leader").cast("long").alias("leader"), F.concat_ws(",", F.col("replicas").cast("array<string>")).alias("replicas"), F.col("quorum").cast("long").alias("quorum"))


@query(with_(PLACED, "SELECT leader::BIGINT AS broker, count(*) AS led FROM pl GROUP BY leader"))
def partitions_led_by(spark, d):
    return placed(spark, d).groupBy(F.col("leader").cast("long").alias("broker")).agg(F.count("*").alias("led"))


@query(with_(PLACED, "SELECT broker::BIGINT AS broker, topic, count(*) AS hosted FROM (SELECT topic, unnest([leader, second]) AS broker FROM pl) GROUP BY ALL"))
def partitions_hosted_by(spark, d):
    a = cluster.assignments(topics(spark, d), 3, 2)
    return a.select("topic", F.explode("replicas").alias("b")).groupBy(F.col("b").cast("long").alias("broker"), "topic").agg(F.count("*").alias("hosted"))


@query(with_(PLACED, "SELECT topic, partition::BIGINT AS partition, leader::BIGINT AS leader, 'broker-' || leader || ':9092' AS endpoint FROM pl"))
def metadata(spark, d):
    brokers = spark.createDataFrame([(b, f"broker-{b}:9092") for b in range(3)], "leader int, endpoint string")
    return placed(spark, d).join(F.broadcast(brokers), "leader").select("topic", part(), F.col("leader").cast("long").alias("leader"), "endpoint")


@query(with_(TOPICS, "SELECT topic, partitions::BIGINT AS partitions FROM t WHERE topic IN ('nation_1', 'nation_2', 'no-such')"))
def metadata_filter(spark, d):
    asked = spark.createDataFrame([("nation_1",), ("nation_2",), ("no-such",)], "topic string")
    return topics(spark, d).join(asked, "topic", "left_semi").select("topic", F.col("partitions").cast("long").alias("partitions"))


def lookups(spark, d):
    """Requested partitions: every topic and one that is missing, at partitions 0 to 8."""
    names = topics(spark, d).select("topic").union(spark.createDataFrame([("missing",)], "topic string"))
    return names.select("topic", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("partition"))


LOOKUPS = f"{PLACED}, lk AS (SELECT topic, unnest(range(9)) AS partition FROM (SELECT topic FROM t UNION ALL SELECT 'missing'))"


@query(with_(LOOKUPS, "SELECT lk.topic, lk.partition::BIGINT AS partition, CASE WHEN leader IS NULL THEN 'NOT_FOUND' ELSE 'broker-' || leader END AS route FROM lk LEFT JOIN pl ON pl.topic = lk.topic AND pl.partition = lk.partition"))
def route_leader(spark, d):
    out = lookups(spark, d).join(placed(spark, d), LOG, "left")
    return out.select("topic", part(), F.coalesce(F.concat(F.lit("broker-"), F.col("leader").cast("string")), F.lit("NOT_FOUND")).alias("route"))


@query(with_(LOOKUPS, "SELECT lk.topic, lk.partition::BIGINT AS partition, CASE WHEN leader IS NULL THEN 'NOT_FOUND' WHEN leader <> 1 THEN 'NOT_LEADER' ELSE 'OK' END AS status FROM lk LEFT JOIN pl ON pl.topic = lk.topic AND pl.partition = lk.partition"))
def resolve_partition(spark, d):
    out = lookups(spark, d).join(placed(spark, d), LOG, "left")
    return out.select("topic", part(), F.when(F.col("leader").isNull(), "NOT_FOUND").when(F.col("leader") != 1, "NOT_LEADER").otherwise("OK").alias("status"))


@query(with_(TOPICS, "SELECT topic FROM t WHERE topic NOT IN (SELECT replace(lower(n_name), ' ', '-') FROM nation WHERE n_nationkey % 3 = 0)"))
def reconcile_new_topics(spark, d):
    known = topics(spark, d).join(X.table(spark, d, "nation").filter("n_nationkey % 3 = 0").select(F.replace(F.lower("n_name"), F.lit(" "), F.lit("-")).alias("topic")), "topic", "left_semi")
    return topics(spark, d).join(known, "topic", "left_anti").select("topic")


@query(f"SELECT g.group_id, ({crc('g.group_id')} % 3)::BIGINT AS broker FROM (SELECT DISTINCT 'group-' || user_id AS group_id FROM events) g")
def group_coordinator(spark, d):
    g = X.table(spark, d, "events").select(F.concat(F.lit("group-"), F.col("user_id").cast("string")).alias("group_id")).distinct()
    return g.select("group_id", S.coordinator_slot(F.col("group_id"), 3).cast("long").alias("broker"))


@query(with_(RECORDS, "SELECT key, min(partition)::BIGINT AS partition, count(*) AS n FROM r WHERE key IS NOT NULL GROUP BY key"))
def route_by_key(spark, d):
    return X.produced(spark, d).filter("key IS NOT NULL").groupBy("key").agg(F.min("partition").cast("long").alias("partition"), F.count("*").alias("n"))


@query("SELECT (event_id % 6)::BIGINT AS partition, count(*) AS n FROM events GROUP BY event_id % 6")
def route_round_robin(spark, d):
    return X.table(spark, d, "events").groupBy((F.col("event_id") % 6).alias("partition")).agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey AS id, {crc('p_name')} AS crc FROM part")
def crc32c(spark, d):
    return X.table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.crc32c(F.col("p_name")).alias("crc"))


@query("SELECT topic, CASE WHEN NOT regexp_full_match(topic, '[A-Za-z0-9._-]{1,200}') OR topic IN ('.', '..') THEN 'INVALID_ARGUMENT' WHEN k = 1 THEN 'CREATED' WHEN partitions = first_partitions THEN 'OK' ELSE 'ALREADY_EXISTS' END AS status, k FROM (SELECT topic, partitions, row_number() OVER w AS k, first_value(partitions) OVER w AS first_partitions FROM (SELECT CASE WHEN p_partkey % 50 = 0 THEN '..' WHEN p_partkey % 3 = 0 THEN p_brand ELSE replace(p_brand, '#', '-') END AS topic, p_partkey % 4 AS partitions, p_partkey AS seq FROM part) WINDOW w AS (PARTITION BY topic ORDER BY seq))")
def create_topic_status(spark, d):
    p = X.table(spark, d, "part").select(F.when(F.col("p_partkey") % 50 == 0, "..").when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("topic"), (F.col("p_partkey") % 4).alias("partitions"), F.col("p_partkey").alias("seq"))
    w = Window.partitionBy("topic").orderBy("seq")
    p = p.withColumn("k", F.row_number().over(w).cast("long")).withColumn("_first", F.first("partitions").over(w))
    status = F.when(~S.valid_topic(F.col("topic")), "INVALID_ARGUMENT").when(F.col("k") == 1, "CREATED").when(F.col("partitions") == F.col("_first"), "OK").otherwise("ALREADY_EXISTS")
    return p.select("topic", status.alias("status"), "k")


@query("SELECT p_name AS name, regexp_full_match(p_name, '[A-Za-z0-9._-]{1,200}') AS valid FROM part UNION ALL SELECT p_brand, regexp_full_match(p_brand, '[A-Za-z0-9._-]{1,200}') FROM part UNION ALL SELECT '..', FALSE")
def valid_topic_names(spark, d):
    p = X.table(spark, d, "part")
    names = p.select(F.col("p_name").alias("name")).union(p.select("p_brand")).union(spark.createDataFrame([("..",)], "name string"))
    return names.select("name", S.valid_topic(F.col("name")).alias("valid"))


@query("SELECT topic, max(p) + 1 AS partitions FROM (SELECT event_type AS topic, greatest(3, event_id % 9) AS p FROM events) GROUP BY topic")
def auto_create_topics(spark, d):
    """A topic that a produce request names gets the default number of partitions, or enough for it."""
    e = X.table(spark, d, "events").select(F.col("event_type").alias("topic"), F.greatest(F.lit(4), F.col("event_id") % 9 + 1).alias("p"))
    return e.groupBy("topic").agg(F.max("p").alias("partitions"))


#: A follower starts in sync at offset 0; the mark never falls.
HWM = f"""{PROGRESS}, ru AS (SELECT *, max(log_end) OVER (PARTITION BY partition, broker ORDER BY seq) AS leo FROM pg),
cf AS (SELECT partition, seq, leader_end, coalesce(last_value(CASE WHEN broker = 1 THEN leo END IGNORE NULLS) OVER w, 0) AS l1, coalesce(last_value(CASE WHEN broker = 1 THEN connected END IGNORE NULLS) OVER w, TRUE) AS c1,
  coalesce(last_value(CASE WHEN broker = 2 THEN leo END IGNORE NULLS) OVER w, 0) AS l2, coalesce(last_value(CASE WHEN broker = 2 THEN connected END IGNORE NULLS) OVER w, TRUE) AS c2 FROM ru WINDOW w AS (PARTITION BY partition ORDER BY seq)),
hw AS (SELECT *, least(leader_end, CASE WHEN c1 THEN l1 END, CASE WHEN c2 THEN l2 END) AS candidate, 1 + c1::INT + c2::INT AS isr FROM cf)"""
FOLLOWERS = [1, 2]
ISR = "3 - (SELECT count(*) FROM fo WHERE fo.partition = st.partition AND NOT in_sync)"


@query(with_(HWM, f"SELECT partition::BIGINT AS partition, coalesce((SELECT max(candidate) FROM hw WHERE hw.partition = st.partition), 0) AS high_water, {ISR} AS isr FROM st"))
def high_water_mark(spark, d):
    state, progress = X.state(spark, d), X.progress(spark, d)
    return cluster.high_water_mark(state, progress, FOLLOWERS).select(part(), "high_water", F.col("isr").cast("long").alias("isr"))


@query(with_(HWM, "SELECT seq, max(candidate) OVER (PARTITION BY partition ORDER BY seq) AS hwm FROM hw"))
def hwm_timeline(spark, d):
    return cluster.high_water_timeline(X.progress(spark, d), FOLLOWERS).select("seq", "hwm")


@query(with_(HWM, "SELECT seq, isr::BIGINT AS isr, isr >= 2 AS admissible FROM hw"))
def isr_timeline(spark, d):
    return cluster.high_water_timeline(X.progress(spark, d), FOLLOWERS).select("seq", "isr", (F.col("isr") >= 2).alias("admissible"))


@query(with_(PROGRESS, f"SELECT partition::BIGINT AS partition, ({ISR})::BIGINT AS isr, {ISR} >= 2 AS admissible FROM st"))
def quorum_admissible(spark, d):
    h = cluster.in_sync_replicas(X.state(spark, d), cluster.latest_followers(X.progress(spark, d)), FOLLOWERS)
    return h.select(part(), F.col("isr").cast("long").alias("isr"), (F.col("isr") >= 2).alias("admissible"))


@query(with_(PROGRESS, "SELECT seq, coalesce(epoch < max(epoch) OVER (PARTITION BY partition ORDER BY seq), FALSE) AS stale FROM pg"))
def epoch_fence(spark, d):
    return cluster.fence_epochs(X.progress(spark, d)).select("seq", "stale")


@query(with_(PROGRESS, "SELECT fo.partition::BIGINT AS partition, broker::BIGINT AS broker, greatest(0, st.log_end - leo) AS lag FROM fo JOIN st USING (partition)"))
def follower_lag(spark, d):
    f = cluster.latest_followers(X.progress(spark, d)).join(X.state(spark, d), LOG)
    return f.select(part(), F.col("broker").cast("long").alias("broker"), F.greatest(F.lit(0), F.col("log_end") - F.col("leo")).alias("lag"))


@query(with_(PROGRESS, "SELECT fo.partition::BIGINT AS partition, max(greatest(0, st.log_end - leo)) AS lag FROM fo JOIN st USING (partition) GROUP BY fo.partition"))
def replication_lag(spark, d):
    return follower_lag(spark, d).groupBy("partition").agg(F.max("lag").alias("lag"))


REQ = f"{PROGRESS}, rq AS (SELECT event_id AS req_id, event_id % 4 AS partition, log_end * (event_id // 25 % 20) // 20 AS last_offset, event_id * 1000 AS deadline_ms FROM events JOIN st ON st.partition = event_id % 4)"
ACK = ", ak AS (SELECT rq.*, (flushed > last_offset)::BIGINT + (SELECT count(*) FROM fo WHERE fo.partition = rq.partition AND in_sync AND flushed_end > last_offset) AS persisted FROM rq JOIN st USING (partition))"


def produce_requests(spark, d):
    state = X.state(spark, d).select(*LOG, F.col("log_end").alias("end"))
    e = X.table(spark, d, "events").select(F.col("event_id").alias("req_id"), (F.col("event_id") % 4).cast("int").alias("partition"), (F.col("event_id") * 1000).alias("deadline_ms"))
    return e.join(state, "partition").withColumn("last_offset", F.floor(F.col("end") * (F.floor(F.col("req_id") / 25) % 20) / 20)).drop("end")


@query(with_(REQ + ACK, "SELECT req_id, persisted, persisted >= 2 AS acked FROM ak"))
def quorum_ack(spark, d):
    return acks(spark, d, produce_requests(spark, d)).select("req_id", F.col("persisted").cast("long").alias("persisted"), "acked")


def acks(spark, d, asked: DataFrame) -> DataFrame:
    f = cluster.latest_followers(X.progress(spark, d))
    return cluster.quorum_acks(asked, X.state(spark, d), f, 3)


@query(with_(REQ + ACK, "SELECT req_id FROM ak WHERE persisted < 2 AND deadline_ms <= 5000000"))
def ack_timeouts(spark, d):
    return acks(spark, d, produce_requests(spark, d)).filter("NOT acked AND deadline_ms <= 5000000").select("req_id")


@query(with_(PROGRESS, "SELECT r.partition::BIGINT AS partition, broker::BIGINT AS broker, count(*) AS pending, min(pos) AS next_offset FROM r JOIN fo ON fo.partition = r.partition AND r.pos >= leo GROUP BY r.partition, broker"))
def replicate_pending(spark, d):
    """What a follower still lacks: source records at and beyond its own end."""
    f = cluster.latest_followers(X.progress(spark, d)).select(*LOG, "broker", "leo")
    rows = X.records(spark, d).join(X.small(f), LOG).filter("offset >= leo")  # a row per replica
    return rows.groupBy(part(), F.col("broker").cast("long").alias("broker")).agg(F.count("*").alias("pending"), F.min("offset").alias("next_offset"))


@query(with_(RECORDS, "SELECT seq, CASE WHEN seq % 500 = 0 THEN 'MISSING' WHEN seq % 300 = 0 THEN 'DIFFERS' ELSE 'EXTRA' END AS kind FROM r WHERE seq % 500 = 0 OR seq % 300 = 0"))
def replica_divergence(spark, d):
    """Records on which two replicas disagree: missing from the second, or with another value."""
    a = X.records(spark, d).select(*LOG, "offset", "seq", "value")
    b = a.filter("seq % 500 <> 0").select(*LOG, "offset", F.when(F.col("seq") % 300 == 0, "damaged").otherwise(F.col("value")).alias("other"), F.lit(True).alias("there"))
    out = a.join(b, [*LOG, "offset"], "full_outer").filter(~F.col("value").eqNullSafe(F.col("other")))
    return out.select("seq", F.when(F.col("there").isNull(), "MISSING").when(F.col("seq").isNull(), "EXTRA").otherwise("DIFFERS").alias("kind"))


def group_topics(spark):
    return spark.createDataFrame([("events", 40), ("audit", 7)], "topic string, partitions int")


@query(with_(MEMBERS, ", x AS (SELECT gp.*, k, partitions // k AS q, partitions % k AS m FROM gp JOIN (SELECT DISTINCT group_id, k FROM mr) USING (group_id)), y AS (SELECT *, CASE WHEN partition < m * (q + 1) THEN partition // (q + 1) ELSE m + (partition - m * (q + 1)) // greatest(q, 1) END AS rank FROM x) SELECT y.group_id, topic, partition::BIGINT AS partition, member_id FROM y JOIN mr ON mr.group_id = y.group_id AND mr.rank = y.rank"))
def assign_range(spark, d):
    return cluster.assign_range(X.members(spark, d), group_topics(spark)).select("group_id", "topic", part(), "member_id")


@query(with_(MEMBERS, ", y AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY topic, partition) - 1 AS place FROM gp) SELECT y.group_id, topic, partition::BIGINT AS partition, member_id FROM y JOIN mr ON mr.group_id = y.group_id AND mr.rank = place % k"))
def assign_round_robin(spark, d):
    return cluster.assign_round_robin(X.members(spark, d), group_topics(spark)).select("group_id", "topic", part(), "member_id")


@query(with_(MEMBERS, "SELECT group_id, member_id FROM mb WHERE 400000 - heartbeat_ms > 30000"))
def expired_members(spark, d):
    return cluster.expired(X.members(spark, d), 400_000).select("group_id", "member_id")


@query(with_(MEMBERS, "SELECT group_id, 'stable' AS state, count(DISTINCT member_id) AS members, min(member_id) AS leader FROM mb GROUP BY group_id"))
def describe_groups(spark, d):
    return described(X.members(spark, d))


def described(members: DataFrame) -> DataFrame:
    return members.groupBy("group_id").agg(F.countDistinct("member_id").alias("members"), F.min("member_id").alias("leader")).withColumn("state", F.lit("stable"))


@query(with_(COMMITS, "SELECT group_id, partition::BIGINT AS partition, position, commit_time_ms FROM co"))
def committed_offsets(spark, d):
    return cluster.committed(X.commits(spark, d)).select("group_id", part(), "position", "commit_time_ms")


OWNERS = "ow AS (SELECT 'group-' || g AS group_id, 'member-' || (p % 3) AS member_id, p AS partition FROM range(6) AS a(g), range(5) AS b(p))"


@query(with_(f"{COMMITS}, {OWNERS}", """SELECT log_offset, CASE WHEN position < 0 THEN 'INVALID_ARGUMENT' WHEN member_id = '' THEN 'OK' WHEN group_id = 'group-6' THEN 'NOT_FOUND'
WHEN member_id = 'stranger' THEN 'UNKNOWN_MEMBER' WHEN generation <> 2 THEN 'ILLEGAL_GENERATION' WHEN NOT EXISTS (SELECT 1 FROM ow WHERE ow.group_id = cm.group_id AND ow.member_id = cm.member_id AND ow.partition = cm.partition) THEN 'ILLEGAL_GENERATION' ELSE 'OK' END AS status FROM cm"""))
def commit_fencing(spark, d):
    owners = spark.range(6).select(F.concat(F.lit("group-"), F.col("id").cast("string")).alias("group_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("partition")).select("group_id", F.concat(F.lit("member-"), (F.col("partition") % 3).cast("string")).alias("member_id"), F.lit("events").alias("topic"), "partition")
    generations = owners.select("group_id").distinct().withColumn("generation", F.lit(2))
    return cluster.commit_status(X.commits(spark, d), generations, owners).select("log_offset", "status")


@query(with_(MEMBERS, """, bs AS (SELECT event_id AS seq, 'group-' || CASE WHEN event_id % 6 > 3 THEN 'none' ELSE (event_id // 60 * 4 + event_id % 6)::VARCHAR END AS group_id, 'g-' || (event_id % 20) AS member_id FROM events)
SELECT seq, CASE WHEN group_id NOT IN (SELECT group_id FROM mb) THEN 'NOT_FOUND' WHEN mb.member_id IS NULL THEN 'UNKNOWN_MEMBER' WHEN seq % 5 = 0 THEN 'REBALANCE_IN_PROGRESS' ELSE 'OK' END AS status FROM bs LEFT JOIN mb USING (group_id, member_id)"""))
def heartbeat_status(spark, d):
    """Every event is a heartbeat to a group of its sixty; some to no group or from no member."""
    n = F.col("event_id")
    group = F.when(n % 6 > 3, "none").otherwise((F.floor(n / 60) * 4 + n % 6).cast("string"))
    beats = X.table(spark, d, "events").select(n.alias("seq"), F.concat(F.lit("group-"), group).alias("group_id"), F.concat(F.lit("g-"), (n % 20).cast("string")).alias("member_id"), F.when(n % 5 == 0, 1).otherwise(2).alias("beat_generation"))
    return cluster.heartbeat_status(beats, X.members(spark, d), F.lit(2)).select("seq", "status")


@query(with_(f"{COMMITS}, {STATE}", "SELECT g.group_id, st.partition::BIGINT AS partition, log_end - coalesce(position, log_start) AS lag FROM (SELECT DISTINCT group_id FROM cm) g CROSS JOIN st LEFT JOIN co ON co.group_id = g.group_id AND co.partition = st.partition"))
def consumer_lag(spark, d):
    j = X.commits(spark, d)
    state = X.state(spark, d)
    asked = j.select("group_id").distinct().withColumn("topic", F.lit("events")).join(state, "topic")
    out = asked.join(cluster.committed(j), ["group_id", *LOG], "left")
    return out.select("group_id", part(), (F.col("log_end") - F.coalesce("position", "log_start")).alias("lag"))


@query(with_(f"{COMMITS}, {STATE}", "SELECT g.group_id, st.partition::BIGINT AS partition, CASE WHEN position IS NULL THEN log_end WHEN position < log_start OR position > log_end THEN log_start ELSE position END AS position FROM (SELECT DISTINCT group_id FROM cm) g CROSS JOIN st LEFT JOIN co ON co.group_id = g.group_id AND co.partition = st.partition"))
def start_positions(spark, d):
    """Where members begin: the committed position, the log's end without one, its start if out of range."""
    j = X.commits(spark, d)
    state = X.state(spark, d)
    out = j.select("group_id").distinct().withColumn("topic", F.lit("events")).join(state, "topic").join(cluster.committed(j), ["group_id", *LOG], "left")
    at = F.when(F.col("position").isNull(), F.col("log_end")).when(~F.col("position").between(F.col("log_start"), F.col("log_end")), F.col("log_start")).otherwise(F.col("position"))
    return out.select("group_id", part(), at.alias("position"))


@query(with_(PROGRESS, "SELECT broker::BIGINT AS broker FROM (SELECT DISTINCT broker FROM fo WHERE in_sync UNION SELECT 0)"))
def live_brokers(spark, d):
    f = cluster.latest_followers(X.progress(spark, d)).filter("in_sync").select(F.col("broker").cast("long").alias("broker"))
    return f.union(spark.createDataFrame([(0,)], "broker long")).distinct()


@query(with_(PLACED, "SELECT topic, partition::BIGINT AS partition, third::BIGINT AS removed FROM pl"))
def replica_set_diff(spark, d):
    old = cluster.assignments(topics(spark, d), 3, 3).select("topic", "partition", F.explode("replicas").alias("removed"))
    new = cluster.assignments(topics(spark, d), 3, 2).select("topic", "partition", F.explode("replicas").alias("removed"))
    return old.exceptAll(new).select("topic", part(), F.col("removed").cast("long").alias("removed"))


@query(with_(STATE, ", b AS (SELECT unnest(range(3)) AS broker), x AS (SELECT broker, partition, row_number() OVER (PARTITION BY partition ORDER BY broker) AS k, log_end - broker AS leo FROM b CROSS JOIN st WHERE (partition + broker) % 3 <> 0) SELECT partition::BIGINT AS partition, broker::BIGINT AS broker, leo FROM x WHERE k = 1"))
def partition_view(spark, d):
    """Each partition as the first broker that hosts it reports it."""
    s = X.state(spark, d).select(*LOG, "log_end", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("broker")).filter("(partition + broker) % 3 <> 0")
    return s.groupBy(*LOG).agg(F.min("broker").alias("b"), F.min_by(F.col("log_end") - F.col("broker"), "broker").alias("leo")).select(part(), F.col("b").cast("long").alias("broker"), "leo")


@query(with_(STATE, "SELECT 'events' AS topic, count(*) AS partitions, sum(log_end - log_start)::BIGINT AS records, (SELECT sum(size) FROM r)::BIGINT AS bytes FROM st"))
def list_topics(spark, d):
    r = X.records(spark, d)
    size = r.groupBy(*LOG).agg(F.sum("size").alias("bytes"))
    return X.state(spark, d).join(size, LOG).groupBy("topic").agg(F.count("*").alias("partitions"), F.sum(F.col("log_end") - F.col("log_start")).alias("records"), F.sum("bytes").alias("bytes"))


#: Every partition's log end on its leader: of topic events that of the log, of others a number of their own.
TOPOLOGY = f"{PLACED}, tl AS (SELECT leader AS broker, topic, partition, partition * 100 + strlen(topic) AS log_end, concat_ws(',', leader, second, third) AS replicas FROM pl UNION ALL SELECT partition % 3, 'events', partition, log_end, concat_ws(',', partition % 3, (partition + 1) % 3, (partition + 2) % 3) FROM st)"


@query(with_(f"{STATE}, {TOPOLOGY}", """SELECT broker::BIGINT AS broker, '{"broker_id":' || broker || ',"topics":[' || string_agg(doc, ',' ORDER BY topic) || ']}' AS doc FROM (SELECT broker, topic,
'{"name":"' || topic || '","partitions":[' || string_agg('{"partition":' || partition || ',"leader":' || broker || ',"replicas":[' || replicas || '],"log_end_offset":' || log_end || '}', ',' ORDER BY partition) || ']}' AS doc FROM tl GROUP BY broker, topic) GROUP BY broker"""))
def topology(spark, d):
    """Each broker's document: the partitions that it leads, by topic, with replicas and log ends."""
    events = X.state(spark, d).select("topic", "partition", "log_end", F.array(*((F.col("partition") + k) % 3 for k in range(3))).alias("replicas"))
    others = placed(spark, d).select("topic", "partition", (F.col("partition") * 100 + F.octet_length("topic")).cast("long").alias("log_end"), "replicas")
    return cluster.topology_documents(others.unionByName(events)).select(F.col("broker").cast("long").alias("broker"), "doc")


@query(with_(f"{STATE}, {TOPOLOGY}", "SELECT topic, count(*) AS partitions, sum(log_end)::BIGINT AS log_end FROM tl GROUP BY topic"))
def topology_log_end(spark, d):
    """Records of every topic, from the leaders' documents: the sum of its partitions' log ends."""
    return cluster.topic_log_ends(topology(spark, d), "doc")


@query(with_(MEMBERS, "SELECT group_id, count(DISTINCT member_id) AS generation FROM mb GROUP BY group_id"))
def group_generations(spark, d):
    """The generation of each group after its join events: each shape change adds one (the stateful processor, in batch)."""
    from strandlog.streaming import groups

    joins = X.members(spark, d).select(F.col("event_id").alias("seq"), "group_id", "member_id", F.lit("join").alias("kind"), F.lit("events").alias("topics"), F.lit("range").alias("strategy"), "timeout_ms", F.col("event_id").alias("event_ms"))
    return groups.replay(joins).groupBy("group_id").agg(F.max("generation").alias("generation"))
