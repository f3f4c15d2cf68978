"""Placement, replication and consumer groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions import scalars as S
from strandlog.model import LOG
from strandlog.operators.log import scanned

#: Reports of a stretch, the unit in which timelines are dealt out.
STRETCH = 1 << 13


def assignments(topics: DataFrame, brokers: int, replication: int) -> DataFrame:
    """Replicas of every partition of the topics (topic, partitions); the first is the leader."""
    p = topics.select("topic", F.explode(F.sequence(F.lit(0), F.col("partitions") - 1)).alias("partition"))
    slot = lambda r: ((F.col("partition") + r + S.crc32c(F.col("topic")) % brokers) % brokers).cast("int")
    out = p.withColumn("replicas", F.array(*(slot(r) for r in range(min(brokers, replication)))))
    return out.withColumn("leader", F.get("replicas", F.lit(0))).withColumn("quorum", F.floor(F.size("replicas") / 2) + 1)


def by_seq() -> Column:
    return F.floor(F.col("seq") / STRETCH)


def latest_followers(progress: DataFrame) -> DataFrame:
    """The state of every follower that has reported, after all reports; what a follower has only grows."""
    return progress.groupBy(*LOG, "broker").agg(F.max("log_end").alias("leo"), F.max("flushed").alias("flushed_end"), F.max_by("connected", "seq").alias("in_sync"))


def in_sync_replicas(state: DataFrame, followers: DataFrame, brokers: list[int]) -> DataFrame:
    """topic, partition, log_end, in_sync: the leader and its in-sync followers; one that has not reported is taken to be in sync."""
    out = followers.filter(~F.col("in_sync") & F.col("broker").isin(brokers)).groupBy(*LOG).agg(F.count("*").alias("away"))
    return state.join(out, list(LOG), "left").select(*LOG, "log_end", (1 + len(brokers) - F.coalesce("away", F.lit(0))).alias("isr"))


def high_water_timeline(progress: DataFrame, brokers: list[int]) -> DataFrame:
    """The high-water mark and the in-sync count after every report.

    Followers start in sync at offset 0, so the mark stays at 0 until each has
    reported or has left; without followers in sync the leader's end is the mark.
    It never falls: it is a running maximum. Other followers' states are their
    last reports before this one, carried forward.
    """
    ends = {f"leo{b}": ("max", F.when(F.col("broker") == b, F.col("log_end"))) for b in brokers}
    live = {f"live{b}": ("last", F.when(F.col("broker") == b, F.col("connected"))) for b in brokers}
    r = scanned(progress.select(*LOG, "seq", "leader_end", "broker", "log_end", "connected"), ends | live, list(LOG), F.col("seq"), by_seq())
    held = [F.when(F.coalesce(f"live{b}", F.lit(True)), F.coalesce(f"leo{b}", F.lit(0))) for b in brokers]
    isr = sum((e.isNotNull().cast("long") for e in held), F.lit(1))
    out = r.select(*LOG, "seq", F.least("leader_end", *held).alias("candidate"), isr.alias("isr"))
    return scanned(out, {"hwm": ("max", F.col("candidate"))}, list(LOG), F.col("seq"), by_seq())


def high_water_mark(state: DataFrame, progress: DataFrame, brokers: list[int]) -> DataFrame:
    """topic, partition, high_water, isr after all reports; without any report the mark is 0 (the leader's end if it is alone)."""
    if not brokers:
        return state.select(*LOG, F.col("log_end").alias("high_water"), F.lit(1).alias("isr"))
    last = high_water_timeline(progress, brokers).groupBy(*LOG).agg(F.max("hwm").alias("high_water"))
    isr = in_sync_replicas(state, latest_followers(progress), brokers)
    return isr.join(last, list(LOG), "left").select(*LOG, F.coalesce("high_water", F.lit(0)).cast("long").alias("high_water"), "isr")


def fence_epochs(progress: DataFrame) -> DataFrame:
    """Reports with ``stale``: an epoch below the highest seen before."""
    out = scanned(progress, {"_top": ("max", F.col("epoch"))}, list(LOG), F.col("seq"), by_seq())
    return out.withColumn("stale", F.col("epoch") < F.col("_top")).drop("_top")


def quorum_acks(requests: DataFrame, state: DataFrame, followers: DataFrame, replicas: int) -> DataFrame:
    """Requests with ``persisted`` copies beyond last_offset, and whether they are a majority."""
    f = followers.filter("in_sync").groupBy(*LOG).agg(F.collect_list("flushed_end").alias("ends"))  # a number per replica
    out = requests.join(state, list(LOG)).join(f, list(LOG), "left")
    beyond = F.size(F.filter(F.coalesce("ends", F.array().cast("array<bigint>")), lambda e: e > F.col("last_offset")))
    out = out.withColumn("persisted", (F.col("flushed") > F.col("last_offset")).cast("int") + beyond)
    return out.withColumn("acked", F.col("persisted") >= replicas // 2 + 1)


def member_ranks(members: DataFrame) -> DataFrame:
    """Members of each group in binary order of their ids, with their number."""
    distinct = members.select("group_id", "member_id").distinct()
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy("member_id")) - 1
    size = distinct.groupBy("group_id").agg(F.count("*").alias("k"))
    return distinct.withColumn("rank", rank).join(size, "group_id")


def group_partitions(members: DataFrame, topics: DataFrame) -> DataFrame:
    """Partitions of the union of all members' topics, for each group."""
    union = members.select("group_id", F.explode("topics").alias("topic")).distinct()
    return union.join(topics, "topic").select("group_id", "topic", "partitions", F.explode(F.sequence(F.lit(0), F.col("partitions") - 1)).alias("partition"))


def assign_range(members: DataFrame, topics: DataFrame) -> DataFrame:
    """Per topic, consecutive partitions: the first members get one more if they do not divide."""
    ranks = member_ranks(members)
    p = group_partitions(members, topics).join(ranks.select("group_id", "k").distinct(), "group_id")
    q, m, i = F.floor(F.col("partitions") / F.col("k")), F.col("partitions") % F.col("k"), F.col("partition")
    owner = F.when(i < m * (q + 1), F.floor(i / (q + 1))).otherwise(m + F.floor((i - m * (q + 1)) / F.greatest(q, F.lit(1))))
    return p.withColumn("rank", owner.cast("int")).join(ranks.select("group_id", "rank", "member_id"), ["group_id", "rank"])


def assign_round_robin(members: DataFrame, topics: DataFrame) -> DataFrame:
    """All partitions in order, dealt to the members in turn."""
    ranks = member_ranks(members)
    p = group_partitions(members, topics).withColumn("place", F.row_number().over(Window.partitionBy("group_id").orderBy("topic", "partition")) - 1)
    p = p.join(ranks.select("group_id", "k").distinct(), "group_id").withColumn("rank", (F.col("place") % F.col("k")).cast("int"))
    return p.join(ranks.select("group_id", "rank", "member_id"), ["group_id", "rank"])


def committed(journal: DataFrame) -> DataFrame:
    """The last write per group and partition; tombstones delete."""
    last = journal.groupBy("group_id", *LOG).agg(F.max_by(F.struct("position", "commit_time_ms", "tombstone"), "log_offset").alias("c"))
    return last.filter(~F.col("c.tombstone")).select("group_id", *LOG, F.col("c.position").alias("position"), F.col("c.commit_time_ms").alias("commit_time_ms"))


def commit_status(journal: DataFrame, generations: DataFrame, owners: DataFrame) -> DataFrame:
    """Each commit's verdict, in the coordinator's order of checks."""
    g = generations.select("group_id", F.col("generation").alias("now"))
    m = owners.select("group_id", "member_id").distinct().withColumn("known", F.lit(True))
    o = owners.select("group_id", "member_id", *LOG).withColumn("owns", F.lit(True))
    out = journal.join(g, "group_id", "left").join(m, ["group_id", "member_id"], "left").join(o, ["group_id", "member_id", *LOG], "left")
    status = (
        F.when(F.col("position") < 0, "INVALID_ARGUMENT").when(F.col("member_id") == "", "OK").when(F.col("now").isNull(), "NOT_FOUND")
        .when(F.col("known").isNull(), "UNKNOWN_MEMBER").when(F.col("generation") != F.col("now"), "ILLEGAL_GENERATION").when(F.col("owns").isNull(), "ILLEGAL_GENERATION").otherwise("OK")
    )
    return out.withColumn("status", status)


def heartbeat_status(beats: DataFrame, members: DataFrame, generation: Column) -> DataFrame:
    """NOT_FOUND, UNKNOWN_MEMBER, REBALANCE_IN_PROGRESS or OK for each heartbeat."""
    groups = members.select("group_id").distinct().withColumn("has_group", F.lit(True))
    known = members.select("group_id", "member_id").distinct().withColumn("has_member", F.lit(True))
    out = beats.join(groups, "group_id", "left").join(known, ["group_id", "member_id"], "left")
    return out.withColumn("status", F.when(F.col("has_group").isNull(), "NOT_FOUND").when(F.col("has_member").isNull(), "UNKNOWN_MEMBER").when(F.col("beat_generation") != generation, "REBALANCE_IN_PROGRESS").otherwise("OK"))


def expired(members: DataFrame, now_ms: int) -> DataFrame:
    """Members silent for longer than their timeout (exactly the timeout is not longer)."""
    return members.filter(F.lit(now_ms) - F.col("heartbeat_ms") > F.col("timeout_ms"))


TOPOLOGY = "struct<broker_id: int, topics: array<struct<name: string, partitions: array<struct<partition: int, leader: int, replicas: array<int>, log_end_offset: long>>>>>"


def topology_documents(led: DataFrame) -> DataFrame:
    """broker, doc: each broker's JSON document of the partitions (topic, partition, log_end, replicas) it leads, the first replica."""
    one = F.struct("partition", F.get("replicas", F.lit(0)).alias("leader"), "replicas", F.col("log_end").alias("log_end_offset"))
    topics = led.groupBy(F.get("replicas", F.lit(0)).alias("broker"), F.col("topic").alias("name")).agg(F.array_sort(F.collect_list(one)).alias("partitions"))  # partitions of one topic
    docs = topics.groupBy("broker").agg(F.array_sort(F.collect_list(F.struct("name", "partitions"))).alias("topics"))  # topics of one broker
    return docs.select("broker", F.to_json(F.struct(F.col("broker").alias("broker_id"), "topics")).alias("doc"))


def topic_log_ends(docs: DataFrame, column: str) -> DataFrame:
    """topic, partitions, log_end: read from topology documents, of each partition as its leader tells it."""
    t = docs.select(F.explode(F.from_json(column, TOPOLOGY)["topics"]).alias("t")).select("t.name", F.explode("t.partitions").alias("p"))
    return t.groupBy(F.col("name").alias("topic")).agg(F.count("*").alias("partitions"), F.sum("p.log_end_offset").alias("log_end"))


def metadata_topics(topics: DataFrame, asked: DataFrame) -> DataFrame:
    """The topics that a metadata request names (topic); none named is all, unknown ones are passed by."""
    return topics.join(asked, "topic", "left_semi") if asked.limit(1).count() else topics


def describe_brokers(brokers: DataFrame, placed: DataFrame) -> DataFrame:
    """Brokers with the number of partitions that they lead and hold."""
    led = placed.groupBy(F.col("leader").alias("broker")).agg(F.count("*").alias("led"))
    held = placed.select(F.explode("replicas").alias("broker")).groupBy("broker").agg(F.count("*").alias("hosted"))
    return brokers.join(led, "broker", "left").join(held, "broker", "left").fillna(0, ["led", "hosted"])


def delete_topics(asked: DataFrame, topics: DataFrame) -> DataFrame:
    """Deletes (topic, seq) with their number for the topic, k, and ``status``: OK once for a topic that is there, else NOT_FOUND."""
    k = F.row_number().over(Window.partitionBy("topic").orderBy("seq"))
    there = topics.select("topic").distinct().withColumn("_there", F.lit(True))
    out = asked.withColumn("k", k).join(there, "topic", "left")
    return out.withColumn("status", F.when(F.col("_there") & (F.col("k") == 1), "OK").otherwise("NOT_FOUND")).drop("_there")
