"""Queries over the log, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.functions import scalars as S
from strandlog.functions import wire
from strandlog.operators import log
from strandlog.plans.sql import RECORDS, SEGMENTS, STATE, with_
from strandlog.sources import fixtures as X

QUERIES: dict = {}
SQL: dict[str, str] = {}
LOG = ["topic", "partition"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def segmented(spark: SparkSession, d: str) -> DataFrame:
    return log.roll_and_index(log.batches_of(X.records(spark, d)), X.SEGMENT_BYTES, X.INDEX_BYTES)


def requests(spark: SparkSession, d: str, isolation: int) -> DataFrame:
    """Reads of every partition: from the start, the end, the middle, just past, and far past the end."""
    state = X.state(spark, d)
    places = F.explode(F.array(F.lit(-2).cast("long"), F.lit(-1).cast("long"), F.floor(F.col("log_end") / 2), F.col("log_end"), F.col("log_end") + 1, F.lit(0).cast("long")))
    r = state.select("topic", "partition", places.alias("start"))
    return r.select(F.concat_ws(":", F.col("partition").cast("string"), F.col("start").cast("string")).alias("req_id"), *LOG, "start", F.lit(1000).alias("max_bytes"), F.lit(isolation).alias("isolation")).distinct()


REQUESTS = f"""{STATE}, q AS (SELECT DISTINCT partition || ':' || start AS req_id, partition, start FROM (
  SELECT partition, unnest([-2, -1, log_end // 2, log_end, log_end + 1, 0]) AS start FROM st))"""


def fetch_sql(end: str) -> str:
    return with_(REQUESTS, f"""
, f AS (SELECT q.*, st.log_start, st.log_end, st.hwm, CASE WHEN start = -2 THEN log_start WHEN start = -1 THEN {end} ELSE start END AS from_pos FROM q JOIN st USING (partition)),
g AS (SELECT req_id, r.pos, r.size, {end} AS visible, coalesce(sum(r.size) OVER (PARTITION BY req_id ORDER BY r.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM f JOIN r ON r.partition = f.partition AND r.pos >= from_pos WHERE from_pos BETWEEN log_start AND log_end)
SELECT req_id, pos AS "offset", b::BIGINT AS bytes_before, size FROM g WHERE b < 1000 AND pos < visible""")


@query(with_(RECORDS, "SELECT partition::BIGINT AS partition, count(*) AS n, min(pos) AS first_offset, max(pos) + 1 AS end_offset, sum(size)::BIGINT AS bytes, min(timestamp_ms) AS min_ts, max(timestamp_ms) AS max_ts FROM r GROUP BY partition"))
def route_summary(spark, d):
    """Route, assign offsets, and summarize every partition."""
    return X.records(spark, d).groupBy(F.col("partition").cast("long").alias("partition")).agg(F.count("*").alias("n"), F.min("offset").alias("first_offset"), (F.max("offset") + 1).alias("end_offset"), F.sum("size").alias("bytes"), F.min("timestamp_ms").alias("min_ts"), F.max("timestamp_ms").alias("max_ts"))


@query(with_(RECORDS, 'SELECT seq, partition::BIGINT AS partition, pos AS "offset", timestamp_ms, size FROM r'))
def append_assign_offsets(spark, d):
    return X.records(spark, d).select("seq", F.col("partition").cast("long").alias("partition"), "offset", "timestamp_ms", "size")


@query(with_(RECORDS, "SELECT seq, coalesce(sum(size) OVER (PARTITION BY partition ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM r"))
def byte_positions(spark, d):
    return log.running(X.records(spark, d), F.col("size"), "position").select("seq", "position")


@query(fetch_sql("log_end"))
def fetch_read_uncommitted(spark, d):
    r = X.records(spark, d)
    return log.fetch(r, X.state(spark, d), requests(spark, d, 0)).select("req_id", "offset", "bytes_before", "size")


@query(fetch_sql("hwm"))
def fetch_read_committed(spark, d):
    r = X.records(spark, d)
    return log.fetch(r, X.state(spark, d), requests(spark, d, 1)).select("req_id", "offset", "bytes_before", "size")


@query(with_(RECORDS, 'SELECT partition::BIGINT AS partition, pos AS "offset", key, value FROM r WHERE pos BETWEEN 100 AND 199'))
def fetch_range(spark, d):
    return X.records(spark, d).filter(F.col("offset").between(100, 199)).select(F.col("partition").cast("long").alias("partition"), "offset", "key", "value")


@query(with_(RECORDS, """, c AS (SELECT partition, pos, sum(size) OVER (PARTITION BY partition ORDER BY pos) - size AS b FROM r WHERE pos >= 60)
SELECT partition::BIGINT AS partition, count(*) AS n, max(pos) AS last_offset FROM c WHERE b < 1000 GROUP BY partition"""))
def fetch_byte_budget(spark, d):
    r = X.records(spark, d)
    asked = X.state(spark, d).select(F.col("partition").cast("string").alias("req_id"), *LOG, F.lit(60).cast("long").alias("start"), F.lit(1000).alias("max_bytes"), F.lit(0).alias("isolation"))
    state = X.state(spark, d).withColumn("log_start", F.lit(0).cast("long"))
    return log.fetch(r, state, asked).groupBy(F.col("partition").cast("long").alias("partition")).agg(F.count("*").alias("n"), F.max("offset").alias("last_offset"))


@query(with_(REQUESTS, """, f AS (SELECT q.*, log_start, log_end, CASE WHEN start = -2 THEN log_start WHEN start = -1 THEN log_end ELSE start END AS from_pos FROM q LEFT JOIN st USING (partition))
SELECT req_id, from_pos AS from_offset, CASE WHEN from_pos < log_start OR from_pos > log_end THEN 'OUT_OF_RANGE' ELSE 'OK' END AS error FROM f"""))
def fetch_bounds_check(spark, d):
    return log.bounds_error(requests(spark, d, 0), X.state(spark, d)).select("req_id", "from_offset", "error")


@query(with_(RECORDS, 'SELECT partition::BIGINT AS partition, pos AS "offset", value FROM r QUALIFY row_number() OVER (PARTITION BY partition ORDER BY pos) <= 25'))
def consume_limit(spark, d):
    return log.consume(X.records(spark, d), F.lit(0), 25).select(F.col("partition").cast("long").alias("partition"), "offset", "value")


def times(spark: SparkSession, d: str) -> DataFrame:
    """Ten times per partition, from before its first to after its last record."""
    ends = X.records(spark, d).groupBy(*LOG).agg(F.min("timestamp_ms").alias("lo"), F.max("timestamp_ms").alias("hi"))
    t = F.col("lo") + F.floor((F.col("hi") - F.col("lo")) * (F.col("k") - 1) / 8)
    return ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).select(*LOG, t.cast("long").alias("t")).distinct()


TIMES = f"{STATE}, tq AS (SELECT DISTINCT partition, (lo + ((hi - lo) * (k - 1) // 8))::BIGINT AS t FROM (SELECT partition, min(timestamp_ms) AS lo, max(timestamp_ms) AS hi FROM r GROUP BY partition), range(10) AS x(k))"


@query(with_(TIMES.replace("(hi - lo) * (k - 1) // 8", "floor((hi - lo) * (k - 1) / 8)::BIGINT"), 'SELECT tq.partition::BIGINT AS partition, t, coalesce(min(r.pos) FILTER (r.timestamp_ms >= t), any_value(log_end)) AS found FROM tq JOIN st USING (partition) JOIN r USING (partition) GROUP BY tq.partition, t'))
def list_offsets_exact(spark, d):
    r = X.records(spark, d)
    return log.offsets_for_times(r, X.state(spark, d), times(spark, d)).select(F.col("partition").cast("long").alias("partition"), "t", "found")


SEGMENT_TIMES = f"""{SEGMENTS}, tq AS (SELECT DISTINCT partition, (lo + floor((hi - lo) * (k - 1) / 8)::BIGINT)::BIGINT AS t FROM (SELECT partition, min(timestamp_ms) AS lo, max(timestamp_ms) AS hi FROM r GROUP BY partition), range(10) AS x(k)),
sg AS (SELECT partition, seg, max(max_ts) AS seg_ts, sum(bytes)::BIGINT AS bytes, sum(n)::BIGINT AS records, max(last) AS last FROM s GROUP BY partition, seg),
ix AS (SELECT *, max(max_ts) OVER (PARTITION BY partition, seg ORDER BY base ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s WHERE indexed),
tx AS (SELECT * FROM ix WHERE top IS NULL OR max_ts >= top)"""


@query(with_(SEGMENT_TIMES, """SELECT tq.partition::BIGINT AS partition, t, coalesce((SELECT min(tx.base) FROM tx JOIN sg ON sg.partition = tx.partition AND sg.seg = tx.seg WHERE tx.partition = tq.partition AND seg_ts >= t AND tx.max_ts >= t), log_end) AS found FROM tq JOIN st USING (partition)"""))
def list_offsets_sparse(spark, d):
    r = X.records(spark, d)
    return log.offsets_for_times_sparse(segmented(spark, d), X.state(spark, d), times(spark, d)).select(F.col("partition").cast("long").alias("partition"), "t", "found")


@query(with_(STATE, "SELECT partition::BIGINT AS partition, log_start AS earliest, log_end AS latest FROM st"))
def list_offsets_bounds(spark, d):
    return X.state(spark, d).select(F.col("partition").cast("long").alias("partition"), F.col("log_start").alias("earliest"), F.col("log_end").alias("latest"))


@query(with_(SEGMENT_TIMES, "SELECT partition::BIGINT AS partition, seg AS segment_base, bytes, records, last FROM sg"))
def segment_roll(spark, d):
    return log.segments_of(segmented(spark, d)).select(F.col("partition").cast("long").alias("partition"), "segment_base", "bytes", "records", "last")


@query(with_(SEGMENTS, "SELECT partition::BIGINT AS partition, seg AS segment_base, base - seg AS rel_offset, start::BIGINT AS position FROM s WHERE indexed"))
def build_offset_index(spark, d):
    return segmented(spark, d).filter("indexed").select(F.col("partition").cast("long").alias("partition"), "segment_base", (F.col("base") - F.col("segment_base")).alias("rel_offset"), F.col("start").alias("position"))


@query(with_(SEGMENT_TIMES, "SELECT partition::BIGINT AS partition, seg AS segment_base, base - seg AS rel_offset, max_ts AS ts_ms FROM tx"))
def build_time_index(spark, d):
    return log.time_index(segmented(spark, d)).select(F.col("partition").cast("long").alias("partition"), "segment_base", (F.col("base") - F.col("segment_base")).alias("rel_offset"), F.col("max_ts").alias("ts_ms"))


@query(with_(SEGMENT_TIMES, "SELECT r.seq, sg.seg AS segment_base FROM r ASOF JOIN sg ON r.partition = sg.partition AND r.pos >= sg.seg"))
def segment_for_offset(spark, d):
    r = X.records(spark, d).select(*LOG, "seq", "offset")
    return log.as_of(r, log.segments_of(segmented(spark, d)), LOG, "offset", "segment_base", "segment_base").select("seq", "segment_base")


@query(with_(SEGMENT_TIMES, "SELECT r.seq, ix.start::BIGINT AS start FROM r ASOF JOIN ix ON r.partition = ix.partition AND r.pos >= ix.base"))
def index_floor_lookup(spark, d):
    r = X.records(spark, d).select(*LOG, "seq", "offset")
    return log.as_of(r, segmented(spark, d).filter("indexed"), LOG, "offset", "base", "start").select("seq", "start")


@query(with_(SEGMENTS, """, e AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY base) AS k, CASE WHEN batch_id % 41 = 40 THEN 0 ELSE base END AS stored FROM s WHERE indexed),
v AS (SELECT *, coalesce(stored <= lag(stored) OVER (PARTITION BY partition ORDER BY k), FALSE) AS bad FROM e),
p AS (SELECT *, max(bad::INT) OVER (PARTITION BY partition ORDER BY k) AS cut FROM v)
SELECT partition::BIGINT AS partition, count(*) AS entries, max(stored) AS last_entry FROM p WHERE cut = 0 GROUP BY partition"""))
def index_valid_prefix(spark, d):
    e = segmented(spark, d).filter("indexed").withColumn("stored", F.when(F.col("batch_id") % 41 == 40, 0).otherwise(F.col("base")))
    e = e.withColumn("bad", F.coalesce(F.col("stored") <= F.lag("stored").over(Window.partitionBy(*LOG).orderBy("base")), F.lit(False)))
    return log.valid_prefix(e, LOG, "base", F.col("bad")).groupBy(F.col("partition").cast("long").alias("partition")).agg(F.count("*").alias("entries"), F.max("stored").alias("last_entry"))


@query(with_(SEGMENT_TIMES, """, w AS (SELECT *, sum(bytes) OVER (PARTITION BY partition ORDER BY seg DESC) AS rest, lead(seg) OVER (PARTITION BY partition ORDER BY seg) AS nxt FROM sg)
SELECT partition::BIGINT AS partition, seg AS segment_base, nxt IS NOT NULL AND rest > 40000 AS dropped FROM w"""))
def retention_size(spark, d):
    return log.retention(log.segments_of(segmented(spark, d)), 0, max_bytes=40_000).select(F.col("partition").cast("long").alias("partition"), "segment_base", "dropped")


NOW = 1_706_000_000_000


@query(with_(SEGMENT_TIMES, f""", w AS (SELECT *, lead(seg) OVER (PARTITION BY partition ORDER BY seg) IS NOT NULL AND seg_ts > 0 AND {NOW} - seg_ts > 864000000 AS one FROM sg)
SELECT partition::BIGINT AS partition, seg AS segment_base, bool_and(one) OVER (PARTITION BY partition ORDER BY seg) AS dropped FROM w"""))
def retention_age(spark, d):
    return log.retention(log.segments_of(segmented(spark, d)), NOW, max_age_ms=864_000_000).select(F.col("partition").cast("long").alias("partition"), "segment_base", "dropped")


@query(with_(STATE, "SELECT r.partition::BIGINT AS partition, count(*) AS n, max(pos) AS last_offset FROM r JOIN st USING (partition) WHERE pos < flushed GROUP BY r.partition"))
def truncate_to(spark, d):
    r = X.records(spark, d)
    return log.truncate(r, X.state(spark, d).select(*LOG, F.col("flushed").alias("new_end"))).groupBy(F.col("partition").cast("long").alias("partition")).agg(F.count("*").alias("n"), F.max("offset").alias("last_offset"))


#: Where each partition's bytes end, and why (see ``fixtures.damaged``).
DAMAGED = f"""{STATE}, ct AS (SELECT partition, log_end, CASE partition WHEN 0 THEN log_end * 7 // 8 WHEN 1 THEN log_end * 9 // 10 WHEN 2 THEN log_end - 1 ELSE log_end END AS cut,
  CASE partition WHEN 0 THEN 'CORRUPT' WHEN 1 THEN 'GAP' WHEN 2 THEN 'SHORT' ELSE 'EMPTY' END AS reason FROM st),
dm AS (SELECT r.*, cut, reason, log_end FROM r JOIN ct USING (partition) WHERE r.partition <> 1 OR pos <> cut)"""


@query(with_(DAMAGED, "SELECT seq FROM dm WHERE pos < cut"))
def recover_valid_prefix(spark, d):
    """What a log keeps after a crash, found from its bytes."""
    return log.recover(X.damaged(spark, d)).select("seq")


@query(with_(DAMAGED, """SELECT partition::BIGINT AS partition, count(*) + max((partition = 3)::INT) AS records, count(*) FILTER (pos < cut) AS kept, max(cut) AS next_offset, any_value(reason) AS reason,
(CASE WHEN partition = 3 THEN 0 ELSE sum(CASE WHEN pos >= cut THEN size - CASE WHEN partition = 2 THEN 3 ELSE 0 END ELSE 0 END) END)::BIGINT AS cut_bytes, CASE WHEN partition = 3 THEN 64 ELSE 0 END::BIGINT AS reserved_bytes FROM dm GROUP BY partition"""))
def recovery_report(spark, d):
    return log.recovery_report(X.damaged(spark, d)).select(F.col("partition").cast("long").alias("partition"), "records", "kept", "next_offset", "reason", F.col("cut_bytes").cast("long").alias("cut_bytes"), F.col("reserved_bytes").cast("long").alias("reserved_bytes"))


def gapped(spark: SparkSession, d: str) -> DataFrame:
    """The log without one record in each partition, at 9/10."""
    r = X.records(spark, d)
    return r.join(X.state(spark, d), LOG).filter(F.col("offset") != F.floor(F.col("log_end") * 9 / 10))


@query(with_(STATE, 'SELECT partition::BIGINT AS partition, pos AS "offset", pos - prev - 1 AS missing FROM (SELECT r.partition, pos, lag(pos) OVER (PARTITION BY r.partition ORDER BY pos) AS prev FROM r JOIN st USING (partition) WHERE pos <> log_end * 9 // 10) WHERE pos <> prev + 1'))
def offset_gaps(spark, d):
    return log.gaps(gapped(spark, d)).select(F.col("partition").cast("long").alias("partition"), "offset", "missing")


@query(with_(STATE, """, u AS (SELECT r.partition, count(*) FILTER (pos >= flushed) AS unflushed_records, coalesce(sum(size) FILTER (pos >= flushed), 0)::BIGINT AS unflushed_bytes, coalesce(max(timestamp_ms) FILTER (pos >= flushed) - min(timestamp_ms) FILTER (pos >= flushed), 0) AS unflushed_ms FROM r JOIN st USING (partition) GROUP BY r.partition)
SELECT partition::BIGINT AS partition, unflushed_records, unflushed_bytes, unflushed_ms, unflushed_records > 0 AND (unflushed_records >= 500 OR unflushed_bytes >= 20000 OR unflushed_ms >= 3600000) AS due FROM u"""))
def needs_flush(spark, d):
    """Records, bytes and time that are not flushed, each against its threshold."""
    r = X.records(spark, d)
    rest = r.join(X.state(spark, d), LOG).withColumn("rest", F.col("offset") >= F.col("flushed"))
    of = lambda c: F.when(F.col("rest"), F.col(c))
    u = rest.groupBy(*LOG).agg(F.count_if("rest").alias("unflushed_records"), F.coalesce(F.sum(of("size")), F.lit(0)).alias("unflushed_bytes"), F.coalesce(F.max(of("timestamp_ms")) - F.min(of("timestamp_ms")), F.lit(0)).alias("unflushed_ms"))
    return log.needs_flush(u, 500, 20_000, 3_600_000).select(F.col("partition").cast("long").alias("partition"), "unflushed_records", "unflushed_bytes", "unflushed_ms", "due")


@query(with_(RECORDS, "SELECT seq, size FROM r"))
def encoded_record_size(spark, d):
    return X.produced(spark, d).select("seq", S.record_size(F.col("key"), F.col("value")).alias("size"))


@query(with_(RECORDS, "SELECT seq, key, attributes & 3 AS codec FROM r WHERE attributes & 4 <> 0"))
def tombstones(spark, d):
    return X.records(spark, d).filter(F.col("attributes").bitwiseAND(F.lit(4)) != 0).select("seq", "key", F.col("attributes").bitwiseAND(F.lit(3)).alias("codec"))


@query(with_(RECORDS, 'SELECT seq, size, pos AS "offset", timestamp_ms, seq % 30 <> 0 AS ok FROM r'))
def verify_checksums(spark, d):
    """Every stored record's bytes against its checksum; in every thirtieth a bit is turned. Offset and time are read from the bytes without it."""
    rows = X.stored(spark, d).withColumn("data", F.when(F.col("seq") % 30 == 0, wire.turned(F.col("data"))).otherwise(F.col("data")))
    read = wire.parsed(rows.select("seq", "data"))
    return read.select("seq", F.octet_length("data").cast("long").alias("size"), wire.little(F.col("data"), 9, 8).alias("offset"), wire.peek_timestamp(F.col("data")).alias("timestamp_ms"), (F.col("verdict") == "OK").alias("ok"))


@query(with_(RECORDS, 'SELECT seq, pos AS "offset", timestamp_ms, attributes::BIGINT AS attributes, key, value FROM r'))
def decode_records(spark, d):
    """Every record from its bytes."""
    read = wire.parsed(X.stored(spark, d).select("seq", "data")).select("seq", "record.*").drop("verdict")
    return read.withColumns({"attributes": F.col("attributes").cast("long"), "key": F.col("key").cast("string"), "value": F.col("value").cast("string")})


@query(with_(RECORDS, 'SELECT seq, pos + 1000 AS "offset", timestamp_ms + 5 AS timestamp_ms, size - 4 AS length, TRUE AS ok FROM r'))
def rewrite_headers(spark, d):
    """Every record's bytes under another offset and time, whole again."""
    rows = X.stored(spark, d).select("seq", wire.rewrite_header(F.col("data"), F.col("offset") + 1000, F.col("timestamp_ms") + 5).alias("data"))
    return wire.parsed(rows).select("seq", "record.offset", "record.timestamp_ms", wire.peek_length(F.col("data")).alias("length"), (F.col("verdict") == "OK").alias("ok"))


@query(with_(RECORDS, """, b AS (SELECT partition, batch_id, count(*) AS n FROM r GROUP BY partition, batch_id)
SELECT partition::BIGINT AS partition, batch_id, n, CASE WHEN batch_id % 13 = 0 THEN 'INVALID_ARGUMENT' WHEN batch_id % 7 = 0 THEN 'CORRUPTION' ELSE 'OK' END AS status FROM b"""))
def produce_status(spark, d):
    """Produced batches, some with a wrong count or a cut record; turned bits do not matter here, as checksums are made anew."""
    rows = X.stored(spark, d)
    first = F.min("offset").over(Window.partitionBy(*LOG, "batch_id"))
    rows = rows.withColumn("first", F.col("offset") == first)
    cut = F.when(F.col("first") & (F.col("batch_id") % 7 == 0) & (F.col("batch_id") % 13 != 0), F.substring(F.col("data"), F.lit(1), F.octet_length("data") - 1)).when(F.col("batch_id") % 5 == 0, wire.turned(F.col("data"))).otherwise(F.col("data"))
    counts = rows.groupBy(*LOG, "batch_id").agg(F.count("*").alias("n"))
    declared = counts.select(*LOG, "batch_id", F.when(F.col("batch_id") % 13 == 0, F.col("n") + 99).otherwise(F.col("n")).alias("declared"))
    return log.produce_status(rows.withColumn("data", cut), declared).select(F.col("partition").cast("long").alias("partition"), "batch_id", "n", "status")


@query(with_(STATE, """SELECT partition::BIGINT AS partition, CASE WHEN partition = 3 THEN 'OUT_OF_RANGE' ELSE 'OK' END AS status, CASE WHEN partition = 3 THEN 0 ELSE log_end - flushed END AS appended FROM st"""))
def append_vectored(spark, d):
    """What lies beyond the flushed end as one append of three parts; partition 3 lacks a record between two of them."""
    r = X.records(spark, d)
    rows = r.join(X.state(spark, d), LOG).filter("offset >= flushed").withColumn("part_no", F.floor((F.col("offset") - F.col("flushed")) * 3 / (F.col("log_end") - F.col("flushed"))))
    rows = rows.filter("partition <> 3 OR offset <> flushed + (log_end - flushed) div 2")
    high = X.state(spark, d).select(*LOG, F.col("flushed").alias("log_end"))
    kept, verdict = log.append_vectored([rows.filter(F.col("part_no") == k).select(*LOG, "offset") for k in range(3)], high)
    counts = kept.groupBy(*LOG).agg(F.count("*").alias("appended"))
    return verdict.join(counts, LOG, "left").select(F.col("partition").cast("long").alias("partition"), "status", F.coalesce("appended", F.lit(0)).alias("appended"))


@query(with_(STATE, """, m AS (SELECT partition, batch_id, min(pos) AS base, max(append_time_ms) AS append_ms, sum(size)::BIGINT AS bytes, row_number() OVER (PARTITION BY partition ORDER BY min(pos)) AS k FROM r GROUP BY partition, batch_id),
s AS (SELECT partition, base, k, base AS seg, bytes AS used, append_ms AS since FROM m WHERE k = 1
 UNION ALL SELECT partition, base, k, CASE WHEN roll THEN base ELSE seg END, CASE WHEN roll THEN bytes ELSE used + bytes END, CASE WHEN roll THEN append_ms ELSE since END
 FROM (SELECT m.*, s.seg, s.used, s.since, s.used + m.bytes > 65536 OR m.append_ms - s.since >= 14400000 AS roll FROM s JOIN m ON m.partition = s.partition AND m.k = s.k + 1))
SELECT partition::BIGINT AS partition, seg AS segment_base, count(*) AS batches FROM s GROUP BY partition, seg""").replace("WITH ", "WITH RECURSIVE ", 1))
def segment_roll_by_age(spark, d):
    """Segments that close after four hours, or before 64 KiB are exceeded."""
    r = X.records(spark, d)
    times = r.groupBy(*LOG, "batch_id").agg(F.max("append_time_ms").alias("append_ms"))
    out = log.roll_and_index(log.batches_of(r).join(times, [*LOG, "batch_id"]), 65536, X.INDEX_BYTES, 14_400_000)
    return out.groupBy(F.col("partition").cast("long").alias("partition"), "segment_base").agg(F.count("*").alias("batches"))


@query(with_(SEGMENT_TIMES, "SELECT sg.partition::BIGINT AS partition, seg AS segment_base, CASE WHEN seg >= flushed AND seg <> min(seg) OVER (PARTITION BY sg.partition) THEN 'DROPPED' WHEN last >= flushed THEN 'CUT' ELSE 'KEPT' END AS fate FROM sg JOIN st USING (partition)"))
def truncate_segments(spark, d):
    ends = X.state(spark, d).select(*LOG, F.col("flushed").alias("new_end"))
    return log.truncate_segments(log.segments_of(segmented(spark, d)), ends).select(F.col("partition").cast("long").alias("partition"), "segment_base", "fate")


@query(with_(SEGMENT_TIMES, """, x AS (SELECT r.partition, r.pos, r.size, sg.seg, sum(r.size) OVER (PARTITION BY r.partition, sg.seg ORDER BY r.pos) AS upto FROM r ASOF JOIN sg ON r.partition = sg.partition AND r.pos >= sg.seg)
SELECT partition::BIGINT AS partition, seg AS segment_base, count(*) AS n, sum(size)::BIGINT AS bytes FROM x WHERE upto <= 700 OR pos = seg GROUP BY partition, seg"""))
def fetch_within_segment(spark, d):
    """The first records of every segment, of no more than 700 bytes in all, one at least."""
    r = log.running(X.records(spark, d), F.col("size"), "position").select(*LOG, "seq", "offset", "position", "size")
    entries = log.as_of(r, log.segments_of(segmented(spark, d)), LOG, "offset", "segment_base", "segment_base")
    asked = log.segments_of(segmented(spark, d)).select(F.concat_ws(":", F.col("partition").cast("string"), F.col("segment_base").cast("string")).alias("req_id"), *LOG, "segment_base", F.col("segment_base").alias("start"), F.lit(700).alias("max_bytes"))
    return log.within_segment(entries, asked).groupBy(F.col("partition").cast("long").alias("partition"), "segment_base").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(with_(RECORDS, "SELECT partition::BIGINT AS partition, batch_no, count(*) AS n FROM (SELECT partition, (row_number() OVER (PARTITION BY partition ORDER BY seq) - 1) // 64 AS batch_no FROM r) GROUP BY partition, batch_no"))
def batch_by_count(spark, d):
    return X.records(spark, d).groupBy(F.col("partition").cast("long").alias("partition"), F.floor(F.col("offset") / 64).alias("batch_no")).agg(F.count("*").alias("n"))


@query(with_("RECURSIVE " + RECORDS, """, b AS (SELECT partition, pos, size, 0::BIGINT AS batch_no, size AS used, 1 AS n FROM r WHERE pos = 0 UNION ALL
SELECT r.partition, r.pos, r.size, CASE WHEN b.used + r.size > 2048 OR b.n >= 50 THEN b.batch_no + 1 ELSE b.batch_no END, CASE WHEN b.used + r.size > 2048 OR b.n >= 50 THEN r.size ELSE b.used + r.size END, CASE WHEN b.used + r.size > 2048 OR b.n >= 50 THEN 1 ELSE b.n + 1 END
FROM b JOIN r ON r.partition = b.partition AND r.pos = b.pos + 1)
SELECT partition::BIGINT AS partition, batch_no, count(*) AS n, sum(size)::BIGINT AS bytes FROM b GROUP BY partition, batch_no"""))
def batch_by_bytes(spark, d):
    return log.batch_by_bytes(X.records(spark, d), 2048, 50).groupBy(F.col("partition").cast("long").alias("partition"), "batch_no").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(with_(SEGMENT_TIMES, "SELECT partition::BIGINT AS partition, count(*) AS segments, sum(bytes)::BIGINT AS bytes, sum(records)::BIGINT AS records, min(seg) AS log_start, max(last) + 1 AS log_end FROM sg GROUP BY partition"))
def log_stats(spark, d):
    s = log.segments_of(segmented(spark, d))
    return s.groupBy(F.col("partition").cast("long").alias("partition")).agg(F.count("*").alias("segments"), F.sum("bytes").alias("bytes"), F.sum("records").alias("records"), F.min("segment_base").alias("log_start"), (F.max("last") + 1).alias("log_end"))


@query(with_(SEGMENT_TIMES, "SELECT partition::BIGINT AS partition, max(seg) AS segment_base, arg_max(bytes, seg) AS bytes FROM sg GROUP BY partition"))
def latest_segment(spark, d):
    return log.segments_of(segmented(spark, d)).groupBy(F.col("partition").cast("long").alias("partition")).agg(F.max("segment_base").alias("segment_base"), F.max_by("bytes", "segment_base").alias("bytes"))


@query(with_(RECORDS, """, b AS (SELECT partition, batch_id, min(pos) AS base, max(pos) AS last, count(*) AS n FROM r GROUP BY partition, batch_id),
e AS (SELECT partition, count(*) // 2 AS log_end FROM r GROUP BY partition), x AS (SELECT b.*, coalesce((SELECT max(b2.base) FROM b b2 WHERE b2.partition = b.partition AND b2.base <= e.log_end), 0) AS log_end FROM b JOIN e USING (partition))
SELECT partition::BIGINT AS partition, batch_id, CASE WHEN batch_id % 9 = 0 THEN 'NOT_LEADER' WHEN base <> log_end THEN 'OUT_OF_RANGE' WHEN batch_id % 2 = 0 THEN 'CORRUPT' ELSE 'APPENDED' END AS verdict FROM x"""))
def replicate_accept(spark, d):
    r = X.records(spark, d)
    b = log.batches_of(r)
    half = X.state(spark, d).select(*LOG, F.floor(F.col("log_end") / 2).alias("half"))
    ends = b.join(half, LOG).filter("base <= half").groupBy(*LOG).agg(F.max("base").alias("log_end"))
    # In every other batch a bit of the first record is turned; the follower finds it.
    first = F.col("offset") == F.min("offset").over(Window.partitionBy(*LOG, "batch_id"))
    sent = X.stored(spark, d).withColumn("data", F.when(first & (F.col("batch_id") % 2 == 0), wire.turned(F.col("data"))).otherwise(F.col("data")))
    pushed = log.checked_batches(sent).withColumn("epoch", F.when(F.col("batch_id") % 9 == 0, 0).otherwise(1))
    return log.accept_batches(pushed, ends, 1).select(F.col("partition").cast("long").alias("partition"), "batch_id", "verdict")
