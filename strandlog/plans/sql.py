"""Pieces of oracle SQL: the same fixtures as ``sources.fixtures``, in DuckDB's dialect."""

from __future__ import annotations

from strandlog.functions.scalars import crc32c_table

TABLE = "[" + ", ".join(map(str, crc32c_table())) + "]"


def crc(x: str) -> str:
    """CRC-32C of an ASCII string expression."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({x}) + 1), lambda i: ascii(substr({x}, i, 1))::BIGINT)), lambda c, b: xor(c >> 8, ({TABLE}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


def with_(parts: str, tail: str) -> str:
    tail = tail.strip()
    return f"WITH {parts}{tail}" if tail.startswith(",") else f"WITH {parts} {tail}"


def vs(x: str) -> str:
    return f"(1 + ({x} >= 128)::INT + ({x} >= 16384)::INT + ({x} >= 2097152)::INT)"


RECORDS = f"""ku AS (SELECT user_id, ({crc('user_id::VARCHAR')} & 2147483647) % 4 AS p FROM (SELECT DISTINCT user_id FROM events)),
e0 AS (SELECT event_id AS seq, event_id // 100 AS batch_id, CASE WHEN user_id % 5 <> 0 THEN user_id::VARCHAR END AS key, props AS value,
  CASE WHEN event_id % 97 = 0 THEN 0 WHEN event_id % 50 = 0 THEN epoch_us(ts) // 1000 - 3600000 ELSE epoch_us(ts) // 1000 END AS raw_ms,
  max(epoch_us(ts) // 1000) OVER (PARTITION BY event_id // 100) AS append_time_ms, CASE WHEN event_id % 101 = 0 THEN 4 ELSE 0 END AS attributes,
  CASE WHEN user_id % 5 <> 0 THEN p ELSE event_id // 100 % 4 END AS partition FROM events JOIN ku USING (user_id)),
r AS (SELECT *, CASE WHEN raw_ms <= 0 THEN append_time_ms ELSE raw_ms END AS timestamp_ms,
  (25 + {vs('coalesce(strlen(key) + 1, 0)')} + {vs('strlen(value)')} + coalesce(strlen(key), 0) + strlen(value))::BIGINT AS size,
  row_number() OVER (PARTITION BY partition ORDER BY seq) - 1 AS pos FROM e0)"""

STATE = f"{RECORDS}, st AS (SELECT partition, log_end // 20 AS log_start, log_end, log_end * 8 // 10 AS flushed, log_end * 9 // 10 AS hwm FROM (SELECT partition, max(pos) + 1 AS log_end FROM r GROUP BY partition))"

#: Batches in order, their segment (16 KiB), byte position and index flag (512 bytes).
SEGMENTS = f"""RECURSIVE {STATE},
bt AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY base) AS k FROM (SELECT partition, batch_id, min(pos) AS base, max(pos) AS last, count(*) AS n, sum(size)::BIGINT AS bytes, max(timestamp_ms) AS max_ts FROM r GROUP BY partition, batch_id)),
s AS (SELECT partition, batch_id, base, last, n, bytes, max_ts, k, base AS seg, 0::BIGINT AS start, TRUE AS indexed, 0::BIGINT AS mark FROM bt WHERE k = 1
 UNION ALL
 SELECT partition, batch_id, base, last, n, bytes, max_ts, k, CASE WHEN roll THEN base ELSE seg END, CASE WHEN roll THEN 0 ELSE used END, roll OR used - mark >= 512, CASE WHEN roll THEN 0 WHEN used - mark >= 512 THEN used ELSE mark END
 FROM (SELECT bt.*, s.seg, s.mark, s.start + s.bytes AS used, s.start + s.bytes + bt.bytes > 16384 AS roll FROM s JOIN bt ON bt.partition = s.partition AND bt.k = s.k + 1))"""

PROGRESS = f"""{STATE}, pr AS (SELECT event_id AS seq, event_id % 4 AS partition, 1 + event_id // 4 % 2 AS broker, (event_id % 211 = 0)::BIGINT AS epoch, event_id % 13 <> 0 AS connected, st.log_end AS leader_end,
  st.log_end * (event_id % 10 + 1) // 10 AS log_end FROM events JOIN st ON st.partition = event_id % 4),
pg AS (SELECT *, log_end - log_end // 20 AS flushed FROM pr),
fo AS (SELECT partition, broker, max(log_end) AS leo, max(flushed) AS flushed_end, arg_max(connected, seq) AS in_sync FROM pg GROUP BY partition, broker)"""

COMMITS = """cm AS (SELECT event_id AS log_offset, 'group-' || (event_id % 7) AS group_id, event_id // 7 % 5 AS partition, CASE WHEN event_id % 31 = 0 THEN -5 ELSE event_id // 3 - event_id % 11 END AS position,
  epoch_us(ts) // 1000 AS commit_time_ms, event_id % 23 = 0 AS tombstone, CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 = 0 THEN 'stranger' ELSE 'member-' || (event_id % 3) END AS member_id,
  CASE WHEN event_id % 29 = 0 THEN 1 ELSE 2 END AS generation FROM events),
lc AS (SELECT * FROM cm QUALIFY row_number() OVER (PARTITION BY group_id, partition ORDER BY log_offset DESC) = 1),
co AS (SELECT group_id, partition, position, commit_time_ms FROM lc WHERE NOT tombstone)"""

#: Members of all events: every sixty make four groups.
MEMBERS = """mb AS (SELECT 'group-' || (event_id // 60 * 4 + event_id % 4) AS group_id, 'g-' || (event_id % 60 // 4) AS member_id, 10000 * (event_id % 60) AS heartbeat_ms, event_id % 8 = 3 AS audits FROM events),
mr AS (SELECT group_id, member_id, row_number() OVER (PARTITION BY group_id ORDER BY member_id) - 1 AS rank, count(*) OVER (PARTITION BY group_id) AS k FROM mb),
tp AS (SELECT * FROM (VALUES ('events', 40), ('audit', 7)) AS t(topic, partitions)),
gp AS (SELECT group_id, topic, partitions, unnest(range(partitions)) AS partition FROM (SELECT DISTINCT group_id, 'events' AS topic FROM mb UNION SELECT DISTINCT group_id, 'audit' FROM mb WHERE audits) JOIN tp USING (topic))"""
