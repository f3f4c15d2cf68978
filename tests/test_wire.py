"""Checksums and stored records against plain loops."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from strandlog.functions import crc, wire
from strandlog.functions.scalars import CRC_TABLE
from strandlog.operators import log
from strandlog.sources import frames


def plain(data):
    c = 0xFFFFFFFF
    for b in data:
        c = c >> 8 ^ CRC_TABLE[(c ^ b) & 255]
    return c ^ 0xFFFFFFFF


def test_checksums_are_those_of_a_plain_loop():
    rng = random.Random(1)
    data = [rng.randbytes(n) for n in [0, 1, 2, 3, 4, 5, 255, 256, 257, 511, 512, 513, 5000, *(rng.randrange(900) for _ in range(100))]]
    assert crc.crc32c_array(pa.array([*data, None])).to_pylist() == [*map(plain, data), None]
    assert crc.crc32c_array(pa.array(data)[7:20]).to_pylist() == [*map(plain, data[7:20])]
    assert crc.crc32c(b"123456789") == 0xE3069283
    assert crc.crc32c_array(pa.array([], pa.binary())).to_pylist() == []


def test_records_come_back(spark):
    rows = [(-1, 0, 0, None, b""), (5, 1_600_000_000_000, 4, b"", b"x"), (1 << 40, -7, 255, b"k" * 200, b"v" * 20_000), (7, 1, 0, b"k", None)]
    df = spark.createDataFrame(rows, "offset long, timestamp_ms long, attributes int, key binary, value binary")
    df = df.withColumn("data", wire.encode(*(F.col(c) for c in df.columns)))
    got = wire.parsed(df.select("data")).collect()
    assert [r.verdict for r in got] == ["OK"] * 4
    assert [(r.record.offset, r.record.timestamp_ms, r.record.attributes, r.record.key, r.record.value) for r in got] == [(*r[:4], r[4] or b"") for r in rows]
    assert [len(r.data) for r in got] == [27, 28, 25 + 2 + 3 + 200 + 20_000, 28]
    moved = wire.parsed(df.select(wire.rewrite_header(F.col("data"), F.lit(9), F.lit(8)).alias("data"))).collect()
    assert {(r.verdict, r.record.offset, r.record.timestamp_ms) for r in moved} == {("OK", 9, 8)}
    (good,) = wire.sealed([wire.body(1, 2, 0, b"k", b"value")])
    wrong = [good[:3], good[:20], good[:-1], good + b" ", bytes(64), good[:-1] + b"X", b"\x05" + good[1:], None]
    verdicts = wire.parsed(spark.createDataFrame([(w,) for w in wrong], "data binary")).collect()
    assert [r.verdict for r in verdicts] == ["SHORT", "SHORT", "SHORT", "BAD_LENGTH", "EMPTY", "CORRUPT", "BAD_LENGTH", "SHORT"]


def stored(spark, datas):
    return spark.createDataFrame([("t", 0, k, d) for k, d in enumerate(datas)], "topic string, partition int, slot long, data binary")


def test_recovery_finds_the_damage(spark):
    good = wire.sealed([wire.body(k, 1, 0, None, b"v" * 10) for k in range(8)])
    bad = good[3][:-1] + b"X"
    cases = {
        "CORRUPT": [*good[:3], bad, *good[4:]], "GAP": [*good[:3], *good[4:]], "SHORT": [*good[:3], good[3][:20]], "EMPTY": [*good[:3], bytes(64)],
    }
    for reason, datas in cases.items():
        r = log.recovery_report(stored(spark, datas)).first()
        assert (r.kept, r.next_offset, r.reason) == (3, 3, reason)
        assert r.cut_bytes + r.reserved_bytes == sum(map(len, datas[3:]))
        assert (r.reserved_bytes > 0) == (reason == "EMPTY")
        assert log.recover(stored(spark, datas)).count() == 3
    whole = log.recovery_report(stored(spark, good)).first()
    assert (whole.kept, whole.next_offset, whole.reason, whole.cut_bytes) == (8, 8, None, 0)


def test_frame_verdicts(spark):
    df = spark.range(13).select(F.col("id").alias("event_id"), F.lit("payload").alias("props"))
    got = [r.verdict for r in frames.classify(frames.sample(df)).orderBy("event_id").collect()]
    assert got == ["OK", "SHORT_HEADER", "BAD_MAGIC", "BAD_HEADER", "SHORT_PAYLOAD", "TRAILING_BYTES", "BAD_RESERVED", "UNSUPPORTED_VERSION", "UNKNOWN_OPCODE", "TOO_LARGE", "BAD_PAYLOAD", "OK", "OK"]
