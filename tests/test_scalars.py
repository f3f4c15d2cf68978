import pytest
from pyspark.sql import functions as F

from strandlog.functions import scalars as S


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(("data", "crc"), [(bytes(32), 0x8A9136AA), (b"\xff" * 32, 0x62A8AB43), (bytes(range(32)), 0x46DD794E), (bytes(range(31, -1, -1)), 0x113FDB5C), (b"123456789", 0xE3069283), (b"", 0)])
def test_crc32c_vectors(spark, data, crc):
    assert one(spark, S.crc32c(F.lit(bytearray(data))))[0] == crc


def test_crc32c_chains(spark):
    a, b = F.lit(bytearray(b"hello ")), F.lit(bytearray(b"world"))
    got = one(spark, S.crc32c(b, S.crc32c(a)), S.crc32c(F.concat(a, b)))
    assert got[0] == got[1]
    assert one(spark, S.crc32c(F.lit(None).cast("binary")))[0] is None


def test_record_sizes(spark):
    assert one(spark, S.record_size(F.lit("abcd"), F.lit("v" * 100)))[0] == 131
    assert one(spark, S.record_size(F.lit(None).cast("string"), F.lit("")))[0] == 27
    assert one(spark, S.record_size(F.lit(""), F.lit("")))[0] == 27


def test_parsers(spark):
    row = one(spark, S.parse_bytes(F.lit("4 KiB")), S.parse_bytes(F.lit("4q")), S.parse_duration(F.lit("1500us")), S.parse_duration(F.lit("2h")), S.parse_list(F.lit(" a, ,b ")), S.parse_broker(F.lit("1@h:x:9")), S.parse_broker(F.lit("1@h:0")))
    assert (row[0], row[1], row[2], row[3], row[4]) == (4096, None, 1, 7_200_000, ["a", "b"])
    assert (row[5]["host"], row[5]["port"]) == ("h:x", 9)
    assert row[6] is None
    row = one(spark, S.parse_endpoint(F.lit("[::1]:80")), S.env_key(F.lit("APP_LOG__DIR_X"), "APP_"), S.human_bytes(F.lit(2048)), S.parse_bool(F.lit("Yes")))
    assert (row[0]["host"], row[1], row[2], row[3]) == ("::1", "log_dir.x", "2.0 KiB", True)


def test_hdr_slots(spark):
    tops = [r[0] for r in spark.createDataFrame([(v,) for v in (-5, 0, 2047, 2048, 2049, 4096, 10**15)], "v long").select(S.hdr_slot_top(F.col("v"))).collect()]
    assert tops[:6] == [0, 0, 2047, 2049, 2049, 4099]
    assert tops[6] >= 3_600_000_000_000
