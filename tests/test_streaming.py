from pyspark.sql import functions as F

from strandlog.sources import segments
from strandlog.streaming import append, groups
from tests.test_log import events


def test_group_stream_equals_replay(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    df = spark.createDataFrame(*events(spark))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = groups.stream(stream).writeStream.format("memory").queryName("grp").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("grp").collect()) == sorted(groups.replay(df).collect())


def test_append_stream_gives_dense_offsets(spark, tmp_path):
    rows = spark.range(100).select(F.lit("t").alias("topic"), F.col("id").alias("seq"), F.floor(F.col("id") / 10).alias("batch_id"), F.when(F.col("id") % 3 > 0, (F.col("id") % 7).cast("string")).alias("key"), F.lit("v").alias("value"), F.col("id").alias("timestamp_ms"))
    for k in range(2):
        rows.filter(F.col("seq") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = append.append_stream(stream, str(tmp_path / "log"), 4, str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "log" / "data"))
    assert out.count() == 100
    per = out.groupBy("partition").agg(F.count("*").alias("n"), F.max("offset").alias("top"), F.countDistinct("offset").alias("d")).collect()
    assert all(r.n == r.d == r.top + 1 for r in per)
    assert out.select("micro_batch").distinct().count() == 2


def test_segment_source_stops_at_damage(spark, tmp_path):
    spark.dataSource.register(segments.SegmentSource)
    folder = f"file://{tmp_path}/log"
    rows = [(1000 + k, 0, None if k % 4 == 0 else b"" if k % 4 == 1 else b"key", b"v" * (200 * k)) for k in range(10)]
    segments.write_segment(folder, 0, rows)
    path = segments.write_segment(folder, 10, rows)
    data = bytearray(open(path, "rb").read())
    data[-1] ^= 1
    open(path, "wb").write(bytes(data))
    got = spark.read.format("strand_segments").option("path", folder).load()
    assert sorted(r.offset for r in got.collect()) == list(range(19))
    assert got.filter("offset = 4").first().key is None
    assert bytes(got.filter("offset = 5").first().key) == b""
    assert spark.read.format("strand_segments").option("path", folder).option("start", 12).load().count() == 7
    assert spark.read.format("strand_segments").option("path", folder).option("maxBytes", 300).load().filter("segment_base = 0").count() == 2
    with open(path, "rb") as f:
        got = segments.walk(f, len(data), 10)
    assert (got["records"], got["next_offset"], got["reason"]) == (9, 19, "CORRUPT")
    assert got["valid_bytes"] + got["cut_bytes"] == len(data)
    space = segments.write_segment(f"file://{tmp_path}/space", 0, rows, reserve=500)
    with open(space, "rb") as f:
        got = segments.walk(f, f.seek(0, 2), 0)
    assert (got["records"], got["reserved_bytes"], got["cut_bytes"], got["reason"]) == (10, 500, 0, "EMPTY")
    with open(space, "rb") as f:
        assert [r[1] for r in segments.records(f, f.seek(0, 2), 0, 0, part_bytes=64) if len(r) > 2] == list(range(10))
