"""Queries against their SQL on few rows whose keys are those of larger tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from strandlog.functions import scalars as S
from strandlog.plans import registry


def check(spark, folder, name, table, key, values):
    """The query's rows over a table of these keys, which are those of its SQL."""
    spark.createDataFrame([(v,) for v in values], f"{key} long").coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    want = con.sql(registry.ORACLE_SQL[name])
    cols = sorted(df.columns)
    rows = df.select(*cols).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(want.select(*(f'"{c}"' for c in cols)).fetchall(), key=str)
    return {r.id: r for r in rows}


#: Ports about the greatest one and twice that, keys of more digits than an int has, keys below zero.
SUPPLIERS = [-65535, -9001, -9000, -3, -1, 0, 1, 2, 3, 999, 56534, 56535, 56536, 56537, 56538, 59999, 90996, 90999, 91000, 122_069, 122_070, 122_071, 122_072, 999_999, 1_800_000, 2**31 + 1, 10**12 + 1, None]


def test_parse_broker_spec(spark, tmp_path):
    rows = check(spark, tmp_path, "parse_broker_spec", "supplier", "s_suppkey", SUPPLIERS)
    assert len(rows) == len(SUPPLIERS)
    assert (rows[56535].host, rows[56536].host, rows[56536].port, rows[59999].host) == (None, "host-56536", 65536, None)


def test_no_port_above_the_greatest(spark):
    specs = [("1@h:65535",), ("1@h:65536",), ("1@h:99999",), ("1@h:0",)]
    got = spark.createDataFrame(specs, "s string").select(S.parse_broker(F.col("s"))["port"]).collect()
    assert [r[0] for r in got] == [65535, None, None, None]


#: Halves (2560 * 512 is 1.25 MiB), quotients a little below one (20500 * 100 is 2.05M), ends of the units, sizes past a GiB, keys below zero.
PARTS = [-20500, -1, 0, 1, 2, 9, 10, 2047, 2048, 2560, 4608, 9999, 10000, 10500, 11500, 12500, 17500, 20500, 20992, 999_999, 1_200_000, 2_097_151, 2_097_152, 9_999_499, 10_000_000, 11_500_000, 12_500_000, 10**15 + 7, None]


def test_human_sizes(spark, tmp_path):
    rows = check(spark, tmp_path, "human_sizes", "part", "p_partkey", PARTS)
    assert len(rows) == len(PARTS) - 1
    assert (rows[2560].bytes, rows[20500].human, rows[2_097_152].bytes) == ("1.2 MiB", "2.0M", "1024.0 MiB")


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e6])
def test_tenths_as_in_c(spark, scale):
    x = [k / 20 * scale + d for k in range(1, 400) for d in (0.0, 1e-9)] + [k / 40 for k in range(400)]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", F.format_string("%.1f", S.tenths(F.col("x"))).alias("s")).collect()
    assert [r.s for r in got] == [f"{r.x:.1f}" for r in got]


def test_sizes_have_all_units(spark):
    sizes = [1023, 1024, 1280, 2**20, 2**30 + 2**28, 2**41, 2**51]
    got = spark.createDataFrame([(v,) for v in sizes], "n long").select(S.human_bytes(F.col("n"))).collect()
    assert [r[0] for r in got] == ["1023 B", "1.0 KiB", "1.2 KiB", "1.0 MiB", "1.2 GiB", "2.0 TiB", "2048.0 TiB"]
