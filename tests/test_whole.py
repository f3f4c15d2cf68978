"""Queries over whole tables: each against its SQL, and with a result for every row."""

import duckdb
import pytest

from strandlog.plans import registry


def check(spark, sf, name):
    """The query's rows, which are those of its SQL."""
    con = duckdb.connect()
    for t in ("events", "nation", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    want = con.sql(registry.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    rows = df.select(*cols).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(want.select(*(f'"{c}"' for c in cols)).fetchall(), key=str)
    return rows


def size(spark, sf, table):
    return spark.read.parquet(f"{sf}/{table}.parquet").count()


@pytest.mark.parametrize("name", ["verify_checksums", "segment_for_offset", "index_floor_lookup"])
def test_every_record(spark, sf, name):
    assert len(check(spark, sf, name)) == size(spark, sf, "events")


@pytest.mark.parametrize("name", ["bench_trials", "bench_spread", "bench_median_trial", "bench_summary", "stage_breakdown"])
def test_every_customer(spark, sf, name):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    assert {r.scenario for r in check(spark, sf, name)} == {r[0] for r in orders.select("o_custkey").distinct().collect()}


@pytest.mark.parametrize(("name", "table", "more"), [("segment_names", "orders", 1), ("parse_ack_mode", "orders", 0), ("parse_bytes", "orders", 0), ("parse_duration", "orders", 0), ("escape_label", "events", 0)])
def test_every_row_is_parsed(spark, sf, name, table, more):
    # sf0.01 has order keys beyond every prefix that was taken
    sf = sf.replace("sf0.001", "sf0.01")
    assert len(check(spark, sf, name)) == size(spark, sf, table) + more


def test_every_frame(spark, sf):
    assert sum(r.n for r in check(spark, sf, "frame_classify")) == size(spark, sf, "events")


@pytest.mark.parametrize("name", ["assign_range", "assign_round_robin", "describe_groups", "expired_members", "group_generations"])
def test_every_group(spark, sf, name):
    n = size(spark, sf, "events")
    assert len({r.group_id for r in check(spark, sf, name)}) == n // 60 * 4 + min(n % 60, 4)


@pytest.mark.parametrize("name", ["heartbeat_status", "quorum_ack"])
def test_every_request(spark, sf, name):
    assert len(check(spark, sf, name)) == size(spark, sf, "events")


def test_timeouts_of_all_requests(spark, sf):
    assert any(r.req_id % 25 for r in check(spark, sf, "ack_timeouts"))


def test_every_topic(spark, sf):
    assert sum(r.partitions for r in check(spark, sf, "topology_log_end")) == sum(3 + k % 6 for k in range(25)) + 4  # and those of the log itself
    assert any("nation_2" in r.doc for r in check(spark, sf, "topology"))
