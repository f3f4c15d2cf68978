"""A few whole queries against their SQL, on the smallest data."""

import duckdb
import pytest

from strandlog.plans import registry


@pytest.mark.parametrize("name", ["route_summary", "segment_for_offset", "hwm_timeline", "hdr_percentiles", "commit_fencing", "list_offsets_exact", "isr_timeline", "replicate_accept", "poll", "metadata_file"])
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("events", "nation", "orders", "part", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    want = con.sql(registry.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(want.select(*(f'"{c}"' for c in cols)).fetchall(), key=str)
