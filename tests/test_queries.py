"""Registered vessel queries against their SQL at the smallest scale."""

import glob
import os

import duckdb
import pytest

from wakeline.jobs.queries import QUERIES, SQL


def normal(v):
    return repr(round(v, 6)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    result = con.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(normal(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)) for r in result.fetchall())
    assert sorted(tuple(normal(r[c]) for c in sorted(columns)) for r in df.collect()) == want


def test_port_position_where_ports_share_a_code(spark, sf_dir, tmp_path):
    """City codes repeat after 26 ** 3 ports: each port of the code counts, as in the SQL."""
    for name in ("events", "nation"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"copy (select s.* replace (s_suppkey + i * 17576 as s_suppkey) from '{sf_dir}/supplier.parquet' s, range(3) r(i)) to '{tmp_path}/supplier.parquet' (format parquet)")
    for name in ("events", "nation", "supplier"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    want = con.execute(SQL["port_position"]).fetchall()
    got = QUERIES["port_position"](spark, str(tmp_path)).select("request_id", "destination", "dest_latitude", "dest_longitude").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert len(want) == 3 * len({r[0] for r in want})


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
