"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import math
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def canonical(df):
    def c(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return f"{float(v):.6g}"
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(c(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


CORE = {k for k in entry.queries() if not any(k in m.QUERIES for m in [entry.llm_queries] if m)}


@pytest.mark.parametrize("name", sorted(CORE & set(entry.oracle_sql())))
def test_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(CORE - set(entry.oracle_sql())))
def test_runs_over_whole_tables(spark, duck, name):
    """What SQL can't say gives rows, as many for each input row as its operator promises where that is one."""
    df = entry.queries()[name](spark, SF)
    n = df.count()
    one_each = {"p2_normalised": "message_rows", "redact_messages": "message_rows WHERE msg_content IS NOT NULL AND msg_uuid IS NOT NULL"}
    assert n > 0 and len(df.columns) == len(set(df.columns))
    if name in one_each:
        assert n == duck.execute(f"SELECT count(*) FROM {one_each[name]}").fetchone()[0]


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns
    want = {"p1_found": "line_id bigint, block_path string", "p2_found": "row_id bigint, utc_micros bigint", "p4_found": "msg_uuid string, root_uuid string, node_depth bigint", "p5_found": "row_id bigint", "p6_found": "stream_id string, file_no int, old_path string, new_path string"}
    for name, cols in want.items():
        assert ", ".join(f"{c} {t}" for c, t in entry.queries()[name](spark, SF).dtypes) == cols
