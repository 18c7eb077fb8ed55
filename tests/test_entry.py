import duckdb
import pytest

from netloom import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def plain(rows, names):
    def cell(x):
        if x is None or x != x:
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(str(tuple(cell(r[k]) for k in order)) for r in rows)


@pytest.mark.parametrize("name", ["flagship", "flt_bool_nesting", "flt_ip_ne_missing", "conversations", "rpt_flows", "rpt_ips", "hist_rescaling", "proto_key_name", "dissect_fields", "flow_seq_residual", "fn_slug", "gse_walk", "capture_read", "query_counts_tree", "rpt_conversations"])
def test_against_sql(spark, sf, db, name):
    got = core.QUERIES[name](spark, sf)
    want = db.sql(core.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


def test_every_sql_has_a_query():
    assert set(core.SQL) <= set(core.QUERIES) and len(core.SQL) > 100


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
