"""Formatted numbers round the exact binary value half even, as the reference's Python and Rust do."""

import duckdb
import pytest
from pyspark.sql import functions as F

from netloom import queries as core
from netloom.functions import scalars as S


def duration(s):
    return f"{s * 1000:.0f} ms" if s < 1 else f"{s:.1f} s" if s < 120 else f"{s / 60:.1f} min" if s < 7200 else f"{s / 3600:.1f} h" if s < 172800 else f"{s / 86400:.1f} d"


def scaled(n, units):
    out = f"{n} B"
    for k, (unit, d) in enumerate(units, 1):
        out = f"{n / 1000**k:.{d}f} {unit}" if n >= 1000**k else out
    return out


def test_ties(spark):
    seconds = [*map(float, range(0, 200_000, 3)), *(k / 20 for k in range(-40, 2600)), 0.0005, 0.0015, 0.0025, 1e9 + 43200]
    got = spark.createDataFrame([(x,) for x in seconds], "s double").select("s", S.fmt_duration(F.col("s")).alias("t")).collect()
    assert [(r.s, r.t) for r in got if r.t != duration(r.s)] == []
    sizes = [*range(0, 30_000, 50), *(k * 50_000 for k in range(3000)), *(k * 5_000_000 for k in range(3000)), *(k * 50_000_000_000 for k in range(3000)), (1 << 63) - 1]
    got = spark.createDataFrame([(x,) for x in sizes], "n long").select("n", S.fmt_bytes(F.col("n")).alias("t"), S.fmt_archive_bytes(F.col("n")).alias("u")).collect()
    assert [(r.n, r.t) for r in got if r.t != scaled(r.n, [("KB", 1), ("MB", 1), ("GB", 1), ("TB", 1)])] == []
    assert [(r.n, r.u) for r in got if r.u != scaled(r.n, [("KB", 1), ("MB", 1), ("GB", 2)])] == []


@pytest.mark.parametrize("name", ["fn_duration", "fn_fmt_bytes"])
def test_every_row_against_sql(spark, name):
    sf = "/root/testdata/sf0.1"
    db = duckdb.connect()
    db.sql(f"create view events as select * from read_parquet('{sf}/events.parquet')")
    want = dict(db.sql(core.SQL[name]).fetchall())
    got = {r.packet_no: r.v for r in core.QUERIES[name](spark, sf).collect()}
    assert got == want
    assert len(got) == db.sql("select count(*) from events").fetchall()[0][0]


def test_sizes_beyond_64_bits(spark, tmp_path):
    """Ids as in 60 copies of sf0.1 with shifted keys: the SQL as it stands, over wider packet numbers."""
    ids = [0, 9, 10, 99, 100, 9_999, 10_000, 2_097_151, 2_097_152, 2_700_003, 5_999_999, *range(1_999_000, 6_000_000, 4_001)]
    duckdb.sql("SELECT unnest($1)::BIGINT AS event_id, TIMESTAMP '2024-01-01' AS ts, 1::BIGINT AS user_id, 'x' AS event_type, 1.0::DOUBLE AS value, '' AS props", params=[ids]).write_parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.sql(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    sql = core.SQL["fn_fmt_bytes"].replace("CAST(event_id AS BIGINT) AS packet_no", "CAST(event_id AS HUGEINT) AS packet_no")
    got = {r.packet_no: r.v for r in core.QUERIES["fn_fmt_bytes"](spark, str(tmp_path)).collect()}
    assert got == dict(db.sql(sql).fetchall())
    assert len(got) == len(set(ids)) and got[5_999_999] == "215999892.0 TB"
