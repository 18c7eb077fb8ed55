import pytest
from pyspark.sql import functions as F

from netloom.plans.filters import FilterError, compose, needs_bytes, packet_filter, packet_test, parse
from netloom.sources.events import packets

GOOD = ['mac == aa:bb:*', 'ip in {10.0.0.1, 10.1.*, fe80::/10,}', '!(proto == arp) && port in {443, 50-60}', 'data contains "a\\"b"', "data contains aa:bb", "port > 5", "len >= 0x10", "vlan == 5-3", "protocol == icmp6 || proto == 255"]
BAD = ["", "mac < aa:*", "foo == 1", "ip == 1.2.3", "data == 3", 'port contains "x"', "ip in {}", "port == 1 2", "(port == 1", 'data contains "x', "proto == zzz", "proto == 256", "sport < 1-2", "mac == aa:bb", "port == @", "ip == 10.0.0.0/33", "ip < 10.0.0.1", "port ==", "&& port == 1"]


@pytest.mark.parametrize("text", GOOD)
def test_accepts(text):
    assert parse(text)


@pytest.mark.parametrize("text", BAD)
def test_rejects(text):
    with pytest.raises(FilterError):
        parse(text)


def test_negation_is_a_complement(spark, sf):
    p = packets(spark, sf).cache()
    n = p.count()
    for text in ["port == 80", "sport > 100", "vlan != 10", "ethertype != 0x800", "ip == 10.0.0.0/8 || mac == 02:*:*:*:*:07", "sport != 0-1023", "proto == tcp && !(dport == 443)", "port > 5", "ip == 2001:db8::/32"]:
        assert p.where(packet_filter(text)).count() + p.where(packet_filter(f"!({text})")).count() == n, text
        assert p.where(~packet_test(text)).count() == p.where(packet_filter(f"!({text})")).count()


def test_filters_reach_the_scan(spark, sf, tmp_path):
    path = str(tmp_path / "p")
    packets(spark, sf).write.parquet(path)
    plan = spark.read.parquet(path).where(packet_filter("!(sport == 80) && ip_src == 10.0.0.0/24")).select("packet_no")._jdf.queryExecution().executedPlan().toString()
    assert "Or(IsNull(sport),Not(EqualTo(sport,80)))" in plan and "GreaterThanOrEqual(ip4_src,16777" in plan


def test_bytes_and_composition(spark):
    assert needs_bytes(parse('port == 1 || !(data contains "x")')) and not needs_bytes(parse("port == 1"))
    assert compose("len > 5", proto=["tcp"], port=["80", "443"]) == "proto == tcp && port in {80, 443} && (len > 5)"
    rows = spark.createDataFrame([(1, bytearray(b"\xc3\x80GeT /")), (2, bytearray(b"\xe0get"))], "packet_no long, frame binary")
    assert [r.packet_no for r in rows.where(packet_filter('data contains "gEt /"')).collect()] == [1]
    assert [r.packet_no for r in rows.where(packet_filter("data contains e0:67")).collect()] == [2]
    assert rows.where(packet_filter('data contains "à"')).count() == 0
    assert rows.where(packet_filter('data contains ""')).count() == 2
    assert rows.where(F.lit(True)).count() == 2
