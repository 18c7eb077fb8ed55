import io
import json
import random

import pytest
from pyspark.sql import functions as F

from netloom import cli, output
from netloom.functions.dissect import dissect, field_at, field_spans
from netloom.functions.scalars import fmt_addr, fmt_mac
from netloom.operators import aggregates as A
from netloom.operators import inventory as R
from netloom.plans import cache
from netloom.plans.filters import packet_filter
from netloom.sources.pcap import NotACapture, Walk, boundaries, capture_facts, export_pcap, legacy_batches, open_state, read_captures, register, ticks_per_second, ticks_to_nanos
from netloom.streaming.live import append_to_table, live_conversations, live_filter, live_packets, run_bounded
from tests import frames as B


@pytest.fixture(scope="module")
def capture(tmp_path_factory):
    path = tmp_path_factory.mktemp("cap") / "std.pcap"
    path.write_bytes(B.pcap(B.standard()))
    return str(path)


@pytest.fixture(scope="module")
def packets(spark, capture):
    register(spark)
    return dissect(spark.read.format("pcap").load(capture)).cache()


@pytest.mark.parametrize(("text", "n"), [("proto == tcp", 40), ("proto == udp", 25), ("proto == arp", 10), ("proto == icmp", 5), ("proto in {tcp, udp}", 65), ("ip == 10.0.0.1", 70), ("!(proto == arp)", 70), ("ip_dst == 10.0.*.2", 65), ("ip_src == 10.0.0.0/31", 65), ("mac == ff:*", 10), ("port in {443, 50-60}", 65), ('data contains "HELLO"', 40)])
def test_known_counts(packets, text, n):
    assert packets.where(packet_filter(text)).count() == n


def test_numbers_go_on_over_several_files(spark, tmp_path):
    from netloom.operators import flow_model as W

    for k in range(2):
        (tmp_path / f"{k}.pcap").write_bytes(B.pcap(B.standard()))
    register(spark)
    rows = dissect(spark.read.format("pcap").load(str(tmp_path)))
    again = read_captures(spark, str(tmp_path / "*.pcap"))
    for df in (rows, again):
        assert sorted(r.packet_no for r in df.select("packet_no").collect()) == list(range(160))
    assert [r.packets for r in A.row_groups(rows, 80).orderBy("group_no").collect()] == [80, 80]
    assert A.page(rows, 75, 10).count() == 10
    assert W.ts_delta(rows, 80).where("packet_no IN (0, 80)").select("ts_delta").distinct().count() == 1
    assert sorted(r.flow_id for r in W.flow_ids(rows).collect()) == list(range(rows.select(*W.FLOW).distinct().count()))


def test_statistics(packets):
    macs = {r.m: r for r in A.mac_stats(packets).withColumn("m", fmt_mac(F.col("mac"))).collect()}
    assert macs["aa:aa:aa:00:00:01"].packets == 70 and macs["aa:aa:aa:00:00:01"].protos == "icmp tcp udp"
    assert A.totals(packets).first().packets == 80
    assert A.conversations(packets).first().packets == 70
    assert {(r.proto, r.state): r.packets for r in R.flows(packets).collect()} == {("tcp", "syn-no-reply"): 40, ("udp", "one-way"): 25}


@pytest.mark.parametrize("make", [lambda f: B.pcap(f, ">"), lambda f: B.pcap(f, nanos=True), B.pcapng, lambda f: B.pcapng(f, ">", 9), lambda f: B.pcapng(f, simple=True)])
def test_formats_agree(spark, tmp_path, make):
    (tmp_path / "x.cap").write_bytes(make(B.standard()))
    register(spark)
    rows = spark.read.format("pcap").option("records_per_partition", 7).load(str(tmp_path / "x.cap"))
    got = rows.orderBy("packet_no").collect()
    assert [bytes(r.frame) for r in got] == B.standard() and [r.packet_no for r in got] == list(range(80))
    assert read_captures(spark, str(tmp_path)).count() == 80
    assert rows.rdd.getNumPartitions() == 12


def test_damage_and_other_files():
    whole = B.pcap(B.standard())
    f = io.BytesIO(whole[:-30])
    walk = Walk(f, *open_state(f.read(24)))
    assert len(list(walk.records())) == 79 and walk.truncated
    with pytest.raises(NotACapture):
        open_state(b"not a capture at all, sorry")
    assert ticks_per_second(6) == 10**6 and ticks_per_second(0x80 | 10) == 1024 and ticks_to_nanos(5, 0) == 0


def test_splits_are_record_boundaries(tmp_path):
    (tmp_path / "x").write_bytes(B.pcapng(B.standard()))
    parts = list(boundaries(str(tmp_path / "x"), 30))
    assert [p[0] for p in parts] == [0, 30, 60] and all(a[2] == b[1] for a, b in zip(parts, parts[1:], strict=False))


def test_export_round_trip(spark, packets, tmp_path):
    out = str(tmp_path / "out.pcap")
    assert export_pcap(packets.where(packet_filter("proto == udp")).withColumn("ts_nanos", F.col("ts_nanos") + 123), out)[0] == 25
    back = spark.read.format("pcap").load(out).orderBy("packet_no").collect()
    assert len(back) == 25 and all(r.ts_nanos % 1000 == 123 for r in back)
    assert export_pcap(packets.where("false"), str(tmp_path / "none")) == (0, 0, 0) and not (tmp_path / "none").exists()


def frame_rows(spark, frames, linktype=1):
    return spark.createDataFrame([(k, bytearray(f), linktype) for k, f in enumerate(frames)], "packet_no long, frame binary, linktype int")


def test_dissection(spark):
    one, two = bytes.fromhex("20010db8" + "00" * 11 + "01"), bytes.fromhex("fe80" + "00" * 13 + "02")
    inner = B.ip4(B.IP[1], B.IP[2], 6, B.tcp(1, 2, 0x1FF & 0xC2))
    tagged = B.MAC["A"] + B.MAC["B"] + bytes.fromhex("88a80007" + "81002005" + "0800") + inner
    extended = B.eth(B.MAC["A"], B.MAC["B"], 0x86DD, B.ip6(one, two, 0, bytes([17, 0]) + bytes(6) + B.udp(5, 6, b"x")))
    fragment = bytearray(B.eth(B.MAC["A"], B.MAC["B"], 0x800, inner))
    fragment[20:22] = b"\x00\x10"
    got = dissect(frame_rows(spark, [tagged, extended, bytes(fragment), b"", tagged[:20]])).orderBy("packet_no").collect()
    assert (got[0].vlan, got[0].ethertype, got[0].sport, got[0].tcp_flags) == (5, 0x800, 1, 2)
    assert (got[1].ip_proto, got[1].l4_proto, got[1].sport, got[1].dport) == (0, 17, 5, 6)
    assert got[2].ip_proto == 6 and got[2].sport is None
    assert not got[3].has_eth and got[4].ip_version is None
    raw = dissect(frame_rows(spark, [inner], 101)).first()
    assert raw.ethertype == 0x800 and raw.ip4_src == 0x0A000001 and raw.has_eth is False
    assert dissect(frame_rows(spark, [inner], 147)).first().ip4_src is None
    text = dissect(frame_rows(spark, [extended])).select(fmt_addr(F.col("ip4_src"), F.col("ip6_src")).alias("a"), fmt_addr(F.col("ip4_dst"), F.col("ip6_dst")).alias("b")).first()
    assert (text.a, text.b) == ("2001:db8::1", "fe80::2")
    spans = field_spans(frame_rows(spark, [B.standard()[0]])).select("spans", field_at(F.col("spans"), 35).alias("at")).first()
    assert spans["at"] == "src port" and spans.spans[-1].asDict() == {"label": "payload", "start": 54, "end": 59}


def test_random_frames_never_fail(spark):
    rng = random.Random(5)
    made = []
    for f in B.standard() * 3:
        f = bytearray(f[: rng.randint(0, len(f))])
        for _ in range(rng.randint(0, 4)):
            if f:
                f[rng.randrange(len(f))] = rng.randrange(256)
        made.append(bytes(f))
    for link in (1, 0, 101, 108, 113):
        assert dissect(frame_rows(spark, made, link)).where("sport >= 0 OR sport IS NULL").count() == len(made)
        assert field_spans(frame_rows(spark, made, link)).count() == len(made)


def test_cache_is_used_and_dropped(spark, capture, tmp_path):
    own = tmp_path / "c.pcap"
    own.write_bytes(open(capture, "rb").read())
    m = cache.build(spark, str(own), str(tmp_path / "cache"))
    assert m["packets"] == 80 and cache.load(spark, str(own), str(tmp_path / "cache")).count() == 80
    own.write_bytes(B.pcap(B.standard() * 2))
    assert cache.load(spark, str(own), str(tmp_path / "cache")) is None
    assert cache.open_packets(spark, str(own), str(tmp_path / "cache")).count() == 160


def test_commands(spark, capture, packets, tmp_path, capsys):
    assert cli.main(["query", capture, "--proto", "udp", "--limit", "3", "--json"], spark) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert len(lines) == 3 and set(lines[0]) == {"ts_nanos", "offset", "caplen", "len", "mac_src", "mac_dst", "ip_src", "ip_dst", "proto", "sport", "dport", "vlan"}
    cli.main(["stats", capture, "--json"], spark)
    s = json.loads(capsys.readouterr().out)
    assert s["unique_macs"] == 4 and s["protocols"][0]["proto"] == "tcp" and sum(s["histogram"]["counts"]) == 80
    assert "packets 80" in output.stats_text(s)
    assert (s["file"], s["file_bytes"], s["truncated"], s["row_groups"]) == (capture, len(B.pcap(B.standard())), False, 1) and s["build_millis"] > 0
    for k, make in enumerate((B.pcap, B.pcapng)):
        cut = tmp_path / f"cut{k}.cap"
        cut.write_bytes(make(B.standard())[:-30])
        rows = spark.read.format("pcap").load(str(cut))
        assert capture_facts(rows, str(cut))["truncated"] and rows.count() == 79
    cli.main(["export", capture, "proto == icmp", "--out", str(tmp_path / "o.pcap")], spark)
    assert capsys.readouterr().out.startswith("5 packets")
    cli.main(["hist", capture, "--series", "web=port == 443"], spark)
    assert "web_frames" in capsys.readouterr().out
    assert output.write_report(packets, str(tmp_path / "r"))["tables"]["flows"] == 2
    assert cli.suggest("ip == 10", {"ip": ["10.0.0.1", "192.168.0.1"]}) == ["10.0.0.1"] and "port" in cli.suggest("po", {})


def test_live(spark, tmp_path):
    folder = tmp_path / "spool"
    folder.mkdir()
    (folder / "live.pcap").write_bytes(B.pcap(B.standard()))
    p = live_packets(spark, str(folder))
    run_bounded(live_filter(p, "proto == tcp").select("packet_no"), "live_tcp")
    assert spark.table("live_tcp").count() == 40
    run_bounded(live_conversations(p), "live_convs", "complete")
    assert spark.table("live_convs").first().packets == 70


def test_live_table_goes_on_where_it_stopped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    whole, file = B.pcap(B.standard()), tmp_path / "in" / "x.pcap"
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    for part in (whole[:2000], whole[: len(whole) - 900], whole):  # cut within records
        file.write_bytes(part)
        query = append_to_table(spark, str(tmp_path / "in"), table, checkpoint, max_bytes=700, interval="0 seconds")
        for _ in range(3):  # max_bytes bounds a batch, so one look may not see all
            query.processAllAvailable()
        query.stop()
    assert sorted(r.packet_no for r in spark.read.parquet(table).collect()) == list(range(80))


def test_groups_without_a_match_are_ruled_out(packets):
    for text in ("dport == 443", "proto == arp", "ip == 10.0.0.3", "ip == 10.*.0.2", "mac == ff:*", "len > 60", "len < 1", "port > 5", "!(proto == tcp)", 'data contains "HELLO"', "sport != 5 && vlan == 3", "ip == 2001:db8::/32", "port in {443, 50-60} || ethertype == 0x806"):
        counts = A.query_counts(packets, text, 8).first()
        holding = packets.where(packet_filter(text)).select(A.group_no(8)).distinct().count()
        assert counts.matched == packets.where(packet_filter(text)).count() and counts.groups_total == 10
        assert holding <= counts.groups_scanned <= 10
    assert A.query_counts(packets, "len < 1", 8).first().groups_scanned == A.query_counts(packets, "ip == 2001:db8::/32", 8).first().groups_scanned == 0
    assert A.query_counts(packets, "proto == arp", 8).first().groups_scanned < 10


def test_damaged_chunks_and_boundaries(tmp_path):
    whole = B.pcap(B.standard())
    for cut in (len(whole), len(whole) - 30, 30, 24):
        (tmp_path / "x").write_bytes(whole[:cut])
        with open(tmp_path / "x", "rb") as f:
            state, at = open_state(f.read(24))
            walked = list(Walk(f, state, at).records())
            found = [b for rows in legacy_batches("x", f, state, at, None, 0) for b in rows.to_pylist()]
        assert [(r["record_offset"], r["ts_nanos"], r["frame"]) for r in found] == [(w[0], w[2], w[6]) for w in walked]
        assert [(p[0], p[1]) for p in boundaries(str(tmp_path / "x"), 9)] == [(k, walked[k][0]) for k in range(0, len(walked), 9)] or not walked


def test_address_texts(spark):
    import ipaddress

    rng = random.Random(3)
    every = [bytes(rng.choice([0, 0, 0, 1, 16, 255]) for _ in range(16)) for _ in range(500)] + [bytes(16), b"\xff" * 16]
    got = spark.createDataFrame([(bytearray(x),) for x in every], "a binary").select("a", fmt_addr(F.lit(None).cast("long"), F.col("a")).alias("t")).collect()
    assert all(r.t == ipaddress.IPv6Address(bytes(r.a)).compressed for r in got)
