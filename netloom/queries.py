"""The engine's queries over the driver's tables, each with the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import dissect as D
from netloom.functions import names as N
from netloom.functions import scalars as S
from netloom.functions.fields import candidates_of
from netloom.functions.kaitai import kaitai_decode
from netloom.operators import aggregates as A
from netloom.operators import flow_model as W
from netloom.operators import histograms as H
from netloom.operators import inventory as R
from netloom.plans.filters import packet_filter, table_search
from netloom.sources.bbframe import find_ipv4, gse_packets, parse_lines, validation_report
from netloom.sources.events import PACKETS_SQL, documents_as_payload, packets, packets_of
from netloom.sources.pcap import register, shared_folder, write_part
from netloom.streaming.live import live_conversations, live_filter, live_protocols, run_bounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TIME_STEP = 6 * 3600 * 1_000_000_000


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{n}`").cast("long").alias(n) if t in ("int", "smallint", "tinyint") else F.col(f"`{n}`") for n, t in df.dtypes))


def query(name: str, sql: str | None = None, source=packets):
    def register(make: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: _plain(make(source(spark, sf_dir)))
        if sql:
            SQL[name] = f"WITH {PACKETS_SQL}{sql}" if sql.lstrip().startswith(",") else f"WITH {PACKETS_SQL} {sql}"
        return make

    return register


# ---- filters --------------------------------------------------------------------------------------------------------

V6_NET = "(v6_src IS NOT NULL)"
FILTERS = {
    "mac_any": ("mac == 02:00:00:00:00:07", "mac_src = 2199023255559 OR mac_dst = 2199023255559"),
    "mac_src": ("mac_src == 02:00:00:00:00:07", "mac_src = 2199023255559"),
    "mac_mask": ("mac == 02:*:*:*:*:07", "mac_src % 256 = 7 OR mac_dst % 256 = 7 AND mac_dst < 281474976710655"),
    "mac_prefix": ("mac == ff:ff:*", "mac_dst = 281474976710655"),
    "mac_ne_missing": ("mac != ff:ff:ff:ff:ff:ff", "mac_dst <> 281474976710655"),
    "ip_any": ("ip == 192.168.0.21", "ip4_src = 3232235541 OR ip4_dst = 3232235541"),
    "ip_src": ("ip_src == 192.168.0.21", "ip4_src = 3232235541"),
    "ip_cidr": ("ip_dst == 10.0.0.0/26", "ip4_dst BETWEEN 167772160 AND 167772223"),
    "ip_wildcard": ("src == 192.168.*.21", "ip4_src = 3232235541"),
    "ip_ne_missing": ("ip != 10.0.0.0/8", "NOT coalesce(ip4_src BETWEEN 167772160 AND 184549375 OR ip4_dst BETWEEN 167772160 AND 184549375, false) AND NOT coalesce(ip4_src BETWEEN 167772160 AND 184549375, false) AND NOT coalesce(ip4_dst BETWEEN 167772160 AND 184549375, false)"),
    "ip6_cidr": ("ip == 2001:db8:0:4::/63", "v6_src IN (4, 5) OR v6_dst IN (4, 5)"),
    "ip6_exact": ("ip_src == 2001:db8:0:7::7", "v6_src = 7"),
    "proto_ip": ("proto == udp", "ip_proto = 17"),
    "proto_ether": ("proto == arp", "ethertype = 2054"),
    "port_any": ("port == 53", "sport = 53 OR dport = 53"),
    "port_range": ("port == 5905-5900", "sport BETWEEN 5900 AND 5905 OR dport BETWEEN 5900 AND 5905"),
    "port_order_is_empty": ("port > 5", "false"),
    "port_u16_wrap": ("port == 65616", "sport = 80 OR dport = 80"),
    "sport_cmp": ("sport >= 5000", "sport >= 5000"),
    "sport_ne_missing": ("sport != 80", "sport IS NOT NULL AND sport <> 80"),
    "sport_range_ne_missing": ("sport != 0-1023", "sport IS NULL OR sport > 1023"),
    "ethertype": ("ethertype != 0x800", "ethertype <> 0 AND ethertype <> 2048"),
    "vlan": ("vlan < 12", "vlan < 12"),
    "vlan_range": ("vlan != 10-11", "vlan IS NULL OR vlan > 11"),
    "len": ("len > 100", "origlen > 100"),
    "len_range": ("len == 100-200", "origlen BETWEEN 100 AND 200"),
    "in_mixed": ("port in {53, 5900-5902, 0x50,}", "sport IN (53, 80) OR dport IN (53, 80) OR sport BETWEEN 5900 AND 5902 OR dport BETWEEN 5900 AND 5902"),
    "bool_nesting": ("!(proto == tcp && !(dport == 443)) || vlan == 10", "NOT coalesce(ip_proto = 6 AND NOT coalesce(dport = 443, false), false) OR vlan = 10"),
    "not_port": ("!(port == 80)", "NOT (coalesce(sport = 80, false) OR coalesce(dport = 80, false))"),
    "flag_composition": ("proto in {tcp, udp} && dport == 443 && (len > 90)", "ip_proto IN (6, 17) AND dport = 443 AND origlen > 90"),
}
for _name, (_text, _where) in FILTERS.items():
    query(f"flt_{_name}", f"SELECT packet_no FROM packets WHERE {_where}")(lambda p, text=_text: p.where(packet_filter(text)).select("packet_no"))
query("flt_data_text", "SELECT doc_id AS packet_no FROM documents WHERE contains(lower(text), 'tion of')", documents_as_payload)(lambda p: p.where(packet_filter('data contains "TION of"')).select("packet_no"))
query("flt_data_hex", "SELECT doc_id AS packet_no FROM documents WHERE contains(text, 'the')", documents_as_payload)(lambda p: p.where(packet_filter("data contains 74:68:65")).select("packet_no"))

# ---- dissection -----------------------------------------------------------------------------------------------------


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets as bytes alone: what a capture file would give."""
    made = D.ethernet_frame(packets(spark, sf_dir).withColumn("ethertype", F.when(F.col("ethertype") == 0, 2048).otherwise(F.col("ethertype"))), F.lit("hello").cast("binary"))
    return made.select("packet_no", "ts_nanos", "origlen", "linktype", "frame")


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from capture files: written in order, a file a partition, then read back and dissected."""
    folder = f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}"
    rows = framed(spark, sf_dir).repartitionByRange(4, "packet_no").sortWithinPartitions("packet_no")
    rows.select("ts_nanos", "origlen", "linktype", "frame").foreachPartition(partial(write_part, folder))
    register(spark)
    return spark.read.format("pcap").option("dissect", "true").load(folder)


@query("dissect_fields", """SELECT packet_no, mac_src, mac_dst, vlan, CASE WHEN ethertype = 0 THEN 2048 ELSE ethertype END AS ethertype, ip4_src, ip4_dst, ip_proto, sport, dport, tcp_flags
    FROM (SELECT * REPLACE (CASE WHEN ip4_src IS NULL AND v6_src IS NULL THEN NULL ELSE ip_proto END AS ip_proto) FROM packets)""", framed)
def _(p):
    return D.dissect(p).select("packet_no", "mac_src", "mac_dst", "vlan", "ethertype", "ip4_src", "ip4_dst", "ip_proto", "sport", "dport", "tcp_flags")


@query("vlan_inner", "SELECT vlan, count(*) AS packets FROM packets WHERE vlan IS NOT NULL GROUP BY vlan", framed)
def _(p):
    return D.dissect(p).where("vlan IS NOT NULL").groupBy("vlan").agg(F.count("*").alias("packets"))


query("capture_read", """, n AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS k FROM e)
    SELECT n.k AS packet_no, ts_nanos, mac_src, mac_dst, vlan, CASE WHEN ethertype = 0 THEN 2048 ELSE ethertype END AS ethertype, ip4_src, ip4_dst, CASE WHEN ip4_src IS NULL AND v6_src IS NULL THEN NULL ELSE ip_proto END AS ip_proto, sport, dport, tcp_flags
    FROM packets JOIN n ON n.event_id = packets.packet_no""", captured)(lambda p: p.select("packet_no", "ts_nanos", "mac_src", "mac_dst", "vlan", "ethertype", "ip4_src", "ip4_dst", "ip_proto", "sport", "dport", "tcp_flags"))


@query("field_spans_long", """, h AS (SELECT packet_no, CASE WHEN vlan IS NULL THEN 14 ELSE 18 END AS l3, ip4_src, v6_src, ip_proto, sport, vlan FROM packets),
    t AS (SELECT *, l3 + CASE WHEN ip4_src IS NOT NULL THEN 20 ELSE 40 END AS l4 FROM h WHERE sport IS NOT NULL)
    SELECT packet_no, 'eth dst' AS label, CAST(0 AS BIGINT) AS "start", CAST(6 AS BIGINT) AS "end" FROM h
    UNION ALL SELECT packet_no, 'vlan', 14, 16 FROM h WHERE vlan IS NOT NULL
    UNION ALL SELECT packet_no, 'src port', l4, l4 + 2 FROM t UNION ALL SELECT packet_no, 'tcp flags', l4 + 13, l4 + 14 FROM t WHERE ip_proto = 6""", framed)
def _(p):
    spans = D.field_spans(p).select("packet_no", F.explode_outer("spans").alias("s")).select("packet_no", "s.*")
    return spans.where("label IN ('eth dst', 'vlan', 'src port', 'tcp flags')")


@query("hexdump", """, d AS (SELECT doc_id AS packet_no, text, octet_length(encode(text)) AS n, hex(encode(text)) AS h FROM documents),
    l AS (SELECT packet_no, h, unnest(range(0, n, 16)) AS pos FROM d)
    SELECT packet_no, lpad(printf('%x', pos), 6, '0') AS "offset", rtrim(regexp_replace(lower(substr(h, CAST(pos * 2 + 1 AS INT), 32)), '(..)', '\\1 ', 'g')) AS hex FROM l""", documents_as_payload)
def _(p):
    return D.hexdump(p).select("packet_no", "offset", "hex")


@query("byte_grid", ", d AS (SELECT regexp_extract_all(hex(encode(text)), '..') AS l FROM documents), b AS (SELECT unnest(l) AS x, generate_subscripts(l, 1) - 1 AS pos FROM d) SELECT CAST(pos AS BIGINT) AS pos, count(*) AS packets, count(DISTINCT x) AS n_values FROM b GROUP BY pos", documents_as_payload)
def _(p):
    return D.constant_bytes(D.byte_grid(p)).select("pos", "packets", "n_values")


_KEYWORDS = ", ".join(f"({n}, '{k}')" for n, k in N.IP_PROTOCOLS.items())
_ETHER = ", ".join(f"({n}, '{k}')" for n, k in N.ETHERTYPES.items())
_SERVICES = ", ".join(f"({n}, '{k}')" for n, k in N.SERVICES.items())
PROTO_SQL = f""", kw(n, keyword) AS (VALUES {_KEYWORDS}), et(n, name) AS (VALUES {_ETHER}), named AS (
    SELECT p.*, CASE WHEN ip_proto IS NOT NULL THEN 0 WHEN ethertype <> 0 THEN 1 ELSE 2 END AS proto_kind,
        coalesce(ip_proto, nullif(ethertype, 0), 0) AS proto_number,
        CASE WHEN ip_proto IS NOT NULL THEN coalesce(kw.keyword, 'ipproto-' || ip_proto) WHEN ethertype <> 0 THEN coalesce(et.name, 'ether-0x' || lpad(printf('%x', ethertype), 4, '0')) ELSE 'other' END AS proto
    FROM packets p LEFT JOIN kw ON kw.n = ip_proto LEFT JOIN et ON et.n = ethertype)"""
_NAMED = "packet_no, proto"


@query("proto_key_name", PROTO_SQL + " SELECT packet_no, CAST(proto_kind AS BIGINT) AS proto_kind, CAST(proto_number AS BIGINT) AS proto_number, proto FROM named")
def _(p):
    return A.with_proto(p).select("packet_no", "proto_kind", "proto_number", "proto")


# ---- core aggregates ------------------------------------------------------------------------------------------------

query("totals", "SELECT count(*) AS packets, CAST(sum(origlen) AS BIGINT) AS bytes, min(nullif(ts_nanos, 0)) AS first_ts, max(nullif(ts_nanos, 0)) AS last_ts FROM packets")(A.totals)
query("proto_mix", PROTO_SQL + " SELECT CAST(proto_kind AS BIGINT) AS proto_kind, CAST(proto_number AS BIGINT) AS proto_number, proto, count(*) AS packets, CAST(sum(origlen) AS BIGINT) AS bytes FROM named GROUP BY 1, 2, 3")(A.protocol_mix)
query("port_totals_double_count", ", x AS (SELECT sport AS port FROM packets UNION ALL SELECT dport FROM packets) SELECT port, count(*) AS packets FROM x WHERE port IS NOT NULL GROUP BY port")(A.port_totals)
_MAC_SQL = PROTO_SQL + ", r AS (SELECT mac_src AS mac, * FROM named UNION ALL SELECT mac_dst, * FROM named)"
_PROTOS_SQL = "(SELECT string_agg(proto, ' ' ORDER BY proto_kind, proto_number) FROM (SELECT DISTINCT proto, proto_kind, proto_number FROM {0} x WHERE {1}))"
query("mac_stats", _MAC_SQL + ", g AS (SELECT mac, count(*) AS packets, CAST(sum(origlen) AS BIGINT) AS bytes, arg_min(ts_nanos, packet_no) AS first_seen_in_order, max(ts_nanos) AS last_ts FROM r GROUP BY mac), ps AS (SELECT mac, string_agg(proto, ' ' ORDER BY proto_kind, proto_number) AS protos FROM (SELECT DISTINCT mac, proto, proto_kind, proto_number FROM r) GROUP BY mac) SELECT g.*, protos FROM g JOIN ps USING (mac)")(A.mac_stats)
query("mac_pairs", "SELECT mac_src, mac_dst, count(*) AS packets, CAST(sum(origlen) AS BIGINT) AS bytes FROM packets GROUP BY 1, 2")(A.mac_pairs)
query("port_pairs", "SELECT sport, dport, count(*) AS packets, CAST(sum(origlen) AS BIGINT) AS bytes FROM packets WHERE sport IS NOT NULL GROUP BY 1, 2")(A.port_pairs)
_KEY = "CASE WHEN ip4_{0} IS NOT NULL THEN '4' || upper(lpad(printf('%x', ip4_{0}), 8, '0')) WHEN v6_{0} IS NOT NULL THEN '620010DB80000' || upper(lpad(printf('%x', v6_{0}), 4, '0')) || '000000000000' || upper(lpad(printf('%x', v6_{0}), 4, '0')) END"
CONV_SQL = PROTO_SQL + f""", k AS (SELECT *, {_KEY.format('src')} AS s, {_KEY.format('dst')} AS d FROM named), c AS (SELECT *, least(s, d) AS a, greatest(s, d) AS b FROM k WHERE s IS NOT NULL),
    g AS (SELECT a, b, count(*) AS packets, CAST(sum(origlen) AS BIGINT) AS bytes, arg_min(ts_nanos, packet_no) AS first_seen_in_order, max(ts_nanos) AS last_ts FROM c WHERE TRUE GROUP BY a, b),
    ps AS (SELECT a, b, string_agg(proto, ' ' ORDER BY proto_kind, proto_number) AS protos FROM (SELECT DISTINCT a, b, proto, proto_kind, proto_number FROM c WHERE TRUE) GROUP BY a, b),
    po AS (SELECT a, b, count(DISTINCT port) AS n_ports FROM (SELECT a, b, sport AS port FROM c WHERE TRUE UNION ALL SELECT a, b, dport FROM c WHERE TRUE) GROUP BY a, b)
    SELECT g.*, protos, n_ports, n_ports > 256 AS ports_overflow, greatest(last_ts - first_seen_in_order, 0) / 1e9 AS span_s FROM g JOIN ps USING (a, b) JOIN po USING (a, b)"""
query("conversations", CONV_SQL)(A.conversations)
query("conversations_filtered", CONV_SQL.replace("WHERE TRUE", "WHERE ip_proto = 6 AND NOT coalesce(sport BETWEEN 5900 AND 5910, false) AND NOT coalesce(dport BETWEEN 5900 AND 5910, false) AND (ip4_src BETWEEN 167772160 AND 184549375 OR ip4_dst BETWEEN 167772160 AND 184549375)"))(lambda p: A.conversations(p.where(packet_filter("ip == 10.0.0.0/8 && !(port == 5900-5910) && proto == tcp"))))
query("directional_macs", ", t AS (SELECT mac_src AS mac, origlen, 1 AS tx FROM packets UNION ALL SELECT mac_dst, origlen, 0 FROM packets) SELECT mac, count(*) AS packets, CAST(sum(origlen) AS BIGINT) AS bytes, CAST(sum(tx) AS BIGINT) AS sent, CAST(sum(1 - tx) AS BIGINT) AS received FROM t GROUP BY mac")(A.directional_macs)
query("packets_per_ip", f", k AS (SELECT {_KEY.format('src')} AS ip FROM packets UNION ALL SELECT {_KEY.format('dst')} FROM packets) SELECT ip, count(*) AS packets FROM k WHERE ip IS NOT NULL GROUP BY ip")(A.packets_per_ip)
query("row_groups", ", g AS (SELECT packet_no // 1024 AS group_no, * FROM packets) SELECT group_no, count(*) AS packets, CAST(sum(origlen) AS BIGINT) AS bytes, min(ts_nanos) AS min_ts, max(ts_nanos) AS max_ts, (SELECT string_agg(CAST(x.ip_proto AS VARCHAR), ' ' ORDER BY x.ip_proto) FROM (SELECT DISTINCT g2.group_no, g2.ip_proto FROM g g2) x WHERE x.group_no = g.group_no) AS ip_protos, min(sport) AS min_sport, max(dport) AS max_dport FROM g GROUP BY group_no")(lambda p: A.row_groups(p, 1024))
query("shares", PROTO_SQL + " SELECT proto, count(*) AS packets, round(count(*) * 100.0 / greatest(sum(count(*)) OVER (), 1), 4) AS share FROM named GROUP BY proto_kind, proto_number, proto")(A.shares)
query("distinct_macs", ", m AS (SELECT mac_src AS mac FROM packets UNION SELECT mac_dst FROM packets) SELECT count(*) AS macs FROM m")(A.distinct_macs)
query("match_count", "SELECT count(*) AS n FROM packets WHERE ip_proto = 6 AND (sport = 443 OR dport = 443)")(lambda p: p.where(packet_filter("proto == tcp && port == 443")).agg(F.count("*").alias("n")))
query("query_counts", ", g AS (SELECT packet_no // 1024 AS k, max(dport) AS d FROM packets GROUP BY 1) SELECT (SELECT count(*) FROM packets WHERE dport > 61000) AS matched, count(*) AS groups_total, count(*) FILTER (d > 61000) AS groups_scanned FROM g")(lambda p: A.query_counts(p, "dport > 61000", 1024))
_PRUNE_SQL = ", g AS (SELECT packet_no // 64 AS k, min(dport) AS dl, max(dport) AS dh, min(sport) AS sl, max(sport) AS sh, min(vlan) AS vl, max(vlan) AS vh, min(ip4_src) AS il, max(ip4_src) AS ih FROM packets GROUP BY 1) SELECT (SELECT count(*) FROM packets WHERE {0}) AS matched, count(*) AS groups_total, count(*) FILTER ({1}) AS groups_scanned FROM g"
query("query_counts_tree", _PRUNE_SQL.format("(sport BETWEEN 64000 AND 65000 OR dport BETWEEN 64000 AND 65000) AND vlan < 11 OR ip4_src BETWEEN 167772160 AND 167772167", "(coalesce(sl <= 65000 AND sh >= 64000, false) OR coalesce(dl <= 65000 AND dh >= 64000, false)) AND coalesce(vl < 11, false) OR coalesce(il <= 167772167 AND ih >= 167772160, false)"))(lambda p: A.query_counts(p, "port == 64000-65000 && vlan < 11 || src == 10.0.0.0/29", 64))

# ---- order, limits --------------------------------------------------------------------------------------------------

query("top_protos", PROTO_SQL + " SELECT proto, count(*) AS packets FROM named GROUP BY proto ORDER BY packets DESC, proto LIMIT 3")(lambda p: A.top(A.protocol_mix(p).select("proto", "packets"), 3, "packets", "proto"))
query("top_macs", _MAC_SQL + " SELECT mac, count(*) AS packets FROM r GROUP BY mac ORDER BY packets DESC, mac LIMIT 10")(lambda p: A.top(A.mac_stats(p).select("mac", "packets"), 10, "packets", "mac"))
query("top_ports", ", x AS (SELECT sport AS port FROM packets UNION ALL SELECT dport FROM packets) SELECT port, count(*) AS packets FROM x WHERE port IS NOT NULL GROUP BY port ORDER BY packets DESC, port LIMIT 10")(lambda p: A.top(A.port_totals(p), 10, "packets", "port"))
query("top_convs_bytes", CONV_SQL + " ORDER BY bytes DESC, a, b LIMIT 20")(lambda p: A.top(A.conversations(p), 20, "bytes", "a", "b"))
query("page_window", "SELECT packet_no, origlen FROM packets WHERE packet_no BETWEEN 2048 AND 3071")(lambda p: A.page(p, 2048).select("packet_no", "origlen"))
query("query_limit", "SELECT packet_no FROM packets WHERE ip_proto = 17 ORDER BY packet_no LIMIT 100")(lambda p: p.where(packet_filter("proto == udp")).select("packet_no").orderBy("packet_no").limit(100))

# ---- lookups --------------------------------------------------------------------------------------------------------


def _with_table(make):
    return lambda p: make(p, p.sparkSession)


query("port_service", f", s(port, service) AS (VALUES {_SERVICES}) SELECT packet_no, dport, service FROM packets LEFT JOIN s ON s.port = dport WHERE dport IS NOT NULL")(_with_table(lambda p, spark: p.where("dport IS NOT NULL").join(F.broadcast(N.services(spark)), F.col("dport") == F.col("port"), "left").select("packet_no", "dport", "service")))
query("flow_service", f", s(port, service) AS (VALUES {_SERVICES}) SELECT packet_no, coalesce(b.service, a.service, '') AS service FROM packets LEFT JOIN s a ON a.port = sport LEFT JOIN s b ON b.port = dport WHERE sport IS NOT NULL")(lambda p: p.where("sport IS NOT NULL").select("packet_no", F.coalesce(N.service_name(F.col("dport")), N.service_name(F.col("sport")), F.lit("")).alias("service")))
query("ethertype_name", f", t(n, name) AS (VALUES {_ETHER}) SELECT packet_no, name FROM packets LEFT JOIN t ON t.n = ethertype")(_with_table(lambda p, spark: p.join(F.broadcast(N.ethertypes(spark).withColumnRenamed("ethertype", "n")), F.col("ethertype") == F.col("n"), "left").select("packet_no", "name")))
query("protocol_keyword", f", t(n, keyword) AS (VALUES {_KEYWORDS}) SELECT packet_no, keyword FROM packets LEFT JOIN t ON t.n = ip_proto")(_with_table(lambda p, spark: p.join(F.broadcast(N.ip_protocols(spark)), F.col("ip_proto") == F.col("number"), "left").select("packet_no", "keyword")))
query("drill_down", ", c AS (SELECT ip4_src, ip4_dst, sum(origlen) AS n FROM packets WHERE ip4_src IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 5) SELECT packet_no FROM packets p WHERE EXISTS (SELECT 1 FROM c WHERE c.ip4_src = p.ip4_src AND c.ip4_dst = p.ip4_dst)")(lambda p: p.join(p.where("ip4_src IS NOT NULL").groupBy("ip4_src", "ip4_dst").agg(F.sum("origlen").alias("n")).orderBy(F.desc("n"), "ip4_src", "ip4_dst").limit(5), ["ip4_src", "ip4_dst"], "left_semi").select("packet_no"))

# ---- histograms -----------------------------------------------------------------------------------------------------

query("hist_rescaling", """, o AS (SELECT arg_min(ts_nanos, packet_no) // 1000000000 * 1000000000 AS origin, least(min(ts_nanos), arg_min(ts_nanos, packet_no) // 1000000000 * 1000000000) AS lo, max(ts_nanos) AS hi FROM packets),
    w AS (SELECT origin, min(width) AS width FROM (SELECT o.*, CAST(1000000000 * pow(2, k) AS BIGINT) AS width FROM o, range(0, 30) t(k)) WHERE (hi - origin) // width - CAST(floor((lo - origin) / CAST(width AS DOUBLE)) AS BIGINT) < 1024 GROUP BY origin)
    SELECT origin, width, CAST(floor((ts_nanos - origin) / CAST(width AS DOUBLE)) AS BIGINT) AS bucket, count(*) AS packets FROM packets, w GROUP BY 1, 2, 3""")(H.rescaling)
_HB = f", t0 AS (SELECT arg_min(ts_nanos, packet_no) AS t0 FROM packets), hb AS (SELECT *, greatest(ts_nanos - t0, 0) // {TIME_STEP} AS bucket FROM packets, t0)"
_SERIES_SQL = {"tcp": "ip_proto = 6", "udp": "ip_proto = 17", "icmp": "ip_proto IN (1, 58)", "arp": "ethertype = 2054", "other": "NOT coalesce(ip_proto IN (1, 6, 17, 58), false) AND ethertype <> 2054", "ipv6": "ethertype = 34525", "dns": "sport = 53 OR dport = 53", "tls": "sport = 443 OR dport = 443", "http": "sport IN (80, 8080) OR dport IN (80, 8080)", "ssh": "sport = 22 OR dport = 22", "smb": "sport IN (139, 445) OR dport IN (139, 445)"}
_SUMS = ", ".join(f"count(*) FILTER ({w}) AS {n}_frames, CAST(coalesce(sum(origlen) FILTER ({w}), 0) AS BIGINT) AS {n}_bytes" for n, w in _SERIES_SQL.items())
query("hist_multi_series", _HB + f" SELECT bucket, count(*) AS frames, CAST(sum(origlen) AS BIGINT) AS bytes, {_SUMS} FROM hb GROUP BY bucket")(lambda p: H.multi_series(p, TIME_STEP))
query("hist_rates", _HB + f", g AS (SELECT bucket, count(*) AS frames, CAST(sum(origlen) AS BIGINT) AS bytes FROM hb GROUP BY bucket), a AS (SELECT unnest(range(0, (SELECT max(bucket) FROM hb) + 1)) AS bucket) SELECT a.bucket, coalesce(frames, 0) AS frames, coalesce(bytes, 0) AS bytes, round(coalesce(frames, 0) / {TIME_STEP / 1e9}, 3) AS frames_per_s, round(coalesce(bytes, 0) * 8 / {TIME_STEP / 1e9}, 3) AS bits_per_s FROM a LEFT JOIN g USING (bucket)")(lambda p: H.with_rates(H.gap_filled(H.multi_series(p, TIME_STEP, {})), TIME_STEP))
query("hist_downsample", _HB + ", g AS (SELECT bucket, count(*) AS frames FROM hb GROUP BY bucket) SELECT CAST(floor(bucket * 16 / 120.0) AS BIGINT) AS col, CAST(sum(frames) AS BIGINT) AS frames FROM g GROUP BY 1")(lambda p: H.downsample(H.multi_series(p, TIME_STEP, {}), 16, 120, "frames"))
query("hist_fold", _HB + ", g AS (SELECT bucket, count(*) AS frames FROM hb GROUP BY bucket) SELECT bucket // 8 AS fold, max(frames) AS frames FROM g GROUP BY 1")(lambda p: H.fold(H.multi_series(p, TIME_STEP, {}), 16, 121))
query("hist_peak", _HB + ", g AS (SELECT bucket, count(*) AS frames FROM hb GROUP BY bucket) SELECT bucket, frames FROM g ORDER BY frames DESC, bucket LIMIT 1")(lambda p: H.peak(H.multi_series(p, TIME_STEP, {})))
query("hist_mix", _HB + " SELECT " + ", ".join(f"round(count(*) FILTER ({_SERIES_SQL[n]}) * 100.0 / greatest(count(*), 1), 2) AS {n}" for n in ("tcp", "udp", "arp")) + " FROM hb")(lambda p: H.multi_series(p, TIME_STEP).agg(*H.share_of(None, ["tcp", "udp", "arp"])))

# ---- scalars --------------------------------------------------------------------------------------------------------


def scalar(name: str, sql: str, column, where: str = "TRUE"):
    query(name, f"SELECT packet_no, {sql} AS v FROM packets WHERE {where}")(lambda p: p.where(where).select("packet_no", column().alias("v")))


_MAC_TEXT = "array_to_string([substr(lpad(printf('%x', {0}), 12, '0'), CAST(i AS INT), 2) for i in [1, 3, 5, 7, 9, 11]], ':')"
_IP4_TEXT = "(({0} // 16777216) || '.' || ({0} // 65536 % 256) || '.' || ({0} // 256 % 256) || '.' || ({0} % 256))"
_IP_TEXT = "CASE WHEN ip4_{0} IS NOT NULL THEN " + _IP4_TEXT.replace("{0}", "ip4_{0}") + " WHEN v6_{0} = 0 THEN '2001:db8::' WHEN v6_{0} IS NOT NULL THEN '2001:db8:0:' || printf('%x', v6_{0}) || '::' || printf('%x', v6_{0}) END"
scalar("fn_fmt_mac", _MAC_TEXT.format("mac_src"), lambda: S.fmt_mac(F.col("mac_src")))
scalar("fn_fmt_ip4", _IP4_TEXT.format("ip4_src"), lambda: S.fmt_ip4(F.col("ip4_src")), "ip4_src IS NOT NULL")
scalar("fn_fmt_addr", _IP_TEXT.format("src"), lambda: S.fmt_addr(F.col("ip4_src"), F.col("ip6_src")))
scalar("fn_fmt_ts", "strftime(make_timestamp(ts_nanos // 1000), '%Y-%m-%d %H:%M:%S.%g')", lambda: S.fmt_ts(F.col("ts_nanos")))
scalar("fn_fmt_ts_short", "strftime(make_timestamp(ts_nanos // 1000), '%H:%M:%S.%g')", lambda: S.fmt_ts(F.col("ts_nanos"), short=True))
scalar("fn_iso", "strftime(make_timestamp(ts_nanos // 1000), '%Y-%m-%dT%H:%M:%S.%g+00:00')", lambda: S.iso(F.col("ts_nanos")))
_BIG = "(packet_no * packet_no * packet_no)"
scalar("fn_fmt_bytes", f"CASE WHEN {_BIG} >= 1000000000000 THEN printf('%.1f TB', {_BIG} / 1e12) WHEN {_BIG} >= 1000000000 THEN printf('%.1f GB', {_BIG} / 1e9) WHEN {_BIG} >= 1000000 THEN printf('%.1f MB', {_BIG} / 1e6) WHEN {_BIG} >= 1000 THEN printf('%.1f KB', {_BIG} / 1e3) ELSE {_BIG} || ' B' END", lambda: S.fmt_bytes(F.expr("CAST(packet_no AS DECIMAL(38,0)) * packet_no * packet_no")))  # a cube leaves 64 bits at 2,097,152 packets
scalar("fn_duration", "CASE WHEN packet_no < 1 THEN printf('%.0f ms', packet_no * 1000.0) WHEN packet_no < 120 THEN printf('%.1f s', packet_no * 1.0) WHEN packet_no < 7200 THEN printf('%.1f min', packet_no / 60.0) WHEN packet_no < 172800 THEN printf('%.1f h', packet_no / 3600.0) ELSE printf('%.1f d', packet_no / 86400.0) END", lambda: S.fmt_duration(F.col("packet_no")))
scalar("fn_tcp_flags", "CASE tcp_flags WHEN 2 THEN 'SYN' WHEN 18 THEN 'SYN,ACK' WHEN 4 THEN 'RST' WHEN 24 THEN 'PSH,ACK' END", lambda: S.tcp_flags(F.col("tcp_flags")))
scalar("fn_sign_extend", "CASE WHEN packet_no % 256 >= 128 THEN packet_no % 256 - 256 ELSE packet_no % 256 END", lambda: S.sign_extend(F.col("packet_no") % 256, 8))
scalar("fn_zigzag", "CASE WHEN origlen - 100 >= 0 THEN (origlen - 100) * 2 ELSE -(origlen - 100) * 2 - 1 END", lambda: S.zigzag(F.col("origlen") - 100))
scalar("fn_unzigzag", "CASE WHEN packet_no % 2 = 0 THEN packet_no // 2 ELSE -((packet_no + 1) // 2) END", lambda: S.unzigzag(F.col("packet_no")))
scalar("payload_class", "CASE WHEN ip_proto = 6 AND sport IS NOT NULL THEN 'tcp/' || CASE WHEN least(sport, dport) < 1024 THEN least(sport, dport) ELSE 65535 END WHEN ip_proto = 17 AND sport IS NOT NULL THEN 'udp/' || CASE WHEN least(sport, dport) < 1024 THEN least(sport, dport) ELSE 65535 END WHEN ip_proto IS NOT NULL THEN 'ip/' || ip_proto ELSE 'l2/' || ethertype END", lambda: S.payload_class(F.col("ethertype"), F.col("ip_proto"), F.col("sport"), F.col("dport")))


def text_scalar(name: str, least: int, sql: str, column):
    """Over every text; null for those of fewer than `least` bytes."""
    query(name, f"SELECT doc_id AS packet_no, CASE WHEN octet_length(encode(text)) >= {least} THEN {sql} END AS v FROM documents", documents_as_payload)(lambda p: p.select("packet_no", column().alias("v")))


_B = "CAST(('0x' || rpad(substr(hex(encode(substr(text, 1, 12))), {0} * 2 + 1, 2), 2, '0')) AS BIGINT)"  # 12 characters hold the bytes asked for
text_scalar("fn_bits", 4, f"({_B.format(2)} * 256 + {_B.format(3)}) // 32 % 128", lambda: S.bits(F.col("frame"), 20, 7))
text_scalar("fn_uint_be", 7, f"{_B.format(4)} * 65536 + {_B.format(5)} * 256 + {_B.format(6)}", lambda: S.uint_be(F.col("frame"), 4, 3))
text_scalar("fn_uint_le", 7, f"{_B.format(6)} * 65536 + {_B.format(5)} * 256 + {_B.format(4)}", lambda: S.uint_le(F.col("frame"), 4, 3))
query("fn_ones_sum", """, d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), l AS (SELECT r, regexp_extract_all(hex(encode(text)), '..') AS l FROM d),
    b AS (SELECT r, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM l), s AS (SELECT r, CAST(sum(CAST('0x' || x AS BIGINT) * CASE WHEN k % 2 = 1 THEN 256 ELSE 1 END) AS BIGINT) AS s FROM b GROUP BY r)
    SELECT doc_id AS packet_no, CASE WHEN text IS NOT NULL THEN CASE WHEN coalesce(s, 0) = 0 THEN 0 ELSE (s - 1) % 65535 + 1 END END AS v FROM d LEFT JOIN s USING (r)""", documents_as_payload)(lambda p: p.select("packet_no", S.ones_sum(F.col("frame")).alias("v")))
query("fn_slug", "SELECT page_id, CASE WHEN s = '' THEN 'field' WHEN regexp_matches(s, '^[0-9]') THEN 'f_' || s ELSE s END AS v FROM (SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM pages)", lambda spark, sf: spark.read.parquet(f"{sf}/pages.parquet"))(lambda p: p.select("page_id", S.slug(F.col("url")).alias("v")))
query("fn_canonical_ts", "SELECT doc_id, regexp_full_match(t, '(0|[1-9][0-9]{0,17})(\\.[0-9]{1,18})?') AS v FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '0' || doc_id WHEN doc_id % 4 = 1 THEN doc_id || '.' ELSE doc_id || '.5' END AS t FROM documents)", lambda spark, sf: spark.read.parquet(f"{sf}/documents.parquet").select("doc_id"))(lambda p: p.select("doc_id", S.canonical_timestamp(F.expr("CASE WHEN doc_id % 4 = 0 THEN '0' || doc_id WHEN doc_id % 4 = 1 THEN doc_id || '.' ELSE doc_id || '.5' END")).alias("v")))

# ---- inventory ------------------------------------------------------------------------------------------------------

REPORT_SQL = f""", rr AS (SELECT *, {_MAC_TEXT.format('mac_src')} AS smac, {_MAC_TEXT.format('mac_dst')} AS dmac, {_IP_TEXT.format('src')} AS sip, {_IP_TEXT.format('dst')} AS dip,
    CASE WHEN sport IS NOT NULL THEN CASE ip_proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' END END AS pp FROM packets),
    r AS (SELECT *, CASE WHEN sip IS NULL AND ethertype = 2054 THEN 'arp' ELSE CASE ip_proto WHEN 1 THEN 'icmp' WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' ELSE coalesce(CAST(ip_proto AS VARCHAR), '') END END AS l4 FROM rr)"""
_BASE = "count(*) AS packets, CAST(sum(origlen) AS BIGINT) AS bytes, min(ts_nanos) AS first_ts, max(ts_nanos) AS last_ts"


def _side(test: str, name: str) -> str:
    return f"count(*) FILTER ({test}) AS {name}_packets, CAST(coalesce(sum(origlen) FILTER ({test}), 0) AS BIGINT) AS {name}_bytes"


_HIST_SQL = {"tcp": "ip_proto = 6", "udp": "ip_proto = 17", "icmp": "ip_proto = 1", "icmpv6": "ip_proto = 58", "arp": "ethertype = 2054 AND NOT coalesce(ip_proto IN (1, 6, 17, 58), false)", "other": "NOT coalesce(ip_proto IN (1, 6, 17, 58), false) AND ethertype <> 2054"}
query("rpt_histogram", _HB + ", g AS (SELECT bucket, count(*) AS frames, CAST(sum(origlen) AS BIGINT) AS bytes, " + ", ".join(f"count(*) FILTER ({w}) AS {n}_frames, CAST(coalesce(sum(origlen) FILTER ({w}), 0) AS BIGINT) AS {n}_bytes" for n, w in _HIST_SQL.items()) + f" FROM hb GROUP BY bucket), a AS (SELECT unnest(range(0, (SELECT max(bucket) FROM hb) + 1)) AS bucket) SELECT a.bucket, coalesce(frames, 0) AS frames, coalesce(bytes, 0) AS bytes, " + ", ".join(f"coalesce({n}_{k}, 0) AS {n}_{k}" for n in _HIST_SQL for k in ("frames", "bytes")) + f", round(coalesce(frames, 0) / {TIME_STEP / 1e9}, 3) AS frames_per_s, round(coalesce(bytes, 0) * 8 / {TIME_STEP / 1e9}, 3) AS bits_per_s FROM a LEFT JOIN g USING (bucket)")(lambda p: R.histogram(p, TIME_STEP))
query("rpt_protocols", REPORT_SQL + """, x AS (SELECT 'chain' AS kind, CASE WHEN ip4_src IS NOT NULL THEN 'eth:ip' WHEN sip IS NOT NULL THEN 'eth:ipv6' ELSE 'eth' END || CASE WHEN l4 <> '' THEN ':' || l4 ELSE '' END AS protocol, origlen FROM r
    UNION ALL SELECT 'top', CASE WHEN l4 = '' THEN 'eth' ELSE l4 END, origlen FROM r UNION ALL SELECT 'vlan', CAST(vlan AS VARCHAR), origlen FROM r WHERE vlan IS NOT NULL)
    SELECT kind, protocol, count(*) AS packets, CAST(sum(origlen) AS BIGINT) AS bytes, round(count(*) * 100.0 / (SELECT count(*) FROM packets), 2) AS pct_packets FROM x GROUP BY 1, 2""")(R.protocols)
query("rpt_macs", REPORT_SQL + f""", x AS (SELECT smac AS mac, TRUE AS tx, sip AS ip, origlen, ts_nanos FROM r UNION ALL SELECT dmac, FALSE, CASE WHEN NOT starts_with(dmac, 'ff:ff') THEN dip END, origlen, ts_nanos FROM r),
    i AS (SELECT mac, ip, row_number() OVER (PARTITION BY mac ORDER BY ip) AS k FROM (SELECT DISTINCT mac, ip FROM x WHERE ip IS NOT NULL)),
    l AS (SELECT mac, count(*) AS n, string_agg(ip, ' ' ORDER BY ip) FILTER (k <= 20) AS ips FROM i GROUP BY mac)
    SELECT g.*, coalesce(n, 0) AS ip_count, coalesce(ips || CASE WHEN n > 20 THEN ' ...' ELSE '' END, '') AS ips FROM (SELECT mac, {_BASE}, {_side('tx', 'tx')}, {_side('NOT tx', 'rx')} FROM x GROUP BY mac) g LEFT JOIN l USING (mac)""")(R.macs)
query("rpt_ips", REPORT_SQL + f""", b AS (SELECT *, dport <= sport AS dst_serves, CASE WHEN pp IS NOT NULL THEN pp || '/' || least(sport, dport) END AS port FROM r WHERE sip IS NOT NULL),
    x AS (SELECT sip AS ip, TRUE AS tx, dip AS peer, smac AS m, NOT dst_serves AS serves, port, l4, origlen, ts_nanos FROM b UNION ALL SELECT dip, FALSE, sip, dmac, dst_serves, port, l4, origlen, ts_nanos FROM b),
    n AS (SELECT ip, serves, port, count(*) AS n FROM x WHERE port IS NOT NULL GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY ip, serves ORDER BY n DESC, port) AS k FROM n),
    t AS (SELECT ip, string_agg(port || '(' || n || ')', ' ' ORDER BY k) FILTER (serves) AS served, string_agg(port || '(' || n || ')', ' ' ORDER BY k) FILTER (NOT serves) AS used FROM k WHERE k <= 5 GROUP BY ip)
    SELECT g.*, coalesce(served, '') AS ports_served, coalesce(used, '') AS ports_used, round((last_ts - first_ts) / 1e9, 3) AS duration_s FROM (SELECT ip, {_BASE}, {_side('tx', 'tx')}, {_side('NOT tx', 'rx')}, count(DISTINCT peer) AS peer_count, string_agg(DISTINCT l4, ' ' ORDER BY l4) AS protocols, string_agg(DISTINCT m, ' ' ORDER BY m) AS macs FROM x GROUP BY ip) g LEFT JOIN t USING (ip)""")(R.ips)
query("rpt_ports", REPORT_SQL + f""", s(sp, service) AS (VALUES {_SERVICES}), x AS (SELECT pp AS proto, sport AS port, TRUE AS src, sip AS host, origlen, ts_nanos FROM r WHERE pp IS NOT NULL UNION ALL SELECT pp, dport, FALSE, dip, origlen, ts_nanos FROM r WHERE pp IS NOT NULL)
    SELECT g.*, coalesce(service, '') AS service FROM (SELECT proto, port, {_BASE}, {_side('src', 'as_src')}, {_side('NOT src', 'as_dst')}, count(DISTINCT host) AS host_count FROM x GROUP BY 1, 2) g LEFT JOIN s ON sp = port""")(R.ports)
query("rpt_conversations", REPORT_SQL + f""", x AS (SELECT *, sip <= dip AS ab, CASE WHEN pp IS NOT NULL THEN pp || '/' || least(sport, dport) END AS port, least(sip, dip) AS ip_a, greatest(sip, dip) AS ip_b FROM r WHERE sip IS NOT NULL),
    i AS (SELECT ip_a, ip_b, port, row_number() OVER (PARTITION BY ip_a, ip_b ORDER BY port) AS k FROM (SELECT DISTINCT ip_a, ip_b, port FROM x WHERE port IS NOT NULL)),
    l AS (SELECT ip_a, ip_b, string_agg(port, ' ' ORDER BY port) FILTER (k <= 15) || CASE WHEN count(*) > 15 THEN ' ...' ELSE '' END AS dst_ports FROM i GROUP BY 1, 2)
    SELECT g.*, coalesce(dst_ports, '') AS dst_ports, round((last_ts - first_ts) / 1e9, 3) AS duration_s FROM (SELECT ip_a, ip_b, {_BASE}, {_side('ab', 'a_to_b')}, {_side('NOT ab', 'b_to_a')}, string_agg(DISTINCT l4, ' ' ORDER BY l4) AS protocols FROM x GROUP BY 1, 2) g LEFT JOIN l USING (ip_a, ip_b)""")(R.conversations)
_FLOWS_SQL = REPORT_SQL + f""", s(sp, service) AS (VALUES {_SERVICES}), x AS (SELECT *, sip < dip OR sip = dip AND sport <= dport AS ab FROM r WHERE pp IS NOT NULL AND sip IS NOT NULL),
    y AS (SELECT *, CASE WHEN ab THEN sip ELSE dip END AS ip_a, CASE WHEN ab THEN sport ELSE dport END AS port_a, CASE WHEN ab THEN dip ELSE sip END AS ip_b, CASE WHEN ab THEN dport ELSE sport END AS port_b FROM x),
    g AS (SELECT pp AS proto, ip_a, port_a, ip_b, port_b, {_BASE}, {_side('ab', 'a_to_b')}, {_side('NOT ab', 'b_to_a')}, count(*) FILTER (pp = 'tcp' AND tcp_flags = 2) AS syn, count(*) FILTER (pp = 'tcp' AND tcp_flags = 18) AS syn_ack, count(*) FILTER (pp = 'tcp' AND tcp_flags = 4) AS rst FROM y GROUP BY 1, 2, 3, 4, 5),
    f AS (SELECT g.*, CASE WHEN proto = 'tcp' THEN CASE WHEN syn > 0 AND syn_ack > 0 THEN 'handshake' WHEN syn > 0 THEN 'syn-no-reply' WHEN a_to_b_packets = 0 OR b_to_a_packets = 0 THEN 'one-way' ELSE 'mid-stream' END || CASE WHEN rst > 0 THEN '+rst' ELSE '' END
        WHEN a_to_b_packets > 0 AND b_to_a_packets > 0 THEN 'bidir' ELSE 'one-way' END AS state, coalesce(b.service, a.service, '') AS service, round((last_ts - first_ts) / 1e9, 3) AS duration_s FROM g LEFT JOIN s a ON a.sp = port_a LEFT JOIN s b ON b.sp = port_b)"""
query("rpt_flows", _FLOWS_SQL + " SELECT * FROM f")(R.flows)
query("rpt_flow_state", _FLOWS_SQL + " SELECT proto, state, count(*) AS flows FROM f GROUP BY 1, 2")(lambda p: R.flows(p).groupBy("proto", "state").agg(F.count("*").alias("flows")))
query("rpt_top_flows", _FLOWS_SQL + " SELECT proto, ip_a, port_a, ip_b, port_b, packets FROM f ORDER BY packets DESC, proto, ip_a, port_a, ip_b, port_b LIMIT 25")(lambda p: R.ordered("flows", p).select("proto", "ip_a", "port_a", "ip_b", "port_b", "packets").limit(25))

#: Names seen in traffic, made from web pages: portable SQL over page_id and url.
NAME_COLUMNS = {
    "host": "split_part(split_part(url, '://', 2), '/', 1)", "uri": "'/' || split_part(split_part(url, '://', 2), '/', 2)", "sip": "'10.0.0.' || (page_id % 17)", "dip": "'192.168.1.' || (page_id % 5)",
    "dport": "CASE WHEN page_id % 9 = 0 THEN 0 WHEN page_id % 2 = 0 THEN 443 ELSE 80 END", "ts_nanos": "page_id * 1000000", "response": "page_id % 3 = 0", "method": "CASE WHEN page_id % 4 = 0 THEN 'POST' ELSE 'GET' END", "user_agent": "CASE WHEN page_id % 6 = 0 THEN '' ELSE 'agent/' || (page_id % 2) END",
}


def names_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").withColumn("page_id", F.col("page_id") % 1000)
    rows = pages.selectExpr(*(f"{x} AS {n}" for n, x in NAME_COLUMNS.items()))
    return rows.withColumns({"qname": F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1), "server_name": F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1)})


_NAMES_SQL = ", pg AS (SELECT page_id % 1000 AS page_id, url FROM pages), n0 AS (SELECT " + ", ".join(f"{x} AS {n}" for n, x in NAME_COLUMNS.items()) + " FROM pg), n AS (SELECT *, regexp_extract(host, '([^.]*\\.[^.]*)$', 1) AS qname FROM n0)"


def _names_sql(keys: str, count: str, client: str, server: str, extra: str = "") -> str:
    return _NAMES_SQL + f""", v AS (SELECT *, {client} AS c, {server} AS s FROM n), cl AS (SELECT {keys}, c, row_number() OVER (PARTITION BY {keys} ORDER BY c) AS k FROM (SELECT DISTINCT {keys}, c FROM v)), sl AS (SELECT {keys}, s, row_number() OVER (PARTITION BY {keys} ORDER BY s) AS k FROM (SELECT DISTINCT {keys}, s FROM v)),
    cc AS (SELECT {keys}, count(*) AS client_count, string_agg(c, ' ' ORDER BY c) FILTER (k <= 10) AS clients FROM cl GROUP BY {keys}), ss AS (SELECT {keys}, string_agg(s, ' ' ORDER BY s) FILTER (k <= 5) AS servers FROM sl GROUP BY {keys}),
    g AS (SELECT {keys}, count(*) AS {count}, {extra} min(ts_nanos) AS first_ts, max(ts_nanos) AS last_ts FROM v GROUP BY {keys})"""


_SERVER_SQL = "CASE WHEN dport <> 0 THEN dip || ':' || dport ELSE dip END"
query("rpt_dns", _names_sql("qname", "queries_and_responses", "CASE WHEN response THEN dip ELSE sip END", "CASE WHEN response THEN sip ELSE dip END", "count(*) FILTER (response) AS responses,") + " SELECT qname AS name, queries_and_responses, responses, client_count, clients, servers, first_ts, last_ts FROM g JOIN cc USING (qname) JOIN ss USING (qname)", names_seen)(R.dns)
query("rpt_sni", _names_sql("qname", "client_hellos", "sip", _SERVER_SQL) + " SELECT qname AS server_name, client_hellos, client_count, clients, servers, first_ts, last_ts FROM g JOIN cc USING (qname) JOIN ss USING (qname)", names_seen)(R.tls_sni)
_HK = "host, method, uri, user_agent"
query("rpt_http", _names_sql(_HK, "requests", "sip", _SERVER_SQL) + f" SELECT {_HK}, requests, client_count, clients, servers, first_ts, last_ts FROM g JOIN cc USING ({_HK}) JOIN ss USING ({_HK})", names_seen)(R.http)
query("table_search", "SELECT page_id FROM pages WHERE contains(lower(url), 'example') AND NOT contains(lower(url), '/en/') AND contains(CAST(page_id AS VARCHAR), '1')", lambda spark, sf: spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url"))(lambda p: p.where(table_search(["page_id", "url"], "EXAMPLE -/en/ page:1")).select("page_id"))

# ---- flow model -----------------------------------------------------------------------------------------------------

MODEL_COLUMNS = {"ip_id": "(event_id * 40503) % 65536", "seq": "(event_id * 2654435) % 4294967296", "ack": "(event_id * 97531) % 4294967296", "payload_len": "event_id % 1400"}


def modelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).selectExpr("*", *(f"{x.replace('event_id', 'packet_no')} AS {n}" for n, x in MODEL_COLUMNS.items())).where("sport IS NOT NULL")


_FLOW_SQL = ", m AS (SELECT *, " + ", ".join(f"{x.replace('event_id', 'packet_no')} AS {n}" for n, x in MODEL_COLUMNS.items()) + " FROM packets WHERE sport IS NOT NULL)"
_FLOW = "mac_src, mac_dst, vlan, ethertype, ip4_src, ip4_dst, v6_src, v6_dst, ip_proto, sport, dport"
_W = f"OVER (PARTITION BY {_FLOW} ORDER BY packet_no)"


def _wrap_sql(x: str, bits: int) -> str:
    return f"((({x}) + {1 << bits - 1}) % {1 << bits} + {1 << bits}) % {1 << bits} - {1 << bits - 1}"


query("flow_ip_id_delta", _FLOW_SQL + f" SELECT packet_no, {_wrap_sql(f'ip_id - lag(ip_id, 1, 0) {_W}', 16)} AS ip_id_delta FROM m", modelled)(lambda p: W.ip_id_delta(p).select("packet_no", "ip_id_delta"))
_NEXT = "(seq + payload_len + tcp_flags // 2 % 2 + tcp_flags % 2) % 4294967296"
query("flow_seq_residual", _FLOW_SQL + f", t AS (SELECT *, {_NEXT} AS nx FROM m WHERE ip_proto = 6) SELECT packet_no, {_wrap_sql(f'seq - lag(nx, 1, 0) {_W}', 32)} AS seq_residual FROM t", modelled)(lambda p: W.seq_residual(p.where("ip_proto = 6")).select("packet_no", "seq_residual"))
query("flow_ack_delta", _FLOW_SQL + f" SELECT packet_no, {_wrap_sql(f'ack - lag(ack, 1, 0) {_W}', 32)} AS ack_delta FROM m", modelled)(lambda p: W.ack_delta(p).select("packet_no", "ack_delta"))
query("ts_delta", "SELECT packet_no, ts_nanos - lag(ts_nanos, 1, 0) OVER (PARTITION BY packet_no // 1024 ORDER BY packet_no) AS ts_delta FROM packets")(lambda p: W.ts_delta(p, 1024).select("packet_no", "ts_delta"))
query("flow_ids", _FLOW_SQL + f", f AS (SELECT {_FLOW}, min(packet_no) AS first_packet FROM m GROUP BY ALL) SELECT mac_src, mac_dst, vlan, ethertype, ip4_src, ip4_dst, ip_proto, sport, dport, first_packet, row_number() OVER (ORDER BY first_packet) - 1 AS flow_id FROM f", modelled)(lambda p: W.flow_ids(p, bucket=1000).drop("ip6_src", "ip6_dst"))
query("fn_ip_checksum", "SELECT packet_no, (65535 - s) AS v FROM (SELECT packet_no, x % 65536 + x // 65536 AS s FROM (SELECT packet_no, 17664 + (20 + CASE WHEN ip_proto = 6 THEN 25 WHEN ip_proto = 17 THEN 13 ELSE 5 END) + 16384 + ip_proto + ip4_src // 65536 + ip4_src % 65536 + ip4_dst // 65536 + ip4_dst % 65536 AS x FROM packets WHERE ip4_src IS NOT NULL))", framed)(lambda p: D.dissect(p).where("ip4_src IS NOT NULL").select("packet_no", S.ip_checksum(F.substring(F.col("frame"), F.when(F.col("vlan").isNull(), 15).otherwise(19), F.lit(20))).alias("v")))

# ---- set operations over packets; extras that the reference leaves to its filter language ---------------------------

query("set_intersect", "SELECT ip4_src AS ip FROM packets WHERE ip_proto = 6 AND ip4_src IS NOT NULL INTERSECT SELECT ip4_src FROM packets WHERE ip_proto = 17")(lambda p: p.where("ip_proto = 6 AND ip4_src IS NOT NULL").select(F.col("ip4_src").alias("ip")).intersect(p.where("ip_proto = 17").select("ip4_src")))
query("set_except", "SELECT ip4_src AS ip FROM packets WHERE ip_proto = 6 AND ip4_src IS NOT NULL EXCEPT SELECT ip4_src FROM packets WHERE ip_proto = 1")(lambda p: p.where("ip_proto = 6 AND ip4_src IS NOT NULL").select(F.col("ip4_src").alias("ip")).subtract(p.where("ip_proto = 1").select("ip4_src")))

# ---- what SQL can't say: rows only ----------------------------------------------------------------------------------

SPEC = "meta:\n  id: text_head\nseq:\n  - id: first\n    type: u1\n  - id: word\n    type: u2le\n  - id: flag\n    type: b1\n  - id: rest\n    type: b7\n  - id: tail\n    type: str\n    size: 4\n    encoding: ASCII\n"


@query("kaitai_decode", source=documents_as_payload)
def _(p):
    return kaitai_decode(p, SPEC)


@query("fn_candidates", source=documents_as_payload)
def _(p):
    return candidates_of(p, 16, 32)


def baseband_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's whole text in GSE packets of at most 4,095 bytes, two to a baseband frame, a frame to a line; lines
    of every fiftieth document are malformed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(bytearray())).alias("b"))
    last = F.greatest(F.lit(0), F.ceil(F.length("b") / 8186) - 1).cast("int")
    parts = docs.select("doc_id", "b", F.explode(F.sequence(F.lit(0), last)).alias("f"))
    part = lambda k: F.substring(F.col("b"), F.col("f") * 8186 + 4093 * k + 1, F.lit(4093))
    gse = lambda x: F.concat(F.lpad(F.hex(F.length(x) + 2 + 0xC000), 4, "0"), F.hex(x))
    body = F.concat(gse(part(0)), F.when(F.length(part(1)) > 0, gse(part(1))).otherwise(""))
    frame = F.concat(F.lit("72000000"), F.lpad(F.hex(F.length(body) * 4), 4, "0"), F.lit("47000000"), body)
    return parts.select("doc_id", F.concat(F.lit('{"timestamp":'), F.col("doc_id").cast("string"), F.lit("."), (F.col("f") + 100).cast("string"), F.lit(',"bbframe":"'), F.regexp_replace(F.base64(F.unhex(frame)), "[\r\n]", ""), F.when(F.col("doc_id") % 50 == 0, '"}').otherwise('","metadata":{"ma_hdr":1}}')).alias("value"))


_FRAMES_SQL = ", d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n FROM documents), f AS (SELECT doc_id, n, unnest(range(0, greatest(1, (n + 8185) // 8186))) AS f FROM d)"


@query("gse_walk", _FRAMES_SQL + ", p AS (SELECT *, unnest([0, 1]) AS i, least(8186, n - f * 8186) AS m FROM f WHERE doc_id % 50 <> 0) SELECT doc_id || '.' || (f + 100) AS timestamp, CAST(i AS BIGINT) AS \"index\", CAST(i * 4095 AS BIGINT) AS start, CAST(CASE i WHEN 0 THEN least(m, 4093) ELSE m - 4093 END + 2 AS BIGINT) AS size FROM p WHERE i = 0 OR m > 4093", baseband_lines)
def _(p):
    return gse_packets(parse_lines(p)).select("timestamp", "index", "start", "size")


@query("bbframe_report", _FRAMES_SQL + " SELECT count(*) AS lines, count(*) FILTER (doc_id % 50 <> 0) AS modelled, count(*) FILTER (doc_id % 50 = 0) AS rejected_shape, CAST(0 AS BIGINT) AS rejected_timestamp, CAST(0 AS BIGINT) AS rejected_base64 FROM f", baseband_lines)
def _(p):
    return validation_report(parse_lines(p)).drop("frame_bytes")


def proven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame behind a shift of 0 to 2 bytes and without its Ethernet addresses: by packet number with the header's
    checksum filled in, then also with padding behind, then also with another version nibble; else proven by length."""
    p = D.dissect(framed(spark, sf_dir)).withColumns({"kind": F.col("packet_no") % 4, "l3": F.when(F.col("vlan").isNull(), 15).otherwise(19)})
    head = F.substring(F.col("frame"), F.col("l3"), F.lit(20))
    sealed = F.concat(F.substring(head, 1, 10), F.unhex(F.lpad(F.hex(S.ip_checksum(head)), 4, "0")), F.substring(head, 13, 8))
    turned = F.concat(F.lit(bytearray([0x75])), F.substring(sealed, 2, 19))
    made = F.when(F.col("kind") == 0, head).when(F.col("kind") == 3, turned).otherwise(sealed)
    v4 = F.concat(F.substring(F.col("frame"), F.lit(13), F.col("l3") - 13), made, F.substring(F.col("frame"), F.col("l3") + 20, F.length("frame")), F.when(F.col("kind") >= 2, F.lit(bytearray(7))).otherwise(F.lit(bytearray())))
    body = F.when(F.col("ip4_src").isNotNull(), v4).otherwise(F.substring(F.col("frame"), F.lit(13), F.length("frame")))
    return p.select("packet_no", F.explode(F.array(F.concat(F.substring(F.lit(bytearray([0xFF, 0xFF])), F.lit(1), (F.col("packet_no") % 3).cast("int")), body))).alias("body"))


@query("find_ipv4", "SELECT packet_no, CASE WHEN ip4_src IS NOT NULL THEN packet_no % 3 + CASE WHEN vlan IS NULL THEN 2 ELSE 6 END END AS v FROM packets", proven)
def _(p):
    return p.select("packet_no", find_ipv4(F.col("body")).alias("v"))


@query("fn_l4_checksum", """, f AS (SELECT packet_no, ip_proto, sport, dport, coalesce(tcp_flags, 0) AS fl, CASE WHEN ip_proto = 6 THEN 25 ELSE 13 END AS n, ip4_src, ip4_dst FROM packets WHERE ip4_src IS NOT NULL AND sport IS NOT NULL),
    t AS (SELECT packet_no, ip4_src // 65536 + ip4_src % 65536 + ip4_dst // 65536 + ip4_dst % 65536 + ip_proto + n + sport + dport + 26725 + 27756 + 28416 + CASE WHEN ip_proto = 6 THEN 1 + 20480 + fl + 8192 ELSE 13 END AS x FROM f),
    y AS (SELECT packet_no, x % 65536 + x // 65536 AS s FROM t) SELECT packet_no, 65535 - (s % 65536 + s // 65536) AS v FROM y""", framed)
def _(p):
    d = D.dissect(p).where("ip4_src IS NOT NULL AND sport IS NOT NULL")
    l3 = F.when(F.col("vlan").isNull(), 15).otherwise(19)
    return d.select("packet_no", S.l4_checksum(F.substring(F.col("frame"), l3 + 12, F.lit(8)), F.col("ip_proto"), F.substring(F.col("frame"), l3 + 20, F.length("frame"))).alias("v"))


@query("json_lines", "SELECT packet_no, '{\"ts_nanos\":' || ts_nanos || ',\"len\":' || origlen || ',\"vlan\":' || coalesce(CAST(vlan AS VARCHAR), 'null') || '}' AS value FROM packets")
def _(p):
    return p.select("packet_no", F.to_json(F.struct("ts_nanos", F.col("origlen").alias("len"), "vlan"), {"ignoreNullFields": "false"}).alias("value"))

# ---- the whole way, and live ----------------------------------------------------------------------------------------

FLAGSHIP = "ip == 10.0.0.0/8 && !(port == 5900-5910)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames built from events, dissected again, filtered and summed up by conversation."""
    rows = packets(spark, sf_dir).withColumn("ethertype", F.when(F.col("ethertype") == 0, 2048).otherwise(F.col("ethertype")))
    made = D.ethernet_frame(rows, F.lit("hello").cast("binary")).select("packet_no", "ts_nanos", "origlen", "linktype", "frame")
    return _plain(A.conversations(D.dissect(made).where(packet_filter(FLAGSHIP))))


QUERIES["flagship"] = flagship
SQL["flagship"] = "WITH " + PACKETS_SQL + CONV_SQL.replace("WHERE TRUE", "WHERE (ip4_src BETWEEN 167772160 AND 184549375 OR ip4_dst BETWEEN 167772160 AND 184549375) AND NOT coalesce(sport BETWEEN 5900 AND 5910, false) AND NOT coalesce(dport BETWEEN 5900 AND 5910, false)")


def _streamed(spark: SparkSession, sf_dir: str, mode: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A streaming query over the events table as it grows, drained into a memory table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(events).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"live_{uuid.uuid4().hex}"
    run_bounded(make(packets_of(raw)), name, mode)
    return spark.table(name)


def _live(name: str, mode: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _plain(_streamed(spark, sf_dir, mode, make))
    SQL[name] = f"WITH {PACKETS_SQL}{'' if sql.startswith(',') else ' '}{sql}"


_live("stream_live_filter", "append", lambda p: live_filter(p, "proto == tcp && port == 443").select("packet_no", "origlen"), "SELECT packet_no, origlen FROM packets WHERE ip_proto = 6 AND (sport = 443 OR dport = 443)")
_live("stream_live_conversations", "complete", live_conversations, f", c AS (SELECT *, {_KEY.format('src')} AS s, {_KEY.format('dst')} AS d FROM packets) SELECT least(s, d) AS a, greatest(s, d) AS b, count(*) AS packets, CAST(sum(origlen) AS BIGINT) AS bytes, min(ts_nanos) AS first_ts, max(ts_nanos) AS last_ts FROM c WHERE s IS NOT NULL GROUP BY 1, 2")
_live("stream_live_protocols", "complete", lambda p: live_protocols(p).select("proto", "packets", "bytes"), PROTO_SQL + " SELECT proto, count(*) AS packets, CAST(sum(origlen) AS BIGINT) AS bytes FROM named GROUP BY proto_kind, proto_number, proto")
