"""The inventory report: ten tables over packets with text addresses.

Every table is one or two groupings of exploded roles with a map-side part. List columns come from sets that hold the
distinct members of one group; their caps apply to the text shown alone, counts are of all members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.names import IP_PROTOCOLS, service_name
from netloom.functions.scalars import fmt_addr, fmt_mac
from netloom.operators.histograms import gap_filled, multi_series, with_rates

ADDRESSED = "(ip4_src IS NOT NULL OR ip6_src IS NOT NULL) AND (ip4_dst IS NOT NULL OR ip6_dst IS NOT NULL)"  # of raw columns, so it reaches the scan
NAMED = (1, 2, 6, 17, 41, 47, 50, 51, 58, 89, 132)  # protocols shown by name; others by number
HISTOGRAM = {
    "tcp": "proto == tcp", "udp": "proto == udp", "icmp": "proto == icmp", "icmpv6": "proto == icmpv6", "arp": "ethertype == 0x806 && !(proto in {tcp, udp, icmp, icmpv6})",
    "other": "!(proto in {tcp, udp, icmp, icmpv6} || ethertype == 0x806)",
}


def report_rows(p: DataFrame) -> DataFrame:
    """Packets with the report's fields: smac, dmac, sip, dip, l4 and, for TCP, UDP and SCTP, pp with both ports."""
    l4 = F.when(F.col("ip_proto").isin(*NAMED), F.try_element_at(F.create_map(*(F.lit(x) for n in NAMED for x in (n, IP_PROTOCOLS[n]))), F.col("ip_proto"))).otherwise(F.coalesce(F.col("ip_proto").cast("string"), F.lit("")))
    pp = F.when(F.col("sport").isNotNull() & F.col("dport").isNotNull(), F.when(F.col("ip_proto") == 6, "tcp").when(F.col("ip_proto") == 17, "udp").when(F.col("ip_proto") == 132, "sctp"))
    out = p.withColumns({"smac": fmt_mac(F.col("mac_src")), "dmac": fmt_mac(F.col("mac_dst")), "sip": fmt_addr(F.col("ip4_src"), F.col("ip6_src")), "dip": fmt_addr(F.col("ip4_dst"), F.col("ip6_dst")), "pp": pp})
    return out.withColumn("l4", F.when(F.col("sip").isNull() & (F.col("ethertype") == 0x0806), "arp").otherwise(l4))


def _sums() -> list[Column]:
    return [F.count("*").alias("packets"), F.sum("origlen").alias("bytes")]


def _seen() -> list[Column]:
    return [F.min("ts_nanos").alias("first_ts"), F.max("ts_nanos").alias("last_ts")]


def _sided(flag: str, name: str) -> list[Column]:
    hit = F.col(flag)
    return [F.count_if(hit).alias(f"{name}_packets"), F.coalesce(F.sum(F.when(hit, F.col("origlen"))), F.lit(0)).alias(f"{name}_bytes")]


def listed(values: Column, cap: int | None = None) -> Column:
    """A sorted set as text; beyond the cap it ends in ' ...'."""
    values = F.array_sort(values)
    if cap is None:
        return F.array_join(values, " ")
    return F.concat(F.array_join(F.slice(values, 1, cap), " "), F.when(F.size(values) > cap, " ...").otherwise(""))


def _roles(*roles: dict[str, Column]) -> Column:
    return F.inline(F.array(*(F.struct(*(c.alias(n) for n, c in r.items())) for r in roles)))


def members(each: DataFrame, keys: list[str], item: str, count: str, shown: str | None = None, cap: int = 0, more: str = " ...") -> DataFrame:
    """The number of distinct items of each key and, as text, the first `cap` of them; no set is gathered whole."""
    distinct = each.where(F.col(item).isNotNull()).select(*keys, item).distinct()
    out = distinct.groupBy(*keys).agg(F.count("*").cast("int").alias(count))
    if not shown:
        return out
    first = distinct.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(item))).where(F.col("place") <= cap)
    lists = first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(item)), " ").alias(shown))
    rest = F.when(F.col(count) > cap, more).otherwise("")
    return out.join(lists, keys).withColumn(shown, F.concat(F.col(shown), rest))


def histogram(p: DataFrame, interval_ns: int) -> DataFrame:
    return with_rates(gap_filled(multi_series(p, interval_ns, HISTOGRAM)), interval_ns)


def protocols(p: DataFrame) -> DataFrame:
    """Kinds chain, top and vlan, each with its share of all packets."""
    r = report_rows(p)
    name = F.when(F.col("l4") == "", "eth").otherwise(F.col("l4"))
    link = F.when(F.col("sip").isNotNull(), F.when(F.col("ip4_src").isNotNull(), "eth:ip").otherwise("eth:ipv6")).otherwise("eth")
    chain = r.groupBy(F.concat_ws(":", link, F.nullif("l4", F.lit(""))).alias("protocol")).agg(*_sums()).withColumn("kind", F.lit("chain"))
    top = r.groupBy(name.alias("protocol")).agg(*_sums()).withColumn("kind", F.lit("top"))
    vlan = r.where("vlan IS NOT NULL").groupBy(F.col("vlan").cast("string").alias("protocol")).agg(*_sums()).withColumn("kind", F.lit("vlan"))
    total = p.agg(F.count("*").alias("total"))  # one row
    every = chain.unionByName(top).unionByName(vlan).crossJoin(F.broadcast(total))
    return every.select("kind", "protocol", "packets", "bytes", F.round(F.col("packets") * 100.0 / F.greatest("total", F.lit(1)), 2).alias("pct_packets"))


def macs(p: DataFrame) -> DataFrame:
    group = F.col("dmac").rlike("^(ff:ff|01:00:5e|33:33)")
    each = report_rows(p).where("mac_src IS NOT NULL").select("origlen", "ts_nanos", _roles({"mac": F.col("smac"), "tx": F.lit(True), "ip": F.col("sip")}, {"mac": F.col("dmac"), "tx": F.lit(False), "ip": F.when(~group, F.col("dip"))}))
    each = each.withColumn("rx", ~F.col("tx"))
    found = each.groupBy("mac").agg(*_sums(), *_sided("tx", "tx"), *_sided("rx", "rx"), *_seen())
    return found.join(members(each, ["mac"], "ip", "ip_count", "ips", 20), "mac", "left").fillna({"ip_count": 0, "ips": ""})


def top_keys(counts: DataFrame, keys: list[str], item: str, n: str, k: int, out: str) -> DataFrame:
    """The k largest items of each key as 'item(n) ...'; ties by item."""
    rank = Window.partitionBy(*keys).orderBy(F.desc(n), item)
    best = counts.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= k)
    text = F.concat(F.col(item), F.lit("("), F.col(n).cast("string"), F.lit(")"))
    lines = F.array_sort(F.collect_list(F.struct("place", text.alias("text"))))  # k at most
    return best.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["text"]), " ").alias(out))


def ips(p: DataFrame) -> DataFrame:
    """The lower port is the service; on a tie the destination serves."""
    r = report_rows(p.where(ADDRESSED))
    served_by_dst = F.col("dport") <= F.col("sport")
    port = F.concat("pp", F.lit("/"), F.least("sport", "dport").cast("string"))
    each = r.select("origlen", "ts_nanos", "l4", F.when(F.col("pp").isNotNull(), port).alias("port"), _roles(
        {"ip": F.col("sip"), "tx": F.lit(True), "peer": F.col("dip"), "own_mac": F.col("smac"), "serves": ~served_by_dst},
        {"ip": F.col("dip"), "tx": F.lit(False), "peer": F.col("sip"), "own_mac": F.col("dmac"), "serves": served_by_dst},
    )).withColumn("rx", ~F.col("tx"))
    found = each.groupBy("ip").agg(*_sums(), *_sided("tx", "tx"), *_sided("rx", "rx"), listed(F.collect_set("l4")).alias("protocols"), listed(F.collect_set("own_mac")).alias("macs"), *_seen())
    counts = each.where("port IS NOT NULL").groupBy("ip", "serves", "port").agg(F.count("*").alias("n"))
    served = top_keys(counts.where("serves"), ["ip"], "port", "n", 5, "ports_served")
    used = top_keys(counts.where("NOT serves"), ["ip"], "port", "n", 5, "ports_used")
    out = found.join(members(each, ["ip"], "peer", "peer_count"), "ip").join(served, "ip", "left").join(used, "ip", "left").fillna("", ["ports_served", "ports_used"])
    return out.withColumn("duration_s", F.round((F.col("last_ts") - F.col("first_ts")) / F.lit(1e9), 3))


def ports(p: DataFrame) -> DataFrame:
    each = report_rows(p).where("pp IS NOT NULL").select("pp", "origlen", "ts_nanos", _roles({"port": F.col("sport"), "src": F.lit(True), "host": F.col("sip")}, {"port": F.col("dport"), "src": F.lit(False), "host": F.col("dip")}))
    each = each.withColumn("dst", ~F.col("src"))
    each = each.withColumnRenamed("pp", "proto")
    found = each.groupBy("proto", "port").agg(*_sums(), *_sided("src", "as_src"), *_sided("dst", "as_dst"), *_seen())
    found = found.join(members(each, ["proto", "port"], "host", "host_count"), ["proto", "port"], "left").fillna({"host_count": 0})
    return found.withColumn("service", F.coalesce(service_name(F.col("port")), F.lit("")))


def conversations(p: DataFrame) -> DataFrame:
    """Address pairs ordered as texts."""
    r = report_rows(p.where(ADDRESSED)).withColumn("ab", F.col("sip") <= F.col("dip")).withColumn("ba", ~F.col("ab"))
    port = F.when(F.col("pp").isNotNull(), F.concat("pp", F.lit("/"), F.least("sport", "dport").cast("string")))
    each, keys = r.withColumns({"ip_a": F.least("sip", "dip"), "ip_b": F.greatest("sip", "dip"), "port": port}), ["ip_a", "ip_b"]
    found = each.groupBy(*keys).agg(*_sums(), *_sided("ab", "a_to_b"), *_sided("ba", "b_to_a"), listed(F.collect_set("l4")).alias("protocols"), *_seen())
    out = found.join(members(each, keys, "port", "n_ports", "dst_ports", 15).drop("n_ports"), keys, "left").fillna("", ["dst_ports"])
    return out.withColumn("duration_s", F.round((F.col("last_ts") - F.col("first_ts")) / F.lit(1e9), 3))


def flows(p: DataFrame) -> DataFrame:
    """Both directions of a connection as one row, ends ordered by (address text, port), with its state."""
    a, b = F.struct(F.col("sip").alias("ip"), F.col("sport").alias("port")), F.struct(F.col("dip").alias("ip"), F.col("dport").alias("port"))
    r = report_rows(p.where(ADDRESSED)).where("pp IS NOT NULL").withColumns({"a": F.least(a, b), "b": F.greatest(a, b), "ab": a <= b, "ba": ~(a <= b)})
    bit = lambda n: F.coalesce(F.col("tcp_flags").bitwiseAND(n) != 0, F.lit(False)) & (F.col("pp") == "tcp")
    found = r.groupBy("pp", "a", "b").agg(*_sums(), *_sided("ab", "a_to_b"), *_sided("ba", "b_to_a"), F.count_if(bit(2) & ~bit(16)).alias("syn"), F.count_if(bit(2) & bit(16)).alias("syn_ack"), F.count_if(bit(4)).alias("rst"), *_seen())
    one_way = (F.col("a_to_b_packets") == 0) | (F.col("b_to_a_packets") == 0)
    tcp = F.when((F.col("syn") > 0) & (F.col("syn_ack") > 0), "handshake").when(F.col("syn") > 0, "syn-no-reply").when(one_way, "one-way").otherwise("mid-stream")
    state = F.when(F.col("pp") == "tcp", F.concat(tcp, F.when(F.col("rst") > 0, "+rst").otherwise(""))).when(one_way, "one-way").otherwise("bidir")
    names = {"proto": F.col("pp"), "ip_a": F.col("a.ip"), "port_a": F.col("a.port"), "ip_b": F.col("b.ip"), "port_b": F.col("b.port"), "state": state}
    service = F.coalesce(service_name(F.col("b.port")), service_name(F.col("a.port")), F.lit(""))
    return found.withColumns(names | {"service": service, "duration_s": F.round((F.col("last_ts") - F.col("first_ts")) / F.lit(1e9), 3)}).drop("pp", "a", "b")


def _server() -> Column:
    return F.when(F.coalesce(F.col("dport"), F.lit(0)) != 0, F.concat("dip", F.lit(":"), F.col("dport").cast("string"))).otherwise(F.col("dip"))


def _named(each: DataFrame, keys: list[str], *counts: Column) -> DataFrame:
    """Counts, distinct clients (ten shown) and servers (five shown) of each key; absent keys group as one."""
    same = F.struct(*keys)
    each = each.withColumn("key", same)
    out = each.groupBy("key").agg(*counts, *_seen())
    for item, n, shown, cap in (("client", "client_count", "clients", 10), ("server", "n_servers", "servers", 5)):
        out = out.join(members(each, ["key"], item, n, shown, cap, more=""), "key", "left").fillna({n: 0, shown: ""})
    order = [c for c in out.columns if c not in ("key", "n_servers", "client_count", "clients", "servers", "first_ts", "last_ts")]
    return out.select(*(F.col("key")[k].alias(k) for k in keys), *order, "client_count", "clients", "servers", "first_ts", "last_ts")


def dns(rows: DataFrame) -> DataFrame:
    """rows: qname, response boolean, sip, dip, ts_nanos; the roles swap on a response."""
    client, server = (F.when(F.col("response"), x).otherwise(y) for x, y in ((F.col("dip"), F.col("sip")), (F.col("sip"), F.col("dip"))))
    each = rows.withColumns({"client": client, "server": server}).withColumnRenamed("qname", "name")
    return _named(each, ["name"], F.count("*").alias("queries_and_responses"), F.count_if("response").alias("responses"))


def _asked(rows: DataFrame, keys: list[str], count: str) -> DataFrame:
    return _named(rows.withColumns({"client": F.col("sip"), "server": _server()}), keys, F.count("*").alias(count))


def tls_sni(rows: DataFrame) -> DataFrame:
    """rows: server_name, sip, dip, dport, ts_nanos."""
    return _asked(rows.where("server_name <> ''"), ["server_name"], "client_hellos")


def http(rows: DataFrame) -> DataFrame:
    """rows: host, method, uri, user_agent, sip, dip, dport, ts_nanos; those with a host or a method count."""
    return _asked(rows.where("host <> '' OR method <> ''"), ["host", "method", "uri", "user_agent"], "requests")


TABLES = {"macs": (macs, "packets", ["mac"]), "ips": (ips, "packets", ["ip"]), "ports": (ports, "packets", ["proto", "port"]), "conversations": (conversations, "packets", ["ip_a", "ip_b"]), "flows": (flows, "packets", ["proto", "ip_a", "port_a", "ip_b", "port_b"]), "protocols": (protocols, "packets", ["kind", "protocol"])}


def ordered(name: str, p: DataFrame) -> DataFrame:
    """A table in its report order; ties by key."""
    make, by, keys = TABLES[name]
    return make(p).orderBy(*(["kind"] if name == "protocols" else []), F.desc(by), *keys)


def summary(p: DataFrame) -> dict:
    """Totals and the number of rows of each table, for the report's summary file."""
    facts = p.agg(F.count("*").alias("packets"), F.sum("origlen").alias("bytes"), F.min("ts_nanos").alias("first_ts"), F.max("ts_nanos").alias("last_ts")).first().asDict()
    return facts | {"tables": {name: make(p).count() for name, (make, _, _) in TABLES.items()}}
