"""Traffic aggregates over a packets table. bytes are always wire lengths (origlen).

Addresses are grouped by a text key that sorts as (family, bytes): '4' or '6' and the address in hex. Groupings have a
map-side part, so a hot device or conversation is one row per task before the shuffle; sets hold at most 65,536 ports
or a few hundred protocols per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.names import proto_kind, proto_name, proto_number
from netloom.plans.filters import bounded, may_match, packet_test, parse
from netloom.schema import GROUP

PORTS_SHOWN = 256


def with_proto(p: DataFrame) -> DataFrame:
    args = F.col("ip_proto"), F.col("ethertype")
    return p.withColumns({"proto_kind": proto_kind(*args), "proto_number": proto_number(*args), "proto": proto_name(*args)})


def address_key(side: str) -> Column:
    v4, v6 = F.col(f"ip4_{side}"), F.col(f"ip6_{side}")
    return F.coalesce(F.concat(F.lit("4"), F.lpad(F.hex(v4), 8, "0")), F.concat(F.lit("6"), F.hex(v6)))


def seen(ts: str = "ts_nanos") -> list[Column]:
    """The first packet's time in file order and the latest time."""
    return [F.min_by(ts, "packet_no").alias("first_seen_in_order"), F.max(ts).alias("last_ts")]


def sizes() -> list[Column]:
    return [F.count("*").alias("packets"), F.sum("origlen").alias("bytes")]


def proto_set() -> Column:
    """Names in the order of (kind, number)."""
    return F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("proto_kind", "proto_number", "proto"))), lambda x: x["proto"]), " ").alias("protos")


def totals(p: DataFrame) -> DataFrame:
    known = F.when(F.col("ts_nanos") != 0, F.col("ts_nanos"))
    return p.agg(F.count("*").alias("packets"), F.coalesce(F.sum("origlen"), F.lit(0)).alias("bytes"), F.min(known).alias("first_ts"), F.max(known).alias("last_ts"))


def protocol_mix(p: DataFrame) -> DataFrame:
    return with_proto(p).groupBy("proto_kind", "proto_number", "proto").agg(*sizes())


def port_totals(p: DataFrame) -> DataFrame:
    """A packet counts at each of its ports, twice if they are equal."""
    return p.select(F.explode(F.array("sport", "dport")).alias("port")).where("port IS NOT NULL").groupBy("port").agg(F.count("*").alias("packets"))


def _mac_roles(p: DataFrame) -> DataFrame:
    return p.where("mac_src IS NOT NULL").withColumn("mac", F.explode(F.array("mac_src", "mac_dst")))


def mac_stats(p: DataFrame) -> DataFrame:
    """Both ends of a packet count; a packet to its own sender counts twice."""
    return _mac_roles(with_proto(p)).groupBy("mac").agg(*sizes(), *seen(), proto_set())


def mac_pairs(p: DataFrame) -> DataFrame:
    return p.where("mac_src IS NOT NULL").groupBy("mac_src", "mac_dst").agg(*sizes())


def port_pairs(p: DataFrame) -> DataFrame:
    return p.where("sport IS NOT NULL AND dport IS NOT NULL").groupBy("sport", "dport").agg(*sizes())


def conversations(p: DataFrame) -> DataFrame:
    """By unordered address pair, the smaller (family, bytes) first; no cap on pairs. Over 256 ports: ports_overflow."""
    ends = with_proto(p).withColumns({"src": address_key("src"), "dst": address_key("dst")}).where("src IS NOT NULL")
    pair = ends.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    found = pair.groupBy("a", "b").agg(*sizes(), *seen(), proto_set(), F.collect_set("sport").alias("s"), F.collect_set("dport").alias("d"))
    ports = F.array_union("s", "d")
    return found.withColumns({"n_ports": F.size(ports), "ports_overflow": F.size(ports) > PORTS_SHOWN, "span_s": F.greatest(F.col("last_ts") - F.col("first_seen_in_order"), F.lit(0)) / F.lit(1e9)}).drop("s", "d")


def directional_macs(p: DataFrame) -> DataFrame:
    """Totals, packets sent and packets received of each device, in one grouping."""
    roles = p.where("mac_src IS NOT NULL").select("origlen", F.explode(F.array(F.struct(F.col("mac_src").alias("mac"), F.lit(1).alias("tx")), F.struct(F.col("mac_dst").alias("mac"), F.lit(0).alias("tx")))).alias("r"))
    return roles.select("origlen", "r.*").groupBy("mac").agg(*sizes(), F.sum("tx").alias("sent"), F.sum(1 - F.col("tx")).alias("received"))


def packets_per_ip(p: DataFrame) -> DataFrame:
    """Packets of an address's conversations, on both ends."""
    ends = p.select(F.explode(F.array(address_key("src"), address_key("dst"))).alias("ip"))
    return ends.where("ip IS NOT NULL").groupBy("ip").agg(F.count("*").alias("packets"))


BOUNDED = ("mac_src", "mac_dst", "ip4_src", "ip4_dst", "ip6_src", "ip6_dst", "ethertype", "vlan", "ip_proto", "sport", "dport", "origlen")


def group_no(size: int) -> Column:
    return F.floor(F.col("packet_no") / size).cast("long").alias("group_no")


def bounds(columns: list[str] | tuple[str, ...] = BOUNDED) -> list[Column]:
    """What may_match() tests of a group."""
    return [f(c).alias(f"{c}_{side}") for c in columns for f, side in ((F.min, "low"), (F.max, "high"))]


def row_groups(p: DataFrame, size: int = GROUP, *more: Column) -> DataFrame:
    """Summaries of consecutive runs of packets, with more aggregates if given; times of 0 are included."""
    return p.groupBy(group_no(size)).agg(*sizes(), F.min("ts_nanos").alias("min_ts"), F.max("ts_nanos").alias("max_ts"), F.array_join(F.transform(F.array_sort(F.collect_set("ip_proto")), lambda x: x.cast("string")), " ").alias("ip_protos"), F.min("sport").alias("min_sport"), F.max("dport").alias("max_dport"), *more)


def shares(p: DataFrame) -> DataFrame:
    """Each protocol's share of the packets, in percent."""
    mix = protocol_mix(p)
    return mix.select("proto", "packets", F.round(F.col("packets") * 100.0 / F.greatest(F.sum("packets").over(Window.partitionBy()), F.lit(1)), 4).alias("share"))


def distinct_macs(p: DataFrame) -> DataFrame:
    return _mac_roles(p).agg(F.count_distinct("mac").alias("macs"))


def top(df: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(n)


def page(p: DataFrame, start: int, rows: int = 1024) -> DataFrame:
    """Rows of a window by packet number, which prunes row groups."""
    return p.where(F.col("packet_no").between(start, start + rows - 1))


def query_counts(p: DataFrame, text: str, size: int = GROUP) -> DataFrame:
    """(matched, groups_total, groups_scanned) of a filter in one pass; groups whose bounds rule a match out aren't scanned."""
    tree = parse(text)
    groups = p.groupBy(group_no(size)).agg(F.count_if(packet_test(text)).alias("matched"), *bounds(bounded(tree)))
    return groups.agg(F.coalesce(F.sum("matched"), F.lit(0)).alias("matched"), F.count("*").alias("groups_total"), F.count_if(may_match(tree)).alias("groups_scanned"))
