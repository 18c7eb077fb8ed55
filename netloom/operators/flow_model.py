"""What a packet adds to what its flow predicts: deltas and residuals, as window functions over the flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.scalars import wrapped

#: Link layer, addresses of either family, protocol and ports: null where a packet has none.
FLOW = ("mac_src", "mac_dst", "vlan", "ethertype", "ip4_src", "ip4_dst", "ip6_src", "ip6_dst", "ip_proto", "sport", "dport")


def flow_window(keys: tuple[str, ...] = FLOW, order: str = "packet_no"):
    """A unidirectional flow in file order."""
    return Window.partitionBy(*keys).orderBy(order)


def ip_id_delta(p: DataFrame, keys=FLOW) -> DataFrame:
    """16-bit signed change of ip_id in the flow, from 0."""
    return p.withColumn("ip_id_delta", wrapped(F.col("ip_id") - F.lag("ip_id", 1, 0).over(flow_window(keys)), 16))


def seq_residual(p: DataFrame, keys=FLOW) -> DataFrame:
    """32-bit signed difference of seq from the predicted one: the last seq, its payload, and one for SYN and FIN."""
    flags = F.col("tcp_flags")
    ahead = F.col("seq") + F.col("payload_len") + F.shiftright(flags, 1).bitwiseAND(1) + flags.bitwiseAND(1)
    d = p.withColumn("__next", F.pmod(ahead, F.lit(1 << 32)))
    return d.withColumn("seq_residual", wrapped(F.col("seq") - F.lag("__next", 1, 0).over(flow_window(keys)), 32)).drop("__next")


def ack_delta(p: DataFrame, keys=FLOW) -> DataFrame:
    return p.withColumn("ack_delta", wrapped(F.col("ack") - F.lag("ack", 1, 0).over(flow_window(keys)), 32))


def ts_delta(p: DataFrame, block: int = 65_536) -> DataFrame:
    """Time since the packet before in its block of packets; from 0 at the block's start."""
    w = Window.partitionBy(F.floor(F.col("packet_no") / block)).orderBy("packet_no")
    return p.withColumn("ts_delta", F.col("ts_nanos") - F.lag("ts_nanos", 1, 0).over(w))


def flow_ids(p: DataFrame, keys=FLOW, bucket: int = 1 << 20) -> DataFrame:
    """(keys, first_packet, flow_id): dense ids by first appearance, from 0. Flows are numbered within buckets of packet
    numbers, and each bucket starts where the ones before end, so no task sees all flows."""
    first = p.groupBy(*keys).agg(F.min("packet_no").alias("first_packet")).withColumn("__b", F.floor(F.col("first_packet") / bucket))
    sizes = first.groupBy("__b").agg(F.count("*").alias("__n"))  # one row per bucket of a million packets
    starts = sizes.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("first_packet"))
    return first.withColumn("__in", inside).join(starts, "__b").select(*keys, "first_packet", (F.col("__start") + F.col("__in") - 1).alias("flow_id"))
