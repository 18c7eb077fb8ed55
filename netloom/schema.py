"""The packets table: one row per captured packet."""

from pyspark.sql import types as T

#: Absent fields are null; ethertype 0 and ts_nanos 0 also stand for absent. MAC and IPv4 addresses are integers, IPv6
#: addresses 16 bytes; both sort and range-prune as their texts' values do. ts is ts_nanos cut to microseconds.
PACKETS = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("packet_no", T.LongType(), False),
    T.StructField("ts_nanos", T.LongType()), T.StructField("record_offset", T.LongType()), T.StructField("data_offset", T.LongType()),
    T.StructField("caplen", T.LongType()), T.StructField("origlen", T.LongType()), T.StructField("linktype", T.IntegerType()),
    T.StructField("frame", T.BinaryType()),
])
#: What dissection adds.
FIELDS = T.StructType([
    T.StructField("has_eth", T.BooleanType()), T.StructField("mac_src", T.LongType()), T.StructField("mac_dst", T.LongType()),
    T.StructField("ethertype", T.IntegerType()), T.StructField("vlan", T.IntegerType()), T.StructField("ip_version", T.IntegerType()),
    T.StructField("ip4_src", T.LongType()), T.StructField("ip4_dst", T.LongType()), T.StructField("ip6_src", T.BinaryType()), T.StructField("ip6_dst", T.BinaryType()),
    T.StructField("ip_proto", T.IntegerType()), T.StructField("l4_proto", T.IntegerType()), T.StructField("sport", T.IntegerType()), T.StructField("dport", T.IntegerType()),
    T.StructField("tcp_flags", T.IntegerType()), T.StructField("payload_at", T.IntegerType()),
])
ETHERNET, RAW, NULL, LOOP = 1, 101, 0, 108  # link types
GROUP = 65_536  # packets in a row group
