"""Packets made from the driver's events table: a portable mapping that any SQL engine computes alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARP, TCP, UDP = "event_id % 10 = 8", "event_id % 10 < 5", "event_id % 10 BETWEEN 5 AND 7"
V6 = "event_id % 13 = 5 AND event_id % 10 <> 8"
BACK = "event_id % 3 = 1"  # the server answers
CLIENT_PORT = "CASE WHEN event_id % 97 = 0 THEN 443 ELSE 1024 + (user_id * 37) % 60000 END"
SERVER_PORT = "CASE WHEN event_id % 97 = 0 THEN 443 WHEN user_id % 4 = 0 THEN 53 WHEN user_id % 4 = 1 THEN 80 WHEN user_id % 4 = 2 THEN 443 ELSE 5900 + user_id % 11 END"
CLIENT_MAC, SERVER_MAC = "2199023255552 + user_id % 40", "2199023255552 + (user_id * 7) % 40"
CLIENT_IP, SERVER_IP = "167772160 + user_id", "3232235520 + (user_id * 7 + event_id % 3) % 256"
#: name, expression over event_id, user_id, value and us (microseconds); all are BIGINT, absent is null.
COLUMNS = {
    "packet_no": "event_id",
    "ts_nanos": "us * 1000 + event_id % 1000",
    "origlen": "60 + CAST(floor(value) AS BIGINT)",
    "ethertype": f"CASE WHEN {ARP} THEN 2054 WHEN {V6} THEN 34525 WHEN event_id % 101 = 0 THEN 0 ELSE 2048 END",
    "ip_proto": f"CASE WHEN {TCP} THEN 6 WHEN {UDP} THEN 17 WHEN event_id % 10 = 9 THEN CASE WHEN event_id % 30 = 9 THEN 253 ELSE 1 END END",
    "mac_src": f"CASE WHEN {BACK} THEN {SERVER_MAC} ELSE {CLIENT_MAC} END",
    "mac_dst": f"CASE WHEN {ARP} THEN 281474976710655 WHEN {BACK} THEN {CLIENT_MAC} ELSE {SERVER_MAC} END",
    "ip4_src": f"CASE WHEN NOT ({ARP}) AND NOT ({V6}) THEN CASE WHEN {BACK} THEN {SERVER_IP} ELSE {CLIENT_IP} END END",
    "ip4_dst": f"CASE WHEN NOT ({ARP}) AND NOT ({V6}) THEN CASE WHEN {BACK} THEN {CLIENT_IP} ELSE {SERVER_IP} END END",
    "v6_src": f"CASE WHEN {V6} THEN CASE WHEN {BACK} THEN 7 ELSE user_id % 64 END END",
    "v6_dst": f"CASE WHEN {V6} THEN CASE WHEN {BACK} THEN user_id % 64 ELSE 7 END END",
    "sport": f"CASE WHEN event_id % 10 < 8 THEN CASE WHEN {BACK} THEN {SERVER_PORT} ELSE {CLIENT_PORT} END END",
    "dport": f"CASE WHEN event_id % 10 < 8 THEN CASE WHEN {BACK} THEN {CLIENT_PORT} ELSE {SERVER_PORT} END END",
    "vlan": "CASE WHEN event_id % 7 = 0 THEN 10 + event_id % 3 END",
    "tcp_flags": f"CASE WHEN {TCP} THEN CASE WHEN event_id % 20 = 0 THEN 2 WHEN event_id % 20 IN (1, 13) THEN 18 WHEN event_id % 50 = 14 THEN 4 ELSE 24 END END",
}
INTS = ("ethertype", "ip_proto", "sport", "dport", "vlan", "tcp_flags")
#: The same for DuckDB, as the relation `packets`.
PACKETS_SQL = "e AS (SELECT *, epoch_us(ts) AS us FROM events), packets AS (SELECT " + ", ".join(f"CAST({x} AS BIGINT) AS {n}" for n, x in COLUMNS.items()) + " FROM e)"


def v6_address(n) -> F.Column:
    """2001:db8:0:n::n"""
    part = F.lpad(F.hex(n), 4, "0")
    return F.when(n.isNotNull(), F.unhex(F.concat(F.lit("20010DB80000"), part, F.lit("000000000000"), part)))


def packets_of(events: DataFrame) -> DataFrame:
    """events, batch or streaming, as packets."""
    own = events.select("event_id", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = own.selectExpr(*(f"CAST({x} AS {'INT' if n in INTS else 'BIGINT'}) AS {n}" for n, x in COLUMNS.items()))
    more = {"has_eth": F.lit(True), "ip6_src": v6_address(F.col("v6_src")), "ip6_dst": v6_address(F.col("v6_dst")), "caplen": F.col("origlen"), "linktype": F.lit(1)}
    return rows.withColumns(more)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def documents_as_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as frames, for payload searches."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("packet_no"), F.col("text").cast("binary").alias("frame"))
