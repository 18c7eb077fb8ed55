"""Names of protocols, ethertypes and services, and their lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# IANA protocol numbers and their keywords.
IP_PROTOCOLS = {
    0: "hopopt", 1: "icmp", 2: "igmp", 3: "ggp", 4: "ipv4", 5: "st", 6: "tcp", 7: "cbt", 8: "egp", 9: "igp",
    10: "bbn-rcc-mon", 11: "nvp-ii", 12: "pup", 14: "emcon", 15: "xnet", 16: "chaos", 17: "udp", 18: "mux", 19: "dcn-meas",
    20: "hmp", 21: "prm", 22: "xns-idp", 23: "trunk-1", 24: "trunk-2", 25: "leaf-1", 26: "leaf-2", 27: "rdp", 28: "irtp", 29: "iso-tp4",
    30: "netblt", 31: "mfe-nsp", 32: "merit-inp", 33: "dccp", 34: "3pc", 35: "idpr", 36: "xtp", 37: "ddp", 38: "idpr-cmtp", 39: "tp++",
    40: "il", 41: "ipv6", 42: "sdrp", 43: "ipv6-route", 44: "ipv6-frag", 45: "idrp", 46: "rsvp", 47: "gre", 48: "dsr", 49: "bna",
    50: "esp", 51: "ah", 52: "i-nlsp", 54: "narp", 55: "min-ipv4", 56: "tlsp", 57: "skip", 58: "icmpv6", 59: "ipv6-nonxt",
    60: "ipv6-opts", 62: "cftp", 64: "sat-expak", 65: "kryptolan", 66: "rvd", 67: "ippc", 69: "sat-mon",
    70: "visa", 71: "ipcv", 72: "cpnx", 73: "cphb", 74: "wsn", 75: "pvp", 76: "br-sat-mon", 77: "sun-nd", 78: "wb-mon", 79: "wb-expak",
    80: "iso-ip", 81: "vmtp", 82: "secure-vmtp", 83: "vines", 84: "iptm", 85: "nsfnet-igp", 86: "dgp", 87: "tcf", 88: "eigrp", 89: "ospf",
    90: "sprite-rpc", 91: "larp", 92: "mtp", 93: "ax.25", 94: "ipip", 96: "scc-sp", 97: "etherip", 98: "encap",
    100: "gmtp", 101: "ifmp", 102: "pnni", 103: "pim", 104: "aris", 105: "scps", 106: "qnx", 107: "a/n", 108: "ipcomp", 109: "snp",
    110: "compaq-peer", 111: "ipx-in-ip", 112: "vrrp", 113: "pgm", 115: "l2tp", 116: "ddx", 117: "iatp", 118: "stp", 119: "srp",
    120: "uti", 121: "smp", 123: "ptp", 124: "isis", 125: "fire", 126: "crtp", 127: "crudp", 128: "sscopmce", 129: "iplt",
    130: "sps", 131: "pipe", 132: "sctp", 133: "fc", 134: "rsvp-e2e-ignore", 135: "mobility", 136: "udplite", 137: "mpls-in-ip", 138: "manet", 139: "hip",
    140: "shim6", 141: "wesp", 142: "rohc", 143: "ethernet", 144: "aggfrag", 145: "nsh", 146: "homa", 147: "bit-emu", 255: "reserved",
}
# Ethertypes and their names.
ETHERTYPES = {
    0x0800: "ipv4", 0x0806: "arp", 0x22F0: "avtp", 0x8035: "rarp", 0x809B: "appletalk", 0x8100: "vlan", 0x86DD: "ipv6",
    0x8809: "slow-protocols", 0x8847: "mpls", 0x8848: "mpls-mcast", 0x8863: "pppoe-disc", 0x8864: "pppoe", 0x888E: "eapol",
    0x8892: "profinet", 0x88A8: "qinq", 0x88B8: "goose", 0x88B9: "gse", 0x88BA: "sampled-values", 0x88CC: "lldp",
    0x88E1: "homeplug-av", 0x88E5: "macsec", 0x88F7: "ptp", 0x8906: "fcoe", 0x8914: "fip", 0x9000: "loopback-test",
}
# Common ports. The whole IANA registry is read from its CSV by services_from_csv().
SERVICES = {
    20: "ftp-data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "domain", 67: "bootps", 68: "bootpc", 69: "tftp", 80: "http",
    88: "kerberos", 110: "pop3", 111: "sunrpc", 123: "ntp", 135: "epmap", 137: "netbios-ns", 138: "netbios-dgm", 139: "netbios-ssn",
    143: "imap", 161: "snmp", 162: "snmptrap", 179: "bgp", 389: "ldap", 443: "https", 445: "microsoft-ds", 465: "submissions",
    500: "isakmp", 502: "mbap", 514: "syslog", 515: "printer", 520: "router", 546: "dhcpv6-client", 547: "dhcpv6-server", 554: "rtsp",
    587: "submission", 631: "ipp", 636: "ldaps", 853: "domain-s", 873: "rsync", 993: "imaps", 995: "pop3s", 1194: "openvpn",
    1433: "ms-sql-s", 1521: "oracle", 1723: "pptp", 1812: "radius", 1883: "mqtt", 1900: "ssdp", 2049: "nfs", 3306: "mysql",
    3389: "ms-wbt-server", 3478: "stun", 4500: "ipsec-nat-t", 4789: "vxlan", 5060: "sip", 5061: "sips", 5222: "xmpp-client",
    5353: "mdns", 5355: "llmnr", 5432: "postgresql", 5672: "amqp", 5900: "rfb", 6379: "redis", 6443: "sun-sr-https",
    8080: "http-alt", 8443: "pcsync-https", 8883: "secure-mqtt", 9100: "pdl-datastream", 9200: "wap-wsp", 11211: "memcache",
    27017: "mongodb", 51820: "wireguard",
}


def services(spark: SparkSession, extra: dict[int, str] | None = None) -> DataFrame:
    """(port, service); at most 65,536 rows, so it may be broadcast."""
    return spark.createDataFrame(sorted((SERVICES | (extra or {})).items()), "port int, service string")


def services_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """(port, service) from the IANA service-name CSV: single ports with a name, the TCP entry first, then the shortest name."""
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    named = rows.select(F.col("Service Name").alias("service"), F.expr("try_cast(`Port Number` AS int)").alias("port"), F.col("Transport Protocol").alias("transport")).where("service IS NOT NULL AND port BETWEEN 1 AND 65535")
    rank = F.struct(F.when(F.col("transport") == "tcp", 0).when(F.col("transport") == "udp", 1).otherwise(2), F.length("service"), "service")
    return named.groupBy("port").agg(F.min_by("service", rank).alias("service"))


def ip_protocols(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(IP_PROTOCOLS.items()), "number int, keyword string")


def ethertypes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(ETHERTYPES.items()), "ethertype int, name string")


def _named(number: Column, table: dict[int, str]) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), number)


def service_name(port: Column, table: dict[int, str] | None = None) -> Column:
    return _named(port, table or SERVICES)


def ethertype_name(ethertype: Column) -> Column:
    return _named(ethertype, ETHERTYPES)


def proto_kind(ip_proto: Column, ethertype: Column) -> Column:
    """0 an IP protocol, 1 an ethertype, 2 neither; protocols sort by kind, then number."""
    return F.when(ip_proto.isNotNull(), 0).when(F.coalesce(ethertype, F.lit(0)) != 0, 1).otherwise(2)


def proto_number(ip_proto: Column, ethertype: Column) -> Column:
    return F.coalesce(ip_proto, F.when(ethertype != 0, ethertype), F.lit(0))


def proto_name(ip_proto: Column, ethertype: Column) -> Column:
    by_ip = F.coalesce(_named(ip_proto, IP_PROTOCOLS), F.format_string("ipproto-%d", ip_proto))
    by_ether = F.coalesce(ethertype_name(ethertype), F.concat(F.lit("ether-0x"), F.lower(F.lpad(F.hex(ethertype.cast("long")), 4, "0"))))
    return F.when(ip_proto.isNotNull(), by_ip).when(F.coalesce(ethertype, F.lit(0)) != 0, by_ether).otherwise("other")
