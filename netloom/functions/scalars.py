"""Scalar functions over packet values, all native Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def fmt_mac(mac: Column) -> Column:
    return F.regexp_replace(F.lpad(F.lower(F.hex(mac)), 12, "0"), "(..)(?!$)", "$1:")


def fmt_ip4(ip: Column) -> Column:
    part = lambda k: F.shiftright(ip, k).bitwiseAND(255).cast("string")
    return F.when(ip.isNotNull(), F.concat_ws(".", part(24), part(16), part(8), part(0)))


def fmt_ip6(ip: Column) -> Column:
    """As RFC 5952: lower case, no leading zeros, the first of the longest runs of two or more zero groups as ::"""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.hex(ip)), "(.{4})(?!$)", "$1:"), "(^|:)0{1,3}(?=[0-9a-f])", "$1")
    runs = F.regexp_extract_all(plain, F.lit("(?<![0-9a-f])0(?::0)+(?![0-9a-f])"), F.lit(0))
    longest = F.array_max(runs)  # runs differ in length alone, so the greatest text is the longest
    short = F.regexp_replace(plain, F.concat(F.lit("^(.*?)(?:^|:)"), longest, F.lit("(?::|$)")), F.lit("$1::"))
    return F.when(ip.isNotNull(), F.coalesce(short, plain))


def fmt_addr(ip4: Column, ip6: Column) -> Column:
    return F.coalesce(fmt_ip4(ip4), fmt_ip6(ip6))


def _moment(nanos: Column) -> Column:
    return F.timestamp_micros(F.floor(nanos.cast("decimal(20,0)") / 1000).cast("long"))


def fmt_ts(nanos: Column, short: bool = False) -> Column:
    """UTC with milliseconds, cut; '-' for 0. The session's time zone must be UTC."""
    moment = _moment(nanos)
    return F.when(nanos == 0, "-").otherwise(F.date_format(moment, "HH:mm:ss.SSS" if short else "yyyy-MM-dd HH:mm:ss.SSS"))


def iso(nanos: Column) -> Column:
    """UTC as ISO 8601 with milliseconds."""
    return F.date_format(_moment(nanos), "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")


def fixed(x: Column, digits: int) -> Column:
    """A double with so many decimals, the exact binary value rounded half even as Python and Rust do; format_string
    rounds the shortest decimal half up."""
    scale, a = 10**digits, F.abs(x)
    high = a * 134217729.0 - (a * 134217729.0 - a)  # Veltkamp: the product with a small integer is exact in two parts
    twice = a * (2.0 * scale)
    rest = (high * (2.0 * scale) - twice) + (a - high) * (2.0 * scale)
    k = F.floor(a * float(scale))
    over = (twice - (k * 2 + 1).cast("double")) + rest
    whole = k + F.when((over > 0) | (over == 0) & (k % 2 == 1), 1).otherwise(0)
    text = F.floor(whole / scale).cast("string")
    if digits:
        text = F.concat(text, F.lit("."), F.lpad((whole % scale).cast("string"), digits, "0"))
    return F.when(a < 1e12, F.concat(F.when(x.cast("string").startswith("-"), "-").otherwise(""), text)).otherwise(F.format_string(f"%.{digits}f", x))


def _scaled(n: Column, units: list[str], base: str, digits: list[int]) -> Column:
    out = F.concat(n.cast("string"), F.lit(base))
    for k, (unit, d) in enumerate(zip(units, digits, strict=True), 1):
        out = F.when(n >= 1000**k, F.concat(fixed(n.cast("double") / float(1000**k), d), F.lit(unit))).otherwise(out)
    return out


def fmt_bytes(n: Column) -> Column:
    """Decimal units, one decimal: 999 B, 1.0 KB, ... TB."""
    return _scaled(n, [" KB", " MB", " GB", " TB"], " B", [1, 1, 1, 1])


def fmt_archive_bytes(n: Column) -> Column:
    """As fmt_bytes up to GB, which has two decimals."""
    return _scaled(n, [" KB", " MB", " GB"], " B", [1, 1, 2])


def human(n: Column, unit: str = "") -> Column:
    out = F.format_string(f"%.0f{unit}", n.cast("double"))
    for k, s in enumerate("KMGTP", 1):
        out = F.when(F.abs(n) >= 1000.0**k, F.format_string(f"%.1f{s}{unit}", n.cast("double") / 1000.0**k)).otherwise(out)
    return out


def fmt_duration(s: Column) -> Column:
    x = s.cast("double")
    steps = [(1, x * 1000.0, 0, " ms"), (120, x, 1, " s"), (7200, x / 60.0, 1, " min"), (172800, x / 3600.0, 1, " h")]
    out = F.concat(fixed(x / 86400.0, 1), F.lit(" d"))
    for limit, value, digits, unit in reversed(steps):
        out = F.when(s < limit, F.concat(fixed(value, digits), F.lit(unit))).otherwise(out)
    return out


def trim_float(x: Column) -> Column:
    """No decimals from 10 on, else two."""
    return F.when(x >= 10, F.format_string("%.0f", x)).otherwise(F.format_string("%.2f", x))


def tcp_flags(flags: Column) -> Column:
    names = ["FIN", "SYN", "RST", "PSH", "ACK", "URG"]
    some = F.array(*(F.when(flags.bitwiseAND(1 << k) != 0, name) for k, name in enumerate(names)))
    return F.when(flags.isNotNull(), F.coalesce(F.nullif(F.array_join(some, ","), F.lit("")), F.lit("none")))


def slug(text: Column) -> Column:
    """An identifier: lower-case ASCII letters and digits, runs of others as one _, none at the ends."""
    low = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(low == "", "field").when(low.rlike("^[0-9]"), F.concat(F.lit("f_"), low)).otherwise(low)


def zigzag(n: Column) -> Column:
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(n: Column) -> Column:
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-n.bitwiseAND(1))


def canonical_timestamp(text: Column) -> Column:
    """Whether a decimal timestamp is spelt in the one way that parses and prints back the same."""
    return text.rlike(r"^(0|[1-9][0-9]{0,17})(\.[0-9]{1,18})?$")


def wrapped(n: Column, bits: int) -> Column:
    """n as a signed integer of that many bits."""
    half = 1 << (bits - 1)
    return F.pmod(n + half, F.lit(1 << bits)) - half


# ---- bytes and bits -------------------------------------------------------------------------------------------------


def uint_be(data: Column, at: int | Column, size: int) -> Column:
    """Big-endian unsigned integer of up to 7 bytes; null past the end. Bytes count from 0."""
    at = F.lit(at) if isinstance(at, int) else at
    part = F.substring(data, at + 1, F.lit(size))
    return F.when((at >= 0) & (F.length(data) >= at + size), F.conv(F.hex(part), 16, 10).cast("long"))


def uint_le(data: Column, at: int, size: int) -> Column:
    parts = [F.hex(F.substring(data, at + 1 + k, 1)) for k in reversed(range(size))]
    return F.when(F.length(data) >= at + size, F.conv(F.concat(*parts), 16, 10).cast("decimal(20,0)" if size == 8 else "long"))


def bits(data: Column, start: int, count: int) -> Column:
    """`count` bits (1 to 56 at any offset) from bit `start`, most significant first; null past the end."""
    first, last = start // 8, (start + count - 1) // 8
    if last - first >= 7:
        raise ValueError("the bits must lie in 7 bytes")
    whole = uint_be(data, first, last - first + 1)
    return F.shiftright(whole, (last + 1) * 8 - start - count).bitwiseAND((1 << count) - 1)


def sign_extend(n: Column, count: int) -> Column:
    return n - n.bitwiseAND(1 << (count - 1)) * 2


def byte_array(data: Column) -> Column:
    """Bytes as an array of int; empty for an empty value."""
    n = F.length(data)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.conv(F.hex(F.substring(data, k, F.lit(1))), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


def ones_sum(data: Column) -> Column:
    """Folded one's-complement sum of big-endian 16-bit words; an odd last byte is the high one."""
    words = ((F.length(data) + 1) / 2).cast("int")
    word = lambda k: F.conv(F.rpad(F.hex(F.substring(data, k * 2 + 1, F.lit(2))), 4, "0"), 16, 10).cast("long")
    total = F.when(F.length(data) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(words - 1, F.lit(0))), F.lit(0).cast("long"), lambda s, k: s + word(k)))
    fold = lambda x: x.bitwiseAND(0xFFFF) + F.shiftright(x, 16)
    return fold(fold(fold(total)))


def ip_checksum(header: Column) -> Column:
    """Checksum of an IPv4 header whose checksum field counts as zero."""
    zeroed = F.concat(F.substring(header, 1, 10), F.lit(bytearray(2)), F.substring(header, F.lit(13), F.greatest(F.length(header) - 12, F.lit(0))))
    return F.lit(0xFFFF) - ones_sum(zeroed)


def l4_checksum(addresses: Column, proto: Column, segment: Column) -> Column:
    """Checksum of a whole TCP (6) or UDP (17) segment whose checksum field counts as zero, with the IPv4 pseudo header;
    addresses: source and destination as 8 bytes. Null for other protocols."""
    at = F.when(proto == 6, 16).when(proto == 17, 6)
    zeroed = F.concat(F.substring(segment, F.lit(1), at), F.lit(bytearray(2)), F.substring(segment, at + 3, F.greatest(F.length(segment) - at - 2, F.lit(0))))
    pseudo = F.concat(addresses, F.unhex(F.lpad(F.hex(proto), 4, "0")), F.unhex(F.lpad(F.hex(F.length(segment)), 4, "0")))
    return F.lit(0xFFFF) - ones_sum(F.concat(pseudo, zeroed))


def payload_class(ethertype: Column, ip_proto: Column, sport: Column, dport: Column) -> Column:
    """What payload is grouped by: (kind, number); TCP and UDP by the lower port if below 1024, else 65535."""
    low = F.least(sport, dport)
    port = F.when(low < 1024, low).otherwise(0xFFFF)
    return F.when(ip_proto.isin(6, 17) & low.isNotNull(), F.concat(F.when(ip_proto == 6, "tcp/").otherwise("udp/"), port.cast("string"))).when(ip_proto.isNotNull(), F.concat(F.lit("ip/"), ip_proto.cast("string"))).otherwise(F.concat(F.lit("l2/"), F.coalesce(ethertype, F.lit(0)).cast("string")))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
