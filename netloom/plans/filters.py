"""The packet filter language: text to a syntax tree to a native Column.

    expr    := expr '||' expr | expr '&&' expr | '!' expr | '(' expr ')' | test
    test    := field op value | field 'in' '{' value, ... '}' | 'data contains' ("text" | aa:bb)
    op      := == != < > <= >=

Logic is two-valued: a field that a packet lacks never gives null. The compiler keeps that without wrapping leaves in
coalesce(), so filters reach the Parquet scan: it carries negations down to the leaves and writes a negated leaf as
(c IS NULL OR NOT test).
"""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from netloom.functions.names import ETHERTYPES, IP_PROTOCOLS


class FilterError(ValueError):
    pass


FIELDS = {
    "mac": ("mac_src", "mac_dst"), "mac_src": ("mac_src",), "mac_dst": ("mac_dst",),
    "ip": ("src", "dst"), "ip_src": ("src",), "ip_dst": ("dst",),
    "proto": (), "port": ("sport", "dport"), "sport": ("sport",), "dport": ("dport",),
    "ethertype": ("ethertype",), "vlan": ("vlan",), "len": ("origlen",), "data": ("frame",),
}
ALIASES = {
    "mac.src": "mac_src", "mac.dst": "mac_dst", "ip.src": "ip_src", "src": "ip_src", "ip.dst": "ip_dst", "dst": "ip_dst",
    "protocol": "proto", "port.src": "sport", "port.dst": "dport", "length": "len", "payload": "data", "bytes": "data",
}
PROTO_ALIASES = {"icmp6": ("ip_proto", 58), "ip4": ("ethertype", 0x0800), "ipv4": ("ethertype", 0x0800), "ip6": ("ethertype", 0x86DD), "ipv6": ("ethertype", 0x86DD)}
TOKEN = re.compile(r"""\s*(?:"((?:\\.|[^"\\])*)"|(==|!=|<=|>=|&&|\|\||[<>!(){},])|([\w:.*/-]+))""", re.S)
U16 = 65536


@dataclass(frozen=True)
class Value:
    """kind: number, range, bits (value, mask, width in bytes), proto, text or hex."""

    kind: str
    data: object


@dataclass(frozen=True)
class Test:
    field: str
    op: str
    value: Value


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    end = len(text.rstrip())
    while at < end:
        m = TOKEN.match(text, at)
        if not m:
            rest = text[at:].lstrip()
            raise FilterError("unterminated string literal" if rest[0] == '"' else f"unexpected character {rest[0]!r} at {text.index(rest[0], at)}")
        if m[1] is not None:
            out.append(("text", re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), m[1], flags=re.S)))
        else:
            out.append(("op", m[2]) if m[2] else ("word", m[3]))
        at = m.end()
    return out


def _number(s: str) -> int | None:
    m = re.fullmatch(r"0x([0-9a-fA-F]+)|\+?([0-9]+)", s)
    n = int(m[1], 16) if m and m[1] else int(m[2]) if m else None
    return n if n is not None and n < 1 << 64 else None


def _mac(s: str) -> Value | None:
    parts = s.split(":")
    if len(parts) > 6 or len(parts) < 6 and parts[-1] != "*" or not all(p == "*" or re.fullmatch("[0-9a-fA-F]{2}", p) for p in parts):
        return None
    parts += ["*"] * (6 - len(parts))
    return Value("bits", (bytes(0 if p == "*" else int(p, 16) for p in parts), bytes(0 if p == "*" else 255 for p in parts)))


def _ip(s: str) -> Value | None:
    if "*" in s:
        parts = s.split(".")
        if len(parts) > 4 or len(parts) < 4 and parts[-1] != "*" or not all(p == "*" or re.fullmatch("[0-9]+", p) and int(p) < 256 for p in parts):
            return None
        parts += ["*"] * (4 - len(parts))
        return Value("bits", (bytes(0 if p == "*" else int(p) for p in parts), bytes(0 if p == "*" else 255 for p in parts)))
    base, slash, length = s.partition("/")
    try:
        address = ipaddress.ip_address(base)
        if "%" in base or slash and not re.fullmatch("[0-9]+", length):
            return None
        net = ipaddress.ip_network((address, int(length) if slash else address.max_prefixlen), strict=False)
    except ValueError:
        return None
    return Value("bits", (net.network_address.packed, net.netmask.packed))


def _value(field: str, s: str) -> Value:
    if field in ("mac", "mac_src", "mac_dst"):
        found, what = _mac(s), "a MAC address or pattern"
    elif field in ("ip", "ip_src", "ip_dst"):
        found, what = _ip(s), "an IP address, wildcard or CIDR"
    elif field == "proto":
        by_name = {name: n for n, name in reversed(IP_PROTOCOLS.items())}
        ether = {name: n for n, name in ETHERTYPES.items()}
        n, what = _number(s), "a protocol"
        pair = PROTO_ALIASES.get(s) or (("ip_proto", by_name[s]) if s in by_name else ("ethertype", ether[s]) if s in ether else ("ip_proto", n) if n is not None and n < 256 else None)
        found = pair and Value("proto", pair)
    elif field == "data":
        raise FilterError("'data' only takes 'contains'")
    else:
        n, what = _number(s), "a number or range"
        ends = [_number(x) for x in s.split("-", 1)]
        found = Value("number", n) if n is not None else Value("range", (min(ends), max(ends))) if len(ends) == 2 and None not in ends else None
    if not found:
        raise FilterError(f"{s!r} is not {what}")
    return found


def parse(text: str):
    """The syntax tree of a filter; FilterError if it isn't one."""
    found, at = tokens(text), 0

    def take(kind: str | None = None, *texts: str) -> tuple[str, str]:
        nonlocal at
        now = found[at] if at < len(found) else ("end", "the end")
        if kind and now[0] != kind or texts and now[1] not in texts:
            raise FilterError(f"expected {' or '.join(texts) or kind}, got {now[1]!r}")
        at += 1
        return now

    def next_is(*texts: str) -> bool:
        return at < len(found) and found[at] in [("op", t) for t in texts]

    def chain(inner, sign: str, kind):
        parts = [inner()]
        while next_is(sign):
            take()
            parts.append(inner())
        return kind(tuple(parts)) if len(parts) > 1 else parts[0]

    def either():
        return chain(both, "||", Any)

    def both():
        return chain(unary, "&&", All)

    def unary():
        if next_is("!"):
            take()
            return Not(unary())
        if next_is("("):
            take()
            inner = either()
            take("op", ")")
            return inner
        return test()

    def test():
        name = take("word")[1]
        field = ALIASES.get(name, name)
        if field not in FIELDS:
            raise FilterError(f"unknown field {name!r}")
        kind, sign = take()
        if kind == "op" and sign in ("==", "!=", "<", ">", "<=", ">="):
            value = _value(field, take("word")[1])
            if sign not in ("==", "!=") and value.kind != "number":
                raise FilterError("ordering needs a plain number")
            return Test(field, sign, value)
        if (kind, sign) == ("word", "contains"):
            kind, what = take()
            if kind == "word" and re.fullmatch("[0-9a-fA-F]{2}(:[0-9a-fA-F]{2})*", what):
                value = Value("hex", bytes.fromhex(what.replace(":", "")))
            elif kind == "text":
                value = Value("text", what)
            else:
                raise FilterError(f"expected a quoted string or hex bytes, got {what!r}")
            if field != "data":
                raise FilterError("'contains' only applies to 'data'")
            return Test(field, "==", value)
        if (kind, sign) == ("word", "in"):
            take("op", "{")
            parts = [Test(field, "==", _value(field, take("word")[1]))]
            while not next_is("}"):
                take("op", ",")
                if not next_is("}"):
                    parts.append(Test(field, "==", _value(field, take("word")[1])))
            take()
            return Any(tuple(parts))
        raise FilterError(f"expected an operator, got {sign!r}")

    tree = either()
    if at < len(found):
        raise FilterError(f"unexpected {found[at][1]!r} after the filter")
    return tree


def needs_bytes(tree) -> bool:
    """Whether the filter reads packet bytes, so the frame column can't be left out of the scan."""
    if isinstance(tree, Test):
        return tree.field == "data"
    return any(needs_bytes(x) for x in ((tree.inner,) if isinstance(tree, Not) else tree.parts))


def _contiguous(mask: bytes) -> bool:
    bits = int.from_bytes(mask) ^ (1 << 8 * len(mask)) - 1
    return bits & (bits + 1) == 0


def _masked(name: str, value: bytes, mask: bytes) -> Column:
    """A prefix is a range, which a scan can prune by; other masks are computed."""
    hi = bytes(v | (255 - m) for v, m in zip(value, mask, strict=True))
    c = F.col(name)
    if len(value) == 16:
        lo, hi = F.lit(bytearray(value)), F.lit(bytearray(hi))
        return c == lo if mask == b"\xff" * 16 else (c >= lo) & (c <= hi)
    low, high = int.from_bytes(value), int.from_bytes(hi)
    if _contiguous(mask):
        return c == low if low == high else c.between(low, high)
    return c.bitwiseAND(F.lit(int.from_bytes(mask))) == low


def _columns(t: Test) -> tuple[str, ...]:
    if t.value.kind == "bits" and t.field.startswith("ip"):
        family = "ip4" if len(t.value.data[0]) == 4 else "ip6"
        return tuple(f"{family}_{side}" for side in FIELDS[t.field])
    return (t.value.data[0],) if t.value.kind == "proto" else FIELDS[t.field]


def _equal(t: Test, name: str) -> Column:
    kind, data = t.value.kind, t.value.data
    if kind == "bits":
        return _masked(name, *data)
    if kind == "proto":
        return F.col(name) == data[1]
    if kind == "range":
        return F.col(name).between(*data)
    return F.col(name) == (data % U16 if t.field == "port" else data)


def _compare(c: Column, op: str, n: int) -> Column:
    return {"==": c == n, "!=": c != n, "<": c < n, ">": c > n, "<=": c <= n, ">=": c >= n}[op]


def _test(t: Test, wanted: bool) -> Column:
    kind, data = t.value.kind, t.value.data
    if t.field == "data":
        if kind == "text":
            upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
            needle = data.encode().decode("latin-1").translate(str.maketrans(upper, lower))
            hit = F.contains(F.translate(F.decode("frame", "ISO-8859-1"), upper, lower), F.lit(needle))
        else:
            hit = F.contains(F.col("frame"), F.lit(bytearray(data)))
        return hit if wanted else ~F.coalesce(hit, F.lit(False))
    names = _columns(t)
    if kind == "number" and t.field != "port":
        c = F.col(names[0])
        if wanted:
            hit = _compare(c, t.op, data)
            return (c != 0) & hit if t.field == "ethertype" else hit
        miss = c.isNull() | _compare(c, {"==": "!=", "!=": "==", "<": ">=", ">": "<=", "<=": ">", ">=": "<"}[t.op], data)
        return (c == 0) | miss if t.field == "ethertype" else miss
    if t.op not in ("==", "!="):
        return F.lit(not wanted)  # ordering on 'port' never holds
    hits = [_equal(t, name) for name in names]
    if t.field == "ethertype":
        hits = [(F.col("ethertype") != 0) & h for h in hits]
    if wanted == (t.op == "=="):
        return reduce(or_, hits)
    return reduce(and_, (F.col(n).isNull() | ~h for n, h in zip(names, hits, strict=True)))


def compile_tree(tree, wanted: bool = True) -> Column:
    if isinstance(tree, Not):
        return compile_tree(tree.inner, not wanted)
    if isinstance(tree, Test):
        return _test(tree, wanted)
    parts = sorted(tree.parts, key=needs_bytes)  # payload searches last: they cost most
    return reduce(or_ if isinstance(tree, Any) == wanted else and_, (compile_tree(p, wanted) for p in parts))


def packet_filter(text: str) -> Column:
    """For where(): null stands for false. Inside other expressions use packet_test()."""
    return compile_tree(parse(text))


def packet_test(text: str) -> Column:
    return F.coalesce(packet_filter(text), F.lit(False))


def _bounds(t: Test) -> tuple[object, object]:
    """The least and the greatest value that an equality can hold for."""
    kind, data = t.value.kind, t.value.data
    if kind == "bits":
        value, mask = data
        high = bytes(v | (255 - m) for v, m in zip(value, mask, strict=True))
        return (F.lit(bytearray(value)), F.lit(bytearray(high))) if len(value) == 16 else (int.from_bytes(value), int.from_bytes(high))
    if kind == "proto":
        return data[1], data[1]
    if kind == "range":
        return data
    return (data % U16, data % U16) if t.field == "port" else (data, data)


def bounded(tree) -> list[str]:
    """The packet columns whose bounds may_match() asks for."""
    if isinstance(tree, Test):
        return [] if tree.field == "data" or tree.op == "!=" else list(_columns(tree))
    parts = () if isinstance(tree, Not) else tree.parts
    return sorted({c for p in parts for c in bounded(p)})


def may_match(tree) -> Column:
    """Whether a group of packets may hold a match, from <column>_low and <column>_high of the columns of bounded().
    Never false for a group with a match; negations and payload searches always may."""
    if isinstance(tree, Not) or isinstance(tree, Test) and (tree.field == "data" or tree.op == "!="):
        return F.lit(True)
    if not isinstance(tree, Test):
        return reduce(or_ if isinstance(tree, Any) else and_, (may_match(p) for p in tree.parts))
    if tree.op == "==":
        low, high = _bounds(tree)
        return F.coalesce(reduce(or_, ((F.col(f"{c}_low") <= high) & (F.col(f"{c}_high") >= low) for c in _columns(tree))), F.lit(False))
    if tree.field == "port":
        return F.lit(False)  # ordering on 'port' never holds
    side = "low" if tree.op.startswith("<") else "high"
    return F.coalesce(_compare(F.col(f"{_columns(tree)[0]}_{side}"), tree.op, tree.value.data), F.lit(False))


FLAGS = ("mac", "mac_src", "mac_dst", "ip", "ip_src", "ip_dst", "proto", "port", "sport", "dport", "vlan")


def compose(filter: str | None = None, **flags: list[str]) -> str:
    """One filter text of field flags and a free filter: one value is ==, several are in { }, all joined by &&."""
    parts = []
    for name in FLAGS:
        values = flags.get(name) or []
        if values:
            parts.append(f"{name} == {values[0]}" if len(values) == 1 else f"{name} in {{{', '.join(values)}}}")
    if filter:
        parts.append(f"({filter})" if parts else filter)
    text = " && ".join(parts)
    if text:
        parse(text)
    return text


def table_search(columns: list[str], text: str) -> Column:
    """Rows that hold all terms; -term excludes; prefix:value looks at the first column with that prefix, unless the
    token consists of hex digits and colons alone."""
    out = F.lit(True)
    for token in text.lower().split():
        bare = token.removeprefix("-") if len(token) > 1 else token
        name, colon, value = bare.partition(":")
        column = next((c for c in columns if c.lower().startswith(name)), None) if colon and name and not re.fullmatch("[0-9a-f:]+", bare) else None
        where = F.col(f"`{column}`").cast("string") if column else F.concat_ws("\x01", *(F.col(f"`{c}`").cast("string") for c in columns))
        hit = F.coalesce(F.contains(F.lower(where), F.lit(value if column else bare)), F.lit(False))
        out = out & (~hit if bare != token else hit)
    return out
