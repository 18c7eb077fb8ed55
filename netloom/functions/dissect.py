"""Link, network and transport headers of a frame: fields by Arrow batch, spans and dumps as native Columns.

Rules where headers are damaged: what the captured bytes don't hold is null; no ports on fragments but the first; a
header length below its minimum counts as the minimum. VLAN tags nest up to two; IPv6 extension headers as deep as they
go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netloom.functions.scalars import byte_array, uint_be
from netloom.schema import ETHERNET, FIELDS, LOOP, NULL, RAW

TAGS = (0x8100, 0x88A8, 0x9100)
MOST_TAGS = 2
EXTENSIONS = (0, 43, 60, 135, 139, 140)  # headers whose length is in units of 8 bytes


def _u(data: Column, at: Column, size: int) -> Column:
    return uint_be(data, at, size)


def _fixed(d: DataFrame, keep: list[str]) -> DataFrame:
    """d with its new columns behind a generator, so that a later filter isn't rewritten into the nested expressions
    that they stand for, which would grow beyond any plan's size."""
    new = [c for c in d.columns if c not in keep]
    own = F.inline_outer(F.array(F.struct(*new)))
    return d.select(*keep, own)


def _binary(rows: np.ndarray, held: np.ndarray) -> pa.Array:
    """Values of one width where held, in order; null elsewhere."""
    ends = np.concatenate([[0], np.cumsum(np.where(held, rows.shape[1], 0))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(held), [pa.py_buffer(np.packbits(held, bitorder="little").tobytes()), pa.py_buffer(ends.tobytes()), pa.py_buffer(rows[held].tobytes())])


def header_fields(frames: pa.Array, links: np.ndarray) -> list[pa.Array]:
    """The columns of schema.FIELDS for a batch of frames, all of them at once; below, -1 stands for absent."""
    wide = pa.types.is_large_binary(frames.type)
    _, ends, held = frames.buffers()
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[frames.offset : frames.offset + len(frames) + 1].astype(np.int64)
    data = np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8)
    data = data if len(data) >= 16 else np.concatenate([data, np.zeros(16, np.uint8)])
    start, known = ends[:-1], np.asarray(frames.is_valid())
    size = np.where(known, np.diff(ends), 0)

    def u(at, n: int) -> np.ndarray:
        ok = (at >= 0) & (at + n <= size)
        base, out = np.where(ok, start + at, 0), np.zeros(len(size), np.int64)
        for k in range(n):
            out = out << 8 | data[base + k]
        return np.where(ok, out, -1)

    def either(test: np.ndarray, value, other=-1) -> np.ndarray:
        return np.where(test, value, other)

    eth = known & (links == ETHERNET) & (size >= 14)
    l3 = either(eth, 14, either(np.isin(links, (NULL, LOOP)) & (size > 4), 4, either(known & (links == RAW), 0)))
    kind, vlan = either(eth, u(np.int64(12), 2)), np.full(len(size), -1)
    tagged = eth & np.isin(kind, TAGS) & (size >= l3 + 4)
    for _ in range(MOST_TAGS):
        vlan, kind, l3 = either(tagged, u(l3, 2) & 0xFFF, vlan), either(tagged, u(l3 + 2, 2), kind), l3 + 4 * tagged
        tagged &= np.isin(kind, TAGS) & (size >= l3 + 4)
    first = u(l3, 1)
    version = first >> 4
    ethertype = either(eth, kind, either(version == 4, 0x0800, either(version == 6, 0x86DD, 0)))
    v4 = (ethertype == 0x0800) & (version == 4) & (size >= l3 + 20)
    v6 = (ethertype == 0x86DD) & (version == 6) & (size >= l3 + 40)
    ip_proto = either(v4, u(l3 + 9, 1), either(v6, u(l3 + 6, 1)))
    fragment = either(v4, u(l3 + 6, 2) & 0x1FFF, 0)
    at = either(v4, l3 + np.maximum((first & 15) * 4, 20), either(v6, l3 + 40))
    proto = ip_proto
    while True:
        units = v6 & np.isin(proto, EXTENSIONS)
        piece, ah = v6 & (proto == 44), v6 & (proto == 51)
        some = units | piece | ah
        if not some.any():
            break
        length = u(at + 1, 1)
        after = either(piece, at + 8, either(length >= 0, at + either(units, (length + 1) * 8, (length + 2) * 4)))
        fragment = either(piece, u(at + 2, 2) >> 3, fragment)
        proto, at = either(some, either(at >= 0, u(at, 1)), proto), either(some, either(at >= 0, after), at)
    whole = (fragment == 0) & (at >= 0)
    tcp = whole & (proto == 6) & (size >= at + 20)
    udp = whole & (proto == 17) & (size >= at + 8)
    ports = tcp | udp
    payload = either(tcp, at + np.maximum((u(at + 12, 1) >> 4) * 4, 20), either(udp, at + 8, either(v4 | v6, at, l3)))
    payload = either(known, np.minimum(either(payload < 0, size, payload), size))

    def six(offset: int) -> pa.Array:
        where = np.where(v6, start + l3 + offset, 0)[:, None] + np.arange(16)
        return _binary(data[np.minimum(where, len(data) - 1)], v6)

    def ints(x: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.array(x.astype(np.int64 if kind == pa.int64() else np.int32), kind, mask=x < 0)

    big, small = pa.int64(), pa.int32()
    return [
        pa.array(eth), ints(either(eth, u(np.int64(6), 6)), big), ints(either(eth, u(np.int64(0), 6)), big), ints(ethertype, small), ints(vlan, small), ints(either(v4, 4, either(v6, 6)), small),
        ints(either(v4, u(l3 + 12, 4)), big), ints(either(v4, u(l3 + 16, 4)), big), six(8), six(24),
        ints(ip_proto, small), ints(proto, small), ints(either(ports, u(at, 2)), small), ints(either(ports, u(at + 2, 2)), small),
        ints(either(tcp, u(at + 13, 1) & 0x3F), small), ints(payload, small),
    ]


def with_fields(batch: pa.RecordBatch, frame: str = "frame", linktype: str = "linktype") -> pa.RecordBatch:
    links = batch.column(linktype).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    found = header_fields(batch.column(frame), links)
    return pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *FIELDS.fieldNames()])


def dissect(packets: DataFrame, frame: str = "frame", linktype: str = "linktype") -> DataFrame:
    """The columns of packets with those of schema.FIELDS. Unknown link types and null frames give empty fields.

    Headers are decoded in Arrow batches with numpy: as chained byte expressions they grew beyond what is compiled, and
    took some seconds of planning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield with_fields(batch, frame, linktype)

    return packets.mapInArrow(run, StructType([*packets.schema.fields, *FIELDS.fields]))


def field_spans(packets: DataFrame, frame: str = "frame", linktype: str = "linktype") -> DataFrame:
    """packets with spans: an array of (label, start, end) of the header fields and the payload, for frames with at
    most two VLAN tags. A plain IPv6 header counts 40 bytes."""
    data, link = F.col(frame), F.col(linktype)
    n = F.length(data)
    eth = (link == ETHERNET) & (n >= 14)
    e0 = _u(data, F.lit(12), 2)
    t1 = eth & e0.isin(*TAGS) & (n >= 18)
    t2 = t1 & _u(data, F.lit(16), 2).isin(*TAGS) & (n >= 22)
    l3 = F.when(t2, 22).when(t1, 18).when(eth, 14).when(link.isin(NULL, LOOP) & (n > 4), 4).when(link == RAW, 0)
    d = packets.withColumns({"__eth": F.coalesce(eth, F.lit(False)), "__t1": F.coalesce(t1, F.lit(False)), "__t2": F.coalesce(t2, F.lit(False)), "__l3": l3})
    first = _u(data, F.col("__l3"), 1)
    kind = F.when(F.col("__eth"), _u(data, F.col("__l3") - 2, 2)).otherwise(F.when(F.shiftright(first, 4) == 4, 0x0800).when(F.shiftright(first, 4) == 6, 0x86DD))
    v4 = (kind == 0x0800) & (n >= F.col("__l3") + 20)
    v6 = (kind == 0x86DD) & (n >= F.col("__l3") + 40)
    d = d.withColumns({"__v4": F.coalesce(v4, F.lit(False)), "__v6": F.coalesce(v6, F.lit(False))})
    at = F.col("__l3")
    d = d.withColumns({"__l4": F.when(F.col("__v4"), at + F.greatest(first.bitwiseAND(15) * 4, F.lit(20))).when(F.col("__v6"), at + 40), "__p": F.when(F.col("__v4"), _u(data, at + 9, 1)).when(F.col("__v6"), _u(data, at + 6, 1))})
    l4 = F.col("__l4")
    tcp, udp = (F.col("__p") == 6) & (n >= l4 + 14), (F.col("__p") == 17) & (n >= l4 + 8)
    ports = tcp | udp
    payload = F.when(tcp, l4 + F.greatest(F.shiftright(_u(data, l4 + 12, 1), 4) * 4, F.lit(20))).when(udp, l4 + 8).otherwise(F.coalesce(l4, at))
    span = lambda test, label, a, z: F.when(test, F.struct(F.lit(label).alias("label"), a.cast("int").alias("start"), z.cast("int").alias("end")))
    fixed = lambda test, label, a, size: span(test, label, F.lit(a), F.lit(a + size))
    spans = F.array(
        fixed(F.col("__eth"), "eth dst", 0, 6), fixed(F.col("__eth"), "eth src", 6, 6), fixed(F.col("__t1"), "vlan", 14, 2), fixed(F.col("__t2"), "vlan (inner)", 18, 2),
        span(F.col("__eth"), "ethertype", at - 2, at),
        span(F.col("__v4"), "ip proto", at + 9, at + 10), span(F.col("__v6"), "ip proto", at + 6, at + 7),
        span(F.col("__v4"), "ip src", at + 12, at + 16), span(F.col("__v4"), "ip dst", at + 16, at + 20),
        span(F.col("__v6"), "ip src", at + 8, at + 24), span(F.col("__v6"), "ip dst", at + 24, at + 40),
        span(ports, "src port", l4, l4 + 2), span(ports, "dst port", l4 + 2, l4 + 4), span(tcp, "tcp flags", l4 + 13, l4 + 14),
        span(payload < n, "payload", payload, n),
    )
    return _fixed(d.select(*packets.columns, F.filter(spans, lambda s: s.isNotNull()).alias("spans")), packets.columns)


def field_at(spans: Column, offset: int) -> Column:
    """The label of the field that a byte belongs to."""
    return F.get(F.filter(spans, lambda s: (s["start"] <= offset) & (s["end"] > offset)), F.lit(0))["label"]


def hexdump(packets: DataFrame, frame: str = "frame", keys: tuple[str, ...] = ("packet_no",)) -> DataFrame:
    """(keys, offset, hex, ascii), 16 bytes a line; bytes that don't print are shown as ·"""
    data = F.col(frame)
    rows = packets.where(F.length(data) > 0).select(*keys, data.alias("data"), F.explode(F.sequence(F.lit(0), F.length(data) - 1, F.lit(16))).alias("at"))
    part = F.substring(F.col("data"), F.col("at") + 1, F.lit(16))
    pairs = F.regexp_replace(F.lower(F.hex(part)), "(..)(?!$)", "$1 ")
    text = F.regexp_replace(F.decode(part, "ISO-8859-1"), "[^\\x20-\\x7e]", "·")
    return rows.select(*keys, F.lower(F.lpad(F.hex("at"), 6, "0")).alias("offset"), pairs.alias("hex"), text.alias("ascii"))


def byte_grid(packets: DataFrame, frame: str = "frame", width: int | None = None, keys: tuple[str, ...] = ("packet_no",)) -> DataFrame:
    """(keys, pos, byte): the bytes of each packet (its first `width` ones, if given), one a row."""
    data = F.col(frame) if width is None else F.substring(F.col(frame), 1, width)
    return packets.select(*keys, F.posexplode(byte_array(data)).alias("pos", "byte"))


def constant_bytes(grid: DataFrame) -> DataFrame:
    """Offsets with the number of packets that reach them and of their distinct bytes (at most 256)."""
    return grid.groupBy("pos").agg(F.count("*").alias("packets"), F.min("byte").alias("low"), F.max("byte").alias("high"), F.size(F.collect_set("byte")).alias("n_values"))


def ethernet_frame(packets: DataFrame, payload: Column | None = None) -> DataFrame:
    """packets with frame: Ethernet, up to one VLAN tag, IPv4 or IPv6, TCP, UDP or other, from the fields; for tests
    and round trips. IPv4 headers carry no checksum."""
    hexed = lambda c, n: F.lpad(F.hex(c.cast("long")), n * 2, "0")
    body = F.hex(payload) if payload is not None else F.lit("")
    ports = F.concat(hexed(F.col("sport"), 2), hexed(F.col("dport"), 2))
    tcp = F.concat(ports, F.lit("0000000100000000"), F.lit("50"), hexed(F.coalesce("tcp_flags", F.lit(0)), 1), F.lit("2000"), F.lit("00000000"), body)
    udp = F.concat(ports, hexed(F.length(body) / 2 + 8, 2), F.lit("0000"), body)
    l4 = F.when(F.col("sport").isNull(), body).when(F.col("ip_proto") == 6, tcp).otherwise(udp)
    n = F.length(l4) / 2
    v4 = F.concat(F.lit("4500"), hexed(n + 20, 2), F.lit("00000000"), F.lit("40"), hexed(F.col("ip_proto"), 1), F.lit("0000"), hexed(F.col("ip4_src"), 4), hexed(F.col("ip4_dst"), 4), l4)
    v6 = F.concat(F.lit("60000000"), hexed(n, 2), hexed(F.col("ip_proto"), 1), F.lit("40"), F.hex("ip6_src"), F.hex("ip6_dst"), l4)
    l3 = F.when(F.col("ip4_src").isNotNull(), v4).when(F.col("ip6_src").isNotNull(), v6).otherwise(body)
    tag = F.when(F.col("vlan").isNotNull(), F.concat(F.lit("8100"), hexed(F.col("vlan"), 2))).otherwise("")
    return packets.withColumn("frame", F.unhex(F.concat(hexed(F.col("mac_dst"), 6), hexed(F.col("mac_src"), 6), tag, hexed(F.col("ethertype"), 2), l3)))
