"""Captures made byte by byte."""

import struct

MAC = {k: bytes([v] * 3 + [0, 0, n]) for n, (k, v) in enumerate((("A", 0xAA), ("B", 0xBB), ("C", 0xCC)), 1)}
IP = {1: bytes([10, 0, 0, 1]), 2: bytes([10, 0, 0, 2]), 3: bytes([192, 168, 1, 3])}


def eth(dst, src, kind, body):
    return dst + src + struct.pack(">H", kind) + body


def ip4(src, dst, proto, body):
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0) + src + dst + body


def ip6(src, dst, proto, body):
    return struct.pack(">IHBB", 6 << 28, len(body), proto, 64) + src + dst + body


def tcp(sport, dport, flags, body=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, 1, 0, 0x50, flags, 0x2000, 0, 0) + body


def udp(sport, dport, body=b""):
    return struct.pack(">HHHH", sport, dport, 8 + len(body), 0) + body


def standard():
    """80 frames: 40 TCP SYN, 25 UDP, 10 ARP, 5 ICMP."""
    out = [eth(MAC["B"], MAC["A"], 0x800, ip4(IP[1], IP[2], 6, tcp(40000, 443, 2, b"hello")))] * 40
    out += [eth(MAC["B"], MAC["A"], 0x800, ip4(IP[1], IP[2], 17, udp(53000, 53, b"dnsq")))] * 25
    out += [eth(b"\xff" * 6, MAC["C"], 0x806, struct.pack(">HHBBH", 1, 0x800, 6, 4, 1) + MAC["C"] + IP[3] + bytes(6) + bytes([192, 168, 1, 1]))] * 10
    out += [eth(MAC["A"], MAC["B"], 0x800, ip4(IP[2], IP[1], 1, b"\x08" + bytes(7)))] * 5
    return out


T0 = 1_700_000_000


def pcap(frames, order="<", nanos=False, linktype=1):
    magic = 0xA1B23C4D if nanos else 0xA1B2C3D4
    out = struct.pack(f"{order}IHHiIII", magic, 2, 4, 0, 0, 65535, linktype)
    for k, f in enumerate(frames):
        out += struct.pack(f"{order}4I", T0 + k, 7, len(f), len(f)) + f
    return out


def pcapng(frames, order="<", resolution=None, simple=False):
    out = struct.pack(f"{order}IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28)
    options = b"" if resolution is None else struct.pack(f"{order}HHB3xHH", 9, 1, resolution, 0, 0)
    size = 20 + len(options)
    out += struct.pack(f"{order}IIHHI", 1, size, 1, 0, 65535) + options + struct.pack(f"{order}I", size)
    for k, f in enumerate(frames):
        pad = f + bytes(-len(f) % 4)
        if simple:
            out += struct.pack(f"{order}III", 3, 16 + len(pad), len(f)) + pad + struct.pack(f"{order}I", 16 + len(pad))
            continue
        ticks = (T0 + k) * (1_000_000 if resolution is None else 10**resolution)
        out += struct.pack(f"{order}IIIIIII", 6, 32 + len(pad), 0, ticks >> 32, ticks & 0xFFFFFFFF, len(f), len(f)) + pad + struct.pack(f"{order}I", 32 + len(pad))
    return out
