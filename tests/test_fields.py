from netloom.functions.fields import Field, FieldMap, candidates, decode, extract_bits, extract_uint, flipped, reversed_bytes, selection, sign_extend, slug, to_kaitai, to_lua
from netloom.functions.kaitai import SpecError, interpret, parse_spec
from netloom.operators.histograms import glyphs, nice_interval
from netloom.sources.bbframe import gse_packets, parse_lines


def test_bits():
    data = bytes([0b10110011, 0x34, 0x12, 0xFF])
    assert extract_bits(data, 0, 1) == 1 and extract_bits(data, 2, 7) == 0b1100110 and extract_bits(data, 30, 3) is None
    assert extract_uint(data, 8, 16, True) == 0x1234 and sign_extend(0xFF, 8) == -1
    assert decode("uint", 8, 16, data) == "13330 (0x3412)" and decode("ipv4", 0, 32, data) == "179.52.18.255" and decode("mac", 0, 48, data) == "?"
    assert candidates(0, 1, data) == [("flag", "true")] and [k for k, _ in candidates(0, 32, data)] == ["uint", "uintle", "int", "ipv4", "ascii", "bytes"]
    assert selection(3, 1, False) == (8, 24) and flipped(b"\x00", 7) == b"\x01" and reversed_bytes(b"abcd", 1, 3) == b"acbd"
    assert [slug(x) for x in ("A b--C", "9x", "!!")] == ["a_b_c", "f_9x", "field"]


def test_field_map_and_code():
    m = FieldMap("My Proto")
    assert m.insert(Field("magic", 0, 16, "uint")) and not m.insert(Field("x", 8, 8, "uint")) and m.insert(Field("flag", 20, 1, "flag")) and m.insert(Field("len", 24, 16, "uintle"))
    spec = parse_spec(to_kaitai(m))
    assert [f[0] for f in interpret(spec, bytes(8))][:3] == ["magic", "unknown0", "flag"]
    lua = to_lua(m, "udp.port", 99)
    assert "add_le" in lua and "0x8" in lua and 'DissectorTable.get("udp.port"):add(99, p)' in lua
    assert m.field_at(20).name == "flag" and m.remove_at(20).name == "flag" and m.undo().name == "len"
    assert m.may_tag(16, 8, [(0, 16)]) and not m.may_tag(8, 16, [])


def test_specs():
    spec = parse_spec("meta: {id: t}\nseq:\n  - {id: n, type: u1}\n  - {id: items, type: u2be, repeat: expr, repeat-expr: n}\n  - {id: opt, type: u1, if: n == 9}\n  - {id: kind, type: u1, enum: e}\n  - {id: sub, type: pair}\n  - {id: bad, type: f4}\n  - {id: never, type: u1}\ntypes:\n  pair:\n    seq:\n      - {id: a, type: s1}\nenums:\n  e:\n    6: tcp\n")
    got = interpret(spec, bytes([2, 0, 1, 0, 2, 6, 0xFF, 1, 1, 1, 1]))
    assert [(f[0], f[4]) for f in got] == [("n", "2 (0x2)"), ("items[0]", "1 (0x1)"), ("items[1]", "2 (0x2)"), ("kind (tcp)", "6 (0x6)"), ("sub.a", "-1")]
    assert [f[0] for f in interpret(spec, b"\x02\x00")] == ["n"]
    try:
        parse_spec("meta: {id: x}")
        raise AssertionError
    except SpecError:
        pass


def test_small_helpers():
    assert nice_interval(60, 120) == 0.5 and nice_interval(0, 10) == 0.001 and nice_interval(1e9, 1) == 86400
    assert glyphs([0, 1, 7]) == " ▂█"


def test_baseband_lines(spark):
    frame = "72000000002047000000" + "c004aabb"
    import base64

    good = '{"timestamp":12.5,"bbframe":"' + base64.b64encode(bytes.fromhex(frame)).decode() + '","metadata":{"a":1}}'
    rows = [(good,), ('{"bbframe":"","timestamp":1,"metadata":{}}',), (good.replace("12.5", "012"),), (good.replace('","meta', '=","meta'),)]
    parsed = parse_lines(spark.createDataFrame(rows, "value string"))
    assert [r.reject_reason for r in parsed.collect()] == [None, "shape", "timestamp", "base64"]
    assert [(r.start, r["size"], bytes(r.packet).hex()) for r in gse_packets(parsed).collect()] == [(0, 4, "c004aabb")]
