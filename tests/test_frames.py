"""Frames and ICMP bodies against a plain walk over one frame at a time."""

import random
from ipaddress import ip_address

import pytest
from conftest import values

from netloom.sources import frames

BLANK = {
    "length": 0, "hdr_length": 0, "ip_protocol": 0, "app_protocol": None, "src": None, "dst": None,
    "port_src": 0, "port_dst": 0, "tcp_flags": 0, "vlan": 0,
}
IP_LETTERS = {1: "i", 4: "4", 6: "T", 17: "U", 41: "6", 58: "I"}


def number(data, at, size=2):
    if at + size > len(data):
        raise EOFError
    return int.from_bytes(data[at : at + size], "big")


def plain_ip(data):
    found = []
    while True:
        layer = {"layer": "I", **BLANK, "length": len(data)}
        found.append(layer)
        version = data[0] >> 4 if len(data) >= 20 else 0
        if version not in (4, 6) or version == 6 and len(data) < 40:
            layer["ip_protocol"] = 0 if version == 6 else version
            return found
        header, protocol, at, size = (data[0] % 16 * 4, data[9], 12, 4) if version == 4 else (40, data[6], 8, 16)
        src, dst = data[at : at + size], data[at + size : at + 2 * size]
        layer |= {
            "ip_protocol": version, "hdr_length": header, "app_protocol": IP_LETTERS.get(protocol, "?"),
            "src": str(ip_address(src)), "dst": str(ip_address(dst)),
        }
        body = data[header:]
        if protocol in (4, 41) and header:
            data = body
            continue
        if protocol == 6 and len(body) >= 14:
            layer |= {"hdr_length": header + (body[12] >> 4) * 4, "tcp_flags": body[13]}
        elif protocol == 6:
            layer["app_protocol"] = "?"
            return found
        elif protocol == 17 and len(body) >= 8:
            layer["hdr_length"] += 8
        if protocol in (6, 17) and len(body) >= 4:
            layer |= {"port_src": number(body, 0), "port_dst": number(body, 2)}
        return found


def plain_layers(link, data):
    if link in (12, 14, 101):
        return plain_ip(data)
    if link not in (1, 6, 113):
        return [{"layer": "?", **BLANK, "length": len(data)}]
    outer = {"layer": "S" if link == 113 else "E", **BLANK, "length": len(data)}
    at = 14 if link == 113 else 12
    if len(data) < at + 2:
        return [outer]
    outer |= {"src": data[6:12].hex(":"), "app_protocol": "?"}
    if link != 113:
        outer["dst"] = data[:6].hex(":")
    try:
        while number(data, at) in (0x88A8, 0x9100):
            at += 4
        if number(data, at) == 0x8100:
            tag = number(data, at + 2)
            outer["vlan"] = tag if link != 113 else 0
            at += 4
        kind = number(data, at)
    except EOFError:
        return [outer]
    if kind < 0x0800 or kind in (0x0800, 0x86DD):
        outer["app_protocol"] = "I"
        return [outer, *plain_ip(data[at + 2 :])]
    names = {0x8035: "a", 0x0806: "A", 0x0842: "W", 0x8137: "X", 0x8138: "X", 0x888E: "E", 0x8863: "P", 0x8864: "P"}
    outer["app_protocol"] = names.get(kind, "?")
    return [outer]


def some_ip(draw, depth=0):
    inner = draw.choice([4, 41]) if depth < 4 and draw.random() < 0.4 else draw.choice([1, 6, 6, 17, 58, 99])
    body = some_ip(draw, depth + 1) if inner in (4, 41) else draw.randbytes(draw.randrange(30))
    if draw.random() < 0.5:
        words = draw.choice([5, 5, 5, 6, 15, 1, 0])
        head = bytes([0x40 + words]) + draw.randbytes(8) + bytes([inner]) + draw.randbytes(2)
        return head + draw.randbytes(8) + bytes(max(0, 4 * words - 20)) + body
    ends = draw.choice([draw.randbytes(32), bytes(32), bytes(10) + b"\xff\xff" + draw.randbytes(4) + bytes(16)])
    return bytes([0x60]) + draw.randbytes(5) + bytes([inner]) + draw.randbytes(1) + ends + body


def some_frame(draw):
    link = draw.choice([1, 1, 1, 6, 12, 101, 113, 999])
    tags = b"".join(draw.choice([b"\x88\xa8", b"\x91\x00"]) + draw.randbytes(2) for _ in range(draw.randrange(3)))
    tags += draw.choice([b"", b"\x81\x00" + draw.randbytes(2)])
    kind = draw.choice([0x0800, 0x86DD, 0x0100, 0x0806, 0x8864, 0x1234]).to_bytes(2, "big")
    head = b"" if link in (12, 101) else draw.randbytes(14 if link == 113 else 12) + tags + kind
    frame = head + some_ip(draw)
    return link, frame[: draw.randrange(len(frame) + 1)] if draw.random() < 0.4 else frame


def test_frames_as_by_a_plain_walk(rows):
    draw = random.Random(5)
    data = [(i, *some_frame(draw)) for i in range(4000)]
    data += [(4000, 1, b""), (4001, 101, b""), (4002, 101, b"\x45"), (4003, 999, b"")]
    want = {i: plain_layers(link, frame) for i, link, frame in data}
    df = rows([(i, link, bytearray(frame)) for i, link, frame in data], "id int, datalink int, frame binary")
    got = {r["id"]: [x.asDict() for x in r["layers"]] for r in frames.decode_packets(df.repartition(3)).collect()}
    assert got.keys() == want.keys()
    texts = {"src", "dst"}
    for i, layers in want.items():
        # Mixed addresses have two spellings, so ends are compared as addresses.
        plain = [[{k: v for k, v in x.items() if k not in texts} for x in side] for side in (layers, got[i])]
        assert plain[0] == plain[1], i
        for one, other in zip(layers, got[i]):
            for end in texts:
                a, b = one[end], other[end]
                assert a == b or ip_address(a) == ip_address(b), i


def test_many_nested_packets():
    tunnel = bytes([0x45]) + bytes(8) + bytes([4]) + bytes(10)
    found = frames.frame_layers(101, tunnel * 700)
    assert len(found) == 701 and [x["length"] for x in found[-2:]] == [20, 0]


@pytest.mark.parametrize("order", [("id", "datalink", "frame", "note"), ("note", "frame", "id", "datalink")])
def test_missing_frames_are_rejected(rows, order):
    data = [(1, 1, bytearray(14), "a"), (2, 1, None, "b"), (3, None, bytearray(14), "c"), (4, None, None, None)]
    df = rows(data, "id int, datalink int, frame binary, note string").select(*order)
    assert values(frames.decode_packets(df), "id") == [(1,)]
    bad = frames.decode_packets(df, rejected=True)
    assert bad.columns == [*order, "reason"]
    assert values(bad, "id", "reason") == [(2, "message is missing"), (3, "link type is missing"), (4, "message is missing")]
    assert frames.decode_packets(df.limit(0)).count() == 0


def test_icmp_bodies_are_refusals_or_rejected(rows):
    ports = b"\0\x50\x9c\x40" + bytes(4)
    quote = bytes([0x45]) + bytes(8) + bytes([6]) + bytes(2) + bytes(4) + bytes([1, 2, 3, 4]) + ports
    quote6 = bytes([0x60]) + bytes(5) + bytes([6, 0]) + bytes(16) + bytes(15) + b"\1" + ports
    head = lambda kind, code: bytes([kind, code]) + bytes(6)
    cases = [
        ("i", head(3, 3) + quote, None), ("i", head(3, 1) + quote6, None), ("I", head(1, 4) + quote6, None),
        ("i", head(3, 4) + quote, frames.NO_REFUSAL), ("I", head(3, 4) + quote6, "message is not unreachable"),
        ("x", head(3, 3) + quote, "message is not unreachable"), (None, head(3, 3) + quote, "protocol is missing"),
        ("i", None, "message is missing"), ("i", b"\3\3", "message is cut off"), ("i", head(3, 3), "quoted packet cannot be read"),
        ("i", head(3, 3) + quote[:-1], "message is cut off"), ("i", head(3, 3) + quote6[:39], "quoted packet cannot be read"),
        ("i", head(3, 3) + quote[:9] + bytes([17]) + quote[10:], "quoted packet is not TCP"),
        ("i", head(3, 3) + quote[:6] + b"\0\1" + quote[8:], "quoted packet is a fragment"),
        ("i", head(3, 3) + quote[:6] + b"\x40\0" + quote[8:], None),
    ]
    data = [(i, p, None if b is None else bytearray(b)) for i, (p, b, _) in enumerate(cases)]
    df = rows(data, "id int, app_protocol string, body binary")
    good = values(frames.decode_icmp_nak(df), "id", "reason", "address", "local_port", "remote_port")
    assert sorted(good) == [
        (0, "P", "1.2.3.4", 80, 40000), (1, "H", "::1", 80, 40000), (2, "P", "::1", 80, 40000), (14, "P", "1.2.3.4", 80, 40000),
    ]
    bad = frames.decode_icmp_nak(df, rejected=True)
    assert bad.columns == ["id", "app_protocol", "body", "reason"]
    assert sorted(values(bad, "id", "reason")) == [(i, c[2]) for i, c in enumerate(cases) if c[2]]
