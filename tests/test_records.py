"""Records of variable length against a plain reading of one message at a time."""

import random
import struct
from datetime import datetime, timedelta
from ipaddress import ip_address

from conftest import values

from netloom.sources import codecs

T0 = datetime(2024, 1, 1)
EVENTS = ("connect", "disconnect", "lost", "extra", "timeout", "login")


class Plain:
    def __init__(self, data):
        self.data = data

    def take(self, size):
        if size > len(self.data):
            raise EOFError
        head, self.data = self.data[:size], self.data[size:]
        return head

    def number(self, size):
        return int.from_bytes(self.take(size), "big")

    def text(self):
        return self.take(self.number(4))


def plain_logs(data, version):
    message, found = Plain(data), []
    while message.data:
        age, event, family, details, code = message.number(4), *message.take(3), message.take(1).decode("latin-1")
        port = message.number(2) if version == 2 else None
        ends = [str(ip_address(message.take(16 if family == 1 else 4))) for _ in range(version)]
        texts = [None] * 6
        for _ in range(details):
            kind = message.number(1)
            text = message.text()
            if kind < 6:
                texts[kind] = text
        if event > 5:
            raise EOFError
        found.append((T0 - timedelta(milliseconds=age), EVENTS[event], ends[0], ends[1] if version == 2 else None, port, code, *texts))
    return found


def plain_pings(hosts, data):
    message, found = Plain(data), []
    for request, amount in hosts:
        address = message.text().decode("ascii")
        found.append((request, address or None, [message.number(4) for _ in range(amount if address else 0)]))
    return found


def plain_certs(hosts, data):
    message, found = Plain(data), []
    word = lambda: message.text().decode("utf-8", "replace")
    for request, details, params in hosts:
        count = message.number(1)
        cipher, proto = (word(), word()) if count and params else (None, None)
        for i in range(count):
            value = word()
            name, expiry = (word(), word()) if details else (None, None)
            found.append((request, cipher, proto, i, len(value) > 40, value, name, expiry or None))
    return found


def text(value):
    return struct.pack("!L", len(value)) + value


def some_text(draw):
    return text(draw.choice([b"", b"x", b"caf\xc3\xa9", b"\xff\xfe", b"y" * 41, "ž".encode() * 30]))


def some_log(draw, version):
    family, details = draw.choice([0, 1]), draw.randrange(4)
    event = 7 if draw.random() < 0.02 else draw.randrange(6)
    head = struct.pack("!IBBBB", draw.randrange(1 << 31), event, family, details, draw.randrange(1, 256))
    ends = draw.randbytes(version * (16 if family else 4))
    port = draw.randbytes(2) if version == 2 else b""
    return head + port + ends + b"".join(bytes([draw.randrange(9)]) + some_text(draw) for _ in range(details))


def damaged(draw, payload):
    return payload[: draw.randrange(len(payload) + 1)] if draw.random() < 0.3 else payload


def expected(read, messages):
    """Records of the messages that can be read, and the places of the others."""
    good, bad = [], []
    for i, message in enumerate(messages):
        try:
            good += [(i, *record) for record in read(*message)]
        except (EOFError, UnicodeDecodeError):
            bad.append(i)
    return sorted(good, key=repr), bad


def canonical(rows):
    """Mixed addresses have two spellings."""
    return sorted([(*r[:3], *(None if a is None else str(ip_address(a)) for a in r[3:5]), *r[5:]) for r in rows], key=repr)


def test_honeypot_logs_as_by_a_plain_reading(rows):
    for version in (1, 2):
        draw = random.Random(version)
        messages = [(damaged(draw, b"".join(some_log(draw, version) for _ in range(draw.randrange(5)))),) for _ in range(600)]
        want, bad = expected(lambda data: plain_logs(data, version), messages)
        data = [(i, T0, bytearray(m[0])) for i, m in enumerate(messages)] + [(600, T0, None)]
        df = rows(data, "client long, received timestamp_ntz, payload binary").repartition(3)
        got = codecs.decode_fake_logs(df, version=version, logins_only=False)
        columns = ["client", "timestamp", "event", "remote", "local", "remote_port", "code", "name", "password", "reason", "method", "uri", "host"]
        plain = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in got.select(*columns).collect()]
        reason = lambda v: None if v is None else v.decode("utf-8", "replace")
        assert canonical(plain) == canonical([(*r[:9], reason(r[9]), *r[10:]) for r in want])
        only = codecs.decode_fake_logs(df, version=version)
        assert only.count() == sum(r[2] == "login" for r in want)
        rejected = codecs.decode_fake_logs(df, version=version, rejected=True)
        assert [r.client for r in rejected.orderBy("client").collect()] == [*bad, 600]
        assert bad and {r.reason for r in rejected.collect()} == {"message is missing", "message is cut off", "unknown event"}


def test_pings_as_by_a_plain_reading(rows):
    draw = random.Random(3)
    messages = []
    for _ in range(500):
        hosts = [(draw.randrange(9), draw.randrange(4)) for _ in range(draw.randrange(4))]
        reply = lambda n: draw.choice([text(b""), text(b"192.0.2.1") + draw.randbytes(4 * n), text(b"::1") + draw.randbytes(4 * n)])
        payload = b"".join(reply(n) for _, n in hosts)
        payload = payload.replace(b"::1", b"\xff:1") if draw.random() < 0.05 else payload
        messages.append((hosts, damaged(draw, payload)))
    want, bad = expected(plain_pings, messages)
    data = [(i, h, bytearray(m)) for i, (h, m) in enumerate(messages)]
    data += [(500, None, bytearray(4)), (501, [(1, 1)], None), (502, [(1, None)], bytearray(4)), (503, [None], bytearray(4))]
    df = rows(data, "client long, hosts array<struct<request: long, amount: int>>, payload binary").repartition(3)
    assert values(codecs.decode_pings(df), "client", "request", "ip", "rtts") == want
    rejected = codecs.decode_pings(df, rejected=True)
    assert rejected.columns == ["client", "hosts", "payload", "reason"]
    assert [r.client for r in rejected.orderBy("client").collect()] == [*bad, 500, 501, 502, 503]
    assert {r.reason for r in rejected.collect()} == {"message is missing", "message is cut off", "hosts are missing", "address is no text"}


def test_certificates_as_by_a_plain_reading(rows):
    draw = random.Random(4)
    messages = []
    for _ in range(500):
        hosts = [(draw.randrange(9), draw.random() < 0.5, draw.random() < 0.5) for _ in range(draw.randrange(4))]
        payload = b""
        for _, details, params in hosts:
            links = draw.randrange(4)
            texts = (2 if links and params else 0) + links * (3 if details else 1)
            payload += bytes([links]) + b"".join(some_text(draw) for _ in range(texts))
        messages.append((hosts, damaged(draw, payload)))
    want, bad = expected(plain_certs, messages)
    data = [(i, h, bytearray(m)) for i, (h, m) in enumerate(messages)] + [(500, None, bytearray(4)), (501, [], None)]
    df = rows(data, "client long, hosts array<struct<request: long, want_details: boolean, want_params: boolean>>, payload binary").repartition(3)
    assert values(codecs.decode_certs(df)) == want
    assert [r.client for r in codecs.decode_certs(df, rejected=True).orderBy("client").collect()] == [*bad, 500, 501]
    assert codecs.decode_certs(df.limit(0)).count() == 0
