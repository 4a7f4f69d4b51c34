"""Addresses against Python's ipaddress."""

import ipaddress
import random
import socket

from conftest import values

from netloom.functions import net


def canonical(text):
    try:
        family = socket.AF_INET6 if ":" in text else socket.AF_INET
        return socket.inet_ntop(family, socket.inet_pton(family, text))
    except OSError:
        return None


def addresses():
    rng = random.Random(1)
    out = [
        "10.0.0.1", "172.15.0.1", "172.16.0.1", "172.31.255.255", "172.32.0.1", "192.168.1.1", "127.0.0.1", "224.0.0.1",
        "255.255.255.255", "0.0.0.0", "192.0.2.1", "169.254.1.1", "8.8.8.8", "::", "::1", "ff02::1", "fe80::1",
        "2001:db8::1", "::ffff:1.2.3.4", "2001:0DB8:0:0:0:0:0:1", "2001:db8:0:0:1:0:0:1", "1::", "::2:0:0:1", "1:0:0:2::3",
        "1:2:3:4:5:6:7:8", "64:ff9b::192.0.2.33", "f000::1",
        # no addresses
        "256.1.1.1", "1.2.3", "1.2.3.4.5", "1:2:3", "1::2::3", "12345::1", "g::1", "", ":", "1:2:3:4:5:6:7:8:9", "::ffff:1.2.3.400",
    ]
    for _ in range(300):
        groups = [rng.choice(["0", "0", format(rng.getrandbits(16), "x")]) for _ in range(8)]
        out.append(":".join(groups))
        out.append(str(ipaddress.ip_address(":".join(groups))))
        out.append(str(ipaddress.ip_address(rng.getrandbits(32))))
    return sorted(set(out))


def test_canonical_text(rows):
    texts = addresses()
    got = dict(values(rows([(t,) for t in texts], "ip string").select("ip", net.ip_canon("ip").alias("c"))))
    # glibc prints low addresses as dotted text; ours are hexadecimal.
    for text in texts:
        want = canonical(text)
        if want and "." in want and ":" in want and not want.startswith("::ffff:"):
            continue
        assert got[text] == want, text


def test_networks(rows):
    texts = [t for t in addresses() if canonical(t)]
    for bits in (1, 8, 12, 31, 32):
        got = dict(values(rows([(t,) for t in texts if ":" not in t], "ip string").select("ip", net.ip_net("ip", bits))))
        for text, found in got.items():
            assert found == str(ipaddress.ip_network((text, bits), strict=False).network_address), (text, bits)
    for bits in (1, 48, 64, 65, 127, 128):
        v6 = [t for t in texts if ":" in t]
        got = dict(values(rows([(t,) for t in v6], "ip string").select("ip", net.ip_net("ip", bits))))
        for text, found in got.items():
            want = ipaddress.ip_network((text, bits), strict=False).network_address
            assert ipaddress.ip_address(found) == want, (text, bits)


def test_public_addresses(rows):
    texts = [t for t in addresses() if canonical(t)]
    got = dict(values(rows([(t,) for t in texts], "ip string").select("ip", net.p_public_ip("ip"))))
    for text, found in got.items():
        ip = ipaddress.ip_address(text)
        if ip.version == 6:
            want = not (ip.is_unspecified or ip.is_loopback or ip.is_multicast)
        else:
            documentation = any(
                ip in ipaddress.ip_network(n) for n in ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24")
            )
            private = any(ip in ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"))
            want = not (
                private or documentation or ip.is_loopback or ip.is_multicast or ip.is_link_local
                or str(ip) in ("255.255.255.255", "0.0.0.0")
            )
        assert found == want, text


def test_legacy_public_addresses(rows):
    data = [("10.1.1.1", False), ("127.0.0.1", True), ("224.1.1.1", False), ("f012::1", False), ("::1", True)]
    frame = rows(data, "ip string, want boolean").select("ip", "want", net.p_public_ip("ip", legacy=True).alias("got"))
    assert all(r.want == r.got for r in frame.collect())


def test_cidr_join_with_both_families(rows):
    rng = random.Random(2)
    hosts = [f"10.0.{rng.randrange(4)}.{rng.randrange(256)}" for _ in range(200)]
    hosts += [str(ipaddress.ip_address((0x20010DB8 << 96) + rng.getrandbits(70))) for _ in range(200)]
    ranges = [("10.0.0.0", 23), ("10.0.2.0", 31), ("10.0.2.8", 32), ("10.0.0.0", 8), ("0.0.0.0", 0), ("2001:db8::", 64), ("2001:db8::", 127), ("2001:db8::", 60)]
    want = sorted(
        (h, n, p) for h in hosts for n, p in ranges
        if p and ipaddress.ip_address(h).version == ipaddress.ip_address(n).version
        and ipaddress.ip_address(h) in ipaddress.ip_network((n, p))
    )
    got = net.cidr_join(rows([(h,) for h in hosts], "ip string"), "ip", rows(ranges, "network string, prefix int"))
    assert values(got, "ip", "network", "prefix") == sorted(want, key=repr)
    kept = net.drop_subnets(rows([(h,) for h in hosts], "ip string"), "ip", rows(ranges[:3], "network string, prefix int"))
    covered = {h for h, n, p in want if (n, p) in ranges[:3]}
    assert values(kept) == sorted(((h,) for h in hosts if h not in covered), key=repr)


def test_unmapped_and_ports(rows):
    frame = rows([("::ffff:1.2.3.4", 80), ("2001:db8::1", 443), ("1.2.3.4", None)], "ip string, port int").select(
        net.ip_text(net.unmap_v4(net.ip_bin("ip"))).alias("plain"), net.addr_port("ip", "port").alias("both")
    )
    assert values(frame) == sorted(
        [("1.2.3.4", "[::ffff:1.2.3.4]:80"), ("2001:db8::1", "[2001:db8::1]:443"), ("1.2.3.4", "1.2.3.4")], key=repr
    )
    back = frame.select(net.parse_addr_port("both").alias("p")).select("p.*")
    assert set(values(back)) == {("::ffff:1.2.3.4", 80), ("2001:db8::1", 443), ("1.2.3.4", None)}


def test_set_items(rows):
    data = [("1.2.3.4",), ("1.2.3.4,tcp:22",), ("1.2.3.0/24",), ("1.2.3.4/32",), ("2001:db8::1/128",), ("2001:db8::/32,udp:53",)]
    got = rows(data, "item string").select("item", net.parse_set_item("item").alias("i")).select("item", "i.*")
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == {
        "1.2.3.4": ("1.2.3.4", None, None, None),
        "1.2.3.4,tcp:22": ("1.2.3.4", "tcp", 22, None),
        "1.2.3.0/24": ("1.2.3.0", None, None, 24),
        "1.2.3.4/32": ("1.2.3.4", None, None, None),
        "2001:db8::1/128": ("2001:db8::1", None, None, None),
        "2001:db8::/32,udp:53": ("2001:db8::", "udp", 53, 32),
    }


def test_in_cidr(rows):
    frame = rows([("10.0.0.7",), ("10.0.0.8",), ("2001:db8::7",), ("bad",)], "addr string")
    got = frame.select(
        "addr", net.in_cidr("addr", "10.0.0.0", 29).alias("v4"), net.in_cidr("addr", "2001:db8::", 64).alias("v6"),
        net.in_cidr("addr", "0.0.0.0", 0).alias("zero"),
    )
    assert set(values(got)) == {
        ("10.0.0.7", True, False, False), ("10.0.0.8", False, False, False),
        ("2001:db8::7", False, True, False), ("bad", False, False, False),
    }
