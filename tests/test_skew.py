"""Ordered helpers against brute force, with one key that holds most rows."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netloom.functions.times import hour_of, micros
from netloom.operators import chains, limits, ordering, packets

BASE = datetime(2024, 1, 1)


@pytest.fixture
def events(rows):
    rng = random.Random(3)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}"
        data.append((key, i, BASE + timedelta(seconds=rng.randrange(40_000)), rng.choice([None, i])))
    return data, rows(data, "k string, id long, ts timestamp_ntz, v long")


def by_key(data):
    groups = {}
    for row in data:
        groups.setdefault(row[0], []).append(row)
    return {k: sorted(v, key=lambda r: (r[2], r[1])) for k, v in groups.items()}


def test_neighbours(events):
    data, df = events
    for ahead in (True, False):
        got = ordering.neighbour(df, ["k"], ["ts", "id"], hour_of("ts"), {"other": "id"}, ahead)
        found = {r.id: r.other for r in got.collect()}
        for group in by_key(data).values():
            for i, row in enumerate(group):
                j = i + 1 if ahead else i - 1
                assert found[row[1]] == (group[j][1] if 0 <= j < len(group) else None)


def test_ranks(events):
    data, df = events
    found = {r.id: r.n for r in ordering.ranked(df, ["k"], ["ts", "id"], hour_of("ts"), "n").collect()}
    for group in by_key(data).values():
        assert [found[r[1]] for r in group] == list(range(1, len(group) + 1))


def test_carry_forward(events):
    data, df = events
    got = ordering.carry_forward(df, ["k"], ["ts", "id"], hour_of("ts"), "v", "seen")
    found = {r.id: r.seen for r in got.collect()}
    for group in by_key(data).values():
        last = None
        for row in group:
            last = row[3] if row[3] is not None else last
            assert found[row[1]] == last


def test_top_k(events):
    data, df = events
    got = ordering.top_k(df, ["k"], [F.desc("ts"), "id"], 50, salts=7)
    found = {r.id for r in got.where("in_top").collect()}
    assert got.count() == len(data)
    for group in by_key(data).values():
        best = sorted(group, key=lambda r: (-r[2].timestamp(), r[1]))[:50]
        assert {r[1] for r in best} == {r[1] for r in group} & found


def test_exact_median(events):
    data, df = events
    got = ordering.exact_median(df.withColumn("us", micros("ts") - micros(F.lit(BASE).cast("timestamp_ntz"))), ["k"], "us")
    found = {r.k: r.median for r in got.collect()}
    for key, group in by_key(data).items():
        assert found[key] == statistics.median((r[2] - BASE) / timedelta(microseconds=1) for r in group)


def test_greedy_windows(events):
    data, df = events
    got = chains.greedy_windows(df, ["k"], "ts", 500_000_000)
    found = {r.id: r.start for r in got.collect()}
    for group in by_key(data).values():
        start = None
        for row in group:
            if start is None or row[2] > start + timedelta(seconds=500):
                start = row[2]
            assert found[row[1]] == start


def test_login_bursts(events, rows):
    data, _ = events
    logs = rows([("s", k, i, ts, "login") for k, i, ts, _ in data], "server string, remote string, id long, timestamp timestamp_ntz, event string")
    found = {(r.remote, r.id) for r in limits.login_bursts(logs, 5, 600_000_000).collect()}
    want = set()
    for key, group in by_key(data).items():
        count, quiet = 0, None
        for row in group:
            count += 1
            if count >= 5 and (quiet is None or row[2] >= quiet):
                want.add((key, row[1]))
                count, quiet = 0, row[2] + timedelta(seconds=600)
    assert found == want


def walked_limit(messages, inflow, seconds, full):
    """Accepted ids by walking the messages of each client."""
    tick_of = lambda ts: int((ts - datetime(1970, 1, 1)).total_seconds()) // seconds
    accepted = set()
    for group in by_key(messages).values():
        tokens, tick = full, None
        for _, number, ts, cost in group:
            now = tick_of(ts)
            tokens = tokens if tick is None else min(full, tokens + inflow * (now - tick))
            tick = now
            if cost < tokens:
                accepted.add(number)
                tokens -= cost
    return accepted


@pytest.mark.parametrize(("cost", "kind", "factor"), [(1, "long", 5), (0.75, "double", 5), (1, "long", 1_000_000)])
def test_rate_limit(events, rows, cost, kind, factor):
    """Whole and fractional costs, a NULL client, and a capacity of millions in the same time."""
    data, _ = events
    messages = [(k if i % 9 else None, i, ts, cost * (1 + i % 6)) for i, (k, _, ts, _) in enumerate(data)]
    if factor > 5:
        messages = [(k, i, ts, c * 3_000_000) for k, i, ts, c in messages]
    df = rows(messages, f"client string, id long, ts timestamp_ntz, cost {kind}").withColumn("row", F.lit("x"))
    got = limits.rate_limit(df, 4, 60, factor, chunk_refills=10)
    flags = {r.id: r.accepted for r in got.collect()}
    assert len(flags) == len(messages) and {i for i, f in flags.items() if f} == walked_limit(messages, 4, 60, 4 * factor)
    assert set(flags.values()) == {True, False}


def test_rate_limit_without_cost_or_time(rows):
    data = [(1, 1, BASE, 3), (1, 2, BASE, None), (1, 3, None, 1), (1, 4, BASE, 3)]
    df = rows(data, "client long, id long, ts timestamp_ntz, cost long")
    assert {r.id: r.accepted for r in limits.rate_limit(df, 1, 60).collect()} == {1: True, 2: False, 3: False, 4: False}


# Events of one connection as (second, kind, reason), and the reasons reported.
ATTEMPTS = [
    ([(0, "syn", None)], ["T"]),
    ([(0, "syn", None), (1, "ack", None)], []),
    ([(0, "ack", None), (1, "syn", None)], []),
    ([(0, "syn", None), (1, "nak", "P")], ["P"]),
    ([(0, "syn", None), (1, "ack", None), (2, "nak", "P")], []),
    ([(0, "syn", None), (1, "nak", "N"), (2, "ack", None)], ["N"]),
    ([(0, "nak", "H"), (1, "nak", "A"), (2, "syn", None)], ["A"]),
    ([(0, "nak", "H"), (1, "ack", None), (2, "syn", None)], []),
    ([(0, "syn", None), (1, "syn", None), (2, "nak", "O")], ["O"]),
    ([(0, "nak", "P")], []),
    ([(0, "syn", None), (1, "nak", "P"), (60, "syn", None)], ["P", "T"]),
]


def test_refused(rows):
    data = [
        (client, "198.51.100.1", 40000, 22, BASE + timedelta(seconds=second), kind, reason)
        for client, (steps, _) in enumerate(ATTEMPTS)
        for second, kind, reason in steps
    ]
    events = rows(
        data, "client long, address string, local_port int, remote_port int, ts timestamp_ntz, kind string, reason string"
    )
    found = {}
    for r in packets.classify_refused(events).orderBy("timestamp").collect():
        found.setdefault(r.client, []).append(r.reason)
    assert found == {client: want for client, (_, want) in enumerate(ATTEMPTS) if want}


def test_capture_warnings(rows):
    data = [(1, i, BASE + timedelta(seconds=60 * i), "?", "in", "I") for i in range(40)]
    df = rows(data, "client long, id long, ts timestamp_ntz, layer string, direction string, app_protocol string")
    got = packets.capture_warnings(df)
    # Windows of 16 packets (0-15, 16-31, 32-39); the last one is too short.
    assert sorted(r.ts for r in got.collect()) == [BASE + timedelta(minutes=9), BASE + timedelta(minutes=25)]


@pytest.mark.parametrize("chunks", [1, 256])
def test_chains_over_many_chunks(rows, monkeypatch, chunks):
    """One key has 90 % of the rows; blocks of one chunk and of many; sparse and dense stretches."""
    monkeypatch.setattr(chains, "BLOCK_CHUNKS", chunks)
    rnd = random.Random(11)
    data, t = [], 0
    for i in range(4000):
        t += rnd.choice((0, 1, 3, 20, 20, 200, 5000 if i % 50 == 0 else 7))
        data.append(("hot" if i % 10 else rnd.choice(["a", None]), i, BASE + timedelta(seconds=t)))
    df = rows(data, "k string, id long, ts timestamp_ntz")
    got = {r.id: r.start for r in chains.greedy_windows(df, ["k"], "ts", 60_000_000).collect()}
    logs = df.selectExpr("'telnet' AS server", "k AS remote", "'login' AS event", "id", "ts AS timestamp")
    alarms = {(r.id, r.n) for r in limits.login_bursts(logs, 4, 60_000_000).collect()}
    want, bursts = {}, set()
    for key in ("hot", "a", None):
        start = quiet = None
        since = 0
        for n, (_, number, ts) in enumerate(sorted((r for r in data if r[0] == key), key=lambda r: (r[2], r[1])), 1):
            if start is None or ts > start + timedelta(seconds=60):
                start = ts
            want[number] = start
            since += 1
            if since >= 4 and (quiet is None or ts >= quiet):
                bursts.add((number, n))
                since, quiet = 0, ts + timedelta(seconds=60)
    assert got == want and alarms == bursts
