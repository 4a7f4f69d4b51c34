"""Streams in several micro-batches: state, late rows and retries."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import values
from netloom.operators import limits, packets
from netloom.streaming import jobs, stateful

T0 = datetime(2024, 1, 1)
DDL = "client long, ts timestamp_ntz, direction string, length long"


def files(spark, folder, batches, ddl):
    """One file per batch, read one by one in order."""
    import time

    for batch in batches:
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are read by age
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(folder)


def test_late_packets_are_dropped(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    batches = [
        [(1, at(0), "in", 10), (1, at(50), "in", 10)],
        [(1, at(300), "in", 5)],
        [(1, at(10), "in", 1000), (1, at(301), "in", 5)],  # the first one is far behind
    ]
    stream = files(spark, str(tmp_path / "in"), batches, DDL)
    peaks = jobs.stream_peaks(stream, "60 seconds", (10_000_000, 5_000_000), lateness="20 seconds")
    jobs.write_batches(peaks, str(tmp_path / "out"), str(tmp_path / "state"), "append")
    got = {(r.timestamp, r.win_len): r.in_max for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[(T0, 10_000_000)] == 10
    assert all(v < 1000 for v in got.values())


def test_peaks_equal_the_batch_form(spark, tmp_path):
    at = lambda s: T0 + timedelta(milliseconds=s)
    data = [(i % 3, at(i * 137), "in" if i % 2 else "out", 10 + i % 7) for i in range(2000)]
    ender = [(9, at(10_000_000), "in", 1)]
    stream = files(spark, str(tmp_path / "in"), [data[:1000], data[1000:], ender, ender], DDL)
    jobs.write_batches(jobs.stream_peaks(stream, "60 seconds"), str(tmp_path / "out"), str(tmp_path / "state"), "append")
    got = spark.read.parquet(str(tmp_path / "out")).where("client < 9")
    want = packets.peak_bandwidth(spark.createDataFrame(data, DDL), 60_000_000)
    key = lambda r: (r.timestamp, r.client, r.win_len, r.in_max, r.out_max)
    assert sorted(map(key, got.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).collect())) == sorted(map(key, want.collect()))


def shuffled(rows, time_of):
    """Three batches of rows in time order, in which neighbours across their edges are exchanged."""
    rows = sorted(rows, key=time_of)
    third = len(rows) // 3
    parts = [rows[:third], rows[third : 2 * third], rows[2 * third :]]
    for a, b in zip(parts, parts[1:]):
        a[-6:], b[:6] = b[:6], a[-6:]
    return [random.Random(5).sample(p, len(p)) for p in parts]


def drained(spark, tmp_path, rows, time_of, ddl, build, column, marker=None):
    """The rows of a stream over three micro-batches out of order, written to the end."""
    stateful.use_rocksdb(spark)
    stream = files(spark, str(tmp_path / "in"), shuffled(rows, time_of), ddl)
    jobs.write_to_end(stream, build, column, str(tmp_path / "out"), str(tmp_path / "state"), marker=marker)
    return spark.read.parquet(str(tmp_path / "out"))


def test_alarms_equal_the_batch_form(spark, tmp_path):
    rnd = random.Random(1)
    ddl = "id long, server string, remote string, event string, timestamp timestamp_ntz"
    data = [(i, "telnet", rnd.choice(["a", "b", None]), "login" if i % 7 else "command", T0 + timedelta(seconds=4 * i)) for i in range(300)]
    build = lambda rows: stateful.stream_login_bursts(rows, 4, 60_000_000, "2 minutes")
    got = drained(spark, tmp_path, data, lambda r: r[4], ddl, build, "timestamp", jobs.LOGIN_MARKER)
    want = limits.login_bursts(spark.createDataFrame(data, ddl), 4, 60_000_000)
    assert values(got, "server", "remote", "id", "timestamp") == values(want, "server", "remote", "id", "timestamp")


def test_forgotten_alarms(spark, tmp_path):
    ddl = "id long, server string, remote string, event string, timestamp timestamp_ntz"
    data = [(i, "telnet", "a", "login", T0 + timedelta(seconds=s)) for i, s in enumerate((0, 1, 100, 101, 102, 103))]
    build = lambda rows: stateful.stream_login_bursts(rows, 3, 1_000_000, "2 minutes", 50_000_000)
    got = drained(spark, tmp_path, data, lambda r: r[4], ddl, build, "timestamp", jobs.LOGIN_MARKER)
    assert [r.id for r in got.collect()] == [4]


def test_limits_equal_the_batch_form(spark, tmp_path):
    rnd = random.Random(2)
    ddl = "client long, id long, ts timestamp_ntz, cost long"
    data = [(rnd.choice([1, 2, None]), i, T0 + timedelta(seconds=3 * i + (i // 100) * 900), 1 + i % 5) for i in range(300)]
    build = lambda rows: stateful.stream_rate_limit(rows, 4, 30, lateness="2 minutes")
    got = drained(spark, tmp_path, data, lambda r: r[2], ddl, build, "ts")
    want = limits.rate_limit(spark.createDataFrame(data, ddl), 4, 30)
    assert values(got, "client", "id", "accepted") == values(want, "client", "id", "accepted")
    assert 0 < got.where("accepted").count() < len(data)


def test_sessions_equal_the_batch_form(spark, tmp_path):
    rnd = random.Random(3)
    ddl = "id long, client long, activity string, timestamp timestamp_ntz"
    data = [(i, rnd.randint(1, 4), rnd.choice(["login", "logout", "push"]), T0 + timedelta(seconds=2 * i)) for i in range(300)]
    build = lambda rows: stateful.stream_client_sessions(rows, "2 minutes")
    got = drained(spark, tmp_path, data, lambda r: r[3], ddl, build, "timestamp", jobs.SESSION_MARKER)
    want, last = [], {}
    for _, client, activity, ts in sorted(data, key=lambda r: r[3]):
        if activity != "push":
            if last.get(client):
                want.append((client, last[client], ts, "relogin" if activity == "login" else "logout"))
            last[client] = ts if activity == "login" else None
    assert values(got, "client", "start", "end", "ended") == sorted(want, key=repr)


def test_refusals_equal_the_batch_form(spark, tmp_path):
    rnd = random.Random(4)
    ddl = "client long, address string, local_port int, remote_port int, ts timestamp_ntz, kind string, reason string"
    data = []
    for i in range(400):
        kind = rnd.choice(["syn", "syn", "ack", "nak"])
        data.append((rnd.choice([1, 2, 3, None]), "a", 1, 2, T0 + timedelta(seconds=5 * i), kind, rnd.choice("NHP") if kind == "nak" else None))
    build = lambda rows: stateful.stream_refused(rows, lateness="2 minutes")
    got = drained(spark, tmp_path, data, lambda r: r[4], ddl, build, "ts")
    want = packets.classify_refused(spark.createDataFrame(data, ddl))
    columns = [*packets.CONNECTION, "timestamp", "reason"]
    assert values(got, *columns) == values(want, *columns) and got.count() > 20


def test_a_repeated_batch_counts_once(spark, tmp_path):
    rows = spark.range(10).withColumnRenamed("id", "n")
    rows.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    # Two queries with fresh checkpoints both write batch 0: the folder is replaced.
    for state in ("a", "b"):
        stream = spark.readStream.schema("n long").parquet(str(tmp_path / "in"))
        jobs.write_batches(stream, out, str(tmp_path / state), "append")
    assert spark.read.parquet(out).count() == 10


def test_flow_sessions_close_after_a_silence(spark, tmp_path):
    """A session over two batches, out of order, is one flow; a gap makes two."""
    ddl = (
        "client long, ts timestamp_ntz, direction string, length long, layer string, ip_protocol int, app_protocol string, "
        "addr_local string, addr_remote string, port_local int, port_remote int, tcp_flags int"
    )
    at = lambda s: T0 + timedelta(seconds=s)
    packet = lambda s, client=1: (client, at(s), "in", 10, "I", 4, "T", "l", "r", 1, 2, 0)
    data = [[packet(0), packet(100)], [packet(160), packet(130)], [packet(400)]]
    stream = files(spark, str(tmp_path / "in"), [*data, [packet(9_000, 2)], [packet(9_001, 2)]], ddl)
    flows = jobs.stream_flow_sessions(stream, "2 minutes")
    jobs.write_batches(flows, str(tmp_path / "out"), str(tmp_path / "state"), "append")
    got = spark.read.parquet(str(tmp_path / "out")).where("client = 1").orderBy("start_in").collect()
    assert [(r.start_in, r.stop_in, r.count_in, r.size_in) for r in got] == [(at(0), at(160), 4, 40), (at(400), at(400), 1, 10)]


def test_compaction_keeps_rows_and_bounds_files(spark, tmp_path):
    """Totals per hour over many arrivals; after each, some hours are closed and some change again."""
    ddl = "timestamp timestamp_ntz, client long, n long"
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rng, want, touched = random.Random(3), {}, []

    def total():
        return {(r.timestamp, r.client): r.n for r in jobs.read_latest(spark, out, keys).collect()}

    keys = ["timestamp", "client"]
    for step in range(6):
        rows = [(T0 + timedelta(hours=step * 2 - rng.randrange(3)), k % 3, k) for k in range(20)]
        for hour, client, n in rows:
            want[hour, client] = want.get((hour, client), 0) + n
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.timed(spark.readStream.schema(ddl).parquet(source), "timestamp", "4 hours")
        jobs.write_batches(stream.groupBy(*keys).agg(F.sum("n").alias("n")), out, state)
        jobs.compact_batches(spark, out, keys, "timestamp", "4 hours")
        touched.append(len([f for f in (tmp_path / "out").iterdir() if f.name.startswith("batch=")]))
        assert total_of(total(), T0) == total_of(want, T0)
    assert max(touched) <= 4 and touched[-1] <= touched[2]
    # What an ended attempt has left behind does not count, and a second call changes nothing.
    spark.createDataFrame([(T0, 0, 10**6)], ddl).write.parquet(f"{out}-closed/upto=999")
    assert total_of(total(), T0) == total_of(want, T0)
    jobs.compact_batches(spark, out, keys, "timestamp", "4 hours")
    assert total_of(total(), T0) == total_of(want, T0)
    assert list((tmp_path / "out-closed").glob("upto=*/*.parquet"))


def total_of(totals, start):
    """Totals by hours since `start`, whatever kind of time Spark gave back."""
    return {(int((h.replace(tzinfo=None) - start).total_seconds()), c): n for (h, c), n in totals.items()}
